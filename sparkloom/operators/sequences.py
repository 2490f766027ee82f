"""Event sequences by entity or session, and splits into train and test."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import block_ids
from ..sources.readers import numbered


def sequences(events: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    """key, events: each key's events in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_e"))))
    return events.groupBy(key).agg(F.transform(pairs, lambda x: x["_e"]).alias("events"))


def entity_sequences(parsed: DataFrame, order: str, entity: str = "ip_address", event: str = "event_id") -> DataFrame:
    """value, events: a log that has a value twice counts twice."""
    rows = parsed.select(order, event, F.posexplode("params").alias("_i", "p")).filter(F.col("p.entity") == entity)
    return sequences(rows.withColumn("value", F.col("p.value")), "value", event, [order, "_i"])


def session_sequences(logs: DataFrame, order: str, content: str = "content", event: str = "event_id") -> DataFrame:
    """block_id, events: each log once for every block it names."""
    rows = logs.select(order, event, F.explode(block_ids(F.col(content))).alias("block_id"))
    return sequences(rows, "block_id", event, [order])


def labelled(seqs: DataFrame, labels: DataFrame, key: str, label: str, anomalous: str = "Anomaly") -> DataFrame:
    return seqs.join(labels.select(key, (F.col(label) == anomalous).cast("int").alias("label")), key, "left")


def split_by_class(rows: DataFrame, label: str, order: Column | str, test_ratio: float) -> DataFrame:
    """rows with part: of each class, the first int(n * (1 - test_ratio)) by order are train, the rest test. Rows are
    numbered by ranges, so that a class is no one task."""
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.floor(F.count("*") * (1 - test_ratio)).alias("_train"))
    out = numbered(rows, order, "_number", label).join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return out.withColumn("part", F.when(F.col("_number") <= F.col("_train"), "train").otherwise("test")).drop("_number", "_label", "_train")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows in an order that only key and seed decide."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def split_statistics(parts: DataFrame, label: str, positive=1) -> DataFrame:
    """part, n, positive, negative of a split's rows; a null label is neither."""
    hit = F.col(label) == positive
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.count_if(hit).alias("positive"), F.count_if(~hit).alias("negative"))
