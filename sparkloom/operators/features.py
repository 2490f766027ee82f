"""Event count features in long form: instance, event, x."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Events of a vocabulary that is broadcast (a few MB).
SMALL = 50_000


def counts(rows: DataFrame, instance: str, event: str) -> DataFrame:
    """instance, event, x for each that occurs; rows: one per event."""
    return rows.groupBy(F.col(instance).alias("instance"), F.col(event).alias("event")).agg(F.count("*").cast("double").alias("x"))


def wide(long: DataFrame, events: list[str]) -> DataFrame:
    """A column for each event, 0 where it does not occur."""
    return long.groupBy("instance").pivot("event", events).agg(F.sum("x")).na.fill(0.0)


def sigmoid(x):
    return F.when(x != 0, 1 / (1 + F.exp(-x))).otherwise(0.0)


@dataclass
class FeatureModel:
    """What fit() learned: the vocabulary with df, idf and mean (a table), how many instances there were."""

    vocabulary: DataFrame
    n: int
    weighting: str | None
    normalization: str | None
    oov: bool
    min_count: int

    def transform(self, long: DataFrame, fitted: bool = False) -> DataFrame:
        """instance, event, x for every instance and event of the vocabulary, so that means apply to zeros as well;
        with oov, event null counts what is not in it: distinct unseen events, or, of the fitted rows, rare ones."""
        base = long.select("instance").distinct()
        v = self.vocabulary.filter("kept")
        x = self._dense(long, v) if self.normalization == "zero-mean" else long.join(v, "event")
        if self.weighting == "tf-idf":
            x = x.withColumn("x", F.col("x") * F.col("idf"))
        if self.normalization == "zero-mean":
            x = x.withColumn("x", F.col("x") - F.col("mean"))
        elif self.normalization == "sigmoid":
            x = x.withColumn("x", sigmoid(F.col("x")))
        out = x.select("instance", "event", "x")
        if self.oov:
            known = self.vocabulary.filter("kept") if not fitted else self.vocabulary.filter(F.col("df") >= self.min_count)
            strange = long.join(known.select("event"), "event", "left_anti").groupBy("instance").agg(F.countDistinct("event").cast("double").alias("o"))
            extra = base.join(strange, "instance", "left").select("instance", F.lit(None).cast("string").alias("event"), F.coalesce("o", F.lit(0.0)).alias("x"))
            out = out.unionByName(extra)
        return out


    def _dense(self, long: DataFrame, v: DataFrame) -> DataFrame:
        """A row for each instance and event, which is what the mean is taken from. Zeros are not stored or joined:
        an instance's counts meet as one map, and the vocabulary, a row per event, is spread from there."""
        events = F.array_sort(F.collect_list(F.struct("event", "df", "idf", "mean", "kept"))).alias("voc")
        every = v.agg(events).withColumn("one", F.lit(1))
        counts = long.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct("event", "x"))).alias("held")).withColumn("one", F.lit(1))
        small = self.vocabulary.count() <= SMALL
        met = counts.join(F.broadcast(every) if small else every, "one")
        out = met.select("instance", "held", F.explode("voc").alias("w")).select("instance", "w.*", F.coalesce(F.try_element_at("held", F.col("w.event")), F.lit(0.0)).alias("x"))
        return out


def fit(long: DataFrame, weighting: str | None = None, normalization: str | None = None, oov: bool = False, min_count: int = 1) -> FeatureModel:
    """Learns df, idf = ln(n / (df + 1e-8)) and means (over all instances, zeros included) of weighted counts. With
    oov and min_count over 1, events of fewer instances than that leave the vocabulary."""
    n = long.select("instance").distinct().count()
    v = long.groupBy("event").agg(F.count("*").alias("df"), F.sum("x").alias("s"))
    v = v.withColumn("idf", F.log(F.lit(float(n)) / (F.col("df") + 1e-8)))
    mean = F.col("s") * (F.col("idf") if weighting == "tf-idf" else F.lit(1.0)) / float(max(n, 1))
    v = v.withColumn("mean", mean).withColumn("kept", F.lit(not oov or min_count <= 1) | (F.col("df") >= min_count))
    return FeatureModel(v.select("event", "df", "idf", "mean", "kept"), n, weighting, normalization, oov, min_count)
