"""Sources: all give DataFrames, with raw logs as id, source_collection, line, metadata."""
from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import log_format, long_hash, split_lines, strip
from ..schemas import RAW_LOG

NO_META = "cast(map() as map<string,string>)"


def spread(df: DataFrame) -> DataFrame:
    """A scan, dealt out anew if it has fewer partitions than half the cores; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def limited(df: DataFrame, most: int = -1) -> DataFrame:
    """At most so many rows; a negative number is no limit."""
    return df.limit(most) if most >= 0 else df


def search_hits(hits: DataFrame, collection: str = "search", most: int = -1) -> DataFrame:
    """Raw logs from hits (id, results array<struct<body>>): the non-empty lines of every body."""
    lines = hits.select("id", F.posexplode("results").alias("r", "x")).select("id", "r", F.posexplode(split_lines(F.col("x.body"))).alias("l", "line")).filter(F.length("line") > 0)
    key = long_hash(F.concat_ws("|", F.lit(collection), "id", "r", "l", "line"))
    return limited(lines.select(key.alias("id"), F.lit(collection).alias("source_collection"), "line", F.expr(NO_META).alias("metadata")), most)


def load_config(path: str) -> dict:
    """host, port and collections (name, id_field, prop_fields, text_fields); host and port from the environment
    variables DB_HOST and DB_PORT where the file has none."""
    with open(path) as f:
        config = json.load(f)
    config["host"] = config.get("host") or os.environ.get("DB_HOST", "")
    config["port"] = config.get("port") or int(os.environ.get("DB_PORT", 0))
    for c in config.get("collections", []):
        if not {"name", "id_field", "prop_fields", "text_fields"} <= c.keys():
            raise ValueError(f"collection needs name, id_field, prop_fields and text_fields: {c}")
    return config


def crawl(tables: dict[str, DataFrame], config: dict) -> DataFrame:
    """Raw logs of the configured collections: properties that a document has go to metadata, text fields are cut
    into lines (of arrays, each item is one); missing fields are skipped, empty lines stay."""
    out = None
    for c in config["collections"]:
        t = tables[c["name"]]
        props = [p for p in c["prop_fields"] if p in t.columns]
        meta = F.map_filter(F.create_map(*[x for p in props for x in (F.lit(p), F.col(p).cast("string"))]), lambda k, v: v.isNotNull()) if props else F.expr(NO_META)
        texts = [F.col(x) if isinstance(t.schema[x].dataType, T.ArrayType) else split_lines(F.col(x)) for x in c["text_fields"] if x in t.columns]
        lines = F.flatten(F.filter(F.array(*texts), lambda a: a.isNotNull())) if texts else F.array().cast("array<string>")
        rows = t.select(F.col(c["id_field"]).cast("string").alias("id"), F.lit(c["name"]).alias("source_collection"), F.explode(lines).alias("line"), meta.alias("metadata"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no collections")
    return out


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("line"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_LOG) -> DataFrame:
    """Decoded records of a file of JSON lines; a broken line is a row of nulls."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def json_directory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)


def format_columns(df: DataFrame, fmt: str, line: str = "line", drop: bool = True) -> DataFrame:
    """df with a column for each field of a log format; lines that do not match go, or have nulls and rejected."""
    names, rx = log_format(fmt)
    text = strip(F.col(line))
    hit = text.rlike(rx)
    df = df.filter(hit) if drop else df.withColumn("rejected", ~F.coalesce(hit, F.lit(False)))
    return df.withColumns({n: F.when(hit, F.regexp_extract(text, rx, i + 1)) for i, n in enumerate(names)})


def numbered(df: DataFrame, order: str | Column, name: str = "log_id", by: str | None = None) -> DataFrame:
    """1-based ordinals in order (of the rows with one value of by), without one task for all rows: rows are
    range-partitioned, counted, and numbered from their partition's offset."""
    from ..operators.scratch import cut

    n, by_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [by] if by else []
    parts = cut(df.repartitionByRange(n, *by_, order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p", *by_).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by_).orderBy("_p")  # a row per partition
    offsets = sizes.select(F.col("_p").alias("_q"), *[F.col(c).alias("_by") for c in by_], (F.sum("_n").over(before) - F.col("_n")).alias("_o"))
    same = F.col("_p") == F.col("_q")
    joined = parts.join(offsets, same & F.col(by).eqNullSafe(F.col("_by")) if by else same)
    number = F.row_number().over(Window.partitionBy("_p", *by_).orderBy(order)) + F.col("_o")
    return joined.withColumn(name, number.cast("long")).drop("_p", "_q", "_o", "_by")


def structured_csv(spark: SparkSession, path: str) -> DataFrame:
    """content and event_id of a structured log, whichever case its header has."""
    t = spark.read.option("header", True).csv(path)
    names = {c.lower().replace("_", ""): c for c in t.columns}
    return t.select(F.col(names["content"]).alias("content"), F.col(names["eventid"]).alias("event_id"))


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """x (array) and y of an NPZ file with x_data and y_data."""
    import numpy as np

    with np.load(path, allow_pickle=False) as f:
        return spark.createDataFrame([(x.tolist() if x.ndim else x.item(), int(y)) for x, y in zip(f["x_data"], f["y_data"])])


def labelled_urls(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    t = spark.read.option("header", True).csv(path)
    return t.select("url", (F.col("label") == "bad").cast("int").alias("label")).orderBy(F.xxhash64(F.lit(seed), "url"), "url")


def topic(spark: SparkSession, source: str, name: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """A stream of records of a topic: source is a Kafka bootstrap address (kafka://host:port), or a folder that has
    a folder of text files for each topic."""
    if source.startswith("kafka://"):
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", source[8:]).option("subscribe", name).options(**options).load().select(F.col("value").cast("string"))
    else:
        raw = spark.readStream.options(**options).text(f"{source}/{name}")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*") if schema else raw


def first_rows(vertices: DataFrame, collection: str, n: int = 11) -> DataFrame:
    return vertices.filter(F.col("collection") == collection).limit(n)


def edges_of(edges: DataFrame, collection: str, src: str) -> DataFrame:
    return edges.filter((F.col("collection") == collection) & (F.col("src") == src))
