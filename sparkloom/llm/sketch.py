"""Document fingerprints: a threshold-scaled sketch, in DataFrame functions only.

A sketch holds every hash of a text's 5-word shingles that lies in the lowest 1 / scale of all hashes, sorted and
distinct. Where these are fewer than `least` it holds the so many smallest hashes, so that short texts have a sketch
as well; its threshold is then its largest hash, or none if it holds all. least = 0 is the plain threshold sketch, with
one threshold for all texts. Up to the smaller of two sketches' thresholds, the sketch of a union is the union of the
sketches, and the share of the smaller one that the other holds estimates how far the one text is contained in the
other, however unequal their lengths.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import written
from .common import hex64, words_of

#: Words of a shingle; the default scale and least; ids in a range when ids are put in order.
SHINGLE, SCALE, LEAST, RANGE = 5, 8, 32, 1 << 16


def limit(scale: int) -> int:
    """The largest hash in the lowest 1 / scale."""
    return -(1 << 63) + (1 << 64) // scale - 1


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """df with the sketch of column text as array<long>. Steps are columns of their own, each used more than once, so
    that the optimizer does not write one into the other's lambda."""
    out = df.withColumn("_w", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - SHINGLE, F.lit(0)))
    shingles = F.transform(starts, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)]))
    out = out.withColumn("_h", F.when(F.size("_w") > 0, shingles).otherwise(F.array().cast("array<long>")))
    out = out.withColumn("_k", F.filter("_h", lambda h: h <= F.lit(limit(scale))))
    out = out.withColumn("_d", F.array_distinct("_k"))
    kept = F.sort_array("_d")
    if least:
        kept = F.when(F.size("_d") < least, F.slice(F.sort_array(F.array_distinct("_h")), 1, least)).otherwise(kept)
    return out.withColumn(name, kept).drop("_w", "_h", "_k", "_d")


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, hex64), "")


def with_likeness(df: DataFrame, a: str, b: str, name: str, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """df with near_<name>, the share of the smaller sketch that both have, and jaccard_<name>, both up to the smaller
    of the sketches' thresholds. Two empty sketches: 1; else, with nothing to compare: 0."""

    def threshold(c: str) -> Column:
        if not least:
            return F.lit(limit(scale))
        whole = F.size(c) < least  # all of the text's hashes
        return F.when(whole, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(limit(scale)), F.element_at(c, -1)))

    out = df.withColumn("_t", F.least(threshold(a), threshold(b)))
    out = out.withColumn("_a", F.filter(a, lambda h: h <= F.col("_t"))).withColumn("_b", F.filter(b, lambda h: h <= F.col("_t")))
    out = out.withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    fewer, union = F.least(F.size("_a"), F.size("_b")), F.size("_a") + F.size("_b") - F.col("_n")
    none = F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(0.0)
    return out.withColumn(f"near_{name}", F.when(fewer > 0, F.col("_n") / fewer).otherwise(none)).withColumn(f"jaccard_{name}", F.when(union > 0, F.col("_n") / union).otherwise(none)).drop("_t", "_a", "_b", "_n")


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids: the next larger one, after the largest the smallest.

    The ids are range-partitioned once, RANGE in a range; each range looks up its own neighbours, and a table of one
    row per range joins the ranges' ends. ids: a written table.
    """
    n = -(-ids.count() // RANGE) or 1
    ranges = written(ids.repartitionByRange(n, "doc_id").select("doc_id", F.spark_partition_id().alias("range")))
    heads = ranges.groupBy("range").agg(F.min("doc_id").alias("head"))
    in_order, every = Window.orderBy("range"), Window.partitionBy(F.lit(1))
    heads = written(heads.select("range", F.coalesce(F.lead("head").over(in_order), F.min("head").over(every)).alias("after")))
    following = ranges.withColumn("lead", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    return following.join(heads, "range").select("doc_id", F.coalesce("lead", "after").alias("next_id"))


def sketch_report(docs: DataFrame, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row, and
    jaccard_edited, jaccard_next.

    Likeness is containment of the smaller sketch in the other. Null text: empty, with an empty fingerprint, like only
    to another such. Texts of any length are read whole. Rows of the same doc_id each have the same next document: of
    the rows of the next larger id, the one whose head (as many characters as the longest text of the doc_id needs)
    sorts first, and of equal heads the one whose sketch does. A null doc_id has no next document and is followed by
    an empty one. Only doc_id and text are read, whatever other columns are named. Empty table: no rows.
    """
    every = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = every.filter("doc_id is not null")  # the same on both sides of the loan, so that texts are shuffled once
    quarter = lambda c: F.floor(F.length(c) / 4).cast("int")
    ids = written(d.groupBy("doc_id").agg(F.max(quarter("text")).alias("k")))
    order = written(next_ids(ids.select("doc_id")))
    wanted = written(order.join(ids, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "k"))
    lent = with_sketch(d.join(wanted, "doc_id"), "text", "next_sketch", scale, least)
    lent = lent.select(F.col("for_id").alias("doc_id"), F.struct(F.substring("text", F.lit(1), F.col("k")).alias("head"), "next_sketch").alias("next"))
    lent = lent.groupBy("doc_id").agg(F.min("next").alias("next"))
    alone = every.filter("doc_id is null").withColumn("next", F.lit(None).cast(lent.schema["next"].dataType))
    joined = d.join(lent, "doc_id", "left").unionByName(alone).withColumn("_q", quarter("text"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("_q")), F.coalesce(F.substring("next.head", F.lit(1), F.col("_q")), F.lit("")))
    joined = joined.select("doc_id", F.col("text"), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), F.coalesce("next.next_sketch", F.array().cast("array<long>")).alias("c"))
    joined = with_sketch(with_sketch(joined, "text", "a", scale, least), "edited", "b", scale, least)
    joined = with_likeness(with_likeness(joined, "a", "b", "edited", scale, least), "a", "c", "next", scale, least)
    return joined.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), "near_edited", "near_next", "jaccard_edited", "jaccard_next")
