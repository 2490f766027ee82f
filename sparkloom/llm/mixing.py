"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are cut into ranges of about RANGE documents, and
those into blocks of BLOCK ranges. Token counts are summed where they lie and prefix-summed per source, first over
blocks, then over the ranges of the one block that holds the source's exact cut, which finds its range. Ranges below
it are taken, those above are not, and only the cut range is sorted. A source of a third of all rows is thus no more
than many ranges, and no task sees them all.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import written
from .common import WORD, rows_apart, unpacked, words_of

WEIGHTS, MOST, RANGE, BLOCK, SALT = (1, 2, 3), 3, 512, 4096, "mix-1"
#: Sources whose plan is broadcast (some MB); that of more is joined by a shuffle.
FEW = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, source, size, key)"""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return rows_apart(docs, source=F.col("source"), size=size, key=key)


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source, size), one row per source.

    Weights go by the sources' order, null last. All weights share the total; a source whose share is over MOST times
    its size gets that much and the rest is shared again: shares are w * L, capped, with one L for all. A source is
    capped if, with L at its own cap / w, the shares come to no more than the total.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    t = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("w", F.array(*map(F.lit, WEIGHTS))[F.col("rank") % len(WEIGHTS)].cast("long")).withColumn("cap", MOST * F.col("size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("size").over(every)).withColumn("ws", F.sum("w").over(every))
    t = t.withColumn("caps", F.sum("cap").over(by_ratio)).withColumn("wcaps", F.sum("w").over(by_ratio))
    t = t.withColumn("capped", F.col("caps").cast("double") + F.col("ratio") * (F.col("ws") - F.col("wcaps")) <= F.col("total"))
    t = t.withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    t = t.withColumn("wrest", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    share = F.col("w").cast("double") * F.col("rest").cast("double") / F.col("wrest").cast("double")
    return t.select(*sources.columns, F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _plan(stats: DataFrame) -> DataFrame:
    """A row for each source, written: source_, source_size, target, epochs, rest (words beyond whole epochs), ranges,
    cut (the range in which rest ends, -1: none) and before (words in the ranges below it). stats: (source, size, key)."""
    sums = targets(stats.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    sums = sums.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0))
    sums = sums.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("size")).withColumn("ranges", F.ceil(F.col("n") / RANGE))
    sums = written(sums.select(F.col("source").alias("source_"), F.col("size").alias("source_size"), "target", "epochs", "rest", "ranges"))
    same = F.col("source").eqNullSafe(F.col("source_"))
    ranges = stats.join(_few(sums.select("source_", "ranges")), same).groupBy("source_", _range().alias("range")).agg(F.sum("size").alias("sum"))
    ranges = written(ranges.withColumn("block", F.floor(F.col("range") / BLOCK)))

    def cut(parts: DataFrame, at: str, before: str) -> DataFrame:
        """Of each source, the part in which rest ends, and the words before it."""
        upto = F.sum("sum").over(Window.partitionBy("s").orderBy(at)) - F.col("sum") + F.col(before)
        rest = sums.select(F.col("source_").alias("r"), "rest")
        return parts.withColumn("upto", upto).join(_few(rest), F.col("s").eqNullSafe(F.col("r"))).filter("upto <= rest and rest < upto + sum").select("s", F.col(at).alias("cut"), F.col("upto").alias("before"))

    named = ranges.select(F.col("source_").alias("s"), "block", "range", "sum")
    block = written(cut(named.groupBy("s", "block").agg(F.sum("sum").alias("sum")).withColumn("zero", F.lit(0)), "block", "zero"))
    inside = named.join(_few(block.select(F.col("s").alias("b"), "cut", "before")), F.col("s").eqNullSafe(F.col("b")) & (F.col("block") == F.col("cut"))).select("s", "range", "sum", "before")
    found = cut(inside, "range", "before")
    plan = sums.join(found, F.col("source_").eqNullSafe(F.col("s")), "left")
    return written(plan.select(*sums.columns, F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("before", F.lit(0)).alias("before")), ranges, block)


def _range() -> Column:
    u32 = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    return F.shiftright(u32 * F.col("ranges"), 32)  # below 2^63 for 2^31 ranges


def _few(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= FEW else sources


def _mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, size, source_size, target, epochs, extra): how often rows (row, source, size, key) are taken whole, and how
    many words once more."""
    joined = rows.join(_few(plan), F.col("source").eqNullSafe(F.col("source_"))).withColumn("range", _range())
    whole = joined.filter("range <> cut").withColumn("extra", F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(0))
    upto = F.sum("size").over(Window.partitionBy("source_").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("before")
    edge = joined.filter("range = cut").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - upto)))
    return whole.unionByName(edge).select("row", "size", "source_size", "target", "epochs", F.col("extra").cast("long").alias("extra"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of each row.

    The size is the number of words of the whole text; null text: 0. Each source's taken words are the whole part of its target: whole
    epochs of all its documents, then documents by their keys, the last one in part. A null source is one like any
    other. Rows of the same doc_id have the same key and are taken shorter ones first. Only doc_id, text and source are
    read, whatever other columns are named. Empty table: no rows.
    """
    rows = _keyed(docs.select("doc_id", "text", "source")).select(F.struct("row.doc_id", "row.source").alias("row"), "source", "size", "key")
    rows = written(rows)
    out = _mixed(rows, _plan(rows.drop("row")))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", F.col("row.source").alias("source"), "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each epoch in which a document is taken, with its columns, whatever their names; a
    document taken in part keeps its first words, joined by a space (n_chars, if there, follows).

    Documents without words (null or empty texts) are not taken. Null sources, ties, repeated rows and empty tables as
    in mix_report; long texts are taken whole but for the one that the cut falls into.
    """
    stats = written(_keyed(docs.select("doc_id", "text", "source")).select("source", "size", "key"))
    rows = _mixed(_keyed(docs), _plan(stats))
    parts = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.array("extra"))
    rows = rows.withColumn("part", F.explode(F.filter(parts, lambda x: x > 0)))
    cut, text = F.col("part") < F.col("size"), F.col("row.text")
    row = F.col("row").withField("text", F.when(cut, F.array_join(F.slice(words_of(text), 1, F.col("part").cast("int")), " ")).otherwise(text))
    rows = rows.select(row.alias("row"), cut.alias("cut"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("cut"), F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))))
    return unpacked(rows, docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM sources
), weighed AS (
  SELECT *, 1 + r % 3 AS w, 3 * s AS cap, CAST(3 * s AS DOUBLE) / CAST(1 + r % 3 AS DOUBLE) AS ratio FROM ranked
), summed AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS ws,
    sum(cap) OVER (ORDER BY ratio, r ROWS UNBOUNDED PRECEDING) AS caps,
    sum(w) OVER (ORDER BY ratio, r ROWS UNBOUNDED PRECEDING) AS wcaps FROM weighed
), flagged AS (
  SELECT *, CAST(caps AS DOUBLE) + ratio * CAST(ws - wcaps AS DOUBLE) <= CAST(total AS DOUBLE) AS capped FROM summed
), aimed AS (
  SELECT source, s, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE)
    * CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE)
    / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM flagged
), planned AS (
  SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS e FROM aimed
), prefixed AS (
  SELECT d.*, p.s, p.target, p.e, CAST(floor(p.target) AS BIGINT) - p.e * p.s AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS upto
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source, s AS source_size, target,
  CAST(e * size + greatest(0, least(size, rest - upto)) AS BIGINT) AS taken FROM prefixed
"""
