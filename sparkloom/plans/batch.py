"""Batch mining of one log file to a pair of CSV tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import positional_params
from ..functions.entities import PATTERNS, extract_entities
from ..functions.strings import nascii, short_hash, strip, word_tokens
from ..operators.mining import mine_exact, template_counts
from ..sources import readers, sinks


def mine_lines(lines: DataFrame, order: str, fmt: str = "<content>", tau: float = 0.5, patterns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(structured, templates): structured has log_id (1 to n over the lines that match the format), the format's
    columns, event_id, template and parameters, a JSON list: entities by start with their pos, then, unless the line
    opened its cluster, the tokens that differ from the template, without entity and pos."""
    kept = readers.format_columns(lines.withColumn("line", strip(nascii(F.col("line")))), fmt)
    kept = readers.numbered(kept, order)
    e = extract_entities(kept, "content", PATTERNS if patterns is None else patterns, whole=True).withColumn("tokens", word_tokens(F.col("rewritten")))
    mined = mine_exact(e, "log_id", "tokens", stream=False, tau=tau)
    x = e.join(mined.select("log_id", "template", "template_then", "is_new"), "log_id")
    row = lambda a, z, entity, value, pos: F.struct(a.alias("start"), z.alias("end"), entity.alias("entity"), value.alias("value"), pos.alias("pos"))
    named = F.transform("entities", lambda p, i: row(p["char_start"], p["char_end"], p["entity"], p["value"], i))
    rest = F.transform(positional_params(F.split("template_then", " "), F.col("tokens")), lambda p: row(p["char_start"], p["char_end"], F.lit(None).cast("string"), p["value"], F.lit(None).cast("int")))
    params = F.to_json(F.when(F.col("is_new"), named).otherwise(F.concat(named, rest)))
    columns = [c for c in kept.columns if c not in (*lines.columns, "log_id")]
    structured = x.select("log_id", *columns, short_hash(F.col("template")).alias("event_id"), "template", params.alias("parameters"))
    return structured, template_counts(structured, F.col("template"))


def mine_file(spark: SparkSession, path: str, out: str, fmt: str = "<content>", tau: float = 0.5, patterns: dict[str, str] | None = None) -> None:
    """Mines a text file and writes <out>_structured.csv and <out>_templates.csv."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    structured, templates = mine_lines(lines, "line_no", fmt, tau, patterns)
    structured = structured.persist()
    try:
        sinks.structured_pair(structured, templates, out)
    finally:
        structured.unpersist()
