"""From raw logs to parsed logs to graph tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import extract_entities, to_line
from ..functions.strings import join_tokens, long_hash, nascii, short_hash, strip, token_index, tokens
from ..operators.graph import log_graph
from ..operators.kernel import STAR
from ..functions.arrays import wildcards
from ..operators.mining import SLOT, mine_exact, mine_shards
from ..operators.scratch import written
from ..schemas import PARAM
from ..sources import readers, sinks


def prepare(raw: DataFrame, fmt: str = "<content>", patterns: dict[str, str] | None = None) -> DataFrame:
    """raw with line (ASCII), the format's columns, rejected, rewritten, edits, entities and tokens."""
    lines = raw.withColumn("line", strip(nascii(F.col("line"))))
    cut = readers.format_columns(lines, fmt, drop=False)
    return extract_entities(cut, "content", patterns).withColumn("tokens", tokens(strip(F.col("rewritten"))))


def _slot_params() -> Column:
    """Slots as parameters: spans on the content, by the tokens' places in the rewritten text."""
    gaps = F.regexp_extract_all("rewritten", F.lit(r"\s+"), 0)
    total = lambda a: F.aggregate(F.transform(a, lambda x: F.length(x)), F.lit(0), lambda x, y: x + y)
    at = lambda i: total(F.slice("tokens", F.lit(1), i)) + total(F.slice(gaps, F.lit(1), i))

    def one(s):
        a, z = to_line(at(s["token"]), F.col("edits")), to_line(at(s["token"]) + F.length(s["value"]), F.col("edits"))
        t = token_index(F.col("content"), a)
        return F.struct(a.alias("char_start"), z.alias("char_end"), t.alias("token_start"), (t + 1).alias("token_end"), F.lit("unnamed").alias("entity"), s["value"].alias("value"), s["prev_token"].alias("prev_token"), s["next_token"].alias("next_token"))

    return F.transform("slots", one)


def records(prepared: DataFrame, mined: DataFrame, order: str) -> DataFrame:
    """Parsed logs, with is_new and order. Rejected lines have none."""
    return parsed(prepared.filter("not rejected").join(mined.select(order, "template_then", "event_ord", "is_new", "slots"), order), order)


def parsed(p: DataFrame, order: str) -> DataFrame:
    """Parsed logs of prepared lines with what mining found for them."""
    named = F.transform("entities", lambda e: F.struct(*[e[f.name] if f.name not in ("prev_token", "next_token") else F.lit(None).cast("string").alias(f.name) for f in PARAM.fields]))
    kind = f"array<{PARAM.simpleString()}>"
    both = F.concat(named.cast(kind), _slot_params().cast(kind))
    keyed = F.array_sort(F.transform(both, lambda x, i: F.struct(x["char_start"].alias("a"), i.alias("i"), x.alias("x"))))
    log_id = long_hash(F.concat_ws("|", "source_collection", "id", F.col(order).cast("string"), "content"))
    return p.select(
        log_id.alias("log_id"), "line", join_tokens(tokens(F.col("content"))).alias("message"), F.col("template_then").alias("log_key"), "event_ord", short_hash(F.col("template_then")).alias("event_id"),
        "id", "source_collection", "metadata", F.transform(keyed, lambda k: k["x"]).alias("params"), "is_new", order,
    )


def parse(raw: DataFrame, order: str, fmt: str = "<content>", patterns: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """raw logs, parsed: in one mining order, which is one task, or, not exact, by shards: then a line's template is the
    one it has in the end, is_new marks the first line of each, and a line that fits no template is one of its own."""
    p = prepare(raw, fmt, patterns)
    kept = p.filter("not rejected")
    if exact:
        return records(p, mine_exact(kept, order, "tokens"), order)
    kept = written(kept)  # read several times
    found = mine_shards(kept, "tokens")
    slots = F.transform(wildcards(F.col("t")), lambda i: F.struct(i.alias("token"), F.get("tokens", i).alias("value"), F.get("t", i - 1).alias("prev_token"), F.get("t", i + 1).alias("next_token")))
    # else the wildcards' places are not the tokens'
    fits = (F.size("t") == F.size("tokens")) & F.forall(F.zip_with("t", "tokens", lambda x, y: (x == STAR) | (x == y)), lambda x: x)
    firsts = found.groupBy("event_ord").agg(F.min(order).alias("_first")).withColumnRenamed("event_ord", "_event")
    t = found.withColumn("t", F.coalesce("template", "tokens")).join(firsts, F.col("event_ord") == F.col("_event"), "left")
    mined = t.select(order, F.array_join("t", " ").alias("template_then"), F.coalesce("event_ord", F.lit(-1)).alias("event_ord"), F.coalesce(F.col(order) == F.col("_first"), F.lit(True)).alias("is_new"), F.when(fits, slots).otherwise(F.expr(f"cast(array() as {SLOT})")).cast(SLOT).alias("slots"))
    return records(kept, mined, order)


def load_graph(parsed: DataFrame, folder: str, stamp: int) -> None:
    """Vertices and edges of parsed logs, upserted into the graph's tables; stamp orders batches."""
    for rows, name in zip(log_graph(parsed), ("vertices", "edges")):
        sinks.merge_table(rows.withColumn("seq", F.lit(stamp).cast("long")), f"{folder}/{name}", ["collection", "key"], "seq")


def run_pipeline(spark: SparkSession, raw: DataFrame, order: str, folder: str, fmt: str = "<content>", exact: bool = True) -> dict[str, int]:
    """Parses raw and loads it: parsed logs and new templates as files, vertices and edges upserted. Returns counts."""
    parsed = parse(raw, order, fmt, exact=exact).persist()
    try:
        sinks.fan_out(parsed.drop(order), folder)
        load_graph(parsed, folder, parsed.agg(F.max(order)).first()[0] or 0)
        return {"parsed": parsed.count(), "templates": parsed.filter("is_new").count()}
    finally:
        parsed.unpersist()
