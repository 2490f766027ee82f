"""Chat formatting: tool-call linking in DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier), ordered topologically, checked against the schema of
their arguments, and written as canonical JSON (keys sorted, no white space). A result depends on its call, a call on
nothing but its place, so (the call's turn, calls first, own turn) is a topological order: results that came before
their call, or late, stand right behind it. That key needs no window and gathers no conversation in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of a tool: the JSON kinds of its arguments; a trailing ? marks one that may be missing.
SCHEMAS = {"reply": {"chars": "number", "text": "string", "words": "number"}}

_RANK = {"call": 0, "message": 1, "result": 2, "orphan": 3}


def kind_of(value: Column) -> Column:
    """The JSON kind of a variant: string, number, boolean, null, array or object."""
    t = F.schema_of_variant(value)
    return F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number")


def faults(name: Column, arguments: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """Sorted faults of arguments (map of argument to kind; null: no JSON object): an unknown tool, arguments that
    are missing, of another kind, or not in the schema."""
    rules = {tool: {k: v for k, v in sorted(s.items())} for tool, s in sorted(schemas.items())}
    known = F.create_map(*[x for tool, s in rules.items() for x in (F.lit(tool), F.create_map(*[F.lit(y) for kv in s.items() for y in kv]))])
    schema = known[name]
    missing = F.map_keys(F.map_filter(schema, lambda k, v: ~v.endswith("?") & ~F.map_contains_key(arguments, k)))
    extra = F.map_keys(F.map_filter(arguments, lambda k, v: ~F.map_contains_key(schema, k)))
    wrong = F.map_keys(F.map_filter(arguments, lambda k, v: F.map_contains_key(schema, k) & (F.rtrim(schema[k], F.lit("?")) != v)))
    tagged = lambda tag, c: F.transform(c, lambda k: F.concat(F.lit(f"{tag}:"), k))
    found = F.array_sort(F.concat(tagged("missing", missing), tagged("extra", extra), tagged("kind", wrong)))
    return F.when(arguments.isNull(), F.array(F.lit("malformed"))).when(name.isNull() | schema.isNull(), F.array(F.lit("unknown-tool"))).otherwise(found)


def parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, kind, call_id, name, arguments (variant), content: a row for each call and result.

    A turn whose text is a JSON object with tool_calls (a list of id, name, arguments) is so many calls; one with
    tool_call_id and content is a result. Of other turns, one by a user calls the tool `reply` under the identifier of
    its turn, and one by an assistant is the result for the turn before it; the rest, and JSON turns of another shape,
    are messages.
    """
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    t = t.withColumn("v", F.try_parse_json(F.when(F.ltrim("text").startswith("{"), F.col("text"))))
    t = t.withColumn("calls", F.try_variant_get("v", "$.tool_calls", "array<struct<id:string,name:string,arguments:variant>>")).withColumn("answers", F.try_variant_get("v", "$.tool_call_id", "string"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    plain = F.parse_json(F.to_json(F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(words, F.lit(0)).alias("words"))))
    explicit = t.filter("calls is not null").withColumn("c", F.explode("calls"))
    explicit = explicit.select("conv_id", "turn", "role", F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.lit(None).cast("string").alias("content"))
    rest = t.filter("calls is null")
    mute, own = F.lit(None).cast("string"), F.concat(F.lit("turn-"), F.col("turn"))
    answered = F.col("answers").isNotNull()
    user, assistant = F.col("v").isNull() & (F.col("role") == "user"), F.col("v").isNull() & (F.col("role") == "assistant")
    implicit = rest.select(
        "conv_id", "turn", "role", F.when(answered | assistant, "result").when(user, "call").otherwise("message").alias("kind"),
        F.when(answered, F.col("answers")).when(user, own).when(assistant, F.concat(F.lit("turn-"), F.col("turn") - 1)).otherwise(mute).alias("call_id"),
        F.when(user, "reply").alias("name"), F.when(user, plain).alias("arguments"),
        F.when(answered, F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit(""))).when(user, mute).otherwise(F.coalesce("text", F.lit(""))).alias("content"),
    )
    return explicit.unionByName(implicit)


def link(found: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """conv_id, call_turn, rank, turn, kind, call_id, n_results, valid, faults, json of each part.

    Sorted by (conv_id, call_turn, rank, turn), rows are in topological order. Calls that share an identifier all stay
    and results link to the one with the smallest turn; a result without call or identifier is an orphan at its own
    turn. valid: of calls, whether arguments keep the schema; of results, whether there is a call; else null. faults
    are joined by commas.
    """
    key = ["conv_id", "call_id"]
    calls, results = found.filter("kind = 'call'"), found.filter("kind = 'result'")
    first = calls.filter("call_id is not null").groupBy(*key).agg(F.min("turn").alias("first")).hint("shuffle_hash")
    counts = results.filter("call_id is not null").groupBy(*key).agg(F.count("*").alias("n_results")).hint("shuffle_hash")
    kinds = F.transform_values(F.try_variant_get("arguments", "$", "map<string,variant>"), lambda k, v: kind_of(v))
    c = calls.join(counts, key, "left").withColumn("kinds", kinds).withColumn("f", faults(F.col("name"), F.col("kinds"), schemas))
    body = F.to_json(F.struct("arguments", "call_id", "conv_id", "name", "role", "turn"))  # fields in the order of their names
    c = c.select("conv_id", F.col("turn").alias("call_turn"), "turn", "kind", "call_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), (F.size("f") == 0).alias("valid"), F.array_join("f", ",").alias("faults"), body.alias("json"))
    body = F.to_json(F.struct("call_id", "content", "conv_id", "role", "turn"))
    r = results.join(first, key, "left")
    r = r.select("conv_id", F.coalesce("first", "turn").alias("call_turn"), "turn", F.when(F.col("first").isNull(), "orphan").otherwise("result").alias("kind"), "call_id", F.lit(0).cast("long").alias("n_results"), F.col("first").isNotNull().alias("valid"), F.when(F.col("first").isNull(), "no-call").otherwise("").alias("faults"), body.alias("json"))
    m = found.filter("kind = 'message'").select("conv_id", F.col("turn").alias("call_turn"), "turn", "kind", "call_id", F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("boolean").alias("valid"), F.lit("").alias("faults"), body.alias("json"))
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])[F.col("kind")]
    return c.unionByName(r).unionByName(m).withColumn("rank", rank).select("conv_id", "call_turn", "rank", "turn", "kind", "call_id", "n_results", "valid", "faults", "json")


def chat_report(turns: DataFrame) -> DataFrame:
    """Every turn of a conversations table, linked (see parts and link). Null text: empty; a null role is a message.
    Null conv_id or turn: linked to nothing. Repeated rows each are a part. Empty table: no rows. Other columns are
    not read."""
    return link(parts(turns))


ORACLE = """
WITH calls AS (
  SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, turn) AS first FROM conversations WHERE role = 'user'
), keys AS (SELECT DISTINCT conv_id, turn FROM calls),
answers AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)
SELECT c.conv_id, CASE WHEN c.role = 'assistant' AND k.turn IS NOT NULL THEN c.turn - 1 ELSE c.turn END AS call_turn,
  CAST(CASE WHEN c.role = 'user' THEN 0 WHEN c.role = 'assistant' AND k.turn IS NOT NULL THEN 2 WHEN c.role = 'assistant' THEN 3 ELSE 1 END AS INTEGER) AS rank,
  c.turn, CASE WHEN c.role = 'user' THEN 'call' WHEN c.role = 'assistant' AND k.turn IS NOT NULL THEN 'result' WHEN c.role = 'assistant' THEN 'orphan' ELSE 'message' END AS kind,
  CASE WHEN c.role = 'user' THEN 'turn-' || c.turn WHEN c.role = 'assistant' THEN 'turn-' || (c.turn - 1) END AS call_id,
  CAST(CASE WHEN c.role = 'user' THEN coalesce(a.n, 0) ELSE 0 END AS BIGINT) AS n_results,
  CASE WHEN c.role = 'user' THEN true WHEN c.role = 'assistant' THEN k.turn IS NOT NULL END AS valid,
  CASE WHEN c.role = 'assistant' AND k.turn IS NULL THEN 'no-call' ELSE '' END AS faults,
  CASE WHEN c.role = 'user' THEN '{"arguments":{"chars":' || length(c.text) || ',"text":' || CAST(to_json(c.text) AS VARCHAR)
      || ',"words":' || len(regexp_extract_all(c.text, '[^\\x20\\x09-\\x0D]+')) || '},"call_id":"turn-' || c.turn || '","conv_id":' || c.conv_id || ',"name":"reply","role":"user","turn":' || c.turn || '}'
    WHEN c.role = 'assistant' THEN '{"call_id":"turn-' || (c.turn - 1) || '","content":' || CAST(to_json(c.text) AS VARCHAR) || ',"conv_id":' || c.conv_id || ',"role":"assistant","turn":' || c.turn || '}'
    ELSE '{"content":' || CAST(to_json(c.text) AS VARCHAR) || ',"conv_id":' || c.conv_id || ',"role":' || CAST(to_json(c.role) AS VARCHAR) || ',"turn":' || c.turn || '}' END AS json
FROM conversations c LEFT JOIN keys k ON k.conv_id = c.conv_id AND k.turn = c.turn - 1
LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn
"""
