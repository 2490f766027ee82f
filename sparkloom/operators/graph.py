"""Property graph as a vertex and an edge table, with upserts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import short_hash
from ..schemas import ENTITY_COLLECTIONS
from .components import components


def _lookup(index: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in ENTITY_COLLECTIONS.items() for x in (k, v[index])])


def params_of(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each entity that has a vertex: keep, entity, value, char_start, char_end, token_start, and password,
    that of the last password behind a user of the same log and before the next user."""
    rows = parsed.select(*keep, F.posexplode("params").alias("_i", "p")).select(*keep, "_i", "p.entity", "p.value", "p.char_start", "p.char_end", "p.token_start")
    w = Window.partitionBy(*keep).orderBy("_i")
    block = F.sum((F.col("entity") == "user").cast("int")).over(w)
    rows = rows.withColumn("_u", block)
    held = F.last(F.when(F.col("entity") == "password", F.col("value")), ignorenulls=True).over(Window.partitionBy(*keep, "_u").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("password", F.when((F.col("entity") == "user"), held))
    return rows.filter(F.col("entity").isin(*ENTITY_COLLECTIONS)).drop("_i", "_u")


def entity_vertices(params: DataFrame, order: list[str]) -> DataFrame:
    """collection, key, name, props of entities; of several mentions the last by order that has a property gives it."""
    v = params.select(_lookup(0)[F.col("entity")].alias("collection"), short_hash(F.col("value")).alias("key"), F.col("value").alias("name"), F.concat_ws("-", "char_start", "char_end").alias("span"), F.col("token_start").cast("string").alias("token"), "password", F.struct(*order, "char_start").alias("_o"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c)
    v = v.groupBy("collection", "key").agg(*[last(c) for c in ("name", "span", "token", "password")])
    props = F.map_filter(F.create_map(*[x for c in ("span", "token", "password") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return v.select("collection", "key", "name", props.alias("props"))


def entity_edges(params: DataFrame, log_key: str) -> DataFrame:
    """collection, key, src, dst, name of the edges from logs to their entities."""
    e = params.select(_lookup(1)[F.col("entity")].alias("collection"), F.col(log_key).alias("src"), short_hash(F.col("value")).alias("dst"), F.col("value").alias("name"))
    return e.withColumn("key", F.concat_ws("-", "src", "dst")).dropDuplicates(["collection", "key"]).select("collection", "key", "src", "dst", "name")


def log_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of parsed logs: collections, logs, templates and entities."""
    empty = F.create_map().cast("map<string,string>")
    col, key = short_hash(F.col("source_collection")), F.col("event_ord").cast("string")
    sources = parsed.select(F.lit("collections").alias("collection"), col.alias("key"), F.col("source_collection").alias("name"), empty.alias("props")).dropDuplicates(["key"])
    meta = F.map_concat(F.coalesce("metadata", empty), F.map_filter(F.create_map(F.lit("source_id"), F.col("id"), F.lit("message"), F.col("message")), lambda k, v: v.isNotNull()))
    logs = parsed.select(F.lit("logs").alias("collection"), F.col("log_id").alias("key"), F.col("line").alias("name"), meta.alias("props"))
    keys = parsed.groupBy(key.alias("key")).agg(F.max_by("log_key", "log_id").alias("name")).select(F.lit("log_keys").alias("collection"), "key", "name", empty.alias("props"))
    params = params_of(parsed, ["log_id"])
    vertices = sources.unionByName(logs).unionByName(keys).unionByName(entity_vertices(params, ["log_id"]))
    has_log = parsed.select(F.lit("has_log").alias("collection"), F.concat_ws("-", col, "log_id").alias("key"), col.alias("src"), F.col("log_id").alias("dst"), F.col("source_collection").alias("name"))
    has_key = parsed.select(F.lit("has_log_key").alias("collection"), F.concat_ws("-", "log_id", key).alias("key"), F.col("log_id").alias("src"), key.alias("dst"), F.col("log_key").alias("name"))
    return vertices, has_log.unionByName(has_key).unionByName(entity_edges(params, "log_id"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by keys; each other column takes its last non-null value by order, new over old. Maps are overlaid: each
    of their entries takes its last non-null value, so that one that the last map has not stays. Entries are counted
    one by one with partial sums, so that a key of very many rows is gathered nowhere. Null keys are keys."""
    both = old.unionByName(new, allowMissingColumns=True)
    maps = [f.name for f in both.schema if isinstance(f.dataType, T.MapType) and f.name not in keys]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    has = [F.max(F.col(c).isNotNull()).alias(c) for c in maps]
    out = both.groupBy(*keys).agg(*[last(c) for c in both.columns if c not in keys and c not in maps and c != order], *has, F.max(order).alias(order))
    for c in maps:
        entries = both.select(*keys, F.col(order).alias("_order"), F.explode(c).alias("_k", "_v")).filter("_v is not null")
        entries = entries.groupBy(*keys, "_k").agg(F.max_by("_v", F.struct("_order", "_v")).alias("_v"))
        held = entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("_held"))  # a row's own properties
        held = held.withColumnsRenamed({k: f"_{i}" for i, k in enumerate(keys)})
        same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
        empty = F.when(F.col(c), F.create_map().cast(both.schema[c].dataType))
        out = out.join(held, same, "left").withColumn(c, F.coalesce("_held", empty)).drop("_held", *[f"_{i}" for i in range(len(keys))])
    return out.select(both.columns)


def new_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys).distinct(), keys, "left_semi")


def out_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.select(F.col("key").alias("src")).join(edges, "src")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst, weight), weight 1 where there is none; repeated edges are one, of their last."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.cast("double").alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): the smallest node of each node's connected component, however far it is."""
    return components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select("node", F.col("root").alias("community"))
