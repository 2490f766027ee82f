"""Biased random walks and node embeddings (Grover and Leskovec, 2016)."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import EDGE_FEATURES, cosine
from . import jvm, skipgrams_java, walkers_java
from .scratch import discard, fresh, opened, written
from .walkers import Walker, packed

#: A graph of at most so many edges and bytes of their nodes' names is sent to the executors as a whole; walks of one task there.
HELD_EDGES, HELD_BYTES, WALKS = 1_000_000, 1 << 25, 2000


def first_probabilities(edges: DataFrame) -> DataFrame:
    """(src, dst, probability) of a walk's first step; edges: both directions, weighted."""
    return edges.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("probability"))


def biased(steps: DataFrame, edges: DataFrame, p: float, q: float, overrides: DataFrame | None = None) -> DataFrame:
    """steps (previous, current, dst, weight, ...) with weight biased: / p back, unchanged to a neighbour of the
    previous node, else / q. overrides: (node, p, q), which hold where the walk stands."""
    near = edges.select(F.col("src").alias("previous"), F.col("dst"), F.lit(True).alias("_near"))
    s = steps.join(near, ["previous", "dst"], "left")
    pc, qc = F.lit(float(p)), F.lit(float(q))
    if overrides is not None:
        s = s.join(overrides.select(F.col("node").alias("current"), F.col("p").alias("_p"), F.col("q").alias("_q")), "current", "left")
        pc, qc = F.coalesce("_p", pc), F.coalesce("_q", qc)
    w = F.when(F.col("dst") == F.col("previous"), F.col("weight") / pc).when(F.col("_near"), F.col("weight")).otherwise(F.col("weight") / qc)
    return s.withColumn("weight", w).drop("_near", "_p", "_q")


def transition_probabilities(edges: DataFrame, p: float = 1.0, q: float = 1.0, overrides: DataFrame | None = None) -> DataFrame:
    """(previous, current, dst, probability) for all paths of two edges."""
    steps = edges.select(F.col("src").alias("previous"), F.col("dst").alias("current")).join(edges.select(F.col("src").alias("current"), "dst", "weight"), "current")
    b = biased(steps, edges, p, q, overrides)
    total = F.sum("weight").over(Window.partitionBy("previous", "current"))
    return b.select("previous", "current", "dst", (F.col("weight") / total).alias("probability"))


def walks(edges: DataFrame, n_walks: int = 10, length: int = 90, p: float = 1.0, q: float = 1.0, seed: int = 0, overrides: DataFrame | None = None, cumulative: bool = False) -> DataFrame:
    """(round, node, walk array<string>): from each node n_walks walks of so many nodes; a dead end ends one early.

    The next node is the one with the least -ln(u) / weight, u from a hash of seed, round, node, step and candidate, so
    the same walks come again whatever the partitions are. A graph that fits HELD_EDGES and HELD_BYTES, without nulls and
    with positive weights, is sent to the executors, and each walk is made in one go, by Java (where a p or q is not
    positive, by numpy). Of any other, a step is a join of
    the walks' heads with the edges; each step's heads are written as they are and are the next one's input; the walks are
    gathered once, in the end. Both ways give the same walks.
    overrides: (node, p, q, n_walks, walk_length), null where the general value holds.
    cumulative: a step has one u, a hash without the candidate, and goes to the first neighbour, by name, at which the
    weights add up to u of their sum: the same chances with one hash a step, for walks without bias only.
    """
    if cumulative and (p != 1 or q != 1 or overrides is not None and overrides.filter("p <> 1 or q <> 1").head(1)):
        raise ValueError("cumulative draws take no p or q")
    spark, edges = edges.sparkSession, written(edges.select("src", "dst", "weight"))  # each step reads them
    nodes = edges.select(F.col("src").alias("node")).distinct()
    if overrides is not None:
        extra = overrides.select("node", F.col("n_walks").alias("_n"), F.col("walk_length").alias("_l"))
        nodes = nodes.join(extra, "node", "left")
    else:
        nodes = nodes.withColumn("_n", F.lit(None).cast("int")).withColumn("_l", F.lit(None).cast("int"))
    rounds = nodes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1)))).filter("_n is null or round < _n")
    heads = rounds.select("round", "node", F.coalesce("_l", F.lit(length)).alias("most"), F.lit(None).cast(edges.schema["src"].dataType).alias("previous"), F.col("node").alias("current"))
    if _held(edges):
        out = _walked(edges, written(rounds.select("round", "node", F.coalesce("_l", F.lit(length)).alias("most"))), p, q, seed, overrides, cumulative)
        discard(edges)
        return out
    longest = length if overrides is None else max(length, overrides.agg(F.max("walk_length")).first()[0] or 0)
    held = [edges]
    if cumulative:
        upto = Window.partitionBy("src").orderBy("dst", "weight")
        high = edges.withColumn("high", F.sum("weight").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        edges = written(high.withColumn("low", F.lag("high", 1, 0.0).over(upto)).withColumn("total", F.max("high").over(Window.partitionBy("src"))))
        held.append(edges)
    out, path, schema = edges.withColumnRenamed("src", "current"), fresh(spark), heads.schema
    for step in range(max(1, longest)):
        if step:
            options = heads.filter(F.col("most") > step).join(out, "current")
            if not cumulative:
                options = biased(options, edges, p, q, overrides)
            drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("node").cast("string"), F.lit(str(step)), *([] if cumulative else [F.col("dst").cast("string")])).cast("binary"))
            u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 1) / float((1 << 52) + 1)
            if cumulative:
                options = options.filter((F.col("low") < u * F.col("total")) & (u * F.col("total") <= F.col("high")))
            to = F.min_by(F.struct("current", "dst"), F.struct(-F.log(u) / F.col("weight"), "dst"))
            heads = options.groupBy("round", "node", "most").agg(to.alias("to")).select("round", "node", "most", F.col("to.current").alias("previous"), F.col("to.dst").alias("current"))
        heads.write.parquet(f"{path}/step={step}")
        heads = spark.read.schema(schema).parquet(f"{path}/step={step}")
    discard(*held)
    steps = opened(spark, path, T.StructType([*schema.fields, T.StructField("step", T.IntegerType())]))
    walk = F.transform(F.array_sort(F.collect_list(F.struct("step", F.col("current").cast("string").alias("c")))), lambda x: x["c"])  # a walk's own nodes
    return steps.groupBy("round", "node").agg(walk.alias("walk"))


def _held(edges: DataFrame) -> bool:
    bytes_ = F.sum(F.octet_length(F.col("src").cast("string")) + F.octet_length(F.col("dst").cast("string")))
    bad = F.col("src").isNull() | F.col("dst").isNull() | ~F.coalesce((F.col("weight") > 0) & (F.col("weight") < math.inf), F.lit(False))
    r = edges.agg(F.count("*").alias("n"), bytes_.alias("b"), F.max(bad).alias("bad")).first()
    return 0 < r.n <= HELD_EDGES and r.b <= HELD_BYTES and not r.bad


def _walked(edges: DataFrame, starts: DataFrame, p: float, q: float, seed: int, overrides: DataFrame | None, cumulative: bool) -> DataFrame:
    """starts (round, node, most; written) with their walks instead of most."""
    t = edges.orderBy("src", "dst", "weight").select(F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("double")).toArrow().combine_chunks()
    both = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).combine_chunks().dictionary_encode()
    names, number = both.dictionary, both.indices.to_numpy()
    ps, qs = np.full(len(names), float(p)), np.full(len(names), float(q))
    if overrides is not None:
        at = {x: i for i, x in enumerate(names.to_pylist())}
        for r in overrides.select(F.col("node").cast("string").alias("node"), "p", "q").join(edges.select(F.col("src").cast("string").alias("node")).distinct(), "node").collect():
            ps[at[r.node]], qs[at[r.node]] = p if r.p is None else r.p, q if r.q is None else r.q
    src, dst, weight, spark = number[: t.num_rows], number[t.num_rows :], t["weight"].to_numpy(), edges.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-starts.count() // WALKS))
    starts = starts.withColumn("key", F.col("node").cast("string")).repartition(n)
    if all((0 < x).all() and np.isfinite(x).all() for x in (ps, qs)):
        function = jvm.made(spark, "SparkloomWalks", walkers_java.SOURCE, packed(names, src, dst, weight, ps, qs), str(seed), cumulative)
        return starts.select("round", "node", jvm.called(spark, function, T.ArrayType(T.StringType()), F.col("round"), F.col("key"), F.col("most")).alias("walk"))
    graph = spark.sparkContext.broadcast((names, src, dst, weight, ps, qs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, src, dst, weight, ps, qs = graph.value
        walker, at = Walker(names.to_pylist(), src, dst, weight, ps, qs, seed), {x: i for i, x in enumerate(names.to_pylist())}
        for b in batches:
            walk = walker.walk(b["round"].to_numpy(), np.array([at[x] for x in b["key"].to_pylist()], np.int32), b["most"].to_numpy())
            lengths = (walk >= 0).sum(axis=1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["round"], b["node"], pa.ListArray.from_arrays(offsets, names.take(pa.array(walk[walk >= 0])))], ["round", "node", "walk"])

    schema = T.StructType([starts.schema["round"], starts.schema["node"], T.StructField("walk", T.ArrayType(T.StringType()))])
    return starts.mapInArrow(run, schema)


def embed(walk_table: DataFrame, dims: int = 128, window: int = 10, min_count: int = 1, seed: int = 1, partitions: int = 4) -> Word2VecModel:
    """Spark's Word2Vec, its steps made by skipgrams_java: as there, each partition learns by itself, and a word's vectors
    are averaged over those that hold it. The vocabulary and its vectors pass the driver, as there."""
    spark, held = walk_table.sparkSession, written(walk_table.select("walk"))  # it is read twice
    counts = held.select(F.explode("walk").alias("word")).filter("word is not null").groupBy("word").count().filter(F.col("count") >= min_count)
    vocabulary = counts.orderBy(F.desc("count"), "word").toArrow()
    n, texts = vocabulary.num_rows, [x.encode() for x in vocabulary["word"].to_pylist()]
    if not 0 < n * dims < 1 << 31:
        raise ValueError(f"no vectors can be held for {n} words of {dims} numbers; see min_count and dims")
    begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype("<i4")
    words = np.array([n], "<i8").tobytes() + vocabulary["count"].to_numpy().astype("<i8").tobytes() + begin.tobytes() + b"".join(texts)
    learner = jvm.made(spark, "SparkloomSkipGrams", skipgrams_java.SOURCE, words, dims, window, partitions, str(seed))
    found = written(jvm.mapped(held.repartition(partitions), learner, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("vector", T.BinaryType())])))
    discard(held)
    total, times = np.zeros((n, dims), np.float32), np.zeros(n, np.int64)
    for r in found.toLocalIterator():
        total[r.i] += np.frombuffer(r.vector, "<f4")
        times[r.i] += 1
    discard(found)
    if (rest := np.flatnonzero(times == 0)).size:  # words that never stood beside another keep what they began with
        total[rest] = np.frombuffer(learner.begun(), "<f4").reshape(n, dims)[rest]
    total /= np.maximum(times, 1).astype(np.float32)[:, None]
    general = Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, seed=seed, numPartitions=partitions, inputCol="walk", outputCol="vector")
    model = general._copyValues(Word2VecModel(learner.model(general.uid, total.astype("<f4").tobytes())))
    model._transfer_params_to_java()
    return model


def edge_vectors(edges: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """edges (src, dst) with the feature of their nodes' vectors (key, vector); an unknown node raises."""
    a, b = vectors.select(F.col("key").alias("src"), F.col("vector").alias("_a")), vectors.select(F.col("key").alias("dst"), F.col("vector").alias("_b"))
    known = edges.join(a, "src", "left").join(b, "dst", "left")
    bad = F.raise_error(F.concat(F.lit("no vector for an edge's node: "), F.col("src").cast("string"), F.lit(", "), F.col("dst").cast("string")))
    value = F.when(F.col("_a").isNull() | F.col("_b").isNull(), bad.cast("array<double>")).otherwise(EDGE_FEATURES[kind](F.col("_a"), F.col("_b")))
    return known.select("src", "dst", value.alias("feature"))


def all_pairs(vectors: DataFrame, kind: str) -> DataFrame:
    """(src, dst, feature) of every unordered pair of keys, each with itself as well: quadratic, as asked for."""
    a, b = vectors.select(F.col("key").alias("src"), F.col("vector").alias("_a")), vectors.select(F.col("key").alias("dst"), F.col("vector").alias("_b"))
    return a.join(b, F.col("src") <= F.col("dst")).select("src", "dst", EDGE_FEATURES[kind](F.col("_a"), F.col("_b")).alias("feature"))


def most_similar(vectors: DataFrame, key, k: int = 10) -> DataFrame:
    """The k keys nearest to one by cosine."""
    probe = vectors.filter(F.col("key") == key).select(F.col("vector").alias("_v")).limit(1)
    rest = vectors.filter(F.col("key") != key).join(F.broadcast(probe))  # one row
    return rest.select("key", cosine(F.col("vector"), F.col("_v")).alias("cosine")).orderBy(F.desc("cosine"), "key").limit(k)
