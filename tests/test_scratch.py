"""Scratch tables, joins on hot keys, connected components."""
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, scratch
from sparkloom.operators.components import components
from sparkloom.operators.skew import skew_join


def there(table):
    return os.path.exists(table.scratch.removeprefix("file:"))


def test_scratch_tables_go_with_their_scope(spark):
    with scratch.scope():
        a = scratch.written(spark.range(5))
        b = scratch.written(a.filter("id > 2"), a)
        assert not there(a) and there(b) and sorted(r.id for r in b.collect()) == [3, 4]
    assert not there(b)
    inner = []
    c = scratch.settled(lambda: inner.append(scratch.written(spark.range(4))) or inner[0].filter("id > 1"))
    assert not there(inner[0]) and c.count() == 2
    kept = scratch.settled(lambda: spark.range(3), c)
    assert not there(c)
    with scratch.scope():
        pass
    assert there(kept)
    scratch.discard(kept)
    assert not there(kept)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Nothing:
        isEmpty = staticmethod(lambda: True)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Nothing)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": {}})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(session)


@pytest.mark.parametrize("most", [1000, 3, 1])
def test_skew_join_is_a_join(spark, most):
    rng = random.Random(most)
    data = [(rng.choice([0] * 30 + list(range(1, 40)) + [None]), i) for i in range(400)]
    rows = scratch.written(spark.createDataFrame(data, "k int, v int"))
    keyed = scratch.written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("n > 1"))
    got = sorted(map(tuple, skew_join(rows, keyed, ["k"], "n", most).select("k", "v", "n", "least").collect()))
    assert got == sorted(map(tuple, rows.join(keyed, "k").select("k", "v", "n", "least").collect()))


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    least = defaultdict(list)
    for x in parent:
        least[root(x)].append(x)
    return {(x, min(xs)) for xs in least.values() for x in xs}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    path = list(range(1000, 1100))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(5000, 5000), (7, 7)]
    t = spark.createDataFrame([*edges, (None, 3), (9, None)], "a int, b int")
    assert {tuple(r) for r in components(t).collect()} == brute(edges)
    assert components(t.limit(0)).collect() == []


def test_communities_of_a_long_path(spark):
    nodes = [f"n{i:03}" for i in range(100)]
    e = spark.createDataFrame(list(zip(nodes, nodes[1:])), "src string, dst string")
    assert {r.community for r in graph.communities(graph.undirected(e)).collect()} == {"n000"}
