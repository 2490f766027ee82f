"""Whole plans, and every query with SQL against DuckDB."""
import glob
import json
import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.__main__ import main
from sparkloom.functions.ner import recognise
from sparkloom.operators import graph, links, walks
from sparkloom.plans import batch, detect
from sparkloom.plans import queries as plain
from sparkloom.sources import sinks

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def tables(path=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{path}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def compare(spark, frame, sql):
    r = tables().sql(sql)
    columns = sorted(r.columns)
    assert sorted(frame.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(norm(x[c]) for c in columns) for x in frame.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(plain.SQL))
def test_query_is_its_sql(spark, name):
    compare(spark, plain.Q[name](spark, SF), plain.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plain.Q) - set(plain.SQL)))
def test_query_without_sql_runs(spark, name):
    frame = plain.Q[name](spark, SF)
    assert frame.columns and isinstance(frame.collect(), list)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mine_file(spark, tmp_path):
    (tmp_path / "log").write_text("a: open file 10.0.0.1 x\nbroken\na: open file 10.0.0.2 y\na: bye\na: open file 10.0.0.3 y\n")
    out = str(tmp_path / "o")
    assert main(["mine", str(tmp_path / "log"), out, "--format", "<who>: <content>"]) == 0
    rows = sorted(spark.read.option("header", True).option("escape", '"').csv(f"{out}_structured.csv").collect(), key=lambda r: int(r.log_id))
    assert [r.log_id for r in rows] == ["1", "2", "3", "4"] and [r.who for r in rows] == ["a"] * 4
    assert rows[0].template == rows[1].template == rows[3].template == "open file * *" and rows[2].template == "bye"
    first, second = json.loads(rows[0].parameters), json.loads(rows[1].parameters)
    assert first == [{"start": 10, "end": 18, "entity": "ip_address", "value": "10.0.0.1", "pos": 0}]
    assert second[1] == {"start": 12, "end": 13, "value": "y"} and len(second) == 2
    assert {(r.template, r["count"]) for r in spark.read.option("header", True).option("escape", "\"").csv(f"{out}_templates.csv").collect()} == {("open file * *", "3"), ("bye", "1")}


def test_detect(spark):
    good = [(i, e) for i in range(60) for e in ["open"] * (i % 4 + 1) + ["close"] * (i % 4 + 1)]
    bad = good + [(100, "open"), (100, "open"), (100, "close")]
    train, test = (spark.createDataFrame(x, "i long, e string") for x in (good, bad))
    miner, out = detect.detect(train, test, "i", "e")
    assert set(miner.invariants) == {("close", "open")}
    labels = spark.createDataFrame([(i, int(i == 100)) for i in (*range(60), 100)], "i long, y int")
    r = detect.evaluate(out, labels, "i", "y").first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 0)


def test_links(spark):
    e = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string"))
    assert {tuple(r) for r in links.candidates(e).collect()} == {("a", "c"), ("b", "d")}
    v = spark.createDataFrame([(f"n{i}", [float(i % 2), float(1 - i % 2)]) for i in range(12)], "key string, vector array<double>")
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}", int(i % 2 == j % 2)) for i in range(12) for j in range(i)], "src string, dst string, label int")
    model = links.fit_links(pairs, v)
    s = {(r.src, r.dst): r.score for r in links.score_links(model, pairs, v).collect()}
    assert s["n2", "n0"] > 0.5 > s["n1", "n0"]


def test_vectors_and_sequences_to_files(spark, tmp_path):
    w = spark.createDataFrame([(["a", "b", "c"],), (["b", "c", "a"],)], "walk array<string>")
    model = walks.embed(w, dims=4, partitions=1)
    sinks.vectors_text(model, str(tmp_path / "v"))
    lines = [r.value.split(" ") for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert {x[0] for x in lines} == {"a", "b", "c"} and all(len(x) == 5 for x in lines)
    sinks.sequence_csv(w.withColumn("k", F.lit(1)), str(tmp_path / "s"), "walk")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "s")).count() == 2


def test_recognisers_plug_in(spark):
    def upper(texts):
        import re

        return [[(m.start(), m.end(), "PERSON") for m in re.finditer(r"[A-Z]\w+", t)] for t in texts]

    rows = recognise(spark.createDataFrame([("see Ann and Bob",), (None,)], "line string"), "line", upper).collect()
    assert [(s.entity, s.value) for s in rows[0].named] == [("PERSON", "Ann"), ("PERSON", "Bob")] and rows[1].named == []


def test_rules_command(tmp_path):
    (tmp_path / "r.yml").write_text("title: t\ndetection: {k: [x], condition: k}\n")
    assert main(["rules", str(tmp_path), "--out", str(tmp_path / "out")]) == 0 and (tmp_path / "out").read_text().startswith("t\tcoalesce(contains(")


def test_commands(spark, tmp_path):
    from sparkloom.sources import readers

    at = lambda x: str(tmp_path / x)
    docs = [(i, f"get http://{'bad' if i % 2 else 'good'}{i}.example.{'ru/login.exe?q=%00' if i % 2 else 'org/page'} now") for i in range(60)]
    spark.createDataFrame(docs, "k int, text string").write.parquet(at("tables/c.parquet"))
    (tmp_path / "config.json").write_text(json.dumps({"host": "", "collections": [{"name": "c", "id_field": "k", "prop_fields": [], "text_fields": ["text"]}]}))
    assert main(["crawl", at("config.json"), at("tables"), at("raw")]) == 0 and spark.read.json(at("raw")).count() == 60
    assert main(["parse", "--stream", at("raw"), at("graph")]) == 0
    urls = sinks.read_table(spark, at("graph/vertices")).filter("collection = 'urls'")
    assert urls.count() == 60
    assert main(["load", at("graph/parsed_logs"), at("again")]) == 0
    assert sinks.read_table(spark, at("again/vertices")).filter("collection = 'urls'").count() == 60
    (tmp_path / "u.csv").write_text("url,label\n" + "".join(f"{t.split()[1]},{'bad' if i % 2 else 'good'}\n" for i, t in docs))
    assert main(["train", at("u.csv"), at("model")]) == 0 and spark.read.parquet(at("model/history")).first().accuracy > 0.8
    assert main(["train", at("u.csv"), at("bilstm"), "--bilstm", "--embed-dim", "8", "--epochs", "2"]) == 0
    assert main(["analyze", at("graph"), at("bilstm")]) == 0 and spark.read.parquet(at("bilstm/history")).first().n > 0
    assert main(["analyze", at("graph"), at("model")]) == 0
    marked = [r for r in sinks.read_table(spark, at("graph/vertices")).filter("collection = 'urls'").collect()]
    assert sum((r.props["malicious_warning"] == "true") == ("bad" in r.name) for r in marked) >= 55 and all(r.props["span"] for r in marked)
    good = "".join(f"x blk_{i},open\nx blk_{i},close\n" * (i % 3 + 1) for i in range(40))
    (tmp_path / "a.csv").write_text("Content,EventId\n" + good)
    (tmp_path / "b.csv").write_text("Content,EventId\n" + good + "x blk_99,open\n")
    assert main(["detect", at("a.csv"), at("b.csv"), at("found")]) == 0
    found = {r.instance: r.anomaly for r in spark.read.option("header", True).csv(at("found")).collect()}
    assert found["blk_99"] == "1" and found["blk_1"] == "0" and readers.load_config(at("config.json"))["collections"]


def test_passthrough(monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", iter(["a\n", "b"]))
    assert main(["passthrough"]) == 0 and capsys.readouterr().out == "a\nb"


def test_rule_codes(tmp_path):
    def code(text, **kw):
        (tmp_path / "r.yml").write_text(text)
        return sinks.compiled_rules([str(tmp_path / "r.yml")], str(tmp_path / "out"), **kw)

    rule = "title: t\ndetection: {k: {a: 1, 'b|contains': x}, condition: %s}\n"
    assert code(rule % "k") == 0 and code("a: [") == 3 and code("title: t\n") == 4 and code(rule % "q") == 4 and code(rule % "[k]") == 8
    assert code(rule.replace("contains", "near") % "k") == 9 and code(rule % "'k | count() > 5'") == 42
    assert code(rule % "k", columns=["a"]) == 80 and code(rule % "k", columns=["z"]) == 90 and code(rule % "k", columns=["a", "b"]) == 0
    assert sinks.compiled_rules([str(tmp_path / "r.yml")], str(tmp_path / "no/such/out")) == 1
    (tmp_path / "r.yml").write_bytes(b"title: \xff\xfe\n")
    assert sinks.compiled_rules([str(tmp_path / "r.yml")], str(tmp_path / "out")) == 5


def test_compiled_rules_run(spark, tmp_path):
    rule = {"title": "q", "detection": {"k": {"who": "AD*'\\", "n|re": "^\\d$"}, "condition": "not k"}}
    from sparkloom.operators import rules

    t = spark.createDataFrame([("ad x'\\", "1"), ("ad", "12")], "who string, n string")
    assert [r.who for r in t.filter(rules.rule_sql(rule, [])).collect()] == ["ad"]


def test_small_helpers(spark, tmp_path):
    from sparkloom.concurrent import ordered_map
    from sparkloom.functions import arrays as A
    from sparkloom.operators import mining
    from sparkloom.operators.kernel import between

    assert ordered_map(lambda x: x * x, range(20)) == [x * x for x in range(20)]
    t = spark.createDataFrame([([], {"a": "1", "b": "2"}, {"b": "3", "c": None, "d": "4"})], "x array<int>, m map<string,string>, n map<string,string>")
    r = t.select(A.is_empty(F.col("x")).alias("yes"), A.not_empty(F.col("x")).alias("no"), A.overlay(F.col("m"), F.col("n")).alias("o")).first()
    assert r.yes and not r.no and r.o == {"a": "1", "b": "3", "d": "4"}
    templates = spark.createDataFrame([(0, ["a", "*", "b"]), (1, ["c"])], mining.TEMPLATES)
    mining.save_templates(templates, str(tmp_path / "t"))
    assert sorted(map(tuple, mining.load_templates(spark, str(tmp_path / "t")).collect())) == [(0, ["a", "*", "b"]), (1, ["c"])]
    assert {r.event_ord: json.loads(r.json) for r in mining.template_json(templates).collect()} == {0: {"lcsseq": "a * b", "position": [1]}, 1: {"lcsseq": "c", "position": []}}
    spark.range(2).write.parquet(str(tmp_path / "u"))
    with pytest.raises(TypeError):
        mining.load_templates(spark, str(tmp_path / "u"))
    assert between("a * b c *".split(), "a x y b c z".split()) == [["x", "y"], ["z"]] and between("a * b".split(), "a b".split()) is None and between("* a".split(), "x".split()) is None


def test_parse_by_shards(spark):
    from sparkloom.plans import parse

    lines = [f"job {w} took {i} ms on node" for i in range(30) for w in ("alpha", "beta")] + ["all done"]
    raw = spark.createDataFrame([(str(i), "c", x, {}, i) for i, x in enumerate(lines)], "id string, source_collection string, line string, metadata map<string,string>, seq long")
    exact, shards = ({r.seq: r for r in parse.parse(raw, "seq", exact=e).collect()} for e in (True, False))
    assert {r.log_key for r in shards.values()} == {"job * took <NUMBER> ms on node", "all done"}
    last = len(lines) - 2
    assert shards[last].params == exact[last].params and shards[last].log_id == exact[last].log_id and shards[last].log_key == exact[last].log_key
    assert sorted(k for k, r in shards.items() if r.is_new) == sorted(k for k, r in exact.items() if r.is_new) == [0, last + 1]


def test_imports_without_the_corpus_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/sparkloom", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "sparkloom/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'entity_degree_topk' in e.queries() and not any(q.startswith('op1_') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
