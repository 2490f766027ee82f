"""Entities, parsing, graph, features, rules, walks, URLs and streams on small tables."""
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions import arrays as A
from sparkloom.functions import strings as S
from sparkloom.functions.entities import PATTERNS, extract_entities, java
from sparkloom.operators import features, graph, invariants, mining, rules, sequences, trees, urls, walks
from sparkloom.plans import parse
from sparkloom.sources import readers, sinks
from sparkloom.streaming import streams


def entities(spark, line, patterns=None, whole=False):
    r = extract_entities(spark.createDataFrame([(line,)], "line string"), "line", patterns, whole).first()
    return r.rewritten, [(e.char_start, e.char_end, e.token_start, e.entity, e.value) for e in r.entities or []]


def test_one_address(spark):
    line = "User bal (192.168.139.1) set 'SYSLOG_NOTICE' to ''"
    text, found = entities(spark, line)
    assert found == [(10, 23, 3, "ip_address", "192.168.139.1")]
    assert text[10:22] == "<IP_ADDRESS>"


def test_two_addresses_keep_their_places_in_the_line(spark):
    line = "User bal (192.168.139.1) set 'SYSLOG_INFO' to ' 192.168.139.1'"
    text, found = entities(spark, line)
    assert [(a, b) for a, b, *_ in found] == [(10, 23), (48, 61)]
    assert text == "User bal (<IP_ADDRESS>) set 'SYSLOG_INFO' to ' <IP_ADDRESS>'"


@pytest.mark.parametrize(
    "line",
    [
        "get http://a.example.com/x?y=1 by bob@x.org:10.0.0.1:pw then 10.0.0.2;root;toor and v1.2.3 of 64K, 5MB 7gb 2.4GHz",
        "open /dev/sda1 /proc/1/maps /usr/lib/x.so /var/www/a.php 0xdeadbeef-12 and 123e4567-e89b-12d3-a456-426614174000 at 12 o'clock",
        "me@x.org:secret me@y.org tcp/10.1.2.3:80 10.1.2.4+16 1.2.3-rc1  77  88 ",
        "", "nothing here",
    ],
)
def test_spans_hold_their_values(spark, line):
    _, found = entities(spark, line)
    assert all(line[a:b] == v for a, b, _, _, v in found)
    import re

    text, want = line, []
    for key, rx in PATTERNS.items():
        want += [g for m in re.finditer(rx, text) for g in m.groupdict()]
        text = re.sub(rx, lambda m, rx=rx, key=key: (";" if key == "ip_address_user_password" else ":").join(f"<{g.upper()}>" for g in re.compile(rx).groupindex), text)
    got = entities(spark, line)
    assert got[0] == text and sorted(e for *_, e, _ in got[1]) == sorted(want)


LONG = 60_000


@pytest.mark.parametrize("token", ["1" + ".1" * LONG, "/dev" + "/a" * LONG, "/proc" + "/a.b" * LONG, "/a" * LONG, "/a" * LONG + "/b.php", "a@b" + ".c" * LONG, "a" * LONG, "a@" * LONG, "/a/b.php" + "/c" * LONG + "!", "0x" + "f" * LONG, "1.2.3.4;" + "x" * LONG])
def test_long_tokens_do_no_harm(spark, token):
    import re

    df = spark.createDataFrame([(token,)], "line string")
    for key, rx in PATTERNS.items():
        if not (key == "ip_address" and token.startswith("1.1")):  # thousands of matches
            got = extract_entities(df, "line", {key: rx}).select(F.size("entities").alias("n")).first().n
            assert (got > 0) == bool(re.search(rx, token[: 2000 if "php" not in token else None], re.ASCII)) or key == "uri" and "php" in token


def test_flat_patterns_are_the_patterns(spark):
    import random
    import re

    rng = random.Random(1)
    parts = ["/", "/a/b.php", "/a/b/", "a", "b", ".", "1", "2", "dev", "proc", ".php", "-", "@", "_", "+", ":", " ", "v", "c.d", "//", "1.2", ";", "x"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(4)
    for key, rx in PATTERNS.items():
        want = re.compile(rx, re.ASCII)
        got = df.select("i", F.regexp_extract_all("line", F.lit(java(rx)[0]), 0).alias("m")).collect()
        assert all(r.m == [m.group() for m in want.finditer(lines[r.i])] for r in got), key
        assert list(java(rx)[1]) == list(want.groupindex)


def test_each_pattern_is_searched_for_once(spark):
    lines = spark.createDataFrame([("a",)], "line string").repartition(2)
    plan = extract_entities(lines, "line")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{12}\\b)") == 1 and plan.count("GHz\\b)") == 1


def test_places_hold_where_a_later_match_takes_in_an_earlier_one(spark):
    line = "1.2.3 a@b.co:http://xx.yy/z !:" + "q" * 60 + " 4.5.6"
    text, found = entities(spark, line)
    assert text == "<VERSION> <EMAIL>:<IP_ADDRESS>:<PASSWORD> <VERSION>"
    assert [(a, b, t, e) for a, b, t, e, _ in found if e in ("version", "password")] == [(0, 5, 0, "version"), (30, 90, 3, "password"), (91, 96, 3, "version")]


@pytest.mark.parametrize("line", ["\x01\x0210.0.0.1\x03\x03\x01 c@d.org:p\x02\x03\x03w \x01\x03v1.2\x02", "\x02 5MB\x02\x03 10.0.0.2;a\x01\x03\x03\x03;\x03b\x02 ", "\x01 7gb", " \x03 7gb 8gb 1.2.3 é 9K\x03"])
def test_lines_that_hold_the_marks(spark, line):
    import re

    text, want = line, []
    for key, rx in PATTERNS.items():
        want += [(g, v) for m in re.finditer(rx, text, re.ASCII) for g, v in m.groupdict().items()]
        text = re.sub(rx, lambda m, rx=rx, key=key: (";" if key == "ip_address_user_password" else ":").join(f"<{g.upper()}>" for g in re.compile(rx).groupindex), text, flags=re.ASCII)
    got, found = entities(spark, line)
    assert got == text and sorted((e, v) for *_, e, v in found) == sorted(want) and want
    assert all(line[a:b] == v and t == len(line[:a].split()) for a, b, t, _, v in found)


def test_whole_matches_become_stars(spark):
    text, found = entities(spark, "a 1.2.3 b 10.0.0.1", {k: PATTERNS[k] for k in ("ip_address", "version")}, whole=True)
    assert text == "a * b *" and [f[3] for f in found] == ["version", "ip_address"]
    assert java(PATTERNS["email_password"])[1] == {"email": 1, "password": 2}
    assert entities(spark, None) == (None, [])


def test_strings(spark):
    def value(c, *row):
        return spark.createDataFrame([row], ", ".join(f"c{i} {'int' if isinstance(x, int) else 'string'}" for i, x in enumerate(row))).select(c).first()[0]

    for text in ("a\nb", "a\r\n\rb\n", "", "\n", "x\x0by z\x85", "end\n\n"):
        assert value(S.split_lines(F.col("c0")), text) == text.splitlines()
    assert value(S.nascii(F.col("c0")), "aéèb") == "a<NASCII>b" and value(S.strip(F.col("c0")), " \ta b\n") == "a b"
    assert value(S.word_tokens(F.col("c0")), " a=b:,c ") == ["a", "b", "c"] and value(S.tokens(F.col("c0")), " a  b") == ["", "a", "b"]
    toks = S.tokens(F.col("c0"))
    assert value(S.char_start(toks, F.lit(2)), "ab c def") == 5 and value(S.char_start(toks, F.lit(3)), "ab c def") is None
    assert value(S.block_ids(F.col("c0")), "blk_1 blk_-2 blk_1") == ["blk_1", "blk_-2"]
    got = value(S.indicators(F.col("c0")), "see hxxp://evil[.]example[.]com/a 10[.]0[.]0[.]1 bob[at]x(dot)org d41d8cd98f00b204e9800998ecf8427e fe80::1:2")
    assert {tuple(x) for x in got} >= {("url", "http://evil.example.com/a"), ("ipv4", "10.0.0.1"), ("email", "bob@x.org"), ("hash", "d41d8cd98f00b204e9800998ecf8427e"), ("ipv6", "fe80::1:2")}
    assert value(S.edge_token(F.col("c0"), F.col("c1")), "b", "a") == "a|b"


def test_log_formats(spark):
    t = spark.createDataFrame([("logger: User bal Timed out",), ("no process",)], "line string")
    fmt = "<Process>: <content>"
    assert [tuple(r) for r in readers.format_columns(t, fmt).select("Process", "content").collect()] == [("logger", "User bal Timed out")]
    assert [r.rejected for r in readers.format_columns(t, fmt, drop=False).collect()] == [False, True]
    assert readers.format_columns(t, "<content>").count() == 2
    got = readers.numbered(spark.range(50).repartition(7), "id").collect()
    assert sorted((r.id, r.log_id) for r in got) == [(i, i + 1) for i in range(50)]


def test_sources(spark, tmp_path):
    hits = spark.createDataFrame([("h1", [("a\n\nb",), ("c",)]), ("h2", [])], "id string, results array<struct<body:string>>")
    assert sorted(r.line for r in readers.search_hits(hits).collect()) == ["a", "b", "c"]
    assert readers.search_hits(hits, most=2).count() == 2 and readers.search_hits(hits, most=0).count() == 0
    docs = spark.createDataFrame([(1, "d", None, "x\n\ny", ["p", "q"]), (2, None, "s", None, None)], "k int, domain string, crawlDate string, text string, more array<string>")
    config = {"collections": [{"name": "c", "id_field": "k", "prop_fields": ["domain", "crawlDate", "gone"], "text_fields": ["text", "more", "none"]}]}
    got = readers.crawl({"c": docs}, config).collect()
    assert [r.line for r in got] == ["x", "", "y", "p", "q"] and got[0].metadata == {"domain": "d"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"id":"1","line":"l","metadata":{"a":"b"}}\nbroken\n')
    assert [r.id for r in readers.json_lines(spark, str(tmp_path / "a" / "x.jsonl")).collect()] == ["1", None]
    assert readers.json_directory(spark, str(tmp_path), readers.RAW_LOG).count() == 2
    (tmp_path / "u.csv").write_text("url,label\na.com,bad\nb.com,good\n")
    assert {(r.url, r.label) for r in readers.labelled_urls(spark, str(tmp_path / "u.csv")).collect()} == {("a.com", 1), ("b.com", 0)}
    (tmp_path / "s.csv").write_text("Content,EventId\nhello,E1\n")
    assert tuple(readers.structured_csv(spark, str(tmp_path / "s.csv")).first()) == ("hello", "E1")
    np.savez(tmp_path / "x.npz", x_data=np.array([[1, 2], [3, 4]]), y_data=np.array([0, 1]))
    assert [tuple(r) for r in readers.arrays(spark, str(tmp_path / "x.npz")).collect()] == [([1, 2], 0), ([3, 4], 1)]
    (tmp_path / "c.json").write_text('{"host":"","collections":[]}')
    assert readers.load_config(str(tmp_path / "c.json"))["collections"] == []


RAW = [
    "logger: User bal (192.168.139.1) set 'SYSLOG_NOTICE' to ''", "logger: User bal (192.168.139.2) set 'SYSLOG_WARN' to ''", "no format",
    "logger: 10.0.0.9;root;toor did log in", "logger: User bal  (192.168.139.3)  set 'SYSLOG_ERR' to ''", "logger: mail a@b.org:pw é 10.0.0.9",
]


def raw(spark):
    return spark.createDataFrame([(str(i), "c", x, {"k": "v"}, i) for i, x in enumerate(RAW)], "id string, source_collection string, line string, metadata map<string,string>, seq long")


def test_parse(spark):
    out = {r.seq: r for r in parse.parse(raw(spark), "seq", "<Process>: <content>").collect()}
    assert sorted(out) == [0, 1, 3, 4, 5]
    assert out[1].log_key == "User bal (<IP_ADDRESS>) set * to ''" and out[1].event_ord == out[0].event_ord == 0
    content = RAW[4].split(": ", 1)[1]
    assert [(p.entity, p.value) for p in out[4].params] == [("ip_address", "192.168.139.3"), ("unnamed", "'SYSLOG_ERR'")]
    assert all(content[p.char_start : p.char_end] == p.value for p in out[4].params)
    slot = out[4].params[1]
    assert (slot.prev_token, slot.next_token) == ("set", "to")
    assert out[5].line.endswith("<NASCII> 10.0.0.9") and [p.entity for p in out[5].params][:2] == ["email", "password"]
    assert len({r.log_id for r in out.values()}) == 5


def test_pipeline_upserts(spark, tmp_path):
    folder = str(tmp_path)
    n = parse.run_pipeline(spark, raw(spark), "seq", folder, "<Process>: <content>")
    assert n == {"parsed": 5, "templates": 3}
    v = {(r.collection, r.name): r for r in sinks.read_table(spark, f"{folder}/vertices").collect()}
    e = sinks.read_table(spark, f"{folder}/edges")
    assert v["users", "root"].props["password"] == "toor" and ("ip_addrs", "10.0.0.9") in v and ("collections", "c") in v
    before = (len(v), e.count())
    assert e.filter("collection = 'has_ip_addr'").count() == 5
    parse.run_pipeline(spark, raw(spark), "seq", folder, "<Process>: <content>")
    assert (sinks.read_table(spark, f"{folder}/vertices").count(), sinks.read_table(spark, f"{folder}/edges").count()) == before
    assert spark.read.json(f"{folder}/parsed_logs").count() == 10


def test_upsert_keeps_last_values_of_each_property(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 1)], "k int, p string, q string, o int")
    new = spark.createDataFrame([(1, None, "y", 2), (3, "c", None, 2)], "k int, p string, q string, o int")
    assert {tuple(r) for r in graph.upsert(old, new, ["k"], "o").collect()} == {(1, "a", "y", 2), (2, "b", None, 1), (3, "c", None, 2)}


def test_upsert_overlays_maps(spark):
    kind = "k int, m map<string,string>, o int"
    old = spark.createDataFrame([(1, {"password": "p", "x": "1"}, 1), (2, None, 1), (None, {"a": "b"}, 1), (4, {}, 1)], kind)
    new = spark.createDataFrame([(1, {"x": "2", "z": None}, 2), (1, {"y": "3"}, 3), (2, {"q": "r"}, 2), (3, None, 2), (None, {"c": "d"}, 2)], kind)
    got = {r.k: (r.m, r.o) for r in graph.upsert(old, new, ["k"], "o").collect()}
    assert got == {1: ({"password": "p", "x": "2", "y": "3"}, 3), 2: ({"q": "r"}, 2), 3: (None, 2), None: ({"a": "b", "c": "d"}, 2), 4: ({}, 1)}


def test_merged_tables_rewrite_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ids, v, o: spark.createDataFrame([(i, v, {v: str(i)}, o) for i in ids], "k int, v string, m map<string,string>, o int")
    sinks.merge_table(rows(range(40), "a", 1), path, ["k"], "o", 8)
    before = sinks._versions(spark, path)
    sinks.merge_table(rows([3, 77], "b", 2), path, ["k"], "o", 8)
    after = sinks._versions(spark, path)
    assert sum(after[b] != before.get(b) for b in after) <= 2
    got = {r.k: (r.v, r.m) for r in sinks.read_table(spark, path).collect()}
    assert got[3] == ("b", {"a": "3", "b": "3"}) and got[77] == ("b", {"b": "77"}) and got[4] == ("a", {"a": "4"}) and len(got) == 41
    for k in range(3):
        sinks.merge_table(rows([3], f"c{k}", 3 + k), path, ["k"], "o", 8)
    assert sinks.read_table(spark, path).count() == 41 and len(sinks.read_table(spark, path).filter("k = 3").first().m) == 5


def test_a_retried_batch_adds_nothing(spark, tmp_path):
    p = parse.parse(raw(spark), "seq", "<Process>: <content>")
    for _ in range(2):
        sinks.fan_out(p, str(tmp_path), 7)
    assert spark.read.json(f"{tmp_path}/parsed_logs").count() == 5 and spark.read.text(f"{tmp_path}/log_keys").count() == 3


def test_features_by_hand(spark):
    rows = [(0, "A"), (0, "B"), (0, "A"), (1, "B"), (2, "B"), (2, "C")]
    long = features.counts(spark.createDataFrame(rows, "s int, e string"), "s", "e")
    wide = {r.instance: (r.A, r.B, r.C) for r in features.wide(long, ["A", "B", "C"]).collect()}
    assert wide == {0: (2, 1, 0), 1: (0, 1, 0), 2: (0, 1, 1)}
    model = features.fit(long, "tf-idf", "zero-mean")
    idf = {r.event: r.idf for r in model.vocabulary.collect()}
    assert idf["A"] == pytest.approx(math.log(3 / (1 + 1e-8))) and idf["B"] == pytest.approx(0, abs=1e-8)
    x = {(r.instance, r.event): r.x for r in model.transform(long).collect()}
    assert len(x) == 9 and x[0, "A"] == pytest.approx(2 * idf["A"] - 2 / 3 * idf["A"]) and x[1, "A"] == pytest.approx(-2 / 3 * idf["A"])
    oov = features.fit(long, oov=True, min_count=2)
    assert {r.instance: r.x for r in oov.transform(long, fitted=True).filter("event is null").collect()} == {0: 1, 1: 0, 2: 1}
    unseen = features.counts(spark.createDataFrame([(7, "Z"), (7, "Y"), (7, "B")], "s int, e string"), "s", "e")
    assert {r.event: r.x for r in oov.transform(unseen).collect()} == {"B": 1.0, None: 2.0}


def test_invariants_of_a_known_space(spark):
    rng = np.random.default_rng(0)
    data = [(int(a), int(a), int(b), int(2 * b), 0) for a, b in rng.integers(1, 9, (200, 2))]
    t = spark.createDataFrame(data, "a int, b int, c int, d int, z int")
    m = invariants.InvariantsMiner().fit(t, ["a", "b", "c", "d", "z"])
    assert m.invariants[("z",)] == [1] and set(m.invariants) == {("z",), ("a", "b"), ("c", "d")}
    x, y = m.invariants["c", "d"]
    assert x == -2 * y and sum(m.invariants["a", "b"]) == 0
    assert [r.anomaly for r in m.predict(spark.createDataFrame([(1, 1, 2, 4, 0), (1, 2, 2, 4, 0), (1, 1, 2, 4, 1)], t.schema)).collect()] == [0, 1, 1]


def test_trees_and_splits(spark):
    t = spark.createDataFrame([(i, float(i % 7), int(i % 7 > 3)) for i in range(200)], "i int, x double, label int")
    parts = sequences.split_by_class(t, "label", "i", 0.25)
    assert {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()} == {(l, p): n for l in (0, 1) for total in [t.filter(f"label={l}").count()] for p, n in (("train", int(total * 0.75)), ("test", total - int(total * 0.75)))}
    for kw in ({}, {"max_features": "all", "criterion": "entropy", "class_weight": {1: 3.0}}):
        r = trees.DecisionTree(**kw).fit(parts.filter("part='train'"), ["x"]).evaluate(parts.filter("part='test'")).first()
        assert r.f1 > 0.9


def test_arrays(spark):
    t = spark.createDataFrame([("a b c d".split(), "a x c".split(), [1.0, 2.0], [3.0, 5.0])], "t array<string>, u array<string>, v array<double>, w array<double>")
    r = t.select(
        A.matched(F.col("t"), F.col("u")).alias("m"), A.fits(F.array(F.lit("a"), F.lit("*")), F.col("u")).alias("f"), A.wildcards(F.array(F.lit("*"), F.lit("b"), F.lit("*"))).alias("w"),
        A.positional_params(F.col("u"), F.col("t")).alias("p"), A.longest_common_tokens("t", "u").alias("l"), A.edge_l2(F.col("v"), F.col("w")).alias("l2"), A.char_vector(F.lit("abz"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), 5).alias("c"),
        A.char_vector(F.lit("abab"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), 3).alias("c3"),
    ).first()
    assert (r.m, r.f, r.w, r.l, r.l2, r.c, r.c3) == (2, True, [0, 2], ["a", "c"], [4.0, 9.0], [1, 2, 0, 0, 0], [1, 2, 1])
    assert [tuple(x) for x in r.p] == [(2, 3, "b"), (6, 7, "d")]


def test_mining_operators_agree(spark):
    lines = [f"user {i % 9} did {a} at host {i % 4}" for i in range(60) for a in ("login", "logout")] + ["system is going down now"] * 5
    t = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, line string").withColumn("tokens", S.tokens(F.col("line"))).repartition(4)
    exact = mining.mine_exact(t, "seq", "tokens")
    assert {r.template for r in exact.select("template").distinct().collect()} == {"user * did * at host *", "system is going down now"}
    templates = mining.shard_templates(t, "tokens")
    a = mining.assign(t, "tokens", templates).select("seq", F.array_join("template", " ").alias("t"))
    assert {tuple(r) for r in a.collect()} == {(r.seq, r.template) for r in exact.collect()}
    counts = mining.template_counts(a, F.col("t")).collect()
    assert sorted(r["count"] for r in counts) == [5, 120]


@pytest.mark.parametrize("common", [1000, 2, 0])
def test_assign_finds_the_best_of_all(spark, monkeypatch, common):
    import random

    from sparkloom.operators.kernel import Template

    monkeypatch.setattr(mining, "COMMON", common)
    rng = random.Random(common)
    word = lambda: rng.choice(["user"] * 6 + list("abcdefgh") + ["*"])
    templates = [[word() for _ in range(rng.randrange(1, 8))] for _ in range(60)]
    lines = [[rng.choice(["user"] * 4 + list("abcdefghxyz")) for _ in range(rng.randrange(1, 9))] for _ in range(200)] + [None]
    t = spark.createDataFrame(list(enumerate(templates)), "event_ord int, template array<string>")
    got = {r.i: (r.event_ord, r.template) for r in mining.assign(spark.createDataFrame(list(enumerate(lines)), "i int, tokens array<string>"), "tokens", t).collect()}
    for i, line in enumerate(lines):
        best, top = (None, None), 0
        for k, x in enumerate(templates if line else []):
            n = Template(0, x, {j for j, y in enumerate(x) if y == "*"}).score(line)
            if len(line) / 2 <= len(x) <= 2 * len(line) and n > top and 2 * n >= len(line):
                best, top = (k, x), n
        assert got[i] == best, line


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mining, "SHARD", 3)
    monkeypatch.setattr(mining, "MERGED", 2)
    lines = [f"user {i % 9} did {a} at host {i % 4}" for i in range(40) for a in ("login", "logout")] + ["system is going down now"] * 5
    t = spark.createDataFrame([(x.split(),) for x in lines], "tokens array<string>")
    one, two = (sorted(map(tuple, mining.mine_shards(t.repartition(n), "tokens").select(F.array_join("tokens", " "), F.array_join("template", " ")).collect())) for n in (1, 7))
    assert one == two and {x for _, x in one} == {"user * did * at host *", "system is going down now"}


def test_shards_number_templates_as_one_miner_does(spark, monkeypatch):
    lines = ["new member 7"] * 4 + [f"user {i} did a for {i}.5 in usual mode" for i in range(30)] + ["connection from host 1 lost"] * 2 + [f"connection from host {i} lost" for i in range(9)]
    t = spark.createDataFrame([(x.split(),) for x in lines], "tokens array<string>")
    want = ["new member 7", "connection from host * lost", "user * did a for * in usual mode"]
    for size in (20_000, 4):
        monkeypatch.setattr(mining, "SHARD", size)
        monkeypatch.setattr(mining, "MERGED", 2)
        assert [" ".join(r.template) for r in mining.shard_templates(t, "tokens").orderBy("event_ord").collect()] == want


def test_walks(spark):
    e = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string"))
    edges = {(r.src, r.dst) for r in e.collect()}
    w = walks.walks(e, n_walks=3, length=7, p=0.5, q=2, seed=1)
    rows = w.collect()
    assert len(rows) == 3 * 6 and all(len(r.walk) == 7 and all(s in edges for s in zip(r.walk, r.walk[1:])) for r in rows)
    assert {(r.round, r.node, *r.walk) for r in rows} == {(r.round, r.node, *r.walk) for r in walks.walks(e.repartition(3), 3, 7, 0.5, 2, 1).collect()}
    few = spark.createDataFrame([("a", 1.0, 1.0, 1, 3)], "node string, p double, q double, n_walks int, walk_length int")
    some = [r for r in walks.walks(e, 2, 4, overrides=few).collect() if r.node == "a"]
    assert len(some) == 1 and len(some[0].walk) == 3
    p = {(r.previous, r.current, r.dst): r.probability for r in walks.transition_probabilities(e, 0.5, 4).collect()}
    assert p["a", "c", "a"] == pytest.approx(2 / 3.25) and p["a", "c", "b"] == pytest.approx(1 / 3.25) and p["a", "c", "d"] == pytest.approx(0.25 / 3.25)
    assert {r.node: r.community for r in graph.communities(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "key string, vector array<double>")
    assert [r.key for r in walks.most_similar(v, "a", 1).collect()] == ["b"] and walks.all_pairs(v, "average").count() == 6
    with pytest.raises(PySparkException):
        walks.edge_vectors(spark.createDataFrame([("a", "q")], "src string, dst string"), v, "l1").collect()


@pytest.mark.parametrize("kind", ["string", "long"])
def test_walks_of_a_held_graph_are_those_of_joins(spark, monkeypatch, kind):
    import random

    from sparkloom.operators import walkers

    rng = random.Random(1)
    name = lambda i: i if kind == "long" else "é" * (i % 40) + str(i)
    rows = [(name(rng.randrange(30)), name(rng.randrange(30)), float(rng.randrange(1, 4))) for _ in range(70)] + [(name(40), name(i), 1.0) for i in range(30)] + [(name(3), name(99), 1.0)]
    e = spark.createDataFrame(rows + rows[:3], f"src {kind}, dst {kind}, weight double")  # one way, a dead end, parallel edges
    few = spark.createDataFrame([(name(3), 0.1, 9.0, 1, 3), (name(40), None, 0.2, None, 8)], f"node {kind}, p double, q double, n_walks int, walk_length int")
    monkeypatch.setattr(walkers, "SLICE", 16)
    for graph_, more in ((e, {"overrides": few}), (graph.undirected(e), {}), (graph.undirected(e), {"p": 1.0, "q": 1.0})):
        got = []
        for held in (10**6, 0):
            monkeypatch.setattr(walks, "HELD_EDGES", held)
            assert walks._held(walks.written(graph_)) == (held > 0)
            w = walks.walks(graph_, 2, 6, **({"p": 0.5, "q": 2.0, "seed": 3} | more))
            got.append((w.dtypes, sorted(map(str, w.collect()))))
        assert got[0] == got[1] and got[0][1]


@pytest.mark.parametrize("longest", [3, 47])
def test_walks_of_a_hub_hash_in_blocks(spark, longest):
    """No Python worker hashes candidates any more; the rows are those of the numpy walker, at a hub of several blocks too."""
    import numpy as np

    from sparkloom.operators import walkers

    rows = [("hub", f"{i:0{longest if i == 1234 else 1}d}", 1.0 + i % 3) for i in range(2100)] + [(f"{i}", f"{i + 1}", 2.0) for i in range(30)] + [("é", "hub", 1.0)]
    e = graph.undirected(spark.createDataFrame(rows, "src string, dst string, weight double"))
    w = walks.walks(e, 1, 12, 0.5, 2.0, 3)
    assert "ArrowPython" not in w._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in w._jdf.queryExecution().executedPlan().toString()
    got = {r.node: r.walk for r in w.collect()}
    edges = sorted(tuple(r) for r in e.select("src", "dst", "weight").collect())
    names = sorted({x[0] for x in edges})
    at = {x: i for i, x in enumerate(names)}
    src, dst, weight = (np.array(x) for x in zip(*((at[a], at[b], c) for a, b, c in edges)))
    walker = walkers.Walker(names, src.astype(np.int32), dst.astype(np.int32), weight, np.full(len(names), 0.5), np.full(len(names), 2.0), 3)
    want = walker.walk(np.zeros(len(names), np.int32), np.arange(len(names), dtype=np.int32), np.full(len(names), 12))
    assert got == {x: [names[j] for j in want[i]] for i, x in enumerate(names)}


def test_cumulative_draws_follow_weights(spark, monkeypatch):
    """One hash a step, by joins as well, and the chances of first_probabilities."""
    e = graph.undirected(spark.createDataFrame([("hub", f"n{i}", 1.0 + i % 3) for i in range(6)], "src string, dst string, weight double"))
    rows = walks.walks(e, 300, 9, seed=3, cumulative=True).collect()
    seen = [b for r in rows for a, b in zip(r.walk, r.walk[1:]) if a == "hub"]
    for r in walks.first_probabilities(e).filter("src = 'hub'").collect():
        assert seen.count(r.dst) / len(seen) == pytest.approx(r.probability, abs=0.02)
    got = walks.walks(e, 2, 5, seed=3, cumulative=True).collect()
    monkeypatch.setattr(walks, "HELD_EDGES", 0)
    assert sorted(map(str, got)) == sorted(map(str, walks.walks(e, 2, 5, seed=3, cumulative=True).collect()))
    with pytest.raises(ValueError):
        walks.walks(e, p=0.5, cumulative=True)


def test_walks_start_few_jobs(spark):
    """A job for each of the 90 steps took longer than the walks."""
    e = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    spark.sparkContext.setJobGroup("walks", "walks")
    assert walks.walks(e).count() == 30
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("walks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 40


def test_embedding_makes_its_walks_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for x in frames:
            made.add(len(x))
            yield x

    w = spark.createDataFrame([(["a", "b", "c"],), (["b", "c", "a"],)], "walk array<string>").mapInPandas(count, "walk array<string>")
    assert walks.embed(w, dims=4, partitions=1).getVectors().count() == 3 and made.value == 2


def test_embedding_is_that_of_word2vec(spark, monkeypatch):
    """Spark's own loop took twice the time; its vectors on one partition are the same, behind 10,000 words as well."""
    import random

    import numpy as np
    from pyspark.ml.feature import Word2Vec

    rng = random.Random(2)
    words = [f"é{i}" for i in range(40)]
    every = [x for i, x in enumerate(words) for _ in range(100 + 20 * i)]  # no two words as often: ties have no order there
    rng.shuffle(every)
    rows = [(every[i : i + 1100],) for i in range(0, len(every), 1100)] + [(["alone"],)]
    w = spark.createDataFrame(rows, "walk array<string>").coalesce(1)
    model = Word2Vec(vectorSize=12, windowSize=4, minCount=1, seed=1, numPartitions=1, inputCol="walk", outputCol="vector").fit(w)
    want = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    monkeypatch.setattr(walks.Word2Vec, "fit", None)
    made = walks.embed(w, dims=12, window=4, partitions=1)
    got = {r.word: r.vector.toArray() for r in made.getVectors().collect()}
    assert got.keys() == want.keys() and len(got) == 41
    assert all(np.allclose(got[x], want[x], rtol=1e-3, atol=1e-4) for x in got)
    assert made.transform(w).first().vector.size == 12 and made.getVectorSize() == 12
    two = [{r.word: tuple(r.vector.toArray()) for r in walks.embed(w.repartition(2), dims=12, window=4, partitions=2).getVectors().collect()} for _ in range(2)]
    assert two[0] == two[1]  # tasks of one executor do not write into each other's numbers
    with pytest.raises(ValueError):
        walks.embed(w, min_count=10**9)


def test_urls(spark):
    data = [(f"http://good{i}.example.org/page", 0) for i in range(60)] + [(f"http://x{i}.evil.ru/login.exe?q=%00", 1) for i in range(60)]
    model, held = urls.train(spark.createDataFrame(data, "url string, label int"))
    assert held.filter((F.col("label") == 1) == F.col("malicious_warning")).count() >= 0.9 * held.count()
    got = urls.classify(model, spark.createDataFrame([("http://z.evil.ru/login.exe?q=%00",)], "url string")).first()
    assert got.verdict == "bad"
    with pytest.raises(PySparkException):
        urls.classify(model, spark.createDataFrame([("",)], "url string")).collect()
    p = parse.parse(spark.createDataFrame([("1", "c", "get http://z.evil.ru/login.exe now", {}, 1)], "id string, source_collection string, line string, metadata map<string,string>, seq long"), "seq")
    scored = spark.createDataFrame([("http://z.evil.ru/login.exe", True)], "url string, malicious_warning boolean")
    (param,) = urls.enrich_params(p, scored).first().params
    assert param.entity == "url" and param.meta.malicious_warning


def test_rules(spark, tmp_path):
    t = spark.createDataFrame([("a", "exit signal Segmentation Fault (11)", 1), ("b", "fine", None), ("admin", "Fine too", 2)], "who string, msg string, n int")
    (tmp_path / ".hidden").write_text("nope: [")
    (tmp_path / "r.yml").write_text("title: seg\ndetection:\n  keywords:\n    - 'exit signal Segmentation Fault'\n  condition: keywords\n")
    (rule,) = rules.load_rules([tmp_path])
    assert [r.alerts for r in rules.apply_rules(t, [rule], ["msg"]).collect()] == [["seg"], [], []]

    def who(detection):
        return [r.who for r in t.filter(rules.compile_rule({"detection": detection}, ["msg"])).collect()]

    assert who({"s": {"who": "AD*"}, "condition": "s"}) == ["admin"]
    assert who({"s": {"msg|contains|all": ["fine", "too"]}, "f": {"n": None}, "condition": "s or f"}) == ["b", "admin"]
    assert who({"s_1": {"n": 1}, "s_2": {"n": [2, 3]}, "condition": "1 of s_* and not all of them"}) == ["a", "admin"]
    assert who({"s": {"n": 1}, "condition": "not s"}) == ["b", "admin"]
    for bad in ({"s": {}, "condition": "t"}, {"s": {"n": 1}, "condition": "(s"}, {"s": {"n|x": 1}, "condition": "s"}, {"s": {"n": 1}}):
        with pytest.raises(rules.RuleError):
            who(bad)
    assert sinks.compiled_rules([str(tmp_path)], str(tmp_path / "out.txt")) == 0
    (tmp_path / "bad.yml").write_text("a: [")
    assert sinks.compiled_rules([str(tmp_path)], str(tmp_path / "out.txt")) == 3


def test_stream_mining_is_batch_mining(spark, tmp_path):
    lines = [f"user {i % 9} did {a} at host {i % 4}" for i in range(20) for a in ("login", "logout")]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, line string").withColumn("tokens", S.tokens(F.col("line")))
    src = str(tmp_path / "in")
    for k in range(3):
        t.filter(f"seq % 3 >= 0 and floor(seq / 14) = {k}").coalesce(1).write.mode("append").parquet(f"{src}/b{k}")
    exact = {(r.seq, r.template_then, r.event_ord, r.is_new) for r in mining.mine_exact(t, "seq", "tokens").collect()}
    stream = spark.readStream.schema(t.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.mine_stream(stream, "seq", "tokens").writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("mined").collect()
    assert len(rows) == len(lines) and {r.seq for r in rows} == {r[0] for r in exact} and sum(r.is_new for r in rows) == sum(x[3] for x in exact)


def test_lines_are_put_in_order_in_runs(monkeypatch):
    import random

    import pandas as pd
    import pyarrow as pa

    from sparkloom.operators import runs

    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), ["a", str(i)]) for i in range(500)]
    schema, most = pa.schema([("o", pa.int64()), ("t", pa.list_(pa.string()))]), [0]
    kept = runs._run
    monkeypatch.setattr(runs, "_run", lambda parts: most.append(sum(p.num_rows for p in parts)) or kept(parts))
    monkeypatch.setattr(runs, "RUN_ROWS", 50)
    monkeypatch.setattr(runs, "READ", 7)
    got = list(runs.in_order((pd.DataFrame(rows[i : i + 20], columns=["o", "t"]) for i in range(0, 500, 20)), schema))
    assert got == sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)) and max(most) < 80


@pytest.mark.parametrize("stream", [True, False])
def test_exact_mining_passes_lines_in_batches(spark, stream):
    """The miner's task got all lines in one frame."""
    lines = [f"user {i % 9} did {a} at host {i % 4}" for i in range(40) for a in ("login", "logout")] + ["system is going down now"] * 5
    t = spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "seq long, tokens array<string>").repartition(3)
    got = mining.mine_exact(t, "seq", "tokens", stream=stream)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and sorted(r.seq for r in got.collect()) == list(range(85))
    assert {r.template for r in got.collect()} == {"user * did * at host *", "system is going down now"}


def test_stream_load(spark, tmp_path):
    p = parse.parse(raw(spark), "seq", "<Process>: <content>")
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = streams.load(stream, str(tmp_path / "g"), str(tmp_path / "cp"), "seq")
    q.awaitTermination()
    assert sinks.read_table(spark, str(tmp_path / "g/edges")).filter("collection = 'has_log'").count() == 5


def test_stream_correlation(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "ip1", f"u{i}", "fail") for i in range(6)] + [("2024-01-01 00:20:00", "ip1", "u1", "ok"), ("2024-01-01 00:01:00", "ip2", "u1", "fail"), ("2024-01-02 00:00:00", "ip9", "u", "other")]
    t = spark.createDataFrame(rows, "ts string, ip string, usr string, what string")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    out = streams.failures_then_success(s, "ts", "ip", "usr", F.col("what") == "fail", F.col("what") == "ok")
    q = out.writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.actor for r in spark.table("hits").collect()} <= {"ip1"}
    b = rules.brute_force(t.withColumn("ts", F.to_timestamp("ts")), "ts", "ip", "usr", F.col("what") == "fail", F.col("what") == "ok", least=1, minutes=18).collect()
    assert [(r.actor, r.n_failures, r.n_subjects) for r in b] == [("ip1", 4, 4)]
