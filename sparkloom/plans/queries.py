"""Queries over the test tables, one for each operator, and their SQL where SQL can express them."""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import strings as S
from ..functions.entities import PATTERNS, extract_entities, java, numbered
from ..operators import features, graph, invariants, links, metrics, mining, rules, sequences, trees, urls, walks
from ..operators.scratch import scratch_dir
from ..sources import readers
from ..streaming import streams
from . import parse

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- lines, tokens, entities -------------------------------------------------------------------------------------

_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"""parts AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{_ENDS}') AS p, text FROM documents),
kept AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, p[i] AS line FROM kept, unnest(range(1, len(p) + 1)) AS u(i)),
plain AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[^\\x00-\\x7F]+', '<NASCII>', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines)"""


def lines(s: SparkSession, d: str) -> DataFrame:
    return readers.spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(S.split_lines(F.col("text"))).alias("line_no", "line"))


def plain(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).withColumn("line", S.strip(S.nascii(F.col("line"))))


@query(f"WITH {_LINES} SELECT * FROM lines")
def lines_explode(s, d):
    return lines(s, d)


@query(f"WITH {_LINES} SELECT * FROM plain")
def nascii_lines(s, d):
    return plain(s, d)


@query(f"WITH {_LINES} SELECT doc_id, line_no, len(regexp_split_to_array(line, '\\s+')) AS n, array_to_string(regexp_split_to_array(line, '\\s+'), '|') AS tokens FROM plain")
def tokenize_ws(s, d):
    t = S.tokens(F.col("line"))
    return plain(s, d).select("doc_id", "line_no", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, array_to_string(list_filter(regexp_split_to_array(line, '[\\s=:,]'), lambda x: x <> ''), '|') AS tokens FROM plain")
def tokenize_punct(s, d):
    return plain(s, d).select("doc_id", "line_no", F.array_join(S.word_tokens(F.col("line")), "|").alias("tokens"))


def _entity(name: str) -> Callable:
    def run(s, d):
        e = extract_entities(plain(s, d), "line", {name: PATTERNS[name]})
        return e.select("doc_id", "line_no", F.posexplode("entities").alias("pos", "e")).select("doc_id", "line_no", "pos", "e.entity", "e.value")

    return run


for _n in ("ip_address", "email", "version"):
    _rx = numbered(PATTERNS[_n]).replace("'", "''")
    Q[f"entities_{_n}"] = _entity(_n)
    SQL[f"entities_{_n}"] = f"WITH {_LINES}, found AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_rx}', 1) AS v FROM plain) SELECT doc_id, line_no, CAST(i - 1 AS INTEGER) AS pos, '{_n}' AS entity, v[i] AS value FROM found, unnest(range(1, len(v) + 1)) AS u(i)"

#: A line that holds a value of each pattern: its parts, of which those in braces are numbers of the event.
_HOLDS_ALL = (
    "see http://h{e}.example.com/p?q={u} mail u{e}@x{u}.org:10.0.{u}.7:pw{e} or v{e}@y.org:secret{e} or w{e}@z.org open /dev/sd{e} and /proc/{e}/maps from 10.1.{u}.9;root{e};toor{e} "
    "or 10.2.{u}.8:80 at 0xdead{e}-{u} id 123e4567-e89b-12d3-a456-{d} uses {u}K and {e}MB plus {u}gb on {u}.4GHz file /usr/lib{e}/x.so page /var/www{e}/a.php ver v{u}.2.{e}-rc1 count {e} done"
)
_PARTS = {"e": "event_id", "u": "user_id", "d": "lpad(CAST(event_id AS STRING), 12, '0')"}


def _spoken(parts: dict[str, str], kind: str) -> str:
    """SQL of the line above."""
    words = re.split(r"(\{\w\})", _HOLDS_ALL)
    return " || ".join(f"CAST({parts[w[1]]} AS {kind})" if w.startswith("{") else f"'{w}'" for w in words if w)


_FULL = f"full_lines AS (SELECT event_id, {_spoken(_PARTS | {'d': _PARTS['d'].replace('STRING', 'VARCHAR')}, 'VARCHAR')} AS line FROM events)"
#: For the patterns that look around, ones for SQL that do not, and what the line is rewritten to for them.
_AROUND = {
    "uri": (r"(/(?:[\w.]+/)+\w+\.php)", "line"),
    "file": (r"(/(?:[\w.]+/)+\w+(?:\.\w+)?)", r"regexp_replace(regexp_replace(line, '/(dev|proc)', ' ', 'g'), '/\w+\.php', '/', 'g')"),
    "number": (r"\s(\d+)\s", "line"),
}


def full_lines(s: SparkSession, d: str) -> DataFrame:
    return readers.spread(table(s, d, "events")).select("event_id", F.expr(_spoken(_PARTS, "STRING")).alias("line"))


def _full_entity(name: str) -> Callable:
    def run(s, d):
        e = extract_entities(full_lines(s, d), "line", {name: PATTERNS[name]})
        return e.select("event_id", F.posexplode("entities").alias("pos", "e")).select("event_id", "pos", "e.entity", "e.value")

    return run


for _n in PATTERNS:
    _rx, _line = _AROUND.get(_n, (numbered(PATTERNS[_n]), "line"))
    _groups = java(PATTERNS[_n])[1]
    _each = " UNION ALL ".join(f"SELECT event_id, CAST((i - 1) * {len(_groups)} + {k} AS INTEGER) AS pos, '{g}' AS entity, v{k}[i] AS value FROM found, unnest(range(1, len(v{k}) + 1)) AS u(i)" for k, g in enumerate(_groups))
    _lists = ", ".join(f"regexp_extract_all({_line}, '{_rx}', {number}) AS v{k}" for k, number in enumerate(_groups.values()))
    Q[f"full_{_n}"] = _full_entity(_n)
    SQL[f"full_{_n}"] = f"WITH {_FULL}, found AS (SELECT event_id, {_lists} FROM full_lines) {_each}"


def _chain_sql() -> str:
    """All patterns in turn, each on what the ones before have rewritten."""
    steps, now = [_FULL, "s0 AS (SELECT event_id, line AS t, CAST([] AS VARCHAR[]) AS found FROM full_lines)"], 0
    for name, pattern in PATTERNS.items():
        rx, groups = _AROUND.get(name, (numbered(pattern),))[0], java(pattern)[1]
        new = (";" if name == "ip_address_user_password" else ":").join(f"<{g.upper()}>" for g in groups)
        values = " || ".join(f"list_transform(regexp_extract_all(t, '{rx}', {k}), lambda v: '{g}=' || v)" for g, k in groups.items())
        rewritten = f" {new} " if name == "number" else new
        steps.append(f"s{now + 1} AS (SELECT event_id, regexp_replace(t, '{rx}', '{rewritten}', 'g') AS t, found || {values} AS found FROM s{now})")
        now += 1
    return f"WITH {', '.join(steps)} SELECT event_id, t AS rewritten, array_to_string(list_sort(found), ' ') AS found, true AS spans_hold FROM s{now}"


@query(_chain_sql())
def entity_chain(s, d):
    e = extract_entities(full_lines(s, d), "line")
    spans = F.forall("entities", lambda x: F.substring("line", x["char_start"] + 1, x["char_end"] - x["char_start"]) == x["value"])
    return e.select("event_id", "rewritten", F.array_join(F.sort_array(F.transform("entities", lambda x: F.concat(x["entity"], F.lit("="), x["value"]))), " ").alias("found"), spans.alias("spans_hold"))


@query(f"WITH {_LINES}, found AS (SELECT doc_id, line_no, line, regexp_extract_all(line, '{numbered(PATTERNS['version'])}', 0) AS v FROM plain) SELECT doc_id, line_no, regexp_replace(line, '{numbered(PATTERNS['version'])}', '<VERSION>', 'g') AS rewritten, CAST(length(regexp_extract(line, '^(.*?){numbered(PATTERNS['version'])}', 1)) AS INTEGER) AS first_start FROM found WHERE len(v) > 0")
def entity_rewriting(s, d):
    e = extract_entities(plain(s, d), "line", {"version": PATTERNS["version"]}).filter(F.size("entities") > 0)
    return e.select("doc_id", "line_no", "rewritten", F.get("entities", F.lit(0))["char_start"].alias("first_start"))


@query()
def entities_all(s, d):
    e = extract_entities(plain(s, d), "line")
    return e.filter(F.size("entities") > 0).select("doc_id", "line_no", "rewritten", F.to_json("entities").alias("entities"))


def _indicators_sql() -> str:
    """RE2 has no look-around: with other characters doubled, each of a run's two neighbours is its own to consume."""
    t = "line"
    for pattern, meant in S.REFANGED:
        t = f"regexp_replace({t}, '{pattern}', '{meant}', 'g')"
    kinds = []
    for kind, rx in S.INDICATORS.items():
        text, group, around = "t", 0, re.search(r"\(\?<!\[(.*?)\]\)", rx)
        if around:
            bare = re.sub(r"\(\?<?!\[.*?\]\)", "", rx.removeprefix("(?i)"))
            text, group, rx = f"regexp_replace(t, '([^{around[1]}])', '\\1\\1', 'g')", 1, f"(?i)(?:^|[^{around[1]}])({bare})(?:[^{around[1]}]|$)"
        quoted = rx.replace("'", "''")
        kinds.append(f"SELECT DISTINCT doc_id, line_no, '{kind}' AS kind, unnest(regexp_extract_all({text}, '{quoted}', {group})) AS value FROM meant")
    return f"WITH {_LINES}, meant AS (SELECT doc_id, line_no, {t} AS t FROM plain) {' UNION ALL '.join(kinds)}"


@query(_indicators_sql())
def indicators_refanged(s, d):
    return plain(s, d).select("doc_id", "line_no", F.explode(S.indicators(F.col("line"))).alias("i")).select("doc_id", "line_no", "i.kind", "i.value")


@query("SELECT event_id, 'u' || user_id AS actor, event_type AS action, CAST(event_id AS VARCHAR) AS ref FROM events")
def logformat_columns(s, d):
    e = table(s, d, "events").select("event_id", F.concat(F.lit("u"), "user_id", F.lit(":  "), "event_type", F.lit(" "), "event_id").alias("line"))
    return readers.format_columns(e, "<actor>: <action> <ref>").drop("line")


@query("SELECT page_id, substr(md5(url), 1, 8) AS h FROM pages")
def short_hash(s, d):
    return table(s, d, "pages").select("page_id", S.short_hash(F.col("url")).alias("h"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS log_id FROM events")
def row_ordinal(s, d):
    return readers.numbered(table(s, d, "events").select("event_id"), "event_id")


# ---- crawl --------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT CAST(l.doc_id AS VARCHAR) AS id, 'documents' AS source_collection, line, d.lang || '/' || d.source AS metadata FROM lines l JOIN documents d USING (doc_id)")
def crawl_documents(s, d):
    config = {"collections": [{"name": "documents", "id_field": "doc_id", "prop_fields": ["lang", "source", "no_such"], "text_fields": ["text", "missing"]}]}
    raw = readers.crawl({"documents": table(s, d, "documents")}, config)
    return raw.withColumn("metadata", F.concat_ws("/", F.col("metadata")["lang"], F.col("metadata")["source"]))


# ---- graph --------------------------------------------------------------------------------------------------------

_MAILS = f"{_LINES}, found AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{numbered(PATTERNS['email'])}', 1)) AS v, 'email' AS entity FROM plain UNION ALL SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '{numbered(PATTERNS['email'])}', '<EMAIL>', 'g'), '{numbered(PATTERNS['ip_address'])}', 1)), 'ip_address' FROM plain)"


def _two_entities(s, d) -> DataFrame:
    e = extract_entities(plain(s, d), "line", {k: PATTERNS[k] for k in ("email", "ip_address")})
    return e.select("doc_id", "line_no", F.explode("entities").alias("e")).select("doc_id", "line_no", "e.entity", "e.value", "e.char_start", "e.char_end", "e.token_start").withColumn("password", F.lit(None).cast("string")).withColumn("log_id", F.concat_ws("-", "doc_id", "line_no"))


@query(f"WITH {_MAILS} SELECT entity, v AS value, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY ALL ORDER BY n_docs DESC, entity, value LIMIT 20")
def entity_degree_topk(s, d):
    return _two_entities(s, d).groupBy("entity", "value").agg(F.countDistinct("doc_id").alias("n_docs")).orderBy(F.desc("n_docs"), "entity", "value").limit(20)


@query(f"WITH {_MAILS} SELECT DISTINCT CASE entity WHEN 'email' THEN 'emails' ELSE 'ip_addrs' END AS collection, substr(md5(v), 1, 8) AS key, v AS name FROM found")
def entity_vertices(s, d):
    return graph.entity_vertices(_two_entities(s, d), ["doc_id", "line_no"]).drop("props")


@query(f"WITH {_MAILS} SELECT DISTINCT CASE entity WHEN 'email' THEN 'has_email' ELSE 'has_ip_addr' END AS collection, doc_id || '-' || line_no || '-' || substr(md5(v), 1, 8) AS key, doc_id || '-' || line_no AS src, substr(md5(v), 1, 8) AS dst, v AS name FROM found")
def entity_edges(s, d):
    return graph.entity_edges(_two_entities(s, d), "log_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v, max(event_id) AS event_id FROM (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) GROUP BY user_id")
def vertices_upsert(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    half = F.col("event_id") % 2 == 0
    return graph.upsert(e.filter(half), e.filter(~half), ["user_id"], "event_id")


@query("WITH p AS (SELECT user_id, event_type AS k, arg_max(value, event_id) FILTER (event_id % 4 <> 0) AS v, max(event_id) AS o FROM events GROUP BY ALL) SELECT user_id, coalesce(string_agg(k || '=' || CAST(v AS VARCHAR), ' ' ORDER BY k) FILTER (v IS NOT NULL), '') AS props, max(o) AS event_id FROM p GROUP BY user_id")
def vertices_props(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.create_map("event_type", F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string"))).alias("props"))
    half = F.col("event_id") % 2 == 0
    out = graph.upsert(e.filter(half), e.filter(~half), ["user_id"], "event_id")
    return out.withColumn("props", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"])), " "))


@query("SELECT 'n' || lpad(CAST(i AS VARCHAR), 3, '0') AS node, 'n000' AS community FROM range(0, 62) AS t(i) UNION ALL SELECT 'x', 'x' UNION ALL SELECT 'y', 'x'")
def communities_of_a_path(s, d):
    """A path of 62 nodes and one edge beside it."""
    node = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 3, "0"))
    path = s.range(61).select(node(F.col("id")).alias("src"), node(F.col("id") + 1).alias("dst"))
    return graph.communities(graph.undirected(path.unionByName(s.createDataFrame([("y", "x")], "src string, dst string"))))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_vertices_anti(s, d):
    return graph.new_rows(table(s, d, "labels"), table(s, d, "documents").select("doc_id", "lang"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def known_vertices_semi(s, d):
    return graph.changed_rows(table(s, d, "labels"), table(s, d, "documents").select("doc_id", "lang"), ["doc_id"])


_EDGES = """edges0 AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 1.0::DOUBLE AS weight FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2.0::DOUBLE FROM nation),
both_ways AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM edges0 UNION ALL SELECT dst, src, weight FROM edges0) GROUP BY src, dst)"""


def supply(s, d) -> DataFrame:
    a = table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit(1.0).alias("weight"))
    b = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit(2.0).alias("weight"))
    return graph.undirected(a.unionByName(b))


@query(f"WITH {_EDGES} SELECT src, count(*) AS degree FROM both_ways GROUP BY src")
def walk_degree(s, d):
    return supply(s, d).groupBy("src").agg(F.count("*").alias("degree"))


@query("SELECT n.n_name, s.s_suppkey AS dst FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey")
def out_edges(s, d):
    v = table(s, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    e = table(s, d, "supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    return graph.out_edges(v, e).join(v.withColumnRenamed("key", "src"), "src").select("n_name", "dst")


@query(f"WITH RECURSIVE {_EDGES}, reach AS (SELECT DISTINCT src AS node, src AS far FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON b.src = r.far) SELECT node, min(far) AS community FROM reach GROUP BY node")
def communities(s, d):
    return graph.communities(supply(s, d))


# ---- sequences and features ---------------------------------------------------------------------------------------


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS events FROM events GROUP BY user_id")
def event_sequences(s, d):
    return sequences.sequences(table(s, d, "events"), "user_id", "event_type", ["ts", "event_id"]).withColumn("events", F.array_join("events", ">"))


_BLOCKS = "blocks AS (SELECT event_id, event_type, 'got blk_' || user_id || ' and blk_-' || (event_id % 7) || CASE WHEN event_id % 5 = 0 THEN ' blk_' || user_id ELSE '' END AS content FROM events)"


@query(f"WITH {_BLOCKS}, ids AS (SELECT event_id, event_type, unnest(list_distinct(regexp_extract_all(content, '(blk_-?\\d+)', 1))) AS block_id FROM blocks) SELECT block_id, string_agg(event_type, '>' ORDER BY event_id) AS events FROM ids GROUP BY block_id")
def session_sequences(s, d):
    e = table(s, d, "events").withColumn("content", F.concat(F.lit("got blk_"), "user_id", F.lit(" and blk_-"), F.col("event_id") % 7, F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" blk_"), "user_id")).otherwise("")))
    return sequences.session_sequences(e, "event_id", event="event_type").withColumn("events", F.array_join("events", ">"))


@query("WITH t AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM t")
def train_test_split(s, d):
    return sequences.split_by_class(table(s, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.3)


@query("SELECT d.doc_id, CAST(l.toxic = 1 AS INTEGER) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def labelled_join(s, d):
    return sequences.labelled(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id", "toxic", 1)


TYPES = ["click", "error", "purchase", "signup", "view"]
_DAYS = "rows AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS instance, event_type AS event FROM events), cnt AS (SELECT instance, event, count(*)::DOUBLE AS x FROM rows GROUP BY ALL), nn AS (SELECT count(DISTINCT instance) AS n FROM cnt), voc AS (SELECT event, count(*) AS df, sum(x) AS s, ln(any_value(n)::DOUBLE / (count(*) + 1e-8)) AS idf, any_value(n) AS n FROM cnt, nn GROUP BY event)"


def days(s, d) -> DataFrame:
    """Event counts of a user's day."""
    e = table(s, d, "events").withColumn("instance", F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    return features.counts(e, "instance", "event_type")


@query(f"WITH {_DAYS} SELECT instance, " + ", ".join(f"coalesce(sum(x) FILTER (event = '{t}'), 0) AS {t}" for t in TYPES) + " FROM cnt GROUP BY instance")
def event_count_matrix(s, d):
    return features.wide(days(s, d), TYPES)


@query(f"WITH {_DAYS} SELECT instance, event, round(x * idf, 6) AS x FROM cnt JOIN voc USING (event)")
def event_tfidf(s, d):
    long = days(s, d)
    return features.fit(long, "tf-idf").transform(long).withColumn("x", F.round("x", 6))


@query(f"WITH {_DAYS}, grid AS (SELECT DISTINCT c.instance, v.event, v.s / v.n AS mean FROM cnt c CROSS JOIN voc v) SELECT g.instance, g.event, round(coalesce(c.x, 0) - g.mean, 6) AS x FROM grid g LEFT JOIN cnt c ON c.instance = g.instance AND c.event = g.event")
def event_zero_mean(s, d):
    long = days(s, d)
    return features.fit(long, None, "zero-mean").transform(long).withColumn("x", F.round("x", 6))


@query(f"WITH {_DAYS} SELECT instance, event, round(CASE WHEN x * idf <> 0 THEN 1 / (1 + exp(-x * idf)) ELSE 0 END, 6) AS x FROM cnt JOIN voc USING (event)")
def event_sigmoid(s, d):
    long = days(s, d)
    return features.fit(long, "tf-idf", "sigmoid").transform(long).withColumn("x", F.round("x", 6))


@query(f"WITH {_DAYS} SELECT instance, count(DISTINCT event) FILTER (event IN ('signup', 'error')) AS oov FROM cnt GROUP BY instance")
def oov_counts(s, d):
    long = days(s, d)
    model = features.fit(long.filter(~F.col("event").isin("signup", "error")), oov=True)
    return model.transform(long).filter("event is null").select("instance", F.col("x").cast("long").alias("oov"))


@query(f"WITH {_DAYS} SELECT a.event AS a, b.event AS b, sum(a.x * b.x) AS g FROM cnt a JOIN cnt b ON a.instance = b.instance AND a.event <= b.event GROUP BY a.event, b.event")
def gram_matrix(s, d):
    return invariants.gram_long(days(s, d))


@query(f"WITH {_DAYS}, w AS (SELECT instance, " + ", ".join(f"coalesce(sum(x) FILTER (event = '{t}'), 0) AS {t}" for t in TYPES) + " FROM cnt GROUP BY instance) SELECT instance, CAST(abs(click - view) + abs(error) > 1e-6 AS INTEGER) AS anomaly FROM w")
def invariant_predict(s, d):
    m = invariants.InvariantsMiner()
    m.invariants = {("click", "view"): [1, -1], ("error",): [1]}
    return m.predict(features.wide(days(s, d), TYPES)).select("instance", "anomaly")


@query("SELECT * FROM (VALUES ('never', '1'), ('click,view,opened', '1,1,-1')) AS t(columns, theta)")
def invariants_mined(s, d):
    w = features.wide(days(s, d), TYPES).withColumn("opened", F.col("click") + F.col("view")).withColumn("never", F.lit(0.0))
    m = invariants.InvariantsMiner().fit(w, ["click", "view", "opened", "never"])
    return s.createDataFrame([(",".join(c), ",".join(map(str, t))) for c, t in m.invariants.items()], "columns string, theta string")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0), 0)::DOUBLE AS precision, coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0)::DOUBLE AS recall, coalesce(2 * count(*) FILTER (quality = 1 AND toxic = 1) / nullif(2 * count(*) FILTER (quality = 1 AND toxic = 1) + count(*) FILTER (quality = 1 AND toxic <> 1) + count(*) FILTER (quality <> 1 AND toxic = 1), 0), 0)::DOUBLE AS f1 FROM labels")
def prf1(s, d):
    return metrics.prf1(table(s, d, "labels"), "quality", "toxic")


@query(f"WITH {_DAYS}, w AS (SELECT instance, CAST(bool_or(event = 'error') AS INTEGER) AS label FROM cnt GROUP BY instance), t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY instance) > floor(count(*) OVER (PARTITION BY label) * (1 - 0.3)) AS held FROM w) SELECT count(*) FILTER (held AND label = 1) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM t")
def decision_tree(s, d):
    """The label can be read off one column, so the tree must make no mistake."""
    w = features.wide(days(s, d), TYPES).withColumn("label", (F.col("error") > 0).cast("int"))
    parts = sequences.split_by_class(w, "label", "instance", 0.3)
    tree = trees.DecisionTree(max_depth=3).fit(parts.filter("part = 'train'"), TYPES)
    return tree.evaluate(parts.filter("part = 'test'"))


# ---- mining -------------------------------------------------------------------------------------------------------


#: Lines of four shapes that have less than half of their words in common, so that each is one template.
_SHAPES = "CASE event_type WHEN 'error' THEN 'connection from host ' || user_id || ' lost' WHEN 'purchase' THEN 'paid ' || {value} || ' to account ' || user_id || ' with thanks' WHEN 'signup' THEN 'new member ' || user_id ELSE 'user ' || user_id || ' did ' || event_type || ' for ' || {value} || ' in usual mode' END"
_STARS = "CASE event_type WHEN 'error' THEN 'connection from host * lost' WHEN 'purchase' THEN 'paid * to account * with thanks' WHEN 'signup' THEN 'new member *' ELSE 'user * did * for * in usual mode' END"
_SHAPED = f"l AS (SELECT event_id, {_SHAPES.format(value="printf('%.2f', value)")} AS line, {_STARS} AS template FROM events)"


def event_lines(s, d) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.expr(_SHAPES.format(value="format_string('%.2f', value)")).alias("line"))
    return e.withColumn("tokens", S.tokens(F.col("line")))


@query(f"WITH {_SHAPED}, n AS (SELECT line, template, count(*) AS n FROM l GROUP BY line, template), d AS (SELECT template, row_number() OVER (ORDER BY n DESC, line) AS r FROM n), t AS (SELECT template, CAST(row_number() OVER (ORDER BY min(r)) - 1 AS INTEGER) AS event_ord FROM d GROUP BY template) SELECT event_id, event_ord, template FROM l JOIN t USING (template)")
def template_assign(s, d):
    return mining.mine_shards(event_lines(s, d), "tokens").select("event_id", "event_ord", F.array_join("template", " ").alias("template"))


@query(f"WITH {_SHAPED} SELECT substr(md5(template), 1, 8) AS event_id, template, count(*) AS count FROM l GROUP BY template")
def template_counts(s, d):
    return mining.template_counts(mining.mine_shards(event_lines(s, d), "tokens"), F.array_join("template", " "))


_MINED = f"WITH {_SHAPED}, t AS (SELECT template, min(event_id) AS first, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS event_ord FROM l GROUP BY template) SELECT event_id, event_ord, template, event_id = first AS is_new FROM l JOIN t USING (template)"


@query(_MINED)
def template_mine_exact(s, d):
    return mining.mine_exact(event_lines(s, d), "event_id", "tokens").select("event_id", "event_ord", "template", "is_new")


@query(_MINED)
def template_mine_batch(s, d):
    e = event_lines(s, d).withColumn("tokens", S.word_tokens(F.col("line")))
    return mining.mine_exact(e, "event_id", "tokens", stream=False).select("event_id", "event_ord", "template", "is_new")


@query("SELECT event_id, '[' || CASE WHEN event_type = 'view' THEN '' ELSE '{\"char_start\":' || 11 + length(CAST(user_id AS VARCHAR)) || ',\"char_end\":' || 11 + length(CAST(user_id AS VARCHAR)) + length(event_type) || ',\"value\":\"' || event_type || '\"}' END || ']' AS parameters FROM (SELECT event_id, user_id, event_type FROM events)")
def template_params(s, d):
    t = F.array(F.lit("user:"), F.col("user_id").cast("string"), F.lit("did"), F.lit("view"))
    x = table(s, d, "events").withColumn("t", t).withColumn("tokens", F.array(F.lit("user:"), F.col("user_id").cast("string"), F.lit("did"), F.col("event_type")))
    return mining.with_params(x, "t", "tokens").select("event_id", "parameters")


_NEXT = "SELECT event_id, list_transform(['user', CAST(user_id AS VARCHAR), 'did', event_type, 'k', CAST(event_id % 3 AS VARCHAR) || 'x'], lambda x: x) AS t FROM events"


@query(f"WITH l AS ({_NEXT}) SELECT a.event_id, array_to_string(list_filter(a.t, lambda x, i: x = b.t[i]), ' ') AS common FROM l a JOIN l b ON b.event_id = a.event_id + 1")
def lcs_tokens(s, d):
    """Of lines whose words at different places differ, so that what they have in common stands at the same places."""
    e = table(s, d, "events").select("event_id", F.array(F.lit("user"), F.col("user_id").cast("string"), F.lit("did"), "event_type", F.lit("k"), F.concat(F.col("event_id") % 3, F.lit("x"))).alias("t"))
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("t").alias("u"))
    return e.join(n, "event_id").select("event_id", F.array_join(A.longest_common_tokens("t", "u"), " ").alias("common"))


@query("SELECT a.item_id, len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))) AS overlap FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def token_overlap(s, d):
    b = table(s, d, "benchmark").select("item_id", F.split("text", " ").alias("t"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(n, "item_id").select("item_id", F.size(F.array_intersect("t", "u")).cast("long").alias("overlap"))


# ---- walks and vectors --------------------------------------------------------------------------------------------

_PAIR = "pairs AS (SELECT a.vec_id AS src, list_transform(range(1, len(a.embedding) + 1), lambda i: [a.embedding[i]::DOUBLE, b.embedding[i]::DOUBLE]) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _edge(kind: str, sql: str):
    def run(s, d):
        v = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
        e = v.select(F.col("key").alias("src"), (F.col("key") + 1).alias("dst")).join(v.select(F.col("key").alias("dst")), "dst", "left_semi")
        return walks.edge_vectors(e, v, kind).select("src", F.round(F.aggregate("feature", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))

    Q[f"edge_{kind}"] = run
    SQL[f"edge_{kind}"] = f"WITH {_PAIR} SELECT src, round(list_sum(list_transform(z, lambda p: {sql})), 6) AS total FROM pairs"


_edge("average", "(p[1] + p[2]) / 2")
_edge("hadamard", "p[1] * p[2]")
_edge("l1", "abs(p[1] - p[2])")
_edge("l2", "(p[1] - p[2]) * (p[1] - p[2])")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0) SELECT vec_id AS key, round(list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)), 6) AS cosine FROM v, q WHERE vec_id <> 0 ORDER BY cosine DESC, key LIMIT 10")
def cosine_topk(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    return walks.most_similar(v, 0).select("key", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_EDGES}, steps AS (SELECT a.src AS previous, a.dst AS current, b.dst, CASE WHEN b.dst = a.src THEN b.weight / 0.5 WHEN e.src IS NOT NULL THEN b.weight ELSE b.weight / 2.0 END AS w FROM both_ways a JOIN both_ways b ON b.src = a.dst LEFT JOIN both_ways e ON e.src = a.src AND e.dst = b.dst) SELECT previous, current, dst, round(w / sum(w) OVER (PARTITION BY previous, current), 6) AS probability FROM steps")
def transition_probs(s, d):
    return walks.transition_probabilities(supply(s, d), 0.5, 2.0).withColumn("probability", F.round("probability", 6))


@query(f"WITH {_EDGES} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS probability FROM both_ways")
def first_probs(s, d):
    return walks.first_probabilities(supply(s, d)).withColumn("probability", F.round("probability", 6))


_WALK = f"""WITH RECURSIVE {_EDGES}, walk AS (
  SELECT r AS round, src AS node, 1 AS step, CAST(NULL AS VARCHAR) AS previous, src AS current, src AS walk FROM (SELECT DISTINCT src FROM both_ways), range(0, 10) AS t(r)
  UNION ALL
  SELECT round, node, step + 1, current, arg_min(dst, -ln(u) / w), walk || ' ' || arg_min(dst, -ln(u) / w) FROM (
    SELECT k.*, b.dst, (CAST('0x' || substr(md5('3|' || round || '|' || node || '|' || step || '|' || b.dst), 1, 13) AS BIGINT) + 1) / 4503599627370497.0 AS u,
      CASE WHEN b.dst = previous THEN b.weight / 0.5 WHEN e.src IS NOT NULL THEN b.weight ELSE b.weight / 2.0 END AS w
    FROM walk k JOIN both_ways b ON b.src = k.current LEFT JOIN both_ways e ON e.src = k.previous AND e.dst = b.dst WHERE step < 90) GROUP BY round, node, step, previous, current, walk
) SELECT CAST(round AS INTEGER) AS round, node, walk FROM walk WHERE step = 90"""


@query(_WALK)
def random_walks(s, d):
    return walks.walks(supply(s, d), p=0.5, q=2.0, seed=3).withColumn("walk", F.array_join("walk", " "))


@query()
def node_embeddings(s, d):
    model = walks.embed(walks.walks(supply(s, d), seed=3, cumulative=True))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


# ---- URLs ---------------------------------------------------------------------------------------------------------

_CHARS = "chars AS (SELECT page_id, unnest(string_split(url, '')) AS c, generate_subscripts(string_split(url, ''), 1) - 1 AS pos FROM pages), seen AS (SELECT c, min((page_id, pos)) AS f FROM chars WHERE c <> '' GROUP BY c), voc AS (SELECT c, row_number() OVER (ORDER BY f) AS idx FROM seen)"


@query(f"WITH {_CHARS} SELECT c AS char, CAST(idx AS INTEGER) AS idx FROM voc")
def url_vocab(s, d):
    return urls.text_model(table(s, d, "pages"), "page_id").select("char", "idx")


@query(f"WITH {_CHARS} SELECT page_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) FILTER (pos < 40) || repeat(' 0', greatest(40 - count(*), 0)) AS vector FROM chars JOIN voc USING (c) GROUP BY page_id")
def url_charindex(s, d):
    p = table(s, d, "pages").select("page_id", "url")
    return urls.index_vectors(p, urls.text_model(p, "page_id"), 40).select("page_id", F.array_join("vector", " ").alias("vector"))


@query("WITH g AS (SELECT page_id, unnest(list_transform(range(1, length(url) - 1), lambda i: substr(url, i, 3))) AS gram FROM pages) SELECT page_id, gram, count(*) AS n FROM g GROUP BY ALL")
def url_features(s, d):
    c = urls.characters(table(s, d, "pages").select("page_id", "url"))
    grams = F.transform(F.sequence(F.lit(0), F.size("_chars") - 3), lambda i: F.array_join(F.slice("_chars", i + 1, F.lit(3)), ""))
    return c.filter(F.size("_chars") >= 3).select("page_id", F.explode(grams).alias("gram")).groupBy("page_id", "gram").agg(F.count("*").alias("n"))


@query()
def url_predict(s, d):
    """The label is a toy: whether the host's hash is odd."""
    p = table(s, d, "pages").select("page_id", "url", (F.pmod(F.xxhash64(F.parse_url("url", F.lit("HOST"))), F.lit(2)) == 1).cast("int").alias("label"))
    model, _ = urls.train(p)
    return urls.classify(model, p.select("page_id", "url"))


@query()
def url_bilstm(s, d):
    """The label is a toy: whether the URL has a query."""
    p = table(s, d, "pages").select("page_id", "url", F.contains("url", F.lit("?")).cast("int").alias("label"))
    model, _ = urls.train_bilstm(p)
    return urls.classify(model, p.select("page_id", "url"))


# ---- rules --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license') OR contains(lower(text), 'mit license')")
def rule_keywords(s, d):
    rule = {"title": "license", "detection": {"keywords": ["apache license", "MIT License"], "condition": "keywords"}}
    return table(s, d, "documents").filter(rules.compile_rule(rule, ["text"])).select("doc_id")


@query("SELECT event_id FROM events WHERE (event_type = 'error' OR starts_with(event_type, 'pur')) AND NOT (contains(props, '7') OR user_id = 5)")
def rule_boolean(s, d):
    rule = {"detection": {"a": {"event_type": "ERROR"}, "b": {"event_type|startswith": "pur"}, "f_props": {"props|contains": "7"}, "f_user": {"user_id": 5}, "condition": "(a or b) and not 1 of f_*"}}
    return table(s, d, "events").filter(rules.compile_rule(rule, ["props"])).select("event_id")


@query("SELECT g.user_id AS actor, g.ts AS success_at, count(*) AS n_failures, count(DISTINCT b.event_id % 11) AS n_subjects FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') g JOIN events b ON b.user_id = g.user_id AND b.event_type IN ('error', 'view') AND b.ts < g.ts AND b.ts >= g.ts - INTERVAL 900 MINUTE GROUP BY ALL HAVING count(DISTINCT b.event_id % 11) >= 2")
def bruteforce_window(s, d):
    e = table(s, d, "events").withColumn("subject", F.col("event_id") % 11)
    out = rules.brute_force(e, "ts", "user_id", "subject", F.col("event_type").isin("error", "view"), F.col("event_type") == "purchase", least=2, minutes=900)
    return out.withColumn("success_at", F.col("success_at").cast("timestamp_ntz"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2")
def rule_threshold(s, d):
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rules.threshold(e, "at", ["user_id"], F.col("event_type") == "error", 2, "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN ('src0', 'src1')")
def rule_allow_list(s, d):
    allowed = s.createDataFrame([("src0",), ("src1",)], "source string")
    return rules.not_listed(table(s, d, "documents").select("source").distinct(), allowed, "source")


# ---- tokens of lines, parameters and lookups ----------------------------------------------------------------------

_TEMPLATE = ["user", "*", "did", "view"]


def _short_lines(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", "event_type", F.array(F.lit("user"), F.col("user_id").cast("string"), F.lit("did"), "event_type").alias("toks")).withColumn("t", F.array(*map(F.lit, _TEMPLATE)))


@query("SELECT event_id, 2 + CAST(event_type = 'view' AS INTEGER) AS n FROM events")
def greedy_matches(s, d):
    return _short_lines(s, d).select("event_id", A.matched(F.col("t"), F.col("toks")).alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'view'")
def template_fits(s, d):
    return _short_lines(s, d).filter(A.fits(F.col("t"), F.col("toks"))).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN '1,2' ELSE '1' END AS places FROM events")
def wildcard_positions(s, d):
    t = F.array(F.lit("user"), F.lit("*"), F.when(F.col("event_type") == "view", "*").otherwise("did"), "event_type")
    return _short_lines(s, d).select("event_id", F.array_join(A.wildcards(t), ",").alias("places"))


@query("SELECT event_id, 6 + length(CAST(user_id AS VARCHAR)) AS third, CAST(NULL AS INTEGER) AS fifth FROM events")
def token_char_start(s, d):
    return _short_lines(s, d).select("event_id", S.char_start(F.col("toks"), F.lit(2)).cast("long").alias("third"), S.char_start(F.col("toks"), F.lit(4)).alias("fifth"))


@query("SELECT event_id, 3 AS at_type FROM events")
def token_of_offset(s, d):
    line = F.concat(F.array_join("toks", " "), F.lit(" x"))
    return _short_lines(s, d).withColumn("line", line).select("event_id", S.token_index(F.col("line"), F.length(F.array_join(F.slice("toks", 1, 3), " ")) + 1).alias("at_type"))


_KINDS = "CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'user' WHEN 'error' THEN 'password' ELSE 'ip_address' END"


def _params(s, d) -> DataFrame:
    """A log for each user, whose parameters are the events in order."""
    kind = F.when(F.col("event_type").isin("view", "click"), "user").when(F.col("event_type") == "error", "password").otherwise("ip_address")
    at = F.lit(0)
    p = F.struct("event_id", kind.alias("entity"), F.concat(F.lit("v"), F.col("event_id") % 50).alias("value"), at.alias("char_start"), at.alias("char_end"), at.alias("token_start"))
    return table(s, d, "events").groupBy(F.col("user_id").alias("log_id")).agg(F.array_sort(F.collect_list(p)).alias("params"))


@query(f"WITH r AS (SELECT user_id AS log_id, event_id, {_KINDS} AS entity, 'v' || (event_id % 50) AS value FROM events), u AS (SELECT *, sum(CAST(entity = 'user' AS INTEGER)) OVER (PARTITION BY log_id ORDER BY event_id) AS u FROM r), h AS (SELECT log_id, u, arg_max(value, event_id) AS password FROM u WHERE entity = 'password' GROUP BY ALL) SELECT u.log_id, entity, value, CASE WHEN entity = 'user' THEN password END AS password FROM u LEFT JOIN h ON h.log_id = u.log_id AND h.u = u.u WHERE entity <> 'password'")
def user_passwords(s, d):
    return graph.params_of(_params(s, d), ["log_id"]).select("log_id", "entity", "value", "password")


@query(f"SELECT 'v' || (event_id % 50) AS value, string_agg(CAST(user_id AS VARCHAR), '>' ORDER BY user_id, event_id) AS events FROM events WHERE {_KINDS} = 'ip_address' GROUP BY 1")
def entity_sequences(s, d):
    logs = _params(s, d).withColumn("seq", F.col("log_id"))
    return sequences.entity_sequences(logs, "seq", event="log_id").withColumn("events", F.array_join("events", ">"))


@query("SELECT page_id, url, CAST(page_id % 3 = 0 AS BOOLEAN) AS warned FROM pages")
def url_params_enriched(s, d):
    p = table(s, d, "pages")
    parsed = p.select("page_id", F.array(F.struct(F.lit("url").alias("entity"), F.concat(F.col("page_id").cast("string"), F.lit("|"), "url").alias("value")), F.struct(F.lit("number").alias("entity"), F.lit("1").alias("value"))).alias("params"))
    scored = p.select(F.concat(F.col("page_id").cast("string"), F.lit("|"), "url").alias("url"), (F.col("page_id") % 3 == 0).alias("malicious_warning"))
    out = urls.enrich_params(parsed, scored, "page_id").filter(F.get("params", F.lit(1))["meta"].isNull())
    first = F.get("params", F.lit(0))
    return out.select("page_id", F.substring_index(first["value"], "|", -1).alias("url"), first["meta"]["malicious_warning"].alias("warned"))


@query("SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS value FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)")
def blacklist_lookup(s, d):
    bad = table(s, d, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").cast("string").alias("value"))
    return rules.listed(table(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("value")), bad, "value").select("event_id", "value")


@query(f"WITH {_EDGES} SELECT DISTINCT a.dst AS src, b.dst AS dst FROM both_ways a JOIN both_ways b ON a.src = b.src AND a.dst < b.dst WHERE NOT EXISTS (SELECT 1 FROM both_ways e WHERE e.src = a.dst AND e.dst = b.dst)")
def link_candidates(s, d):
    return links.candidates(supply(s, d).select("src", "dst"))


@query(f"WITH {_EDGES} SELECT DISTINCT least(src, dst) || '|' || greatest(src, dst) AS edge FROM both_ways")
def edge_tokens(s, d):
    return supply(s, d).select(S.edge_token(F.col("src"), F.col("dst")).alias("edge")).distinct()


@query("SELECT CAST(s_suppkey AS VARCHAR) AS dst FROM supplier WHERE s_nationkey = 3")
def edges_of_vertex(s, d):
    e = table(s, d, "supplier").select(F.lit("supplies").alias("collection"), F.col("s_nationkey").cast("string").alias("src"), F.col("s_suppkey").cast("string").alias("dst"))
    return readers.edges_of(e, "supplies", "3").select("dst")


# ---- sources that other queries do not read through ----------------------------------------------------------------


@query(f"WITH {_LINES} SELECT md5('search|' || doc_id || '|0|' || line_no || '|' || line) AS id, 'search' AS source_collection, line, 0 AS n_metadata FROM lines WHERE line <> ''")
def search_hit_lines(s, d):
    hits = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body")).select(F.col("doc_id").alias("id"), F.array(F.struct("body")).alias("results"))
    return readers.search_hits(hits).withColumn("n_metadata", F.size("metadata")).drop("metadata")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS action, event_type = 'error' AS rejected FROM events")
def logformat_rejects(s, d):
    line = F.concat(F.when(F.col("event_type") == "error", "no colon ").otherwise("who: "), F.col("event_type"))
    e = table(s, d, "events").select("event_id", line.alias("line"))
    return readers.format_columns(e, "<actor>: <action>", drop=False).drop("line", "actor")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("WITH t AS (SELECT toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT CASE WHEN r <= floor(n * 0.5) THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (toxic = 1) AS positive, count(*) FILTER (toxic <> 1) AS negative FROM t GROUP BY 1")
def split_statistics(s, d):
    parts = sequences.split_by_class(table(s, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 0.5)
    return sequences.split_statistics(parts, "toxic")


# ---- parse and stream ---------------------------------------------------------------------------------------------


def _raw(s, d) -> DataFrame:
    e = event_lines(s, d)
    return e.select(F.col("event_id").cast("string").alias("id"), F.lit("events").alias("source_collection"), F.col("line"), F.expr(readers.NO_META).alias("metadata"), F.col("event_id").alias("seq"))


def _param(start: str, value: str, token: int, entity: str, before: str = "", after: str = "") -> str:
    """SQL of a parameter as JSON; start and value are SQL."""
    beside = "".join(f',"{k}":"{v}"' for k, v in (("prev_token", before), ("next_token", after)) if v)
    return f"""'{{"char_start":' || ({start}) || ',"char_end":' || ({start} + length({value})) || ',"token_start":{token},"token_end":{token + 1},"entity":"{entity}","value":"' || {value} || '"{beside}}}'"""


_N, _V = "CAST(user_id AS VARCHAR)", "printf('%.2f', value)"
_PARSED = f"""WITH r AS (SELECT *, {_SHAPES.format(value=_V)} AS line, CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE event_type END AS shape FROM events),
f AS (SELECT shape, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS event_ord FROM r GROUP BY shape),
w AS (SELECT *, min(event_type) OVER (PARTITION BY shape ORDER BY event_id) <> max(event_type) OVER (PARTITION BY shape ORDER BY event_id) AS types, min(user_id) OVER (PARTITION BY shape ORDER BY event_id) <> max(user_id) OVER (PARTITION BY shape ORDER BY event_id) AS users FROM r JOIN f USING (shape)),
k AS (SELECT *, CASE shape WHEN 'error' THEN 'connection from host <NUMBER> lost' WHEN 'purchase' THEN 'paid <VERSION> to account <NUMBER> with thanks' WHEN 'signup' THEN 'new member ' || CASE WHEN users THEN '*' ELSE {_N} END ELSE 'user <NUMBER> did ' || CASE WHEN types THEN '*' ELSE event_type END || ' for <VERSION> in usual mode' END AS log_key FROM w)
SELECT md5('events|' || event_id || '|' || event_id || '|' || line) AS log_id, line AS message, log_key, event_ord, substr(md5(log_key), 1, 8) AS event_id, '[' || CASE shape
  WHEN 'error' THEN {_param("21", _N, 3, "number")}
  WHEN 'purchase' THEN {_param("5", _V, 1, "version")} || ',' || {_param(f"17 + length({_V})", _N, 4, "number")}
  WHEN 'signup' THEN CASE WHEN users THEN {_param("11", _N, 2, "unnamed", "member")} ELSE '' END
  ELSE {_param("5", _N, 1, "number")} || CASE WHEN types THEN ',' || {_param(f"10 + length({_N})", "event_type", 3, "unnamed", "did", "for")} ELSE '' END || ',' || {_param(f"15 + length({_N}) + length(event_type)", _V, 5, "version")} END || ']' AS params FROM k"""


@query(_PARSED)
def parsed_logs(s, d):
    return parse.parse(_raw(s, d), "seq").select("log_id", "message", "log_key", "event_ord", "event_id", F.to_json("params").alias("params"))


@query("SELECT event_id, 'user ' || CASE WHEN min(user_id) OVER w = max(user_id) OVER w THEN CAST(user_id AS VARCHAR) ELSE '*' END || ' did ' || CASE WHEN min(event_type) OVER w = max(event_type) OVER w THEN event_type ELSE '*' END AS template_then, 0 AS event_ord, event_id = min(event_id) OVER w AS is_new FROM events WINDOW w AS (ORDER BY event_id)")
def stream_templates(s, d):
    """Mining as a stream over a table's files; the sink is a table of the shared folder."""
    e = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    lines_ = e.select("event_id", F.concat_ws(" ", F.lit("user"), "user_id", F.lit("did"), "event_type").alias("line")).withColumn("tokens", S.tokens(F.col("line")))
    mined = streams.mine_stream(lines_, "event_id", "tokens")
    folder = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    q = mined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(mined.schema).parquet(f"{folder}/out").select("event_id", "template_then", "event_ord", "is_new")
