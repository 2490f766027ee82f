"""The corpus operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing names."""
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sparkloom.llm import chat, isomedia, langid, license, linededup, mixing, packing, simhash, sketch, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size int, _id int"
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "sa") for b in ("ba", "no", "pe", "si", "zu", "É")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near(rng, text, k=1):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 400)
    passage = prose(rng, 60)
    texts = [None, "", "   \t\n ", "a", "one two", "Line of text here\nLine of text here\nunlike", base, base, base, "1234 !!"]
    texts += [near(rng, base) for _ in range(12)]
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 25) for _ in range(4)]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(30)]
    texts += [prose(rng, 6000), "Released under the MIT License.\n the mit   LICENSE, apache-license; GNU General Public License version 3"]
    texts += ["  line OF text HERE \n" + prose(rng, 20), "x" * 3000, "é" * 9 + "\n" + "é" * 10, "é" * 9 + "\n" + "É" * 10 + "\n" + "é" * 10]
    rows = [(i * 3, t, ["en", "fr", None][i % 3], [None, "b", "a", "src"][min(i % 7, 3)], None, "clash", 9, i) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id here at all", "en", "a", 4, None, None, None), (None, base, None, None, 1, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    got = Counter(map(tuple, df.collect()))
    assert got == Counter(expected)


@pytest.mark.parametrize(
    "report",
    [simhash.simhash_components, suffix.repeated_passages, langid.language_report, sketch.sketch_report, isomedia.media_report, license.license_report, linededup.line_report, packing.pack, mixing.mix_report, simhash.one_of_each, linededup.without_repeats, mixing.mix, langid.accepted],
)
def test_empty_table(none, report):
    assert report(none).collect() == []


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_matches_all_pairs(docs, rows):
    ids, prints = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    expected = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints))]
    same(simhash.simhash_components(docs), expected)


def test_simhash_spark_hash_is_the_same(spark):
    h = spark.sql("select xxhash64('ka lo mi')").first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"ka lo mi", 42)


@pytest.mark.parametrize("dealt", [1 << 17, 20])
def test_simhash_links_of_random_balls(spark, monkeypatch, dealt):
    monkeypatch.setattr(simhash, "DEALT", dealt)
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        prints.add(c)
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            prints.add(x)
    prints |= {0, 1, (1 << 64) - 1, 1 << 63, 7, 15}
    prints = sorted(prints)
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.classes(rows).collect()}
    expected = brute_components(list(range(len(prints))), prints)
    assert [got[p] for p in prints] == expected
    assert len(set(expected)) > 20


def test_simhash_stage_keeps_one_of_each(docs, rows):
    ids, prints = [r[0] for r in rows if r[0] is not None], [brute_fingerprint(r[1]) for r in rows if r[0] is not None]
    keep = {i for i, c in zip(ids, brute_components(ids, prints)) if i == c}
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({None: 2} | dict.fromkeys(keep, 1))


def test_chat_links_orders_and_validates(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{"z":1,"y":"q"}},{"id":"b","name":"f","arguments":{"y":2,"x":[]}},{"id":"c","name":"g","arguments":{}},{"id":"d","name":"f","arguments":5}]}'
    turns = [
        (1, 0, "system", "hi \"there\"", 0), (1, 1, "assistant", call, 0), (1, 5, "tool", '{"tool_call_id":"a","content":"late"}', 0), (1, 0, "tool", '{"tool_call_id":"b","content":"early"}', 0),
        (1, 2, "tool", '{"tool_call_id":"nobody","content":"x"}', 0), (2, 0, "user", None, 1), (2, 1, "assistant", "two\nlines", 1), (2, 1, "assistant", "again", 1), (2, 3, "assistant", "alone", 1), (2, 4, None, "{broken", 1), (None, None, "user", "", 1),
    ]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, kind int")
    schemas = {"f": {"y": "string", "z": "number?"}, "reply": chat.SCHEMAS["reply"]}
    out = chat.link(chat.parts(t), schemas).collect()
    by = {(r.call_id, r.kind): r for r in out if r.conv_id == 1}
    assert by["a", "call"].valid and by["a", "call"].n_results == 1
    assert by["a", "call"].json == '{"arguments":{"y":"q","z":1},"call_id":"a","conv_id":1,"name":"f","role":"assistant","turn":1}'
    assert by["b", "call"].faults == "extra:x,kind:y" and by["c", "call"].faults == "unknown-tool" and by["d", "call"].faults == "malformed"
    assert by["b", "result"].call_turn == 1 and by["a", "result"].call_turn == 1 and by["nobody", "orphan"].faults == "no-call"
    two = sorted((r.call_turn, r.rank, r.turn, r.kind) for r in out if r.conv_id == 2)
    assert two == [(0, 0, 0, "call"), (0, 2, 1, "result"), (0, 2, 1, "result"), (3, 3, 3, "orphan"), (4, 1, 4, "message")]
    assert len(out) == 4 + 4 + 6
    order = sorted(out, key=lambda r: (r.conv_id or 0, r.call_turn or 0, r.rank, r.turn or 0))
    seen = set()
    for r in order:
        if r.kind == "call":
            seen.add((r.conv_id, r.call_id))
        assert r.kind != "result" or (r.conv_id, r.call_id) in seen
    assert chat.chat_report(t.limit(0)).collect() == []


def brute_covered(rows):
    """Words of documents that lie in a run of 50 words which another document has as well."""
    holders = defaultdict(set)
    for i, t, *_ in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    covered = defaultdict(set)
    for i, t, *_ in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            if len(holders[tuple(w[k : k + 50])]) > 1:
                covered[i].update(range(k, k + 50))
    return covered


def runs(places):
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def brute_partners(rows):
    """For each text, the document that each repeated passage of it links to."""
    holders = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    found = defaultdict(dict)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            h = holders[tuple(w[k : k + 50])]
            if len(h) > 1:
                found[i, t][k] = max(h) if i == min(h) else min(h)
    return found


def brute_passages(rows):
    out = []
    for (i, _), starts in brute_partners([r for r in rows if r[0] is not None]).items():
        for a, z in runs({p for k in starts for p in range(k, k + 50)}):
            out.append((i, a, z, z - a, sorted({x for k, x in starts.items() if a <= k < z})))
    return out


def passages_of(spark, rows, parts=6):
    out = suffix.repeated_passages(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(parts)).collect()
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 0), (3, 2)])
def test_suffix_finds_what_all_windows_find(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "CHUNK", 16)
    rng = random.Random(seed)
    rows = [r[:2] for r in corpus(seed)]
    pieces = prose(rng, 500).split()
    rows += [(1000 + i, prose(rng, 40) + " " + " ".join(pieces[a : a + n]) + " " + prose(rng, 40)) for i, (a, n) in enumerate([(0, 50), (0, 50), (10, 200), (150, 300), (400, 100), (20, 49), (300, 51), (5, 48)])]
    rows += [(2000 + i, " ".join(["la"] * n)) for i, n in enumerate((49, 50, 51, 90))] + [(3000, " ".join(pieces[:50])), (3001, " ".join(pieces[-50:]))]
    assert passages_of(spark, rows) == sorted(brute_passages(rows))


@pytest.mark.parametrize("hot", [1000, 20])
def test_suffix_many_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(9)
    base = prose(rng, 120)
    rows = [(i, base if i % 2 else near(rng, base, 2)) for i in range(200)] + [(500 + i, prose(rng, 100)) for i in range(20)]
    assert passages_of(spark, rows, 7) == sorted(brute_passages(rows))


def test_suffix_texts_of_one_doc_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b c d e f g {passage}"), (1, f"x y z {passage} end"), (1, f"one {passage}"), (2, passage), (2, passage), (3, "short"), (None, passage)]
    assert passages_of(spark, rows) == [(1, 1, 61, 60, [2]), (1, 3, 63, 60, [2]), (1, 7, 67, 60, [2]), (2, 0, 60, 60, [1])]
    assert passages_of(spark, [(1, passage), (1, passage), (1, f"x {passage}")]) == []


def linked(pairs):
    """The classes that the pairs connect."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    out = defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("hot", [1000, 20])
def test_suffix_partners_connect_all_holders(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(12)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(120)]
    out = passages_of(spark, rows)
    assert linked((i, x) for i, _, _, _, other in out for x in other) == [list(range(120))]


def test_suffix_runs_name_all_partners(spark):
    passage = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    held = {50: "abc", 10: "a", 20: "dbe", 30: "c", 5: "d", 90: "e"}
    rows = [(i, " ".join(passage[k] for k in ks)) for i, ks in held.items()]
    assert {(i, a, z): other for i, a, z, _, other in passages_of(spark, rows)} == {
        (50, 0, 180): [10, 20, 30], (20, 0, 180): [5, 50, 90], (10, 0, 60): [50], (30, 0, 60): [50], (5, 0, 60): [20], (90, 0, 60): [20],
    }


def test_language_model_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.language_report(d).join(d, "doc_id").collect()
    assert {r.held_out for r in out} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in out) / len(out) < 0.01


def test_language_edges(docs, rows):
    out = langid.language_report(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.lang_pred == "und") == (r.score == 0.0) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (0, 3, 6, 27)] == ["und"] * 4 and by[9].lang_pred in ("en", "fr")
    assert langid.fit([]).predict("text") == ("und", 0.0, True)
    assert langid.features("abcabc x", 3)[0].size == 3 and abs(langid.features("abcabc x", 3)[1].sum() - 1) < 1e-6
    assert not langid.has_letter("\u00bd 12 _ \u00b2") and langid.has_letter("\u00bd \u00e9")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {0, 3, 6, 27}.isdisjoint(r.doc_id for r in kept.collect())


def brute_subwords(text):
    """The pieces of 2 to 4 bytes of each lower-cased word with its edges, by name."""
    out = []
    line = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())
    for w in line.split():
        padded = b" " + w + b" "
        out += [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]
    return out


def brute_bucket(piece):
    h = 0
    for c in piece:
        h = (h * 257 + c) % 2**32
    h = (h + len(piece)) * 2654435761 % 2**32
    return (h ^ h >> 15) * 2246822519 % 2**32 >> 18


@pytest.mark.parametrize("text", ["a", "The quick: 12 brown  fox", "École n'est pas\tfini", "日本 x"])
def test_language_subwords_by_hand(text):
    want = Counter(brute_bucket(p) for p in brute_subwords(text))
    ids, share = langid.features(text)
    assert {int(i): round(float(x) * sum(want.values())) for i, x in zip(ids, share)} == want


def test_language_step_by_hand():
    rng = np.random.default_rng(3)
    e, w, bias = rng.normal(size=(6, 2)), rng.normal(size=(2, 3)), rng.normal(size=3)
    ids, share, label, rate = np.array([1, 4]), np.array([0.25, 0.75]), 2, 0.3
    h = [sum(share[k] * e[i][d] for k, i in enumerate(ids)) for d in range(2)]
    z = [sum(h[d] * w[d][c] for d in range(2)) + bias[c] for c in range(3)]
    total = sum(np.exp(x) for x in z)
    g = [np.exp(z[c]) / total - (c == label) for c in range(3)]
    back = [sum(w[d][c] * g[c] for c in range(3)) for d in range(2)]
    e2 = [[e[i][d] - (rate * share[list(ids).index(i)] / 0.75 * back[d] if i in ids else 0) for d in range(2)] for i in range(6)]
    w2 = [[w[d][c] - rate * h[d] * g[c] for c in range(3)] for d in range(2)]
    b2 = [bias[c] - rate * g[c] for c in range(3)]
    langid.step(e, w, bias, ids, share, label, rate)
    assert np.allclose(e, e2) and np.allclose(w, w2) and np.allclose(bias, b2)
    model = langid.Model(["x", "y", "z"], np.zeros((langid.BUCKETS, 3)), np.array([0.0, 1.0, 0.0]), 1.0, 0.9)
    assert model.predict("word")[0] == "y" and model.predict("word")[2] and abs(model.predict("word")[1] - np.e / (np.e + 2)) < 1e-12


def test_language_learns_every_label(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 300)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k * 26 + i, " ".join([alphabet[i] + alphabet[(i + 3) % 26] + alphabet[(i * 7) % 26]] * 9), f"l{i}") for i in range(26) for k in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 26


def test_sketch_of_text_and_edited_text(docs, rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    after = dict(zip(ids, ids[1:] + ids[:1]))
    text = {r[0]: r[1] or "" for r in sorted(rows, key=lambda r: r[1] or "", reverse=True)}
    out = sketch.sketch_report(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            continue
        t = text[r.doc_id]
        q = len(t) // 4
        edited = t[: len(t) - q] + text[after[r.doc_id]][:q]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in out}
    assert by[18].fingerprint == by[21].fingerprint != "" and by[18].near_next == 1.0
    assert by[0].fingerprint == by[3].fingerprint == ""


def test_sketch_is_the_scaled_hash_set(spark):
    def h(*x):
        return spark.sql(f"select xxhash64({', '.join(x)})").first()[0]

    rng = random.Random(3)
    a = prose(rng, 300)
    t = spark.createDataFrame([(a,), ("ka lo",), (None,)], "text string")
    got = [r.s for r in sketch.with_sketch(t, "text", "s").select("s").collect()]
    words = a.split()
    hashes = {w: h(f"'{w}'") for w in set(words)}
    lists = spark.createDataFrame([tuple(hashes[x] for x in words[i : i + 5]) for i in range(296)], "a long, b long, c long, d long, e long").selectExpr("xxhash64(a, b, c, d, e) h").collect()
    low = sorted({r.h for r in lists if r.h < -(1 << 63) + (1 << 61)})
    assert got[0] == (low if len(low) >= sketch.LEAST else sorted({r.h for r in lists})[: sketch.LEAST])
    assert len(got[1]) == 1 and not got[2]


def test_sketch_plain_threshold(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (3, 40, 600)]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    both = sketch.with_sketch(sketch.with_sketch(t, "text", "s", 8, 0), "text", "all", 1, 0).collect()
    for r in both:
        assert r.s == [h for h in r["all"] if h <= sketch.limit(8)] and r["all"] == sorted(set(r["all"]))
    pair = spark.createDataFrame([(sorted(both[1].s), sorted(both[2].s))], "a array<long>, b array<long>")
    r = sketch.with_likeness(pair, "a", "b", "it", 8, 0).first()
    assert r.near_it == len(set(both[1].s) & set(both[2].s)) / min(len(both[1].s), len(both[2].s))


def test_sketch_repeated_ids_with_one_head(spark):
    a, b = "abcd efgh ij kl mn op", "abcd efgh qr st uv wx"
    t = lambda order: spark.createDataFrame([(1, "abcdefgh " * 2), *[(2, x) for x in order]], "doc_id long, text string")
    one, two = (sorted(map(tuple, sketch.sketch_report(t(x)).collect())) for x in ([a, b], [b, a]))
    assert one == two and len(one) == 3


def test_sketch_estimates_likeness(spark):
    rng = random.Random(6)
    rows = []
    for n in (12, 40, 100, 400, 3000):
        for share in (0.25, 0.5, 0.9):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            k = int(n * share)
            rows.append((n, share, " ".join(words), " ".join(words[:k] + [f"v{rng.randrange(10**6)}" for _ in range(n - k)])))
    t = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame(rows, "n int, share double, x string, y string"), "x", "a"), "y", "b")
    for r in sketch.with_likeness(t, "a", "b", "it").collect():
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (r.x.split(), r.y.split())]
        true = len(grams[0] & grams[1]) / len(grams[0])
        assert abs(r.near_it - true) < (1e-9 if r.n <= 36 else 0.3)
        assert abs(r.jaccard_it - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < (1e-9 if r.n <= 36 else 0.3)


def test_media_round_trip(docs, rows):
    text = {(r[0], r[1]) for r in rows}
    out = isomedia.media_report(docs).collect()
    assert len(out) == len(rows)
    one = {i: (t or "").encode() for i, t in text if i is not None}
    for r in out:
        if r.doc_id is None:
            continue
        b = one[r.doc_id]
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        media = isomedia.wrap(p)
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()


def test_media_walks_boxes(spark):
    payload = bytes(range(256)) * 90
    media = isomedia.wrap(payload, 576)
    (track,) = isomedia.inspect(media)
    assert b"".join(media[a : a + n] for a, n in track["samples"]) == payload
    assert track["codec"] == "raw " and track["duration"] == len(payload) and len(track["keyframes"]) == 5
    assert track["times"] == list(range(0, len(payload), 576))
    free = struct.pack(">I4s", 8, b"free")
    moved = free + media
    assert isomedia.inspect(moved)[0]["samples"] == track["samples"]
    kinds = [k for k, _, _ in isomedia.boxes(media)]
    assert kinds == [b"ftyp", b"moov", b"mdat"]
    files = spark.createDataFrame([(1, media, "x"), (2, media[:300], "x"), (3, None, "x"), (4, b"", "x"), (5, free, "x")], "id int, media binary, row string")
    out = {r.id: r for r in isomedia.media_columns(files).collect()}
    (one,) = out[1].tracks
    assert one.n_samples == 40 and one.keyframes[1].size == 576 and one.keyframes[1].time == 8 * 576 and out[1].error is None and out[1].row == "x"
    assert out[2].error and out[2].tracks is None and all(out[i].error == "no track" and out[i].tracks == [] for i in (3, 4, 5))
    assert isomedia.media_columns(files.limit(0)).collect() == []


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def ints(*x):
    return struct.pack(f">{len(x)}I", *x)


def test_media_tables_that_claim_too_much(spark):
    media = isomedia.wrap(bytes(576 * 8))
    at = media.index(b"stsz") + 8
    bad = [media[:at] + ints(size, n) + media[at + 8 :] for size, n in ((576, 2**32 - 1), (1, 2**32 - 1), (0, 2**32 - 1), (576, 9))]
    at = media.index(b"stts") + 8
    bad += [media[:at] + ints(1, 2**32 - 1, 576) + media[at + 12 :], media[:at] + ints(2**32 - 1) + media[at + 4 :], media[:at] + ints(1, 7, 576) + media[at + 12 :]]
    at = media.index(b"stsc") + 8
    bad += [media[:at] + ints(1, 2**32 - 1) + media[at + 8 :], media[:at] + ints(1, 5) + media[at + 8 :]]
    for data in bad:
        with pytest.raises(isomedia.BadMedia):
            isomedia.inspect(data)
    deep = b""
    for _ in range(200):
        deep = box(b"moov", deep)
    out = isomedia.media_columns(spark.createDataFrame([(i, x) for i, x in enumerate([*bad, deep, media])], "i int, media binary")).collect()
    assert all(r.error for r in out if r.i < len(bad) + 1) and [r.error for r in out if r.i == len(bad) + 1] == [None]


def two_tracks():
    """A movie of two tracks whose samples are all in fragments."""
    def track(number, handler, codec):
        stbl = box(b"stbl", box(b"stsd", ints(0, 1), box(codec, bytes(8))), box(b"stts", ints(0, 0)), box(b"stsc", ints(0, 0)), box(b"stsz", ints(0, 0, 0)), box(b"stco", ints(0, 0)))
        return box(b"trak", box(b"tkhd", ints(0, 0, 0, number, 0, 0)), box(b"mdia", box(b"mdhd", ints(0, 0, 0, 1000 * number, 0, 0)), box(b"hdlr", ints(0, 0), handler, bytes(13)), box(b"minf", stbl)))

    trex = lambda n, *x: box(b"trex", ints(0, n, 1, *x))
    head = box(b"ftyp", b"isom", ints(0)) + box(b"moov", track(1, b"vide", b"avc1"), track(2, b"soun", b"mp4a"), box(b"mvex", trex(1, 40, 0, 0x10000), trex(2, 20, 7, 0)))

    def moof(base, a, b):
        """a: sizes of the first track, the first a keyframe; b: how many samples of the second."""
        def whole(offset):
            one = box(b"traf", box(b"tfhd", ints(0x20000, 1)), box(b"tfdt", struct.pack(">IQ", 1 << 24, base)), box(b"trun", ints(0x205, len(a), offset, 0, *a)))
            two = box(b"traf", box(b"tfhd", ints(0x20000, 2)), box(b"trun", ints(0x101, b, offset + sum(a), *[20 + k for k in range(b)])))
            return box(b"moof", one, two)

        return whole(len(whole(0)) + 8)

    payloads = [bytes([k]) * (sum(a) + 7 * b) for k, (a, b) in enumerate([((5, 6, 7), 2), ((9,), 3)])]
    return head + moof(100, (5, 6, 7), 2) + box(b"mdat", payloads[0]) + moof(220, (9,), 3) + box(b"mdat", payloads[1])


def test_media_fragments(spark):
    data = two_tracks()
    video, sound = isomedia.inspect(data)
    one, two = data.index(b"mdat") + 4, data.rindex(b"mdat") + 4
    assert video["samples"] == [(one, 5), (one + 5, 6), (one + 11, 7), (two, 9)] and video["keyframes"] == [0, 3]
    assert video["times"] == [100, 140, 180, 220] and video["duration"] == 260 and video["codec"] == "avc1"
    assert sound["samples"] == [(one + 18, 7), (one + 25, 7), (two + 9, 7), (two + 16, 7), (two + 23, 7)] and sound["keyframes"] == [0, 1, 2, 3, 4]
    assert sound["times"] == [0, 20, 41, 61, 82] and sound["handler"] == "soun" and sound["timescale"] == 2000
    (r,) = isomedia.media_columns(spark.createDataFrame([(data,)], "media binary")).collect()
    assert [(t.track_id, t.n_samples, len(t.keyframes)) for t in r.tracks] == [(1, 4, 2), (2, 5, 5)] and r.error is None
    at = data.index(b"trun") + 8
    for broken in (data[:-1], data[:at] + ints(2**32 - 1) + data[at + 4 :], data[: data.index(b"tfhd") + 8] + ints(9) + data[data.index(b"tfhd") + 12 :]):
        with pytest.raises(isomedia.BadMedia):
            isomedia.inspect(broken)


def test_media_compact_and_narrow_tables():
    data = box(b"stz2", b"\0\0\0\0\0\0\0\4", struct.pack(">I", 3), bytes([0x21, 0x30])) + box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 3, 1)) + box(b"stco", struct.pack(">III", 0, 1, 4))
    table = {k: (a, b) for k, a, b in isomedia.boxes(data)}
    assert isomedia.sample_ranges(data, table) == [(4, 2), (6, 1), (7, 3)]


def brute_license(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    places = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_license_base_places(docs, rows):
    expected = []
    for r in rows:
        n, places = brute_license(r[1])
        at = [p for p, _ in places]
        expected.append((r[0], n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    out = license.license_report(docs)
    same(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), expected)
    full = next(r for r in out.collect() if r.base_labels == "apache,gpl,mit")
    assert full.n_base == 4 and {"apache", "gpl", "gpl-3.0", "mit", "mit-release"} == set(full.labels.split(",")) and full.score == 1.0


def test_license_random_phrases():
    rng = random.Random(2)
    index = license.Index(license.templates(), 10, {b"license": 9, b"mit": 3})
    for _ in range(300):
        text = " ".join(rng.choice(["mit", "license", "apache", "general", "public", "x"]) for _ in range(30))
        n, places = brute_license(text)
        assert sorted(index.scan(license.words(text.encode()))[1]) == sorted(places)


MIT = """Copyright (c) 2020 A. N. Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
CC0 = "To the extent possible under law, {} has waived all copyright and related or neighboring rights to this work."
ISC = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted, provided"
BSD = "Redistribution and use in source and binary forms, with or without modification, {}are permitted provided that the following conditions are met:"


@pytest.mark.parametrize(
    "label,text",
    [
        ("mit-text", MIT), ("mit-text", MIT.replace('(the "Software"), ', "")), ("cc0", CC0.format("the author")), ("cc0", CC0.format("Ada")), ("cc0", CC0.format("the Open Foundation of Somewhere and all others")),
        ("isc", ISC.format("and/or")), ("isc", ISC.format("and")), ("bsd", BSD.format("")), ("bsd", BSD.format("of any kind, ")),
        ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
        ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by", "licensed under the terms of a Creative Commons Attribution 4.0 International License"),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("unlicense", "This is free and unencumbered software released into the public domain."),
        ("gpl-notice", "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation"),
    ],
)
def test_license_real_wording(label, text):
    index = license.Index(license.templates(), 10, {b"license": 9, b"the": 9})
    assert label in index.scan(license.words(text.encode()))[0]


def test_license_real_wording_of_others():
    index = license.Index(license.templates(), 10, {b"license": 9, b"the": 9})
    for text in ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify"):
        assert {"cc-by", "mit-text"}.isdisjoint(index.scan(license.words(text.encode()))[0])


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))
    top = (1 << 63) - 1
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(top if i is None else i)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == (top if i is None else i)]
        yield i, t, lines, kept


@pytest.mark.parametrize("small", [False, True])
def test_lines_against_brute_force(docs, rows, monkeypatch, small):
    if small:  # many segments, in rounds, and tasks of several chunks
        for name, value in (("SEGMENT_BITS", 64), ("ROUND_BYTES", 40), ("CHUNK", 5), ("BITS", 2)):
            monkeypatch.setattr(linededup, name, value)
    expected = [(i, len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for i, _, a, b in brute_lines(rows)]
    same(linededup.line_report(docs), expected)


@pytest.mark.parametrize("segments", [3, 4096])
def test_lines_filters_grow_with_the_lines(spark, monkeypatch, segments):
    """Whatever the size: nearly no line that stands once is suspected, and every one that stands twice is."""
    monkeypatch.setattr(linededup, "SEGMENT_BITS", 1 << 10)
    monkeypatch.setattr(linededup, "SEGMENTS", segments)
    n = 60_000
    rows = spark.range(n).selectExpr("id as doc_id", f"concat('a line of its own ', id, '\nline of two documents ', id % {n // 2}) as text", "id % 7 as k").filter(f"doc_id < {n // 2} or doc_id % 10 = 0")
    keyed = linededup._keyed(rows)
    lines = linededup.line_table(keyed)
    found = linededup.suspects(lines)
    twice = rows.selectExpr("explode(split(text, '\n')) as x").groupBy("x").count().filter("count > 1").selectExpr("sum(count)").first()[0]
    assert lines.count() > 50 * (1 << 10) and found.dropDuplicates().count() == found.count()
    assert twice <= found.count() <= twice + 0.01 * (lines.count() - twice)


def test_lines_of_rows_without_id(spark):
    texts = [f"a line that is the same\nand one that is not {i}" for i in range(40)]
    rows = [(None, t) for t in texts] + [(7, texts[0]), (7, texts[1]), (7, texts[1])]
    expected = [(i, len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for i, _, a, b in brute_lines(rows)]
    same(linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), expected)


def test_lines_stage(docs, rows):
    out = linededup.without_repeats(docs)
    assert out.columns == docs.columns
    expected = [(i, None if t is None else "\n".join(b)) for i, t, a, b in brute_lines(rows)]
    same(out.select("doc_id", "text"), expected)


def exact_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_pieces(pieces, texts, exact, window=1024):
    """texts: doc_id to list of texts."""
    ids = {i: sorted([[*exact.encode(t or "", add_special_tokens=False).ids, 0] for t in ts]) for i, ts in texts.items()}
    at, spent = defaultdict(list), defaultdict(int)
    for p in pieces:
        at[p.sequence_id].append((p.offset, p.length))
        spent[p.doc_id] += p.length
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(x) for x in ids[p.doc_id])
    assert spent == {i: sum(map(len, x)) for i, x in ids.items()}
    waste = 0
    for found in at.values():
        end = 0
        for a, n in sorted(found):
            assert a == end and n > 0
            end += n
        assert end <= window
        waste += 0 if end & (end - 1) == 0 else window - end
    return waste


def test_packing_covers_every_id(docs, rows):
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    assert check_pieces(packing.pack(docs).collect(), texts, exact_tokenizer()) == 0


def test_packing_fast_encoder_is_exact():
    rng, exact, encode = random.Random(4), exact_tokenizer(), packing.encoder(packing.default_tokenizer())
    alphabet = [chr(i) for i in range(0x250) if i not in range(0x80, 0xA0)] + list(" \n\t.'s0") * 20 + ["<|endoftext|>", "日本", "😀", " "]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def brute_targets(sizes):
    """sizes: source to size. Shares what is above the cap again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        t = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing_budgets(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, mixing.mix_report(docs.repartition(3)).collect(), ), key=str) == sorted(map(tuple, out), key=str)
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(int(want[s] + 1e-9) - taken[s] in (0, 1) for s in sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == Counter({s: n for s, n in taken.items() if n})


def test_mixing_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)
    rng = random.Random(8)
    data = [(i, prose(rng, rng.randrange(0, 9)), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    out = mixing.mix_report(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(0 <= target[s] - taken[s] < 1 + 1e-6 for s in target)
    key = lambda r: hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()
    for s in target:
        extra = [(key(r), r.taken / r.size) for r in out if r.source == s and r.size]
        shares = [x for _, x in sorted(extra)]
        assert shares == sorted(shares, reverse=True)


#: Names that the operators use themselves, in any step.
OWN = "row id part hi lo gone first last n hot_ segment twice fp root component_id k centre key size source_ source_size target epochs rest ranges cut before range block sum extra zero upto s b r lang_pred score rejected held_out chance rate n_lines n_dropped fingerprint _w _h rid at gram".split()


@pytest.mark.parametrize("stage", [langid.accepted, linededup.without_repeats, simhash.one_of_each, mixing.mix])
def test_stages_leave_other_columns_alone(spark, stage):
    rng = random.Random(4)
    texts = [prose(rng, 30), prose(rng, 31), prose(rng, 32) + "\nand a common line", prose(rng, 33) + "\nand a common line", None, ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t or ""), *[f"{c} {i}" for c in OWN]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN))
    plain = stage(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    out = stage(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((r.doc_id, r.text or "") for r in plain) and len(got) > 2
    assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in OWN)


@pytest.mark.parametrize("report", [simhash.simhash_components, suffix.repeated_passages, langid.language_report, sketch.sketch_report, isomedia.media_report, license.license_report, linededup.line_report, packing.pack, mixing.mix_report])
def test_reports_ignore_other_columns(spark, report):
    rng = random.Random(5)
    rows = [(i, prose(rng, 70), "en", "a", *["x"] * len(OWN)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in OWN))
    drop = lambda out: out.drop("sequence_id")
    assert sorted(map(str, drop(report(docs)).collect())) == sorted(map(str, drop(report(docs.select("doc_id", "text", "lang", "source"))).collect()))


def test_simhash_stage_goes_by_rows(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "y"), (2, b, "a"), (3, c, "z"), (3, b, "z"), (3, c, "z"), (4, c, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == sorted([(1, a, "x"), (2, b, "a"), (3, c, "z")])


def test_mixing_blocks_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 3)
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 9)), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == small
    monkeypatch.setattr(mixing, "RANGE", 512)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == small


def test_pipeline_stage_by_stage(spark, docs, rows, tmp_path):
    """run() against brute-force stages, each on what its predecessor kept."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    given = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    given.write.parquet(f"{tmp_path}/documents.parquet")
    now = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    model = langid.train(given)
    now = [r for r in now if not model.predict(r[1])[2]]
    assert 20 < len(now) < len(given.collect())
    kept = {i: "\n".join(b) for i, _, _, b in brute_lines(now)}
    now = [(r[0], kept[r[0]], *r[2:]) for r in now]
    component = brute_components([r[0] for r in now], [brute_fingerprint(r[1]) for r in now])
    now = [r for r, c in zip(now, component) if r[0] == c]
    mixed = [r for r in mixing.mix_report(spark.createDataFrame([(r[0], r[1], r[3]) for r in now], "doc_id long, text string, source string")).collect() if r.taken]
    text, texts = {r[0]: r[1] for r in now}, defaultdict(list)
    for r in mixed:
        texts[r.doc_id] += [text[r.doc_id]] * (r.taken // r.size)
        if r.taken % r.size:
            texts[r.doc_id].append(" ".join(text[r.doc_id].split()[: r.taken % r.size]))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert check_pieces(out, texts, exact_tokenizer()) == 0
