"""Suffix-array dedup with sparse suffix arrays.

A passage of PASSAGE words holds PASSAGE - GRAM + 1 grams of GRAM words; the one with the least hash (the minimiser)
depends on the passage's own words only, so every copy of it selects the same one. Suffixes are retained there alone,
about one in 18 words, and of those only the ones whose first GRAM words another retained suffix has as well.

Each carries, as hashes of words, what follows its gram and what stands before it, as far as a passage that selected
it can reach. Suffixes are sorted by gram and then by what follows; the length that neighbours have in common gives
the intervals of suffixes that agree to the right by so many words, and within an interval those that agree to the
left by the rest of the passage are the copies of that passage. Only comparing each suffix with its two neighbours
would lose passages: among near copies the neighbour that is most alike to the right need not be the one to the left.

A gram that very many suffixes have is not gathered: its suffixes are dealt evenly, and those with equal contexts are
joined to one class with partial sums. Each class gives a hash for every passage that selected it, and equal ones are
joined in turn; what a class finds goes to all its suffixes. Both ways give the same rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import written
from ..operators.skew import skew_join
from .common import pieces, utf8

PASSAGE, GRAM = 50, 16
#: Words of a passage beside its gram.
SPAN = PASSAGE - GRAM
#: Suffixes with one gram that are sorted in one task, and suffixes that a task compares at a time.
HOT, CHUNK = 1000, 1 << 14
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}

_SUFFIXES = "gram long, hot boolean, doc_id long, rid long, at int, least int, most int, right binary, left binary"
_FOUND = "doc_id long, rid long, lo int, hi int, partner long, gram long, least int, most int, right binary, left binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_PASSAGES = "one long, two long, first long, last long, k int, a long, b long"


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64, or more."""
    if len(_powers.get(base, ())) <= n:
        with np.errstate(over="ignore"):
            _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(2 * n, 1 << 16), base, np.uint64))])
    return _powers[base]


class Line:
    """The words of a text, with hashes of runs of them from prefix sums over their bytes."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        self.bytes = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1) - 1
        self.first = np.concatenate([[0], self.ends[:-1] + 1])
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes * _power(_BASE, len(self.bytes))[: len(self.bytes)])])

    def hashes(self, width: int) -> np.ndarray:
        """A 64-bit hash of each run of so many words."""
        with np.errstate(over="ignore"):
            a, b = self.first[: self.n - width + 1], self.ends[width - 1 :]
            h = (self.sums[b] - self.sums[a]) * _power(pow(_BASE, -1, 1 << 64), len(self.bytes))[a]
            h ^= h >> np.uint64(31)
            h *= np.uint64(_MIX[0])
            return h ^ (h >> np.uint64(29))

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """For each passage, the position of its minimiser; the hashes of all grams."""
        h = self.hashes(GRAM)
        least = np.lib.stride_tricks.sliding_window_view(h, SPAN + 1)
        step = 1 << 16
        return np.concatenate([least[i : i + step].argmin(axis=1) + np.arange(i, min(i + step, len(least))) for i in range(0, len(least), step)]), h


def _texts(batches) -> Iterator[tuple[dict, Line]]:
    for b in pieces(batches):
        rows = {n: b.column(n).to_pylist() for n in b.schema.names if n != "text"}
        for k, t in enumerate(utf8(b.column("text"))):
            yield {n: c[k] for n, c in rows.items()}, Line(t)


def retained(d: DataFrame) -> DataFrame:
    """(rid, places array<struct<at,hot>>), written: of each text the minimisers whose gram is repeated, and whether
    more than HOT suffixes have it."""

    def pick(batches):
        for row, line in _texts(batches):
            if line.n >= PASSAGE:
                least, h = line.minimisers()
                at = np.unique(least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["rid"])), pa.array(at.astype(np.int32)), pa.array(h[at].view(np.int64))], ["rid", "at", "gram"])

    picked = written(d.select("rid", "text").mapInArrow(pick, "rid long, at int, gram long"))
    # counted with partial sums, then joined
    again = written(picked.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    places = skew_join(picked, again, ["gram"], "n").groupBy("rid").agg(F.collect_set(F.struct("at", (F.col("n") > HOT).alias("hot"))).alias("places"))  # a text's own
    return written(places, picked, again)


def suffixes(d: DataFrame, places: DataFrame) -> DataFrame:
    """The repeated suffixes of all texts. The passages that start least to most words before `at` have selected it;
    right and left are the hashes of the words behind its gram and, backwards, before it."""

    def extend(batches):
        columns: list[list] = [[] for _ in range(9)]

        def out():
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["gram", "hot", "doc_id", "rid", "at", "least", "most", "right", "left"])
            for c in columns:
                c.clear()
            return found

        for row, line in _texts(batches):
            if line.n < PASSAGE:
                continue
            selected, grams = line.minimisers()
            at = np.array([p["at"] for p in row["places"]], np.int64)
            a, z = np.searchsorted(selected, at), np.searchsorted(selected, at, "right")
            words = (line.hashes(1) >> np.uint64(32)).astype(">u4")
            backwards, n = words[::-1], line.n
            for p, lo, hi, m in zip(row["places"], a.tolist(), z.tolist(), at.tolist()):
                if lo < hi:  # else a place of another text with the same rid
                    least, most = m - hi + 1, m - lo
                    values = (int(grams[m].view(np.int64)), p["hot"], row["doc_id"], row["rid"], m, least, most, words[m + GRAM : m - least + PASSAGE].tobytes(), backwards[n - m : n - m + most].tobytes())
                    for c, x in zip(columns, values):
                        c.append(x)
            if len(columns[0]) >= 4096:
                yield out()
        yield out()

    return d.join(places, "rid").mapInArrow(extend, _SUFFIXES)


def _matrix(column: pa.Array) -> np.ndarray:
    """Word hashes, a row for each value, filled up with zeros to SPAN words."""
    lengths = np.array([len(x) // 4 for x in column.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint64)
    out = np.zeros((len(lengths), SPAN), np.uint64)
    out[np.arange(SPAN) < lengths[:, None]] = flat
    return out


def _running(words: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the first 0, 1, ... SPAN words of each row."""
    out = np.empty((len(words), SPAN + 1), np.uint64)
    out[:, 0] = seed
    with np.errstate(over="ignore"):
        for k in range(SPAN):
            h = (out[:, k] ^ words[:, k]) * np.uint64(_MIX[k % 2])
            out[:, k + 1] = h ^ (h >> np.uint64(32))
    return out


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def compare(t: pa.Table) -> pa.RecordBatch:
    """The passages, as runs (lo to hi) of starts with the same partner, that suffixes of another document have.
    t: suffixes sorted by gram and right, no gram cut."""
    gram, doc, least, most = (_numbers(t, c) for c in ("gram", "doc_id", "least", "most"))
    right, n = _matrix(t.column("right").combine_chunks()), t.num_rows
    length = SPAN - least
    common = np.zeros(n, np.int64)
    common[0] = -1
    if n > 1:  # with the neighbour before
        same = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(axis=1)
        common[1:] = np.where(gram[1:] == gram[:-1], np.minimum(same, np.minimum(length[1:], length[:-1])), -1)
    left = _running(_matrix(t.column("left").combine_chunks()), 1)
    partner, found = np.zeros((n, SPAN + 1), np.int64), np.zeros((n, SPAN + 1), bool)
    for k in range(SPAN + 1):  # passages that start k words before the suffix
        own = np.flatnonzero((least <= k) & (k <= most))
        if len(own) < 2:
            continue
        interval, before = np.cumsum(common < SPAN - k)[own], left[own, k]
        order = np.lexsort((before, interval))
        i, b, d = interval[order], before[order], doc[own][order]
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
        sizes = np.diff(starts, append=len(i))
        first, last = np.repeat(np.minimum.reduceat(d, starts), sizes), np.repeat(np.maximum.reduceat(d, starts), sizes)
        hit = first < last
        rows = own[order][hit]
        found[rows, k] = True
        partner[rows, k] = np.where(d == first, last, first)[hit]
    opens = found.copy()
    opens[:, 1:] &= ~found[:, :-1] | (partner[:, 1:] != partner[:, :-1])
    ends = found.copy()
    ends[:, :-1] &= ~found[:, 1:] | (partner[:, 1:] != partner[:, :-1])
    row, a = np.nonzero(opens)
    z = np.nonzero(ends)[1]
    at, n = _numbers(t, "at")[row], len(row)
    none = [pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 2, *[pa.nulls(n, pa.binary())] * 2]
    found = [pa.array(x) for x in (doc[row], _numbers(t, "rid")[row], (at - z).astype(np.int32), (at - a).astype(np.int32), partner[row, a])]
    return pa.RecordBatch.from_arrays([*found, *none], _NAMES)


def passages(batches) -> Iterator[pa.RecordBatch]:
    """A row with a 128-bit hash (a, b) for each passage that selected a class of suffixes, k words before them."""
    for t in batches:
        least, most, gram = _numbers(t, "least"), _numbers(t, "most"), _numbers(t, "gram").view(np.uint64)
        right, left = _matrix(t.column("right")), _matrix(t.column("left"))
        hashes = []
        for seed in (2, 3):
            r, x = _running(right, seed), _running(left, seed + 2)
            with np.errstate(over="ignore"):
                hashes.append([((r[:, SPAN - k] ^ gram) * np.uint64(_MIX[0]) + x[:, k] * np.uint64(_MIX[1]) + np.uint64(k)).view(np.int64) for k in range(SPAN + 1)])
        for k in range(SPAN + 1):
            own = np.flatnonzero((least <= k) & (k <= most))
            columns = [_numbers(t, c)[own] for c in ("one", "two", "first", "last")]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, [*columns, np.full(len(own), k, np.int32), hashes[0][k][own], hashes[1][k][own]])), ["one", "two", "first", "last", "k", "a", "b"])


def widespread(often: DataFrame) -> DataFrame:
    """What repeated() returns, of suffixes (doc_id, rid, at, gram, least, most, right, left) of any number for a gram."""
    context = ("gram", "right", "left")
    named = written(often.withColumn("one", F.xxhash64(*context)).withColumn("two", F.xxhash64(F.lit(1), *reversed(context))))
    same = [F.first(c).alias(c) for c in (*context, "least", "most")]
    classes = written(named.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), *same))
    every = written(classes.mapInArrow(lambda batches: passages(pieces(batches, CHUNK)), _PASSAGES))
    met = every.groupBy("a", "b").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("n")).filter("least < most")
    met = skew_join(every.select("one", "two", "k", "a", "b"), written(met), ["a", "b"], "n")
    by = ["one", "two", "least", "most"]
    runs = met.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy(*by).orderBy("k")))  # of 35 passages
    runs = runs.groupBy(*by, "run").agg(F.min("k").alias("a"), F.max("k").alias("z")).join(classes.select("one", "two", "n"), ["one", "two"])
    out = skew_join(named.select("one", "two", "doc_id", "rid", "at"), written(runs.drop("run")), ["one", "two"], "n")
    partner = F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least"))
    return out.select("doc_id", "rid", (F.col("at") - F.col("z")).alias("lo"), (F.col("at") - F.col("a")).alias("hi"), partner.alias("partner"))


def repeated(d: DataFrame) -> DataFrame:
    """(doc_id, rid, lo, hi, partner), written: the passages starting at lo to hi stand in the document partner as
    well: in each case the one with the smallest id that has them, of that one's own the one with the largest."""

    def search(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            hot = b.column("hot")
            if len(often := b.filter(hot)):
                at, own = often.column("at"), [often.column(c) for c in ("gram", "least", "most", "right", "left")]
                yield pa.RecordBatch.from_arrays([often.column("doc_id"), often.column("rid"), at, at, pa.nulls(len(often), pa.int64()), *own], _NAMES)
            held.append(b.filter(pc.invert(hot)))
            n += len(held[-1])
            if n >= CHUNK:
                t = pa.Table.from_batches(held)
                gram = _numbers(t, "gram")
                whole = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                if whole:
                    yield compare(t.slice(0, whole))
                held, n = t.slice(whole).combine_chunks().to_batches(), len(t) - whole
        if n:
            yield compare(pa.Table.from_batches(held))

    places = retained(d)
    key = F.when(F.col("hot"), F.xxhash64("rid", "at")).otherwise(F.col("gram"))
    dealt = suffixes(d, places).withColumn("key", key).repartition("key").sortWithinPartitions("hot", "gram", "right").drop("key")
    rows = written(dealt.mapInArrow(search, _FOUND), places)
    often = widespread(rows.filter("gram is not null").withColumnRenamed("lo", "at"))
    return written(rows.filter("gram is null").select(often.columns).unionByName(often), rows)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each maximal run of words of a text that is covered by passages of PASSAGE words, each found in
    another document as well: doc_id, start_word, end_word (not included), n_words, other_docs (sorted: of each
    passage the document with the smallest id that has it, or, in that one's own row, the one with the largest, which
    links all that have it).

    Words are runs of anything but ASCII white space, compared as they are. Texts that are null or shorter than
    PASSAGE words and rows without doc_id give no rows. Rows of the same doc_id are no other documents to each other;
    each of their different texts has rows of its own, and rows of the same doc_id and text count once. Texts of any
    length are searched whole. Only doc_id and text are read, whatever other columns are named. Empty table: no rows.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    d = d.withColumn("rid", F.xxhash64("doc_id", "text"))
    by_start = Window.partitionBy("doc_id", "rid").orderBy("lo", "hi", "partner")  # a text's own passages
    s = repeated(d)
    reach = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1)) + PASSAGE
    s = s.withColumn("opens", F.when(F.col("lo") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    s = s.withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    out = s.groupBy("doc_id", "rid", "run").agg(F.min("lo").cast("long").alias("start_word"), (F.max("hi") + PASSAGE).cast("long").alias("end_word"), F.array_sort(F.collect_set("partner")).alias("other_docs"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_docs")
