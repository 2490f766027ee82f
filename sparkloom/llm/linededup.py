"""Line dedup with two Bloom filters, for keys seen once and keys seen twice.

1. One pass over the texts writes a narrow table of line digests (`line_table`), sorted by digest within each file.
2. The filters get BITS bits for each of its rows, so they are as selective at any size. They are cut by digest into
   segments: every task marks its own lines, and what the tasks marked in a segment meets in one task (bitwise: twice
   gets what is in both once-filters). Segments grow in number up to SEGMENTS and then in size, up to ROUND_BYTES.
3. The twice-filter goes to the executors in rounds of ROUND_BYTES, the bound of what is broadcast. A round tests the
   digests of its segments alone, which it reads by their range; lines that no filter suspects are shuffled nowhere.
4. Suspects are shuffled as digests, for exact confirmation and for the smallest doc_id.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import discard, fresh, opened, written
from ..operators.skew import skew_join
from .common import pieces, rows_apart, unpacked, utf8, with_field

MIN_CHARS = 10
#: Bits of the filters for each line, bits that a line sets, bits of a segment while there are few, and segments while
#: they are small; bytes of a segment, and of all that are broadcast together, at most; lines that a task holds.
BITS, HASHES, SEGMENT_BITS, SEGMENTS, ROUND_BYTES, CHUNK = 8, 4, 1 << 20, 4096, 1 << 26, 1 << 20
#: The doc_id that a row without one counts as.
NO_ID = (1 << 63) - 1

_LINES = "id long, part long, hi long, lo long"


def line_key(line: bytes) -> bytes | None:
    """The line's key, or None if it is shorter than MIN_CHARS code points."""
    key = line.strip().lower()
    if len(key) >= 4 * MIN_CHARS or len(key) >= MIN_CHARS and len(key.decode("utf-8", "replace")) >= MIN_CHARS:
        return key
    return None


def _keys(text: bytes | None) -> set[bytes]:
    found = set(map(line_key, (text or b"").split(b"\n")))
    found.discard(None)
    return found


def _digest(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return struct.unpack(">qq", hashlib.blake2b(key, digest_size=16).digest())


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, part): part tells rows of one doc_id apart by their texts, above all rows that have no doc_id."""
    part = F.xxhash64(F.col("text").cast("string"))
    return rows_apart(docs, id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), part=part)


def line_table(keyed: DataFrame) -> DataFrame:
    """(id, part, hi, lo), written: a row for each different line key of a text."""

    def run(batches):
        ids: list[int] = []
        parts: list[int] = []
        digests: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at = np.array(digests, np.int64).reshape(-1, 2)
            order = np.argsort(at[:, 0])
            columns = [np.array(ids, np.int64)[order], np.array(parts, np.int64)[order], at[order, 0], at[order, 1]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["id", "part", "hi", "lo"])
            for x in (ids, parts, digests):
                x.clear()

        for b in pieces(batches):
            for i, part, t in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), utf8(b.column("text"))):
                found = list(map(_digest, _keys(t)))
                digests += found
                ids += [i] * len(found)
                parts += [part] * len(found)
            if len(ids) >= CHUNK:
                yield from flush()
        yield from flush()

    return written(keyed.select("id", "part", F.col("row.text").alias("text")).mapInArrow(run, _LINES))


class Layout:
    """Where a digest's bits are: its segment by the order of hi, its places within by lo."""

    def __init__(self, lines: int):
        bits = max(1, BITS * lines)
        n = max(min(SEGMENTS, -(-bits // SEGMENT_BITS)), -(-bits // (8 * ROUND_BYTES)))
        self.segments, self.bits = n, (-(-bits // n) + 7) // 8 * 8
        self.width = -(-(1 << 64) // n)  # of a segment's range of hi

    def segment(self, hi: np.ndarray) -> np.ndarray:
        if self.segments == 1:
            return np.zeros(len(hi), np.int64)
        return ((hi.view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(self.width)).astype(np.int64)

    def places(self, lo: np.ndarray) -> np.ndarray:
        u = lo.view(np.uint64)
        step = (u >> np.uint64(32)) | np.uint64(1)
        return np.stack([((u & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % np.uint64(self.bits) for i in range(HASHES)], axis=1).astype(np.int64)

    def first_hi(self, segment: int) -> int:
        """The least hi of a segment."""
        return min(segment * self.width, (1 << 64) - 1) - (1 << 63)

    def rounds(self) -> list[tuple[int, int]]:
        step = max(1, ROUND_BYTES * 8 // self.bits)
        return [(a, min(a + step, self.segments)) for a in range(0, self.segments, step)]


def _pack(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64))


def _chunks(batches, *names: str) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield [np.concatenate([x.column(c).to_numpy() for x in held]) for c in names]
            held, n = [], 0
    if held:
        yield [np.concatenate([x.column(c).to_numpy() for x in held]) for c in names]


def twice_filter(lines: DataFrame, layout: Layout) -> DataFrame:
    """(segment, twice binary), written: the bits that lines of different rows have set, a row for each segment."""
    bits = layout.bits

    def fill(batches):
        for hi, lo in _chunks(batches, "hi", "lo"):
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            first = np.flatnonzero(new)
            again = np.diff(first, append=len(hi)) > 1
            hi, lo = hi[first], lo[first]
            segment, places = layout.segment(hi), layout.places(lo)
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(hi)]):
                once, twice = np.unique(places[a:z]), np.unique(places[a:z][again[a:z]])
                yield pa.RecordBatch.from_arrays([pa.array([int(segment[a])], pa.int32()), pa.array([_pack(once)], pa.binary()), pa.array([_pack(twice)], pa.binary())], ["segment", "once", "twice"])

    def merge(batches):
        now, a, t = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(t).tobytes(), 1)], pa.binary())], ["segment", "twice"])

        for b in batches:
            for k, once, twice in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != now:  # sorted, so that one segment is held at a time
                    if now is not None:
                        yield out()
                    now, a, t = k, np.zeros(bits, bool), np.zeros(bits, bool)
                p = _unpack(once)
                t[p[a[p]]] = True
                a[p] = True
                t[_unpack(twice)] = True
        if now is not None:
            yield out()

    marked = lines.select("hi", "lo").mapInArrow(fill, "segment int, once binary, twice binary")
    return written(marked.repartition(layout.segments, "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary"))


def suspects(lines: DataFrame) -> DataFrame:
    """The rows of lines, written, whose bits are all in the twice-filter: every line that two texts have, and few
    others."""
    spark, layout = lines.sparkSession, Layout(lines.count())
    twice, path = twice_filter(lines, layout), fresh(lines.sparkSession)
    for a, z in layout.rounds():
        rows = twice.filter(f"segment >= {a} and segment < {z}").collect()  # ROUND_BYTES at most
        sent = spark.sparkContext.broadcast({r.segment: bytes(r.twice) for r in rows})

        def test(batches):
            full: dict[int, np.ndarray] = {}
            for b in batches:
                hi, lo = b.column("hi").to_numpy(), b.column("lo").to_numpy()
                keep = np.zeros(len(hi), bool)
                segment, places = layout.segment(hi), layout.places(lo)
                for k in np.unique(segment).tolist():
                    if k not in full and k in sent.value:
                        full[k] = np.frombuffer(zlib.decompress(sent.value[k]), np.uint8)
                    if k in full:
                        own = np.flatnonzero(segment == k)
                        p = places[own]
                        keep[own] = (full[k][p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).all(axis=1)
                yield b.filter(pa.array(keep))

        last = f" and hi < {layout.first_hi(z)}L" if z < layout.segments else ""
        first = f"hi >= {layout.first_hi(a)}L" if a else "true"
        lines.filter(first + last).mapInArrow(test, _LINES).write.mode("append").parquet(path)
        sent.unpersist()
    discard(twice)
    return opened(spark, path, lines.schema)


def repeats(keyed: DataFrame) -> DataFrame:
    """(id, part, gone array<struct<hi,lo>>), written: the lines that a text loses."""
    lines = line_table(keyed)
    seen = suspects(lines)
    discard(lines)
    first = written(seen.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first < last").select("hi", "lo", "first", "n"))
    lost = skew_join(seen, first, ["hi", "lo"], "n").filter("id > first")
    return written(lost.groupBy("id", "part").agg(F.collect_set(F.struct("hi", "lo")).alias("gone")), seen, first)  # a text's own lines


def _kept(text: bytes | None, gone: set[tuple[int, int]]) -> tuple[list[bytes], int]:
    lines = (text or b"").split(b"\n")
    if not gone:
        return lines, len(lines)
    return [x for x in lines if (k := line_key(x)) is None or _digest(k) not in gone], len(lines)


def _cut(docs: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped): docs' rows with what is kept of their texts."""
    keyed = _keyed(docs)
    joined = keyed.join(repeats(keyed), ["id", "part"], "left").select("row", "gone")

    def cut(batches):
        for b in pieces(batches):
            texts, lines, dropped, rows = [], [], [], b.column("row")
            for t, gone in zip(utf8(rows.field("text")), b.column("gone").to_pylist()):
                kept, n = _kept(t, {(x["hi"], x["lo"]) for x in gone or ()})
                texts.append(None if t is None else b"\n".join(kept) if len(kept) < n else t)
                lines.append(n)
                dropped.append(n - len(kept))
            yield pa.RecordBatch.from_arrays([with_field(rows, "text", pa.array(texts, pa.string())), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, joined.select("row").schema.add("n_lines", "long").add("n_dropped", "long"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, with text replaced by its kept lines, n_lines and n_dropped; columns of those names are replaced, all
    others stay, whatever their names.

    Null text is one empty line. A null doc_id counts as the largest one, and rows of the same doc_id as one
    document, whose lines all stay where it is the first; repeated rows all stay. Texts of any length are cut whole,
    and may be all dropped: the row stays, with an empty text (no text if it had none). Empty table: no rows.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _cut(docs).select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "n_lines", "n_dropped")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with their kept lines as text, and n_chars, if there, of the new text where a line went; the same columns,
    whatever their names. Nulls, long texts, repeated rows and empty tables as in drop_repeated_lines."""
    out = _cut(docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_dropped") > 0, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return unpacked(out, docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row (see drop_repeated_lines)."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT d.doc_id, d.i, d.line, f.first IS NOT NULL AND d.doc_id <> f.first AS gone
  FROM keyed d LEFT JOIN firsts f ON d.k = f.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
