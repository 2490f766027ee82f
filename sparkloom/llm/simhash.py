"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link if at most 3 bits differ. 3 is odd, so half of it is 1 on one side and 2 on the other:

1. `fingerprints`: one pass over the texts.
2. `crowded` (a sieve): the bits are cut into 3 blocks. A pair that differs in 3 bits or fewer differs in at most 2
   bits outside one of the blocks, so every fingerprint emits, for each left-out block, all variants of the rest
   within half of that radius (1 bit): 131 keys. A fingerprint none of whose keys is met by another has no link.
3. `links`: those that are left emit all variants of the whole word within half the radius: 65 within 1 bit, and,
   where the fingerprint's parity is odd (a pair at distance 3 has both parities), the 2,016 at 2 bits. All that meet
   in a variant with one of the first kind are within 3 bits of it; the smallest of those is the bucket's centre, and
   each other one links to it. A bucket holds 2,081 fingerprints at most, whatever the data are, links are linear in
   the emitted rows, and every pair within 3 bits shares a bucket with such a centre, so components lose nothing.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.scratch import written
from .common import hex64, pieces, rows_apart, unpacked, utf8

SEED, SHINGLE, RADIUS = 42, 3, 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
_CHUNK = 1 << 16
#: Fingerprints whose variants one task emits: some 17 million rows in the sieve.
DEALT = 1 << 17


def fingerprint(text: bytes | None) -> int:
    """SimHash of 3-word shingles, unsigned; no words: 0."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return hashed(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(first, ends[SHINGLE - 1 :].tolist())), ">u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(part, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fp long) of each row; part tells texts of one doc_id apart, fp has the bits of the unsigned
    fingerprint."""

    def run(batches):
        for b in pieces(batches):
            fp = [_signed(fingerprint(t)) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(fp, pa.int64())], ["doc_id", "part", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("part"), text).mapInArrow(run, "doc_id long, part long, fp long")


def _masks(bits: range, most: int, least: int = 0) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(least, most + 1) for c in combinations(bits, k)]


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' if v != -(1 << 63) else '(-9223372036854775807L - 1L)' for v in values)})"


def dealt(fps: DataFrame) -> DataFrame:
    """A written table of fingerprints, dealt out anew if its partitions have more than DEALT: files are split by bytes,
    and a large split would emit a hundred times its rows from one task."""
    n = fps.count()
    return fps if n <= DEALT * fps._jdf.queryExecution().toRdd().getNumPartitions() else fps.repartition(-(-n // DEALT))


def crowded(fps: DataFrame) -> DataFrame:
    """Of the distinct fingerprints (fp), all that may have a link."""
    parts, fps = [], dealt(fps)
    for k, (lo, hi) in enumerate(BLOCKS):
        keep = _signed(((1 << 64) - 1) ^ sum(1 << b for b in range(lo, hi)))
        flips = [m for m in [0, *(_signed(1 << b) for b in range(64) if not lo <= b < hi)]]
        parts.append(f"transform({_longs(flips)}, m -> xxhash64({k}, (fp & {_longs([keep])}[0]) ^ m))")
    keys = fps.select("fp", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("key"))
    near = Window.partitionBy("key").orderBy("fp")  # neighbours only, so that no group is held in memory
    met = keys.select("fp", F.lag("fp").over(near).alias("p"), F.lead("fp").over(near).alias("n")).filter("p is not null or n is not null")
    return met.select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within RADIUS, enough to connect all that are connected."""
    fps = dealt(fps)
    near = fps.select("fp", F.explode(F.expr(_longs(_masks(range(64), 1)))).alias("m")).select("fp", F.col("fp").alias("centre"), F.expr("fp ^ m").alias("key"))
    far = fps.filter("bit_count(fp) % 2 = 1").select("fp", F.explode(F.expr(_longs(_masks(range(64), 2, 2)))).alias("m")).select("fp", F.lit(None).cast("long").alias("centre"), F.expr("fp ^ m").alias("key"))
    bucket = Window.partitionBy("key")
    met = near.unionByName(far).select("fp", F.min("centre").over(bucket).alias("a")).filter("a <> fp").distinct()
    return met.filter(f"bit_count(a ^ fp) <= {RADIUS}").select("a", F.col("fp").alias("b"))


def classes(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of rows (doc_id, fp), written; root is the component's
    smallest fingerprint."""
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    near = written(crowded(first.select("fp")))
    edges = written(links(near), near)
    roots = written(components(edges).select(F.col("node").alias("fp"), "root"), edges)
    least = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    merged = roots.join(least, "root").select("fp", "root", "component_id")
    return written(first.join(merged, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")), first, roots)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach.

    Null or empty text, or only white space: fingerprint zero, linked like any other. Texts of any length are hashed
    whole. A null doc_id is never a component's smallest; a component of nothing else has component_id null. Repeated
    rows are returned as often as they come. Columns other than doc_id and text are not read. Empty table: no rows.
    """
    rows = written(fingerprints(docs).drop("part"))
    return rows.join(classes(rows), "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of its rows with the smallest doc_id, the one whose text's hash is least, and of
    repeats of that row the one whose other columns sort first as JSON. Same columns, whatever their names.

    It goes by rows and not by ids: texts of one doc_id that are in different components each stay. Rows without a
    doc_id can't be named as a copy and all stay. Null and empty texts are copies of each other. Empty table: no rows.
    """
    rows = written(fingerprints(docs.filter(F.col("doc_id").isNotNull())).distinct())
    keep = rows.join(classes(rows), "fp").filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "part")).alias("k")).select("k.*")
    named = docs.filter(F.col("doc_id").isNotNull())
    others = [f"row.`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    apart = rows_apart(named, doc_id=F.col("doc_id").cast("long"), part=F.xxhash64(F.col("text").cast("string")))
    kept = apart.join(keep.distinct(), ["doc_id", "part"], "left_semi")
    first = Window.partitionBy("doc_id", "part").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    kept = kept.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return unpacked(kept, docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()).withColumn("text", F.col("text").cast("string")))
