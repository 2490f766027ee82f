"""ISO media containers (ISO/IEC 14496-12): a walker of nested boxes, a decoder of sample tables, and a writer.

`inspect` reads codec, duration, sample ranges and times and keyframe byte ranges from boxes alone, of the movie's own
tables and of movie fragments; payload bytes are only ever sliced by those ranges, never decoded. Every table is
checked against the box that holds it and the file before anything of its length is made.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, utf8

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Fixed values of the format: flags of fragment headers and runs, and of a sample that is no keyframe.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEYFRAME = 0x10000
UNIT, SAMPLE, TIMESCALE, KEYFRAME_EVERY, SAMPLES_IN_CHUNK = 576, 576, 48000, 8, 4
#: Boxes within boxes, at most.
DEEPEST = 16
CODEC = b"raw "


class BadMedia(ValueError):
    """The bytes break off or contradict their own tables."""


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first payload byte, end) of the boxes side by side in data[start:end]; 64-bit sizes and size 0 (to the
    end) included."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise BadMedia("a box header breaks off")
        n, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if n == 1:
            if start + 16 > end:
                raise BadMedia("a box header breaks off")
            (n,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif n == 0:
            n = end - start
        if n < head or start + n > end:
            raise BadMedia(f"box {kind!r} does not fit")
        yield kind, start + head, start + n
        start += n


def tree(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of types, first payload byte, end) of every box, outer ones first."""
    stack = [iter([(path, start, len(data) if end is None else end)])]
    while stack:
        for at, a, b in stack[-1]:
            if at != path:
                yield at, a, b
            if at == path or at[-1] in CONTAINERS:
                if len(at) > DEEPEST:
                    raise BadMedia("boxes are nested too deep")
                stack.append(iter([((*at, kind), x, y) for kind, x, y in boxes(data, a, b)]))
                break
        else:
            stack.pop()


def _numbers(data, a: int, end: int, n: int, form: str) -> tuple:
    """n numbers from a on, which must lie before end."""
    if a + n * struct.calcsize(f">{form}") > end:
        raise BadMedia("a table breaks off")
    return struct.unpack_from(f">{n}{form}", data, a)


def _counted(data, box: tuple[int, int], form: str = "I", width: int = 1) -> tuple:
    """The numbers of a table with its length in front."""
    a, end = box
    (n,) = _numbers(data, a + 4, end, 1, "I")
    return _numbers(data, a + 8, end, n * width, form)


def sample_sizes(data, table: dict[bytes, tuple[int, int]]) -> list[int]:
    """From stsz or stz2."""
    if b"stsz" in table:
        a, end = table[b"stsz"]
        size, n = _numbers(data, a + 4, end, 2, "I")
        if size and n > len(data) // size:
            raise BadMedia("samples are larger than the file")
        return [size] * n if size else list(_numbers(data, a + 12, end, n, "I"))
    if b"stz2" not in table:
        raise BadMedia("no sample sizes")
    a, end = table[b"stz2"]
    field, (n,) = _numbers(data, a + 7, end, 1, "B")[0], _numbers(data, a + 8, end, 1, "I")
    if field not in (4, 8, 16):
        raise BadMedia("sizes of an unknown width")
    raw = _numbers(data, a + 12, end, n if field > 4 else (n + 1) // 2, "H" if field == 16 else "B")
    return list(raw) if field > 4 else [x for b in raw for x in (b >> 4, b & 15)][:n]


def sample_ranges(data, table: dict[bytes, tuple[int, int]]) -> list[tuple[int, int]]:
    """(offset, size) of each sample, from stsz or stz2, stsc, and stco or co64."""
    sizes = sample_sizes(data, table)
    wide = b"co64" in table
    if not wide and b"stco" not in table or b"stsc" not in table:
        raise BadMedia("no chunk table")
    chunks = _counted(data, table[b"co64" if wide else b"stco"], "Q" if wide else "I")
    flat = _counted(data, table[b"stsc"], width=3)
    runs = list(zip(flat[::3], flat[1::3]))
    out, k = [], 0
    for i, (first, per) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        if not 1 <= first <= last <= len(chunks) + 1:
            raise BadMedia("a chunk is missing")
        for at in chunks[first - 1 : last - 1]:
            for size in sizes[k : k + per]:
                out.append((at, size))
                at += size
            k += per
    if len(out) < len(sizes):
        raise BadMedia("samples without a chunk")
    return out


def sample_times(data, table: dict[bytes, tuple[int, int]], n: int) -> tuple[list[int], int]:
    """The decoding time of each of n samples and of the end, from stts."""
    if b"stts" not in table:
        raise BadMedia("no sample times")
    flat, out, now = _counted(data, table[b"stts"], width=2), [], 0
    for count, delta in zip(flat[::2], flat[1::2]):
        if len(out) + count > n:
            raise BadMedia("times for more samples than there are")
        out += range(now, now + count * delta, delta) if delta else [now] * count
        now += count * delta
    if len(out) < n:
        raise BadMedia("samples without a time")
    return out, now


class _Fragment:
    """One movie fragment: places of its runs' samples, by the rules for base offsets."""

    def __init__(self, data, start: int):
        self.data, self.start, self.next, self.first = data, start, start, True

    def header(self, a: int, end: int, known: dict[int, tuple]) -> int:
        """Reads tfhd; the id of its track."""
        flags, track = _numbers(self.data, a, end, 2, "I")
        at, self.defaults = a + 8, list(known.get(track, (0, 0, 0)))  # duration, size, flags
        self.base = self.start if flags & FROM_MOOF or self.first else self.next
        if flags & BASE_OFFSET:
            (self.base,), at = _numbers(self.data, at, end, 1, "Q"), at + 8
        at += 4 * bool(flags & DESCRIPTION)
        for k, bit in enumerate((DURATION, SIZE, FLAGS)):
            if flags & bit:
                (self.defaults[k],), at = _numbers(self.data, at, end, 1, "I"), at + 4
        self.next, self.first = self.base, False
        return track

    def run(self, a: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
        """(offset, size, duration, keyframe) of the samples of a trun."""
        flags, n = _numbers(self.data, a, end, 2, "I")
        at, first = a + 8, None
        if flags & RUN_OFFSET:
            self.next, at = self.base + _numbers(self.data, at, end, 1, "i")[0], at + 4
        if flags & RUN_FIRST:
            (first,), at = _numbers(self.data, at, end, 1, "I"), at + 4
        own = [k for k, bit in enumerate((RUN_DURATION, RUN_SIZE, RUN_FLAGS)) if flags & bit]
        width = len(own) + bool(flags & RUN_COMPOSITION)
        if width == 0 and n * max(self.defaults[1], 1) > len(self.data):
            raise BadMedia("samples are larger than the file")
        table = _numbers(self.data, at, end, n * width, "I")
        for i in range(n):
            values = list(self.defaults)
            if i == 0 and first is not None:
                values[2] = first
            for j, k in enumerate(own):
                values[k] = table[i * width + j]
            yield self.next, values[1], values[0], not values[2] & NO_KEYFRAME
            self.next += values[1]


def inspect(data: bytes) -> list[dict]:
    """A dict for each track: track_id, handler, codec, timescale, duration (units of timescale), samples as (offset,
    size) in the file, times (of decoding) and keyframes, as indices of samples. Raises BadMedia on broken input."""
    tracks: list[dict] = []
    known: dict[int, tuple] = {}
    parts: list[tuple[int, int, list]] = []  # of fragments: track, base time (-1: goes on), samples
    fragment = None
    for path, a, b in tree(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"track_id": len(tracks) + 1, "handler": "", "codec": "", "timescale": 0, "duration": 0, "table": {}})
        elif kind == b"trex" and b"mvex" in path:
            track, _, *defaults = _numbers(data, a + 4, b, 5, "I")
            known[track] = tuple(defaults)
        elif kind == b"moof":
            fragment = _Fragment(data, a - (8 if bytes(data[a - 4 : a]) == kind else 16))
        elif fragment and kind == b"tfhd":
            parts.append((fragment.header(a, b, known), -1, []))
        elif fragment and parts and kind == b"tfdt":
            parts[-1] = (parts[-1][0], _numbers(data, a + 4, b, 1, "Q" if _numbers(data, a, b, 1, "B")[0] else "I")[0], parts[-1][2])
        elif fragment and parts and kind == b"trun":
            parts[-1][2].extend(fragment.run(a, b))
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        wide = kind in (b"mdhd", b"tkhd") and _numbers(data, a, b, 1, "B")[0]
        if kind == b"tkhd":
            (t["track_id"],) = _numbers(data, a + (20 if wide else 12), b, 1, "I")
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = (*_numbers(data, a + 20, b, 1, "I"), *_numbers(data, a + 24, b, 1, "Q")) if wide else _numbers(data, a + 12, b, 2, "I")
        elif kind == b"hdlr":
            t["handler"] = bytes(data[a + 8 : min(a + 12, b)]).decode("latin-1")
        elif kind == b"stsd" and _numbers(data, a + 4, b, 1, "I")[0]:
            t["codec"] = bytes(data[a + 12 : min(a + 16, b)]).decode("latin-1")
        elif path[-2] == b"stbl":
            t["table"][kind] = (a, b)
    if lost := {p[0] for p in parts} - {t["track_id"] for t in tracks}:
        raise BadMedia(f"a fragment of no track: {min(lost)}")
    for t in tracks:
        _decode(data, t, [p[1:] for p in parts if p[0] == t["track_id"]], t["track_id"] in known)
    return tracks


def _decode(data, t: dict, parts: list[tuple[int, list]], fragmented: bool) -> None:
    table = t.pop("table")
    none = fragmented and b"stsz" not in table and b"stz2" not in table
    t["samples"] = [] if none else sample_ranges(data, table)
    n = len(t["samples"])
    t["times"], now = ([], 0) if none else sample_times(data, table, n)
    t["keyframes"] = list(range(n))  # without stss every sample is one
    if b"stss" in table:
        t["keyframes"] = [m - 1 for m in _counted(data, table[b"stss"])]
        if any(not 0 <= m < n for m in t["keyframes"]):
            raise BadMedia("a keyframe is missing")
    for base, samples in parts:
        now = base if base >= 0 else now
        for at, size, duration, key in samples:
            if key:
                t["keyframes"].append(len(t["samples"]))
            t["samples"].append((at, size))
            t["times"].append(now)
            now += duration
    if parts:
        t["duration"] = max(t["duration"], now)
    if any(a < 0 or a + size > len(data) for a, size in t["samples"]):
        raise BadMedia("samples lie outside the file")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _table(kind: bytes, *numbers: int, form: str = "I") -> bytes:
    return _box(kind, bytes(4), struct.pack(f">{len(numbers)}{form}", *numbers))


def wrap(payload: bytes, sample: int = SAMPLE) -> bytes:
    """payload as one track of 8-bit mono samples, `sample` bytes each, in chunks of SAMPLES_IN_CHUNK; every
    KEYFRAME_EVERYth is marked a keyframe. len(payload) must be a positive multiple of sample."""
    n = len(payload) // sample
    if not n or len(payload) % sample:
        raise ValueError(f"payload must be a positive multiple of {sample} bytes")
    duration, matrix = n * sample, struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks, last = (n + SAMPLES_IN_CHUNK - 1) // SAMPLES_IN_CHUNK, n % SAMPLES_IN_CHUNK
    runs = [(1, SAMPLES_IN_CHUNK, 1)] * (n >= SAMPLES_IN_CHUNK) + [(chunks, last, 1)] * bool(last)
    keys = range(1, n + 1, KEYFRAME_EVERY)
    entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHII", 1, 8, 0, TIMESCALE << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(at: int) -> bytes:
        stbl = _box(
            b"stbl", _box(b"stsd", bytes(4), struct.pack(">I", 1), entry), _table(b"stts", 1, n, sample), _table(b"stss", len(keys), *keys),
            _table(b"stsc", len(runs), *(x for r in runs for x in r)), _table(b"stsz", sample, n), _box(b"co64", bytes(4), struct.pack(f">I{chunks}Q", chunks, *(at + i * sample * SAMPLES_IN_CHUNK for i in range(chunks)))),
        )
        dinf = _box(b"dinf", _box(b"dref", bytes(4), struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
        minf = _box(b"minf", _box(b"smhd", bytes(8)), dinf, stbl)
        mdhd = _box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _box(b"hdlr", bytes(8), b"soun", bytes(12), b"\0"), minf)
        tkhd = _box(b"tkhd", b"\1\0\0\7", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8))
        mvhd = _box(b"mvhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = ftyp + movie(len(ftyp) + len(movie(0)) + 16)
    return b"".join([head, struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16), payload])


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def feature(track: dict) -> str:
    frames = ",".join("{}+{}".format(*track["samples"][k]) for k in track["keyframes"])
    return f"codec={track['codec'].strip()};handler={track['handler']};seconds={track['duration']}/{track['timescale']};samples={len(track['samples'])};keyframes={frames}"


_FRAMES = T.ArrayType(T.StructType().add("time", "long").add("offset", "long").add("size", "long"))
TRACKS = T.ArrayType(T.StructType().add("track_id", "long").add("handler", "string").add("codec", "string").add("timescale", "long").add("duration", "long").add("n_samples", "long").add("keyframes", _FRAMES))


def media_columns(files: DataFrame, column: str = "media") -> DataFrame:
    """files with tracks, an array of each track's track_id, handler, codec, timescale, duration, n_samples and
    keyframes (time, offset and size of each), and error.

    The bytes column is not returned; other columns stay whatever their names, but tracks and error are replaced.
    Null or empty bytes and files without a track: no tracks, and an error that says so. Broken bytes, above all
    tables that claim what the file cannot hold: null tracks and an error; other rows are not affected. Repeated rows
    are returned as often as they come. Empty table: no rows."""
    rest = [c for c in files.columns if c not in (column, "tracks", "error")]
    frames = pa.list_(pa.struct([(n, pa.int64()) for n in ("time", "offset", "size")]))
    kind = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", frames)]))

    def row(data):
        try:
            tracks = inspect(data or b"")
        except (BadMedia, IndexError, OverflowError) as e:
            return None, str(e) or "broken"
        named = [{k: t[k] for k in ("track_id", "handler", "codec", "timescale", "duration")} | {"n_samples": len(t["samples"]), "keyframes": [{"time": t["times"][i], "offset": t["samples"][i][0], "size": t["samples"][i][1]} for i in t["keyframes"]]} for t in tracks]
        return named, None if tracks else "no track"

    def run(batches):
        for b in pieces(batches):
            found = list(map(row, b.column("media").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.string())], ["row", "tracks", "error"])

    none = next(f"_{i}" for i in range(len(rest) + 1) if f"_{i}" not in rest)  # a struct needs a field
    given = files.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("boolean").alias(none)).alias("row"), F.col(f"`{column}`").alias("media"))
    out = given.mapInArrow(run, given.select("row").schema.add("tracks", TRACKS).add("error", "string"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "tracks", "error")


def media_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row.

    Each text is wrapped into a container, the container's bytes are inspected, and the payload is gathered by the
    sample ranges found there. Null text: empty. Texts of any length are stored whole; null and repeated doc_ids are
    returned as they come. Only doc_id and text are read, whatever other columns are named. Empty table: no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def row(doc, text):
        text = text or b""
        media = wrap(pad(text))
        (track,) = inspect(media)
        payload = b"".join(media[a : a + n] for a, n in track["samples"])
        return doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in pieces(batches):
            found = list(zip(*map(row, b.column("doc_id").to_pylist(), utf8(b.column("text"))))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, map(list, found), kinds)), names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
