"""Bounded-space online packing of tokenised documents into sequences of WINDOW ids.

Each partition keeps OPEN windows. A document's ids go, WINDOW at a time, to sequences of their own; the rest goes to
the open window with the least room that takes it; if none does, the fullest one is filled to the brim with its head
and emitted, and the rest is placed in turn. What stays open at a partition's end is merged by a second, much smaller
pass over the leftovers alone, whose own last window is cut at powers of two, where no padding is needed.
"""
from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import written
from .common import pieces, utf8

WINDOW, OPEN = 1024, 32
#: Partitions whose leftovers meet in one task of the second pass.
MERGED = 32
BOUNDARY_ID = 0
#: The tokenizer file whose vocabulary tiktoken has as well, and the string of its special token.
TWIN, SPECIAL = "byte_bpe_50k.json", "<|endoftext|>"

_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_cached: dict[str, Callable[[str], list[int]]] = {}
#: Texts of these characters alone are cut alike by both libraries' engines for regular expressions.
_PLAIN = re.compile(r"[\t\n\r\x20-ɏ]*")


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as the tokenizers library does with add_special_tokens=False.

    Where the file's vocabulary has a twin of the same name for tiktoken, that library, four times as fast, encodes
    texts of plain Latin characters without special tokens' strings; both give the same ids (tests compare them).
    """
    if path not in _cached:
        exact: list = []

        def slow(text: str) -> list[int]:
            if not exact:  # most workers never need it
                from tokenizers import Tokenizer

                exact.append(Tokenizer.from_file(path))
            return exact[0].encode(text, add_special_tokens=False).ids

        if not path.endswith(TWIN):
            _cached[path] = slow
        else:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _cached[path] = lambda text: fast.encode_ordinary(text) if _PLAIN.fullmatch(text) and SPECIAL not in text else slow(text)
    return _cached[path]


class Packer:
    """Places pieces (key, start, ids) and gives back those of emitted windows."""

    def __init__(self, emit_id: Callable[[], int], window: int = WINDOW, keep: int = OPEN):
        self.next_id, self.window = emit_id, window
        self.open: list[list] = [[0, []] for _ in range(keep)]

    def place(self, key, start: int, ids: np.ndarray) -> Iterator[tuple]:
        while len(ids):
            fits = [w for w in self.open if self.window - w[0] >= len(ids)]
            best = max(fits, key=lambda w: w[0]) if fits else max(self.open, key=lambda w: w[0])
            head = ids[: self.window - best[0]]
            best[1].append((key, start, head, best[0]))
            best[0] += len(head)
            if best[0] == self.window:
                yield from self._emit(best[1])
                best[0], best[1] = 0, []
            start, ids = start + len(head), ids[len(head) :]

    def _emit(self, pieces: list) -> Iterator[tuple]:
        number = self.next_id()
        for key, start, ids, offset in pieces:
            yield key, start, ids, number, offset

    def leftovers(self) -> Iterator[tuple]:
        """The pieces of the open windows, which end here."""
        for _, pieces in self.open:
            for key, start, ids, _ in pieces:
                yield key, start, ids

    def close(self) -> Iterator[tuple]:
        """The open windows' pieces, joined and cut into full windows, then into powers of two."""
        pieces = [[k, s, i] for k, s, i in self.leftovers()]
        left = sum(len(p[2]) for p in pieces)
        while left:
            room = self.window if left >= self.window else 1 << left.bit_length() - 1
            left, number, offset = left - room, self.next_id(), 0
            while offset < room:
                key, start, ids = pieces[0]
                head = ids[: room - offset]
                yield key, start, head, number, offset
                offset += len(head)
                pieces[0] = [key, start + len(head), ids[len(head) :]]
                if not len(pieces[0][2]):
                    pieces.pop(0)


def _table(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * (9 if ids else 7)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids", "task"] if ids else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, keep: int = OPEN) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: a tokenizer file, which must lie at the same path on every worker. Null or empty text: the boundary id
    alone. Null and repeated doc_ids are packed as they come, texts of any length whole. Empty table: no
    rows. Other columns are not read, whatever their names.
    """
    path = tokenizer or default_tokenizer()

    def counter(tag: int) -> Callable[[], int]:
        base, n = (tag << 62) + (TaskContext.get().partitionId() << 32), iter(range(1 << 32))
        return lambda: base + next(n)

    def first(batches):
        encode, number = encoder(path), counter(0)
        packer, task = Packer(number, window, keep), TaskContext.get().partitionId()
        for b in pieces(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                ids = np.array([*encode((text or b"").decode("utf-8", "replace")), BOUNDARY_ID], np.uint32)
                n, whole = len(ids), len(ids) // window * window
                rows += [(doc, a, window, _crc(ids[a : a + window]), n, number(), 0, None, task) for a in range(0, whole, window)]
                rows += [(k[0], a, len(x), _crc(x), k[1], s, o, None, task) for k, a, x, s, o in packer.place((doc, n), whole, ids[whole:].copy())]
            yield _table(rows, True)
        yield _table([(k[0], a, len(x), None, k[1], None, None, x.astype("<u4").tobytes(), task) for k, a, x in packer.leftovers()], True)

    def second(batches):
        packer = Packer(counter(1), window, keep)
        out = lambda found: _table([(k[0], a, len(x), _crc(x), k[1], s, o) for k, a, x, s, o in found], False)
        for b in pieces(batches):
            c = {n: b.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")}
            yield out([r for d, a, n, x in zip(*c.values()) for r in packer.place((d, n), a, np.frombuffer(x, "<u4"))])
        yield out(packer.close())

    parts = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first, f"{_COLUMNS}, ids binary, task long"))
    placed = parts.filter("sequence_id is not null").drop("ids", "task")
    group = F.floor(F.col("task") / MERGED)
    tasks = parts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    left = parts.filter("sequence_id is null").withColumn("g", group).repartition(max(1, int(tasks) // MERGED), "g").sortWithinPartitions("g", "task", "doc_id", "start", "ids")
    return placed.unionByName(left.drop("g").mapInArrow(second, _COLUMNS))
