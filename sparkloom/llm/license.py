"""License scans with a positional rare-token index over license templates.

Document frequencies of the templates' words are counted over the whole corpus. Each template is posted under its
words with their positions. A file's template words are looked up rarest first; a template's rarest word that the file
has gives the places where the template could start, the other words' positions in the file are intersected with them
by relative position, and a template holds if its mandatory phrase stands there word for word and enough of its other
words stand before and after it in their order, where words may be put in, left out or replaced. Short phrases are templates that are mandatory as a whole, so all their places are found.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences by which well-known licenses are recognised, with the phrase that must stand as it is.
TEMPLATES = {
    "agpl": ("gnu affero general public license", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    "gpl-2.0": ("gnu general public license version 2", "general public license version 2"),
    "gpl-3.0": ("gnu general public license version 3", "general public license version 3"),
    "gpl-notice": ("it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "hereby granted free of charge"),
    "mit-release": ("released under the mit license", "the mit license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
}
#: Further sentences for some of the labels: of the license's own text beside its notice, or a shorter wording.
MORE = [
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0"),
    ("cc-by", "bound by the terms and conditions of this creative commons attribution 4 0 international public license", "creative commons attribution"),
    ("cc0", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", "automatically confer exclusive copyright and related rights"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "hereby granted free of charge"),
]
#: Words that make another license of it where they follow the mandatory phrase.
OTHER = {"cc-by": frozenset(b"noncommercial sharealike noderivatives noderivs non share no".split())}
#: Share of a template's words that must meet at one place, and how many words may be put in on each side of the phrase.
COVER, SHIFT = 0.8, 8
_WORD_BYTES = bytes(i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of any other bytes above 127."""
    return (text or b"").translate(_WORD_BYTES).split()


def in_order(a: list[bytes], b: list[bytes]) -> int:
    """How many words a and b have in common in the same order, at most."""
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


@dataclass
class Template:
    label: str
    words: list[bytes]
    must: list[bytes]
    base: bool = False
    at: int = field(init=False)

    def __post_init__(self):
        n = len(self.must)
        self.at = next(i for i in range(len(self.words)) if self.words[i : i + n] == self.must)

    def cover(self, found: list[bytes], key: int) -> float:
        """The share of the words that stand around the mandatory phrase at key; a single word on a side has one place."""
        end = key + len(self.must)
        if end < len(found) and found[end] in OTHER.get(self.label, ()):
            return 0.0
        before, after = self.words[: self.at], self.words[self.at + len(self.must) :]
        left, right = (len(side) + (SHIFT if len(side) > 1 else 0) for side in (before, after))
        n = in_order(before, found[max(0, key - left) : key]) + in_order(after, found[end : end + right])
        return (n + len(self.must)) / len(self.words)


def templates() -> list[Template]:
    split = lambda s: s.encode().split()
    return [Template(v, split(k), split(k), True) for k, v in BASE.items()] + [Template(k, split(t), split(m)) for k, t, m in [*((k, *v) for k, v in TEMPLATES.items()), *MORE]]


class Index:
    """Postings of the templates' words, and the words' weights: ln((n + 1) / (df + 1))."""

    def __init__(self, known: list[Template], n: int, df: dict[bytes, int]):
        self.templates = known
        self.vocabulary = frozenset(w for t in known for w in t.words)
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(known):
            for i, w in enumerate(t.words):
                self.postings[w].append((k, i))
        # of the words that a place of the template must have, the rarest
        self.anchor = [max(range(t.at, t.at + len(t.must)), key=lambda i: (self.idf[t.words[i]], -i)) for t in known]

    def scan(self, found: list[bytes]) -> tuple[dict[str, float], list[tuple[int, str]]]:
        """Labels with their best cover, and the places (start, label) of base phrases."""
        where: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(found):
            if w in self.vocabulary:
                where[w].append(i)
        best: dict[str, float] = {}
        places: list[tuple[int, str]] = []
        rare = sorted(where, key=lambda w: (-self.idf[w], w))
        for w in rare:
            for k, i in self.postings[w]:
                if self.anchor[k] != i or any(x not in where for x in self.templates[k].must):
                    continue
                t = self.templates[k]
                starts = {p - i for p in where[w]}
                if t.base:
                    for j, x in enumerate(t.words):
                        starts &= {p - j for p in where[x]} if j != i else starts
                    places += [(s, t.label) for s in starts]
                    if starts:
                        best[t.label] = 1.0
                    continue
                keys = [s + t.at for s in starts if s + t.at >= 0 and found[s + t.at : s + t.at + len(t.must)] == t.must]
                cover = max((t.cover(found, key) for key in keys), default=0.0)
                if cover >= COVER:
                    best[t.label] = max(best.get(t.label, 0.0), cover)
        return best, places


def build_index(docs: DataFrame) -> Index:
    """Counts in how many documents each template word stands, over all of docs: one row per partition and word
    that is found, summed; the result has at most a row for each word of the templates."""
    known = templates()
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches):
        n, df = 0, Counter()
        for b in pieces(batches):
            for t in utf8(b.column("text")):
                n += 1
                df.update(vocabulary.intersection(words(t)))
        keys = [b"", *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n, *df.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.word): r.n for r in rows}
    return Index(known, df.pop(b"", 0), df)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score: the best share of a template's words met in order at one place (1 for a base phrase, 0 without labels). Null text:
    empty, no labels (empty strings). Only doc_id and text are read. Empty table: no rows.
    """
    index = build_index(docs)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def row(doc, text):
        found = words(text)
        best, places = index.scan(found)
        starts = [p for p, _ in places]
        base = sorted({x for _, x in places})
        return doc, len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(best)), max(best.values(), default=0.0)

    def run(batches):
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
        for b in pieces(batches):
            got = list(zip(*map(row, b.column("doc_id").to_pylist(), utf8(b.column("text"))))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, map(list, got), kinds)), names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
