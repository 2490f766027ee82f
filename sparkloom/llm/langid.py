"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated rejection.

Subwords are the 2 to 4 byte pieces of the lower-cased words, with their edges, hashed to BUCKETS. The model is linear
after averaging, so embedding and softmax weights fold into one table for prediction (BUCKETS x languages).
Training takes a sample, by a hash of doc_id: SAMPLE documents in all, about, and PER_LANGUAGE of each label at most;
the more labels there are, the fewer of each, and none is left out as long as there are no more labels than that. A
sampled document is held by the TOP subwords that fill most of it. These bound what comes to the driver, to SAMPLE *
TOP * 6 bytes (300 MB); every text, of any length, is predicted whole.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import written
from .common import pieces, rows_apart, unpacked

BUCKETS, DIMS, EPOCHS, RATE = 1 << 14, 16, 12, 0.5
#: Documents that are sampled for training, in all and of each label, about, and subwords of each at most.
SAMPLE, PER_LANGUAGE, TOP = 12_000, 400, 1 << 12
#: Of clean labelled documents, so many may score below the rejection threshold, which is never above MOST_REJECT.
FALSE_REJECTS, MOST_REJECT = 0.002, 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_EDGE = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def subword_ids(text: str) -> np.ndarray:
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_EDGE) + b" ", np.uint8).astype(np.uint32)
    edge = a == 32
    found = []
    h = a
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(257) + a[n - 1 :]
        ok = ~(edge[:-1] & edge[1:]) if n == 2 else ~edge[1:-1] if n == 3 else ~(edge[1:-2] | edge[2:-1])
        mixed = (h[ok] + np.uint32(n)) * np.uint32(2654435761)
        found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(18))
    return np.concatenate(found)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals that are no digits, such as a half, are none."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(text: str, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Subwords and their shares of a text, of the most frequent ones."""
    ids, n = np.unique(subword_ids(text), return_counts=True)
    if len(ids) > top:
        most = np.sort(np.lexsort((ids, -n))[:top])
        ids, n = ids[most], n[most]
    return ids.astype(np.uint16), (n / n.sum()).astype(np.float32)


class Model:
    """table: BUCKETS x languages, bias and threshold; scores are probabilities at the calibrated temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, ids: np.ndarray, share: np.ndarray) -> np.ndarray:
        return share @ self.table[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, rejected. A null text or one without letters is UNKNOWN, and rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        n = np.bincount(subword_ids(text), minlength=BUCKETS)
        p = softmax((n @ self.table / n.sum() + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def step(e: np.ndarray, w: np.ndarray, bias: np.ndarray, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent on a text's cross entropy, in place. Embeddings move by their share relative to
    the largest one, so that those of long texts learn as fast."""
    h = share @ e[ids]
    g = softmax(h @ w + bias)
    g[label] -= 1
    back = w @ g
    w -= rate * np.outer(h, g)
    bias -= rate * g
    e[ids] -= rate * np.outer(share / share.max(), back)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: label, ids, shares. A fifth of them calibrates temperature and threshold and trains nothing."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    at, rng = {x: i for i, x in enumerate(languages)}, np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[: len(rows) // 5]]
    train = [rows[i] for i in order[len(held) :]]
    e, w, bias = rng.normal(0, 0.1, (BUCKETS, DIMS)), np.zeros((DIMS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            label, ids, share = train[i]
            step(e, w, bias, ids, share, at[label], RATE * (1 - done / steps))
            done += 1
    model = Model(languages, (e @ w).astype(np.float64), bias)
    logits = [(model.logits(i, s), at[x]) for x, i, s in held]
    if logits:
        loss = lambda t: -sum(np.log(max(softmax(z / t)[k], 1e-12)) for z, k in logits)
        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        right = [softmax(z / model.temperature).max() for z, k in logits if z.argmax() == k]
        model.threshold = min(MOST_REJECT, float(np.quantile(right, FALSE_REJECTS))) if right else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learns from text and lang of documents that are not held out. Rows without lang, doc_id or letters are left
    out."""
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    labelled = named.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    counts = written(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    labels = counts.count()
    if not labels:
        return fit([])
    each = min(PER_LANGUAGE, SAMPLE / labels)
    rates = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    likely = labelled.withColumn("chance", chance)
    drawn = likely.join(F.broadcast(rates) if labels <= SAMPLE else rates, "lang").filter("chance < rate").select("lang", "text")

    def run(batches):
        for b in pieces(batches):
            rows = [(x, *features(t)) for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["lang", "ids", "share"])

    sample = drawn.mapInArrow(run, "lang string, ids binary, share binary").collect()  # see SAMPLE and TOP
    return fit(sorted(((r.lang, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.share, np.float32)) for r in sample), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))


def identify(rows: DataFrame, text: Column, model: Model) -> DataFrame:
    """rows (row, and any columns beside it) with lang_pred, score and rejected of a text."""

    def run(batches):
        for b in pieces(batches):
            found = list(map(model.predict, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    given = rows.select("row", text.alias("text"))
    return given.mapInArrow(run, given.select("row").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row, in one pass after training.

    lang, source and doc_id are no inputs of a prediction. A null doc_id is not held out and trains nothing; repeated
    rows each are predicted. A text that is null or has no letter, or any text if no label can be learned from:
    lang_pred und, score 0, rejected. Texts of any length are read whole. Other columns are not read. Empty table: no
    rows.
    """
    rows = docs.select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text"))
    out = identify(rows, F.col("text"), train(docs))
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those that the model rejects; the same columns, whatever their names, with their own values.
    Nulls, empty and long texts, repeated rows and empty tables as in language_report: rows without letters go."""
    rows = rows_apart(docs)
    return unpacked(identify(rows, F.col("row.text"), train(docs)).filter("not rejected"), docs.columns)
