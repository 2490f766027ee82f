"""A bidirectional LSTM over the characters of URLs, in numpy.

Characters are embedded, read by one LSTM from each end, and the two last states go to a softmax over two classes. The
steps are the published ones of LSTMs with a forget gate; places behind a URL's end change no state. Training is on the
driver, by RMSprop, over a sample of distinct labelled URLs that is bounded (`rows` and `length` of `train`). Scoring is
an Arrow UDF that carries the weights, a few hundred kB, to the tables or streams that it scores.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the embedding and of a direction's state, share dropped, rows of a step, passes, rate, decay.
DIMS, UNITS, DROP, BATCH, EPOCHS, RATE, DECAY = 100, 64, 0.2, 64, 30, 0.001, 0.9
#: Distinct URLs that are learned from, about, and characters of a URL that are read, at most.
ROWS, LENGTH = 20_000, 256


class Model:
    """characters: those that have an index, from 1 on; 0 is any other. weights: arrays by name. history: a dict for
    each pass, with loss and accuracy."""

    def __init__(self, characters: str, length: int, weights: dict[str, np.ndarray], history: list[dict] | None = None):
        self.characters, self.length, self.weights, self.history = characters, length, weights, history or []
        self.index = {c: i for i, c in enumerate(characters, 1)}

    def encode(self, urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indices, and which places are a URL's own; as wide as the longest of them."""
        cut = [(u or "")[: self.length] for u in urls]
        wide = max(1, max(map(len, cut), default=1))
        x, own = np.zeros((len(cut), wide), np.int64), np.zeros((len(cut), wide), bool)
        for i, u in enumerate(cut):
            x[i, : len(u)] = [self.index.get(c, 0) for c in u]
            own[i, : len(u)] = True
        return x, own

    def probabilities(self, urls: list[str | None], rows: int = 512) -> np.ndarray:
        """Of the second class, for each URL. Those of like length are computed together."""
        out, order = np.zeros(len(urls)), np.argsort([len(u or "") for u in urls], kind="stable")
        for a in range(0, len(urls), rows):
            at = order[a : a + rows]
            out[at] = forward(self.weights, *self.encode([urls[i] for i in at]))[0][:, 1]
        return out


def initial(characters: int, dims: int, units: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    spread = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    w = {"embedding": rng.uniform(-0.05, 0.05, (characters + 1, dims)), "out": spread(2 * units, 2), "out_bias": np.zeros(2)}
    for end in ("left", "right"):
        bias = np.zeros(4 * units)
        bias[units : 2 * units] = 1  # forget gates start open
        w |= {f"{end}_in": spread(dims, 4 * units), f"{end}_state": spread(units, 4 * units), f"{end}_bias": bias}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _read(x, own, w_in, w_state, bias, kept):
    """The last state of an LSTM over x (rows, places, dims), and what its way back needs. kept: dropout of states."""
    n, places, units = len(x), x.shape[1], len(w_state)
    given = x @ w_in + bias
    h, c, steps = np.zeros((n, units), x.dtype), np.zeros((n, units), x.dtype), []
    for t in range(places):
        z = given[:, t] + (h * kept) @ w_state
        gates, new = _sigmoid(z[:, : 3 * units]), np.tanh(z[:, 3 * units :])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        c_next = f * c + i * new
        squashed, here = np.tanh(c_next), own[:, t, None]
        steps.append((h, c, i, f, o, new, squashed, here))
        h, c = np.where(here, o * squashed, h), np.where(here, c_next, c)
    return h, steps


def _back(dh, x, w_in, w_state, kept, steps):
    """Gradients of x, w_in, w_state and bias from that of the last state."""
    dc, dz_all, d_state = np.zeros_like(dh), np.zeros((*x.shape[:2], w_in.shape[1]), x.dtype), np.zeros_like(w_state)
    for t in range(len(steps) - 1, -1, -1):
        h, c, i, f, o, new, squashed, here = steps[t]
        dh_own, dc_own = np.where(here, dh, 0), np.where(here, dc, 0)
        dc_own = dc_own + dh_own * o * (1 - squashed**2)
        dz = np.concatenate([dc_own * new * i * (1 - i), dc_own * c * f * (1 - f), dh_own * squashed * o * (1 - o), dc_own * i * (1 - new**2)], axis=1)
        dz_all[:, t] = dz
        d_state += (h * kept).T @ dz
        dh = np.where(here, 0, dh) + (dz @ w_state.T) * kept
        dc = np.where(here, 0, dc) + dc_own * f
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return dz_all @ w_in.T, x.reshape(-1, x.shape[2]).T @ flat, d_state, flat.sum(0)


def forward(w: dict[str, np.ndarray], x: np.ndarray, own: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None):
    """Probabilities of the classes, and what gradients() needs. drop: share of the embedding's dimensions, of each
    LSTM's inputs and of its states that are left out in a row, at all of its places."""
    keep = lambda size: ((rng.random((len(x), 1, size)) >= drop) / (1 - drop)).astype(np.float32) if drop else np.ones((1, 1, size), np.float32)
    dims, units = w["embedding"].shape[1], len(w["left_state"])
    spatial, parts, last = keep(dims), {}, []
    embedded = w["embedding"][x] * spatial
    for end, way in (("left", 1), ("right", -1)):
        kept_in, kept = keep(dims), keep(units)[:, 0]
        seen = (embedded * kept_in)[:, ::way]
        h, steps = _read(seen, own[:, ::way], w[f"{end}_in"], w[f"{end}_state"], w[f"{end}_bias"], kept)
        parts[end] = (seen, kept_in, kept, steps, way)
        last.append(h)
    state = np.concatenate(last, axis=1)
    z = state @ w["out"] + w["out_bias"]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True), (x, spatial, parts, state)


def gradients(w: dict[str, np.ndarray], p: np.ndarray, labels: np.ndarray, cache) -> dict[str, np.ndarray]:
    """Of the mean cross entropy."""
    x, spatial, parts, state = cache
    dz = (p - np.eye(2, dtype=p.dtype)[labels]) / len(labels)
    units, g = len(w["left_state"]), {"out": state.T @ dz, "out_bias": dz.sum(0), "embedding": np.zeros_like(w["embedding"])}
    d_state, d_embedded = dz @ w["out"].T, 0
    for k, (end, (seen, kept_in, kept, steps, way)) in enumerate(parts.items()):
        d_seen, g[f"{end}_in"], g[f"{end}_state"], g[f"{end}_bias"] = _back(d_state[:, k * units : (k + 1) * units], seen, w[f"{end}_in"], w[f"{end}_state"], kept, steps)
        d_embedded = d_embedded + d_seen[:, ::way] * kept_in
    np.add.at(g["embedding"], x, d_embedded * spatial)
    return g


def fit(rows: list[tuple[str, int]], length: int = LENGTH, dims: int = DIMS, units: int = UNITS, drop: float = DROP, batch: int = BATCH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 42) -> Model:
    """rows: URLs and labels, 0 or 1. Rows of a step have like lengths; steps come in random order."""
    rng = np.random.default_rng(seed)
    characters = "".join(sorted({c for u, _ in rows for c in u[:length]}))
    model = Model(characters, length, initial(len(characters), dims, units, rng))
    w, mean = model.weights, {k: np.zeros_like(v) for k, v in model.weights.items()}
    for _ in range(epochs if rows else 0):
        order = sorted(rng.permutation(len(rows)), key=lambda i: min(len(rows[i][0]), length) // 8)
        steps, loss, right = [order[a : a + batch] for a in range(0, len(order), batch)], 0.0, 0
        for k in rng.permutation(len(steps)):
            some = [rows[i] for i in steps[k]]
            labels = np.array([y for _, y in some])
            p, cache = forward(w, *model.encode([u for u, _ in some]), drop, rng)
            loss -= float(np.log(np.maximum(p[np.arange(len(some)), labels], 1e-7)).sum())
            right += int((p.argmax(1) == labels).sum())
            for name, g in gradients(w, p, labels, cache).items():
                mean[name] = DECAY * mean[name] + (1 - DECAY) * g**2
                w[name] -= (rate * g / (np.sqrt(mean[name]) + 1e-7)).astype(np.float32)
        model.history.append({"loss": loss / len(rows), "accuracy": right / len(rows)})
    return model


def train(urls: DataFrame, url: str = "url", label: str = "label", rows: int = ROWS, length: int = LENGTH, seed: int = 42, **sizes) -> tuple[Model, DataFrame]:
    """The model from 80 % of urls, and its predictions on the rest. Where there are more than `rows` distinct URLs,
    a sample of about that many is drawn by a hash. A URL of both labels counts once for each; rows without URL or
    label, or with an empty URL, train nothing."""
    given, held = urls.select(url, label).randomSplit([0.8, 0.2], seed)
    some = given.filter(F.col(label).isNotNull() & (F.length(url) > 0)).select(F.substring(url, 1, length).alias("u"), (F.col(label) == 1).cast("int").alias("y")).distinct()
    rate = min(1.0, rows / max(1, some.count()))
    drawn = some.filter(F.pmod(F.xxhash64(F.lit(seed), "u", "y"), F.lit(1 << 30)) < rate * (1 << 30)).collect()  # see rows and length
    model = fit(sorted((r.u, r.y) for r in drawn), length, seed=seed, **sizes)
    return model, score(model, held, url)


def score(model: Model, urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with malicious_warning; streams as well. A null URL is an empty one."""

    @F.pandas_udf("boolean")
    def bad(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.probabilities([None if u is None else str(u) for u in b]) > 0.5)

    return urls.withColumn("malicious_warning", bad(F.col(url)))


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Weights, with the history of their training, as one Parquet table. It replaces what is there."""
    rows = [(k, list(v.shape), bytearray(v.astype("<f4").tobytes()), None) for k, v in model.weights.items()]
    rows += [("length", [model.length], None, model.characters)]
    rows += [(f"history_{k}", [i], bytearray(np.array(v, "<f4").tobytes()), None) for i, h in enumerate(model.history) for k, v in h.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary, text string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    found = spark.read.parquet(path).collect()  # a row for each array and pass
    (size,) = [r for r in found if r.name == "length"]
    weights = {r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r["shape"]).copy() for r in found if r.data and not r.name.startswith("history_")}
    passes: dict[int, dict] = {}
    for r in found:
        if r.name.startswith("history_"):
            passes.setdefault(r["shape"][0], {})[r.name[8:]] = float(np.frombuffer(bytes(r.data), "<f4")[0])
    return Model(size.text, size["shape"][0], weights, [passes[i] for i in sorted(passes)])
