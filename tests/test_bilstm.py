import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import bilstm, urls


def small(rng, characters=5, dims=4, units=3):
    return {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in bilstm.initial(characters, dims, units, rng).items()}


def plain(w, ids):
    """One URL's probabilities, a place and a unit at a time."""
    s = lambda z: 1 / (1 + np.exp(-z))
    units, last = len(w["left_state"]), []
    for end, way in (("left", ids), ("right", ids[::-1])):
        h, c = [0.0] * units, [0.0] * units
        for k in way:
            x, z = w["embedding"][k], []
            for j in range(4 * units):
                z.append(w[f"{end}_bias"][j] + sum(x[a] * w[f"{end}_in"][a][j] for a in range(len(x))) + sum(h[a] * w[f"{end}_state"][a][j] for a in range(units)))
            c = [s(z[units + u]) * c[u] + s(z[u]) * np.tanh(z[3 * units + u]) for u in range(units)]
            h = [s(z[2 * units + u]) * np.tanh(c[u]) for u in range(units)]
        last += h
    z = np.array(last) @ w["out"] + w["out_bias"]
    return np.exp(z) / np.exp(z).sum()


def test_forward_is_the_plain_loop():
    rng = np.random.default_rng(1)
    model = bilstm.Model("abcde", 6, small(rng))
    texts = ["abc", "", "eeeeee", "a?d", "abcdeabcde", None]
    got = model.probabilities(texts, rows=4)
    want = [plain(model.weights, [model.index.get(c, 0) for c in (t or "")[:6]])[1] for t in texts]
    assert np.allclose(got, want, atol=1e-6)


def test_gradients_are_differences():
    rng = np.random.default_rng(2)
    w, model = small(rng), bilstm.Model("abcde", 9, {})
    x, own = model.encode(["abca", "e", "dbbca?", ""])
    labels = np.array([0, 1, 1, 0])

    def run():
        return bilstm.forward(w, x, own, 0.3, np.random.default_rng(5))

    loss = lambda: -np.log(run()[0][np.arange(4), labels]).mean()
    found = bilstm.gradients(w, *(lambda p, cache: (p, labels, cache))(*run()))
    assert found.keys() == w.keys()
    for name, g in found.items():
        for at in np.ndindex(g.shape):
            before = w[name][at]
            w[name][at] = before + 1e-5
            up = loss()
            w[name][at] = before - 1e-5
            down = loss()
            w[name][at] = before
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, (name, at)


def test_train_score_save(spark, tmp_path):
    data = [(f"http://good{i}.example.org/page", 0) for i in range(60)] + [(f"http://x{i}.evil.ru/login.exe?q=%00", 1) for i in range(60)]
    odd = [(None, 1), ("", 0), ("http://no.label/", None), *data[:1] * 500]
    model, held = urls.train_bilstm(spark.createDataFrame(data + odd, "url string, label int"), dims=16, units=8, rate=0.01, epochs=20)
    known = held.filter("url <> '' and label is not null")
    assert known.filter((F.col("label") == 1) == F.col("malicious_warning")).count() >= 0.9 * known.count()
    assert len(model.history) == 20 and model.history[-1]["loss"] < model.history[0]["loss"]
    for _ in range(2):
        urls.save(model, str(tmp_path / "m"), urls.metrics(known), spark)
    again = urls.load(str(tmp_path / "m"), spark)
    assert again.characters == model.characters and again.length == model.length and all(np.array_equal(v, again.weights[k]) for k, v in model.weights.items())
    assert np.allclose([h["loss"] for h in again.history], [h["loss"] for h in model.history])
    asked = spark.createDataFrame([("http://z.evil.ru/login.exe?q=%00", 1), ("http://goodz.example.org/page", 2), ("x" * 5000, 3), (None, 4), ("", 5)], "url string, n int")
    got = {r.n: r.malicious_warning for r in urls.score(again, asked).collect()}
    assert got[1] and not got[2] and got[4] == got[5] and len(got) == 5
    assert urls.score(again, asked.limit(0)).count() == 0
    assert urls.classify(again, asked.filter("n < 3")).filter("verdict = 'bad'").first().n == 1
    assert spark.read.parquet(str(tmp_path / "m/history")).count() == 2


def test_no_rows(spark):
    model, held = urls.train_bilstm(spark.createDataFrame([], "url string, label int"), dims=4, units=2)
    assert held.count() == 0 and model.history == [] and len(model.probabilities(["a", None])) == 2
