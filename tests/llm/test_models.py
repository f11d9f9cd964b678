import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtally.llm import discriminant, toxicity
from roadtally.llm.common import id_crc32
from tests.llm.conftest import SCHEMA, prose, row


def fold(n):
    return F.pmod(id_crc32(F.col("doc_id")), F.lit(n))


def test_fold_is_crc32_of_the_id(spark):
    got = [r[0] for r in spark.range(20).select(id_crc32(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) for i in range(20)]


def test_quality_learns_from_training_rows_only(spark):
    docs = [row(i, prose(i, 120)) if i % 2 else row(i, "### *** " * 40 + prose(i, 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2) for i in range(300)], "doc_id long, quality int")
    out = discriminant.score_quality(spark.createDataFrame(docs, SCHEMA), labels, fold(3) != 1).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out)


def test_quality_on_odd_rows(odd_docs, no_docs, some_labels):
    assert discriminant.score_quality(odd_docs, some_labels, fold(3) != 1).count() == odd_docs.count()
    assert discriminant.score_quality(no_docs, some_labels, fold(3) != 1).count() == 0
    none = discriminant.score_quality(odd_docs, some_labels.limit(0), fold(3) != 1).collect()
    assert {r.score for r in none} == {0.5}


def test_gradient():
    rng = np.random.default_rng(1)
    words = ["idiot", "the", "cat", "sat", "on", "mat", "dog"]
    net = toxicity.Network(words[:5], np.zeros(5, np.float32))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) + (rng.normal(0, 0.2, net.p[k].shape) if k in ("att", "out", "bias") else 0)
    at = np.array([[0, 1, 2, -1], [3, 4, 5, 6], [1, 2, -1, -1]])
    docs, labels = np.array([0, 2]), np.array([1.0, 0.0])
    _, grad = net.gradient(words, at, docs, labels)
    for k in ("att", "out", "bias", "xf", "ub", "cf", "word", "char"):
        for _ in range(3):
            place = tuple(rng.integers(0, n) for n in net.p[k].shape)
            if k == "char":
                place = (int(toxicity.trigrams(["cat"])[0][0]), place[1])
            if k == "word":
                place = (2, place[1])
            old, eps, value = net.p[k][place], 3e-3, []
            for s in (1, -1):
                net.p[k][place] = old + s * eps
                value.append(net.gradient(words, at, docs, labels)[0])
            net.p[k][place] = old
            assert (value[0] - value[1]) / (2 * eps) == pytest.approx(float(grad[k][place]), abs=2e-3)


def test_trigrams_of_a_batch_equal_those_of_each_word():
    words = ["", "a", "ab", "caña", "x" * 50]
    flat, sizes = toxicity.trigrams(words)
    assert sizes.tolist() == [max(1, len(w.encode()) + 2 - 2) for w in words]
    at = 0
    for w, n in zip(words, sizes):
        alone, one = toxicity.trigrams([w])
        assert one.tolist() == [n]
        if w:
            assert alone.tolist() == flat[at : at + n].tolist()
        at += n
    assert at == len(flat)


def toxic_rows():
    rows = []
    for i in range(240):
        words = prose(i, 90).split()
        if i % 3 == 0:
            words[i % 80] = words[(i * 7) % 90] = ("moron", "scum", "worthless")[i % 9 // 3]
        rows.append(row(i, " ".join(words)))
    return rows


def test_toxicity_learns_and_scores_held_out_rows(spark):
    docs = spark.createDataFrame(toxic_rows(), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels, fold(5) != 0).withColumn("held", fold(5) == 0).where("held").collect()
    assert len(out) > 20
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in out) / len(out)
    assert right >= 0.9


def test_scorer_does_not_depend_on_the_batch():
    net = toxicity.Network(["the0", "fox1"], np.zeros(2, np.float32))
    texts = [prose(i, 10 + 37 * i) for i in range(6)] + ["", None, "one"]
    whole = toxicity.Scorer(net).score(texts)[0]
    assert whole == pytest.approx([toxicity.Scorer(net).score([t])[0][0] for t in texts], abs=1e-5)


def test_scores_equal_a_plain_forward_pass():
    """One text at a time, one window at a time, one word at a time."""
    rng = np.random.default_rng(5)
    net = toxicity.Network(["the0", "fox1", "lazy7"], np.array([0.4, -0.3, 0.9], np.float32))
    for k in ("att", "out", "bias", "cf", "cb"):
        net.p[k] = rng.normal(0, 0.5, net.p[k].shape).astype(np.float32)
    net.shift = 0.3
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    logistic = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN

    def vector(word):
        plain = toxicity.normal(word)
        return np.r_[p["word"][net.index.get(plain, 0)], p["char"][toxicity.trigrams([plain])[0]].mean(axis=0)]

    def states(words, d):
        state, out = np.zeros(h), []
        for w in words if d == "f" else words[::-1]:
            x, own = vector(w) @ p[f"x{d}"] + p[f"c{d}"], state @ p[f"u{d}"]
            z, r = logistic(x[:h] + own[:h]), logistic(x[h : 2 * h] + own[h : 2 * h])
            state = (1 - z) * np.tanh(x[2 * h :] + r * own[2 * h :]) + z * state
            out.append(state)
        return out if d == "f" else out[::-1]

    texts = [prose(i, 3 + 29 * i) + " The0 fox1, lazy7!" for i in range(5)]
    got, top, many = toxicity.Scorer(net).score(texts)
    for text, score, peak, n in zip(texts, got, top, many):
        words, a, u, windows = text.split(), [], [], []
        for start in toxicity.window_starts(len(words)):
            own = words[start : start + toxicity.WINDOW]
            hidden = [np.r_[x, y] for x, y in zip(states(own, "f"), states(own, "b"))]
            wa, wu = np.array([x @ p["att"] for x in hidden]), np.array([x @ p["out"] for x in hidden])
            windows.append((np.exp(wa) * wu).sum() / np.exp(wa).sum())
            a.extend(wa)
            u.extend(wu)
        bias = p["bias"][0] + 0.3
        assert n == len(windows)
        assert score == pytest.approx(logistic((np.exp(a) * u).sum() / np.exp(a).sum() + bias), abs=1e-4)
        assert peak == pytest.approx(logistic(max(windows) + bias), abs=1e-4)


def test_sampled_rows_are_whole_and_bounded(spark):
    docs = spark.createDataFrame([row(i, prose(i, 40 + 25 * i)) for i in range(30)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    n = {tuple(prose(i, 40 + 25 * i).split()[:24]): len(toxicity.window_starts(40 + 25 * i)) for i in range(30)}
    for bound in (60, 100_000):
        got, y, _ = toxicity.training_sample(docs, labels, F.lit(True), "toxic", 20, bound)
        assert all(len(w) == n[tuple(w[0])] for w in got)
        assert all(sum(len(w) for w, k in zip(got, y) if k == label) <= bound for label in (0, 1)) and len(set(y)) == 2
    assert len(got) == 30


def test_rows_that_do_not_fit_leave_the_others():
    assert toxicity.fitting([(1, 0, 70), (2, 0, 40), (3, 0, 20), (4, 0, 10)], 100) == [(1, 1.0), (3, 1.0), (4, 1.0)]
    assert toxicity.fitting([(4, 1, 900), (6, 1, 500)], 100) == [(6, 5.0)] and toxicity.fitting([], 100) == []


def test_one_very_long_text_does_not_take_the_sample(spark):
    good, bad = "the calm river runs past green fields", "you vile rotten stupid fool be gone"
    texts = [f"{good} {i} and {i + 1}" if i % 2 == 0 else f"{bad} {i} and {i + 1}" for i in range(60)]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(100 + k, f"{bad} " * 30_000) for k in range(2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (101, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    windows, y, _ = toxicity.training_sample(docs, labels, F.lit(True), "toxic", 100, 1000)
    assert y.tolist().count(1) == 30 and max(map(len, windows)) == 1
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, F.lit(True), windows=1000).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2)) and got[100] > 0.5
    only = docs.where("doc_id >= 100 OR doc_id % 2 = 0")  # no toxic row fits
    windows, y, _ = toxicity.training_sample(only, labels, F.lit(True), "toxic", 100, 1000)
    assert y.tolist().count(1) == 1 and 900 <= max(map(len, windows)) <= 1000
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(only, labels, F.lit(True), windows=1000, epochs=1).collect())
    assert {r.score for r in toxicity.score_toxicity(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"), F.lit(True), epochs=1).collect()} != set()


def test_toxicity_on_odd_rows(odd_docs, no_docs, some_labels):
    out = toxicity.score_toxicity(odd_docs, some_labels, fold(5) != 0, epochs=1).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(no_docs, some_labels, fold(5) != 0).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd_docs, some_labels.limit(0), fold(5) != 0).collect()} == {0.5}


def test_discriminant_equals_direct_log_densities():
    """Class covariances from the rows themselves, shrunk, inverted and put into the Gaussian density without factors."""
    rng = np.random.default_rng(9)
    d = discriminant.DIM
    rows = {0: rng.normal(1, 2, (90, d)) @ rng.normal(0, 1, (d, d)), 1: rng.normal(0, 1, (40, d)) @ rng.normal(0, 1, (d, d)) + 1}
    model = discriminant.Discriminant.fit({k: (float(len(x)), x.sum(axis=0), x.T @ x) for k, x in rows.items()})
    every = np.vstack([rows[0], rows[1]])
    center, scale = every.mean(axis=0), every.std(axis=0)
    z = {k: (x - center) / scale for k, x in rows.items()}
    pooled = sum(len(x) * np.cov(x.T, bias=True) for x in z.values()) / len(every)
    logs, new = [], (rng.normal(0, 3, (25, d)) - center) / scale
    for k in (0, 1):
        trust = len(z[k]) / (len(z[k]) + 5 * d)
        c = trust * np.cov(z[k].T, bias=True) + (1 - trust) * pooled
        c = (1 - discriminant.SHRINK) * c + discriminant.SHRINK * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        away = new - z[k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ni,ij,nj->n", away, np.linalg.inv(c), away) + np.linalg.slogdet(c)[1]) + np.log(len(z[k])))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert model.scores(new * scale + center) == pytest.approx(want, abs=1e-9)
