import math

import numpy as np
import pytest

from roadtally.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, fold int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in vectors], SCHEMA).repartition(3)


def exact(vectors, k):
    """Every query against every candidate."""
    real = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(real):
        if i is not None and i % 20 == 0:
            found = sorted((-float((v * w).sum()), j is None, j or 0) for b, (j, w) in enumerate(real) if b != at and len(w) == len(v))
            out.setdefault(i, []).append([(s, None if none else j) for s, none, j in found[:k]])
    return out


def got(spark, vectors, k=20, **how):
    out = {}
    for r in nb.nearest(table(spark, vectors), nb.F.col("vec_id") % 20 == 0, k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def drawn(kind, n, dim, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dim))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clusters":
        x = x * 0.2 + draw.standard_normal((10, dim))[draw.integers(0, 10, n)]
    if kind == "norms":
        x *= np.exp(draw.standard_normal(n) * 2)[:, None]
    return [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind,dim", [("unit", 16), ("unit", 64), ("clusters", 32), ("norms", 24)])
def test_recall(spark, monkeypatch, kind, dim):
    monkeypatch.setattr(nb, "BLOCK", 500)
    monkeypatch.setattr(nb, "GROUP", 30)
    vectors = drawn(kind, 2000, dim)
    want, found = exact(vectors, 20), got(spark, vectors)
    assert found.keys() == want.keys()
    hits = 0
    for q, (true,) in want.items():
        assert [r for r, _, _ in found[q]] == list(range(1, 21)) and q not in {v for _, v, _ in found[q]}
        assert [s for _, _, s in found[q]] == sorted((s for _, _, s in found[q]), reverse=True)
        hits += len({v for _, v, _ in found[q]} & {v for _, v in true})
    assert hits >= 0.95 * 20 * len(want)


def test_threshold_and_reach():
    assert nb.threshold(48, 0.85) == 41
    draw = np.random.default_rng(3)
    far = nb.reach(48, 41, 0.98)
    inside = (np.abs(draw.standard_normal((20_000, 48))) <= far).sum(1) >= 41
    assert abs(inside.mean() - 0.98) < 0.005


def test_windows_count_each_vector_once():
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((300, 8))
    block = nb.Block(vectors)
    for i in range(nb.PROJECTIONS):
        assert sorted(block.order[i].tolist()) == list(range(300)) and (np.diff(block.sorted[i]) >= 0).all()
    # with every array needed and no early end, all vectors are verified
    places, scores = next(block.search(vectors[:1], 299, nb.PROJECTIONS, 1e9, np.array([0])))
    assert sorted(places.tolist()) == list(range(1, 300)) and np.allclose(sorted(scores), sorted(vectors[1:] @ vectors[0]))


def test_ties_copies_and_bad_vectors(spark):
    vectors = drawn("unit", 60, 8)
    vectors += [(100 + i, vectors[3][1]) for i in range(50)]  # one vector very often
    vectors += [(200, None), (220, []), (240, [0.0] * 8), (260, [None] + [1.0] * 7), (280, [float("nan")] * 8), (300, [float("inf")] * 8), (None, vectors[5][1]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (20, vectors[7][1]), (400, vectors[3][1])]
    want, found = exact(vectors, 20), got(spark, vectors)
    assert found.keys() == want.keys() and not {200, 220, 240, 260, 280, 300} & found.keys()
    assert [v for _, v, _ in found[320]] == [321] and found[320][0][2] == 4.0
    for q, lists in want.items():
        rows = sorted((-s, v is None, v or 0) for _, v, s in found[q])
        true = sorted((s, v is None, v or 0) for one in lists for s, v in one)
        assert len(rows) == len(true) and np.allclose([r[0] for r in rows], [t[0] for t in true])
    assert [v for _, v, _ in found[100]][:3] == [3, 101, 102]


def test_few_and_no_vectors(spark):
    assert got(spark, [(0, [1.0, 0.0])]) == {}
    assert got(spark, [(0, [1.0, 0.0]), (7, [0.5, 0.5])]) == {0: [(1, 7, 0.5)]}
    assert nb.nearest(table(spark, [(1, [1.0])]).limit(0), nb.F.col("vec_id") % 20 == 0, 20).count() == 0
