"""Paths are resampled and held against templates in blocks of rows, not row by row."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadtally.operators import regions, shapes, tracks, trajectories
from roadtally.sources import sinks


def test_arrays_are_resampled_as_the_column_expression_does(spark):
    draw = np.random.default_rng(5)
    rows = [(k, *[draw.normal(0, 50, n).cumsum().tolist() for _ in range(2)], draw.uniform(5, 90, n).tolist()) for k, n in enumerate(draw.integers(0, 60, 120))]
    rows += [(200, [1.0] * 6, [2.0] * 6, [3.0] * 6), (201, None, [1.0], [1.0]), (202, [1.0, 2.0], [1.0], [1.0, 1.0]), (203, [1.0, 1.0, 4.0], [0.0, 0.0, 0.0], [1.0, 2.0, 3.0])]
    rows += [(204, [1.0, None, 5.0], [0.0, 1.0, 2.0], [1.0] * 3), (205, [None, 1.0, 2.0, 3.0, 4.0, 5.0], [0.0] * 6, [1.0] * 6), (206, [0.0, 9.0], [0.0, 0.0], [None, 2.0])]
    df = spark.createDataFrame(rows, "id long, xs array<double>, ys array<double>, hs array<double>")
    want = {r.id: r.p for r in df.select("id", shapes.resampled(F.col("xs"), F.col("ys"), F.col("hs"), 16).alias("p")).where("p IS NOT NULL").collect()}
    held, x, y, h = shapes.resampled_arrays(*[pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (1, 2, 3)], 16)
    got = {rows[r][0]: (x[i], y[i], h[i]) for i, r in enumerate(held)}
    assert set(got) == set(want)
    for k, p in want.items():
        for values, c in zip(got[k], "xyh"):
            assert values == pytest.approx([np.nan if q[c] is None else q[c] for q in p], abs=1e-9, nan_ok=True)


def test_movements_equal_every_path_against_every_example():
    draw = np.random.default_rng(9)
    x, y = draw.uniform(0, 300, (700, 1)) + np.zeros(16), draw.uniform(0, 30, (700, 1)) + np.linspace(0, 200, 16) * draw.choice([-1, 1], (700, 1))
    h = draw.uniform(5, 120, (700, 16))
    lines = np.stack([np.stack([np.full(32, float(v)), np.linspace(-200, 200, 32) * w], axis=1).ravel() for v in (20, 25, 150, 290) for w in (1, -1)])
    movements = [1, 1, 1, 2, 2, 2, 3, 3]
    got = {m: dict(zip(rows, values.T.tolist())) for m, rows, values in trajectories.fits(x, y, h, movements, lines, 1.0)}
    for m in (1, 2, 3):
        each = []
        for line in lines[[k for k, v in enumerate(movements) if v == m]]:
            gap, way = trajectories.nearest_places((line[None, ::2], line[None, 1::2]), (x, y))
            each.append(list(zip((gap / h).max(axis=1), way[:, 0], way[:, -1], (np.diff(way, axis=1) >= trajectories.BACKWARD).mean(axis=1))))
        want = {i: list(min(e)) for i, e in enumerate(zip(*each)) if min(e)[0] <= 1}
        assert 0 < len(want) < 700 and got[m] == want


def test_many_paths_take_seconds(spark):
    """60 000 paths of ten points took over a millisecond each in expressions, and each example again."""
    xs = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i * 0 + F.col("id") % 50).cast("double"))
    paths = spark.range(0, 60_000, 1, 4).select((F.col("id") % 3).alias("project_id"), "id", xs.alias("xs"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * 20.0).alias("ys"), F.lit(60.0).alias("height"))
    lines = [(s, 1, m, 20, [float(v) for k in range(32) for v in (m * 10.0 + e, 6.0 * k)]) for s in range(3) for m in range(4) for e in range(12)]
    templates = spark.createDataFrame(lines, "project_id long, origen_id long, destino_id long, n long, points array<double>")
    began = time.time()
    assert trajectories.assigned_paths(paths, templates).count() == 60_000
    assert trajectories.resampled_paths(paths.withColumnsRenamed({"project_id": "job_id", "id": "track_id"})).count() == 60_000 * 32
    assert time.time() - began < 60


def test_tasks_do_not_grow_with_the_table(spark):
    """Windows by track were dealt over the session's partitions at every size."""
    rows = spark.range(0, 1_300_000, 1, 4).select((F.col("id") % 7).alias("job_id"), F.floor(F.col("id") / 5).alias("track_id"), (F.col("id") % 5).alias("frame"), F.when(F.col("id") % 5 == 0, 1).alias("access"))
    assert sinks.dealt(rows, "job_id", "track_id", rows=100_000).rdd.getNumPartitions() == 13
    assert sinks.dealt(rows.limit(10), "job_id", "track_id").rdd.getNumPartitions() == 4
    plan = tracks.origins_destinations(rows)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_points_are_not_dealt_by_site(spark):
    rows = spark.range(0, 5000, 1, 4).select((F.col("id") % 7).alias("job_id"), F.floor(F.col("id") / 5).alias("track_id"), (F.col("id") % 5).alias("frame"))
    points = rows.select(F.lit(1).alias("project_id"), "job_id", "track_id", "frame", (F.col("frame") * 400.0).alias("gx"), F.lit(5.0).alias("gy"))
    assert "SortMergeJoin" not in regions.track_ends(points, 1920, 1080)._jdf.queryExecution().executedPlan().toString()
