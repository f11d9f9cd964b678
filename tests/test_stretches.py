"""Repeated crossings, clocks and twins against plain walks through each video."""

import math
import random

import pytest

from roadtally.operators import tracks


@pytest.mark.parametrize("seed", range(4))
def test_repeated_crossings_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        frame = None if rng.random() < 0.03 else rng.choice([rng.randint(0, 60), rng.randint(0, 4000)])
        rows.append((i, rng.choice([1, 2]), rng.choice([1, 1, 1, None]), rng.randint(0, 9) * 1000 + i, frame, rng.choice([None, *map(float, range(0, 60, 4))]), 960.0 + rng.choice([0, 5, 40]), rng.choice([None, 20.0, 60.0, 100.0])))
    df = spark.createDataFrame(rows, "id int, job_id int, lane_id int, track_id int, frame int, gx double, gy double, height double")
    want = []
    for line in {(r[1], r[2]) for r in rows}:
        taken = []
        for i, _, _, _, f, x, y, h in sorted((r for r in rows if (r[1], r[2]) == line), key=lambda r: (r[4] is not None, r[4] or 0, r[3])):
            known = None not in (f, x, y, h)
            if not (known and any(f - a <= 5 and abs(x - b) <= max(6, 0.2 * max(h, d)) and abs(y - c) <= max(6, 0.2 * max(h, d)) for a, b, c, d in taken)):
                want.append(i)
                if known:
                    taken.append((f, x, y, h))
    got = tracks.drop_repeated_crossings(df)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want) and len(want) < 300
    assert tracks.drop_repeated_crossings(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_clock_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([None, *[float(i // 10 * 2 - rng.choice([0, 0, 3]))] * 9]), rng.choice([20.0, 20.0, 10.0, None] if seed == 3 else [20.0, 10.0])) for i in range(200)]
    got = {(r.job_id, r.frame): r.at for r in tracks.monotonic_clock(spark.createDataFrame(rows, "job_id long, frame long, s double, fps double")).collect()}
    want = {}
    for job in (1, 2, None):
        at = None
        for _, f, s, fps in sorted((r for r in rows if r[0] == job), key=lambda r: r[1]):
            at = s if at is None or s is not None and s > at else None if fps is None else at + 1 / fps
            want[job, f] = at
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


def test_twins_of_all_videos_are_joined_at_once(spark):
    pairs = [(1, 5, 9), (1, 3, 5), (1, 20, 21), (2, 9, 5), (2, 7, 8), (2, 8, 9)]
    got = tracks.twin_groups(spark.createDataFrame(pairs, "job_id long, a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 3), (1, 5, 3), (1, 9, 3), (1, 20, 20), (1, 21, 20), (2, 5, 5), (2, 7, 5), (2, 8, 5), (2, 9, 5)]
    assert tracks.twin_groups(spark.createDataFrame([], "job_id long, a long, b long")).count() == 0
