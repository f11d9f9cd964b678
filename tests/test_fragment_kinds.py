"""Joined pieces: kinds of equal pieces, and the single pass over points, against the plain steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtally.operators import fragments, geometry, tracks
from roadtally.operators.assign import FORBIDDEN, assign, shared_out

POINTS = "job_id long, track_id long, frame int, gx double, gy double, h double, access int"


def plain_ends(points, moved):
    boxes = points.withColumn("y1", F.lit(0.0)).withColumn("y2", F.col("h"))
    alive = geometry.moved(boxes, moved).where("moved").select("job_id", "track_id")
    rows = points.join(alive, ["job_id", "track_id"])
    return fragments.piece_ends(rows).join(tracks.origins_destinations(rows).select("job_id", "track_id", "destination"), ["job_id", "track_id"])


@pytest.mark.parametrize("batch", [7, 10_000])
def test_ends_in_one_pass_equal_the_plain_steps(spark, batch):
    """Nulls anywhere, short stays in the centre, pieces of one point, still ones, and tracks that go on over batches."""
    draw = np.random.default_rng(3)
    maybe = lambda v, share: None if draw.random() < share else v
    rows = []
    for job in (1, 2):
        for track in range(60):
            share, n = float(draw.choice([0.0, 0.0, 0.3, 1.0], p=[0.4, 0.2, 0.35, 0.05])), int(draw.integers(1, 40))
            where, access = 0.0, None
            for frame in draw.choice(200, n, replace=False):
                access = access if draw.random() < 0.7 else [None, 1, 2][int(draw.integers(0, 3))]
                where += float(draw.integers(0, 3))
                rows.append((job, track, maybe(int(frame), share / 20), maybe(where, share), maybe(float(draw.integers(0, 9)), share), maybe(float(draw.integers(1, 30)), share), access))
    seen = set()
    rows = [r for r in rows if r[2] is not None or (r[:2] not in seen and not seen.add(r[:2]))]  # one null frame a track: their order is open
    rows += [(None, 1, 1, 1.0, 1.0, 1.0, 1), (1, None, 1, 1.0, 1.0, 1.0, 1)]
    points = spark.createDataFrame(rows, POINTS)
    columns = ["job_id", "track_id", "n", "destination", *fragments.ENDS]
    value = lambda v: None if v is None else round(float(v), 9)
    table = lambda df: {(r.job_id, r.track_id): tuple(value(r[c]) for c in columns) for r in df.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = table(fragments.moving_ends(points, 0.5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = table(plain_ends(points, 0.5))
    assert got == want and 20 < len(got) < 120
    assert fragments.moving_ends(points.limit(0), 0.5).count() == 0


def test_groups_are_shared_out_at_least_cost():
    draw = np.random.default_rng(1)
    for _ in range(300):
        n, m = draw.integers(1, 7, 2)
        cost = np.where(draw.random((n, m)) < draw.choice([0.3, 0.6, 1]), np.round(draw.normal(0, 1, (n, m)), draw.integers(0, 4)), FORBIDDEN)
        na, nb = draw.integers(1, 4, n), draw.integers(1, 4, m)
        i, j = np.nonzero(cost < FORBIDDEN)
        got = shared_out(i.tolist(), j.tolist(), cost[i, j].tolist(), na[i].tolist(), nb[j].tolist())
        each = np.repeat(np.repeat(cost, na, 0), nb, 1)
        want = assign(each)
        assert sum(k for *_, k in got) == len(want) and abs(sum(k * cost[a, b] for a, b, k in got) - sum(each[p] for p in want)) < 1e-6
        assert all(sum(k for a, _, k in got if a == r) <= na[r] for r in range(n)) and all(sum(k for _, b, k in got if b == c) <= nb[c] for c in range(m))


def test_equal_pieces_make_no_more_candidates(spark, monkeypatch):
    """Copies of a piece had a candidate with every copy of the next one, so their number grew with the square of the copies."""
    one = [(1, t, f, 0.0, 10.0 * f, 10.0, None) for t, fs in ((1, range(0, 6)), (5000, range(7, 13))) for f in fs]
    rows = [(job, t + k, *rest) for k in range(40) for job, t, *rest in one]
    rows += [(1, 9000, f, 0.0, 10.0 * f, 10.0, None) for f in range(8, 14)]  # one more start, one frame later
    df = spark.createDataFrame(rows, POINTS).withColumn("y2", F.col("h")).withColumn("y1", F.lit(0.0))
    made = []
    inner = fragments.joined_kinds
    monkeypatch.setattr(fragments, "joined_kinds", lambda c: (made.append(c.count()), inner(c))[1])
    got = sorted((r.track_id, r.chain, r.place) for r in fragments.chains_of_points(df, 10.0).collect())
    assert got == sorted(x for k in range(40) for x in ((1 + k, 1 + k, 0), (5000 + k, 1 + k, 1)))
    assert made == [2]


def copied_events(spark, copies, place):
    from roadtally.plans.fixtures import Fixtures

    events = Fixtures(spark, "/root/testdata/sf0.001").table("events")
    rows = events.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
    shifted = rows.withColumn("event_id", F.col("event_id") + F.col("copy") * 100_000).withColumn("user_id", F.col("user_id") + F.col("copy") * 1500)
    shifted.select(events.columns).write.parquet(f"{place}/events.parquet")
    return place


@pytest.mark.parametrize("name", ["q149_counts_by_trajectory", "q151_segment_movements", "q140_retimed_paths", "q161_compared_methods"])
def test_queries_of_paths_make_no_more_candidates_of_copies(spark, monkeypatch, tmp_path, name):
    """Six copies of every event made 36 candidates of each one's."""
    from roadtally.plans import registry

    made = []
    inner = fragments.joined_kinds
    monkeypatch.setattr(fragments, "joined_kinds", lambda c: (made.append(c.count()), inner(c))[1])
    registry.queries()[name](spark, copied_events(spark, 6, f"file://{tmp_path}"))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert 0 < made[0] < 6 * made[1]
