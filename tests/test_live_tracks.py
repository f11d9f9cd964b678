"""Live tracks are followed in groups: state rows don't grow with the tracks, and batches change nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtally.streaming import live

N = 2500


@pytest.fixture(scope="module")
def walk():
    """Heights of N tracks over six frames."""
    return np.random.default_rng(3).integers(900, 1020, (N, 6)).astype(float)


def ran(spark, tmp_path, walk, job):
    """The rows that a job appends when frames 0 to 2 come in one batch and 3 to 5 in the next, and the rows of its state."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id long, track_id long, frame long, gy double, project_id long, gx double"
    for turn in (range(3), range(3, 6)):
        rows = [(t % 7, t, f, float(walk[t, f]), 1, 10.0) for t in range(N) for f in turn]
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(1_704_067_200 + F.col("frame") / 20))
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source).withWatermark("ts", "1 hour")
        writer = job(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "marks")).format("parquet").option("path", out)
        query = writer.start()
        query.awaitTermination()
    return spark.read.parquet(out).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def first_steps(walk, crossed, least):
    """Each track's first frame f with crossed(height at f - 1, height at f), from frame least on."""
    return {t: f for t in range(N) for f in [next((f for f in range(max(1, least), 6) if crossed(walk[t, f - 1], walk[t, f])), None)] if f}


def test_crossings(spark, tmp_path, walk):
    got, state = ran(spark, tmp_path, walk, lambda d: live.live_crossings(d, 960.0))
    want = first_steps(walk, lambda a, b: a < 960 <= b or a > 960 >= b, 2)
    assert {(r.job_id, r.track_id, r.frame, r.direction) for r in got} == {(t % 7, t, f, "in" if walk[t, f - 1] < 960 else "out") for t, f in want.items()}
    assert len(got) == len(want) and 0 < state <= live.GROUPS


def test_line_crossings(spark, tmp_path, walk):
    lines = spark.createDataFrame([(1, 4, 0.0, 960.5, 100.0, 960.5), (2, 5, 0.0, 960.5, 100.0, 960.5)], "project_id long, lane_id long, x1 double, y1 double, x2 double, y2 double")
    got, state = ran(spark, tmp_path, walk, lambda d: live.live_line_crossings(d, lines))
    want = first_steps(walk, lambda a, b: (a < 960.5) != (b < 960.5), 2)
    assert {(r.track_id, r.frame, r.lane_id) for r in got} == {(t, f, 4) for t, f in want.items()} and len(got) == len(want) and 0 < state <= live.GROUPS


def test_speed_pairs(spark, tmp_path, walk):
    got, state = ran(spark, tmp_path, walk, lambda d: live.speed_pairs(d, 930.0, 990.0))
    one, two = (first_steps(walk, lambda a, b, y=y: (a < y) != (b < y), 1) for y in (930, 990))
    want = {(t, "in" if one[t] < two[t] else "out", round(abs(one[t] - two[t]) / 20, 6)) for t in one.keys() & two.keys()}
    assert {(r.track_id, r.direction, round(r.seconds, 6)) for r in got} == want and len(got) == len(want) and 0 < state <= live.GROUPS
