"""The live counter's jobs run as streams over stored rows; their results are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.plans.counts import STAMP
from roadtally.plans.fixtures import Fixtures, oracle
from roadtally.plans.measures import GROUND, LINES, STEPS, TILTED, ground
from roadtally.sources import segments, sinks
from roadtally.streaming import live

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


def stored(fx, rows: DataFrame, files: int | None = None) -> DataFrame:
    """A stream of the rows, with so many files a batch."""
    place = sinks.shared_place(fx.spark, "stream")
    rows.write.parquet(place)
    reader = fx.spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(place)


def settled(fx, stream: DataFrame) -> DataFrame:
    """What the stream has appended when all its rows are read."""
    place, marks = sinks.shared_place(fx.spark, "settled"), sinks.shared_place(fx.spark, "marks")
    writer = stream.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", marks)
    writer.format("parquet").option("path", place).start().awaitTermination()
    return fx.spark.read.parquet(place)


def in_turns(fx, turns: list[DataFrame], job) -> DataFrame:
    """What a job appends when rows come in turns: for each turn the stream starts again from its checkpoint and reads what is new in one batch."""
    place, out, marks = (sinks.shared_place(fx.spark, x) for x in ("stream", "settled", "marks"))
    for rows in turns:
        rows.write.mode("append").parquet(place)
        stream = job(fx.spark.readStream.schema(rows.schema).parquet(place))
        writer = stream.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", marks)
        writer.format("parquet").option("path", out).start().awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(out)


def appended(fx, rows: DataFrame, job) -> DataFrame:
    """What a windowed job appends: all rows and, far behind them, one that closes their windows; then every fiftieth row once more,
    which comes too late and must change nothing."""
    last = rows.agg(F.max("ts").alias("ts")).select(*[F.col("ts") + F.expr("INTERVAL 2 DAYS") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns]).toDF(*rows.columns)
    return in_turns(fx, [rows.unionByName(last.where("ts IS NOT NULL")), rows.where("track_id % 50 = 1")], job)


def crossings(fx) -> DataFrame:
    return fx.crossings.select("job_id", "track_id", "lane_id", "direction", "vehicle_type", F.col("ts").cast("timestamp").alias("ts"))


def timed_points(fx) -> DataFrame:
    at = F.timestamp_seconds(1_704_067_200 + F.col("job_id") % 1000 * 3600 + F.col("frame") / 20)
    return ground(fx).select(F.col("job_id").cast("long"), F.col("track_id").cast("long"), F.col("frame").cast("long"), "gy", at.alias("ts"))


@query("q142_live_crossings", "SELECT job_id, track_id, min(frame) AS frame, arg_min(way, frame) AS direction FROM (SELECT *, CASE WHEN py < 960 AND gy >= 960 THEN 'in' WHEN py > 960 AND gy <= 960 THEN 'out' END AS way FROM steps) WHERE way IS NOT NULL AND place >= 3 AND frame - pframe <= 3 GROUP BY ALL", GROUND, STEPS)
def _(fx):
    return settled(fx, live.live_crossings(stored(fx, timed_points(fx)).withWatermark("ts", "10 seconds"), 960.0))


@query(
    "q142_live_line_crossings",
    """SELECT job_id, crossed_lane AS lane_id, track_id, min(frame) AS frame, arg_min(CASE WHEN turn > 0 THEN 'in' ELSE 'out' END, frame) AS direction FROM hits WHERE turn <> 0 AND place >= 3 AND frame - pframe <= 3 GROUP BY ALL""",
    GROUND, STEPS, LINES, TILTED,
)
def _(fx):
    """Both slanting lines of each site; every track's points come in three batches, in order."""
    at = F.timestamp_seconds(1_704_067_200 + F.col("job_id") % 1000 * 3600 + F.col("frame") / 20)
    rows = ground(fx).select(F.col("project_id").cast("long"), F.col("job_id").cast("long"), F.col("track_id").cast("long"), F.col("frame").cast("long"), "gx", "gy", at.alias("ts"))
    lines = fx.lanes.select(F.col("project_id").cast("long"), F.col("lane_id").cast("long"), F.lit(0.0).alias("x1"), F.lit(955.5).alias("y1"), F.lit(3000.0).alias("x2"), (951.5 + F.col("lane_id")).alias("y2"))
    part = F.floor((F.row_number().over(Window.partitionBy("job_id", "track_id").orderBy("frame")) - 1) / 4)
    rows = sinks.kept_table(rows.withColumn("part", F.least(part, F.lit(2))), "points")  # read once for each turn
    turns = [rows.where(F.col("part") == k).drop("part") for k in range(3)]
    return in_turns(fx, turns, lambda points: live.live_line_crossings(points.withWatermark("ts", "40 days"), lines))


@query("q143_live_intervals", f"SELECT {STAMP.format('start')} AS start, lane_id, direction, vehicle_type, n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, lane_id, direction, vehicle_type, count(*) AS n FROM crossings GROUP BY ALL)")
def _(fx):
    return appended(fx, crossings(fx), live.interval_counts).withColumn("start", C.stamp(F.col("start")))


@query("q144_live_sliding_hours", f"SELECT {STAMP.format('start')} AS start, lane_id, n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start, lane_id, count(*) AS n FROM crossings, (VALUES (0), (1), (2), (3)) s(k) GROUP BY ALL)")
def _(fx):
    return appended(fx, crossings(fx), live.sliding_hours).withColumn("start", C.stamp(F.col("start")))


@query(
    "q145_live_sessions",
    f"""SELECT lane_id, {STAMP.format('start')} AS start, n FROM (SELECT lane_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 30 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY lane_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session
       FROM (SELECT lane_id, ts, lag(ts) OVER (PARTITION BY lane_id ORDER BY ts) AS before FROM crossings)) GROUP BY lane_id, session)""",
)
def _(fx):
    return appended(fx, crossings(fx), lambda rows: live.headway_sessions(rows, 30.0)).withColumn("start", C.stamp(F.col("start")))


@query(
    "q146_live_speed_pairs",
    """SELECT job_id, track_id, CASE WHEN a < b THEN 'in' ELSE 'out' END AS direction, round(abs(b - a) / 20.0e0, 6) AS seconds FROM (SELECT job_id, track_id, min(frame) FILTER ((py < 900) <> (gy < 900)) AS a, min(frame) FILTER ((py < 1000) <> (gy < 1000)) AS b FROM steps WHERE py IS NOT NULL GROUP BY ALL)
       WHERE a IS NOT NULL AND b IS NOT NULL""",
    GROUND, STEPS,
)
def _(fx):
    rows = settled(fx, live.speed_pairs(stored(fx, timed_points(fx)).withWatermark("ts", "10 seconds"), 900.0, 1000.0))
    return rows.withColumn("seconds", F.round("seconds", 6))


@query("q147_live_repeats", "SELECT DISTINCT job_id, track_id, lane_id FROM crossings")
def _(fx):
    """Every crossing is sent twice."""
    return settled(fx, live.without_repeats(stored(fx, crossings(fx).union(crossings(fx))))).select("job_id", "track_id", "lane_id")


@query("q147_live_replacement", "SELECT job_id, count(*) AS n FROM crossings WHERE hidx % 5 <> 0 OR direction = 'in' OR job_id NOT IN (SELECT job_id FROM crossings WHERE hidx % 5 = 0 AND direction = 'in') GROUP BY ALL")
def _(fx):
    """Every fifth segment comes again on a stream, with its entries alone and in several batches, after all were written; then the store is compacted."""
    place, marks = sinks.shared_place(fx.spark, "replaced"), sinks.shared_place(fx.spark, "marks")
    segments.replace_segments(crossings(fx), place)
    again = fx.crossings.where("hidx % 5 = 0 AND direction = 'in'").select("job_id", "track_id", "lane_id", "direction", "vehicle_type", F.col("ts").cast("timestamp").alias("ts"))
    live.staged_stream(stored(fx, again.repartition(3), 1), place, marks).awaitTermination()
    live.commit_stream(fx.spark, place, marks)
    segments.compact(fx.spark, place)
    return segments.read_segments(fx.spark, place).groupBy("job_id").agg(F.count("*").alias("n"))
