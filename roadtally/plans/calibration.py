"""Comparisons with references, day summaries, pieces of heavies, deletions: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import calibrate, peaks, review
from roadtally.plans.counts import STAMP, shown
from roadtally.plans.fixtures import Fixtures, oracle
from roadtally.plans.measures import NESTED, boxes
from roadtally.plans.tables import MINUTE

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


@query(
    "q038_heavy_candidates",
    """SELECT c.id FROM crossings c JOIN (SELECT lane_id, median(bbox_height) AS middle FROM crossings WHERE vehicle_type = 'car' AND bbox_height > 0 GROUP BY 1 HAVING count(*) >= 30) m USING (lane_id)
       WHERE vehicle_type IN ('bus', 'truck') AND bbox_height >= 1.58e0 * middle""",
)
def _(fx):
    return calibrate.heavy_candidates(fx.crossings).select("id")


@query(
    "q054_against_axle_counter",
    f"""SELECT lane_id, dd, minute, grp, CAST(coalesce(a.n, 0) AS BIGINT) AS n_ours, CAST(coalesce(b.n, 0) AS BIGINT) AS n_theirs FROM
        (SELECT lane_id, dd, minute, grp, sum(n) AS n FROM axle WHERE side = 0 GROUP BY ALL) a FULL JOIN (SELECT lane_id, dd, minute, grp, sum(n) AS n FROM axle WHERE side = 1 GROUP BY ALL) b USING (lane_id, dd, minute, grp)""",
    f"""axle AS (SELECT id % 2 AS side, lane_id, CAST(date_part('day', ts) AS INTEGER) AS dd, {MINUTE} AS minute, CASE vehicle_type WHEN 'bus' THEN 'heavy' WHEN 'truck' THEN 'heavy' ELSE 'light' END AS grp, count(*) AS n
        FROM crossings WHERE vehicle_type <> 'motorcycle' AND hh % 4 <> 1 GROUP BY ALL)""",
)
def _(fx):
    minute = (F.col("hh") * 60 + F.floor(F.minute("ts") / 15) * 15).cast("int").alias("minute")
    n = lambda side: fx.crossings.where(f"id % 2 = {side}").groupBy("lane_id", F.dayofmonth("ts").alias("dd"), minute, F.col("vehicle_type").alias("klass")).agg(F.count("*").alias("n"))
    groups = fx.spark.createDataFrame([("bus", "heavy"), ("truck", "heavy"), ("car", "light")], "klass string, grp string")
    cover = fx.crossings.select("lane_id", F.dayofmonth("ts").alias("dd"), minute, F.when(F.col("hh") % 4 == 1, 0.5).otherwise(1.0).alias("coverage")).distinct()
    return calibrate.against_axle_counter(n(0), n(1), groups, cover)


@query(
    "q059_best_numbering",
    """SELECT project_id, assignment, CAST(error AS BIGINT) AS error FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY error, a, b, c) AS k FROM (
       SELECT project_id, a, b, c, a || ',' || b || ',' || c AS assignment, sum(abs(n - n_hand)) AS error FROM (
         SELECT coalesce(m.project_id, h.project_id) AS project_id, coalesce(m.a, h.a) AS a, coalesce(m.b, h.b) AS b, coalesce(m.c, h.c) AS c, coalesce(m.n, 0) AS n, coalesce(h.n_hand, 0) AS n_hand
         FROM (SELECT project_id, a, b, c, [a, b, c][o] AS ho, [a, b, c][d] AS hd, sum(n) AS n FROM pairs_seen, ways GROUP BY ALL) m
         FULL JOIN (SELECT project_id, a, b, c, o % 3 + 1 AS ho, d % 3 + 1 AS hd, n AS n_hand FROM pairs_seen, ways) h USING (project_id, a, b, c, ho, hd)) GROUP BY ALL)) WHERE k = 1""",
    "pairs_seen AS (SELECT project_id, origen_id AS o, destino_id AS d, count(*) AS n FROM movements WHERE origen_id IS NOT NULL AND destino_id IS NOT NULL GROUP BY ALL)",
    "ways AS (SELECT x.v AS a, y.v AS b, z.v AS c FROM (VALUES (1), (2), (3)) AS x(v), (VALUES (1), (2), (3)) AS y(v), (VALUES (1), (2), (3)) AS z(v))",
)
def _(fx):
    rows = fx.movements.where("origen_id IS NOT NULL AND destino_id IS NOT NULL").groupBy("project_id", F.col("origen_id").alias("o"), F.col("destino_id").alias("d")).agg(F.count("*").alias("n"))
    hand = rows.select("project_id", (F.col("o") % 3 + 1).alias("ho"), (F.col("d") % 3 + 1).alias("hd"), F.col("n").alias("n_hand"))
    return calibrate.best_numbering(rows, hand, [1, 2, 3], [1, 2, 3])


@query(
    "q118_day_summary",
    f"""SELECT e.project_id, e.dd, CAST(e.entries AS BIGINT) AS entries, {STAMP.format('b.bucket')} AS peak_start, CAST(b.volume AS BIGINT) AS volume, round(b.volume / (4.0e0 * b.q_max), 3) AS phf,
        (SELECT count(*) FROM movements m WHERE m.project_id = e.project_id AND origen_id IS NOT NULL AND destino_id IS NOT NULL AND m.ts >= b.bucket AND m.ts < b.bucket + INTERVAL 1 HOUR) AS decided
        FROM (SELECT project_id, dd, sum(n) AS entries FROM ent GROUP BY ALL) e LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (project_id, dd)""",
    "ent AS (SELECT project_id, CAST(date_part('day', ts) AS INTEGER) AS dd, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS n FROM movements WHERE origen_id IS NOT NULL GROUP BY ALL)",
    """runs AS (SELECT project_id, dd, bucket, sum(n) OVER w AS volume, max(n) OVER w AS q_max, count(*) OVER w AS k, max(bucket) OVER w AS upto FROM ent WINDOW w AS (PARTITION BY project_id, dd ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
       best AS (SELECT *, row_number() OVER (PARTITION BY project_id, dd ORDER BY volume DESC, bucket) AS place FROM runs WHERE k = 4 AND upto = bucket + INTERVAL 45 MINUTE)""",
)
def _(fx):
    s = C.seconds(F.col("ts"))
    entries = fx.movements.where("origen_id IS NOT NULL").groupBy("project_id", F.dayofmonth("ts").alias("dd"), (s - s % 900).alias("bucket")).agg(F.count("*").alias("n"))
    peak = peaks.peak_hour(entries, ["project_id", "dd"], volume="n", contiguous=True).select("project_id", "dd", "peak_start", "volume", "phf")
    decided = fx.movements.where("origen_id IS NOT NULL AND destino_id IS NOT NULL").select("project_id", s.alias("at"))
    return shown(calibrate.day_summary(entries, decided, peak), "peak_start")


@query(
    "q012_hourly_comparison",
    """SELECT lane_id, dd, hh, n_ours, n_hand, round(confidence, 6) AS confidence, round(n_ours / n_hand, 6) AS ratio FROM
       (SELECT lane_id, CAST(date_part('day', ts) AS INTEGER) AS dd, hh, count(*) AS n_ours, avg(confidence) AS confidence FROM crossings GROUP BY ALL)
       JOIN (SELECT lane_id, CAST(dd AS INTEGER) AS dd, CAST(minuto // 60 AS INTEGER) AS hh, CAST(sum(n) AS BIGINT) AS n_hand FROM manual GROUP BY ALL) USING (lane_id, dd, hh)""",
)
def _(fx):
    ours = fx.crossings.groupBy("lane_id", F.dayofmonth("ts").alias("dd"), "hh").agg(F.count("*").alias("n_ours"), F.round(F.avg("confidence"), 6).alias("confidence"))
    hand = fx.manual.groupBy("lane_id", "dd", F.floor(F.col("minuto") / 60).cast("int").alias("hh")).agg(F.sum("n").alias("n_hand"))
    return calibrate.hourly_comparison(ours, hand, ["lane_id", "dd", "hh"]).withColumn("ratio", F.round("ratio", 6))


@query(
    "q024_travelling_pieces",
    """SELECT job_id, track_id, heavy_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, track_id ORDER BY n DESC, heavy_id) AS k FROM (
         SELECT job_id, track_id, heavy_id, count(*) AS n, max(rx) - min(rx) + max(ry) - min(ry) AS moves FROM (
           SELECT *, row_number() OVER (PARTITION BY job_id, frame, track_id ORDER BY part DESC, heavy_id) AS k FROM (
             SELECT a.job_id, a.frame, a.track_id, b.track_id AS heavy_id, ((a.x1 + a.x2) / 2 - b.x1) / (b.x2 - b.x1) AS rx, ((a.y1 + a.y2) / 2 - b.y1) / (b.y2 - b.y1) AS ry, (a.x2 - a.x1) * (a.y2 - a.y1) AS area, (b.x2 - b.x1) * (b.y2 - b.y1) AS big,
               greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) AS part
             FROM boxes a JOIN boxes b ON a.job_id = b.job_id AND a.frame = b.frame AND a.track_id <> b.track_id AND b.class_name IN ('bus', 'truck')) WHERE big >= 2 * area AND part >= 0.8)
         WHERE k = 1 GROUP BY ALL)) t JOIN (SELECT job_id, track_id, count(*) AS frames FROM boxes GROUP BY ALL) USING (job_id, track_id) WHERE k = 1 AND n >= 2 AND n >= 0.6 * frames AND moves <= 0.45""",
    NESTED,
)
def _(fx):
    return calibrate.travelling_pieces(boxes(fx))


@query(
    "q141_cascade_delete",
    """SELECT 'crossings' AS name, (SELECT count(*) FROM crossings WHERE job_id % 5 <> 0) AS n UNION ALL SELECT 'movements', (SELECT count(*) FROM movements WHERE job_id % 5 <> 0) UNION ALL SELECT 'segments', (SELECT count(*) FROM segments WHERE id % 5 <> 0)""",
)
def _(fx):
    left = review.cascade_delete({"crossings": (fx.crossings, "job_id"), "movements": (fx.movements, "job_id"), "segments": (fx.segments, "id")}, fx.segments.where("id % 5 = 0"), "id")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
