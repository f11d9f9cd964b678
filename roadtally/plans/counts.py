"""Interval counts, classes, coverage and peaks: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import classify, intervals, peaks
from roadtally.plans.fixtures import Fixtures, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


def shown(df, *names):
    """Seconds as text in the named columns."""
    return df.withColumns({n: C.stamp(C.from_seconds(F.col(n))) for n in names})


# ---- SQL shared by the counterparts

RANGES = """
ranges AS (SELECT project_id, min(start_ts) AS lo, max(end_ts) AS hi FROM jobs GROUP BY project_id),
grid AS (SELECT r.project_id, l.lane_id, g.b AS bucket FROM ranges r JOIN lanes l USING (project_id),
  LATERAL (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, r.lo), r.hi - INTERVAL 1 SECOND, INTERVAL 15 MINUTE)) AS b) g)"""

COUNTS = """
counts AS (SELECT g.project_id, g.lane_id, g.bucket, count(*) FILTER (c.direction = 'in') AS n_in, count(*) FILTER (c.direction = 'out') AS n_out, count(c.id) AS total
  FROM grid g LEFT JOIN crossings c ON c.project_id = g.project_id AND c.lane_id = g.lane_id AND c.ts >= g.bucket AND c.ts < g.bucket + INTERVAL 15 MINUTE
  GROUP BY ALL)"""

HOURS = """
hour_means AS (SELECT project_id, hh, avg(confidence) AS m, count(*) AS n FROM crossings WHERE confidence IS NOT NULL GROUP BY project_id, hh),
hour_rank AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, hh) AS k, count(*) OVER (PARTITION BY project_id) AS hours FROM hour_means),
cutoffs AS (SELECT project_id, least(0.65e0, 0.87e0 * median(m)) AS cutoff FROM hour_rank WHERE k <= greatest(1, hours // 2) GROUP BY project_id),
hours AS (SELECT h.project_id, h.hh, h.m, h.n, c.cutoff, h.m >= c.cutoff AS measurable FROM hour_means h JOIN cutoffs c USING (project_id))"""

SCALES = """
car_scale AS (SELECT project_id, lane_id, hh, count(*) FILTER (vehicle_type = 'car' AND bbox_height > 0) AS cars,
  median(bbox_height) FILTER (vehicle_type = 'car' AND bbox_height > 0) AS mid FROM crossings GROUP BY ALL),
scales AS (SELECT s.project_id, s.lane_id, s.hh,
  CASE WHEN h.measurable AND cars >= 30 AND mid >= 25 THEN 'medido' WHEN h.measurable AND cars >= 30 AND mid >= 12 THEN 'estimado' ELSE 'no_resoluble' END AS level,
  CASE WHEN h.measurable AND cars >= 30 AND mid >= 12 THEN 1.58e0 * mid END AS threshold FROM car_scale s LEFT JOIN hours h USING (project_id, hh)),
profiles AS (SELECT lane_id, CASE WHEN count(*) >= 30 THEN median(bbox_height) END AS car_height,
  CASE WHEN count(*) >= 30 AND count(*) FILTER (bbox_width > 0) >= 30 THEN median(bbox_width / bbox_height) FILTER (bbox_width > 0) END AS car_ratio,
  coalesce(CASE WHEN count(*) >= 30 THEN median(bbox_height) END >= 100, FALSE) AS fine
  FROM crossings c JOIN hours h USING (project_id, hh) WHERE h.measurable AND vehicle_type = 'car' AND bbox_height > 0 GROUP BY lane_id),
refs AS (SELECT lane_id, CASE WHEN count(*) FILTER (vehicle_type = 'car' AND bbox_height > 0) >= 5 THEN 1.58e0 * median(bbox_height) FILTER (vehicle_type = 'car' AND bbox_height > 0) END AS reference
  FROM crossings GROUP BY lane_id)"""

CLASSES = """
ruled AS (SELECT c.*, s.threshold, coalesce(p.fine, FALSE) AS fine, p.car_ratio, r.reference,
  CASE WHEN s.threshold IS NULL THEN 'SIN_RESOLVER'
       WHEN vehicle_type = 'motorcycle' AND coalesce(p.fine, FALSE) THEN CASE WHEN bbox_width > 0 AND bbox_height > 0 AND p.car_ratio > 0 AND bbox_width / bbox_height > 0.7e0 * p.car_ratio THEN 'A' ELSE 'MOTO' END
       WHEN vehicle_type IN ('car', 'motorcycle', 'bicycle') THEN 'A'
       WHEN bbox_height IS NULL THEN 'SIN_RESOLVER'
       WHEN vehicle_type = 'bus' THEN CASE WHEN p.fine THEN 'B' ELSE 'PESADO' END
       WHEN bbox_height <= s.threshold THEN 'A' ELSE CASE WHEN p.fine THEN 'C' ELSE 'PESADO' END END AS rule
  FROM crossings c LEFT JOIN scales s USING (lane_id, hh) LEFT JOIN profiles p USING (lane_id) LEFT JOIN refs r USING (lane_id)),
final AS (SELECT *, CASE WHEN clase_revisada IS NOT NULL THEN clase_revisada WHEN fine AND rule IN ('B', 'C', 'PESADO') AND clase_modelo IS NOT NULL AND prob_modelo >= 0.5 THEN clase_modelo ELSE rule END AS klass FROM ruled),
classified AS (SELECT *, CASE WHEN klass = 'A' THEN CASE WHEN fine AND subtipo_modelo IS NOT NULL AND prob_subtipo >= 0.5 AND hh >= 7 AND hh < 19 THEN subtipo_modelo ELSE 'SIN_SUBTIPO' END END AS subtype,
  CASE WHEN klass = 'SIN_RESOLVER' THEN CASE vehicle_type WHEN 'car' THEN 'A' WHEN 'bicycle' THEN 'A' WHEN 'motorcycle' THEN 'MOTO' WHEN 'bus' THEN 'B'
    WHEN 'truck' THEN CASE WHEN reference > 0 AND bbox_height > 0 THEN CASE WHEN bbox_height <= reference THEN 'A' ELSE 'C' END ELSE 'CAMIONETA_O_CAMION' END ELSE 'SIN_RESOLVER' END END AS provisional FROM final)"""

MERGED = """
done AS (SELECT project_id, start_ts AS a, end_ts AS b FROM jobs WHERE status = 'done'),
flags AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY project_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 SECOND
    OR row_number() OVER (PARTITION BY project_id ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS fresh FROM done),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM flags),
merged AS (SELECT project_id, min(a) AS a, max(b) AS b FROM islands GROUP BY project_id, island)"""

COVERED = """
slots AS (SELECT DISTINCT project_id, bucket FROM grid),
covered AS (SELECT s.project_id, s.bucket, least(1.0e0, sum(CASE WHEN m.a IS NULL THEN 0 ELSE epoch(least(m.b, s.bucket + INTERVAL 15 MINUTE) - greatest(m.a, s.bucket)) END) / 900) AS coverage
  FROM slots s LEFT JOIN merged m ON m.project_id = s.project_id AND m.a < s.bucket + INTERVAL 15 MINUTE AND m.b > s.bucket GROUP BY s.project_id, s.bucket)"""

#: For a table {t} with the key {k}, a bucket and a volume {v}: the first best hour of four rows.
PEAK = """
runs AS (SELECT {k}, bucket, sum({v}) OVER w AS volume, max({v}) OVER w AS q_max, count(*) OVER w AS n, list(struct_pack(v := {v}, b := bucket)) OVER w AS members FROM {t}
  WINDOW w AS (PARTITION BY {k} ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
best AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY volume DESC, bucket) AS place FROM runs WHERE n = 4)"""

PEAK_SELECT = """
SELECT {k}, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS peak_start, CAST(volume AS BIGINT) AS volume, CAST(q_max AS BIGINT) AS peak_interval_volume,
  strftime(list_filter(members, lambda m: m.v = q_max)[1].b, '%Y-%m-%d %H:%M:%S') AS peak_interval_start,
  CASE WHEN q_max > 0 THEN round(volume / (4.0e0 * q_max), 3) END AS phf, coalesce(volume / (4.0e0 * nullif(q_max, 0)) < 0.85e0, FALSE) AS irregular FROM best WHERE place = 1"""

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("q060_counts_by_class", "SELECT project_id, lane_id, direction, vehicle_type, count(*) AS n FROM crossings GROUP BY ALL")
def _(fx):
    return fx.crossings.groupBy("project_id", "lane_id", "direction", "vehicle_type").agg(F.count("*").alias("n"))


def counts_of(fx, minutes=15):
    return intervals.interval_counts(fx.lanes, fx.segments, fx.crossings, minutes)


@query("q061_interval_counts", f"SELECT project_id, lane_id, {STAMP.format('bucket')} AS bucket, n_in, n_out, total FROM counts", RANGES, COUNTS)
def _(fx):
    return shown(counts_of(fx), "bucket")


@query(
    "q062_class_by_bucket",
    f"SELECT lane_id, zone_id, {STAMP.format('time_bucket(INTERVAL 15 MINUTE, ts)')} AS bucket, direction, klass, subtype, provisional, count(*) AS n FROM classified GROUP BY ALL",
    HOURS, SCALES, CLASSES,
)
def _(fx):
    rows = intervals.in_bucket(classify.classified(fx.crossings), intervals.site_ranges(fx.segments, fx.crossings), 15)
    return shown(rows.groupBy("lane_id", "zone_id", "bucket", "direction", "klass", "subtype", "provisional").agg(F.count("*").alias("n")), "bucket")


@query(
    "q065_totals_composition",
    """SELECT project_id, klass, n, CASE WHEN klass <> 'SIN_RESOLVER' THEN round(100.0 * n / sum(n) FILTER (klass <> 'SIN_RESOLVER') OVER (PARTITION BY project_id), 6) END AS pct_of_classified,
       CASE WHEN klass = 'SIN_RESOLVER' THEN round(100.0 * n / sum(n) OVER (PARTITION BY project_id), 6) END AS pct_unresolved
       FROM (SELECT project_id, klass, count(*) AS n FROM classified GROUP BY ALL)""",
    HOURS, SCALES, CLASSES,
)
def _(fx):
    from roadtally.operators import reports

    return reports.composition(classify.classified(fx.crossings), ["project_id"])


@query(
    "q066_combined_flow",
    f"""SELECT project_id, {STAMP.format('bucket')} AS bucket, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(n_out) AS BIGINT) AS n_out,
        CAST(sum(CASE WHEN project_id = 1 THEN n_in ELSE total END) AS BIGINT) AS total FROM counts GROUP BY ALL""",
    RANGES, COUNTS,
)
def _(fx):
    # site 1 has accesses and two lines without a roadway; site 2 has no access
    lanes = fx.lanes.withColumn("zone_id", F.lit(None).cast("int"))
    accesses = fx.zones.where("kind = 'acceso'")
    return shown(intervals.combined_flow(counts_of(fx), intervals.cordon_sites(lanes, accesses)), "bucket")


@query("q084_measurable_hours", "SELECT project_id, hh, round(m, 6) AS mean_confidence, n, round(cutoff, 6) AS cutoff, measurable FROM hours", HOURS)
def _(fx):
    out = classify.measurable_hours(fx.crossings)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "cutoff")})


@query("q085_line_scales", "SELECT project_id, lane_id, hh, level, round(threshold, 6) AS threshold FROM scales", HOURS, SCALES)
def _(fx):
    return classify.line_scales(fx.crossings, classify.measurable_hours(fx.crossings)).withColumn("threshold", F.round("threshold", 6))


@query("q086_line_profiles", "SELECT lane_id, car_height, round(car_ratio, 6) AS car_ratio, fine FROM profiles", HOURS, SCALES)
def _(fx):
    return classify.line_profiles(fx.crossings, classify.measurable_hours(fx.crossings)).withColumn("car_ratio", F.round("car_ratio", 6))


@query("q087_reference_thresholds", "SELECT lane_id, round(reference, 6) AS reference FROM refs", HOURS, SCALES)
def _(fx):
    return classify.reference_thresholds(fx.crossings).withColumn("reference", F.round("reference", 6))


@query(
    "q088_best_hours",
    """SELECT lane_id, hh, level, round(threshold, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY lane_id
       ORDER BY CASE level WHEN 'medido' THEN 2 WHEN 'estimado' THEN 1 ELSE 0 END DESC, hh) AS k FROM scales) WHERE k = 1""",
    HOURS, SCALES,
)
def _(fx):
    return classify.best_hours(classify.line_scales(fx.crossings, classify.measurable_hours(fx.crossings))).withColumn("threshold", F.round("threshold", 6))


@query("q034_rule_class", "SELECT id, rule FROM classified", HOURS, SCALES, CLASSES)
def _(fx):
    return classify.classified(fx.crossings).select("id", "rule")


@query("q035_final_class_subtype", "SELECT id, klass, subtype FROM classified", HOURS, SCALES, CLASSES)
def _(fx):
    return classify.classified(fx.crossings).select("id", "klass", "subtype")


@query("q036_provisional_class", "SELECT id, provisional FROM classified WHERE klass = 'SIN_RESOLVER'", HOURS, SCALES, CLASSES)
def _(fx):
    return classify.classified(fx.crossings).where("klass = 'SIN_RESOLVER'").select("id", "provisional")


@query(
    "q037_company_class",
    """SELECT project_id, CASE WHEN klass IN ('MOTO', 'SIN_RESOLVER') THEN 'A' WHEN klass IN ('T-S', 'T-S-R', 'TRACTOR', 'PESADO') THEN 'C' ELSE klass END AS company, count(*) AS n
       FROM classified GROUP BY ALL""",
    HOURS, SCALES, CLASSES,
)
def _(fx):
    rows = classify.classified(fx.crossings)
    return rows.groupBy("project_id", classify.company_class(F.col("klass")).alias("company")).agg(F.count("*").alias("n"))


@query("q044_interval_coverage", f"SELECT project_id, {STAMP.format('bucket')} AS bucket, round(coverage, 6) AS coverage FROM covered", RANGES, MERGED, COVERED)
def _(fx):
    buckets = intervals.bucket_grid(intervals.site_ranges(fx.segments), 15).select("project_id", "bucket")
    return shown(intervals.coverage(buckets, fx.segments, 15), "bucket").select("project_id", "bucket", F.round("coverage", 6).alias("coverage"))


@query("q122_merged_segments", f"SELECT project_id, {STAMP.format('a')} AS a, {STAMP.format('b')} AS b FROM merged", MERGED)
def _(fx):
    out = intervals.merged_segments(fx.segments)
    return shown(out.select("project_id", F.col("a").cast("long"), F.col("b").cast("long")), "a", "b")


@query(
    "q135_full_quarters",
    f"""SELECT project_id, {STAMP.format("time_bucket(INTERVAL 15 MINUTE, minute)")} AS quarter FROM (
        SELECT DISTINCT j.project_id, j.start_ts + to_minutes(CAST(g.k AS INTEGER)) AS minute
        FROM jobs j, generate_series(0, 59) AS g(k)
        WHERE (j.status = 'done' OR j.id IN (SELECT job_id FROM crossings)) AND g.k < round(j.total_frames / j.fps / 60))
        GROUP BY ALL HAVING count(*) = 15""",
)
def _(fx):
    return shown(intervals.fully_covered_quarters(fx.segments, fx.crossings), "quarter")


@query("q115_peak_hour", PEAK_SELECT.format(k="project_id"), RANGES, COUNTS, "site AS (SELECT project_id, bucket, sum(total) AS total FROM counts GROUP BY ALL)", PEAK.format(k="project_id", v="total", t="site"))
def _(fx):
    site = counts_of(fx).groupBy("project_id", "bucket").agg(F.sum("total").alias("total"))
    return shown(peaks.peak_hour(site, ["project_id"]), "peak_start", "peak_interval_start")


@query("q115_peak_hour_by_line", PEAK_SELECT.format(k="lane_id"), RANGES, COUNTS, PEAK.format(k="lane_id", v="total", t="counts"))
def _(fx):
    return shown(peaks.peak_hour(counts_of(fx), ["lane_id"]), "peak_start", "peak_interval_start")


DAY = """
daily AS (SELECT s.*, CAST(date_part('day', s.bucket) AS INTEGER) AS dd, h.measurable AND coalesce(c.coverage, CASE WHEN s.total > 0 THEN 1 ELSE 0 END) >= 0.995 AS ok
  FROM (SELECT project_id, bucket, sum(total) AS total FROM counts GROUP BY ALL) s JOIN covered c USING (project_id, bucket) LEFT JOIN hours h ON h.project_id = s.project_id AND h.hh = date_part('hour', s.bucket)),
day_runs AS (SELECT project_id, dd, bucket, sum(total) OVER w AS volume, max(total) OVER w AS q_max, count(*) OVER w AS n, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS all_ok,
  list(struct_pack(v := total, b := bucket)) OVER w AS members FROM daily WINDOW w AS (PARTITION BY project_id, dd ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
best AS (SELECT *, row_number() OVER (PARTITION BY project_id, dd ORDER BY volume DESC, bucket) AS place FROM day_runs WHERE n = 4 AND all_ok = 1)"""


def daily_counts(fx):
    """Site counts with the day, the hour and whether the quarter is measurable and covered."""
    site = counts_of(fx).groupBy("project_id", "bucket").agg(F.sum("total").alias("total"))
    site = intervals.coverage(site, fx.segments, 15)
    at = C.from_seconds(F.col("bucket"))
    site = site.withColumn("dd", F.dayofmonth(at)).withColumn("hh", F.hour(at))
    hours = classify.measurable_hours(fx.crossings).select("project_id", "hh", "measurable")
    known = F.coalesce("coverage", (F.col("total") > 0).cast("double")) >= 0.995
    return site.join(hours, ["project_id", "hh"], "left").withColumn("ok", F.coalesce(F.col("measurable"), F.lit(False)) & known)


@query("q116_day_peak", PEAK_SELECT.format(k="project_id, dd"), RANGES, COUNTS, MERGED, COVERED, HOURS, DAY)
def _(fx):
    return shown(peaks.peak_hour(daily_counts(fx), ["project_id", "dd"], valid=F.col("ok")), "peak_start", "peak_interval_start")


@query(
    "q117_shift_peaks",
    PEAK_SELECT.format(k="project_id, dd, shift"),
    RANGES, COUNTS,
    "shifts AS (SELECT project_id, CAST(date_part('day', bucket) AS INTEGER) AS dd, CASE WHEN date_part('hour', bucket) < 12 THEN 'am' ELSE 'pm' END AS shift, bucket, sum(total) AS total FROM counts GROUP BY ALL)",
    PEAK.format(k="project_id, dd, shift", v="total", t="shifts"),
)
def _(fx):
    at = C.from_seconds(F.col("bucket"))
    rows = counts_of(fx).withColumn("dd", F.dayofmonth(at)).withColumn("shift", F.when(F.hour(at) < 12, "am").otherwise("pm"))
    rows = rows.groupBy("project_id", "dd", "shift", "bucket").agg(F.sum("total").alias("total"))
    return shown(peaks.peak_hour(rows, ["project_id", "dd", "shift"]), "peak_start", "peak_interval_start")


@query(
    "q119_cordon_peak",
    PEAK_SELECT.format(k="project_id, dd").replace("place = 1", "place = 1"),
    "entries AS (SELECT project_id, CAST(date_part('day', ts) AS INTEGER) AS dd, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS total FROM crossings WHERE direction = 'in' GROUP BY ALL)",
    """runs AS (SELECT project_id, dd, bucket, sum(total) OVER w AS volume, max(total) OVER w AS q_max, count(*) OVER w AS n, max(bucket) OVER w AS upto,
         list(struct_pack(v := total, b := bucket)) OVER w AS members FROM entries WINDOW w AS (PARTITION BY project_id, dd ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
       best AS (SELECT *, row_number() OVER (PARTITION BY project_id, dd ORDER BY volume DESC, bucket DESC) AS place FROM runs WHERE n = 4 AND upto = bucket + INTERVAL 45 MINUTE)""",
)
def _(fx):
    s = C.seconds(F.col("ts"))
    rows = fx.crossings.where("direction = 'in'").groupBy("project_id", F.dayofmonth("ts").alias("dd"), (s - s % 900).alias("bucket")).agg(F.count("*").alias("total"))
    return shown(peaks.peak_hour(rows, ["project_id", "dd"], latest=True, contiguous=True), "peak_start", "peak_interval_start")
