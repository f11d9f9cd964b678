"""Report tables, inventories, joins, audits, sets and OD tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import classify, intervals, inventory, joins, movements, reports
from roadtally.plans.counts import CLASSES, COUNTS, COVERED, HOURS, MERGED, RANGES, SCALES, STAMP, counts_of, shown
from roadtally.plans.fixtures import Fixtures, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


HOURLY = """
hourly AS (SELECT c.project_id, direction, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(date_part('day', ts) AS INTEGER) AS dd, c.hh, count(*) AS n, bool_or(h.measurable) AS measurable
  FROM crossings c JOIN hours h ON h.project_id = c.project_id AND h.hh = c.hh GROUP BY ALL)"""


def hourly_of(fx):
    hours = classify.measurable_hours(fx.crossings).select("project_id", "hh", "measurable")
    rows = fx.crossings.join(hours, ["project_id", "hh"])
    return rows.groupBy("project_id", "direction", F.weekday("ts").alias("weekday"), F.dayofmonth("ts").alias("dd"), "hh", "measurable").agg(F.count("*").alias("n"))


@query(
    "q067_hour_weekday",
    """SELECT project_id, direction, weekday, hh, CAST(sum(CASE WHEN measurable THEN n END) AS BIGINT) AS n FROM hourly
       GROUP BY GROUPING SETS ((project_id, direction, weekday, hh), (project_id, direction, weekday), (project_id, direction, hh), (project_id, direction))""",
    HOURS, HOURLY,
)
def _(fx):
    return reports.hour_weekday(hourly_of(fx))


@query(
    "q068_daily_average",
    """SELECT project_id, count(DISTINCT dd) AS days, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS max_hour, round(sum(n) / count(DISTINCT dd), 6) AS daily_average
       FROM (SELECT project_id, dd, hh, sum(n) AS n FROM hourly WHERE measurable GROUP BY ALL) GROUP BY project_id""",
    HOURS, HOURLY,
)
def _(fx):
    return reports.daily_figures(hourly_of(fx))


@query(
    "q069_quarter_by_date",
    """SELECT project_id, CAST(minute // 60 AS INTEGER) AS hour, minute, CAST(sum(CASE WHEN dd = 1 THEN v END) AS BIGINT) AS d01, CAST(sum(CASE WHEN dd = 2 THEN v END) AS BIGINT) AS d02, CAST(sum(CASE WHEN dd = 3 THEN v END) AS BIGINT) AS d03
       FROM qd GROUP BY GROUPING SETS ((project_id, minute // 60, minute), (project_id, minute // 60))""",
    RANGES, COUNTS, MERGED, COVERED,
    """qd AS (SELECT s.project_id, date_part('day', bucket) AS dd, CAST(date_part('hour', bucket) * 60 + date_part('minute', bucket) AS BIGINT) AS minute, CASE WHEN coalesce(c.coverage, 1) > 0 OR total > 0 THEN total END AS v
       FROM (SELECT project_id, bucket, sum(total) AS total FROM counts GROUP BY ALL) s JOIN covered c USING (project_id, bucket))""",
)
def _(fx):
    site = counts_of(fx).groupBy("project_id", "bucket").agg(F.sum("total").alias("total"))
    rows = intervals.coverage(site, fx.segments, 15)
    at = C.from_seconds(F.col("bucket"))
    rows = rows.withColumns({"dd": F.dayofmonth(at), "minute": (F.hour(at) * 60 + F.minute(at)).cast("long")})
    return reports.quarter_by_date(rows, [1, 2, 3])


MINUTE = "CAST(hh * 60 + floor(minute(ts) / 15) * 15 AS INTEGER)"


@query(
    "q070_class_by_quarter",
    f"""SELECT project_id, hour, minute, klass, n, round(n / sum(n) OVER (PARTITION BY project_id, hour, minute), 6) AS share FROM (
        SELECT project_id, CAST(m // 60 AS INTEGER) AS hour, m AS minute, klass, count(*) AS n FROM (SELECT project_id, klass, {MINUTE} AS m FROM classified)
        GROUP BY GROUPING SETS ((project_id, m // 60, m, klass), (project_id, m // 60, klass), (project_id, klass)))""",
    HOURS, SCALES, CLASSES,
)
def _(fx):
    rows = classify.classified(fx.crossings).withColumn("minute", (F.col("hh") * 60 + F.floor(F.minute("ts") / 15) * 15).cast("int"))
    return reports.class_by_quarter(rows)


@query(
    "q071_subtypes_of_a",
    """SELECT project_id, hh, subtype, n, round(n / sum(n) OVER (PARTITION BY project_id, hh), 6) AS share FROM (
       SELECT project_id, hh, subtype, count(*) AS n FROM classified WHERE subtype IS NOT NULL GROUP BY GROUPING SETS ((project_id, hh, subtype), (project_id, subtype)))""",
    HOURS, SCALES, CLASSES,
)
def _(fx):
    return reports.subtypes_of_a(classify.classified(fx.crossings).select("project_id", "hh", "subtype"))


@query(
    "q063_site_inventory",
    """SELECT p.project_id, s.videos, s.waiting, l.lines, c.crossings, c.reviewed, c.pending_speed, m.movements, coalesce(z.accesses, 0) AS accesses FROM (SELECT DISTINCT project_id FROM lanes) p
       LEFT JOIN (SELECT project_id, count(*) AS videos, count(*) FILTER (status IN ('queued', 'awaiting_calibration')) AS waiting FROM segments GROUP BY 1) s USING (project_id)
       LEFT JOIN (SELECT project_id, count(*) AS lines FROM lanes GROUP BY 1) l USING (project_id)
       LEFT JOIN (SELECT project_id, count(*) AS crossings, count(clase_revisada) AS reviewed, count(*) FILTER (tiempo_tramo_s IS NULL) AS pending_speed FROM crossings GROUP BY 1) c USING (project_id)
       LEFT JOIN (SELECT project_id, count(*) AS movements FROM movements GROUP BY 1) m USING (project_id)
       LEFT JOIN (SELECT project_id, count(*) AS accesses FROM zones WHERE kind = 'acceso' GROUP BY 1) z USING (project_id)""",
)
def inventory_of(fx):
    return inventory.site_inventory(fx.lanes.select("project_id").distinct(), fx.segments, fx.lanes, fx.crossings, fx.movements, fx.zones)


@query(
    "q064_survey_type",
    """SELECT l.project_id, CASE WHEN z.n > 0 THEN 'mixto' ELSE 'lineal' END AS survey FROM (SELECT DISTINCT project_id FROM lanes) l
       LEFT JOIN (SELECT project_id, count(*) AS n FROM zones WHERE kind = 'acceso' GROUP BY 1) z USING (project_id)""",
)
def _(fx):
    return inventory.survey_type(inventory_of(fx))


@query(
    "q081_height_percentiles",
    """SELECT lane_id, vehicle_type, len(v) AS n, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.1e0) AS BIGINT))] AS p10, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.5e0) AS BIGINT))] AS p50,
       v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.9e0) AS BIGINT))] AS p90 FROM (SELECT lane_id, vehicle_type, list(bbox_height ORDER BY bbox_height) AS v FROM crossings WHERE bbox_height > 0 GROUP BY ALL)""",
)
def _(fx):
    return inventory.height_percentiles(fx.crossings, ["lane_id", "vehicle_type"])


SIZED = "sized AS (SELECT *, CAST(id AS BIGINT) * 1000003 % 900000000 + 100000000 AS size_bytes FROM segments)"


def sized(fx):
    return fx.segments.withColumn("size_bytes", F.col("id").cast("long") * 1000003 % 900000000 + 100000000)


@query(
    "q082_material_sheet",
    """SELECT project_id, count(*) AS segments, round(avg(fps), 6) AS mean_fps, round(sum(size_bytes * 8) / sum(total_frames / fps) / 1e6, 6) AS mbit_s, sum(total_frames / fps) AS seconds,
       CASE WHEN avg(fps) < 15 AND sum(size_bytes * 8) / sum(total_frames / fps) / 1e6 < 1.0 THEN 'fps,bitrate' WHEN avg(fps) < 15 THEN 'fps' WHEN sum(size_bytes * 8) / sum(total_frames / fps) / 1e6 < 1.0 THEN 'bitrate' ELSE '' END AS warning
       FROM sized GROUP BY project_id""",
    SIZED,
)
def _(fx):
    return inventory.material_sheet(sized(fx)).withColumns({c: F.round(c, 6) for c in ("mean_fps", "mbit_s")})


@query(
    "q083_storage_rate",
    """SELECT project_id, round(sum(size_bytes) / 1e9 / (sum(total_frames / fps) / 3600), 6) AS gb_per_hour, count(*) AS segments FROM (
       SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS k FROM sized WHERE status = 'done') WHERE k <= 100 GROUP BY project_id""",
    SIZED,
)
def _(fx):
    return inventory.storage_rate(sized(fx))


@query(
    "q089_compare_sites",
    "SELECT project_id, n, round(n / max(n) OVER (), 6) AS bar FROM (SELECT project_id, count(*) AS n FROM crossings GROUP BY 1)",
)
def _(fx):
    return reports.compare_sites(fx.crossings.groupBy("project_id").agg(F.count("*").alias("n")), "n")


@query(
    "q112_checklist",
    """SELECT project_id, item, n FROM (SELECT project_id, 'error' AS item, count(*) FILTER (status = 'error') AS n FROM segments GROUP BY 1
       UNION ALL SELECT project_id, 'warnings', count(*) FILTER (total_frames = 36000) FROM segments GROUP BY 1) WHERE n > 0""",
)
def _(fx):
    return inventory.checklist(fx.segments.withColumn("warning", F.when(F.col("total_frames") == 36000, "short_read").otherwise("")))


CHANGES = """
changes AS (SELECT project_id, max(u) AS changed FROM (SELECT project_id, TIMESTAMP '2024-01-10 00:00:00' + to_days(CAST(lane_id AS INTEGER)) AS u FROM lanes
  UNION ALL SELECT project_id, TIMESTAMP '2024-01-11 00:00:00' + to_days(CAST(zone_id AS INTEGER)) AS u FROM zones) GROUP BY 1)"""


def changes_of(fx):
    day = lambda base, k: F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(k)
    return inventory.last_geometry_change(fx.lanes.withColumn("updated_at", day("2024-01-10 00:00:00", F.col("lane_id"))), fx.zones.withColumn("updated_at", day("2024-01-11 00:00:00", F.col("zone_id"))))


@query("q133_last_geometry_change", f"SELECT project_id, {STAMP.format('changed')} AS changed FROM changes", CHANGES)
def _(fx):
    return changes_of(fx).withColumn("changed", C.stamp(F.col("changed")))


@query("q113_stale_segments", "SELECT project_id, count(*) AS n FROM jobs JOIN changes USING (project_id) WHERE status = 'done' AND end_ts < changed GROUP BY 1", CHANGES)
def _(fx):
    rows = inventory.stale_segments(fx.segments.withColumn("finished_at", F.col("end_ts")), changes_of(fx))
    return rows.groupBy("project_id").agg(F.count("*").alias("n"))


@query(
    "q114_segment_warnings",
    """SELECT id, concat_ws(',', CASE WHEN dropped > 0.4 * (dropped + seen) THEN 'zones_drop' END, CASE WHEN seen > 0 AND crossings = 0 THEN 'no_crossing' END, CASE WHEN total_frames / fps < 0.95 * 3600 THEN 'short_read' END) AS warning
       FROM (SELECT s.*, s.id % 7 AS dropped, 5 AS seen, coalesce(c.n, 0) AS crossings FROM segments s LEFT JOIN (SELECT job_id, count(*) AS n FROM crossings WHERE direction = 'in' AND vehicle_type = 'bus' GROUP BY 1) c ON c.job_id = s.id)
       WHERE dropped > 0.4 * (dropped + seen) OR crossings = 0 OR total_frames / fps < 0.95 * 3600""",
)
def _(fx):
    hits = fx.crossings.where("direction = 'in' AND vehicle_type = 'bus'").groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("crossings"))
    rows = fx.segments.join(hits, "id", "left").na.fill(0, ["crossings"])
    rows = rows.select("id", (F.col("id") % 7).alias("dropped"), F.lit(5).alias("seen"), "crossings", F.lit(3600).alias("declared_s"), (F.col("total_frames") / F.col("fps")).alias("read_s"))
    return inventory.segment_warnings(rows)


# ---- joins, audits, sets


@query(
    "q040_named_crossings",
    """SELECT c.id, coalesce(z.name, l.name) AS approach FROM crossings c JOIN lanes l USING (lane_id) LEFT JOIN zones z ON z.zone_id = c.zone_id""",
)
def _(fx):
    return joins.named_crossings(fx.crossings, fx.lanes, fx.zones).select("id", "approach")


@query("q041_movements_with_segment", f"SELECT m.id, {STAMP.format('j.start_ts')} AS start FROM movements m LEFT JOIN jobs j ON j.id = m.job_id AND j.status = 'done'")
def _(fx):
    done = fx.segments.where("status = 'done'").select(F.col("id").alias("job_id"), "start_ts")
    return fx.movements.join(done, "job_id", "left").select("id", C.stamp(F.col("start_ts")).alias("start"))


DIAGNOSES = "diagnoses AS (SELECT id % 3 AS score, job_id, id AS created, CASE id % 5 WHEN 0 THEN 'rojo' WHEN 1 THEN 'ambar' ELSE 'verde' END AS colour FROM crossings)"


def diagnoses(fx):
    colour = F.when(F.col("id") % 5 == 0, "rojo").when(F.col("id") % 5 == 1, "ambar").otherwise("verde")
    return fx.crossings.select("job_id", (F.col("id") % 3).alias("score"), F.col("id").alias("created"), colour.alias("colour"))


@query("q043_latest_diagnosis", "SELECT job_id, score, created, colour FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created DESC) AS k FROM diagnoses) WHERE k = 1", DIAGNOSES)
def _(fx):
    return joins.latest_by_key(diagnoses(fx), "job_id", "created")


@query(
    "q042_segments_with_diagnosis",
    "SELECT s.id, s.status, d.colour FROM segments s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created DESC) AS k FROM diagnoses WHERE score = 1) d ON d.job_id = s.id AND d.k = 1",
    DIAGNOSES,
)
def _(fx):
    last = joins.latest_by_key(diagnoses(fx).where("score = 1"), "job_id", "created").select(F.col("job_id").alias("id"), "colour")
    return fx.segments.join(last, "id", "left").select("id", "status", "colour")


#: Segments that end up to three seconds late, in tenths; every seventh comes a second time.
PARTS = """
late AS (SELECT id, project_id, start_ts, end_ts + to_microseconds(CAST(id * 7 % 31 AS BIGINT) * 100000) AS end_ts FROM jobs),
parts AS (SELECT * FROM late UNION ALL SELECT id + 500000, project_id, start_ts, start_ts + INTERVAL 100 MILLISECOND FROM late WHERE id % 7 = 0)"""


def fractional(fx):
    tenths = (F.col("id") * 7 % 31 / 10).cast("decimal(18,6)")
    add = lambda ts, s: ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s)
    late = fx.segments.select(F.col("id").cast("long").alias("id"), "project_id", "start_ts", add(F.col("end_ts"), tenths).alias("end_ts"))
    again = late.where("id % 7 = 0").select(F.col("id") + 500_000, "project_id", "start_ts", add(F.col("start_ts"), F.lit(0.1).cast("decimal(18,6)")))
    return late.union(again)


@query(
    "q045_intervals_touching_bad_video",
    f"""SELECT project_id, {STAMP.format('bucket')} AS bucket FROM (SELECT DISTINCT g.project_id, g.bucket FROM grid g JOIN parts j ON j.project_id = g.project_id AND j.id % 9 = 0 AND j.start_ts < g.bucket + INTERVAL 15 MINUTE AND j.end_ts > g.bucket)""",
    RANGES, PARTS,
)
def _(fx):
    from roadtally.operators import quality

    buckets = intervals.bucket_grid(intervals.site_ranges(fx.segments), 15).select("project_id", "bucket")
    return shown(quality.touching(buckets, fractional(fx).where("id % 9 = 0"), 15), "bucket")


@query(
    "q046_previous_segment",
    """SELECT a.id, b.id AS previous_id FROM parts a JOIN parts b ON b.project_id = a.project_id AND b.id <> a.id AND b.start_ts <= a.start_ts
       WHERE abs(epoch_us(a.start_ts) - epoch_us(b.end_ts)) <= 1000000 AND NOT EXISTS (SELECT 1 FROM parts c WHERE c.project_id = a.project_id AND c.id <> a.id AND c.start_ts <= a.start_ts AND (c.start_ts > b.start_ts OR (c.start_ts = b.start_ts AND c.id > b.id)))""",
    PARTS,
)
def _(fx):
    return joins.previous_segment(fractional(fx))


@query(
    "q048_orphan_audit",
    """SELECT 'crossing_line' AS "check", (SELECT count(*) FROM crossings WHERE lane_id NOT IN (SELECT lane_id FROM lanes WHERE lane_id <> 4)) AS n
       UNION ALL SELECT 'crossing_video', (SELECT count(*) FROM crossings WHERE job_id NOT IN (SELECT id FROM segments WHERE status = 'done'))
       UNION ALL SELECT 'crossing_zone', (SELECT count(*) FROM crossings WHERE zone_id IS NOT NULL AND zone_id NOT IN (SELECT zone_id FROM zones WHERE kind = 'calzada'))
       UNION ALL SELECT 'movement_video', (SELECT count(*) FROM movements WHERE job_id NOT IN (SELECT id FROM segments WHERE status = 'done'))
       UNION ALL SELECT 'movement_origin', (SELECT count(*) FROM movements WHERE origen_id IS NOT NULL AND origen_id NOT IN (SELECT access_id FROM accesses WHERE access_id < 3))
       UNION ALL SELECT 'movement_destination', (SELECT count(*) FROM movements WHERE destino_id IS NOT NULL AND destino_id NOT IN (SELECT access_id FROM accesses))""",
)
def _(fx):
    done = fx.segments.where("status = 'done'")
    return joins.orphan_audit([
        ("crossing_line", fx.crossings, "lane_id", fx.lanes.where("lane_id <> 4"), "lane_id"),
        ("crossing_video", fx.crossings, "job_id", done, "id"),
        ("crossing_zone", fx.crossings, "zone_id", fx.zones.where("kind = 'calzada'"), "zone_id"),
        ("movement_video", fx.movements, "job_id", done, "id"),
        ("movement_origin", fx.movements, "origen_id", fx.accesses.where("access_id < 3"), "access_id"),
        ("movement_destination", fx.movements, "destino_id", fx.accesses, "access_id"),
    ])


@query(
    "q049_cross_site",
    """SELECT 'line_zone' AS "check", (SELECT count(*) FROM lanes l JOIN zones z ON z.zone_id = l.lane_id % 4 + 1 WHERE z.project_id <> l.project_id) AS n
       UNION ALL SELECT 'crossing_zone', (SELECT count(*) FROM crossings c JOIN zones z USING (zone_id) WHERE z.project_id <> c.project_id)
       UNION ALL SELECT 'crossing_video', (SELECT count(*) FROM crossings c JOIN segments s ON s.id = c.job_id WHERE s.project_id <> c.project_id)""",
)
def _(fx):
    return joins.cross_site(fx.crossings, fx.lanes.withColumn("zone_id", F.col("lane_id") % 4 + 1), fx.zones, fx.segments)


@query(
    "q050_files_against_rows",
    """SELECT 'missing' AS state, count(*) FILTER (id % 10 = 0) AS n, CAST(0 AS BIGINT) AS bytes FROM sized
       UNION ALL SELECT 'unclaimed', count(*), CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM sized WHERE id % 10 <> 0 AND id % 4 = 1""",
    SIZED,
)
def _(fx):
    path = F.concat(F.lit("seg/"), F.col("id"), F.lit(".mp4")).alias("path")
    files = sized(fx).where("id % 10 <> 0").select(path, F.col("size_bytes").alias("size"))
    claimed = sized(fx).where("id % 4 <> 1 OR id % 10 = 0").select(path)
    return joins.files_against_rows(claimed, files)


@query("q051_covered_segments", "SELECT project_id, count(*) AS n FROM segments WHERE status = 'done' OR id IN (SELECT job_id FROM crossings WHERE vehicle_type = 'bus') GROUP BY 1")
def _(fx):
    return joins.covered_segments(fx.segments, fx.crossings.where("vehicle_type = 'bus'")).groupBy("project_id").agg(F.count("*").alias("n"))


OURS = f"ours AS (SELECT project_id, lane_id, CAST(date_part('day', ts) AS INTEGER) AS dd, {MINUTE} AS minuto, count(*) AS n FROM crossings WHERE hh % 7 <> 6 GROUP BY ALL)"


def ours_of(fx):
    minute = (F.col("hh") * 60 + F.floor(F.minute("ts") / 15) * 15).cast("int")
    return fx.crossings.where("hh % 7 <> 6").groupBy("project_id", "lane_id", F.dayofmonth("ts").alias("dd"), minute.alias("minuto")).agg(F.count("*").alias("n"))


@query(
    "q053_quarters_against_hand",
    """SELECT coalesce(m.project_id, o.project_id) AS project_id, coalesce(m.lane_id, o.lane_id) AS lane_id, coalesce(m.dd, o.dd) AS dd, coalesce(m.minuto, o.minuto) AS minuto, m.n AS n_hand, o.n AS n_ours,
       CASE WHEN o.n IS NULL THEN 'hand_only' WHEN m.n IS NULL THEN 'ours_only' ELSE 'both' END AS state
       FROM manual m FULL JOIN ours o ON o.project_id = m.project_id AND o.lane_id = m.lane_id AND o.dd = m.dd AND o.minuto = m.minuto""",
    OURS,
)
def _(fx):
    return joins.quarters_against_hand(ours_of(fx), fx.manual, ["project_id", "lane_id", "dd", "minuto"])


@query(
    "q134_common_quarters",
    """SELECT 'both' AS state, (SELECT count(*) FROM (SELECT project_id, lane_id, dd, minuto FROM manual INTERSECT SELECT project_id, lane_id, dd, minuto FROM ours)) AS n
       UNION ALL SELECT 'hand_only', (SELECT count(*) FROM (SELECT project_id, lane_id, dd, minuto FROM manual EXCEPT ALL SELECT project_id, lane_id, dd, minuto FROM ours))""",
    OURS,
)
def _(fx):
    keys = ["project_id", "lane_id", "dd", "minuto"]
    return joins.common_and_missing(fx.manual.select(*keys), ours_of(fx).select(*keys))


@query("q132_days_with_counts", "SELECT DISTINCT project_id, CAST(ts AS DATE) AS day FROM (SELECT project_id, ts FROM crossings UNION ALL SELECT project_id, ts FROM movements)")
def _(fx):
    return joins.days_with_counts(fx.crossings, fx.movements)


# ---- origin and destination


QUARTER = STAMP.format("time_bucket(INTERVAL 15 MINUTE, ts)")


@query(
    "q072_od_counts",
    f"""SELECT project_id, {QUARTER} AS bucket, origen_id, destino_id, vehicle_type AS klass, CASE WHEN origen_id IS NOT NULL AND destino_id IS NOT NULL THEN 'complete' ELSE 'incomplete' END AS state, count(*) AS n
        FROM movements GROUP BY ALL""",
)
def _(fx):
    return shown(movements.od_counts(fx.movements), "bucket")


@query(
    "q073_od_matrix",
    """SELECT project_id, origen_id, destino_id, CAST(sum(n) AS BIGINT) AS n FROM (
       SELECT p.project_id, a.access_id AS origen_id, b.access_id AS destino_id, (SELECT count(*) FROM movements m WHERE m.project_id = p.project_id AND m.origen_id = a.access_id AND m.destino_id = b.access_id) AS n
       FROM (SELECT DISTINCT project_id FROM movements) p, accesses a, accesses b) GROUP BY GROUPING SETS ((project_id, origen_id, destino_id), (project_id, origen_id), (project_id, destino_id), (project_id))""",
)
def _(fx):
    return movements.od_matrix(fx.movements, fx.accesses)


@query(
    "q074_class_mix",
    """SELECT project_id, origen_id, destino_id, count(*) AS total, count(*) FILTER (vehicle_type = 'car') AS car, count(*) FILTER (vehicle_type = 'bus') AS bus, count(*) FILTER (vehicle_type = 'truck') AS truck,
       count(*) FILTER (vehicle_type = 'motorcycle') AS motorcycle FROM movements WHERE origen_id IS NOT NULL AND destino_id IS NOT NULL GROUP BY ALL""",
)
def _(fx):
    return movements.class_mix(fx.movements, ["car", "bus", "truck", "motorcycle"])


@query(
    "q075_access_volumes",
    f"""SELECT project_id, access_id, bucket, count(*) FILTER (side = 'in') AS entries, count(*) FILTER (side = 'out') AS exits FROM (
        SELECT project_id, origen_id AS access_id, {QUARTER} AS bucket, 'in' AS side FROM movements WHERE origen_id IS NOT NULL
        UNION ALL SELECT project_id, destino_id, {QUARTER}, 'out' FROM movements WHERE destino_id IS NOT NULL AND id % 19 <> 0) GROUP BY ALL""",
)
def _(fx):
    grazed = fx.movements.where("id % 19 = 0 AND destino_id IS NOT NULL").select("id", F.col("destino_id").alias("access_id"))
    return shown(movements.access_volumes(fx.movements, grazed=grazed), "bucket")


@query(
    "q076_by_access_number",
    f"""SELECT project_id, CAST(origen_id AS VARCHAR) || '_' || CAST(destino_id AS VARCHAR) AS movement, {QUARTER} AS bucket, count(*) AS n FROM movements WHERE origen_id IS NOT NULL AND destino_id IS NOT NULL GROUP BY ALL""",
)
def _(fx):
    return shown(movements.by_access_number(fx.movements, fx.accesses), "bucket")


@query("q032_access_number", "SELECT access_id, CAST(regexp_extract(access_name, '^\\s*(\\d+)', 1) AS INTEGER) AS number FROM accesses")
def _(fx):
    return fx.accesses.select("access_id", C.access_number(F.col("access_name")).alias("number"))


COMPANY = f"""
numbered AS (SELECT project_id, origen_id AS o, destino_id AS d, CAST(date_part('hour', ts) * 60 + floor(minute(ts) / 15) * 15 AS INTEGER) AS minute,
  CASE vehicle_type WHEN 'bus' THEN 'B' WHEN 'truck' THEN 'C' ELSE 'A' END AS klass FROM movements WHERE origen_id IS NOT NULL AND destino_id IS NOT NULL AND NOT (origen_id = 1 AND destino_id = 1 AND id % 9 <> 0))"""


@query(
    "q077_company_table",
    """SELECT project_id, CAST(o AS VARCHAR) || '_' || CAST(d AS VARCHAR) AS movement, minute, A, B, C, total FROM (
       SELECT *, sum(total) OVER (PARTITION BY project_id, o, d) / sum(total) OVER (PARTITION BY project_id) AS part FROM (
       SELECT project_id, o, d, minute, count(*) FILTER (klass = 'A') AS A, count(*) FILTER (klass = 'B') AS B, count(*) FILTER (klass = 'C') AS C, count(*) AS total FROM numbered GROUP BY ALL))
       WHERE o <> d OR part >= 0.02""",
    COMPANY,
)
def _(fx):
    rows = fx.movements.where("origen_id IS NOT NULL AND destino_id IS NOT NULL AND NOT (origen_id = 1 AND destino_id = 1 AND id % 9 <> 0)")
    klass = F.when(F.col("vehicle_type") == "bus", "B").when(F.col("vehicle_type") == "truck", "C").otherwise("A")
    minute = (F.hour("ts") * 60 + F.floor(F.minute("ts") / 15) * 15).cast("int")
    return movements.company_table(rows.select("project_id", F.col("origen_id").alias("o"), F.col("destino_id").alias("d"), minute.alias("minute"), klass.alias("klass")))


@query(
    "q078_movement_from_line",
    """SELECT l.project_id, l.hh, l.vehicle_type, greatest(0, l.n - coalesce(k.known, 0)) AS n FROM (SELECT project_id, hh, vehicle_type, count(*) AS n FROM crossings WHERE direction = 'in' GROUP BY ALL) l
       LEFT JOIN (SELECT project_id, CAST(date_part('hour', ts) AS INTEGER) AS hh, vehicle_type, count(*) AS known FROM movements WHERE origen_id = 1 AND destino_id IS NOT NULL GROUP BY ALL) k USING (project_id, hh, vehicle_type)""",
)
def _(fx):
    keys = ["project_id", "hh", "vehicle_type"]
    lines = fx.crossings.where("direction = 'in'").groupBy(*keys).agg(F.count("*").alias("n"))
    others = fx.movements.where("origen_id = 1 AND destino_id IS NOT NULL").groupBy("project_id", F.hour("ts").alias("hh"), "vehicle_type").agg(F.count("*").alias("n"))
    return movements.movement_from_line(lines, others, keys)


@query(
    "q079_tracking_quality",
    """SELECT *, CASE WHEN fraction >= 0.60 THEN 'verde' WHEN fraction >= 0.45 THEN 'ambar' ELSE 'rojo' END AS colour FROM (SELECT project_id, count(*) AS total, count(*) FILTER (origen_id IS NOT NULL AND destino_id IS NOT NULL) AS complete,
       round(count(*) FILTER (origen_id IS NOT NULL AND destino_id IS NOT NULL) / count(*), 6) AS fraction FROM movements GROUP BY 1)""",
)
def _(fx):
    return movements.tracking_quality(fx.movements)


@query(
    "q079_lost_by_access",
    """SELECT project_id, access_id, count(*) FILTER (side = 'in') AS entries, count(*) FILTER (side = 'out') AS exits, count(*) FILTER (side = 'in' AND unseen) AS lost FROM (
       SELECT project_id, origen_id AS access_id, 'in' AS side, destino_id IS NULL AS unseen FROM movements WHERE origen_id IS NOT NULL
       UNION ALL SELECT project_id, destino_id, 'out', FALSE FROM movements WHERE destino_id IS NOT NULL) GROUP BY ALL""",
)
def _(fx):
    return movements.lost_by_access(fx.movements)


@query(
    "q130_worst_videos",
    """SELECT project_id, job_id, n, round(fraction, 6) AS fraction, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY fraction, job_id) AS place FROM (
       SELECT project_id, job_id, count(*) AS n, avg(CASE WHEN origen_id IS NOT NULL AND destino_id IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) AS fraction FROM movements GROUP BY ALL) WHERE n >= 5) WHERE place <= 5""",
)
def _(fx):
    return movements.worst_videos(fx.movements, least=5).withColumn("fraction", F.round("fraction", 6))
