"""Track jobs, file paths and exports: queries, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import classify, fragments, intervals, peaks, regions, runs, tracks
from roadtally.plans.counts import CLASSES, COUNTS, COVERED, HOURS, MERGED, RANGES, SCALES, STAMP, counts_of, shown
from roadtally.plans.fixtures import Fixtures, oracle
from roadtally.plans.measures import GROUND, NESTED, boxes, ground
from roadtally.sources import files, sinks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


@query(
    "q028_repeated_crossings",
    "SELECT id, job_id, lane_id, track_id, frame, gx, gy, height FROM walk WHERE keep",
    """listed AS MATERIALIZED (SELECT id, job_id, lane_id, track_id, CAST(cuadro // 4 AS BIGINT) AS frame, bbox_x + bbox_width / 2.0e0 AS gx, 960.0e0 AS gy, CAST(bbox_height AS DOUBLE) AS height, row_number() OVER (PARTITION BY job_id, lane_id ORDER BY cuadro // 4, track_id) AS k FROM crossings),
walk AS (SELECT *, true AS keep, [{'f': frame, 'x': gx, 'h': height}] AS taken FROM listed WHERE k = 1 UNION ALL
  SELECT id, job_id, lane_id, track_id, frame, gx, gy, height, k, nearby = 0, CASE WHEN nearby = 0 THEN list_append(taken, {'f': frame, 'x': gx, 'h': height}) ELSE taken END FROM (
    SELECT n.*, w.taken, len(list_filter(w.taken, lambda t: n.frame - t.f <= 5 AND abs(n.gx - t.x) <= greatest(6.0e0, 0.2e0 * greatest(n.height, t.h)))) AS nearby FROM walk w JOIN listed n ON n.job_id = w.job_id AND n.lane_id = w.lane_id AND n.k = w.k + 1))""",
)
def _(fx):
    """At five frames a second, so that second crossings come two frames later."""
    rows = fx.crossings.select("id", "job_id", "lane_id", "track_id", F.floor(F.col("cuadro") / 4).alias("frame"), (F.col("bbox_x") + F.col("bbox_width") / 2).alias("gx"), F.lit(960.0).alias("gy"), F.col("bbox_height").cast("double").alias("height"))
    return tracks.drop_repeated_crossings(rows)


@query(
    "q107_class_by_vote",
    """SELECT job_id, track_id, class_name FROM (SELECT *, row_number() OVER (PARTITION BY job_id, track_id ORDER BY w DESC, class_name) AS k FROM (
       SELECT job_id, track_id, CASE WHEN frame % 3 = 0 THEN 'bus' ELSE class_name END AS class_name, round(sum(confidence), 9) AS w FROM points GROUP BY ALL)) WHERE k = 1""",
)
def _(fx):
    rows = fx.points.withColumn("class_name", F.when(F.col("frame") % 3 == 0, "bus").otherwise(F.col("class_name")))
    return tracks.class_by_vote(rows)


#: Sites of 2000 files that last about a minute; their clock loses .9 s every 37 files, and every 211th file can't be read.
FILES = """
files AS (SELECT id // 2000 AS project_id, id, round(id % 2000 * 60.0e0 + id % 2000 // 37 * 0.9e0 + id * 13 % 4 * 0.3e0, 6) AS s, CASE WHEN id % 211 = 5 THEN NULL WHEN id % 499 = 7 THEN 4000.0e0 ELSE 60 + (id % 5 - 2) * 0.1e0 END AS duration FROM crossings WHERE id < 1000000000),
placed AS (SELECT *, row_number() OVER w AS pos, round(coalesce(sum(duration) OVER (PARTITION BY project_id ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS p, count(*) FILTER (duration IS NULL) OVER w AS block FROM files WINDOW w AS (PARTITION BY project_id ORDER BY s, id)),
usable AS (SELECT *, round(s - p, 6) AS d FROM placed WHERE duration IS NOT NULL),
jumps AS (SELECT a.project_id, a.pos, min(b.pos) AS next FROM usable a JOIN usable b ON a.project_id = b.project_id AND a.block = b.block AND b.pos > a.pos AND (b.p >= a.p + 3600 OR abs(b.d - a.d) > 1.5) GROUP BY ALL),
starts AS (SELECT project_id, min(pos) AS pos FROM usable GROUP BY project_id, block UNION SELECT j.project_id, j.next FROM starts s JOIN jumps j ON j.project_id = s.project_id AND j.pos = s.pos)"""


@query("q123_minute_runs", "SELECT u.project_id, u.id, CAST(count(s.pos) OVER (PARTITION BY u.project_id ORDER BY u.pos) - 1 AS INTEGER) AS run FROM usable u LEFT JOIN starts s ON s.project_id = u.project_id AND s.pos = u.pos", FILES)
def _(fx):
    k, i = F.col("id") % 2000, F.col("id")
    start = F.round(k * 60.0 + F.floor(k / 37) * 0.9 + i * 13 % 4 * 0.3, 6)
    length = F.when(i % 211 == 5, None).when(i % 499 == 7, 4000.0).otherwise(60 + (i % 5 - 2) * 0.1)
    rows = fx.crossings.where("id < 1000000000").select(F.floor(i / 2000).alias("project_id"), "id", start.alias("s"), length.alias("duration"))
    return runs.minute_runs(rows)


#: Every third track turns back into its first access; steps are one or nine frames long, and single points fall out of their access.
SEEN = """
seen AS (SELECT job_id, track_id, frame * CASE WHEN track_id % 2 = 0 THEN 1 ELSE 9 END AS frame,
  CASE WHEN (track_id + frame) % 4 = 0 THEN NULL WHEN gy < 920 THEN 1 WHEN gy > 1020 THEN CASE WHEN track_id % 3 = 0 THEN 1 ELSE 2 END END AS access FROM ground)"""


@query(
    "q124_origins_destinations",
    """SELECT job_id, track_id, CASE WHEN n = 1 AND a IS NULL AND z IS NOT NULL THEN NULL ELSE one END AS origin, CASE WHEN n > 1 OR (n = 1 AND a IS NULL AND z IS NOT NULL) THEN other END AS destination FROM
       (SELECT job_id, track_id, count(access) AS n, list(access ORDER BY run)[1] AS a, list(access ORDER BY run)[-1] AS z, arg_min(access, run) AS one, arg_max(access, run) AS other FROM
         (SELECT *, access IS DISTINCT FROM lag(access) OVER w OR row_number() OVER w = 1 AS new FROM stays WINDOW w AS (PARTITION BY job_id, track_id ORDER BY run)) WHERE new GROUP BY ALL)""",
    GROUND, SEEN,
    """runs AS (SELECT job_id, track_id, run, access, min(frame) AS low, max(frame) AS high FROM (SELECT *, sum(new) OVER (PARTITION BY job_id, track_id ORDER BY frame) AS run FROM
       (SELECT *, CASE WHEN access IS DISTINCT FROM lag(access) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM seen WINDOW w AS (PARTITION BY job_id, track_id ORDER BY frame))) GROUP BY ALL)""",
    """stays AS (SELECT * FROM (SELECT *, lag(access) OVER w AS before, lead(access) OVER w AS after FROM runs WINDOW w AS (PARTITION BY job_id, track_id ORDER BY run)) WHERE NOT coalesce(access IS NULL AND before = after AND high - low < 15, false))""",
)
def _(fx):
    access = F.when((F.col("track_id") + F.col("frame")) % 4 == 0, None).when(F.col("gy") < 920, 1).when(F.col("gy") > 1020, F.when(F.col("track_id") % 3 == 0, 1).otherwise(2))
    frame = F.col("frame") * F.when(F.col("track_id") % 2 == 0, 1).otherwise(9)
    return tracks.origins_destinations(ground(fx).select("job_id", "track_id", frame.alias("frame"), access.alias("access")))


@query(
    "q125_monotonic_clock",
    'SELECT job_id, frame, round(t, 6) AS "at" FROM walk',
    """instants AS MATERIALIZED (SELECT job_id, frame, s, row_number() OVER (PARTITION BY job_id ORDER BY frame) AS k FROM (SELECT DISTINCT CAST(job_id AS BIGINT) AS job_id, CAST(cuadro AS BIGINT) AS frame, cuadro // 40 * 2.0e0 AS s FROM crossings)),
walk AS (SELECT job_id, frame, k, s AS t FROM instants WHERE k = 1 UNION ALL SELECT n.job_id, n.frame, n.k, CASE WHEN n.s > w.t THEN n.s ELSE w.t + 0.05e0 END FROM walk w JOIN instants n ON n.job_id = w.job_id AND n.k = w.k + 1)""",
)
def _(fx):
    rows = fx.crossings.select(F.col("job_id").cast("long"), F.col("cuadro").cast("long").alias("frame"), (F.floor(F.col("cuadro") / 40) * 2).cast("double").alias("s"), F.lit(20.0).alias("fps")).dropDuplicates(["job_id", "frame"])
    return tracks.monotonic_clock(rows).withColumn("at", F.round("at", 6))


LATE = 7_000_000_000  # added to the track of a path's second piece

#: Tracks cut after their fifth point; every fifth of them stood still before and comes back two seconds later.
CUT = f"""
cut AS (SELECT job_id, CASE WHEN k <= 5 THEN track_id ELSE track_id + {LATE} END AS track_id, CASE WHEN k > 5 AND track_id % 5 = 0 THEN frame + 40 ELSE frame END AS frame, gx, CASE WHEN k <= 5 AND track_id % 5 = 0 THEN 960.0e0 ELSE gy END AS gy, y2 - y1 AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, track_id ORDER BY frame) AS k FROM ground)),
ends AS (SELECT job_id, track_id, max(h) AS h, min(frame) AS f0, max(frame) AS f1, any_value(gx) AS x, arg_min(gy, frame) AS y0, arg_max(gy, frame) AS y1, (arg_max(gy, frame) - arg_min(gy, frame)) / 4.0e0 AS v FROM cut GROUP BY ALL),
pairs AS (SELECT a.job_id, a.track_id AS a, b.track_id AS b, b.f0 - a.f1 AS dt, abs(a.v) * 20 <= 0.15 * a.h AS standing, greatest(a.h, b.h, 1) AS scale, a.v AS va, b.v AS vb,
    sqrt((b.x - a.x) ** 2 + (b.y0 - a.y1) ** 2) AS stayed, sqrt((b.x - a.x) ** 2 + (b.y0 - a.y1 - a.v * (b.f0 - a.f1)) ** 2) AS meant
  FROM ends a JOIN ends b ON a.job_id = b.job_id AND a.track_id <> b.track_id AND b.f0 - a.f1 BETWEEN 1 AND 60 AND b.h BETWEEN 0.5 * a.h AND 2 * a.h
  WHERE a.track_id < {LATE} AND NOT (b.y0 < 920 OR b.y0 > 1020))"""


def cut_tracks(fx):
    order = Window.partitionBy("job_id", "track_id").orderBy("frame")
    k, fifth = F.col("k"), F.col("track_id") % 5 == 0
    rows = ground(fx).withColumn("k", F.row_number().over(order)).withColumn("gy", F.when((k <= 5) & fifth, F.lit(960.0)).otherwise(F.col("gy"))).withColumn("frame", F.when((k > 5) & fifth, F.col("frame") + 40).otherwise(F.col("frame")))
    access = F.when(F.col("gy") < 920, 1).when(F.col("gy") > 1020, 2)
    return rows.select(F.col("job_id").cast("long"), F.when(k <= 5, F.col("track_id")).otherwise(F.col("track_id") + F.lit(LATE)).cast("long").alias("track_id"), "frame", "gx", "gy", "x1", "x2", "y1", "y2", (F.col("y2") - F.col("y1")).alias("h"), access.alias("access"))


@query(
    "q056_fragment_candidates",
    """SELECT job_id, a, b, round(CASE WHEN dt > 20 THEN 1 + stayed / (0.35 * scale) + dt / 60.0e0 ELSE least(meant, stayed) / (2 * scale + 0.5 * abs(va) * dt) + 0.5 * dt / 20 - 0.3 * CASE WHEN abs(va) > 0.5 AND abs(vb) > 0.5 THEN sign(va * vb) ELSE 0 END END, 9) AS cost
       FROM pairs WHERE CASE WHEN dt > 20 THEN standing AND stayed <= 0.35 * scale ELSE least(meant, stayed) <= 2 * scale + 0.5 * abs(va) * dt AND NOT (abs(va) > 0.5 AND abs(vb) > 0.5 AND va * vb < 0) END""",
    GROUND, CUT,
)
def _(fx):
    rows = cut_tracks(fx)
    ends = fragments.piece_ends(rows).join(tracks.origins_destinations(rows).select("job_id", "track_id", "destination"), ["job_id", "track_id"])
    return fragments.fragment_candidates(ends, 20.0, standing_gap=3.0).withColumn("cost", F.round("cost", 9))


@query(
    "q148_joined_fragments",
    f"""SELECT job_id, track_id + CASE WHEN place = 1 THEN {LATE} ELSE 0 END AS track_id, track_id AS chain, CAST(place AS INTEGER) AS place FROM (SELECT job_id, track_id, max(y2 - y1) AS h FROM points GROUP BY ALL), (VALUES (0), (1)) p(place) WHERE 100 >= 2 * h""",
)
def _(fx):
    """Every track is cut after its fifth point and put together again."""
    order = Window.partitionBy("job_id", "track_id").orderBy("frame")
    late = F.when(F.row_number().over(order) > 5, F.lit(LATE)).otherwise(F.lit(0))
    access = F.when(F.col("gy") < 920, 1).when(F.col("gy") > 1020, 2)
    points = ground(fx).withColumn("track_id", F.col("track_id") + late).withColumn("access", access)
    return fragments.chains_of_points(sinks.kept_table(points.select("job_id", "track_id", "frame", "gx", "gy", "y1", "y2", "access"), "points"), 20.0)


@query(
    "q150_fused_twins",
    """SELECT job_id, frame, kept AS track_id, x1, y1, x2, y2 FROM (SELECT b.*, coalesce(longest, b.track_id) AS kept, row_number() OVER (PARTITION BY b.job_id, coalesce(longest, b.track_id), frame ORDER BY n DESC NULLS LAST, b.track_id) AS place
       FROM boxed_frames b LEFT JOIN (SELECT *, first_value(track_id) OVER (PARTITION BY job_id, head ORDER BY n DESC, track_id) AS longest FROM heads JOIN lengths USING (job_id, track_id)) h ON h.job_id = b.job_id AND h.track_id = b.track_id) WHERE place = 1""",
    NESTED,
    """boxed_frames AS MATERIALIZED (SELECT CAST(job_id AS BIGINT) AS job_id, frame, track_id, x1, y1, x2, y2 FROM boxes),
lengths AS (SELECT job_id, track_id, count(*) AS n FROM boxed_frames GROUP BY ALL),
sharing AS (SELECT a.job_id, a.track_id AS a, b.track_id AS b, count(*) AS shared, median(greatest(0.0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))) AS held
  FROM boxed_frames a JOIN boxed_frames b ON a.job_id = b.job_id AND a.frame = b.frame AND a.track_id < b.track_id GROUP BY ALL),
twins AS MATERIALIZED (SELECT o.job_id, a, b FROM sharing o JOIN lengths x ON x.job_id = o.job_id AND x.track_id = a JOIN lengths y ON y.job_id = o.job_id AND y.track_id = b WHERE shared >= 0.5e0 * least(x.n, y.n) AND held >= 0.65e0),
links AS MATERIALIZED (SELECT job_id, a, b FROM twins UNION SELECT job_id, b, a FROM twins),
reached AS (SELECT job_id, a AS track_id, a AS seen FROM links UNION SELECT r.job_id, r.track_id, l.b FROM reached r JOIN links l ON l.job_id = r.job_id AND l.a = r.seen),
heads AS (SELECT job_id, track_id, min(seen) AS head FROM reached GROUP BY ALL)""",
)
def _(fx):
    rows = boxes(fx).select(F.col("job_id").cast("long").alias("job_id"), "frame", F.col("track_id").cast("long").alias("track_id"), "x1", "y1", "x2", "y2")
    return tracks.fused_twins(rows)


def whole_paths(fx):
    """Each track as one path, from its line to the side that it goes to."""
    order = F.array_sort(F.collect_list(F.struct("frame", "gx", "gy")))
    paths = ground(fx).groupBy("project_id", "lane_id", F.col("track_id").alias("id")).agg(order.alias("p"), F.max(F.col("y2") - F.col("y1")).alias("height"), (F.max_by("gy", "frame") > F.min_by("gy", "frame")).alias("down"), ((F.max("frame") - F.min("frame")) / 20).alias("seconds"), F.max_by("gy", "frame").alias("last"))
    return paths.select(F.col("project_id").cast("long"), F.col("lane_id").cast("long").alias("origen_id"), F.when(F.col("down"), 2).otherwise(1).cast("long").alias("destino_id"), F.col("id").cast("long"), F.col("p.gx").alias("xs"), F.col("p.gy").alias("ys"), "height", "seconds", ((F.col("down") & (F.col("last") > 1020)) | (~F.col("down") & (F.col("last") < 920))).alias("inside"))


@query("q152_movement_templates")
def _(fx):
    return tracks.movement_templates(whole_paths(fx))


@query("q052_remeasured_pairs")
def _(fx):
    """All crossings measured again, up to a second and a half later and a little higher; those of every third video got other track numbers."""
    s, h = F.col("cuadro") / 20, F.col("bbox_height")
    rows = fx.crossings.select("job_id", "lane_id", "id", "track_id", F.when(F.col("id") % 41 != 0, s).alias("s"), h.cast("double").alias("height"))
    again = fx.crossings.select("job_id", "lane_id", (F.col("id") * 7 % 1_000_003).alias("id"), F.when(F.col("job_id") % 3 == 0, -F.col("track_id")).otherwise(F.col("track_id")).alias("track_id"), (s + F.col("id") % 4 / 2).alias("s"), (h * (1 + F.col("id") % 5 / 50)).alias("height"))
    return tracks.remeasured_pairs(rows, again)


@query("q158_region_matrix")
def _(fx):
    """Movements between the regions that are found from the tracks of each site."""
    ends = sinks.kept_table(regions.track_ends(ground(fx).select("project_id", "job_id", "track_id", "frame", "gx", "gy"), 1920, 1080), "ends")
    return regions.region_matrix(regions.movements_by_region(ends, regions.regions(ends)))


PATHS = """
names AS (SELECT id, 'site' || project_id || '/2024-01-' || lpad(CAST(day(start_ts) AS VARCHAR), 2, '0') || '/' || CASE WHEN id % 2 = 0 THEN lpad(CAST(hour(start_ts) AS VARCHAR), 2, '0') || '-15-30.mp4' ELSE lpad(CAST(hour(start_ts) AS VARCHAR), 2, '0') || '/05.mp4' END AS path,
  CAST('2024-01-' || lpad(CAST(day(start_ts) AS VARCHAR), 2, '0') AS DATE) AS day, hour(start_ts) * 3600 + CASE WHEN id % 2 = 0 THEN 930 ELSE 300 END AS seconds FROM jobs)"""


def named_files(fx):
    day, hour = F.date_format("start_ts", "dd"), F.date_format("start_ts", "HH")
    tail = F.when(F.col("id") % 2 == 0, F.concat(hour, F.lit("-15-30.mp4"))).otherwise(F.concat(hour, F.lit("/05.mp4")))
    return fx.segments.select("id", "project_id", F.concat(F.lit("site"), F.col("project_id"), F.lit("/2024-01-"), day, F.lit("/"), tail).alias("path"))


@query("q006_start_from_path", "SELECT id, day, CAST(seconds AS INTEGER) AS seconds FROM names", PATHS)
def _(fx):
    return named_files(fx).select("id", files.path_date(F.col("path")).alias("day"), files.path_seconds(F.col("path")).alias("seconds"))


@query(
    "q007_new_files",
    "SELECT id, substr(sha256('entrada|' || CAST(id // 1000 AS VARCHAR) || '|' || path || '|' || CAST(id * 10 AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 28) AS fingerprint FROM names WHERE id % 3 <> 0",
    PATHS,
)
def _(fx):
    listing = named_files(fx).withColumns({"size": F.col("id") * 10, "mtime": F.col("id")})
    known = files.new_files(listing, listing.limit(0).select(F.lit("").alias("fingerprint"))).where("id % 3 = 0").select("fingerprint")
    return files.new_files(listing, known).select("id", "fingerprint")


@query("q033_quarter_labels", "SELECT DISTINCT minuto, CASE WHEN minuto // 60 % 12 = 0 THEN 12 ELSE minuto // 60 % 12 END || ':' || lpad(CAST(minuto % 60 AS VARCHAR), 2, '0') || CASE WHEN minuto >= 720 THEN ' PM' ELSE ' AM' END AS label, minuto AS back FROM manual")
def _(fx):
    label = C.minute_label(F.col("minuto"))
    return fx.manual.select("minuto", label.alias("label"), C.quarter_minute(F.concat(label, F.lit(" - 5:00 PM"))).alias("back")).distinct()


KLASSES = ["A", "B", "C", "MOTO", "PESADO", "SIN_RESOLVER", "T-S"]
WIDE = ", ".join(f"count(*) FILTER (klass = '{k}') AS \"{k}\"" for k in KLASSES)


def by_class(fx):
    rows = intervals.in_bucket(classify.classified(fx.crossings), intervals.site_ranges(fx.segments, fx.crossings), 15)
    return rows.groupBy("lane_id", "bucket", "klass").agg(F.count("*").alias("n"))


@query(
    "q008_interval_table",
    f"""SELECT c.lane_id, {STAMP.format('c.bucket')} AS bucket, n_in, n_out, total, {', '.join(f'coalesce("{k}", 0) AS "{k}"' for k in KLASSES)}, round(v.coverage, 6) AS coverage FROM counts c
        LEFT JOIN (SELECT lane_id, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, {WIDE} FROM classified GROUP BY ALL) k USING (lane_id, bucket) JOIN covered v ON v.project_id = c.project_id AND v.bucket = c.bucket""",
    RANGES, COUNTS, HOURS, SCALES, CLASSES, MERGED, COVERED,
)
def _(fx):
    counts = intervals.coverage(counts_of(fx), fx.segments, 15).withColumn("coverage", F.round("coverage", 6))
    return shown(sinks.interval_table(counts, by_class(fx), KLASSES), "bucket")


@query(
    "q009_summary_table",
    f"""SELECT t.lane_id, t.n_in, t.n_out, t.total, {STAMP.format('b.bucket')} AS peak_start, CASE WHEN b.q_max > 0 THEN round(b.volume / (4.0e0 * b.q_max), 3) END AS phf, {', '.join(f'coalesce("{k}", 0) AS "{k}"' for k in KLASSES)}
        FROM (SELECT lane_id, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(n_out) AS BIGINT) AS n_out, CAST(sum(total) AS BIGINT) AS total FROM counts GROUP BY 1) t LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (lane_id)
        LEFT JOIN (SELECT lane_id, {WIDE} FROM classified GROUP BY 1) k USING (lane_id)""",
    RANGES, COUNTS, HOURS, SCALES, CLASSES,
    """runs AS (SELECT lane_id, bucket, sum(total) OVER w AS volume, max(total) OVER w AS q_max, count(*) OVER w AS n FROM counts WINDOW w AS (PARTITION BY lane_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
       best AS (SELECT *, row_number() OVER (PARTITION BY lane_id ORDER BY volume DESC, bucket) AS place FROM runs WHERE n = 4)""",
)
def _(fx):
    counts = counts_of(fx)
    totals = counts.groupBy("lane_id").agg(*[F.sum(c).alias(c) for c in ("n_in", "n_out", "total")])
    peak = shown(peaks.peak_hour(counts, ["lane_id"]), "peak_start").select("lane_id", "peak_start", "phf")
    return sinks.summary_table(totals, peak, by_class(fx), KLASSES)


@query("q011_audit_table", "SELECT 'cruce' AS kind, id, project_id, ts, vehicle_type AS klass, clase_revisada AS reviewed FROM crossings UNION ALL SELECT 'movimiento', id, project_id, ts, vehicle_type, NULL FROM movements")
def _(fx):
    return sinks.audit_table(fx.crossings, fx.movements)


@query(
    "q015_run_statistics",
    """SELECT project_id, vehicle_type, count(*) FILTER (direction = 'in') AS n_in, count(*) FILTER (direction = 'out') AS n_out, count(*) AS total, count(*) FILTER (direction = 'in') - count(*) FILTER (direction = 'out') AS net FROM crossings GROUP BY ALL""",
)
def _(fx):
    n_in, n_out = F.count_if(F.col("direction") == "in"), F.count_if(F.col("direction") == "out")
    return fx.crossings.groupBy("project_id", "vehicle_type").agg(n_in.alias("n_in"), n_out.alias("n_out"), F.count("*").alias("total"), (n_in - n_out).alias("net"))
