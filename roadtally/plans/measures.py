"""Speeds, reviews, geometry on track points and validation: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import classify, geometry, intervals, joins, quality, review, speed, validate
from roadtally.plans.counts import CLASSES, HOURS, RANGES, SCALES, STAMP, shown
from roadtally.plans.fixtures import Fixtures, oracle
from roadtally.plans.tables import MINUTE, OURS, ours_of

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- speed

SPEEDS = """
speeds AS (SELECT c.*, CASE WHEN tiempo_tramo_s > 0 AND distance_m / tiempo_tramo_s * 3.6e0 BETWEEN 3 AND 160 THEN distance_m / tiempo_tramo_s * 3.6e0 END AS kmh
  FROM crossings c JOIN lanes l USING (lane_id))"""


def speeds(fx):
    rows = fx.crossings.join(fx.lanes.select("lane_id", "distance_m"), "lane_id")
    return rows.withColumn("kmh", speed.kmh(F.col("distance_m"), F.col("tiempo_tramo_s")))


@query(
    "q090_speed_summary",
    """SELECT lane_id, hh, count(kmh) AS n, round(avg(kmh), 6) AS mean, round(quantile_cont(kmh, 0.15), 6) AS p15, round(quantile_cont(kmh, 0.5), 6) AS p50, round(quantile_cont(kmh, 0.85), 6) AS p85 FROM speeds GROUP BY ALL""",
    SPEEDS,
)
def _(fx):
    return rounded(speed.speed_summary(speeds(fx), ["lane_id", "hh"]), "mean", "p15", "p50", "p85")


@query("q091_representative_hours", "SELECT lane_id, hidx, count(*) AS crossed, count(kmh) AS measured, count(kmh) / count(*) >= 0.70 AS publish FROM speeds GROUP BY ALL", SPEEDS)
def _(fx):
    return speed.representative_hours(speeds(fx), ["lane_id", "hidx"])


@query(
    "q092_distance_check",
    """SELECT lane_id, CASE WHEN lane_id = 1 THEN 'no_aplica' WHEN cars < 20 THEN 'sin_datos' WHEN h * distance_m / run BETWEEN 1.1 AND 2.1 THEN 'coherente' ELSE 'revisar' END AS state,
       CASE WHEN lane_id <> 1 AND cars >= 20 THEN round(h * distance_m / run, 2) END AS car_m
       FROM (SELECT l.lane_id, l.distance_m, 150.0e0 * l.lane_id AS run, count(*) AS cars, median(bbox_height) AS h FROM lanes l JOIN crossings c ON c.lane_id = l.lane_id AND vehicle_type = 'car' AND bbox_height > 0 GROUP BY ALL)""",
)
def _(fx):
    upright = F.col("lane_id") != 1
    stretches = fx.lanes.select(
        "lane_id", "distance_m", F.lit(500.0).alias("ax"), F.lit(0.0).alias("ay"), F.when(upright, 500.0).otherwise(1500.0).alias("bx"), F.when(upright, 900.0).otherwise(0.0).alias("by"),
        F.when(upright, 500.0 + 150.0 * F.col("lane_id")).otherwise(900.0).alias("mx"), F.when(upright, 450.0).otherwise(150.0).alias("my"),
    )
    return speed.distance_check(fx.crossings.where("vehicle_type = 'car'"), stretches)


BINS = """
bins AS (SELECT lane_id, CAST(CASE WHEN kmh < 20 THEN 0 WHEN kmh >= 120 THEN 11 ELSE floor((kmh - 20) / 10) + 1 END AS INTEGER) AS bin, count(*) AS n FROM speeds WHERE kmh IS NOT NULL GROUP BY ALL)"""


@query("q093_speed_histogram", "SELECT * FROM bins", SPEEDS, BINS)
def _(fx):
    return speed.histogram(speeds(fx), ["lane_id"])


@query(
    "q093_bin_percentile_mean",
    """SELECT lane_id, round(value, 6) AS p85, round(mean, 6) AS mean FROM (
       SELECT lane_id, CASE WHEN bin = 0 THEN 0 ELSE 20 + (bin - 1) * 10 END + CASE WHEN bin = 0 THEN 20 ELSE 10 END * (0.85e0 * whole - (upto - n)) / n AS value FROM (
         SELECT *, sum(n) OVER (PARTITION BY lane_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lane_id) AS whole FROM bins) WHERE upto >= 0.85e0 * whole AND upto - n < 0.85e0 * whole)
       JOIN (SELECT lane_id, sum((CASE WHEN bin = 0 THEN 28.0e0 ELSE 20 + (bin - 0.5e0) * 10 END) * n) / sum(n) AS mean FROM bins GROUP BY 1) USING (lane_id)""",
    SPEEDS, BINS,
)
def _(fx):
    bins = speed.histogram(speeds(fx), ["lane_id"])
    both = speed.percentile_of_bins(bins, ["lane_id"], 0.85).withColumnRenamed("value", "p85").join(speed.mean_of_bins(bins, ["lane_id"]), "lane_id")
    return rounded(both, "p85", "mean")


@query(
    "q094_speed_study",
    """SELECT lane_id, hh, count(*) AS crossed, count(kmh) AS n, round(avg(kmh), 6) AS mean, round(stddev_pop(kmh), 6) AS sd, round(quantile_cont(kmh, 0.85), 6) AS p85,
       count(kmh) FILTER (NOT heavy) AS n_light, round(avg(kmh) FILTER (NOT heavy), 6) AS mean_light, count(kmh) FILTER (heavy) AS n_heavy, round(avg(kmh) FILTER (heavy), 6) AS mean_heavy,
       round(count(kmh) / count(*), 6) AS measured, count(kmh) < 50 AS small
       FROM (SELECT s.*, vehicle_type = 'bus' OR (vehicle_type = 'truck' AND bbox_height >= m.mid * 1.58e0) AS heavy FROM speeds s JOIN (SELECT lane_id, median(bbox_height) AS mid FROM crossings WHERE vehicle_type = 'car' GROUP BY 1) m USING (lane_id)) GROUP BY ALL""",
    SPEEDS,
)
def _(fx):
    cars = fx.crossings.where("vehicle_type = 'car'").groupBy("lane_id").agg(F.percentile("bbox_height", 0.5).alias("mid"))
    heavy = (F.col("vehicle_type") == "bus") | ((F.col("vehicle_type") == "truck") & (F.col("bbox_height") >= 1.58 * F.col("mid")))
    out = speed.speed_study(speeds(fx).join(cars, "lane_id").withColumn("heavy", heavy), ["lane_id", "hh"])
    return rounded(out, "mean", "sd", "p85", "mean_light", "mean_heavy", "measured")


@query(
    "q095_calibrate_distance",
    """SELECT lane_id, round(median(kmh) / 3.6e0 / median(1 / tiempo_tramo_s) FILTER (hh % 2 = 0 AND tiempo_tramo_s > 0), 6) AS distance_m FROM speeds GROUP BY lane_id""",
    SPEEDS,
)
def _(fx):
    own = speeds(fx).where("hh % 2 = 0").select("lane_id", F.col("tiempo_tramo_s").alias("t"))
    return rounded(speed.calibrate_distance(own, speeds(fx).select("lane_id", F.col("kmh").alias("ref_kmh"))), "distance_m")


# ---- review

DOUBLES = """
timed AS (SELECT *, cuadro / 20.0e0 AS sec FROM crossings),
pairs AS (SELECT *, lag(id) OVER w AS partner, sec - lag(sec) OVER w AS gap, lag(bbox_x) OVER w AS ox, lag(bbox_y) OVER w AS oy, lag(bbox_width) OVER w AS ow, lag(bbox_height) OVER w AS oh
  FROM timed WINDOW w AS (PARTITION BY job_id, lane_id, direction ORDER BY sec, id)),
inters AS (SELECT *, greatest(0, least(bbox_x + bbox_width, ox + ow) - greatest(bbox_x, ox)) * greatest(0, least(bbox_y + bbox_height, oy + oh) - greatest(bbox_y, oy)) AS inter FROM pairs WHERE partner IS NOT NULL AND gap <= 0.6e0),
doubles AS (SELECT id, partner, gap FROM inters WHERE inter / (bbox_width * bbox_height + ow * oh - inter) >= 0.3)"""


@query("q120_possible_doubles", "SELECT id, partner, round(gap, 6) AS gap FROM doubles", DOUBLES)
def _(fx):
    return rounded(review.possible_doubles(fx.crossings, fps=20.0), "gap")


CUTS = """
cuts AS (SELECT lane_id, least(0.35e0, v[1 + CAST(floor(0.05e0 * (len(v) - 1)) AS BIGINT)]) AS cutoff FROM (SELECT lane_id, list(confidence ORDER BY confidence) AS v FROM crossings WHERE confidence IS NOT NULL GROUP BY lane_id))"""


@query("q106_confidence_cutoffs", "SELECT lane_id, round(cutoff, 6) AS cutoff FROM cuts", CUTS)
def _(fx):
    return rounded(review.confidence_cutoffs(fx.crossings, ["lane_id"]), "cutoff")


REASONS = """
reasons AS (
  SELECT c.id, c.project_id, c.ts, c.clase_revisada, 'doble' AS reason, 0 AS rank FROM classified c JOIN doubles USING (id)
  UNION ALL SELECT id, project_id, ts, clase_revisada, 'frontera', 1 FROM classified WHERE threshold > 0 AND bbox_height > 0 AND vehicle_type IN ('truck', 'bus') AND abs(bbox_height - threshold) <= 0.10e0 * threshold
  UNION ALL SELECT id, project_id, ts, clase_revisada, 'modelo', 2 FROM classified WHERE clase_modelo IS NOT NULL AND prob_modelo < 0.6 AND klass NOT IN ('A', 'MOTO', 'SIN_RESOLVER')
  UNION ALL SELECT c.id, project_id, ts, clase_revisada, 'confianza', 3 FROM classified c JOIN cuts k USING (lane_id) WHERE threshold > 0 AND confidence <= cutoff)"""


def reasons_of(fx):
    return review.review_reasons(classify.classified(fx.crossings), review.possible_doubles(fx.crossings, fps=20.0))


@query("q129_reason_totals", "SELECT project_id, reason, count(*) AS n FROM reasons WHERE clase_revisada IS NULL GROUP BY ALL", HOURS, SCALES, CLASSES, DOUBLES, CUTS, REASONS)
def _(fx):
    return review.reason_totals(reasons_of(fx))


@query(
    "q129_review_queue",
    f"""SELECT project_id, id, {STAMP.format('ts')} AS ts, priority, reasons, place, total FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority, ts, id) AS place, count(*) OVER (PARTITION BY project_id) AS total FROM (
        SELECT project_id, id, ts, min(rank) AS priority, string_agg(reason, ',' ORDER BY reason) AS reasons FROM reasons WHERE clase_revisada IS NULL GROUP BY project_id, id, ts)) WHERE place BETWEEN 1 AND 40""",
    HOURS, SCALES, CLASSES, DOUBLES, CUTS, REASONS,
)
def _(fx):
    out = review.review_queue(reasons_of(fx))
    return out.withColumns({"ts": C.stamp(F.col("ts")), "reasons": F.array_join("reasons", ",")})


@query(
    "q131_even_sample",
    """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY lane_id, hh ORDER BY ts, id) - 1 AS place, count(*) OVER (PARTITION BY lane_id, hh) AS n FROM crossings)
       WHERE place % greatest(1, n // 20) = 0 AND place / greatest(1, n // 20) < 20""",
)
def _(fx):
    return review.even_sample(fx.crossings, ["lane_id", "hh"], ["ts", "id"], 20).select("id")


REVIEWED = """
reviewed AS (SELECT id, lane_id, klass, CASE WHEN id % 41 = 0 THEN 'C' WHEN clase_revisada IS NOT NULL THEN clase_revisada ELSE klass END AS after FROM classified)"""


@query(
    "q136_review_changes",
    """SELECT lane_id, klass, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after FROM (SELECT lane_id, klass, count(*) AS n FROM reviewed GROUP BY ALL) b
       FULL JOIN (SELECT lane_id, after AS klass, count(*) AS n FROM reviewed GROUP BY ALL) a USING (lane_id, klass) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    HOURS, SCALES, CLASSES, REVIEWED,
)
def _(fx):
    before = classify.classified(fx.crossings)
    reviews = fx.crossings.where("id % 41 = 0").select("id", F.lit("C").alias("klass_new"))
    after = review.apply_reviews(before, reviews).withColumn("klass", F.coalesce("clase_revisada", "klass"))
    return review.review_changes(before, after)


@query("q137_discard_restore", "SELECT lane_id, count(*) AS n, CAST(sum(bbox_height) AS BIGINT) AS heights, CAST((SELECT count(*) FROM doubles) AS BIGINT) AS discarded FROM crossings GROUP BY lane_id", DOUBLES)
def _(fx):
    left, side = review.discard(fx.crossings, review.possible_doubles(fx.crossings, fps=20.0), "cruce", "doble")
    back = review.restore(left, side)
    gone = side.agg(F.count("*").alias("discarded"))
    return back.groupBy("lane_id").agg(F.count("*").alias("n"), F.sum("bbox_height").alias("heights")).join(F.broadcast(gone), how="cross")


@query("q138_set_stretch_times", "SELECT lane_id, round(sum(CASE WHEN id % 5 = 0 THEN 1.25e0 ELSE tiempo_tramo_s END), 6) AS total FROM crossings GROUP BY lane_id")
def _(fx):
    times = fx.crossings.where("id % 5 = 0").select("job_id", "lane_id", "track_id", F.lit(1.25).alias("t"))
    return review.set_stretch_times(fx.crossings, times).groupBy("lane_id").agg(F.round(F.sum("tiempo_tramo_s"), 6).alias("total"))


@query("q139_move_start", f"""SELECT id, {STAMP.format("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(hidx * 3600 + 600 + CAST(floor(cuadro / 20) AS BIGINT))")} AS at FROM crossings WHERE job_id % 3 = 0""")
def _(fx):
    s = C.seconds(F.col("start_ts"))
    moves = fx.segments.where("id % 3 = 0").select(F.col("id").alias("job_id"), s.alias("old_s"), (s + 600).alias("new_s"), "fps")
    return shown(review.move_start(fx.crossings, moves), "at")


# ---- geometry


def ground(fx):
    """Track points with their ground point."""
    rows = fx.points.withColumn("project_id", F.when(F.col("lane_id") <= 2, 1).otherwise(2))
    return rows.withColumns({"gx": geometry.ground_x(F.col("x1"), F.col("x2")), "gy": F.col("y2")})


GROUND = "ground AS (SELECT *, CASE WHEN lane_id <= 2 THEN 1 ELSE 2 END AS project_id, (x1 + x2) / 2 AS gx, y2 AS gy FROM points)"


def shapes(fx):
    corner = [F.col(c) for c in ("zx1", "zy1", "zx2", "zy2")]
    return fx.zones.withColumn("points", geometry.rectangle(*corner))


@query("q016_ground_points", "SELECT job_id, track_id, frame, gx, gy FROM ground", GROUND)
def _(fx):
    return ground(fx).select("job_id", "track_id", "frame", "gx", "gy")


INSIDE = "gx >= zx1 AND gx < zx2 AND gy >= zy1 AND gy < zy2"


@query("q017_points_in_polygon", f"SELECT z.zone_id, count(*) AS n FROM ground g JOIN zones z ON z.project_id = g.project_id AND {INSIDE} GROUP BY 1", GROUND)
def _(fx):
    """Each point with the zones of its own site."""
    corners = shapes(fx).groupBy("project_id").agg(F.collect_list(F.struct("zone_id", "points")).alias("zs"))
    rows = ground(fx).select("project_id", "gx", "gy").join(corners, "project_id").select("gx", "gy", F.explode("zs").alias("z"))
    return rows.where(geometry.in_polygon(F.col("gx"), F.col("gy"), F.col("z.points"))).groupBy(F.col("z.zone_id").alias("zone_id")).agg(F.count("*").alias("n"))


@query(
    "q018_roadway_of_point",
    f"SELECT g.project_id, z.zone_id AS zone, count(*) AS n FROM (SELECT g.*, (SELECT min(zone_id) FROM zones z WHERE z.project_id = g.project_id AND kind = 'calzada' AND {INSIDE}) AS zone_id FROM ground g) g LEFT JOIN zones z USING (zone_id) GROUP BY ALL",
    GROUND,
)
def _(fx):
    return geometry.zone_of(ground(fx), shapes(fx), "calzada").groupBy("project_id", "zone").agg(F.count("*").alias("n"))


@query(
    "q019_on_road",
    f"""SELECT project_id, lane_id, count(*) AS n FROM ground g WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.project_id = g.project_id AND kind = 'excluir' AND {INSIDE})
        AND EXISTS (SELECT 1 FROM zones z WHERE z.project_id = g.project_id AND kind = 'calzada' AND {INSIDE}) GROUP BY ALL""",
    GROUND,
)
def _(fx):
    return geometry.on_road(ground(fx), shapes(fx)).groupBy("project_id", "lane_id").agg(F.count("*").alias("n"))


@query("q020_class_confidence", "SELECT class_name, count(*) AS n FROM points WHERE confidence >= CASE class_name WHEN 'bus' THEN 0.5 WHEN 'truck' THEN 0.6 ELSE 0.45 END GROUP BY 1")
def _(fx):
    return geometry.confident(fx.points, 0.45, {"bus": 0.5, "truck": 0.6}).groupBy("class_name").agg(F.count("*").alias("n"))


PAIRS = """
near AS (SELECT a.job_id, a.frame, a.track_id AS t1, b.track_id AS t2, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM boxes a JOIN boxes b ON a.job_id = b.job_id AND a.frame = b.frame AND a.track_id < b.track_id),
boxed_pairs AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS inter, (ax2 - ax1) * (ay2 - ay1) AS area_a, (bx2 - bx1) * (by2 - by1) AS area_b FROM near)"""


#: Each car's box again inside a truck's box that is twice as wide and high, on every third track.
NESTED = """
boxes AS (SELECT job_id, frame, track_id, class_name, x1, y1, x2, y2 FROM points
  UNION ALL SELECT job_id, frame, track_id + 5000000000, 'truck', x1 - (x2 - x1) / 2, y1 - (y2 - y1) / 2, x2 + (x2 - x1) / 2, y2 + (y2 - y1) / 2 FROM points WHERE track_id % 3 = 0)"""


def boxes(fx):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    own = fx.points.select("job_id", "frame", F.col("track_id").cast("long").alias("track_id"), "class_name", "x1", "y1", "x2", "y2")
    big = fx.points.where("track_id % 3 = 0").select(
        "job_id", "frame", (F.col("track_id") + F.lit(5000000000)).alias("track_id"), F.lit("truck").alias("class_name"),
        (F.col("x1") - w / 2).alias("x1"), (F.col("y1") - h / 2).alias("y1"), (F.col("x2") + w / 2).alias("x2"), (F.col("y2") + h / 2).alias("y2"),
    )
    return own.unionByName(big)


@query("q021_iou_containment", "SELECT job_id, frame, t1, t2, round(inter / (area_a + area_b - inter), 6) AS iou, round(inter / least(area_a, area_b), 6) AS containment FROM boxed_pairs", NESTED, PAIRS)
def _(fx):
    a = boxes(fx).select("job_id", "frame", F.col("track_id").alias("t1"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    b = boxes(fx).select("job_id", "frame", F.col("track_id").alias("t2"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    c = F.col
    rows = a.join(b, ["job_id", "frame"]).where("t1 < t2")
    iou = geometry.iou(c("ax1"), c("ay1"), c("ax2") - c("ax1"), c("ay2") - c("ay1"), c("bx1"), c("by1"), c("bx2") - c("bx1"), c("by2") - c("by1"))
    held = geometry.containment(*[c(f"a{k}") for k in ("x1", "y1", "x2", "y2")], *[c(f"b{k}") for k in ("x1", "y1", "x2", "y2")])
    return rows.select("job_id", "frame", "t1", "t2", F.round(iou, 6).alias("iou"), F.round(held, 6).alias("containment"))


NEST_RULE = """a.job_id = b.job_id AND a.frame = b.frame AND a.track_id <> b.track_id AND b.class_name IN ('bus', 'truck')
  AND (b.x2 - b.x1) * (b.y2 - b.y1) >= 2 * (a.x2 - a.x1) * (a.y2 - a.y1)
  AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 0.8 * (a.x2 - a.x1) * (a.y2 - a.y1)"""


@query("q022_drop_nested", f"SELECT job_id, track_id, count(*) AS n FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE {NEST_RULE}) GROUP BY ALL", NESTED)
def _(fx):
    return geometry.drop_nested(boxes(fx)).groupBy("job_id", "track_id").agg(F.count("*").alias("n"))


@query(
    "q023_born_inside",
    f"""SELECT job_id, track_id, heavy_id FROM (SELECT a.job_id, a.track_id, b.track_id AS heavy_id, row_number() OVER (PARTITION BY a.job_id, a.track_id ORDER BY (b.x2 - b.x1) * (b.y2 - b.y1) DESC, b.track_id) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id, track_id ORDER BY frame) AS f FROM boxes) a JOIN boxes b ON {NEST_RULE} WHERE a.f = 1) WHERE k = 1""",
    NESTED,
)
def _(fx):
    return geometry.born_inside(boxes(fx))


STEPS = """
steps AS (SELECT *, lag(gx) OVER w AS px, lag(gy) OVER w AS py, lag(frame) OVER w AS pframe, row_number() OVER w AS place FROM ground WINDOW w AS (PARTITION BY job_id, track_id ORDER BY frame))"""


@query("q025_level_crossings", "SELECT job_id, track_id, frame, CASE WHEN py < 960 AND gy >= 960 THEN 'in' ELSE 'out' END AS direction FROM steps WHERE (py < 960 AND gy >= 960) OR (py > 960 AND gy <= 960)", GROUND, STEPS)
def _(fx):
    return geometry.level_crossings(geometry.steps(ground(fx)), 960.0).select("job_id", "track_id", "frame", "direction")


# tilted, so that no point lies on a line and the sign of the turn decides
LINES = "tilted AS (SELECT lane_id, project_id, 0.0e0 AS x1, 955.5e0 AS y1, 3000.0e0 AS x2, 951.5e0 + lane_id AS y2 FROM lanes)"
TILTED = """
hits AS (SELECT s.job_id, s.track_id, s.frame, s.pframe, s.place, l.lane_id AS crossed_lane, (s.gx - s.px) * (l.y2 - l.y1) - (s.gy - s.py) * (l.x2 - l.x1) AS turn
  FROM steps s JOIN tilted l ON l.project_id = s.project_id
  WHERE s.px IS NOT NULL AND ((l.y2 - s.py) * (l.x1 - s.px) > (l.y1 - s.py) * (l.x2 - s.px)) <> ((l.y2 - s.gy) * (l.x1 - s.gx) > (l.y1 - s.gy) * (l.x2 - s.gx))
    AND ((l.y1 - s.py) * (s.gx - s.px) > (s.gy - s.py) * (l.x1 - s.px)) <> ((l.y2 - s.py) * (s.gx - s.px) > (s.gy - s.py) * (l.x2 - s.px)))"""


def tilted(fx):
    lines = fx.lanes.select("lane_id", "project_id", F.lit(0.0).alias("x1"), F.lit(955.5).alias("y1"), F.lit(3000.0).alias("x2"), (951.5 + F.col("lane_id")).alias("y2"))
    stepped = geometry.steps(ground(fx)).drop("x1", "y1", "x2", "y2")
    return geometry.segment_crossings(stepped, lines)


@query("q026_segment_crossings", "SELECT job_id, track_id, frame, crossed_lane, CASE WHEN turn > 0 THEN 'in' ELSE 'out' END AS direction FROM hits WHERE turn <> 0", GROUND, STEPS, LINES, TILTED)
def _(fx):
    return tilted(fx).select("job_id", "track_id", "frame", "crossed_lane", "direction")


@query(
    "q027_eligible_crossings",
    "SELECT job_id, track_id, crossed_lane, min(frame) AS frame FROM hits WHERE turn <> 0 AND place >= 3 AND frame - pframe <= 3 GROUP BY ALL",
    GROUND, STEPS, LINES, TILTED,
)
def _(fx):
    return geometry.eligible_crossings(tilted(fx)).select("job_id", "track_id", "crossed_lane", "frame")


@query(
    "q030_crossing_fraction",
    "SELECT job_id, track_id, frame, round((py - 950) / (py - gy), 6) AS s FROM steps WHERE px IS NOT NULL AND py <> 950 AND (gy = 950 OR (py > 950) <> (gy > 950)) AND gx BETWEEN 0 AND 3000",
    GROUND, STEPS,
)
def _(fx):
    return geometry.crossing_fraction(geometry.steps(ground(fx)), 0.0, 950.0, 3000.0, 950.0).select("job_id", "track_id", "frame", F.round("s", 6).alias("s"))


@query(
    "q031_moved",
    """SELECT job_id, track_id, round(reach, 6) AS reach, height, reach >= 2 * height AS moved FROM (SELECT g.job_id, g.track_id, max(sqrt((gx - fx) ** 2 + (gy - fy) ** 2)) AS reach, list(y2 - y1 ORDER BY y2 - y1)[1 + count(*) // 2] AS height
       FROM ground g JOIN (SELECT job_id, track_id, arg_min(gx, frame) AS fx, arg_min(gy, frame) AS fy FROM ground GROUP BY ALL) f USING (job_id, track_id) GROUP BY ALL)""",
    GROUND,
)
def _(fx):
    return rounded(geometry.moved(ground(fx), 2.0), "reach")


@query(
    "q039_best_view",
    """SELECT job_id, track_id, frame, gx - 0.75 * h AS x, gy - h AS y, 1.5 * h AS w, h FROM (SELECT *, y2 - y1 AS h, row_number() OVER (PARTITION BY job_id, track_id ORDER BY y2 - y1 DESC, frame) AS k FROM ground) WHERE k = 1""",
    GROUND,
)
def _(fx):
    return geometry.best_view(ground(fx))


@query(
    "q157_cordon_crossings",
    """SELECT job_id, track_id, direction, t FROM (SELECT job_id, track_id, frame, CASE WHEN ny > gy THEN 'in' ELSE 'out' END AS direction, (frame + nframe) / 2 AS t, row_number() OVER (PARTITION BY job_id, track_id ORDER BY frame) AS k
       FROM (SELECT *, lead(gy) OVER w AS ny, lead(frame) OVER w AS nframe FROM ground WINDOW w AS (PARTITION BY job_id, track_id ORDER BY frame)) WHERE (gy - 955) * (ny - 955) < 0) WHERE k = 1""",
    GROUND,
)
def _(fx):
    return geometry.cordon_crossings(ground(fx), 955.0)


# ---- quality


@query(
    "q108_hot_cells",
    """SELECT project_id, cx, cy, n, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, cy, cx) AS place FROM (
       SELECT project_id, CAST(floor(gx / 80) AS BIGINT) AS cx, CAST(floor(gy / 80) AS BIGINT) AS cy, count(*) AS n FROM steps WHERE place = 1 GROUP BY ALL)) WHERE place <= 15""",
    GROUND, STEPS,
)
def _(fx):
    starts = geometry.steps(ground(fx)).where("place = 1").drop("place")
    return quality.hot_cells(starts, ["project_id"], "gx", "gy")


@query(
    "q109_density_map",
    """SELECT project_id, px, py, round(255 * heat / max(heat) OVER (PARTITION BY project_id), 4) AS heat FROM (
       SELECT project_id, x + dx.d AS px, y + dy.d AS py, sum(n * exp(-sqrt(dx.d * dx.d + dy.d * dy.d) / 3)) AS heat FROM (SELECT project_id, CAST(floor(gx) AS BIGINT) AS x, CAST(floor(gy) AS BIGINT) AS y, count(*) AS n FROM ground GROUP BY ALL),
       (SELECT unnest(range(-5, 6)) AS d) dx, (SELECT unnest(range(-5, 6)) AS d) dy GROUP BY ALL)""",
    GROUND,
)
def _(fx):
    return quality.density(ground(fx), ["project_id"], "gx", "gy").withColumn("heat", F.round("heat", 4))


@query(
    "q110_flow_conservation",
    """SELECT project_id, hh, count(*) AS "any", count(*) FILTER (lines = 3) AS all_three, round(count(*) FILTER (lines = 3) / count(*), 6) AS ratio FROM (
       SELECT project_id, hh, track_id, count(DISTINCT CASE WHEN track_id % 10 < 9 THEN line ELSE 1 END) AS lines FROM crossings, (VALUES (1), (2), (3)) AS l(line) GROUP BY ALL) GROUP BY ALL""",
)
def _(fx):
    rows = fx.crossings.select("project_id", "hh", "track_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("line"))
    return quality.flow_conservation(rows.withColumn("line", F.when(F.col("track_id") % 10 < 9, F.col("line")).otherwise(1)))


@query(
    "q126_night_switch",
    """SELECT project_id, min(minute) AS switch FROM (SELECT *, max(saturation) OVER (PARTITION BY project_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS peak FROM (
       SELECT project_id, CAST(hh * 60 + minute(ts) AS INTEGER) AS minute, avg(CASE WHEN hh < 19 THEN bbox_height % 40 ELSE bbox_height % 12 END) AS saturation FROM crossings GROUP BY ALL)) WHERE peak < 15 GROUP BY 1""",
)
def _(fx):
    value = F.when(F.col("hh") < 19, F.col("bbox_height") % 40).otherwise(F.col("bbox_height") % 12)
    rows = fx.crossings.groupBy("project_id", (F.col("hh") * 60 + F.minute("ts")).cast("int").alias("minute")).agg(F.avg(value).alias("saturation"))
    return quality.night_switch(rows)


@query(
    "q128_headings",
    """SELECT lane_id, sector, n, CAST((sector * 45 + 90) % 360 AS INTEGER) AS line_angle FROM (SELECT lane_id, CAST(floor(((degrees(atan2(y1 - y0, x1 - x0)) + 22.5 + 360) % 360) / 45) AS INTEGER) AS sector, count(*) AS n FROM (
       SELECT lane_id, job_id, track_id, arg_min(gx, frame) AS x0, arg_min(gy, frame) AS y0, arg_max(gx, frame) AS x1, arg_max(gy, frame) AS y1 FROM ground GROUP BY ALL) GROUP BY ALL)""",
    GROUND,
)
def _(fx):
    ends = ground(fx).groupBy("lane_id", "job_id", "track_id").agg(F.min_by("gx", "frame").alias("x0"), F.min_by("gy", "frame").alias("y0"), F.max_by("gx", "frame").alias("x1"), F.max_by("gy", "frame").alias("y1"))
    return quality.headings(ends)


# ---- validation

MATCHED = "matched AS (SELECT o.project_id, o.lane_id, o.dd, o.minuto, m.n AS n_hand, o.n AS n_ours FROM ours o JOIN manual m ON o.project_id = m.project_id AND o.lane_id = m.lane_id AND o.dd = m.dd AND o.minuto = m.minuto)"
GEH = "gehs AS (SELECT *, sqrt(2 * (4.0e0 * n_ours - 4.0e0 * n_hand) ** 2 / (4.0e0 * n_ours + 4.0e0 * n_hand)) AS geh FROM matched)"


def matched(fx):
    rows = joins.quarters_against_hand(ours_of(fx), fx.manual, ["project_id", "lane_id", "dd", "minuto"])
    return rows.where("state = 'both'").drop("state")


@query("q099_geh", "SELECT project_id, lane_id, dd, minuto, n_hand, n_ours, round(geh, 6) AS geh, geh < 5 AS passes FROM gehs", OURS, MATCHED, GEH)
def _(fx):
    return rounded(validate.geh_table(matched(fx)), "geh")


@query(
    "q099_acceptance",
    "SELECT lane_id, count(*) AS n, count(*) FILTER (geh < 5) AS passing, round(sum(n_ours) / sum(n_hand), 6) AS ratio, count(*) FILTER (geh < 5) >= 0.85 * count(*) AS accepted FROM gehs GROUP BY 1",
    OURS, MATCHED, GEH,
)
def _(fx):
    return rounded(validate.acceptance(validate.geh_table(matched(fx)), ["lane_id"]), "ratio")


@query(
    "q100_partly_covered",
    """SELECT lane_id, dd, minuto, round(n_hand * cov, 6) AS n_hand, n_ours, round(sqrt(2 * (n_ours / (0.25e0 * cov) - n_hand * cov / (0.25e0 * cov)) ** 2 / (n_ours / (0.25e0 * cov) + n_hand * cov / (0.25e0 * cov))), 6) AS geh
       FROM (SELECT *, 0.75e0 + (minuto % 4 + dd % 3) / 12.0e0 AS cov FROM matched) WHERE cov >= 0.85e0""",
    OURS, MATCHED,
)
def _(fx):
    rows = matched(fx).withColumn("coverage", 0.75 + (F.col("minuto") % 4 + F.col("dd") % 3) / 12.0)
    return rounded(validate.scaled_by_coverage(rows), "n_hand", "geh").select("lane_id", "dd", "minuto", "n_hand", "n_ours", "geh")


@query(
    "q102_profile_agreement",
    """SELECT lane_id, round(sum(n_ours) / sum(n_hand), 6) AS ratio, round(corr(n_ours, n_hand), 6) AS r, round(stddev_pop(n_hand) / avg(n_hand), 6) AS cv, stddev_pop(n_hand) / avg(n_hand) < 0.12 AS flat FROM matched GROUP BY 1""",
    OURS, MATCHED,
)
def _(fx):
    return rounded(validate.profile_agreement(matched(fx), ["lane_id"]), "ratio", "r", "cv")


@query(
    "q103_clock_offset",
    """SELECT project_id, shift, round(sum(abs(scale * n - n_hand)) / sum(n_hand), 6) AS error FROM (
         SELECT *, CASE WHEN sum(n) OVER w > 0 THEN sum(n_hand) OVER w / sum(n) OVER w ELSE 0 END AS scale FROM (
           SELECT q.project_id, q.lane_id, q.quarter, s.shift, q.n_hand, (SELECT count(*) FROM per_minute p WHERE p.lane_id = q.lane_id AND (p.minute + s.shift + 1440) % 1440 BETWEEN q.quarter AND q.quarter + 14) AS n
           FROM (SELECT l.project_id, l.lane_id, c.quarter, coalesce(h.n_hand, 0) AS n_hand FROM (SELECT DISTINCT project_id, lane_id FROM hand) l JOIN (SELECT DISTINCT project_id, quarter FROM hand) c USING (project_id)
             LEFT JOIN hand h ON h.lane_id = l.lane_id AND h.quarter = c.quarter) q, (SELECT unnest(range(-10, 11)) AS shift) s WHERE (SELECT count(DISTINCT p.minute) FROM covered_minutes p WHERE p.project_id = q.project_id AND (p.minute + s.shift + 1440) % 1440 BETWEEN q.quarter AND q.quarter + 14) = 15)
         WINDOW w AS (PARTITION BY project_id, lane_id, shift)) GROUP BY ALL""",
    "per_minute AS (SELECT project_id, lane_id, CAST(hh * 60 + minute(ts) AS INTEGER) AS minute FROM crossings)",
    "covered_minutes AS (SELECT DISTINCT p.project_id, CAST(m AS INTEGER) AS minute FROM (SELECT DISTINCT project_id FROM crossings) p, (SELECT unnest(range(420, 1140)) AS m))",
    "hand AS (SELECT project_id, lane_id, minuto AS quarter, CAST(sum(n) AS BIGINT) AS n_hand FROM manual WHERE minuto BETWEEN 420 AND 1125 GROUP BY ALL)",
)
def _(fx):
    minutes = fx.crossings.groupBy("project_id", "lane_id", (F.col("hh") * 60 + F.minute("ts")).cast("int").alias("minute")).agg(F.count("*").alias("n"))
    hand = fx.manual.where("minuto BETWEEN 420 AND 1125").groupBy("project_id", "lane_id", F.col("minuto").alias("quarter")).agg(F.sum("n").alias("n_hand"))
    covered = fx.crossings.select("project_id").distinct().select("project_id", F.explode(F.sequence(F.lit(420), F.lit(1139))).alias("minute"))
    return rounded(validate.clock_offset(minutes, hand, covered), "error")


@query(
    "q121_headway_clusters",
    """SELECT lane_id, quarter, count(*) FILTER (gap IS NULL OR gap >= 4) AS n FROM (SELECT lane_id, quarter, sec - lag(sec) OVER (PARTITION BY lane_id, quarter ORDER BY sec, id) AS gap FROM (
       SELECT id, lane_id, hidx * 3600 + cuadro / 20.0e0 AS sec, CAST(floor((hidx * 3600 + cuadro / 20.0e0) / 900) * 900 AS BIGINT) AS quarter FROM crossings)) GROUP BY ALL""",
)
def _(fx):
    return validate.headway_clusters(fx.crossings.withColumn("at", F.col("hidx") * 3600 + F.col("cuadro") / 20.0), 4.0)


@query(
    "q105_confusion",
    """SELECT klass, coalesce(t.n, 0) AS truth_n, coalesce(g.n, 0) AS guess_n, coalesce(r.n, 0) AS "right", round(coalesce(r.n, 0) / nullif(g.n, 0), 6) AS precision, round(coalesce(r.n, 0) / nullif(t.n, 0), 6) AS recall,
       round(coalesce(g.n, 0) / sum(coalesce(g.n, 0)) OVER () - coalesce(t.n, 0) / sum(coalesce(t.n, 0)) OVER (), 6) AS gap
       FROM (SELECT vehicle_type AS klass, count(*) AS n FROM crossings GROUP BY 1) t FULL JOIN (SELECT CASE WHEN id % 7 = 0 THEN 'truck' ELSE vehicle_type END AS klass, count(*) AS n FROM crossings GROUP BY 1) g USING (klass)
       LEFT JOIN (SELECT vehicle_type AS klass, count(*) AS n FROM crossings WHERE id % 7 <> 0 OR vehicle_type = 'truck' GROUP BY 1) r USING (klass)""",
)
def _(fx):
    rows = fx.crossings.withColumn("guess", F.when(F.col("id") % 7 == 0, "truck").otherwise(F.col("vehicle_type")))
    return rounded(validate.confusion(rows, "vehicle_type", "guess"), "precision", "recall", "gap")


@query(
    "q096_best_multiplier",
    """SELECT lane_id, k / 100 AS multiplier, CAST(gap AS BIGINT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY lane_id ORDER BY gap, k) AS place FROM (
       SELECT t.lane_id, g.k, abs((SELECT count(*) FROM crossings c WHERE c.lane_id = t.lane_id AND c.vehicle_type IN ('truck', 'bus') AND c.bbox_height > g.k / 100 * t.m) - t.hand) AS gap
       FROM (SELECT lane_id, median(bbox_height) FILTER (vehicle_type = 'car') AS m, count(*) FILTER (vehicle_type = 'bus') AS hand FROM crossings GROUP BY 1) t, (SELECT unnest(range(100, 401)) AS k) g)) WHERE place = 1""",
)
def _(fx):
    heavy = fx.crossings.where("vehicle_type IN ('truck', 'bus')")
    hand = fx.crossings.groupBy("lane_id").agg(F.count_if(F.col("vehicle_type") == "bus").alias("n_hand"))
    return validate.best_multiplier(heavy, fx.crossings.where("vehicle_type = 'car'"), hand)


@query(
    "q097_two_group_split",
    """SELECT lane_id, cut, round("between", 3) AS "between" FROM (SELECT *, row_number() OVER (PARTITION BY lane_id ORDER BY "between" DESC, cut) AS k FROM (
       SELECT lane_id, bbox_height AS cut, n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) AS "between" FROM (
       SELECT lane_id, bbox_height, sum(c) OVER o AS n0, sum(c * bbox_height) OVER o AS s0, sum(c) OVER g AS n, sum(c * bbox_height) OVER g AS s FROM (SELECT lane_id, bbox_height, count(*) AS c FROM crossings GROUP BY ALL)
       WINDOW o AS (PARTITION BY lane_id ORDER BY bbox_height), g AS (PARTITION BY lane_id)) WHERE n0 >= 0.1 * n AND n - n0 >= 0.1 * n)) WHERE k = 1""",
)
def _(fx):
    return validate.two_group_split(fx.crossings, ["lane_id"]).withColumn("between", F.round("between", 3))


@query(
    "q098_silhouettes",
    """SELECT lane_id, vehicle_type, count(*) AS n, quantile_cont(bbox_height, 0.25) AS h25, quantile_cont(bbox_height, 0.5) AS h50, quantile_cont(bbox_height, 0.75) AS h75, round(median(bbox_width / bbox_height), 6) AS ratio, round(median(confidence), 6) AS confidence
       FROM crossings GROUP BY ALL""",
)
def _(fx):
    h = F.percentile("bbox_height", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = fx.crossings.groupBy("lane_id", "vehicle_type").agg(F.count("*").alias("n"), h.alias("h"), F.percentile(F.col("bbox_width") / F.col("bbox_height"), 0.5).alias("ratio"), F.percentile("confidence", 0.5).alias("confidence"))
    return rounded(out.select("lane_id", "vehicle_type", "n", *[F.col("h")[i].alias(f"h{q}") for i, q in enumerate((25, 50, 75))], "ratio", "confidence"), "ratio", "confidence")


@query(
    "q104_composition_gap",
    """SELECT lane_id, vehicle_type, round(coalesce(a, 0), 6) AS share_ours, round(coalesce(b, 0), 6) AS share_ref, round(coalesce(a, 0) - coalesce(b, 0), 6) AS points FROM
       (SELECT lane_id, vehicle_type, 100.0 * n / sum(n) OVER (PARTITION BY lane_id) AS a FROM (SELECT lane_id, vehicle_type, count(*) AS n FROM crossings WHERE hh % 2 = 0 GROUP BY ALL))
       FULL JOIN (SELECT lane_id, vehicle_type, 100.0 * n / sum(n) OVER (PARTITION BY lane_id) AS b FROM (SELECT lane_id, vehicle_type, count(*) AS n FROM crossings WHERE hh % 2 = 1 GROUP BY ALL)) USING (lane_id, vehicle_type)""",
)
def _(fx):
    n = lambda rest: fx.crossings.where(f"hh % 2 = {rest}").groupBy("lane_id", "vehicle_type").agg(F.count("*").alias("n"))
    return rounded(validate.composition_gap(n(0), n(1), ["lane_id"], "vehicle_type"), "share_ours", "share_ref", "points")


@query(
    "q055_choose_references",
    """SELECT source, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, min(rank) OVER (PARTITION BY project_id, direction, dd) AS best FROM (
       SELECT project_id, direction, CAST(date_part('day', ts) AS INTEGER) AS dd, CASE WHEN vehicle_type = 'bus' AND id % 3 = 0 THEN 'hand' WHEN id % 5 = 0 THEN 'class' ELSE 'volume' END AS source,
       CASE WHEN vehicle_type = 'bus' AND id % 3 = 0 THEN 0 WHEN id % 5 = 0 THEN 1 ELSE 2 END AS rank, count(*) AS n FROM crossings GROUP BY ALL)) WHERE rank = best GROUP BY 1""",
)
def _(fx):
    source = F.when((F.col("vehicle_type") == "bus") & (F.col("id") % 3 == 0), "hand").when(F.col("id") % 5 == 0, "class").otherwise("volume")
    rows = fx.crossings.groupBy("project_id", "direction", F.dayofmonth("ts").alias("dd"), source.alias("source")).agg(F.count("*").alias("n"))
    return validate.choose_references(rows).groupBy("source").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


@query(
    "q101_reliability",
    """SELECT lane_id, n_ours, n_hand, round(geh, 6) AS geh, CASE WHEN n_hand IS NOT NULL AND geh < 5 THEN 'Validado' WHEN n_hand IS NOT NULL THEN 'No pasó' WHEN complete_share >= 0.60 THEN 'Medido' WHEN complete_share >= 0.45 THEN 'Con reservas' ELSE 'Poco confiable' END AS level,
       CASE WHEN n_hand < 30 AND abs(n_ours - n_hand) > 0.3 * n_hand THEN 'orden de magnitud' ELSE '' END AS note FROM (
       SELECT o.lane_id, o.n AS n_ours, h.n AS n_hand, sqrt(2.0e0 * (o.n - h.n) * (o.n - h.n) / (o.n + h.n)) AS geh, 0.5e0 AS complete_share FROM (SELECT lane_id, count(*) AS n FROM crossings GROUP BY 1) o
       LEFT JOIN (SELECT lane_id, CAST(sum(n) AS BIGINT) AS n FROM manual WHERE lane_id <> 4 GROUP BY 1) h USING (lane_id))""",
)
def _(fx):
    ours = fx.crossings.groupBy("lane_id").agg(F.count("*").alias("n_ours"))
    hand = fx.manual.where("lane_id <> 4").groupBy("lane_id").agg(F.sum("n").alias("n_hand"))
    rows = ours.join(hand, "lane_id", "left").withColumn("complete_share", F.lit(0.5))
    rows = rows.withColumn("geh", F.when(F.col("n_hand").isNotNull(), C.geh(F.col("n_ours").cast("double"), F.col("n_hand").cast("double"))))
    return rounded(validate.reliability(rows), "geh").drop("complete_share")
