"""Geometry of boxes, polygons and lines on track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ground_x(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of boxes given as corner, width and height."""
    inter = _overlap(ax, ax + aw, bx, bx + bw) * _overlap(ay, ay + ah, by, by + bh)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(a1: Column, b1: Column, a2: Column, b2: Column, c1: Column, d1: Column, c2: Column, d2: Column) -> Column:
    """Intersection over the smaller box, boxes as x1, y1, x2, y2."""
    inter = _overlap(a1, a2, c1, c2) * _overlap(b1, b2, d1, d2)
    least = F.least((a2 - a1) * (b2 - b1), (c2 - c1) * (d2 - d1))
    return F.when(least > 0, inter / least).otherwise(F.lit(0.0))


def _overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting; points is an array of (x, y) structs. A side of the polygon counts if it crosses the height of y right of x."""
    n = F.size(points)
    sides = F.sequence(F.lit(0), n - 1)

    def crossed(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, F.when(i == 0, n - 1).otherwise(i - 1))
        side = _side(p["x"], p["y"], q["x"], q["y"], x, y)
        return ((p["y"] <= y) & (q["y"] > y) & (side > 0)) | ((p["y"] > y) & (q["y"] <= y) & (side < 0))

    return F.size(F.filter(sides, crossed)) % 2 == 1


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle's corners as a polygon."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2))


def zone_of(points: DataFrame, zones: DataFrame, kind: str) -> DataFrame:
    """points with zone: the first zone of the kind (by id) of the site that holds the ground point, else null.

    A site's zones travel as one short array with each point, so there is no join by geometry."""
    own = zones.where(F.col("kind") == kind).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("zone_id", "points"))).alias("__zones"))
    rows = points.join(own, "project_id", "left")
    hits = F.filter("__zones", lambda z: in_polygon(F.col("gx"), F.col("gy"), z["points"]))
    return rows.withColumn("zone", F.get(hits, F.lit(0))["zone_id"]).drop("__zones")


def on_road(points: DataFrame, zones: DataFrame) -> DataFrame:
    """The points to keep: none inside an excluded zone; only those in a roadway where the site has any."""
    rows = zone_of(zone_of(points, zones, "excluir").withColumnRenamed("zone", "__out"), zones, "calzada").withColumnRenamed("zone", "__road")
    has = zones.where("kind = 'calzada'").select("project_id").distinct().withColumn("__has", F.lit(True))
    kept = rows.join(has, "project_id", "left").where("__out IS NULL AND (__has IS NULL OR __road IS NOT NULL)")
    return kept.drop("__out", "__road", "__has")


def confident(detections: DataFrame, general: float, by_class: dict[str, float], name: str = "class_name") -> DataFrame:
    """Detections at their class's threshold, or at the general one."""
    own = F.create_map(*[x for k, v in by_class.items() for x in (F.lit(k), F.lit(v))]) if by_class else None
    limit = F.coalesce(own[F.col(name)], F.lit(general)) if by_class else F.lit(general)
    return detections.where(F.col("confidence") >= limit)


def drop_nested(boxes: DataFrame, share: float = 0.8, times: float = 2.0) -> DataFrame:
    """Boxes without those that lie mostly inside a bus or truck of twice their area in the same frame."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    own = boxes.withColumn("area", area)
    big = own.where(F.col("class_name").isin("bus", "truck")).select("job_id", "frame", *[F.col(c).alias(f"o_{c}") for c in ("track_id", "x1", "y1", "x2", "y2", "area")])
    inter = _overlap(F.col("x1"), F.col("x2"), F.col("o_x1"), F.col("o_x2")) * _overlap(F.col("y1"), F.col("y2"), F.col("o_y1"), F.col("o_y2"))
    rule = (own["job_id"] == big["job_id"]) & (own["frame"] == big["frame"]) & (F.col("track_id") != F.col("o_track_id")) & (F.col("o_area") >= times * F.col("area")) & (inter >= share * F.col("area"))
    return own.join(big, rule, "left_anti").drop("area")


def born_inside(points: DataFrame, share: float = 0.8, times: float = 2.0) -> DataFrame:
    """(job_id, track_id, heavy_id): tracks whose first box lies in a bus or truck of twice its area; the largest, then the least id."""
    first = points.withColumn("place", F.row_number().over(Window.partitionBy("job_id", "track_id").orderBy("frame"))).where("place = 1").drop("place")
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    big = points.where(F.col("class_name").isin("bus", "truck")).select("job_id", "frame", F.col("track_id").alias("heavy_id"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    inter = _overlap(F.col("x1"), F.col("x2"), F.col("o_x1"), F.col("o_x2")) * _overlap(F.col("y1"), F.col("y2"), F.col("o_y1"), F.col("o_y2"))
    both = first.join(big, ["job_id", "frame"]).where((F.col("track_id") != F.col("heavy_id")) & (area("o_") >= times * area("")) & (inter >= share * area("")))
    order = Window.partitionBy("job_id", "track_id").orderBy(area("o_").desc(), "heavy_id")
    return both.withColumn("place", F.row_number().over(order)).where("place = 1").select("job_id", "track_id", "heavy_id")


def steps(points: DataFrame) -> DataFrame:
    """Each point of a track with the one before it (px, py, pframe) and its number in the track."""
    order = Window.partitionBy("job_id", "track_id").orderBy("frame")
    return points.withColumns({"px": F.lag("gx").over(order), "py": F.lag("gy").over(order), "pframe": F.lag("frame").over(order), "place": F.row_number().over(order)})


def level_crossings(stepped: DataFrame, level: float, axis: str = "y") -> DataFrame:
    """Steps over a horizontal (axis y) or vertical line: upwards in value is in, downwards out."""
    a, b = F.col(f"p{axis}"), F.col(f"g{axis}")
    way = F.when((a < level) & (b >= level), "in").when((a > level) & (b <= level), "out")
    return stepped.withColumn("direction", way).where("direction IS NOT NULL")


def _side(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segment_crossings(stepped: DataFrame, lines: DataFrame) -> DataFrame:
    """Steps over any line of the site: lines has project_id, lane_id, x1, y1, x2, y2 (a few rows a site)."""
    own = lines.groupBy("project_id").agg(F.collect_list(F.struct("lane_id", "x1", "y1", "x2", "y2")).alias("__lines"))
    rows = stepped.where("px IS NOT NULL").join(own, "project_id").withColumn("line", F.explode("__lines")).drop("__lines")
    ccw = lambda a, b, c: (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])
    p, q = (F.col("px"), F.col("py")), (F.col("gx"), F.col("gy"))
    a, b = (F.col("line.x1"), F.col("line.y1")), (F.col("line.x2"), F.col("line.y2"))
    hit = (ccw(p, a, b) != ccw(q, a, b)) & (ccw(p, q, a) != ccw(p, q, b))
    turn = (q[0] - p[0]) * (b[1] - a[1]) - (q[1] - p[1]) * (b[0] - a[0])
    way = F.when(turn > 0, "in").when(turn < 0, "out")
    return rows.where(hit).withColumn("direction", way).where("direction IS NOT NULL").withColumn("crossed_lane", F.col("line.lane_id"))


def eligible_crossings(crossed: DataFrame, least_points: int = 3, most_gap: int = 3) -> DataFrame:
    """The first crossing of each track and line with three points so far and at most two frames unseen before it."""
    usable = crossed.where((F.col("place") >= least_points) & (F.col("frame") - F.col("pframe") <= most_gap))
    order = Window.partitionBy("job_id", "track_id", "crossed_lane").orderBy("frame")
    return usable.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def crossing_fraction(stepped: DataFrame, ax: float, ay: float, bx: float, by: float) -> DataFrame:
    """Steps that cut the segment a-b with s in (0, 1]: landing on it counts, starting on it doesn't."""
    a, b = (F.lit(ax), F.lit(ay)), (F.lit(bx), F.lit(by))
    p, q = (F.col("px"), F.col("py")), (F.col("gx"), F.col("gy"))
    d0, d1 = _side(*a, *b, *p), _side(*a, *b, *q)
    e0, e1 = _side(*p, *q, *a), _side(*p, *q, *b)
    misses = (d0 == 0) | ((d1 != 0) & ((d0 > 0) == (d1 > 0))) | ((e0 != 0) & (e1 != 0) & ((e0 > 0) == (e1 > 0)))
    return stepped.where("px IS NOT NULL").where(~misses).withColumn("s", d0 / (d0 - d1))


def moved(points: DataFrame, times: float) -> DataFrame:
    """(job_id, track_id, reach, height, moved): the greatest distance from the first point against the median height (upper of two)."""
    order = Window.partitionBy("job_id", "track_id").orderBy(F.asc_nulls_last("frame")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when(F.col("frame").isNotNull(), F.struct("gx", "gy"))).over(order)
    rows = points.select("job_id", "track_id", "frame", "gx", "gy", (F.col("y2") - F.col("y1")).alias("h")).withColumn("first", first)
    away = F.hypot(F.col("gx") - F.col("first.gx"), F.col("gy") - F.col("first.gy"))
    sums = rows.groupBy("job_id", "track_id").agg(F.max(away).alias("reach"), F.sort_array(F.collect_list("h")).alias("hs"))
    height = F.get("hs", F.floor(F.size("hs") / 2).cast("int"))
    return sums.select("job_id", "track_id", "reach", height.alias("height"), (F.col("reach") >= times * height).alias("moved"))


def cordon_crossings(points: DataFrame, level: float) -> DataFrame:
    """(job_id, track_id, direction, t): the first strict crossing of the level by each path, at the mean frame of the two points."""
    order = Window.partitionBy("job_id", "track_id").orderBy("frame")
    rows = points.withColumns({"ny": F.lead("gy").over(order), "nframe": F.lead("frame").over(order)})
    rows = rows.where((F.col("gy") - level) * (F.col("ny") - level) < 0)
    way = F.when(F.col("ny") > F.col("gy"), "in").otherwise("out")
    one = rows.groupBy("job_id", "track_id").agg(F.min_by(F.struct(way.alias("direction"), ((F.col("frame") + F.col("nframe")) / 2).alias("t")), "frame").alias("f"))
    return one.select("job_id", "track_id", "f.direction", "f.t")


def best_view(points: DataFrame) -> DataFrame:
    """(job_id, track_id, frame, x, y, w, h): the box at the point of greatest height; the earliest of equals."""
    h = F.col("y2") - F.col("y1")
    best = points.groupBy("job_id", "track_id").agg(F.max_by(F.struct("frame", "gx", "gy", h.alias("h")), F.struct(h, -F.col("frame"))).alias("b"))
    return best.select("job_id", "track_id", "b.frame", (F.col("b.gx") - 0.75 * F.col("b.h")).alias("x"), (F.col("b.gy") - F.col("b.h")).alias("y"), (1.5 * F.col("b.h")).alias("w"), "b.h")
