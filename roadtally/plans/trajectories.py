"""Whole trajectories, track and detection files read back, and axle counters: queries, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import fragments, geometry, imports, shapes, tracks, trajectories
from roadtally.plans.counts import STAMP
from roadtally.plans.fixtures import Fixtures, oracle
from roadtally.plans.measures import GROUND, LINES, STEPS, TILTED, ground, tilted
from roadtally.plans.paths import LATE, whole_paths
from roadtally.sources import files, sinks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


@query("q001_typed_crossings", f"SELECT id, {STAMP.format('ts')} AS ts, CAST(confidence AS DOUBLE) AS confidence, CAST(bbox_x AS DOUBLE) AS x FROM crossings")
def _(fx):
    """Rows kept as text, with the line that was crossed as JSON, read in the table's own types."""
    place = sinks.shared_place(fx.spark, "typed")
    line = F.to_json(F.array(F.array(F.lit(0.0), F.lit(960.0)), F.array(F.col("bbox_x").cast("double"), F.lit(960.0))))
    fx.crossings.select(F.col("id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("confidence").cast("string"), line.alias("tramo_json")).write.parquet(place)
    back = files.read_table(fx.spark, place, "id long, ts timestamp_ntz, confidence double, notes string", {"tramo_json": "tramo"})
    return back.select("id", C.stamp(F.col("ts")).alias("ts"), "confidence", F.col("tramo")[1][0].alias("x"))


@query("q002_track_files", "SELECT track_id, frame, x1, y1, x2, y2, confidence, 20.0e0 AS fps FROM points")
def _(fx):
    """One JSON file for each segment, read back."""
    p = F.array(F.col("frame").cast("double"), "x1", "y1", "x2", "y2", "confidence")
    each = fx.points.groupBy("job_id", "track_id").agg(F.array_sort(F.collect_list(p)).alias("p"), F.first("class_name").alias("c"))
    track = F.struct(F.create_map("c", F.size("p")).alias("clases"), "p")
    whole = each.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("track_id").cast("string"), track))).alias("tracks"))
    place = sinks.shared_place(fx.spark, "tracks")
    whole.select(F.to_json(F.struct(F.lit(20.0).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(72000).alias("frames"), "tracks"))).write.option("maxRecordsPerFile", 1).text(place)
    return files.read_track_files(fx.spark, place).select("track_id", "frame", "x1", "y1", "x2", "y2", "confidence", "fps")


@query(
    "q003_detection_files",
    """SELECT dense_rank() OVER (PARTITION BY job_id ORDER BY frame) - 1 AS frame, row_number() OVER (PARTITION BY job_id, frame ORDER BY track_id) - 1 AS box_no, x1, y1, x2, y2, confidence, class_name FROM points""",
)
def _(fx):
    """One JSON file for each segment, with the boxes of each frame that has any, read back."""
    number = F.create_map(*[x for k, v in files.CLASSES.items() for x in (F.lit(v), F.lit(float(k)))])
    box = F.struct("track_id", F.array("x1", "y1", "x2", "y2", "confidence", number[F.col("class_name")]).alias("b"))
    each = fx.points.groupBy("job_id", "frame").agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: x["b"]).alias("boxes"))
    whole = each.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "boxes"))), lambda x: x["boxes"]).alias("frames"))
    place = sinks.shared_place(fx.spark, "detections")
    whole.select(F.to_json(F.struct("frames"))).write.option("maxRecordsPerFile", 1).text(place)
    return files.read_detection_files(fx.spark, place).drop("file")


AXLE_NAMES = ", ".join(f"('{c}')" for c in imports.AXLE_CLASSES)


@query(
    "q005_axle_counter_sheets",
    f"""SELECT book, 'clasificatorio' AS kind, lane, strftime(DATE '2024-01-01' + CAST(dd - 1 + CASE WHEN hh < 6 AND latest >= 6 THEN 1 ELSE 0 END AS INTEGER), '%Y-%m-%d') AS date, hh * 60 AS minute, label,
        CAST(CASE label WHEN 'Cars' THEN cars WHEN 'Cycle' THEN cycles WHEN 'Buses' THEN buses WHEN '4A-ST' THEN trucks ELSE 0 END AS DOUBLE) AS n
        FROM hours, (VALUES {AXLE_NAMES}) k(label) WHERE total % 10 <> 9""",
    """hours AS (SELECT concat_ws('-', project_id, dd) AS book, lane_id AS lane, *, max(hh) OVER (PARTITION BY lane_id, dd) AS latest FROM (SELECT project_id, lane_id, day(ts) AS dd, hh, count(*) AS total, count(*) FILTER (vehicle_type = 'car') AS cars,
       count(*) FILTER (vehicle_type = 'motorcycle') AS cycles, count(*) FILTER (vehicle_type = 'bus') AS buses, count(*) FILTER (vehicle_type = 'truck') AS trucks FROM crossings GROUP BY ALL))""",
)
def _(fx):
    """A sheet for each site and day that starts at six in the morning; totals that end in 9 are off by one, and a sum and a summary follow."""
    kinds = ["motorcycle", "car", "bus", "truck"]
    hours = fx.crossings.groupBy("project_id", "lane_id", F.day("ts").alias("dd"), "hh").agg(F.count("*").alias("total"), *[F.count_if(F.col("vehicle_type") == k).alias(k) for k in kinds])
    book = F.concat_ws("-", "project_id", "dd")
    line = F.col("lane_id") * 100 + (F.col("hh") + 18) % 24
    cell = lambda row, c, text, number: F.struct(row.cast("int").alias("row"), F.lit(c).alias("col"), text.cast("string").alias("text"), number.cast("double").alias("number"))
    none = F.lit(None)
    column = {"Cycle": "motorcycle", "Cars": "car", "Buses": "bus", "4A-ST": "truck"}
    values = [F.col(column[c]) if c in column else F.lit(0) for c in imports.AXLE_CLASSES]
    first = F.min("line").over(Window.partitionBy("project_id", "dd", "lane_id")) == F.col("line")
    off = F.col("total") + (F.col("total") % 10 == 9).cast("int")
    body = hours.withColumn("line", line).withColumn("serial", F.when(first, 45_291 + F.col("dd")))
    body = body.select(book.alias("book"), F.explode(F.array(cell(F.col("line"), 0, none, F.col("serial")), cell(F.col("line"), 1, none, F.col("hh") / 24), *[cell(F.col("line"), i + 2, none, v) for i, v in enumerate(values)], cell(F.col("line"), 15, none, off))).alias("x"))
    lanes = hours.select(book.alias("book"), "lane_id").distinct()
    start = F.col("lane_id") * 100
    name = F.concat(F.lit("Lane #"), F.col("lane_id"), F.lit(" Axle Data From: 01/01/2024"))
    sums = [cell(start + 40, 0, F.lit("Daily Total"), none), *[cell(start + 40, i, none, F.lit(0.5)) for i in range(1, 16)]]
    after = [cell(start + 41, 0, F.lit("Summary"), none), *[cell(start + 42, i, none, F.lit(45_300.0 if i == 0 else 0.0)) for i in range(16)]]
    head = lanes.select("book", F.explode(F.array(cell(start - 1, 0, name, none), *sums, *after)).alias("x"))
    got = imports.axle_counts(head.union(body).select("book", "x.*"))
    return got.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "q029_piece_then_whole",
    """SELECT job_id, lane_id, track_id, frame FROM rows WHERE track_id NOT IN (SELECT track_id FROM pairs WHERE other < 1000000000 OR other NOT IN (SELECT track_id FROM pairs WHERE other < 1000000000))""",
    """rows AS (SELECT job_id, lane_id, track_id, cuadro AS frame, direction, bbox_x AS x1, bbox_y AS y1, bbox_x + bbox_width AS x2, bbox_y + bbox_height AS y2 FROM crossings)""",
    """nows AS (SELECT job_id, track_id, frame + 8 AS frame, CASE WHEN track_id % 100 = 0 THEN 1 ELSE 200 END AS dy FROM rows WHERE track_id < 1000000000)""",
    """near AS (SELECT a.*, b.track_id AS other, b.x1 + CASE WHEN n.dy IS NULL THEN 0 ELSE 2 END AS ox1, b.x2 + CASE WHEN n.dy IS NULL THEN 0 ELSE 2 END AS ox2, b.y1 + coalesce(n.dy, 0) AS oy1, b.y2 + coalesce(n.dy, 0) AS oy2
       FROM rows a JOIN rows b ON a.job_id = b.job_id AND a.lane_id = b.lane_id AND a.direction = b.direction AND a.track_id <> b.track_id AND (b.frame < a.frame OR b.frame = a.frame AND b.track_id < a.track_id) AND a.frame - b.frame <= 9
       LEFT JOIN nows n ON n.job_id = b.job_id AND n.track_id = b.track_id AND n.frame = a.frame WHERE a.track_id >= 1000000000)""",
    """pairs AS (SELECT track_id, other FROM near WHERE greatest(0, least(x2, ox2) - greatest(x1, ox1)) * greatest(0, least(y2, oy2) - greatest(y1, oy1)) >= 0.7 * least((x2 - x1) * (y2 - y1), (ox2 - ox1) * (oy2 - oy1)))""",
)
def _(fx):
    """Tracks that were made for doubles are young; of the others every one has a box eight frames on, half of them near."""
    box = {"x1": F.col("bbox_x"), "y1": F.col("bbox_y"), "x2": F.col("bbox_x") + F.col("bbox_width"), "y2": F.col("bbox_y") + F.col("bbox_height")}
    own = fx.crossings.select(F.col("job_id").cast("long"), F.col("lane_id").cast("long"), "track_id", F.col("cuadro").cast("long").alias("frame"), "direction", F.when(F.col("track_id") >= 1_000_000_000, 8).otherwise(30).alias("age"), *[c.cast("double").alias(n) for n, c in box.items()])
    dy = F.when(F.col("track_id") % 100 == 0, 1).otherwise(200)
    now = own.where("track_id < 1000000000").select("job_id", "track_id", (F.col("frame") + 8).alias("frame"), (F.col("x1") + 2).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + 2).alias("x2"), (F.col("y2") + dy).alias("y2"))
    return trajectories.piece_then_whole(own, now).select("job_id", "lane_id", "track_id", "frame")


@query(
    "q127_resampled_paths",
    """SELECT job_id, track_id, CAST(j AS INTEGER) AS place, gx AS x, round(y + way * CASE WHEN m = 10 THEN 175.0e0 ELSE 25.0e0 * (m - 1) END * j / 31, 6) AS y FROM (SELECT job_id, track_id, gx, gy AS y, CASE WHEN lead(gy) OVER w > gy THEN 1 ELSE -1 END AS way, row_number() OVER w AS k,
       CASE track_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 10 END AS m FROM ground WINDOW w AS (PARTITION BY job_id, track_id ORDER BY frame)), range(32) r(j) WHERE k = CASE WHEN m = 10 THEN 2 ELSE 1 END AND m > 1""",
    GROUND,
)
def _(fx):
    """Straight paths of one, two, four and ten points: a running median of five leaves those from the second to the ninth of ten, and paths under five as they are."""
    paths = ground(fx).groupBy("job_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "gx", "gy"))).alias("p"))
    m = F.create_map(*[F.lit(v) for v in (0, 1, 1, 2, 2, 4, 3, 10, 4, 10)])[(F.col("track_id") % 5).cast("int")]
    paths = paths.withColumn("p", F.slice("p", F.lit(1), m))
    out = trajectories.resampled_paths(paths.select("job_id", "track_id", F.col("p.gx").alias("xs"), F.col("p.gy").alias("ys")))
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


def pieces(fx, cut):
    """Points of tracks that are cut after their fifth point where ``cut`` holds, and the chains that put them together again."""
    first = F.min("frame").over(Window.partitionBy("job_id", "track_id"))
    rows = ground(fx).withColumn("chain", F.col("track_id")).withColumn("track_id", F.when(cut & (F.col("frame") - first >= 5), F.col("track_id") + F.lit(LATE)).otherwise(F.col("track_id")))
    return rows.drop("chain"), rows.select("job_id", "track_id", "chain").distinct()


WHOLE = """
whole AS (SELECT job_id, lane_id, track_id, piece, frame, direction, height FROM (SELECT h.job_id, h.crossed_lane AS lane_id, h.track_id, CASE WHEN h.place > 5 THEN h.track_id + 7000000000 ELSE h.track_id END AS piece, h.frame,
  CASE WHEN turn > 0 THEN 'in' ELSE 'out' END AS direction, b.height, row_number() OVER (PARTITION BY h.job_id, h.track_id, h.crossed_lane ORDER BY h.frame) AS k
  FROM hits h JOIN (SELECT job_id, track_id, max(y2 - y1) AS height FROM points GROUP BY ALL) b USING (job_id, track_id) WHERE turn <> 0 AND 100 >= 0.5 * b.height) WHERE k = 1)"""


def tilted_lines(fx):
    return fx.lanes.select("lane_id", "project_id", F.lit(0.0).alias("x1"), F.lit(955.5).alias("y1"), F.lit(3000.0).alias("x2"), (951.5 + F.col("lane_id")).alias("y2"))


def by_trajectory(fx):
    """All tracks are cut; pieces within two frames of each other are joined again."""
    points = sinks.kept_table(pieces(fx, F.lit(True))[0], "points")
    chains = fragments.chains_of_points(points.withColumn("access", F.lit(None).cast("int")), 20.0, trajectories.LINE_MOVED, gap=0.1)
    return trajectories.count_by_trajectory(points.drop("lane_id"), chains, tilted_lines(fx))


@query("q149_counts_by_trajectory", "SELECT * FROM whole", GROUND, STEPS, LINES, TILTED, WHOLE)
def _(fx):
    return by_trajectory(fx)


@query(
    "q161_compared_methods",
    """SELECT lane_id, direction, count(a) AS n_one, count(b) AS n_other, count(*) FILTER (b IS NULL) AS only_one, count(*) FILTER (a IS NULL) AS only_other FROM
       (SELECT DISTINCT job_id, crossed_lane AS lane_id, track_id, CASE WHEN turn > 0 THEN 'in' ELSE 'out' END AS direction, 1 AS a FROM hits WHERE turn <> 0 AND place >= 3 AND frame - pframe <= 3) x
       FULL JOIN (SELECT job_id, lane_id, track_id, direction, 1 AS b FROM whole) y USING (job_id, lane_id, track_id, direction) GROUP BY ALL""",
    GROUND, STEPS, LINES, TILTED, WHOLE,
)
def _(fx):
    instant = geometry.eligible_crossings(tilted(fx)).select("job_id", F.col("crossed_lane").alias("lane_id"), "track_id", "direction")
    return trajectories.compared_methods(instant, by_trajectory(fx))


MOVED = """
moved AS (SELECT job_id, track_id, CASE WHEN down THEN 1 WHEN lane_id <> 3 THEN 2 END AS origin, CASE WHEN NOT down THEN 1 WHEN lane_id <> 3 THEN 2 END AS destination, first_frame, last_frame, class_name, height, confidence,
  CASE WHEN track_id % 2 = 0 THEN 2 ELSE 1 END AS pieces, lane_id <> 3 AS complete FROM (SELECT job_id, track_id, lane_id, min(frame) AS first_frame, max(frame) AS last_frame, any_value(class_name) AS class_name, CAST(max(y2 - y1) AS INTEGER) AS height,
  round(max(confidence), 3) AS confidence, arg_max(y2, frame) > arg_min(y2, frame) AS down FROM points GROUP BY ALL) WHERE CASE WHEN track_id % 2 = 0 THEN 100 ELSE 225 END >= 2 * height)"""


def movements_of(fx):
    """Tracks of even number come in two pieces; the third line's tracks never reach the lower access."""
    points, _ = pieces(fx, F.col("track_id") % 2 == 0)
    access = F.when(F.col("y2") < 930, 1).when((F.col("y2") > 990) & (F.col("lane_id") != 3), 2)
    points = sinks.kept_table(points.withColumn("access", access.cast("long")), "points")
    return trajectories.segment_movements(points, fragments.chains_of_points(points, 20.0), 20.0)


@query(
    "q151_segment_movements",
    """SELECT *, 10 AS n_points, round(first_frame / 20.0e0, 2) AS t_first, round(last_frame / 20.0e0, 2) AS t_last, coalesce(destination IS NOT NULL, false) AS ends_in_dest FROM moved""",
    MOVED,
)
def _(fx):
    rows = movements_of(fx)
    return rows.select(*[c for c in rows.columns if c != "path"], F.size("path.t").alias("n_points"), F.get("path.t", F.lit(0)).alias("t_first"), F.element_at("path.t", -1).alias("t_last"), "path.ends_in_dest")


@query(
    "q140_retimed_paths",
    """SELECT m.job_id, m.track_id, CAST(k - 1 AS INTEGER) AS place, round(CASE WHEN p.frame < 36000 THEN p.frame / 18.0e0 ELSE 2000 + (p.frame - 36000) / 24.0e0 END, 2) AS t FROM moved m JOIN (SELECT job_id, track_id, frame, row_number() OVER (PARTITION BY job_id, track_id ORDER BY frame) AS k FROM points) p USING (job_id, track_id)""",
    MOVED,
)
def _(fx):
    """The stored paths of whole movements, of a camera that gave 18 frames a second in the first half of its video and 24 in the second."""
    clock = F.array(*[F.struct(F.lit(f).cast("long").alias("frame"), F.lit(s).cast("double").alias("at")) for f, s in ((0, 0.0), (36_000, 2_000.0), (72_000, 3_500.0))])
    rows = movements_of(fx).select("job_id", "track_id", shapes.retimed(F.col("path"), F.lit(20.0), clock).alias("path"))
    return rows.select("job_id", "track_id", F.posexplode("path.t").alias("place", "t"))


@query(
    "q057_second_boxes",
    """SELECT DISTINCT job_id, id FROM (SELECT p.job_id, p.id, w.id AS other, count(*) AS n, median(sqrt((p.x - w.x) ** 2 + (p.y - (w.y + (w.ny - w.y) * (p.t - w.t) / CASE WHEN w.nt > w.t THEN w.nt - w.t ELSE 1 END)) ** 2) / greatest(w.h, 1)) AS gap
       FROM second p JOIN firsts w ON w.job_id = p.job_id AND w.lane_id = p.lane_id AND w.down = p.down AND p.t >= w.t AND (p.t < w.nt OR (w.nt = w.t AND p.t = w.t)) GROUP BY ALL) WHERE n >= 5 AND gap <= 1""",
    GROUND,
    """placed AS (SELECT *, row_number() OVER w AS k, round(frame / 20.0e0, 2) AS t, last_value(gy) OVER (PARTITION BY job_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) > first_value(gy) OVER w AS down FROM ground WINDOW w AS (PARTITION BY job_id, track_id ORDER BY frame))""",
    """firsts AS (SELECT job_id, lane_id, down, track_id AS id, t, gx AS x, gy AS y, y2 - y1 AS h, coalesce(lead(t) OVER w, t) AS nt, coalesce(lead(gy) OVER w, gy) AS ny FROM placed WINDOW w AS (PARTITION BY job_id, track_id ORDER BY frame))""",
    f"""second AS (SELECT job_id, lane_id, down, track_id + {LATE} AS id, round((frame + 0.4e0) / 20, 2) AS t, gx + track_id % 7 * 15.0e0 AS x, gy AS y FROM placed WHERE k <= CASE WHEN track_id % 3 = 0 THEN 4 ELSE 8 END)""",
)
def _(fx):
    """A piece beside every whole path, up to 90 pixels off and two fifths of a frame late; every third has four points only."""
    order = F.array_sort(F.collect_list(F.struct("frame", F.col("gx").alias("x"), F.col("gy").alias("y"), (F.col("y2") - F.col("y1")).alias("h"))))
    own = ground(fx).groupBy("job_id", "lane_id", F.col("track_id").alias("id")).agg(order.alias("p"), (F.max_by("gy", "frame") > F.min_by("gy", "frame")).cast("int").alias("destino_id"))
    own = own.withColumnRenamed("lane_id", "origen_id")
    whole = own.withColumn("path", shapes.packed(F.col("p"), F.lit(20.0), F.lit(True))).drop("p")
    moved = F.transform(F.slice("p", F.lit(1), F.when(F.col("id") % 3 == 0, 4).otherwise(8)), lambda q: F.struct((q["frame"] + 0.4).alias("frame"), (q["x"] + F.col("id") % 7 * 15).alias("x"), q["y"].alias("y"), q["h"].alias("h")))
    piece = own.withColumn("path", shapes.packed(moved, F.lit(20.0), F.lit(False))).withColumn("id", F.col("id") + F.lit(LATE)).drop("p")
    return trajectories.second_boxes(piece, whole)


@query("q154_assigned_paths")
def _(fx):
    """The first six points of each track, held against the templates of whole ones."""
    whole = sinks.kept_table(whole_paths(fx), "paths")
    part = whole.select("project_id", "id", F.slice("xs", 1, 6).alias("xs"), F.slice("ys", 1, 6).alias("ys"), "height")
    return trajectories.assigned_paths(part, tracks.movement_templates(whole))


@query(
    "q156_row_fates",
    """SELECT id, CASE WHEN project_id = 1 THEN id % 4 < 2 ELSE origen_id IS NOT NULL AND destino_id IS NOT NULL END AS counts, CASE WHEN project_id = 1 AND id % 4 < 2 THEN 1 ELSE origen_id END AS origen_id,
       CASE WHEN project_id = 1 AND id % 4 < 2 THEN coalesce(destino_id, 3) ELSE destino_id END AS destino_id,
       CASE WHEN project_id <> 1 THEN CASE WHEN origen_id IS NOT NULL AND destino_id IS NOT NULL THEN 'por zonas' ELSE 'incompleto' END WHEN id % 4 = 0 THEN 'por trayectoria' WHEN id % 4 = 1 THEN 'por zonas' WHEN id % 4 = 2 THEN 'ambiguo' ELSE 'pedazo de otro vehículo' END AS how FROM movements""",
)
def _(fx):
    rows = fx.movements.select("id", "project_id", "origen_id", "destino_id", (F.col("project_id") == 1).alias("traced"))
    vehicles = rows.where("traced AND id % 4 < 2").select("id", F.lit(1).alias("v_origin"), F.coalesce("destino_id", F.lit(3)).alias("v_destination"), (F.col("id") % 4 == 0).alias("by_path"))
    return trajectories.row_fates(rows, vehicles, rows.where("traced AND id % 4 = 2").select("id", F.lit("ambiguo").alias("why")))
