"""Imports, exports that are written and read back, and corrected clocks: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import imports, validate
from roadtally.plans.counts import STAMP
from roadtally.plans.fixtures import Fixtures, oracle
from roadtally.sources import segments, sinks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


def sheets(fx):
    """The hand counts as sheets: a book for each site and day, with two blocks side by side, seven columns apart; class B stands first."""
    base = fx.manual.withColumns({"book": F.concat_ws("-", "project_id", "dd"), "c": (F.col("lane_id") % 2) * 7 + 1, "r": F.col("minuto") / 15 + 4})
    label = F.concat(C.minute_label(F.col("minuto")), F.lit(" - "), C.minute_label((F.col("minuto") + 15) % 1440))
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), v.cast("string").alias("value"))
    body = base.select("book", F.explode(F.array(cell(F.col("r"), F.col("c"), label), cell(F.col("r"), F.col("c") + 1, F.floor(F.col("n") / 5)), cell(F.col("r"), F.col("c") + 2, F.col("n") - F.floor(F.col("n") / 5)))).alias("x"))
    direction = F.when(F.col("c") == 1, "NTE - SUR").otherwise("sur-nte")
    head = base.select("book", "c").distinct().select("book", F.explode(F.array(cell(F.lit(2), F.col("c"), F.lit("Hr/Mov")), cell(F.lit(1), F.col("c") + 2, direction), cell(F.lit(3), F.col("c") + 1, F.lit("b")), cell(F.lit(3), F.col("c") + 2, F.lit("A")))).alias("x"))
    return head.union(body).select("book", F.lit("hoja").alias("sheet"), "x.row", "x.col", "x.value")


@query(
    "q004_hand_count_sheets",
    """SELECT concat_ws('-', project_id, dd) AS book, CASE WHEN lane_id % 2 = 0 THEN 'nte-sur' ELSE 'sur-nte' END AS direction, minuto AS minute, klass,
         CAST(CASE klass WHEN 'B' THEN n // 5 WHEN 'A' THEN n - n // 5 ELSE 0 END AS DOUBLE) AS n FROM manual, (VALUES ('A'), ('B'), ('C'), ('T-S'), ('T-S-R')) k(klass)""",
)
def _(fx):
    return imports.hand_counts(sheets(fx))


@query(
    "q010_movement_table",
    """SELECT project_id, strftime(date, '%Y-%m-%d') AS date, label(m) || ' - ' || label((m + 15) % 1440) AS "interval", movement, "A", "B", "C", "A" + "B" + "C" AS total FROM (
       SELECT project_id, CAST(ts AS DATE) AS date, hour(ts) * 60 + minute(ts) // 15 * 15 AS m, origen_id || '_' || destino_id AS movement, count(*) FILTER (vehicle_type IN ('car', 'motorcycle')) AS "A",
         count(*) FILTER (vehicle_type = 'bus') AS "B", count(*) FILTER (vehicle_type = 'truck') AS "C" FROM movements WHERE origen_id IS NOT NULL AND destino_id IS NOT NULL GROUP BY ALL)""".replace(
        "label(m)", "(CASE WHEN m // 60 % 12 = 0 THEN 12 ELSE m // 60 % 12 END || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || CASE WHEN m >= 720 THEN ' PM' ELSE ' AM' END)"
    ).replace(
        "label((m + 15) % 1440)",
        "(CASE WHEN (m + 15) % 1440 // 60 % 12 = 0 THEN 12 ELSE (m + 15) % 1440 // 60 % 12 END || ':' || lpad(CAST((m + 15) % 60 AS VARCHAR), 2, '0') || CASE WHEN (m + 15) % 1440 >= 720 THEN ' PM' ELSE ' AM' END)",
    ),
)
def _(fx):
    klass = F.when(F.col("vehicle_type") == "bus", "B").when(F.col("vehicle_type") == "truck", "C").otherwise("A")
    rows = fx.movements.select("project_id", "ts", F.col("origen_id").alias("origin"), F.col("destino_id").alias("destination"), klass.alias("klass"))
    return sinks.movement_table(rows, ["A", "B", "C"]).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("q013_day_folders", "SELECT project_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM crossings GROUP BY ALL")
def _(fx):
    place = sinks.shared_place(fx.spark, "days")
    sinks.write_days(fx.crossings, place)
    back = fx.spark.read.parquet(place)
    return back.groupBy("project_id", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("q014_segments_counted_again", "SELECT job_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM crossings WHERE hidx % 5 <> 0 OR id % 2 = 0 OR job_id NOT IN (SELECT job_id FROM crossings WHERE hidx % 5 = 0 AND id % 2 = 0) GROUP BY ALL")
def _(fx):
    """All segments are written; every fifth is then counted again, if it has a row of even id, and finds only those."""
    place = sinks.shared_place(fx.spark, "segments")
    segments.replace_segments(fx.crossings, place)
    segments.replace_segments(fx.crossings.where("hidx % 5 = 0 AND id % 2 = 0"), place)
    return segments.read_segments(fx.spark, place).groupBy("job_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(
    "q047_warm_start",
    """SELECT p.job_id + 1 AS job_id, p.track_id, CAST(p.frame - s.total_frames AS INTEGER) AS frame, p.y2 FROM points p JOIN segments s ON s.id = p.job_id JOIN segments n ON n.id = p.job_id + 1 AND n.project_id = s.project_id
       WHERE s.total_frames = 72000 AND p.frame >= 71940 AND p.frame < 72000""",
)
def _(fx):
    own = fx.segments.select(F.col("id").alias("job_id"), "project_id", "fps", "total_frames")
    back = own.where("total_frames = 72000").select((F.col("job_id") + 1).alias("job_id"), "project_id", F.col("job_id").alias("previous_id"))
    links = own.select("job_id", "project_id").join(back, ["job_id", "project_id"]).select("job_id", "previous_id")
    points = fx.points.select("job_id", "track_id", "frame", "y2")
    return imports.warm_started(points, own, links).where("frame < 0")


@query(
    "q080_reviewed_counts",
    """SELECT project_id, reviewer, CAST(sum(c) AS BIGINT) AS crossings, CAST(sum(m) AS BIGINT) AS movements, count(*) AS total FROM (
       SELECT project_id, CASE WHEN id % 3 = 0 THEN 'revision_manual' ELSE 'modelo' END AS reviewer, 1 AS c, 0 AS m FROM crossings WHERE clase_revisada IS NOT NULL
       UNION ALL SELECT project_id, 'revision_manual', 0, 1 FROM movements WHERE id % 34 = 0) GROUP BY ALL""",
)
def _(fx):
    who = F.when(F.col("clase_revisada").isNotNull(), F.when(F.col("id") % 3 == 0, "revision_manual").otherwise("modelo"))
    return imports.reviewed_counts(fx.crossings.withColumn("reviewer", who), fx.movements.withColumn("reviewer", F.when(F.col("id") % 34 == 0, "revision_manual")))


@query(
    "q140_retimed_rows",
    f"""SELECT c.id, {STAMP.format("CASE WHEN c.hidx % 13 = 0 THEN j.start_ts + to_seconds(CAST(floor((CASE WHEN c.id % 9 = 0 THEN floor((epoch(date_trunc('second', c.ts)) - epoch(j.start_ts) + 0.5) * 20) ELSE c.cuadro END) / 22.0e0) AS BIGINT)) ELSE c.ts END")} AS ts
        FROM crossings c JOIN jobs j ON j.id = c.job_id""",
)
def _(fx):
    """Every thirteenth hour's files hold 22 frames a second; in the others the rate is 1 % off, which is let stand."""
    own = fx.segments.select(F.col("id").alias("job_id"), "fps", "start_ts", "total_frames", "hidx")
    clocks = own.select("job_id", F.col("total_frames").alias("n_frames"), (F.col("total_frames") / F.when(F.col("hidx") % 13 == 0, 22.0).otherwise(20.2)).alias("seconds"))
    rows = fx.crossings.select("id", "job_id", "ts", F.when(F.col("id") % 9 != 0, F.col("cuadro")).alias("frame"))
    return imports.retimed(rows, own, clocks).select("id", C.stamp(F.col("ts")).alias("ts"))


# two roadways and two directions a site: after the best pair one is left
@query(
    "q058_paired_directions",
    """SELECT project_id, zone, direction, r FROM (SELECT s.*, b.zone AS z, b.direction AS d FROM scores s JOIN best b USING (project_id)) WHERE (zone = z) = (direction = d)""",
    """hand AS (SELECT project_id, CASE lane_id % 2 WHEN 1 THEN 'nte-sur' ELSE 'sur-nte' END AS direction, dd * 1440 + minuto AS bin, n FROM manual)""",
    """ours AS (SELECT project_id, lane_id AS zone, day(ts) * 1440 + hh * 60 + minute(ts) // 15 * 15 AS bin, count(*) AS n FROM crossings GROUP BY ALL)""",
    """bins AS (SELECT DISTINCT project_id, bin FROM hand)""",
    """grid AS (SELECT b.project_id, b.bin, z.zone, d.direction, coalesce(o.n, 0) AS o, coalesce(h.n, 0) AS h FROM bins b JOIN (SELECT DISTINCT project_id, zone FROM ours) z USING (project_id)
       JOIN (SELECT DISTINCT project_id, direction FROM hand) d USING (project_id) LEFT JOIN ours o ON (o.project_id, o.zone, o.bin) = (b.project_id, z.zone, b.bin)
       LEFT JOIN hand h ON (h.project_id, h.direction, h.bin) = (b.project_id, d.direction, b.bin))""",
    """scores AS (SELECT project_id, zone, direction, round(corr(o, h), 9) AS r FROM grid GROUP BY ALL)""",
    """best AS (SELECT project_id, zone, direction FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY r DESC, zone, direction) AS place FROM scores) WHERE place = 1)""",
)
def _(fx):
    direction = F.when(F.col("lane_id") % 2 == 1, "nte-sur").otherwise("sur-nte")
    hand = fx.manual.select("project_id", direction.alias("direction"), (F.col("dd") * 1440 + F.col("minuto")).alias("bin"), "n")
    quarter = F.day("ts") * 1440 + F.col("hh") * 60 + F.floor(F.minute("ts") / 15) * 15
    ours = fx.crossings.groupBy("project_id", F.col("lane_id").alias("zone"), quarter.alias("bin")).agg(F.count("*").alias("n"))
    return validate.paired_directions(ours, hand)
