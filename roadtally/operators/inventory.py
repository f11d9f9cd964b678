"""Inventories, survey types, checklists and warnings of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import index_pick


def site_inventory(projects: DataFrame, segments: DataFrame, lanes: DataFrame, crossings: DataFrame, movements: DataFrame, zones: DataFrame) -> DataFrame:
    """Counts of everything a site has; each fact is summed on its own before the joins."""
    parts = [
        segments.groupBy("project_id").agg(F.count("*").alias("videos"), F.count_if(F.col("status").isin("queued", "awaiting_calibration")).alias("waiting")),
        lanes.groupBy("project_id").agg(F.count("*").alias("lines")),
        crossings.groupBy("project_id").agg(F.count("*").alias("crossings"), F.count("clase_revisada").alias("reviewed"), F.count_if(F.col("tiempo_tramo_s").isNull()).alias("pending_speed")),
        movements.groupBy("project_id").agg(F.count("*").alias("movements")),
        zones.where("kind = 'acceso'").groupBy("project_id").agg(F.count("*").alias("accesses")),
    ]
    out = projects.select("project_id")
    for part in parts:
        out = out.join(part, "project_id", "left")
    return out.na.fill(0)


def survey_type(inventory: DataFrame) -> DataFrame:
    """mixto, direccional, lineal or sin_calibrar by what is drawn."""
    # Names of the delivered reports.
    kind = (
        F.when((F.col("lines") > 0) & (F.col("accesses") > 0), "mixto")
        .when(F.col("accesses") > 0, "direccional")
        .when(F.col("lines") > 0, "lineal")
        .otherwise("sin_calibrar")
    )
    return inventory.select("project_id", kind.alias("survey"))


def height_percentiles(crossings: DataFrame, keys: list[str]) -> DataFrame:
    """Heights at places min(n - 1, int(n p)) of the sorted sample for p = .1, .5, .9.

    Heights are small whole numbers, so each group is a histogram, and a place is found by its running count."""
    sizes = crossings.where("bbox_height > 0").groupBy(*keys, "bbox_height").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("c").over(group.orderBy("bbox_height"))
    rows = sizes.withColumn("upto", upto).withColumn("n", F.sum("c").over(group))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    pick = lambda p: F.min(F.when(F.col("upto") > place(p), F.col("bbox_height")))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), pick(0.1).alias("p10"), pick(0.5).alias("p50"), pick(0.9).alias("p90"))


def sorted_pick(crossings: DataFrame, keys: list[str], column: str, p: float) -> DataFrame:
    """The same pick on any column, for groups known to be small."""
    return crossings.groupBy(*keys).agg(index_pick(F.array_sort(F.collect_list(column)), p).alias("picked"))


def storage_rate(segments: DataFrame, last: int = 100) -> DataFrame:
    """GB an hour over the last segments by id: size_bytes, fps and total_frames of done rows."""
    rows = segments.where("status = 'done' AND fps > 0 AND total_frames > 0")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("id")))).where(F.col("place") <= last)
    hours = F.sum(F.col("total_frames") / F.col("fps")) / 3600
    return rows.groupBy("project_id").agg(F.round(F.sum("size_bytes") / 1e9 / hours, 6).alias("gb_per_hour"), F.count("*").alias("segments"))


def material_sheet(segments: DataFrame) -> DataFrame:
    """Mean frame rate and bit rate, and warnings on them."""
    length = F.col("total_frames") / F.col("fps")
    out = segments.where("fps > 0 AND total_frames > 0").groupBy("project_id").agg(
        F.count("*").alias("segments"), F.avg("fps").alias("mean_fps"), (F.sum(F.col("size_bytes") * 8) / F.sum(length) / 1e6).alias("mbit_s"), F.sum(length).alias("seconds")
    )
    low_rate, low_bits = F.col("mean_fps") < 15, F.col("mbit_s") < 1.0
    return out.withColumn("warning", F.when(low_rate & low_bits, "fps,bitrate").when(low_rate, "fps").when(low_bits, "bitrate").otherwise(""))


def checklist(segments: DataFrame) -> DataFrame:
    """(project_id, item, n): what stands in the way of a delivery, rows with something only."""
    one = lambda c, name: F.count_if(c).alias(name)
    sums = segments.groupBy("project_id").agg(
        one(F.col("status") == "error", "error"), one(F.col("status") == "queued", "queued"), one((F.col("status") == "done") & F.col("start_ts").isNull(), "no_hour"),
        one(F.col("status") == "awaiting_calibration", "waiting"), one(F.col("warning") != "", "warnings"), F.when(F.count_if(F.col("status") == "done") == 0, 1).otherwise(0).cast("long").alias("nothing_done"),
    )
    return sums.unpivot("project_id", ["error", "queued", "no_hour", "waiting", "warnings", "nothing_done"], "item", "n").where("n > 0")


def last_geometry_change(lanes: DataFrame, zones: DataFrame) -> DataFrame:
    """(project_id, changed): the latest change of a line or a zone."""
    both = lanes.select("project_id", "updated_at").unionAll(zones.select("project_id", "updated_at"))
    return both.groupBy("project_id").agg(F.max("updated_at").alias("changed"))


def stale_segments(segments: DataFrame, change: DataFrame) -> DataFrame:
    """Done segments that were finished before the last change."""
    return segments.where("status = 'done'").join(change, "project_id").where("finished_at < changed")


def segment_warnings(measured: DataFrame) -> DataFrame:
    """(id, warning): measured has per segment dropped and seen detections, crossings, declared and read seconds."""
    parts = F.array_compact(F.array(
        F.when(F.col("dropped") > 0.4 * (F.col("dropped") + F.col("seen")), "zones_drop"),
        F.when((F.col("seen") > 0) & (F.col("crossings") == 0), "no_crossing"),
        F.when(F.col("read_s") < 0.95 * F.col("declared_s"), "short_read"),
    ))
    return measured.select("id", F.array_join(parts, ",").alias("warning")).where("warning <> ''")
