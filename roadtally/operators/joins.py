"""Joins of facts with their parents, audits of broken references, and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import exact_seconds


def named_crossings(crossings: DataFrame, lanes: DataFrame, zones: DataFrame, cordon: DataFrame | None = None) -> DataFrame:
    """Each crossing with its approach: the roadway's name, else the line's; in a cordon the line and which way."""
    rows = crossings.join(lanes.select("lane_id", F.col("name").alias("lane_name")), "lane_id")
    rows = rows.join(zones.select("zone_id", F.col("name").alias("zone_name")), "zone_id", "left")
    name = F.coalesce("zone_name", "lane_name")
    if cordon is not None:
        rows = rows.join(cordon, "project_id", "left")
        way = F.when(F.col("direction") == "in", " (entra)").otherwise(" (sale)")
        name = F.when(F.coalesce("is_cordon", F.lit(False)), F.concat("lane_name", way)).otherwise(name)
    return rows.withColumn("approach", name)


def latest_by_key(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def previous_segment(segments: DataFrame, reach: float = 1.0) -> DataFrame:
    """(id, previous_id): the latest other segment that starts no later and ends within a second of this one's start; of equal starts the greatest id.

    Segments that start together are each other's previous ones. Starts and ends keep their fractions; null ones have no previous."""
    by_start = Window.partitionBy("project_id").orderBy("start_ts")
    by_id = Window.partitionBy("project_id", "start_ts").orderBy("id")
    whole = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("id", "end_ts")
    # of its own start the greatest other id; else the greatest id of the last start before
    rows = segments.where("start_ts IS NOT NULL").withColumn("top", F.last(row).over(whole)).withColumn("near", F.lag(row).over(by_id))
    earlier = rows.groupBy("project_id", "start_ts").agg(F.first("top").alias("top")).withColumn("earlier", F.lag("top").over(by_start)).select("project_id", "start_ts", "earlier")
    rows = rows.join(earlier, ["project_id", "start_ts"])
    before = F.when(F.col("top.id") != F.col("id"), F.col("top")).otherwise(F.coalesce("near", "earlier"))
    rows = rows.withColumn("before", before).where("before IS NOT NULL")
    gap = exact_seconds(F.col("start_ts")) - exact_seconds(F.col("before.end_ts"))
    return rows.where(F.abs(gap) <= reach).select("id", F.col("before.id").alias("previous_id"))


def orphan_audit(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, n): for each (name, child, foreign key, parent, key) the children whose parent is missing."""
    parts = []
    for name, child, fk, parent, key in checks:
        lost = child.where(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n"))
    return reduce(DataFrame.unionAll, parts)


def cross_site(crossings: DataFrame, lanes: DataFrame, zones: DataFrame, segments: DataFrame) -> DataFrame:
    """(check, n): lines tied to another site's zone, crossings whose zone or video is of another site."""
    zone_site = zones.select("zone_id", F.col("project_id").alias("other"))
    video_site = segments.select(F.col("id").alias("job_id"), F.col("project_id").alias("other"))
    differ = lambda rows, name: rows.where("other <> project_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    tied = differ(lanes.join(zone_site, "zone_id"), "line_zone")
    return tied.unionAll(differ(crossings.join(zone_site, "zone_id"), "crossing_zone")).unionAll(differ(crossings.join(video_site, "job_id"), "crossing_video"))


def files_against_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(state, n, bytes): rows (path) whose file is missing; files (path, size) that no row claims."""
    missing = rows.join(files, "path", "left_anti").agg(F.lit("missing").alias("state"), F.count("*").alias("n"), F.lit(0).cast("long").alias("bytes"))
    unclaimed = files.join(rows, "path", "left_anti").agg(F.lit("unclaimed").alias("state"), F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return missing.unionAll(unclaimed)


def covered_segments(segments: DataFrame, crossings: DataFrame) -> DataFrame:
    """Segments that are done or have a crossing."""
    seen = crossings.select(F.col("job_id").alias("id")).distinct()
    done = segments.where("status = 'done'")
    return done.unionByName(segments.where("status <> 'done'").join(seen, "id", "left_semi"))


def quarters_against_hand(ours: DataFrame, hand: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (n_hand, n_ours, state): matched on common quarters, the others listed by the side that has them."""
    both = hand.withColumnRenamed("n", "n_hand").join(ours.withColumnRenamed("n", "n_ours"), keys, "full")
    state = F.when(F.col("n_ours").isNull(), "hand_only").when(F.col("n_hand").isNull(), "ours_only").otherwise("both")
    return both.withColumn("state", state)


def days_with_counts(crossings: DataFrame, movements: DataFrame) -> DataFrame:
    days = lambda df: df.select("project_id", F.to_date("ts").alias("day"))
    return days(crossings).union(days(movements)).distinct()


def common_and_missing(hand: DataFrame, ours: DataFrame) -> DataFrame:
    """(state, n): quarters in both and quarters only counted by hand."""
    both = hand.intersect(ours).agg(F.lit("both").alias("state"), F.count("*").alias("n"))
    return both.unionAll(hand.exceptAll(ours).agg(F.lit("hand_only").alias("state"), F.count("*").alias("n")))
