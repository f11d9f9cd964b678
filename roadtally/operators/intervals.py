"""Interval counts on a zero-filled grid, and how much of each interval the video covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import from_seconds, seconds
from roadtally.sources.sinks import kept_table


def site_ranges(segments: DataFrame, crossings: DataFrame | None = None) -> DataFrame:
    """(project_id, lo, hi) in seconds: over all segments with a start, of any status; else over the crossings."""
    end = F.coalesce(F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")), F.lit(0.0))
    s = seconds(F.col("start_ts"))
    out = segments.where("start_ts IS NOT NULL").groupBy("project_id").agg(F.min(s).alias("lo"), F.max(s + end).alias("hi"))
    if crossings is None:
        return out
    seen = crossings.groupBy("project_id").agg(F.min(seconds(F.col("ts"))).alias("lo2"), (F.max(seconds(F.col("ts"))) + 1).alias("hi2"))
    both = out.join(seen, "project_id", "full")
    return both.select("project_id", F.coalesce("lo", "lo2").alias("lo"), F.coalesce("hi", "hi2").cast("double").alias("hi"))


def bucket_grid(ranges: DataFrame, minutes: int) -> DataFrame:
    """(project_id, origin, bucket): every interval's start in seconds; the first is floored within its hour."""
    step = minutes * 60
    origin = F.col("lo") - F.col("lo") % 3600 + F.floor(F.col("lo") % 3600 / step) * step
    rows = ranges.withColumn("origin", origin)
    last = F.greatest(F.col("origin"), F.col("origin") + (F.ceil((F.col("hi") - F.col("origin")) / step) - 1) * step)
    return rows.select("project_id", "origin", F.explode(F.sequence("origin", last, F.lit(step).cast("long"))).alias("bucket"))


def in_bucket(rows: DataFrame, ranges: DataFrame, minutes: int) -> DataFrame:
    """rows with their interval's start in seconds; rows outside the site's range go. The ranges are stored, so that Spark knows how few they are and rows are not dealt by site."""
    grid = ranges.withColumn("origin", F.col("lo") - F.col("lo") % 3600 + F.floor(F.col("lo") % 3600 / (minutes * 60)) * minutes * 60)
    joined = rows.join(kept_table(grid.select("project_id", "origin", "hi"), "ranges"), "project_id")
    place = F.floor((seconds(F.col("ts")) - F.col("origin")) / (minutes * 60))
    return joined.withColumn("bucket", F.col("origin") + place * minutes * 60).where((place >= 0) & (F.col("bucket") < F.greatest(F.col("hi"), F.col("origin") + 1))).drop("origin", "hi")


def interval_counts(lanes: DataFrame, segments: DataFrame, crossings: DataFrame, minutes: int = 15) -> DataFrame:
    """(project_id, lane_id, bucket, n_in, n_out, total): every line and every interval of its site's range, zeros kept."""
    ranges = site_ranges(segments, crossings)
    counts = in_bucket(crossings, ranges, minutes).groupBy("project_id", "lane_id", "bucket").agg(F.count_if(F.col("direction") == "in").alias("n_in"), F.count_if(F.col("direction") == "out").alias("n_out"))
    grid = bucket_grid(ranges, minutes).join(lanes.select("project_id", "lane_id"), "project_id")
    full = grid.join(counts, ["project_id", "lane_id", "bucket"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return full.select("project_id", "lane_id", "bucket", zero("n_in").alias("n_in"), zero("n_out").alias("n_out"), (zero("n_in") + zero("n_out")).alias("total"))


def merged_segments(segments: DataFrame, gap: float = 1.0) -> DataFrame:
    """(project_id, a, b) in seconds: done segments, joined where at most gap seconds lie between."""
    done = segments.where("status = 'done' AND start_ts IS NOT NULL AND fps > 0 AND total_frames > 0")
    s = seconds(F.col("start_ts")).cast("double")
    rows = done.select("project_id", s.alias("a"), (s + F.col("total_frames") / F.col("fps")).alias("b"))
    order = Window.partitionBy("project_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("a") - reach > gap), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("project_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def coverage(buckets: DataFrame, segments: DataFrame, minutes: int) -> DataFrame:
    """buckets (project_id, bucket) with the covered share of each, null where the site has no segment with a duration.

    Merged segments are cut at the hours they touch, so the overlap is an equi-join on the hour."""
    merged = merged_segments(segments)
    cut = lambda df, a, b: df.withColumn("hour", F.explode(F.sequence(F.floor(F.col(a) / 3600), F.floor((F.col(b) - 1e-9) / 3600))))
    pieces = cut(merged, "a", "b")
    own = buckets.select("project_id", "bucket").distinct().withColumn("until", F.col("bucket") + minutes * 60)
    both = cut(own, "bucket", "until").join(pieces, ["project_id", "hour"])
    # a pair that meets in several hours counts once, in the first of them
    first = F.floor(F.greatest("a", "bucket") / 3600) == F.col("hour")
    part = F.greatest(F.lit(0.0), F.least("b", F.col("until").cast("double")) - F.greatest("a", F.col("bucket").cast("double")))
    sums = both.where(first).groupBy("project_id", "bucket").agg(F.sum(part).alias("covered"))
    known = merged.select("project_id").distinct().withColumn("known", F.lit(True))
    out = buckets.join(sums, ["project_id", "bucket"], "left").join(known, "project_id", "left")
    share = F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / (minutes * 60))
    return out.withColumn("coverage", F.when(F.col("known"), share)).drop("covered", "known")


def cordon_sites(lanes: DataFrame, accesses: DataFrame) -> DataFrame:
    """(project_id, is_cordon): accesses exist, at least two lines, none tied to a roadway."""
    have = accesses.select("project_id").distinct().withColumn("has_access", F.lit(True))
    sums = lanes.groupBy("project_id").agg(F.count("*").alias("n"), F.count("zone_id").alias("tied"))
    return sums.join(have, "project_id", "left").select("project_id", (F.coalesce("has_access", F.lit(False)) & (F.col("n") >= 2) & (F.col("tied") == 0)).alias("is_cordon"))


def combined_flow(counts: DataFrame, cordon: DataFrame) -> DataFrame:
    """(project_id, bucket, n_in, n_out, total): over all lines; in a cordon the volume is what enters."""
    rows = counts.join(cordon, "project_id", "left")
    volume = F.when(F.coalesce("is_cordon", F.lit(False)), F.col("n_in")).otherwise(F.col("total"))
    return rows.groupBy("project_id", "bucket").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum(volume).alias("total"))


def fully_covered_quarters(segments: DataFrame, with_crossings: DataFrame) -> DataFrame:
    """(project_id, quarter): start in seconds of each quarter hour all of whose 15 minutes are in segments that
    are done or have a crossing; lengths are rounded to whole minutes."""
    used = with_crossings.select(F.col("job_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    rows = segments.join(used, "id", "left").where("status = 'done' OR hit")
    first = F.floor(seconds(F.col("start_ts")) / 60)
    n = F.round(F.col("total_frames") / F.col("fps") / 60).cast("long")
    minutes = rows.where(n > 0).select("project_id", F.explode(F.sequence(first, first + n - 1)).alias("minute")).distinct()
    quarter = F.floor(F.col("minute") / 15) * 900
    return minutes.groupBy("project_id", quarter.alias("quarter")).agg(F.count("*").alias("n")).where("n = 15").drop("n")
