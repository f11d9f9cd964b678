"""Quality of framing, tracking and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import exact_seconds


def touching(buckets: DataFrame, segments: DataFrame, minutes: int) -> DataFrame:
    """The intervals that overlap any of the segments; both sides are cut at hours, so the join is on the hour."""
    a, b = exact_seconds(F.col("start_ts")), exact_seconds(F.col("end_ts"))
    cut = segments.select("project_id", a.alias("a"), b.alias("b")).withColumn("hour", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("b") / 3600))))
    own = buckets.withColumn("until", F.col("bucket") + minutes * 60)
    own = own.withColumn("hour", F.explode(F.sequence(F.floor(F.col("bucket") / 3600), F.floor((F.col("until") - 1) / 3600))))
    return own.join(cut, ["project_id", "hour"]).where("a < until AND b > bucket").select("project_id", "bucket").distinct()


def hot_cells(points: DataFrame, keys: list[str], x: str, y: str, cell: int = 80, top: int = 15) -> DataFrame:
    """The cells of a grid with most points; ties by row, then column."""
    cells = points.groupBy(*keys, F.floor(F.col(x) / cell).cast("long").alias("cx"), F.floor(F.col(y) / cell).cast("long").alias("cy")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "cy", "cx")
    return cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def density(points: DataFrame, keys: list[str], x: str, y: str, radius: int = 5) -> DataFrame:
    """Each point adds exp(-d / 3) to the pixels around it; scaled to 255 at the peak. Equal pixels are summed before they spread."""
    pixels = points.groupBy(*keys, F.floor(x).cast("long").alias("px"), F.floor(y).cast("long").alias("py")).agg(F.count("*").alias("n"))
    side = F.sequence(F.lit(-radius), F.lit(radius))
    spread = pixels.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
    weight = F.col("n") * F.exp(-F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")) / 3)
    sums = spread.groupBy(*keys, (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py")).agg(F.sum(weight).alias("heat"))
    return sums.withColumn("heat", 255 * F.col("heat") / F.max("heat").over(Window.partitionBy(*keys)))


def flow_conservation(hits: DataFrame) -> DataFrame:
    """hits: project_id, hh, track_id, line (1, 2, 3). Share of the tracks seen at any line that were seen at all three."""
    each = hits.groupBy("project_id", "hh", "track_id").agg(F.count_distinct("line").alias("lines"))
    return each.groupBy("project_id", "hh").agg(F.count("*").alias("any"), F.count_if(F.col("lines") == 3).alias("all_three")).withColumn("ratio", F.round(F.col("all_three") / F.col("any"), 6))


def band(value: Column, low: float, high: float) -> Column:
    """0 at or below low, 1 at or above high, straight between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def night_switch(minutes: DataFrame, limit: float = 15.0) -> DataFrame:
    """minutes: project_id, minute, saturation. The first minute from which saturation stays below the limit."""
    rest = Window.partitionBy("project_id").orderBy("minute").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return minutes.withColumn("peak", F.max("saturation").over(rest)).where(F.col("peak") < limit).groupBy("project_id").agg(F.min("minute").alias("switch"))


def headings(tracks: DataFrame) -> DataFrame:
    """tracks: lane_id, x0, y0, x1, y1. (lane_id, sector, n): eighths of the circle, most first; the line's angle is 90 degrees on."""
    degrees = F.pmod(F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))) + 22.5, F.lit(360.0))
    return tracks.groupBy("lane_id", F.floor(degrees / 45).cast("int").alias("sector")).agg(F.count("*").alias("n")).withColumn("line_angle", F.pmod(F.col("sector") * 45 + 90, F.lit(360)).cast("int"))
