"""Spot speeds from the time between two lines, their summaries and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a believable speed, of a representative hour and of a car's height in metres.
LEAST_KMH, MOST_KMH = 3.0, 160.0
REPRESENTATIVE = 0.70
CAR_LOW_M, CAR_HIGH_M, CARS_FOR_CHECK, MOST_TILT = 1.1, 2.1, 20, 30.0


def kmh(distance_m: Column, seconds: Column) -> Column:
    """Speed over a stretch; null where it can't be true."""
    v = F.when((seconds > 0) & (distance_m > 0), distance_m / seconds * 3.6)
    return F.when((v >= LEAST_KMH) & (v <= MOST_KMH), v)


def speed_summary(rows: DataFrame, keys: list[str], speed: str = "kmh") -> DataFrame:
    """n, mean and the 15th, 50th and 85th percentile with linear interpolation."""
    p = F.percentile(speed, F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85)))
    return rows.groupBy(*keys).agg(F.count(speed).alias("n"), F.avg(speed).alias("mean"), p.alias("p")).select(*keys, "n", "mean", F.col("p")[0].alias("p15"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p85"))


def representative_hours(rows: DataFrame, keys: list[str], speed: str = "kmh") -> DataFrame:
    """keys + (crossed, measured, publish): an hour is published if 70 % of its vehicles were measured."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("crossed"), F.count(speed).alias("measured"))
    return sums.withColumn("publish", F.col("measured") / F.col("crossed") >= REPRESENTATIVE)


def distance_check(cars: DataFrame, stretches: DataFrame) -> DataFrame:
    """(lane_id, state, car_m): the height of cars in metres that the captured distance implies.

    stretches: lane_id, ax, ay, bx, by (the counting line), mx, my (middle of the second line), distance_m.
    """
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = F.hypot(ux, uy)
    run = F.when(along > 0, F.abs(ux * (F.col("my") - F.col("ay")) - uy * (F.col("mx") - F.col("ax"))) / along)
    tilt = 90 - F.degrees(F.atan2(F.abs(uy), F.abs(ux)))
    heights = cars.where("bbox_height > 0").groupBy("lane_id").agg(F.count("*").alias("cars"), F.percentile("bbox_height", 0.5).alias("h"))
    rows = stretches.join(heights, "lane_id", "left")
    metres = F.col("h") * F.col("distance_m") / run
    usable = (along > 0) & (run > 0) & (tilt <= MOST_TILT)
    state = F.when(~F.coalesce(usable, F.lit(False)), "no_aplica").when(F.coalesce("cars", F.lit(0)) < CARS_FOR_CHECK, "sin_datos").when(metres.between(CAR_LOW_M, CAR_HIGH_M), "coherente").otherwise("revisar")
    return rows.select("lane_id", state.alias("state"), F.when(state.isin("coherente", "revisar"), F.round(metres, 2)).alias("car_m"))


def histogram(rows: DataFrame, keys: list[str], width: float = 10.0, low: float = 20.0, high: float = 120.0, speed: str = "kmh") -> DataFrame:
    """keys + (bin, n): below low in bin 0, then width by width, above high in the last."""
    last = int((high - low) / width) + 1
    place = F.when(F.col(speed) < low, 0).when(F.col(speed) >= high, last).otherwise(F.floor((F.col(speed) - low) / width) + 1)
    return rows.where(F.col(speed).isNotNull()).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentile_of_bins(bins: DataFrame, keys: list[str], q: float, width: float = 10.0, low: float = 20.0) -> DataFrame:
    """keys + (value): the q-quantile interpolated inside its bin; bin 0 reaches from 0 to low."""
    order = Window.partitionBy(*keys).orderBy("bin")
    rows = bins.withColumn("upto", F.sum("n").over(order)).withColumn("whole", F.sum("n").over(Window.partitionBy(*keys)))
    goal = F.col("whole") * q
    hit = rows.where((F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal))
    start = F.when(F.col("bin") == 0, 0.0).otherwise(low + (F.col("bin") - 1) * width)
    size = F.when(F.col("bin") == 0, low).otherwise(F.lit(width))
    return hit.select(*keys, (start + size * (goal - (F.col("upto") - F.col("n"))) / F.col("n")).alias("value"))


def mean_of_bins(bins: DataFrame, keys: list[str], first: float = 28.0, width: float = 10.0, low: float = 20.0) -> DataFrame:
    """keys + (mean): from the bins' middles; the first bin counts as ``first``."""
    middle = F.when(F.col("bin") == 0, F.lit(first)).otherwise(low + (F.col("bin") - 0.5) * width)
    return bins.groupBy(*keys).agg((F.sum(middle * F.col("n")) / F.sum("n")).alias("mean"))


def speed_study(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: crossed, share measured, summaries of all, light and heavy, and whether the sample is small.

    rows: kmh and heavy (boolean)."""
    heavy, light = F.when(F.col("heavy"), F.col("kmh")), F.when(~F.col("heavy"), F.col("kmh"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("crossed"), F.count("kmh").alias("n"), F.avg("kmh").alias("mean"), F.stddev_pop("kmh").alias("sd"), F.percentile("kmh", 0.85).alias("p85"),
        F.count(light).alias("n_light"), F.avg(light).alias("mean_light"), F.count(heavy).alias("n_heavy"), F.avg(heavy).alias("mean_heavy"),
    )
    return out.withColumn("measured", F.col("n") / F.col("crossed")).withColumn("small", F.col("n") < 50)


def calibrate_distance(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(lane_id, distance_m): median reference speed over median of 1 / t, hours of the calibration half only.

    rows: lane_id, t. reference: lane_id, ref_kmh."""
    own = rows.where("t > 0").groupBy("lane_id").agg(F.percentile(1 / F.col("t"), 0.5).alias("rate"))
    ref = reference.groupBy("lane_id").agg(F.percentile("ref_kmh", 0.5).alias("ref"))
    return own.join(ref, "lane_id").select("lane_id", (F.col("ref") / 3.6 / F.col("rate")).alias("distance_m"))
