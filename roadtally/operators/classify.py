"""Vehicle classes by image height.

Hours are measurable by the detector's confidence over the whole site; a line's scale is the median
height of its cars in an hour; heavy vehicles are those taller than a multiple of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.sources.sinks import kept_table

# Results are compared with hand counts made under these.
LEAST_CONFIDENCE = 0.65
DAY_SHARE = 0.87
HEAVY_FACTOR = 1.58
MEASURED_HEIGHT = 25.0
LEAST_HEIGHT = 12.0
FINE_HEIGHT = 100.0
MOTORCYCLE_RATIO = 0.7
CARS_FOR_SCALE = 30
CARS_FOR_REFERENCE = 5
LEAST_PROBABILITY = 0.5
DAYLIGHT = (7, 19)
UNRESOLVED = "SIN_RESOLVER"


def measurable_hours(crossings: DataFrame, hour: str = "hh") -> DataFrame:
    """(project_id, hour, mean_confidence, n, cutoff, measurable): an hour counts if its mean confidence
    reaches 0.87 of the median mean of the busier half of hours, at most 0.65."""
    means = crossings.where("confidence IS NOT NULL").groupBy("project_id", hour).agg(F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))
    site = Window.partitionBy("project_id")
    ranked = means.withColumn("place", F.row_number().over(site.orderBy(F.desc("n"), hour))).withColumn("hours", F.count("*").over(site))
    busy = F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("hours") / 2)), F.col("mean_confidence"))
    cutoff = F.least(F.lit(LEAST_CONFIDENCE), DAY_SHARE * F.median(busy).over(site))
    out = ranked.withColumn("cutoff", cutoff)
    return out.select("project_id", hour, "mean_confidence", "n", "cutoff", (F.col("mean_confidence") >= F.col("cutoff")).alias("measurable"))


def line_scales(crossings: DataFrame, hours: DataFrame, hour: str = "hh") -> DataFrame:
    """(lane_id, hour, level, threshold) of every line and hour with crossings."""
    usable = hours.where("measurable").select("project_id", hour, F.lit(True).alias("usable"))
    car = F.when((F.col("vehicle_type") == "car") & (F.col("bbox_height") > 0), F.col("bbox_height"))
    scales = crossings.groupBy("project_id", "lane_id", hour).agg(F.count(car).alias("cars"), F.percentile(car, 0.5).alias("middle"))
    scales = scales.join(usable, ["project_id", hour], "left")
    good = F.col("usable") & (F.col("cars") >= CARS_FOR_SCALE) & (F.col("middle") >= LEAST_HEIGHT)
    level = F.when(good & (F.col("middle") >= MEASURED_HEIGHT), "medido").when(good, "estimado").otherwise("no_resoluble")
    return scales.select("project_id", "lane_id", hour, level.alias("level"), F.when(good, HEAVY_FACTOR * F.col("middle")).alias("threshold"))


def line_profiles(crossings: DataFrame, hours: DataFrame, hour: str = "hh") -> DataFrame:
    """(lane_id, car_height, car_ratio, fine) over the measurable hours."""
    usable = hours.where("measurable").select("project_id", hour)
    cars = crossings.join(usable, ["project_id", hour], "left_semi").where("vehicle_type = 'car' AND bbox_height > 0")
    ratio = F.when(F.col("bbox_width") > 0, F.col("bbox_width") / F.col("bbox_height"))
    out = cars.groupBy("lane_id").agg(F.count("*").alias("cars"), F.percentile("bbox_height", 0.5).alias("h"), F.count(ratio).alias("ratios"), F.percentile(ratio, 0.5).alias("r"))
    enough = F.col("cars") >= CARS_FOR_SCALE
    height = F.when(enough, F.col("h"))
    return out.select("lane_id", height.alias("car_height"), F.when(enough & (F.col("ratios") >= 30), F.col("r")).alias("car_ratio"), F.coalesce(height >= FINE_HEIGHT, F.lit(False)).alias("fine"))


def reference_thresholds(crossings: DataFrame) -> DataFrame:
    """(lane_id, reference): the same factor with five cars or more, at any hour."""
    car = F.when((F.col("vehicle_type") == "car") & (F.col("bbox_height") > 0), F.col("bbox_height"))
    out = crossings.groupBy("lane_id").agg(F.count(car).alias("cars"), F.percentile(car, 0.5).alias("middle"))
    return out.select("lane_id", F.when(F.col("cars") >= CARS_FOR_REFERENCE, HEAVY_FACTOR * F.col("middle")).alias("reference"))


def best_hours(scales: DataFrame, hour: str = "hh") -> DataFrame:
    """(lane_id, hour, level, threshold): the line's best level, at the earliest hour that has it."""
    rank = F.when(F.col("level") == "medido", 2).when(F.col("level") == "estimado", 1).otherwise(0)
    order = Window.partitionBy("lane_id").orderBy(rank.desc(), F.col(hour))
    return scales.withColumn("place", F.row_number().over(order)).where("place = 1").select("lane_id", hour, "level", "threshold")


def rule_class(kind: Column, height: Column, threshold: Column, width: Column, fine: Column, ratio: Column) -> Column:
    """Class by the height rule; without a threshold nothing is resolved."""
    wide = (width > 0) & (height > 0) & (ratio > 0) & (width / height > MOTORCYCLE_RATIO * ratio)
    return (
        F.when(threshold.isNull(), UNRESOLVED)
        .when((kind == "motorcycle") & fine, F.when(wide, "A").otherwise("MOTO"))
        .when(kind.isin("car", "motorcycle", "bicycle"), "A")
        .when(height.isNull(), UNRESOLVED)
        .when(kind == "bus", F.when(fine, "B").otherwise("PESADO"))
        .when(height <= threshold, "A")
        .otherwise(F.when(fine, "C").otherwise("PESADO"))
    )


def final_class(rule: Column, reviewed: Column, model: Column, probability: Column, fine: Column) -> Column:
    """A reviewed class first; the model's where the rule says heavy, the line is fine and it is sure enough."""
    by_model = fine & rule.isin("B", "C", "PESADO") & model.isNotNull() & (probability >= LEAST_PROBABILITY)
    return F.coalesce(reviewed, F.when(by_model, model).otherwise(rule))


def subtype(model: Column, probability: Column, hour: Column, fine: Column) -> Column:
    sure = fine & model.isNotNull() & (probability >= LEAST_PROBABILITY) & (hour >= DAYLIGHT[0]) & (hour < DAYLIGHT[1])
    return F.when(sure, model).otherwise("SIN_SUBTIPO")


def provisional_class(kind: Column, height: Column, reference: Column) -> Column:
    """What the detector saw, for rows without a resolved class."""
    truck = F.when((reference > 0) & (height > 0), F.when(height <= reference, "A").otherwise("C")).otherwise("CAMIONETA_O_CAMION")
    return F.when(kind.isin("car", "bicycle"), "A").when(kind == "motorcycle", "MOTO").when(kind == "bus", "B").when(kind == "truck", truck).otherwise(UNRESOLVED)


def company_class(name: Column) -> Column:
    """A, B or C as the company's tables have them."""
    # Names of the delivered tables.
    return F.when(name.isin("MOTO", "SIN_RESOLVER"), "A").when(name.isin("T-S", "T-S-R", "TRACTOR", "PESADO"), "C").otherwise(name)


def classified(crossings: DataFrame, hour: str = "hh") -> DataFrame:
    """crossings with threshold, fine, rule, klass, subtype and provisional.

    The scale tables have a row for each line and hour. They are stored, so that Spark knows their sizes and joins them by broadcast when it
    finds them small enough; crossings are not dealt by line, of which there are few.
    """
    hours = kept_table(measurable_hours(crossings, hour), "hours")
    scales = kept_table(line_scales(crossings, hours, hour).select("lane_id", hour, "threshold"), "scales")
    profiles = kept_table(line_profiles(crossings, hours, hour).select("lane_id", "car_ratio", "fine"), "profiles")
    references = kept_table(reference_thresholds(crossings), "references")
    rows = crossings.join(scales, ["lane_id", hour], "left").join(profiles, "lane_id", "left").join(references, "lane_id", "left")
    rows = rows.withColumn("fine", F.coalesce("fine", F.lit(False)))
    c = F.col
    rows = rows.withColumn("rule", rule_class(c("vehicle_type"), c("bbox_height"), c("threshold"), c("bbox_width"), c("fine"), c("car_ratio")))
    rows = rows.withColumn("klass", final_class(c("rule"), c("clase_revisada"), c("clase_modelo"), c("prob_modelo"), c("fine")))
    rows = rows.withColumn("subtype", F.when(c("klass") == "A", subtype(c("subtipo_modelo"), c("prob_subtipo"), c(hour), c("fine"))))
    return rows.withColumn("provisional", F.when(c("klass") == UNRESOLVED, provisional_class(c("vehicle_type"), c("bbox_height"), c("reference"))))
