"""Origin-destination tables of movements with both ends seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import access_number, seconds


def quarter(ts, minutes: int = 15):
    s = seconds(ts)
    return s - s % 3600 + F.floor(s % 3600 / (minutes * 60)) * minutes * 60


def od_counts(movements: DataFrame, minutes: int = 15, klass: str = "vehicle_type") -> DataFrame:
    """(project_id, bucket, origin, destination, class, n); movements with an unseen end have state incomplete."""
    whole = F.col("origen_id").isNotNull() & F.col("destino_id").isNotNull()
    return movements.groupBy("project_id", quarter(F.col("ts"), minutes).alias("bucket"), "origen_id", "destino_id", F.col(klass).alias("klass"), F.when(whole, "complete").otherwise("incomplete").alias("state")).agg(F.count("*").alias("n"))


def od_matrix(movements: DataFrame, accesses: DataFrame) -> DataFrame:
    """(project_id, origin, destination, n): every pair of accesses, zeros kept; null stands for all."""
    sites = movements.select("project_id").distinct()
    # the grid is sites x accesses^2, a few rows a site
    own = accesses.select(F.col("access_id").alias("origen_id"))
    grid = sites.join(F.broadcast(own), how="cross").join(F.broadcast(accesses.select(F.col("access_id").alias("destino_id"))), how="cross")
    n = movements.where("origen_id IS NOT NULL AND destino_id IS NOT NULL").groupBy("project_id", "origen_id", "destino_id").agg(F.count("*").alias("n"))
    full = grid.join(n, ["project_id", "origen_id", "destino_id"], "left").na.fill(0, ["n"])
    return full.cube("origen_id", "destino_id", "project_id").agg(F.sum("n").alias("n")).where("project_id IS NOT NULL")


def class_mix(movements: DataFrame, classes: list[str]) -> DataFrame:
    """A row for each movement with traffic: total and one column a class."""
    rows = movements.where("origen_id IS NOT NULL AND destino_id IS NOT NULL")
    return rows.groupBy("project_id", "origen_id", "destino_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("vehicle_type") == c).alias(c) for c in classes])


def access_volumes(movements: DataFrame, minutes: int = 15, grazed: DataFrame | None = None) -> DataFrame:
    """(project_id, access_id, bucket, entries, exits): by what was seen, incomplete movements too."""
    bucket = quarter(F.col("ts"), minutes).alias("bucket")
    ends = movements.select("id", "project_id", bucket, F.expr("stack(2, origen_id, 'in', destino_id, 'out') AS (access_id, side)")).where("access_id IS NOT NULL")
    if grazed is not None:
        ends = ends.join(grazed.select("id", F.lit("out").alias("side"), "access_id"), ["id", "side", "access_id"], "left_anti")
    return ends.groupBy("project_id", "access_id", "bucket").agg(F.count_if(F.col("side") == "in").alias("entries"), F.count_if(F.col("side") == "out").alias("exits"))


def by_access_number(movements: DataFrame, accesses: DataFrame, minutes: int = 15) -> DataFrame:
    """(project_id, movement, bucket, n): movement is origin_destination by the accesses' numbers; equal numbers merge."""
    numbers = accesses.select("access_id", access_number(F.col("access_name")).alias("number"))
    rows = movements.where("origen_id IS NOT NULL AND destino_id IS NOT NULL")
    rows = rows.join(numbers.withColumnsRenamed({"access_id": "origen_id", "number": "o"}), "origen_id").join(numbers.withColumnsRenamed({"access_id": "destino_id", "number": "d"}), "destino_id")
    return rows.groupBy("project_id", F.concat_ws("_", "o", "d").alias("movement"), quarter(F.col("ts"), minutes).alias("bucket")).agg(F.count("*").alias("n"))


def company_table(numbered: DataFrame, least_u_turn: float = 0.02) -> DataFrame:
    """numbered: project_id, o, d, minute, klass (A, B, C). Quarter counts by movement; U-turns only from 2 % of all."""
    each = numbered.groupBy("project_id", "o", "d", "minute").agg(*[F.count_if(F.col("klass") == c).alias(c) for c in "ABC"], F.count("*").alias("total"))
    site = F.sum("total").over(Window.partitionBy("project_id"))
    own = F.sum("total").over(Window.partitionBy("project_id", "o", "d"))
    kept = each.withColumn("part", own / site).where((F.col("o") != F.col("d")) | (F.col("part") >= least_u_turn))
    return kept.select("project_id", F.concat_ws("_", "o", "d").alias("movement"), "minute", "A", "B", "C", "total")


def movement_from_line(line_counts: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """A movement that a line counts: the line's count less the other movements of that arm, at least 0."""
    rows = line_counts.join(others.groupBy(*keys).agg(F.sum("n").alias("known")), keys, "left")
    return rows.select(*keys, F.greatest(F.lit(0), F.col("n") - F.coalesce("known", F.lit(0))).cast("long").alias("n"))


def tracking_quality(movements: DataFrame, cordon: DataFrame | None = None) -> DataFrame:
    """(project_id, total, complete, fraction, colour)."""
    whole = F.col("origen_id").isNotNull() & F.col("destino_id").isNotNull()
    out = movements.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(whole).alias("complete"))
    out = out.withColumn("fraction", F.round(F.col("complete") / F.col("total"), 6))
    # Limits of the colours.
    colour = F.when(F.col("fraction") >= 0.60, "verde").when(F.col("fraction") >= 0.45, "ambar").otherwise("rojo")
    if cordon is not None:
        out = out.join(cordon, "project_id", "left")
        colour = F.when(F.coalesce("is_cordon", F.lit(False)), "gris").otherwise(colour)
        out = out.withColumn("colour", colour).drop("is_cordon")
        return out
    return out.withColumn("colour", colour)


def worst_videos(movements: DataFrame, least: int = 20, top: int = 5) -> DataFrame:
    """The videos of each site with the lowest complete fraction, of those with enough movements."""
    whole = F.col("origen_id").isNotNull() & F.col("destino_id").isNotNull()
    rows = movements.groupBy("project_id", "job_id").agg(F.count("*").alias("n"), F.avg(whole.cast("double")).alias("fraction")).where(F.col("n") >= least)
    order = Window.partitionBy("project_id").orderBy("fraction", "job_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def lost_by_access(movements: DataFrame) -> DataFrame:
    """(project_id, access_id, entries, exits, lost): lost is what entered there and was not seen to leave."""
    ends = movements.select("project_id", F.expr("stack(2, origen_id, 'in', destino_id, 'out') AS (access_id, side)"), F.col("destino_id").isNull().alias("unseen")).where("access_id IS NOT NULL")
    return ends.groupBy("project_id", "access_id").agg(F.count_if(F.col("side") == "in").alias("entries"), F.count_if(F.col("side") == "out").alias("exits"), F.count_if((F.col("side") == "in") & F.col("unseen")).alias("lost"))
