"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composition(rows: DataFrame, keys: list[str], klass: str = "klass", unresolved: str = "SIN_RESOLVER") -> DataFrame:
    """Counts by class; shares over the classified only, the unresolved with its own share of all."""
    n = rows.groupBy(*keys, klass).agg(F.count("*").alias("n"))
    site = Window.partitionBy(*keys)
    known = F.col(klass) != unresolved
    of_known = F.round(100.0 * F.col("n") / F.sum(F.when(known, F.col("n"))).over(site), 6)
    of_all = F.round(100.0 * F.col("n") / F.sum("n").over(site), 6)
    return n.select(*keys, klass, "n", F.when(known, of_known).alias("pct_of_classified"), F.when(~known, of_all).alias("pct_unresolved"))


def hour_weekday(hourly: DataFrame) -> DataFrame:
    """Sums by direction, hour and weekday (Monday 0) with their totals.

    hourly: project_id, direction, weekday, hh, n, measurable. Cells of hours that can't be measured are
    null; days never seen have no cell. Totals carry null for the key they sum over.
    """
    cell = F.when(F.col("measurable"), F.col("n"))
    sums = hourly.groupBy("project_id", "direction", "weekday", "hh").agg(F.sum(cell).alias("n"))
    return sums.cube("direction", "weekday", "hh", "project_id").agg(F.sum("n").alias("n")).where("project_id IS NOT NULL AND direction IS NOT NULL")


def daily_figures(hourly: DataFrame) -> DataFrame:
    """(project_id, days, total, daily_average, max_hour): averages over the days with a measurable hour."""
    rows = hourly.where("measurable").groupBy("project_id", "dd", "hh").agg(F.sum("n").alias("n"))
    out = rows.groupBy("project_id").agg(F.count_distinct("dd").alias("days"), F.sum("n").alias("total"), F.max("n").alias("max_hour"))
    return out.withColumn("daily_average", F.round(F.col("total") / F.col("days"), 6))


def quarter_by_date(counts: DataFrame, wide_days: list[int]) -> DataFrame:
    """Quarters down, the given days across: the count where covered or seen, null where not, with hour totals.

    counts: project_id, dd, minute, total, coverage. A row with minute null sums its hour."""
    shown = F.when((F.coalesce("coverage", F.lit(1.0)) > 0) | (F.col("total") > 0), F.col("total"))
    rows = counts.withColumn("hour", F.floor(F.col("minute") / 60).cast("int"))
    sets = [F.sum(F.when(F.col("dd") == d, shown)).alias(f"d{d:02d}") for d in wide_days]
    return rows.groupingSets([["project_id", "hour", "minute"], ["project_id", "hour"]], "project_id", "hour", "minute").agg(*sets)


def class_by_quarter(rows: DataFrame) -> DataFrame:
    """rows: project_id, minute, klass. Counts by quarter, by hour and by day (level) with each class's share of the level's whole."""
    each = rows.groupBy("project_id", "minute", "klass").agg(F.count("*").alias("n")).withColumn("hour", F.floor(F.col("minute") / 60).cast("int"))
    sets = each.groupingSets([["project_id", "hour", "minute", "klass"], ["project_id", "hour", "klass"], ["project_id", "klass"]], "project_id", "hour", "minute", "klass").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("project_id", "hour", "minute"))
    return sets.withColumn("share", F.round(F.col("n") / whole, 6))


def subtypes_of_a(rows: DataFrame) -> DataFrame:
    """rows: project_id, hh, subtype of class A. Counts by hour and over all hours (hh null), with shares; they sum to A."""
    sets = rows.where("subtype IS NOT NULL").rollup("project_id", "hh", "subtype").agg(F.count("*").alias("n")).where("subtype IS NOT NULL")
    totals = rows.where("subtype IS NOT NULL").groupBy("project_id", "subtype").agg(F.count("*").alias("n")).withColumn("hh", F.lit(None).cast("int"))
    both = sets.where("hh IS NOT NULL").select("project_id", "hh", "subtype", "n").unionByName(totals.select("project_id", "hh", "subtype", "n"))
    return both.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("project_id", "hh")), 6))


def compare_sites(summary: DataFrame, measure: str) -> DataFrame:
    """summary with a bar: the measure relative to the largest site."""
    return summary.withColumn("bar", F.round(F.col(measure) / F.max(measure).over(Window.partitionBy()), 6))


def label_text(value: Column) -> Column:
    """A name that is safe in a file name."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[^\w .-]", "_"), r"\s+", " "))
