"""Peak hours and peak-hour factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IRREGULAR = 0.85


def peak_hour(counts: DataFrame, keys: list[str], minutes: int = 15, volume: str = "total", latest: bool = False, valid: Column | None = None, contiguous: bool = False) -> DataFrame:
    """For each group the run of 60 // minutes consecutive rows with the greatest volume.

    keys + (peak_start, volume, peak_interval_volume, peak_interval_start, phf, irregular). The first run
    wins ties, or the last with ``latest``. Runs with an invalid row don't count; with ``contiguous``
    neither do runs with a gap in time. Groups shorter than an hour have no row.
    """
    n = 60 // minutes
    if n < 2:
        raise ValueError("an hour needs two intervals at least")
    order = Window.partitionBy(*keys).orderBy("bucket")
    run = order.rowsBetween(0, n - 1)
    best = F.max(volume).over(run)
    rows = counts.withColumn("ok", valid if valid is not None else F.lit(True))
    rows = rows.select(
        *keys, "bucket",
        F.sum(volume).over(run).alias("run_volume"),
        F.count("*").over(run).alias("run_rows"),
        F.min(F.col("ok").cast("int")).over(run).alias("run_ok"),
        F.max("bucket").over(run).alias("run_end"),
        best.alias("q_max"),
        F.collect_list(F.struct(F.col(volume).alias("v"), F.col("bucket").alias("b"))).over(run).alias("members"),
    )
    rows = rows.where((F.col("run_rows") == n) & (F.col("run_ok") == 1))
    if contiguous:
        rows = rows.where(F.col("run_end") - F.col("bucket") == (n - 1) * minutes * 60)
    when = F.desc("bucket") if latest else F.asc("bucket")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("run_volume"), when))).where("place = 1")
    phf = F.when(F.col("q_max") > 0, F.col("run_volume") / (n * F.col("q_max")))
    first = F.filter("members", lambda m: m["v"] == F.col("q_max"))[0]["b"]
    return rows.select(
        *keys, F.col("bucket").alias("peak_start"), F.col("run_volume").alias("volume"), F.col("q_max").alias("peak_interval_volume"),
        first.alias("peak_interval_start"), F.round(phf, 3).alias("phf"), F.coalesce(phf < IRREGULAR, F.lit(False)).alias("irregular"),
    )
