"""Export tables and idempotent writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtally.functions import columns as C


def interval_table(counts: DataFrame, by_class: DataFrame, classes: list[str]) -> DataFrame:
    """A row for each line and interval, one column a class, coverage last.

    counts: lane_id, bucket, n_in, n_out, total, coverage. by_class: lane_id, bucket, klass, n."""
    wide = by_class.groupBy("lane_id", "bucket").agg(*[F.coalesce(F.sum(F.when(F.col("klass") == c, F.col("n"))), F.lit(0)).alias(c) for c in classes])
    return counts.join(wide, ["lane_id", "bucket"], "left").na.fill(0, classes).select("lane_id", "bucket", "n_in", "n_out", "total", *classes, "coverage")


def summary_table(totals: DataFrame, peaks: DataFrame, by_class: DataFrame, classes: list[str]) -> DataFrame:
    """A row for each line: totals, peak hour, factor (null when none) and class columns."""
    wide = by_class.groupBy("lane_id").agg(*[F.coalesce(F.sum(F.when(F.col("klass") == c, F.col("n"))), F.lit(0)).alias(c) for c in classes])
    return totals.join(peaks, "lane_id", "left").join(wide, "lane_id", "left").na.fill(0, classes)


def audit_table(crossings: DataFrame, movements: DataFrame) -> DataFrame:
    """Crossings and movements as one list: kind, id, time, class, who reviewed."""
    one = crossings.select(F.lit("cruce").alias("kind"), "id", "project_id", "ts", F.col("vehicle_type").alias("klass"), F.col("clase_revisada").alias("reviewed"))
    two = movements.select(F.lit("movimiento").alias("kind"), "id", "project_id", "ts", F.col("vehicle_type").alias("klass"))
    return one.unionByName(two, allowMissingColumns=True)


def write_days(df: DataFrame, path: str) -> None:
    """One folder for each site and day."""
    df.withColumn("date", F.to_date("ts")).write.partitionBy("project_id", "date").mode("overwrite").parquet(path)


def movement_table(movements: DataFrame, classes: list[str]) -> DataFrame:
    """(project_id, date, interval, movement, one column a class, total): quarters of complete movements.

    movements: project_id, ts, origin, destination, klass; a movement is named origin_destination."""
    minute = F.hour("ts") * 60 + F.floor(F.minute("ts") / 15).cast("int") * 15
    rows = movements.where("origin IS NOT NULL AND destination IS NOT NULL").select(
        "project_id", F.to_date("ts").alias("date"), F.concat(C.minute_label(minute), F.lit(" - "), C.minute_label((minute + 15) % 1440)).alias("interval"), F.concat_ws("_", "origin", "destination").alias("movement"), "klass"
    )
    counts = rows.groupBy("project_id", "date", "interval", "movement").agg(*[F.count_if(F.col("klass") == c).alias(c) for c in classes])
    total = F.lit(0).cast("long")
    for c in classes:
        total = total + F.col(c)
    return counts.withColumn("total", total)


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared one; on one machine, where none is set, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="roadtally-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back, so later jobs neither repeat it nor need the executors that made it."""
    place = shared_place(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def dealt(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """df dealt by keys over as many partitions as it has ``rows`` rows, and no fewer than the session's, so that a task sorts no more when the table grows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
