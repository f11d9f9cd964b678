"""Runs of consecutive video files, by prefix sums and jumps from cut to cut: no task holds the files of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.sources.sinks import kept_table

DAY = 86_400


def running(rows: DataFrame, key: list[str], chunk: str, order: list[str], **values: Column) -> DataFrame:
    """rows with the sum of each value over the rows before in (chunk, order): inside a chunk by a window, and over a row for each chunk of a key."""
    own = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, chunk).agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    before = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, chunk, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values])
    out = rows.join(sums, [*key, chunk]).withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(v).over(own), F.lit(0)) for n, v in values.items()})
    return out.drop(*[f"__{n}" for n in values])


def minute_runs(files: DataFrame, drift: float = 1.5, most: int = 60, minute: float = 60.0) -> DataFrame:
    """(project_id, id, run): files that follow each other, numbered from 0 in each site.

    files: project_id, id, s (its start in seconds) and duration (null: the file can't be read; without the column each lasts a minute). A run
    ends before a file that starts more than ``drift`` seconds from where the run's start and the durations so far put it, before a file
    when the durations so far make ``most`` minutes, and at a file that can't be read, which is in no run. Files of a null start are left out.

    With P the durations before a file and D = s - P, file j ends the run of i if |D(j) - D(i)| > drift or P(j) >= P(i) + most minutes.
    So the end of a run that would start at i is known without its start's past: the first such j, found among the files of P's next ``most``
    minutes. Runs really start at the first file of each readable stretch and wherever a jump from a start leads; jumps double each round."""
    limit = float(most * minute)
    own = files if "duration" in files.columns else files.withColumn("duration", F.lit(minute))
    rows = own.where("s IS NOT NULL").select("project_id", "id", F.col("s").cast("double").alias("s"), F.col("duration").cast("double").alias("duration")).withColumn("day", F.floor(F.col("s") / DAY))
    lost = F.col("duration").isNull().cast("int")
    rows = running(rows, ["project_id"], "day", ["s", "id"], at=F.lit(1), p=F.coalesce("duration", F.lit(0.0)), block=lost)
    # sums of decimals in another order must not move a file over a bound
    rows = rows.where("duration IS NOT NULL").withColumn("p", F.round("p", 6)).withColumn("d", F.round(F.col("s") - F.col("p"), 6)).withColumn("hour", F.floor(F.col("p") / limit))
    rows = kept_table(rows.select("project_id", "block", "at", "id", "s", "day", "p", "d", "hour"), "files")
    key = ["project_id", "block"]
    later = rows.select(*key, "hour", F.col("at").alias("j"), F.col("p").alias("jp"), F.col("d").alias("jd"))
    near = rows.withColumn("hour", F.explode(F.array(F.col("hour"), F.col("hour") + 1))).join(later, [*key, "hour"]).where("j > at")
    full = F.col("jp") >= F.col("p") + limit
    ends = near.where(full | (F.abs(F.col("jd") - F.col("d")) > drift)).groupBy("project_id", "at").agg(F.min("j").alias("soon"))
    # a file can last longer than a run: then the next file of all lies in a later hour
    asked = rows.select(*key, (F.col("hour") + 2).alias("hour")).distinct().withColumn("first", F.lit(None).cast("long"))
    firsts = rows.groupBy(*key, "hour").agg(F.min("at").cast("long").alias("first"))
    onward = Window.partitionBy(*key).orderBy("hour").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # a row for each hour
    firsts = asked.unionByName(firsts).groupBy(*key, "hour").agg(F.max("first").alias("first")).withColumn("later", F.first("first", ignorenulls=True).over(onward)).select(*key, (F.col("hour") - 2).alias("hour"), "later")
    nxt = rows.join(firsts, [*key, "hour"]).join(ends, ["project_id", "at"], "left").select("project_id", "at", F.least("soon", "later").alias("next")).where("next IS NOT NULL")
    jump = kept_table(nxt, "jumps")
    starts = kept_table(rows.groupBy(*key).agg(F.min("at").alias("at")).select("project_id", "at"), "starts")
    while True:
        reached = starts.join(jump, ["project_id", "at"]).select("project_id", F.col("next").alias("at"))
        new = kept_table(starts.union(reached).distinct(), "starts")
        if new.count() == starts.count():
            break
        starts = new
        on = jump.select("project_id", F.col("at").alias("next"), F.col("next").alias("over"))
        jump = kept_table(jump.join(on, ["project_id", "next"]).select("project_id", "at", F.col("over").alias("next")), "jumps")
    flagged = rows.join(starts.withColumn("starts", F.lit(1)), ["project_id", "at"], "left").na.fill(0, ["starts"])
    numbered = running(flagged, ["project_id"], "day", ["at"], run=F.col("starts"))
    return numbered.select("project_id", "id", (F.col("run") + F.col("starts") - 1).cast("int").alias("run"))
