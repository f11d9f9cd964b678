"""Doubtful crossings, their queue, and the corrections that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import index_pick  # noqa: F401
from roadtally.operators.geometry import iou
from roadtally.sources.sinks import dealt, kept_table

# Limits and order of the reasons.
DOUBLE_SECONDS, DOUBLE_IOU, BORDER, LOW_PROBABILITY, LOW_CONFIDENCE = 0.6, 0.3, 0.10, 0.6, 0.35
PRIORITY = {"doble": 0, "frontera": 1, "modelo": 2, "confianza": 3}


def possible_doubles(crossings: DataFrame, fps: float | None = None) -> DataFrame:
    """(id, partner, gap): the second of two consecutive crossings of one video, line and direction that may be one vehicle.

    Time is the frame over the rate where both are known, else the stamp."""
    rate = F.lit(fps).cast("double") if fps else F.col("fps")
    at = F.coalesce(F.col("cuadro") / rate, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    order = Window.partitionBy("job_id", "lane_id", "direction").orderBy("at", "id")
    names = ["id", "at", "bbox_x", "bbox_y", "bbox_width", "bbox_height"]
    box = F.struct(*names)
    rows = dealt(crossings.withColumn("at", at).select("job_id", "lane_id", "direction", *names), "job_id", "lane_id", "direction")
    rows = rows.withColumn("before", F.lag(box).over(order)).where("before IS NOT NULL")
    rows = rows.withColumn("gap", F.col("at") - F.col("before.at")).where(F.col("gap") <= DOUBLE_SECONDS)
    both = [F.col(c) for c in ("bbox_x", "bbox_y", "bbox_width", "bbox_height")], [F.col(f"before.{c}") for c in ("bbox_x", "bbox_y", "bbox_width", "bbox_height")]
    return rows.where(iou(*both[0], *both[1]) >= DOUBLE_IOU).select("id", F.col("before.id").alias("partner"), "gap")


def confidence_cutoffs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (cutoff): the lesser of 0.35 and the value at place int(.05 (n - 1)) of the sorted confidences."""
    ranked = rows.where("confidence IS NOT NULL").select(*keys, "confidence")
    group = Window.partitionBy(*keys)
    counts = ranked.groupBy(*keys, "confidence").agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(group.orderBy("confidence"))).withColumn("n", F.sum("c").over(group))
    place = F.floor(0.05 * (F.col("n") - 1))
    return counts.where(F.col("upto") > place).groupBy(*keys).agg(F.least(F.lit(LOW_CONFIDENCE), F.min("confidence")).alias("cutoff"))


def review_reasons(crossings: DataFrame, doubles: DataFrame) -> DataFrame:
    """(id, reason): crossings carry klass, threshold and their detector's and model's figures."""
    cut = confidence_cutoffs(crossings, ["lane_id"])
    rows = crossings.join(cut, "lane_id", "left").join(doubles.select("id", F.lit(True).alias("double")), "id", "left")
    h, t = F.col("bbox_height"), F.col("threshold")
    reasons = F.array_compact(F.array(
        F.when(F.col("double"), "doble"),
        F.when((t > 0) & (h > 0) & F.col("vehicle_type").isin("truck", "bus") & (F.abs(h - t) <= BORDER * t), "frontera"),
        F.when(F.col("clase_modelo").isNotNull() & (F.col("prob_modelo") < LOW_PROBABILITY) & ~F.col("klass").isin("A", "MOTO", "SIN_RESOLVER"), "modelo"),
        F.when((t > 0) & (F.col("confidence") <= F.col("cutoff")), "confianza"),
    ))
    return rows.select("id", "project_id", "ts", "clase_revisada", F.explode(reasons).alias("reason"))


def counted_ranges(rows: DataFrame, keys: list[str], ranges: list[str]) -> DataFrame:
    """keys, ranges and (before, held, total): the rows of a group before each of its ranges, in it, and in all. One row for each range is ordered, not the rows."""
    group = Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, *ranges).agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(group.orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumns({"before": before, "total": F.sum("held").over(group)})


def placed(rows: DataFrame, wanted: DataFrame, keys: list[str], ranges: list[str], order: list[str]) -> DataFrame:
    """The rows of the wanted ranges (of counted_ranges) with (place, total): place counts from 1 in the whole group. Null keys are a group of their own."""
    names = [*keys, *ranges]
    side = wanted.select(*[F.col(c).alias(f"__{c}") for c in names], "before", "total")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
    own = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return rows.join(side, same).withColumn("place", F.col("before") + own).drop("before", *[f"__{c}" for c in names])


def hour_of(time: str) -> Column:
    """The hour that a time lies in, counted from 1970: a range of times that one task can order, as a site's or line's hour is bounded."""
    return F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / 3600)


def review_queue(reasons: DataFrame, start: int = 0, limit: int = 40) -> DataFrame:
    """A page of each site's queue of unreviewed rows by priority and time, with the length of the queue.

    The queue is counted by priority and hour; only the hours that the page touches are ordered. Rows of a null time come first in their
    priority, those of a null site are a queue; a page beyond the end and an empty table give no rows."""
    rank = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    rows = reasons.where("clase_revisada IS NULL").withColumn("rank", rank[F.col("reason")])
    items = rows.groupBy("project_id", "id", "ts").agg(F.min("rank").alias("priority"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    items = items.withColumn("__hour", hour_of("ts"))
    counts = counted_ranges(items, ["project_id"], ["priority", "__hour"])
    page = counts.where((F.col("before") < start + limit) & (F.col("before") + F.col("held") > start))
    out = placed(items, page, ["project_id"], ["priority", "__hour"], ["ts", "id"])
    return out.where(F.col("place").between(start + 1, start + limit)).select("project_id", "id", "ts", "priority", "reasons", "place", "total")


def reason_totals(reasons: DataFrame) -> DataFrame:
    return reasons.where("clase_revisada IS NULL").groupBy("project_id", "reason").agg(F.count("*").alias("n"))


def even_sample(rows: DataFrame, keys: list[str], order: list[str], quota: int) -> DataFrame:
    """Every (n // quota)-th row of each group, at most quota, in an order that begins with a time.

    A group is counted by the hours of that time; only hours in which a wanted place falls are ordered, at most quota of them. Rows of a null
    time come first, null keys are a group; an empty table gives no rows."""
    rows = rows.withColumn("__hour", hour_of(order[0]))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / quota))
    counts = counted_ranges(rows, keys, ["__hour"]).withColumn("__next", F.ceil(F.col("before") / step) * step)
    wanted = counts.where((F.col("__next") < F.col("before") + F.col("held")) & (F.col("__next") / step < quota))
    at = F.col("place") - 1
    return placed(rows, wanted, keys, ["__hour"], order).where((at % step == 0) & (at / step < quota)).drop("place", "total", "__hour")


def apply_reviews(crossings: DataFrame, reviews: DataFrame) -> DataFrame:
    """crossings with the reviewed class put in where reviews (id, klass_new) has one."""
    rows = crossings.join(reviews, "id", "left")
    return rows.withColumn("clase_revisada", F.coalesce("klass_new", "clase_revisada")).drop("klass_new")


def review_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lane_id, klass, n_before, n_after) where a review changes a count: the dry run."""
    keys = ["lane_id", "klass"]
    a = before.groupBy(*keys).agg(F.count("*").alias("n_before"))
    b = after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    return a.join(b, keys, "full").na.fill(0).where("n_before <> n_after")


def discard(rows: DataFrame, doomed: DataFrame, kind: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows left, rows for the side table): whole rows as JSON, by which restore() brings them back.

    What is doomed is stored once, and so is the side table. Rows are dealt by id over partitions whose number grows with them."""
    ids = kept_table(doomed.select("id"), "doomed")
    own = dealt(rows, "id")
    left = own.join(ids, "id", "left_anti")
    gone = own.join(ids, "id", "left_semi")
    side = gone.select("project_id", F.lit(kind).alias("kind"), F.col("id").alias("original_id"), F.to_json(F.struct("*")).alias("data"), F.lit(reason).alias("reason"))
    return left, kept_table(side, "side")


def restore(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows with the side table's rows back under their ids; columns that rows no longer has are left out."""
    back = side.select(F.from_json("data", rows.schema).alias("r")).select("r.*")
    return rows.unionByName(back, allowMissingColumns=True)


def set_stretch_times(crossings: DataFrame, times: DataFrame) -> DataFrame:
    """crossings with tiempo_tramo_s from times (job_id, lane_id, track_id, t) where it has one."""
    rows = crossings.join(times, ["job_id", "lane_id", "track_id"], "left")
    return rows.withColumn("tiempo_tramo_s", F.coalesce("t", "tiempo_tramo_s")).drop("t")


def move_start(crossings: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, at): new seconds of crossings whose segment's start moved: new start + frame / rate, else old time + shift.

    moves: job_id, old_s, new_s, fps."""
    old = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    rows = crossings.join(moves, "job_id")
    return rows.select("id", F.floor(F.coalesce(F.col("new_s") + F.col("cuadro") / F.col("fps"), old + F.col("new_s") - F.col("old_s"))).cast("long").alias("at"))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed parents: name -> (table, its foreign key)."""
    gone = doomed.select(F.col(key).alias("__gone")).distinct()
    return {name: df.join(gone, F.col(fk) == F.col("__gone"), "left_anti") for name, (df, fk) in tables.items()}
