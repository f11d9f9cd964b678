"""Comparisons with reference counts, searches over assignments, day summaries and relabelling candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heavy_candidates(crossings: DataFrame, times: float = 1.58, least: int = 30) -> DataFrame:
    """Buses and trucks at least ``times`` the median car of their line, on lines with enough cars."""
    cars = crossings.where("vehicle_type = 'car' AND bbox_height > 0").groupBy("lane_id").agg(F.count("*").alias("cars"), F.percentile("bbox_height", 0.5).alias("middle")).where(F.col("cars") >= least)
    return crossings.where("vehicle_type IN ('bus', 'truck')").join(cars, "lane_id").where(F.col("bbox_height") >= times * F.col("middle"))


def against_axle_counter(ours: DataFrame, theirs: DataFrame, groups: DataFrame, coverage: DataFrame, least: float = 0.995) -> DataFrame:
    """(lane_id, dd, minute, grp, n_ours, n_theirs): both counts by class group, in quarters that the video covers.

    ours and theirs: lane_id, dd, minute, klass, n. groups: klass, grp. coverage: lane_id, dd, minute, coverage."""
    whole = coverage.where(F.col("coverage") >= least).select("lane_id", "dd", "minute")
    side = lambda df, name: df.join(groups, "klass").join(whole, ["lane_id", "dd", "minute"], "left_semi").groupBy("lane_id", "dd", "minute", "grp").agg(F.sum("n").alias(name))
    return side(ours, "n_ours").join(side(theirs, "n_theirs"), ["lane_id", "dd", "minute", "grp"], "full").na.fill(0)


#: Ways that one row of the search stands for before they are made in its task.
WAYS = 65_536


def best_numbering(ours: DataFrame, hand: DataFrame, numbers: list[int], accesses: list[int]) -> DataFrame:
    """(project_id, assignment, error): of all ways to number the accesses the one with the least absolute error; the first in product order on ties.

    ours: project_id, o, d (accesses), n. hand: project_id, ho, hd (numbers), n_hand. A way is a whole number whose digits, to the base of the
    numbers, number the accesses in order. A site's counts are one row with an array of at most accesses^2 cells; blocks of ways are dealt to
    tasks, made there and reduced to the least error before anything is shuffled. A hand count of a number that is not in ``numbers`` is
    an error of every way; accesses that are not in ``accesses`` are left out; repeated pairs add up; null counts are 0."""
    base, places = len(numbers), len(accesses)
    at = lambda values, c: (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1).cast("int")
    cells = ours.withColumns({"i": at(accesses, "o"), "j": at(accesses, "d")}).where("i >= 0 AND j >= 0").groupBy("project_id", "i", "j").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    cells = cells.groupBy("project_id").agg(F.collect_list(F.struct("i", "j", "n")).alias("cells"))
    theirs = hand.groupBy("project_id", at(numbers, "ho").alias("i"), at(numbers, "hd").alias("j")).agg(F.coalesce(F.sum("n_hand"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.abs("n_hand")), F.lit(0)).alias("size"))
    known = F.when((F.col("i") >= 0) & (F.col("j") >= 0), F.struct((F.col("i") * base + F.col("j")).alias("t"), "n"))
    size = F.when((F.col("i") >= 0) & (F.col("j") >= 0), F.abs("n")).otherwise(F.col("size"))
    theirs = theirs.groupBy("project_id").agg(F.map_from_entries(F.collect_list(known)).alias("hand"), F.sum(size).alias("all"))
    sites = cells.join(theirs, "project_id", "full").withColumn("all", F.coalesce("all", F.lit(0)))
    total = base**places
    blocks = sites.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // WAYS)))).repartition("project_id", "block")
    first = F.col("block").cast("long") * WAYS
    ways = blocks.withColumn("way", F.explode(F.sequence(first, F.least(first + WAYS, F.lit(total)) - 1)))
    digit = lambda k: F.expr(f"CAST(floor(way / pow({base}, {places - 1} - {k})) AS BIGINT) % {base}")
    ways = ways.withColumn("digits", F.array(*[digit(k) for k in range(places)]))
    # the number pairs that a way gives the site's cells; all other hand counts are errors in full
    ways = ways.withColumn("got", F.expr(f"transform(cells, c -> struct(CAST(digits[c.i] * {base} + digits[c.j] AS INT) AS t, c.n AS n))"))
    change = """aggregate(array_distinct(transform(got, g -> g.t)), all, (e, t) -> e - abs(coalesce(hand[t], 0))
        + abs(coalesce(hand[t], 0) - aggregate(filter(got, g -> g.t = t), CAST(0 AS BIGINT), (s, g) -> s + g.n)))"""
    best = ways.withColumn("error", F.coalesce(F.expr(change), F.col("all"))).groupBy("project_id").agg(F.min(F.struct("error", "way", "digits")).alias("b"))
    names = F.array(*[F.lit(str(v)) for v in numbers])
    return best.select("project_id", F.array_join(F.transform("b.digits", lambda x: F.element_at(names, (x + 1).cast("int"))), ",").alias("assignment"), F.col("b.error").alias("error"))


def day_summary(entries: DataFrame, movements: DataFrame, peaks: DataFrame) -> DataFrame:
    """(project_id, dd, entries, peak_start, peak_volume, phf, decided): entries of a day, its peak by entries and the whole movements inside the peak.

    entries: project_id, dd, bucket, n. movements: project_id, at (seconds) of decided ones. peaks: project_id, dd, peak_start, volume, phf."""
    totals = entries.groupBy("project_id", "dd").agg(F.sum("n").alias("entries"))
    inside = movements.join(peaks, "project_id").where("at >= peak_start AND at < peak_start + 3600").groupBy("project_id", "dd").agg(F.count("*").alias("decided"))
    return totals.join(peaks, ["project_id", "dd"], "left").join(inside, ["project_id", "dd"], "left").na.fill(0, ["decided"])


def hourly_comparison(ours: DataFrame, hand: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (n_ours, n_hand, ratio, confidence): our hour against the hand count's."""
    both = ours.join(hand, keys)
    return both.withColumn("ratio", F.col("n_ours") / F.col("n_hand"))


def travelling_pieces(boxes: DataFrame, held: float = 0.8, times: float = 2.0, share: float = 0.6, least: int = 2, spread: float = 0.45) -> DataFrame:
    """(job_id, track_id, heavy_id): tracks that ride along inside a bus or truck.

    In each frame a box's best container holds most of it and has twice its area. A track is a piece if its
    commonest container has 60 % of its frames and its centre stays within .45 of the container's size (dx + dy)."""
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    own = boxes.select("job_id", "frame", "track_id", "x1", "y1", "x2", "y2")
    big = boxes.where("class_name IN ('bus', 'truck')").select("job_id", "frame", F.col("track_id").alias("heavy_id"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    inter = F.greatest(F.lit(0.0), F.least("x2", "o_x2") - F.greatest("x1", "o_x1")) * F.greatest(F.lit(0.0), F.least("y2", "o_y2") - F.greatest("y1", "o_y1"))
    both = own.join(big, ["job_id", "frame"]).where((F.col("track_id") != F.col("heavy_id")) & (area("o_") >= times * area("")) & (inter >= held * area("")))
    order = Window.partitionBy("job_id", "frame", "track_id").orderBy(F.desc("part"), "heavy_id")
    best = both.withColumn("part", inter / area("")).withColumn("k", F.row_number().over(order)).where("k = 1")
    rx = ((F.col("x1") + F.col("x2")) / 2 - F.col("o_x1")) / (F.col("o_x2") - F.col("o_x1"))
    ry = ((F.col("y1") + F.col("y2")) / 2 - F.col("o_y1")) / (F.col("o_y2") - F.col("o_y1"))
    sums = best.groupBy("job_id", "track_id", "heavy_id").agg(F.count("*").alias("n"), (F.max(rx) - F.min(rx) + F.max(ry) - F.min(ry)).alias("moves"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "track_id").orderBy(F.desc("n"), "heavy_id"))).where("k = 1")
    length = own.groupBy("job_id", "track_id").agg(F.count("*").alias("frames"))
    rows = top.join(length, ["job_id", "track_id"])
    return rows.where((F.col("n") >= least) & (F.col("n") >= share * F.col("frames")) & (F.col("moves") <= spread)).select("job_id", "track_id", "heavy_id")
