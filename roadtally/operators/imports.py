"""Sheets of hand counts, corrected clocks and warm starts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions import columns as C

# Classes of the hand-count sheets in their order, directions, and limits of the clock and of the warm start.
SHEET_CLASSES = ["A", "B", "C", "T-S", "T-S-R"]
DIRECTION = r"(?i)^\s*[\p{L}.]+\s*-\s*[\p{L}.]+\s*$"
RATE_TOLERANCE, WARM_SECONDS = 0.05, 3.0
# Columns of the axle counter's class table, its speed bands (km/h), day names, and the days that a cell may hold as a date.
AXLE_CLASSES = ["Cycle", "Cars", "2A-4T", "Buses", "2A-SU", "3A-SU", "4A-SU", "4A-ST", "5A-ST", "6A-ST", "5A-MT", "6A-MT", "Other"]
SPEED_BANDS = ["0.0", "32.2", "40.2", "48.2", "56.3", "64.3", "72.4", "80.4", "88.5", "96.5", "104.6", "112.6", "120.7", "128.7", "136.8", "Other"]
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
DATES, SUM_TOLERANCE = (40_000, 60_000), 0.5


def hand_counts(cells: DataFrame) -> DataFrame:
    """(book, direction, minute, klass, n) from cells (book, sheet, row, col, value).

    A block starts at a cell Hr/Mov in the first six rows. Its direction is the label at most one row off and five columns
    to the right, else the sheet's last label, else the sheet's name. The five classes stand below it, else have their
    usual order. A quarter with no number at all was not counted; a lone blank is 0. The first row of a repeated quarter
    wins. Null and empty cells are blanks; a book without a block gives no rows.
    """
    cells = cells.where("value IS NOT NULL AND trim(value) <> ''")
    text = F.trim("value")
    top = cells.where(F.col("row") <= 6)
    heads = top.where(F.lower(text).startswith("hr/mov")).select("book", "sheet", F.col("row").alias("hr"), F.col("col").alias("hc"))
    labels = top.where(text.rlike(DIRECTION) & ~F.lower(text).startswith("hr/mov")).select("book", "sheet", F.col("row").alias("lr"), F.col("col").alias("lc"), F.lower(F.regexp_replace(text, r"\s+", "")).alias("label"))
    beside = (F.abs(F.col("lr") - F.col("hr")) <= 1) & (F.col("lc") > F.col("hc")) & (F.col("lc") <= F.col("hc") + 5)
    place = F.struct("lr", "lc")
    blocks = heads.join(labels, ["book", "sheet"], "left").groupBy("book", "sheet", "hr", "hc").agg(F.min_by("label", F.when(beside, place)).alias("own"), F.max_by("label", place).alias("last"), F.count_if(beside).alias("near"))
    blocks = blocks.select("book", "sheet", "hr", "hc", F.coalesce(F.when(F.col("near") > 0, F.col("own")), "last", F.lower(F.trim("sheet"))).alias("direction"))
    below = cells.join(blocks, ["book", "sheet"]).where((F.col("row") > F.col("hr")) & F.col("col").between(F.col("hc"), F.col("hc") + 5)).withColumn("k", F.col("col") - F.col("hc"))
    names = below.where((F.col("row") == F.col("hr") + 1) & (F.col("k") > 0) & F.upper(text).isin(SHEET_CLASSES))
    names = names.select("book", "sheet", "hr", "hc", "k", F.upper(text).alias("klass"))
    rows = below.groupBy("book", "sheet", "direction", "hr", "hc", "row").agg(
        F.max(F.when(F.col("k") == 0, C.quarter_minute(F.col("value")))).alias("minute"), *[F.max(F.when(F.col("k") == i, F.try_to_number(F.when(text.rlike(r"^\d+(\.\d+)?$"), text), F.lit("999999999.99")))).cast("double").alias(f"v{i}") for i in range(1, 6)]
    )
    rows = rows.where("minute IS NOT NULL AND coalesce(v1, v2, v3, v4, v5) IS NOT NULL")
    first = Window.partitionBy("book", "direction", "minute").orderBy("sheet", "hr", "hc", "row")
    rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    usual = F.array(*[F.lit(c) for c in SHEET_CLASSES])
    each = rows.select("book", "sheet", "hr", "hc", "direction", "minute", F.posexplode(F.array(*[f"v{i}" for i in range(1, 6)])).alias("at", "v")).withColumn("k", F.col("at") + 1)
    each = each.join(names, ["book", "sheet", "hr", "hc", "k"], "left")
    return each.groupBy("book", "direction", "minute", F.coalesce("klass", usual[F.col("at")]).alias("klass")).agg(F.max_by(F.coalesce("v", F.lit(0.0)), "k").alias("n"))


def axle_counts(cells: DataFrame) -> DataFrame:
    """(book, kind, lane, date, minute, label, n) from an axle counter's sheet: cells (book, row, col, text, number).

    kind: clasificatorio (label: a class), velocidad (label: the start of a band) or volumen (label null), from the
    heading of the section above, as is the lane; a summary or chart ends the section. The date is carried down a section,
    and is the next day where the hour goes back. Rows with a label other than a day's name are sums. A row counts only if
    its values add up to its total; the last of two rows of one minute wins. In a volume row a quarter is known by its
    distance from the total. Null and blank cells are ignored; a book without a section gives no rows.
    """
    text = F.trim("text")
    heading = text.contains("Lane #") & text.contains("Data From")
    one = cells.where("number IS NOT NULL OR trim(text) <> ''")
    numbers = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("col", "number"))))
    at = lambda cond, x: F.max_by(F.when(cond, x), F.when(cond, F.col("col")))
    rows = one.groupBy("book", "row").agg(
        numbers.alias("x"),
        F.count_if(text.contains("Summary") | text.contains("Charts")).alias("ends"),
        at(heading, F.regexp_extract(text, r"Lane #(\d)", 1).cast("int")).alias("head"),
        F.max(F.when(heading & text.contains("Speed"), "velocidad").when(heading & text.contains("Axle"), "clasificatorio")).alias("says"),
        F.count_if(~text.isin(DAYS)).alias("labels"),
        F.max(F.when((F.col("row") < 30) & text.contains("Volume Report"), "volumen").when((F.col("row") < 30) & text.contains("Classification Report"), "clasificatorio")).alias("report"),
    )
    down = Window.partitionBy("book").orderBy("row")
    rows = rows.withColumns({"span": F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(down), "report": F.last("report", ignorenulls=True).over(Window.partitionBy("book").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    headed = F.when(F.col("ends") == 0, F.col("head"))
    inside = Window.partitionBy("book", "span").orderBy("row")
    rows = rows.withColumn("lane", F.last(headed, ignorenulls=True).over(inside))
    rows = rows.withColumn("kind", F.when(F.col("lane").isNotNull(), F.coalesce(F.last(F.when(headed.isNotNull(), F.col("says")), ignorenulls=True).over(inside), F.lit("volumen"))))
    state = F.struct("span", "kind", "lane")
    rows = rows.withColumn("section", F.sum(F.when(F.lag(state).over(down).eqNullSafe(state), 0).otherwise(1)).over(down))
    rows = rows.where("kind IS NOT NULL AND labels = 0 AND size(x) >= 3").where("kind <> 'volumen' OR report = 'volumen'")
    first = F.col("x")[0]["number"]
    rows = rows.withColumn("dated", (first > DATES[0]) & (first < DATES[1]))
    section = Window.partitionBy("book", "section").orderBy("row")
    rows = rows.withColumns({"day": F.last(F.when(F.col("dated"), F.floor(first)), ignorenulls=True).over(section), "stretch": F.sum(F.col("dated").cast("int")).over(section)})
    rows = rows.withColumn("x", F.when(F.col("dated"), F.slice("x", 2, 1000)).otherwise(F.col("x")))
    rows = rows.withColumns({"hour": F.col("x")[0]["number"], "v": F.slice("x", 2, 1000)}).where("hour >= 0 AND hour < 1 AND day IS NOT NULL AND size(v) > 0")
    rows = rows.withColumn("minute", F.bround(F.col("hour") * 1440).cast("int"))
    stretch = Window.partitionBy("book", "section", "stretch").orderBy("row")
    rows = rows.withColumn("back", (F.col("minute") < F.lag("minute").over(stretch)).cast("int"))
    rows = rows.withColumn("date", F.date_add(F.lit("1899-12-30").cast("date"), (F.col("day") + F.coalesce(F.sum("back").over(stretch), F.lit(0))).cast("int")))
    total = F.element_at("v", -1)
    number = lambda c: c["number"]
    added = lambda v: F.aggregate(v, F.lit(0.0), lambda s, c: s + c["number"])
    n_of = F.when(F.col("kind") == "clasificatorio", len(AXLE_CLASSES)).otherwise(len(SPEED_BANDS))
    table = rows.where(F.col("kind") != "volumen").where(F.size("v") > n_of).where(F.abs(added(F.slice("v", F.lit(1), n_of)) - number(F.get("v", n_of))) <= SUM_TOLERANCE)
    names = F.when(F.col("kind") == "clasificatorio", F.array(*map(F.lit, AXLE_CLASSES))).otherwise(F.array(*map(F.lit, SPEED_BANDS)))
    table = table.select("book", "row", "kind", "lane", "date", "minute", F.explode(F.arrays_zip(names.alias("label"), F.transform(F.slice("v", F.lit(1), n_of), number).alias("n"))).alias("e"))
    table = table.select("book", "row", "kind", "lane", "date", "minute", "e.label", "e.n")
    quarters = F.slice("v", F.lit(1), F.size("v") - 1)
    volume = rows.where("kind = 'volumen' AND size(v) > 1").where((number(total) >= 0) & (total["col"] - F.get("v", F.lit(0))["col"] <= 4) & (F.abs(added(quarters) - number(total)) <= SUM_TOLERANCE))
    volume = volume.select("book", "row", "kind", "lane", "date", "minute", total["col"].alias("last"), F.explode(quarters).alias("e"))
    volume = volume.select("book", "row", "kind", "lane", "date", (F.col("minute") + 15 * (4 - (F.col("last") - F.col("e.col")))).cast("int").alias("minute"), F.lit(None).cast("string").alias("label"), F.col("e.number").alias("n"))
    return table.union(volume).groupBy("book", "kind", "lane", "date", "minute", "label").agg(F.max_by("n", "row").alias("n"))


def retimed(rows: DataFrame, segments: DataFrame, clocks: DataFrame) -> DataFrame:
    """rows (job_id, ts, frame) with ts from the file's own clock where the segment's frame rate is more than 5 % off.

    segments: job_id, fps, start_ts. clocks: job_id, n_frames, seconds; without one, or with an empty one, nothing changes.
    A row without a frame has the one in the middle of its old second. Frames fall evenly in the file's time.
    """
    rate = clocks.where("n_frames > 0 AND seconds > 0").select("job_id", (F.col("n_frames") / F.col("seconds")).alias("rate"))
    off = segments.join(rate, "job_id").where(F.abs(F.col("rate") - F.col("fps")) > RATE_TOLERANCE * F.col("fps")).select("job_id", "fps", "rate", "start_ts")
    both = rows.join(off, "job_id", "left")
    frame = F.coalesce(F.col("frame").cast("long"), F.floor((C.seconds(F.col("ts")) - C.seconds(F.col("start_ts")) + 0.5) * F.col("fps")))
    new = C.from_seconds(C.seconds(F.col("start_ts")) + F.floor(frame / F.col("rate")))
    return both.withColumn("ts", F.when(F.col("rate").isNotNull() & F.col("ts").isNotNull(), new).otherwise(F.col("ts"))).select(*[F.col(f"`{c}`") for c in rows.columns])


def warm_started(points: DataFrame, segments: DataFrame, previous: DataFrame) -> DataFrame:
    """points with, before each segment's own, the last three seconds of the segment that it goes on from, at frames below 0.

    points: job_id, frame, ... segments: job_id, fps, total_frames. previous: job_id, previous_id. Crossings are given out from frame 0 on only.
    """
    tail = points.withColumnRenamed("job_id", "previous_id").join(segments.select(F.col("job_id").alias("previous_id"), "fps", "total_frames"), "previous_id")
    tail = tail.where(F.col("frame") >= F.col("total_frames") - F.lit(WARM_SECONDS) * F.col("fps")).where(F.col("frame") < F.col("total_frames"))
    tail = tail.join(previous, "previous_id").withColumn("frame", (F.col("frame") - F.col("total_frames")).cast(points.schema["frame"].dataType))
    return points.unionByName(tail.select(*points.columns))


def reviewed_counts(crossings: DataFrame, movements: DataFrame) -> DataFrame:
    """(project_id, reviewer, crossings, movements, total): rows that each reviewer set a class for."""
    one = crossings.where("reviewer IS NOT NULL").select("project_id", "reviewer", F.lit(1).alias("c"), F.lit(0).alias("m"))
    two = movements.where("reviewer IS NOT NULL").select("project_id", "reviewer", F.lit(0).alias("c"), F.lit(1).alias("m"))
    return one.union(two).groupBy("project_id", "reviewer").agg(F.sum("c").alias("crossings"), F.sum("m").alias("movements"), F.count("*").alias("total"))
