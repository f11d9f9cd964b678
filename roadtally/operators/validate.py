"""Validation of counts against hand counts and axle counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.functions.columns import geh
from roadtally.operators.tracks import greedy_pairs

GEH_LIMIT, PASS_SHARE = 5.0, 0.85


def geh_table(matched: DataFrame, per_hour: float = 4.0) -> DataFrame:
    """matched (n_hand, n_ours of a quarter) with geh on hourly flows and whether it passes."""
    rows = matched.withColumn("geh", geh(F.col("n_ours") * per_hour, F.col("n_hand") * per_hour))
    return rows.withColumn("passes", F.col("geh") < GEH_LIMIT)


def acceptance(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (n, passing, ratio, accepted)."""
    out = table.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("passes").alias("passing"), (F.sum("n_ours") / F.sum("n_hand")).alias("ratio"))
    return out.withColumn("accepted", F.col("passing") >= PASS_SHARE * F.col("n"))


def scaled_by_coverage(matched: DataFrame, least: float = 0.85) -> DataFrame:
    """Quarters covered by 85 % or more, the hand count scaled by the coverage, flows over the covered minutes."""
    rows = matched.where(F.col("coverage") >= least).withColumn("n_hand", F.col("n_hand") * F.col("coverage"))
    hours = 0.25 * F.col("coverage")
    return rows.withColumn("geh", geh(F.col("n_ours") / hours, F.col("n_hand") / hours))


def profile_agreement(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (ratio, r, flat): totals' ratio, correlation of the quarters' profiles, and whether the hand profile is flat."""
    out = matched.groupBy(*keys).agg((F.sum("n_ours") / F.sum("n_hand")).alias("ratio"), F.corr("n_ours", "n_hand").alias("r"), (F.stddev_pop("n_hand") / F.avg("n_hand")).alias("cv"))
    return out.withColumn("flat", F.col("cv") < 0.12)


def clock_offset(by_minute: DataFrame, hand: DataFrame, covered: DataFrame, most: int = 10) -> DataFrame:
    """(project_id, shift, error): error by quarter after removing the scale, for each shift of our minutes.

    by_minute: project_id, lane_id, minute, n. hand: project_id, lane_id, quarter, n_hand (a quarter's first minute).
    covered: project_id, minute. Only quarters all of whose shifted minutes are covered count."""
    shifts = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")
    quarters = hand.select("project_id", "quarter").distinct().select("*", shifts).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(14))))
    need = quarters.withColumn("minute", F.pmod(F.col("quarter") + F.col("k") - F.col("shift"), F.lit(1440)))
    good = need.join(covered, ["project_id", "minute"], "left_semi").groupBy("project_id", "quarter", "shift").agg(F.count("*").alias("c")).where("c = 15").drop("c")
    moved = by_minute.select("*", shifts).withColumn("at", F.pmod(F.col("minute") + F.col("shift"), F.lit(1440)))
    ours = moved.groupBy("project_id", "lane_id", "shift", (F.floor(F.col("at") / 15) * 15).cast("int").alias("quarter")).agg(F.sum("n").alias("n"))
    lanes = hand.select("project_id", "lane_id").distinct()
    rows = good.join(lanes, "project_id").join(ours, ["project_id", "lane_id", "shift", "quarter"], "left").join(hand, ["project_id", "lane_id", "quarter"], "left").na.fill(0, ["n", "n_hand"])
    whole = Window.partitionBy("project_id", "lane_id", "shift")
    scale = F.when(F.sum("n").over(whole) > 0, F.sum("n_hand").over(whole) / F.sum("n").over(whole)).otherwise(0.0)
    rows = rows.withColumn("gap", F.abs(scale * F.col("n") - F.col("n_hand")))
    return rows.groupBy("project_id", "shift").agg((F.sum("gap") / F.sum("n_hand")).alias("error"))


def headway_clusters(crossings: DataFrame, wait: float, at: str = "at") -> DataFrame:
    """(lane_id, quarter, n): crossings closer than ``wait`` seconds to the one before count once, within a quarter."""
    quarter = F.floor(F.col(at) / 900) * 900
    rows = crossings.withColumn("quarter", quarter.cast("long"))
    gap = F.col(at) - F.lag(at).over(Window.partitionBy("lane_id", "quarter").orderBy(at, "id"))
    return rows.withColumn("gap", gap).groupBy("lane_id", "quarter").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") >= wait)).alias("n"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, truth_n, guess_n, right, precision, recall, gap): gap is the difference of shares."""
    pairs = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    t = pairs.groupBy(F.col(truth).alias("klass")).agg(F.sum("n").alias("truth_n"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n"))).alias("right"))
    g = pairs.groupBy(F.col(guess).alias("klass")).agg(F.sum("n").alias("guess_n"))
    both = t.join(g, "klass", "full").na.fill(0)
    share = lambda c: F.col(c) / F.sum(c).over(total)
    return both.select("klass", "truth_n", "guess_n", "right", F.try_divide("right", "guess_n").alias("precision"), F.try_divide("right", "truth_n").alias("recall"), (share("guess_n") - share("truth_n")).alias("gap"))


def best_multiplier(heights: DataFrame, cars: DataFrame, heavies_by_hand: DataFrame) -> DataFrame:
    """(lane_id, multiplier, gap): of 1.00, 1.01, ..., 4.00 the one whose count of taller vehicles is nearest the hand count.

    Heights are summed to a histogram before the grid multiplies them."""
    sizes = heights.groupBy("lane_id", "bbox_height").agg(F.count("*").alias("c"))
    middle = cars.groupBy("lane_id").agg(F.percentile("bbox_height", 0.5).alias("m"))
    grid = F.explode(F.sequence(F.lit(100), F.lit(400))).alias("k")
    rows = sizes.join(middle, "lane_id").select("*", grid)
    taller = rows.groupBy("lane_id", "k").agg(F.sum(F.when(F.col("bbox_height") > F.col("k") / 100 * F.col("m"), F.col("c")).otherwise(0)).alias("n"))
    gaps = taller.join(heavies_by_hand, "lane_id").withColumn("gap", F.abs(F.col("n") - F.col("n_hand")))
    best = gaps.groupBy("lane_id").agg(F.min(F.struct("gap", "k")).alias("b"))
    return best.select("lane_id", (F.col("b.k") / 100).alias("multiplier"), F.col("b.gap").alias("gap"))


def composition_gap(ours: DataFrame, reference: DataFrame, keys: list[str], klass: str) -> DataFrame:
    """keys + (class, share_ours, share_ref, points): shares in percent and their difference."""
    share = lambda df, name: df.groupBy(*keys, klass).agg(F.sum("n").alias("n")).select(*keys, klass, (100 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(name))
    both = share(ours, "share_ours").join(share(reference, "share_ref"), [*keys, klass], "full").na.fill(0)
    return both.withColumn("points", F.col("share_ours") - F.col("share_ref"))


def choose_references(counts: DataFrame) -> DataFrame:
    """The rows of the best source of each site, direction and date: hand counts, then class reports, then volume reports."""
    rank = F.when(F.col("source") == "hand", 0).when(F.col("source") == "class", 1).otherwise(2)
    best = F.min(rank).over(Window.partitionBy("project_id", "direction", "dd"))
    return counts.withColumn("__rank", rank).withColumn("__best", best).where("__rank = __best").drop("__rank", "__best")


def two_group_split(heights: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (cut, between): the height after which the variance between two groups is greatest (Otsu), by prefix sums
    over the histogram; none where a group has under 10 % of the sample."""
    sizes = heights.groupBy(*keys, "bbox_height").agg(F.count("*").alias("c"))
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bbox_height")
    rows = sizes.withColumns({"n0": F.sum("c").over(order), "s0": F.sum(F.col("c") * F.col("bbox_height")).over(order), "n": F.sum("c").over(group), "s": F.sum(F.col("c") * F.col("bbox_height")).over(group)})
    n1 = F.col("n") - F.col("n0")
    rows = rows.where((F.col("n0") >= 0.1 * F.col("n")) & (n1 >= 0.1 * F.col("n")))
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    rows = rows.withColumn("between", F.col("n0") * n1 * gap * gap)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(F.col("bbox_height").alias("cut"), "between"), F.struct("between", -F.col("bbox_height"))).alias("b"))
    return best.select(*keys, "b.cut", "b.between")


def reliability(rows: DataFrame) -> DataFrame:
    """rows (n_ours, n_hand, geh, complete_share) with a level and a note."""
    small = (F.col("n_hand") < 30) & (F.abs(F.col("n_ours") - F.col("n_hand")) > 0.3 * F.col("n_hand"))
    # Names of the levels in the delivered reports.
    level = (
        F.when(F.col("n_hand").isNotNull() & (F.col("geh") < GEH_LIMIT), "Validado")
        .when(F.col("n_hand").isNotNull(), "No pasó")
        .when(F.col("complete_share") >= 0.60, "Medido")
        .when(F.col("complete_share") >= 0.45, "Con reservas")
        .otherwise("Poco confiable")
    )
    return rows.withColumn("level", level).withColumn("note", F.when(F.coalesce(small, F.lit(False)), "orden de magnitud").otherwise(""))


def paired_directions(ours: DataFrame, hand: DataFrame) -> DataFrame:
    """(project_id, zone, direction, r): each roadway with the counted direction whose quarters go most like its own, one to one, best first.

    ours: project_id, zone, bin, n. hand: project_id, direction, bin, n; bins of one key are distinct. A site's bins are those of
    its hand counts, and a bin without a row is 0. r is -2 with under three bins or a constant side; ties go by zone, then
    direction. Rows with a null zone, direction or bin are left out; a null n is 0; a zone that gets no direction has null there.
    """
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    hand = hand.where("direction IS NOT NULL AND bin IS NOT NULL").select("project_id", "direction", "bin", n.alias("h"))
    ours = ours.where("zone IS NOT NULL AND bin IS NOT NULL").select("project_id", "zone", "bin", n.alias("o"))
    bins = hand.select("project_id", "bin").distinct()
    size = bins.groupBy("project_id").agg(F.count("*").alias("bins"))
    inside = ours.join(bins, ["project_id", "bin"], "left_semi")
    moments = lambda rows, key, v: rows.groupBy("project_id", key).agg(F.sum(v).alias(f"s{v}"), F.sum(F.col(v) * F.col(v)).alias(f"q{v}"))
    zones = ours.select("project_id", "zone").distinct()
    own = zones.join(moments(inside, "zone", "o"), ["project_id", "zone"], "left").fillna(0, ["so", "qo"])
    both = inside.join(hand, ["project_id", "bin"]).groupBy("project_id", "zone", "direction").agg(F.sum(F.col("o") * F.col("h")).alias("oh"))
    # a site has a few roadways and directions; its quarters are summed by here
    pairs = own.join(moments(hand, "direction", "h"), "project_id").join(size, "project_id").join(both, ["project_id", "zone", "direction"], "left")
    spread = (F.col("bins") * F.col("qo") - F.col("so") * F.col("so")).cast("double") * (F.col("bins") * F.col("qh") - F.col("sh") * F.col("sh"))
    shared = F.col("bins") * F.coalesce("oh", F.lit(0)) - F.col("so") * F.col("sh")
    r = F.when((F.col("bins") >= 3) & (spread > 0), F.round(shared / F.sqrt(F.when(spread > 0, spread)), 9)).otherwise(-2.0)
    best = greedy_pairs(pairs.select("project_id", "zone", "direction", r.alias("r"), (-r).alias("low")), ["project_id"], "zone", "direction", ["low"])
    return zones.join(best.drop("low"), ["project_id", "zone"], "left").select("project_id", "zone", "direction", "r")
