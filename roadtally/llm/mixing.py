"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is its weight's part of the whole, at most ``cap`` times the source's own size;
what is above goes to the others by weight until none is above. A target is met by whole epochs of
the source first. The rest is a weighted sample without replacement: each document draws
-ln(u) / quality, keys are sorted within the source, and documents are taken while the running
total of sizes stays nearest the rest of the target.

u comes from an MD5 of the seed and the id, so reruns agree and no draw depends on partitions. The
running total is cut into ranges of the key: totals of ranges are summed first, so no task sorts a
whole source, however large. Of a source only the place where the sample ends is kept, which each
row is then compared with; texts are never shuffled.

Defined results: a null text has size 0; a null source comes last in the order of weights; repeated
rows draw one key and are taken alike, as a group, to the nearest; sources of size 0 get target 0; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.llm.common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Ranges of the key in which a source's running total is summed on its own.
RANGES = 1024
#: Up to so many sources (some 60 bytes each) their cuts go to every task; beyond, they are joined.
FEW_SOURCES = 200_000


def quality_weight(text: Column) -> Column:
    """1 for prose, down to 0.1 as a text's share of markup symbols grows."""
    left = F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(left.cast("double"), F.length(text).cast("double")), F.lit(1.0)))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the seed and the id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With r = cap * size / weight in ascending order, the sources that stop at their cap are the
    first k for which what is left for a unit of weight does not reach the next r.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % n + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    whole = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    left = F.col("budget") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    over = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = rows.withColumn("level", left / over)
    # the first source in this order that its level doesn't fill fixes the level of all after it
    fixing = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))
    rows = rows.withColumn("level", F.min(fixing).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _source_cuts(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: epochs, and last_key, the greatest key that its sample takes."""
    ranged = drawn.where("size > 0").withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * RANGES))
    totals = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    plan = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = F.col("source").eqNullSafe(F.col("s"))
    # only the range in which a sample ends needs an order within it
    ends = totals.withColumnRenamed("source", "s").join(plan, same).where("ahead <= rest AND rest < ahead + part_size")
    ends = ends.select("s", F.col("part").alias("p"), "ahead", "rest")
    inside = ranged.join(ends, same & (F.col("part") == F.col("p")))
    group = inside.groupBy("source", "key", "ahead", "rest").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    group = group.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    inner = group.where("ahead + size / 2.0D <= rest").groupBy("source").agg(F.max("key").alias("inner_key"))
    low = ends.select("s", (F.col("p") / F.lit(float(RANGES))).alias("edge"))
    cuts = plan.join(inner.withColumnRenamed("source", "i"), F.col("source").eqNullSafe(F.col("i")), "left")
    cuts = cuts.join(low, F.col("source").eqNullSafe(F.col("s")), "left")
    # all ranges before the last one are taken whole; without a last range (rest 0 or above all) nothing or everything is
    return cuts.select(F.col("source").alias("cut_source"), "source_size", "target", "epochs", "inner_key", "edge", (F.col("rest") >= F.col("source_size")).alias("all_rest"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """docs with a struct column ``__mix``: size, source_size, target, copies, taken."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality_weight(text)
    drawn = written(docs.select(F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key")), "drawn")
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = written(_source_cuts(drawn, source_targets(sizes, weights, share, cap)), "cuts")
    if cuts.count() <= FEW_SOURCES:
        cuts = F.broadcast(cuts)
    rows = docs.withColumn("__size", size).withColumn("__key", key)
    rows = rows.join(cuts.select(F.struct("*").alias("__cut")), F.col("source").cast("string").eqNullSafe(F.col("__cut.cut_source")), "left")
    part = F.floor((1 - F.exp(-F.col("__key"))) * RANGES) / F.lit(float(RANGES))
    sampled = F.col("__cut.all_rest") | (part < F.col("__cut.edge")) | ((part == F.col("__cut.edge")) & (F.col("__key") <= F.col("__cut.inner_key")))
    copies = F.col("__cut.epochs") + F.when(sampled & (F.col("__size") > 0), 1).otherwise(0)
    mixed = F.struct(
        F.col("__size").alias("size"),
        F.col("__cut.source_size").alias("source_size"),
        F.col("__cut.target").alias("target"),
        copies.cast("int").alias("copies"),
        (copies * F.col("__size")).cast("long").alias("taken"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], mixed.alias("__mix"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs repeated as often as the mix takes them, with their own columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = mix(docs, **options).where("__mix.copies > 0")
    return taken.select(*own, F.explode(F.expr("sequence(1, __mix.copies)")).alias("__copy")).select(*own)


#: The same mix in DuckDB SQL, each source's documents sorted as a whole.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656.0e0)
    / greatest(0.1e0, coalesce(length(translate(text, '#*$%&|<>', '')) / nullif(CAST(length(text) AS DOUBLE), 0), 1.0e0)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0e0 * source_size AS most, [5.0e0, 2.0e0, 1.0e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
l AS (SELECT *, most / weight AS ratio, (1.5e0 * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS fixed FROM l WHERE level < ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT fixed FROM f) IS NULL THEN most ELSE least(most, (SELECT fixed FROM f) * weight) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
g AS (SELECT source, key, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, key),
r AS (SELECT source, key, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM g)
SELECT d.doc_id, d.size, p.source_size, round(p.target, 6) AS target, CAST((p.epochs + CASE WHEN d.size > 0 AND r.ahead + r.size / 2.0e0 <= p.target - p.epochs * p.source_size THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.key = d.key
"""
