"""Paths as arrays: smoothing, points at equal distances, packing and times.

Column expressions, but for ``resampled_arrays``, which takes whole Arrow batches of paths inside a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How paths are smoothed and stored.
MEDIAN_OF, STORED_POINTS, NO_LENGTH = 5, 48, 1e-6
STORED = "struct<t:array<double>,x:array<double>,y:array<double>,h:array<double>,ends_in_dest:boolean>"


def middle(values: Column) -> Column:
    """The median of an array: the mean of the two middle values of an even number."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def smoothed(values: Column) -> Column:
    """Running medians of five, of three and four at the ends; arrays of under five values stay as they are."""
    n, half = F.size(values), MEDIAN_OF // 2
    low = lambda i: F.greatest(F.lit(0), i - half)
    near = lambda i: F.slice(values, low(i) + 1, F.least(n - 1, i + half) - low(i) + 1)
    return F.when(n < MEDIAN_OF, values).otherwise(F.transform(values, lambda v, i: middle(near(i))))


def lengths(xs: Column, ys: Column) -> Column:
    """The way from the first point to each point."""
    step = lambda i: F.hypot(F.get(xs, i) - F.get(xs, i - 1), F.get(ys, i) - F.get(ys, i - 1))
    way = F.array(F.lit(0.0))
    rest = F.when(F.size(xs) > 1, F.sequence(F.lit(1), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, way, lambda done, i: F.concat(done, F.array(F.element_at(done, -1) + step(i))))


def between(places: Column, values: dict[str, Column], goals: Column) -> Column:
    """For each goal a structure of the values at that place: straight between two of the ascending places, the end's value beyond the ends.

    Where several places are equal the last counts. The place before each goal is looked up once for all values."""
    found = F.transform(goals, lambda g: F.struct(g.alias("g"), (F.size(F.filter(places, lambda p: p <= g)) - 1).alias("i")))
    last = F.size(places) - 1

    def value(q: Column, v: Column) -> Column:
        i = q["i"]
        share = (q["g"] - F.get(places, i)) / (F.get(places, i + 1) - F.get(places, i))
        inner = F.get(v, i) + (F.get(v, i + 1) - F.get(v, i)) * share
        return F.when(i < 0, F.get(v, F.lit(0))).when(i >= last, F.get(v, last)).otherwise(inner)

    return F.transform(found, lambda q: F.struct(*[value(q, v).alias(name) for name, v in values.items()]))


def resampled(xs: Column, ys: Column, hs: Column, n: int) -> Column:
    """n structures (x, y, h) at equal distances along the smoothed path. Null for null, unequal or shorter arrays than two and for paths of no length."""
    sx, sy = smoothed(xs.cast("array<double>")), smoothed(ys.cast("array<double>"))
    # each step is named once, in an array of one structure, so that it is computed once
    one = F.array(F.struct(sx.alias("x"), sy.alias("y"), hs.cast("array<double>").alias("h")))
    one = F.transform(one, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["h"].alias("h"), lengths(p["x"], p["y"]).alias("way")))
    one = F.transform(one, lambda p: F.struct(p.alias("p"), F.element_at(p["way"], -1).alias("long")))
    goals = lambda q: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: q["long"] * j / (n - 1))
    out = F.transform(one, lambda q: F.when(q["long"] >= NO_LENGTH, between(q["p"]["way"], {c: q["p"][c] for c in ("x", "y", "h")}, goals(q))))
    whole = (F.size(xs) >= 2) & (F.size(xs) == F.size(ys)) & (F.size(xs) == F.size(hs))
    return F.when(whole, F.get(out, F.lit(0)))


def resampled_arrays(xs: pa.Array, ys: pa.Array, hs: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``resampled`` gives for a batch of lists: the rows that give points, and their x, y and h (n a row).

    Paths of one length are taken together. A path whose smoothed places are not all finite gives none; a null height stays NaN."""
    sizes = [np.asarray(v.value_lengths().fill_null(0)) for v in (xs, ys, hs)]
    starts = [np.cumsum(s) - s for s in sizes]
    # nulls sort before all values
    flat = [v.flatten().cast(pa.float64()).fill_null(lost).to_numpy(zero_copy_only=False) for v, lost in ((xs, -np.inf), (ys, -np.inf), (hs, np.nan))]
    whole = (sizes[0] >= 2) & (sizes[0] == sizes[1]) & (sizes[0] == sizes[2])
    out = [(np.zeros(0, int), *[np.zeros((0, n))] * 3)]
    for m in np.unique(sizes[0][whole]):
        rows = np.nonzero(whole & (sizes[0] == m))[0]
        x, y, h = (v[s[rows][:, None] + np.arange(m)] for v, s in zip(flat, starts))
        if m >= MEDIAN_OF:
            x, y = (np.stack([_middles(v[:, max(0, i - MEDIAN_OF // 2) : i + MEDIAN_OF // 2 + 1]) for i in range(m)], axis=1) for v in (x, y))
        with np.errstate(invalid="ignore"):
            way = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(np.hypot(np.diff(x), np.diff(y)), axis=1)], axis=1)
        long = np.isfinite(way[:, -1]) & (way[:, -1] >= NO_LENGTH)
        rows, way, values = rows[long], way[long], [v[long] for v in (x, y, h)]
        goals = way[:, -1:] * np.arange(n) / (n - 1)
        place = np.zeros(goals.shape, int)
        for k in range(1, m):
            place += way[:, k, None] <= goals
        low = np.minimum(place, m - 2)
        at = lambda v, i: np.take_along_axis(v, i, axis=1)
        span = at(way, low + 1) - at(way, low)
        share = np.divide(goals - at(way, low), span, out=np.zeros_like(goals), where=span > 0)
        out.append((rows, *[np.where(place >= m - 1, v[:, -1:], at(v, low) + (at(v, low + 1) - at(v, low)) * share) for v in values]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _middles(values: np.ndarray) -> np.ndarray:
    """The median of each row."""
    s, n = np.sort(values, axis=1), values.shape[1]
    return (s[:, (n - 1) // 2] + s[:, n // 2]) / 2


def has_length(xs: Column, ys: Column) -> Column:
    """Whether ``resampled`` gives points: two or more, and not all in one place once they are smoothed."""
    one = F.array(F.struct(smoothed(xs.cast("array<double>")).alias("x"), smoothed(ys.cast("array<double>")).alias("y")))
    step = lambda p, i: F.hypot(F.get(p["x"], i) - F.get(p["x"], i - 1), F.get(p["y"], i) - F.get(p["y"], i - 1))
    total = F.transform(one, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p["x"]) - 1), F.lit(0.0), lambda done, i: done + step(p, i)))
    # the smoothed ends are the middle ones of the three values there: if they differ, nothing else need be looked at
    end = lambda v, start: middle(F.slice(v.cast("array<double>"), start, F.lit(3)))
    apart = lambda v: end(v, F.lit(1)) - end(v, F.greatest(F.lit(1), F.size(v) - 2))
    plain = (F.size(xs) >= MEDIAN_OF) & (F.hypot(apart(xs), apart(ys)) >= NO_LENGTH)
    whole = (F.size(xs) >= 2) & (F.size(xs) == F.size(ys))
    return F.when(whole & plain, F.lit(True)).when(whole, F.get(total, F.lit(0)) >= NO_LENGTH).otherwise(F.lit(False))


def with_heights(paths: DataFrame) -> DataFrame:
    """paths with hs, an array of heights: their own, or their one height for every point."""
    if "hs" in paths.columns:
        return paths
    return paths.withColumn("hs", F.when(F.col("xs").isNotNull(), F.array_repeat(F.col("height").cast("double"), F.size("xs"))))


def packed(points: Column, fps: Column, ends_in_dest: Column) -> Column:
    """A path as it is stored: at most 48 of its points, evenly spread, as four arrays and whether it ended in its destination.

    points: array of struct(frame, x, y, h) in order. Times are seconds from the start of the video, to the hundredth; places to the tenth."""
    n = F.size(points)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(STORED_POINTS - 1)), lambda i: F.rint(i * ((n - 1) / F.lit(STORED_POINTS - 1))).cast("int")))
    kept = F.when(n > STORED_POINTS, F.transform(spread, lambda i: F.get(points, i))).otherwise(points)
    column = lambda f, digits: F.transform(kept, lambda p: F.round(f(p), digits))
    return F.struct(
        column(lambda p: p["frame"] / fps, 2).alias("t"), column(lambda p: p["x"].cast("double"), 1).alias("x"), column(lambda p: p["y"].cast("double"), 1).alias("y"), column(lambda p: p["h"].cast("double"), 1).alias("h"),
        F.coalesce(ends_in_dest, F.lit(False)).alias("ends_in_dest"),
    )


def unpacked(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with a stored path as xs, ys, hs, ts, seconds and inside, as the jobs on paths take them."""
    p = lambda c: F.col(f"{path}.{c}")
    own = [p("x").alias("xs"), p("y").alias("ys"), p("h").alias("hs"), p("t").alias("ts"), (F.element_at(p("t"), -1) - F.get(p("t"), F.lit(0))).alias("seconds"), p("ends_in_dest").alias("inside")]
    return rows.select(*[c for c in rows.columns if c != path], *own)


def retimed(path: Column, old_fps: Column, clock: Column) -> Column:
    """A stored path with the times of a clock (array of struct(frame, at), ascending): each time goes back to its frame by the old rate and takes that frame's time.

    A frame between two of the clock lies straight between their times; null clocks and empty ones leave the path as it is."""
    frames, times = F.transform(clock, lambda c: c["frame"].cast("double")), F.transform(clock, lambda c: c["at"].cast("double"))
    new = F.transform(between(frames, {"at": times}, F.transform(path["t"], lambda t: F.rint(t * old_fps))), lambda q: F.round(q["at"], 2))
    return F.when(F.size(clock) > 0, path.withField("t", new)).otherwise(path)
