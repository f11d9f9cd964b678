"""Broken tracks: which later piece goes on with which, and chains of pieces.

All steps are joins and sums over whole tables. Pieces that end alike, or start alike, are one kind, and candidates are pairs of
kinds, so equal pieces make no more of them. The only grouped step solves the assignment inside one connected part of the
candidates: kinds of one video that vanish and appear within a second of each other, near the same place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.operators import graphs
from roadtally.operators.assign import shared_out
from roadtally.sources.sinks import dealt, kept_table

# Limits under which joined pieces were compared with video.
GAP_SECONDS, TOLERANCE, SIZES = 1.0, 2.0, (0.5, 2.0)
SPREAD_SHARE, STANDING, STANDING_NEAR, MOVING, LEAST_COSINE = 0.5, 0.15, 0.35, 0.5, -0.3
TIME_WEIGHT, WAY_WEIGHT, END_POINTS, ACCESS_MOVED = 0.5, 0.3, 5, 2.0


def piece_ends(points: DataFrame) -> DataFrame:
    """One row a piece (job_id, track_id): n, its first and last point and speed at both ends.

    points: job_id, track_id, frame, gx, gy, h, access (null: the centre). Columns f0, x0, y0, a0, h0, vx0, vy0 are of the start,
    f1, x1, y1, a1, h1, vx1, vy1 of the end: frame, place, access, the greatest height of the five points there (a box shrinks
    when it is half hidden) and the speed a frame over up to four steps. Only those five points of each end are kept; points of a null frame or place are left out."""
    real = points.where("frame IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL")
    own = Window.partitionBy("job_id", "track_id")
    row = real.withColumn("k", F.row_number().over(own.orderBy("frame"))).withColumn("n", F.count("*").over(own))
    row = row.withColumn("back", F.col("n") - F.col("k"))
    last = F.least(F.col("n"), F.lit(END_POINTS))  # points of an end
    at = lambda place, column: F.max(F.when(place, F.col(column)))
    first, final, inner, outer = F.col("k") == 1, F.col("back") == 0, F.col("k") == last, F.col("back") == last - 1
    sides = {"0": (first, F.col("k") <= END_POINTS, first, inner), "1": (final, F.col("back") < END_POINTS, outer, final)}
    out = [F.first("n").alias("n")]
    for side, (end, near, early, late) in sides.items():
        frames = F.greatest(F.lit(1), at(late, "frame") - at(early, "frame"))
        out += [at(end, "frame").alias(f"f{side}"), at(end, "gx").alias(f"x{side}"), at(end, "gy").alias(f"y{side}"), at(end, "access").alias(f"a{side}"), at(near, "h").alias(f"h{side}")]
        out += [((at(late, "gx") - at(early, "gx")) / frames).alias(f"vx{side}"), ((at(late, "gy") - at(early, "gy")) / frames).alias(f"vy{side}")]
    return row.where((F.col("k") <= END_POINTS) | (F.col("back") < END_POINTS)).groupBy("job_id", "track_id").agg(*out)


ENDS = [f"{c}{side}" for side in "01" for c in ("f", "x", "y", "a", "h", "vx", "vy")]


def moving_ends(points: DataFrame, moved: float, short: int = 15) -> DataFrame:
    """``piece_ends`` of the pieces that ``geometry.moved`` keeps, with the destination of ``tracks.origins_destinations``, in one pass.

    points: job_id, track_id, frame, gx, gy, h, access. They are dealt and ordered by track once; a task reads its tracks in order, as arrays."""
    kinds = {"job_id": "long", "track_id": "long", "frame": "double", "gx": "double", "gy": "double", "h": "double", "access": "long"}
    rows = points.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).where("job_id IS NOT NULL AND track_id IS NOT NULL")
    rows = dealt(rows, "job_id", "track_id").sortWithinPartitions("job_id", "track_id", "frame")

    def read(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = _begins(pa.Table.from_batches([*held[-1:], batch]))
            before = held[-1].num_rows if held else 0
            cut = int(begins[-1]) - before if len(begins) else 0  # the last track may go on in the next batch
            if cut > 0 or (held and cut == 0 and before in begins):
                yield from _ends_of(pa.Table.from_batches([*held, batch.slice(0, cut)]), moved, short).to_batches()
                held = []
            held.append(batch.slice(max(cut, 0)))
        if held:
            yield from _ends_of(pa.Table.from_batches(held), moved, short).to_batches()

    schema = ", ".join(f"{c} {'long' if c[0] == 'a' else 'double'}" for c in ENDS)
    return rows.mapInArrow(read, f"job_id long, track_id long, n long, destination long, {schema}")


def _begins(rows: pa.Table) -> np.ndarray:
    """Where a track begins."""
    keys = [rows.column(c).to_numpy() for c in ("job_id", "track_id")]
    new = np.ones(rows.num_rows, bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    return np.flatnonzero(new)


def _ends_of(rows: pa.Table, moved: float, short: int) -> pa.Table:
    """Rows of whole tracks, ordered by track and frame (null first)."""
    start, total = _begins(rows), rows.num_rows
    size = np.diff(np.r_[start, total])
    piece = np.repeat(np.arange(len(start)), size)
    known = {c: rows.column(c).is_valid().to_numpy() for c in ("frame", "gx", "gy", "h", "access")}
    frame, x, y, h = (rows.column(c).fill_null(0.0).to_numpy() for c in ("frame", "gx", "gy", "h"))
    access = rows.column("access").fill_null(0).to_numpy()
    # the greatest way from the first point, against the upper median height
    nulls = np.add.reduceat(~known["frame"], start) if total else size
    first = start + np.minimum(nulls, size - 1)
    placed = known["gx"] & known["gy"] & (known["gx"] & known["gy"] & known["frame"])[first][piece]
    reach = np.maximum.reduceat(np.where(placed, np.hypot(x - x[first][piece], y - y[first][piece]), -np.inf), start) if total else np.zeros(0)
    order = np.lexsort((h, ~known["h"], piece))
    heights = np.add.reduceat(known["h"], start) if total else size
    middle = h[order[np.minimum(start + heights // 2, total - 1)]] if total else np.zeros(0)
    far = (heights > 0) & (reach > -np.inf) & ((reach >= moved * middle) | np.isnan(reach))
    # runs of one access, without short stays in the centre between two of the same
    same = lambda own, on, of: (of[1:] == of[:-1]) & (on[1:] == on[:-1]) & (~on[1:] | (own[1:] == own[:-1]))
    run = np.flatnonzero(np.r_[True, ~same(access, known["access"], piece)]) if total else start
    at, on, of = access[run], known["access"][run], piece[run]
    low, high = (f.reduceat(np.where(known["frame"], frame, np.nan), run) if total else np.zeros(0) for f in (np.fmin, np.fmax))
    back = np.zeros(len(run), bool)
    back[1:-1] = ~on[1:-1] & on[:-2] & on[2:] & (of[:-2] == of[2:]) & (at[:-2] == at[2:]) & (high - low < short)[1:-1]
    at, on, of = at[~back], on[~back], of[~back]
    new = np.r_[True, ~same(at, on, of)][: len(at)]
    at, on, of = at[new], on[new], of[new]
    stays = np.bincount(of[on], minlength=len(start))
    ends_on, begins_on, other = (np.zeros(len(start), t) for t in (bool, bool, np.int64))
    ends_on[of], begins_on[of[::-1]], other[of[on]] = on, on[::-1], at[on]
    arrived = (stays > 1) | ((stays == 1) & ~begins_on & ends_on)
    # the points of both ends
    real = np.flatnonzero(known["frame"] & known["gx"] & known["gy"])
    n = np.bincount(piece[real], minlength=len(start))
    mine = np.flatnonzero(far & (n > 0))
    n = n[mine]
    begin = np.searchsorted(piece[real], mine)
    last, some = begin + n - 1, np.minimum(n, END_POINTS) - 1
    out = {"job_id": rows.column("job_id").take(pa.array(start[mine])), "track_id": rows.column("track_id").take(pa.array(start[mine])), "n": pa.array(n), "destination": pa.array(other[mine], mask=~arrived[mine])}
    for side, end, early, late in (("0", begin, begin, begin + some), ("1", last, last - some, last)):
        here, a, b = real[end], real[early], real[late]
        near = [real[np.minimum(early + k, late)] for k in range(END_POINTS)]
        height = np.max([np.where(known["h"][i], h[i], -np.inf) for i in near], axis=0) if len(mine) else np.zeros(0)
        frames = np.maximum(1.0, frame[b] - frame[a])
        out |= {f"f{side}": pa.array(frame[here]), f"x{side}": pa.array(x[here]), f"y{side}": pa.array(y[here]), f"a{side}": pa.array(access[here], mask=~known["access"][here])}
        out |= {f"h{side}": pa.array(height, mask=height == -np.inf), f"vx{side}": pa.array((x[b] - x[a]) / frames), f"vy{side}": pa.array((y[b] - y[a]) / frames)}
    return pa.table(out)


def fragment_candidates(ends: DataFrame, fps: Column | float, gap: float = GAP_SECONDS, tolerance: float = TOLERANCE, standing_gap: float | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(job_id, a, b, cost): pieces b that may go on with piece a.

    ends: as ``piece_ends`` gives, with ``destination``; starts: where b is taken from, if not from there. A piece a has no destination and two points or more. Piece b starts after a ends, in
    the centre or in the access where a ended, and its height is half to twice that of a. Within ``gap`` seconds it must
    start near where a stood or would be, and if both move not head the other way. A standing a (under 15 % of its height a
    second) may be away for ``standing_gap`` seconds if b starts on the same spot; that costs more than any other join.
    A piece is joined only with starts of the steps of one gap that it can reach. Null heights and places give no candidates."""
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    speed = F.hypot("vx1", "vy1")
    paced = lambda rows: rows.withColumn("g", F.greatest(F.lit(1), F.floor(F.lit(gap) * fps)).cast("long")).withColumn("long_g", F.floor(F.lit(float(standing_gap or 0)) * fps).cast("long"))
    rows = paced(ends)
    lost = rows.where("destination IS NULL AND n >= 2").withColumn("standing", speed * fps <= STANDING * F.col("h1"))
    reach = F.when(F.col("standing"), F.greatest("g", "long_g")).otherwise(F.col("g"))
    lost = lost.withColumn("step", F.explode(F.sequence(F.floor(F.col("f1") / F.col("g")), F.floor((F.col("f1") + reach) / F.col("g")))))
    born = (rows if starts is None else paced(starts)).select("job_id", F.floor(F.col("f0") / F.col("g")).alias("step"), F.col("track_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("f0", "x0", "y0", "a0", "h0", "vx0", "vy0")])
    dt = F.col("b_f0") - F.col("f1")
    both = lost.join(born, ["job_id", "step"]).withColumn("dt", dt).where("track_id <> b AND dt > 0").withColumn("late", F.col("dt") > F.col("g"))
    both = both.where(~F.col("late") | (F.col("standing") & (F.col("dt") <= F.col("long_g"))))
    both = both.where(F.col("b_a0").isNull() | F.coalesce(F.col("b_a0") == F.col("a1"), F.lit(False))).where((F.col("b_h0") / F.greatest("h1", F.lit(1))).between(*SIZES))
    scale, one = F.greatest("h1", "b_h0", F.lit(1)), F.lit(1.0)
    stayed = F.hypot(F.col("b_x0") - F.col("x1"), F.col("b_y0") - F.col("y1"))
    meant = F.hypot(F.col("b_x0") - F.col("x1") - F.col("vx1") * F.col("dt"), F.col("b_y0") - F.col("y1") - F.col("vy1") * F.col("dt"))
    limit = tolerance * scale + SPREAD_SHARE * speed * F.col("dt")
    away = F.least(meant, stayed)
    other = F.hypot("b_vx0", "b_vy0")
    cosine = F.when((speed > MOVING) & (other > MOVING), (F.col("vx1") * F.col("b_vx0") + F.col("vy1") * F.col("b_vy0")) / (speed * other)).otherwise(0.0)
    # Spark may test this before the steps are matched in time, where a limit can be 0
    short = F.when((away <= limit) & (cosine >= LEAST_COSINE), F.try_divide(away, limit) + TIME_WEIGHT * F.col("dt") / F.col("g") - WAY_WEIGHT * cosine)
    again = F.when(stayed <= STANDING_NEAR * scale, one + stayed / (STANDING_NEAR * scale) + F.try_divide("dt", "long_g"))
    costed = both.withColumn("cost", F.when(F.col("late"), again).otherwise(short)).where("cost IS NOT NULL")
    return costed.select("job_id", F.col("track_id").alias("a"), "b", "cost")


def joined_fragments(candidates: DataFrame) -> DataFrame:
    """(job_id, a, b): as many joins as there can be, each piece once as a and once as b, and of those the ones of least cost."""
    one = F.lit(1).cast("long")
    return joined_kinds(candidates.withColumn("na", one).withColumn("nb", one)).select("job_id", "a", "b")


def joined_kinds(candidates: DataFrame) -> DataFrame:
    """(job_id, a, b, n): n pieces of kind a go on with n of kind b. candidates: job_id, a, b, cost, na, nb (pieces of either kind).

    As many pieces as can be are joined, and of those ways the one of least cost is taken. Kinds that are each other's only
    candidates need no search. The others are solved in connected parts, which Spark finds first: a part where every a finds
    room at its cheapest b is solved by that, any other by shortest augmenting paths; no video is one group."""
    rows = candidates.select(*[F.col(c).cast("long").alias(c) for c in ("job_id", "a", "b")], F.col("cost").cast("double").alias("cost"), *[F.col(c).cast("long").alias(c) for c in ("na", "nb")])
    by = lambda c: Window.partitionBy("job_id", c)
    rows = kept_table(rows.withColumn("alone", (F.count("*").over(by("a")) == 1) & (F.count("*").over(by("b")) == 1)), "candidates")
    sole = rows.where("alone").select("job_id", "a", "b", F.least("na", "nb").alias("n"))
    rows = rows.where("NOT alone").drop("alone")
    end, start = F.struct("job_id", F.lit(0).alias("side"), F.col("a").alias("track")), F.struct("job_id", F.lit(1).alias("side"), F.col("b").alias("track"))
    parts = graphs.components(rows.select(end.alias("a"), start.alias("b")))
    own = parts.where("node.side = 0").select(F.col("node.job_id").alias("job_id"), F.col("node.track").alias("a"), F.col("part.side").alias("side"), F.col("part.track").alias("track"))
    part = ["job_id", "side", "track"]
    first = F.row_number().over(by("a").orderBy("cost", "b")) == 1
    placed = rows.join(own, ["job_id", "a"]).withColumn("first", first)
    placed = placed.withColumn("asked", F.sum(F.when(F.col("first"), F.col("na")).otherwise(0)).over(by("b")))
    placed = kept_table(placed.withColumn("full", F.max(F.col("asked") > F.col("nb")).over(Window.partitionBy(*part))), "parts")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        found = shared_out(group["a"].tolist(), group["b"].tolist(), group["cost"].tolist(), group["na"].tolist(), group["nb"].tolist())
        return pd.DataFrame([(group["job_id"].iloc[0], *x) for x in found], columns=["job_id", "a", "b", "n"])

    hard = placed.where("full").select(*part, "a", "b", "cost", "na", "nb")
    solved = dealt(hard, *part, rows=20_000).groupBy(*part).applyInPandas(solve, "job_id long, a long, b long, n long")
    return sole.unionByName(placed.where("NOT full AND first").select("job_id", "a", "b", F.col("na").alias("n"))).unionByName(solved)


def joined_ends(ends: DataFrame, fps: Column | float, gap: float = GAP_SECONDS, tolerance: float = TOLERANCE, standing_gap: float | None = None) -> DataFrame:
    """(job_id, a, b): ``joined_fragments`` of the ``fragment_candidates`` of these ends, without a row for each pair of equal pieces.

    Pieces of one video whose ends are equal in all that a candidate is judged by are of one kind, as are those whose starts are. Kinds are
    joined, and the pieces of two kinds go together in order of their tracks."""
    pace = fps if isinstance(fps, Column) else F.lit(float(fps))

    def kinds(rows: DataFrame, side: str) -> DataFrame:
        own = Window.partitionBy("job_id", "pace", *[f"{c}{side}" for c in ("f", "x", "y", "a", "h", "vx", "vy")])
        order = own.orderBy("track_id")
        return kept_table(rows.withColumns({"kind": F.first("track_id").over(order), "k": F.row_number().over(order), "many": F.count("*").over(own)}), "kinds")

    rows = ends.withColumn("pace", pace)
    lost, born = kinds(rows.where("destination IS NULL AND n >= 2"), "1"), kinds(rows, "0")
    pairs = fragment_candidates(lost.where("k = 1"), F.col("pace"), gap, tolerance, standing_gap, born.where("k = 1"))
    sizes = lambda of, c: of.where("k = 1").select("job_id", F.col("kind").alias(c), F.col("many").alias(f"n{c}"))
    joins = joined_kinds(pairs.join(sizes(lost, "a"), ["job_id", "a"]).join(sizes(born, "b"), ["job_id", "b"]))
    joins = kept_table(joins, "joins")
    so_far = lambda c, other: F.sum("n").over(Window.partitionBy("job_id", c).orderBy(other).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    joins = joins.withColumns({"past_a": so_far("a", "b"), "past_b": so_far("b", "a")}).withColumnsRenamed({"a": "kind_a", "b": "kind_b"})
    members = lambda of, c: of.select("job_id", F.col("kind").alias(f"kind_{c}"), F.col("track_id").alias(c), "k")
    left = members(lost, "a").join(joins, ["job_id", "kind_a"]).where("k > past_a AND k <= past_a + n")
    left = left.withColumn("k", F.col("k") - F.col("past_a") + F.col("past_b")).select("job_id", "kind_b", "k", "a")
    return left.join(members(born, "b").withColumn("k", F.col("k").cast("long")), ["job_id", "kind_b", "k"]).select("job_id", "a", "b")


def piece_chains(joins: DataFrame) -> DataFrame:
    """(job_id, track_id, chain, place) of all pieces that were joined: chain is the first piece's track."""
    node = lambda c: F.struct("job_id", F.col(c).alias("track"))
    found = graphs.chains(joins.select(node("a").alias("a"), node("b").alias("b")))
    return found.select(F.col("node.job_id").alias("job_id"), F.col("node.track").alias("track_id"), F.col("head.track").alias("chain"), F.col("place").cast("int"))


def chains_of_points(points: DataFrame, fps: Column | float, moved: float = ACCESS_MOVED, gap: float = GAP_SECONDS, tolerance: float = TOLERANCE, standing_gap: float | None = None) -> DataFrame:
    """(job_id, track_id, chain, place) of the pieces that go together, from points: job_id, track_id, frame, gx, gy, y1, y2, x1, x2, access.

    Pieces that never get ``moved`` box heights away from their start are left out before they are joined. A piece without a row here is a path of its own."""
    own = points.select("job_id", "track_id", "frame", "gx", "gy", (F.col("y2") - F.col("y1")).alias("h"), "access")
    ends = kept_table(moving_ends(own, moved), "ends")
    return piece_chains(joined_ends(ends, fps, gap, tolerance, standing_gap))
