"""Nearest neighbours by collision counting on single projections.

Vectors are dealt into blocks of bounded size. A block projects its vectors on a fixed set of random directions
and keeps each projection as one sorted array. A query opens a window around its own projection in every array; virtual
rehashing widens all windows by a factor, and only what the wider window adds is counted. A vector that
lies in the windows of THRESHOLD arrays or more is verified: its inner product with the query is computed in double precision.

A search ends by a rule that doesn't depend on the data: at half-width t a vector at distance s lies in a window with
probability 2 Phi(t / s) - 1, so REACH is the ratio t / s at which it reaches the threshold with
probability SURE. When the windows are REACH times as wide as the distance of the k-th best vector found, every
nearer vector was verified with at least that probability. Nothing caps candidates; windows may grow over the whole block.

The largest inner product is the least distance once each vector gets one more component, sqrt(M^2 - |x|^2) with M the
block's largest norm, and queries get zero. Blocks hold vectors of one length whose norms differ by less than a factor of two,
so M fits all of them. A query first widens its windows in its own block; its k-th score there is a floor, and in
every other block the windows take at once the width that finds what reaches the floor. Each query meets every block once, in groups of
bounded size; a block returns its k best, and Spark keeps the k best of all blocks.

Defined results: null and zero vectors and those with null or non-finite components take no part; vectors are compared with those of
their own length only; a row whose id is null is no query, but a candidate (after others of its score); of rows that repeat an id each is
a query and a candidate of the others; equal scores go to the smaller id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.llm.common import written

PROJECTIONS, SHARE, SURE = 48, 0.85, 0.98
#: Vectors of a block, queries of a group, queries that are counted side by side, growth of the windows.
BLOCK, GROUP, SIDE, WIDEN = 8192, 1024, 32, 1.4
SEED = 20


def threshold(projections: int = PROJECTIONS, share: float = SHARE) -> int:
    return int(np.ceil(share * projections))


def reach(projections: int = PROJECTIONS, least: int | None = None, sure: float = SURE) -> float:
    """Half-width over distance at which a vector collides in `least` projections or more with probability `sure`."""
    least = threshold(projections) if least is None else least
    log = np.concatenate([[0], np.cumsum(np.log(np.arange(1, projections + 1)))])
    k = np.arange(least, projections + 1)
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        p = min(2 * NormalDist().cdf(mid) - 1, 1 - 1e-12)
        p = max(p, 1e-300)
        tail = np.exp(log[projections] - log[k] - log[projections - k] + k * np.log(p) + (projections - k) * np.log1p(-p)).sum()
        low, high = (low, mid) if tail >= sure else (mid, high)
    return high


class Block:
    """Sorted projections of the vectors of a block."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors = vectors
        square = (vectors**2).sum(1)
        self.square = float(square.max())
        lifted = np.sqrt(np.maximum(self.square - square, 0.0))
        self.directions = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1] + 1, projections))
        places = (vectors @ self.directions[:-1] + lifted[:, None] * self.directions[-1]).T
        self.order = np.argsort(places, 1, kind="stable")
        self.sorted = np.take_along_axis(places, self.order, 1)

    def at_once(self, queries: np.ndarray, least: int, far: float, floors: np.ndarray):
        """For each query the places and scores of vectors that reach its floor, from windows that are wide enough for it at once.

        Windows that hold most of an array are counted by what they leave out."""
        n, arrays = len(self.vectors), len(self.order)
        middle, size = queries @ self.directions[:-1], (queries**2).sum(1)
        half = far * np.sqrt(np.maximum(size + self.square - 2 * floors, 0.0))
        edges = np.stack([np.searchsorted(self.sorted[i], np.stack([middle[:, i] - half, middle[:, i] + half])) for i in range(arrays)])
        for q in range(len(queries)):
            low, high = edges[:, 0, q].tolist(), edges[:, 1, q].tolist()
            if 2 * (sum(high) - sum(low)) > n * arrays:
                outside = np.concatenate([x for line, a, b in zip(self.order, low, high) for x in (line[:a], line[b:])])
                over = np.flatnonzero(np.bincount(outside, minlength=n) <= arrays - least)
            else:
                over = np.flatnonzero(np.bincount(np.concatenate([line[a:b] for line, a, b in zip(self.order, low, high)]), minlength=n) >= least)
            scores = (self.vectors[over] * queries[q]).sum(1)
            good = scores >= floors[q]
            yield over[good], scores[good]

    def search(self, queries: np.ndarray, k: int, least: int, far: float, skip: np.ndarray):
        """For each query the places and scores of the k best vectors found (and of all that tie with the last), from windows that widen until they are wide enough. skip: the query's own place, or -1."""
        n, arrays = len(self.vectors), len(self.order)
        spread = np.abs(self.sorted[:, [n // 4, 3 * n // 4]] - self.sorted[:, [n // 2]])
        first = max(float(np.median(spread)) / 2, 1e-300)
        for side in range(0, len(queries), SIDE):
            some = queries[side : side + SIDE]
            middle, size = some @ self.directions[:-1], (some**2).sum(1)
            count, seen = np.zeros((len(some), n), np.int16), np.zeros((len(some), n), bool)
            own = skip[side : side + SIDE]
            seen[np.flatnonzero(own >= 0), own[own >= 0]] = True
            low = np.stack([np.searchsorted(self.sorted[i], middle[:, i]) for i in range(arrays)])
            high, half, open_ = low.copy(), first, np.arange(len(some))
            at, scores = [np.zeros(0, np.int64)] * len(some), [np.zeros(0)] * len(some)
            while len(open_):
                wider = np.stack([np.searchsorted(self.sorted[i], np.stack([middle[open_, i] - half, middle[open_, i] + half])) for i in range(arrays)])
                to_low, to_high = np.minimum(wider[:, 0], low[:, open_]), np.maximum(wider[:, 1], high[:, open_])
                going = []
                for j, q in enumerate(open_.tolist()):
                    edges = zip(self.order, to_low[:, j].tolist(), low[:, q].tolist(), high[:, q].tolist(), to_high[:, j].tolist())
                    added = np.concatenate([x for line, a, b, c, d in edges for x in (line[a:b], line[c:d])])
                    count[q] += np.bincount(added, minlength=n).astype(np.int16)
                    over = np.flatnonzero((count[q] >= least) & ~seen[q])
                    if len(over):
                        seen[q, over] = True
                        at[q], scores[q] = np.concatenate([at[q], over]), np.concatenate([scores[q], (self.vectors[over] * some[q]).sum(1)])
                        if len(scores[q]) > k:
                            stay = scores[q] >= np.partition(scores[q], len(scores[q]) - k)[len(scores[q]) - k]
                            at[q], scores[q] = at[q][stay], scores[q][stay]
                    whole = not to_low[:, j].any() and (to_high[:, j] == n).all()
                    enough = len(scores[q]) >= k and half >= far * np.sqrt(max(0.0, size[q] + self.square - 2 * scores[q].min()))
                    if not whole and not enough:
                        going.append(q)
                low[:, open_], high[:, open_] = to_low, to_high
                open_ = np.array(going, np.int64)
                half *= WIDEN
            yield from zip(at, scores)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


FOUND_NAMES = ["query_row", "query_id", "vec_id", "score"]
FOUND = "query_row long, query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int, projections: int = PROJECTIONS, share: float = SHARE, sure: float = SURE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query row by inner product."""
    least = threshold(projections, share)
    far = reach(projections, least, sure)
    real = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(real)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("dim", F.size("v")).withColumn("fold", F.floor(F.log2(norm)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "vectors")
    sizes = rows.groupBy("dim", "fold").agg(F.count("*").alias("n"))
    asked = rows.where("asks").groupBy("dim").agg(F.count("*").alias("n_asked"))
    sizes = sizes.join(asked, "dim").select("dim", "fold", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("n_asked") / GROUP).alias("groups"))
    spread = lambda of: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(of))
    dealt = rows.join(sizes, ["dim", "fold"]).withColumn("block", spread("blocks"))

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """Queries of a group in a block: of their own block, or with the floor that they found there."""
        parts = []
        if mine.num_rows and theirs.num_rows:
            own, asks = mine.column("row").to_numpy(), theirs.column("q_row").to_numpy()
            ids, query_ids = mine.column("vec_id").combine_chunks(), theirs.column("q_vec_id").combine_chunks()
            order = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
            block, queries = Block(_matrix(mine.column("v")), projections, seed), _matrix(theirs.column("q_v"))
            floors = theirs.column("q_floor").to_pandas().to_numpy(float)
            by_row = np.argsort(own)
            at = np.minimum(np.searchsorted(own[by_row], asks), len(own) - 1)
            skip = np.where(own[by_row][at] == asks, by_row[at], -1)
            for known, some in ((False, np.flatnonzero(np.isnan(floors))), (True, np.flatnonzero(~np.isnan(floors)))):
                results = block.at_once(queries[some], least, far, floors[some]) if known else block.search(queries[some], k, least, far, skip[some])
                for q, (places, scores) in zip(some.tolist(), results):
                    best = np.lexsort((order[places], -scores))[:k]
                    n = len(best)
                    parts.append(pa.table([pa.array(np.full(n, asks[q])), pa.repeat(query_ids[q], n), ids.take(pa.array(places[best])), pa.array(scores[best])], names=FOUND_NAMES))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=FOUND_NAMES)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        key = ["dim", "fold", "block", "grp"]
        right = right.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "row", "vec_id", "v", "floor")])
        return left.select(*key, "row", "vec_id", "v").groupBy(*key).cogroup(right.groupBy(*[f"q_{c}" for c in key])).applyInArrow(look, FOUND)

    none, zero = F.lit(None).cast("double").alias("floor"), F.lit(0).cast("long")
    # first each query in its own block; its k-th score there is a floor for all other blocks
    near = written(met(dealt.withColumn("grp", zero), dealt.where("asks").withColumn("grp", zero).withColumn("floor", none)), "near")
    floors = near.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("score")).select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("score")).alias("floor"))
    cells = sizes.select("dim", F.col("fold").alias("to_fold"), "groups", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("to_block"))
    asks = dealt.where("asks").select("dim", "fold", "block", "row", "vec_id", "v").join(floors, "row", "left").join(cells, "dim")
    asks = asks.where("fold <> to_fold OR block <> to_block").withColumn("grp", spread("groups")).drop("fold", "block").withColumnsRenamed({"to_fold": "fold", "to_block": "block"})
    copies = dealt.withColumn("grp", F.explode(F.sequence(zero, F.col("groups") - 1)))
    found = near.unionByName(met(copies, asks))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
