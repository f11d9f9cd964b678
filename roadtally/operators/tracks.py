"""Order-dependent jobs on tracks, as windows, joins and folds of short stretches; templates compare at most 150 paths of a movement in NumPy."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.operators import shapes
from roadtally.operators.assign import FORBIDDEN, assign
from roadtally.operators.graphs import components
from roadtally.sources.sinks import dealt, kept_table

# Limits under which the counts were compared with hand counts.
REMEASURED_SECONDS, REMEASURED_SHARE = 1, 0.12
REPEAT_FRAMES, REPEAT_PIXELS, REPEAT_SHARE = 5, 6.0, 0.2
TWIN_SHARED, TWIN_HELD = 0.5, 0.65
TWIN_FRAMES = 240  # frames whose boxes are compared together; results do not depend on it
LEAST_IOU, CONFIRM_HITS, MOST_MISSES = 0.3, 3, 30
TEMPLATE_POINTS, TEMPLATE_LEAST, TEMPLATE_KEPT, TEMPLATE_EXAMPLES, TEMPLATE_APART, TEMPLATE_DROP = 32, 3, 150, 12, 0.25, 0.10


def drop_repeated_crossings(crossings: DataFrame) -> DataFrame:
    """Crossings without those that repeat an accepted one: same line, at most 5 frames later, its ground point
    within max(6 px, 0.2 height) in x and y (the height of either box).

    A crossing over 5 frames after the one before it depends on none, so a line's crossings fall apart into short stretches; each is
    folded in order of (frame, track_id) inside an array. Crossings of a null frame are kept, and one of a null place or height repeats nothing."""
    line = Window.partitionBy("job_id", "lane_id").orderBy("frame", "track_id")
    begins = F.coalesce(F.col("frame") - F.lag("frame").over(line) > REPEAT_FRAMES, F.lit(True))
    rows = crossings.withColumn("begins", begins.cast("int")).withColumn("stretch", F.sum("begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("frame", "track_id", *[c for c in crossings.columns if c not in ("frame", "track_id")])
    stretches = rows.groupBy("job_id", "lane_id", "stretch").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def repeats(r, t):
        limit = F.greatest(F.lit(REPEAT_PIXELS), REPEAT_SHARE * F.greatest(r["height"], t["height"]))
        near = (r["frame"] - t["frame"] <= REPEAT_FRAMES) & (F.abs(r["gx"] - t["gx"]) <= limit) & (F.abs(r["gy"] - t["gy"]) <= limit)
        return F.coalesce(near & r["height"].isNotNull() & t["height"].isNotNull(), F.lit(False))

    fold = F.aggregate("rows", F.slice("rows", 1, 0), lambda kept, r: F.when(F.exists(kept, lambda t: repeats(r, t)), kept).otherwise(F.concat(kept, F.array(r))))
    return stretches.select(F.explode(fold).alias("r")).select([F.col(f"r.{c}") for c in crossings.columns])


def monotonic_clock(instants: DataFrame) -> DataFrame:
    """(job_id, frame, at): an instant that doesn't advance becomes the one before plus a frame's time.

    No instant can be later than the latest of (s less the frame times up to it) plus all frame times so far, so a row whose s is beyond
    that surely stands as it is. Between such rows, which a clock that runs has everywhere, a short stretch is folded inside an array. A null s
    doesn't advance; what comes before the first s, or after a null rate until the next s, is null."""
    order = Window.partitionBy("job_id").orderBy("frame")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = instants.select("job_id", "frame", F.col("s").cast("double").alias("s"), (1 / F.col("fps")).alias("step"))
    rows = rows.withColumn("steps", F.sum(F.coalesce("step", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.max(F.col("s") - F.col("steps")).over(past) + F.lag("steps").over(order)
    rows = rows.withColumn("most", most).withColumn("stands", (F.col("most").isNull() | F.coalesce(F.col("s") > F.col("most") + 1e-6, F.lit(False))).cast("int"))
    rows = rows.withColumn("stretch", F.sum("stands").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy("job_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("frame", "s", "step"))).alias("rows"))

    def next_instant(done, r):
        last = F.get(done, F.size(done) - 1)["at"]
        at = F.when(last.isNull() | (r["s"] > last), r["s"]).otherwise(last + r["step"])
        return F.concat(done, F.array(F.struct(r["frame"].alias("frame"), at.alias("at"))))

    none = F.transform(F.slice("rows", 1, 0), lambda r: F.struct(r["frame"].alias("frame"), r["s"].alias("at")))
    return stretches.select("job_id", F.explode(F.aggregate("rows", none, next_instant)).alias("r")).select("job_id", "r.frame", "r.at")


def origins_destinations(points: DataFrame, short: int = 15, deal: bool = True) -> DataFrame:
    """(job_id, track_id, origin, destination) from points (frame, access; null: the centre).

    Points are put together as runs of one access; a stay in the centre of under ``short`` frames between runs of one access is left
    out and joins them. The origin is the first access; the destination the last one reached after leaving it. A track that starts in
    the centre and has one run only, at its end, has no origin. Windows are of single tracks; points are dealt by track (unless
    ``deal`` is false: they are already) over partitions whose number grows with them."""
    own = Window.partitionBy("job_id", "track_id")
    begins = lambda order: F.coalesce(~F.col("access").eqNullSafe(F.lag("access").over(order)), F.lit(True)) | (F.row_number().over(order) == 1)
    by_frame = own.orderBy("frame")
    rows = points.select("job_id", "track_id", "frame", F.col("access").cast("long").alias("access"))
    rows = dealt(rows, "job_id", "track_id") if deal else rows
    marked = rows.withColumn("new", begins(by_frame).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(by_frame)).groupBy("job_id", "track_id", "run", "access").agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    by_run = own.orderBy("run")
    back = F.col("access").isNull() & (F.lag("access").over(by_run) == F.lead("access").over(by_run)) & (F.col("high") - F.col("low") < short)
    stays = runs.withColumn("back", F.coalesce(back, F.lit(False))).where("NOT back")
    stays = stays.withColumn("new", begins(by_run)).where("new")
    at = F.struct("run", "access")
    sums = stays.groupBy("job_id", "track_id").agg(F.count("access").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.min(F.when(F.col("access").isNotNull(), at)).alias("one"), F.max(F.when(F.col("access").isNotNull(), at)).alias("other"))
    late = (F.col("n") == 1) & F.col("first.access").isNull() & F.col("last.access").isNotNull()
    several = F.col("n") > 1
    return sums.select("job_id", "track_id", F.when(~late, F.col("one.access")).alias("origin"), F.when(late | several, F.col("other.access")).alias("destination"))


def movement_templates(paths: DataFrame) -> DataFrame:
    """(project_id, origen_id, destino_id, n, seconds, ending, example, medoid, points): typical paths of each movement with three whole ones.

    n, the median duration and the share of paths whose last point lies in the destination are of all paths. The first 150 by
    id, ranked by Spark, are resampled and compared: the mean distance of two paths, each pair of points in its own mean height. Paths
    whose mean distance to all is over the 90th percentile are left out; the medoid is the first example, others are picked
    farthest first while they stand .25 heights apart. Null and empty paths, those of one point and of no length are left out.
    paths: project_id, origen_id, destino_id, id, xs, ys, hs (or one height), seconds, inside."""
    key = ["project_id", "origen_id", "destino_id"]
    whole = shapes.with_heights(paths)
    whole = whole.where(shapes.has_length(F.col("xs"), F.col("ys")) & (F.size("hs") == F.size("xs")))
    sums = whole.groupBy(*key).agg(F.count("*").alias("n"), F.percentile("seconds", 0.5).alias("seconds"), F.avg(F.col("inside").cast("double")).alias("ending")).where(F.col("n") >= TEMPLATE_LEAST)
    kept = whole.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("k") <= TEMPLATE_KEPT)
    kept = kept.withColumn("p", shapes.resampled(F.col("xs"), F.col("ys"), F.col("hs"), TEMPLATE_POINTS))
    kept = kept.select(*[F.col(c).cast("long").alias(c) for c in (*key, "id")], "p.x", "p.y", "p.h")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("id")
        x, y, h = (np.stack(own[c]) for c in ("x", "y", "h"))
        gaps = np.zeros((len(own), len(own)))
        for place in range(x.shape[1]):
            scale = np.maximum(np.add.outer(h[:, place], h[:, place]) / 2, 1.0)
            gaps += np.hypot(np.subtract.outer(x[:, place], x[:, place]), np.subtract.outer(y[:, place], y[:, place])) / scale
        gaps /= x.shape[1]
        usual = gaps.mean(axis=1)
        keep = np.nonzero(usual <= np.quantile(usual, 1 - TEMPLATE_DROP))[0]
        chosen = [int(usual.argmin())]
        while len(chosen) < min(TEMPLATE_EXAMPLES, len(keep)):
            apart = gaps[np.ix_(keep, chosen)].min(axis=1)
            if apart.max() < TEMPLATE_APART:
                break
            chosen.append(int(keep[apart.argmax()]))
        first, ids = own.iloc[0], own["id"].to_numpy()
        lines = np.stack([x, y], axis=2).reshape(len(own), -1)
        rows = [(*(first[c] for c in key), int(ids[c]), c == chosen[0], lines[c].tolist()) for c in chosen]
        return pd.DataFrame(rows, columns=[*key, "example", "medoid", "points"])

    examples = kept.join(sums.select(*key), key).groupBy(*key).applyInPandas(run, "project_id long, origen_id long, destino_id long, example long, medoid boolean, points array<double>")
    return sums.join(examples, key)


def twin_pairs(points: DataFrame) -> DataFrame:
    """(job_id, a, b, na, nb): tracks that share half the frames of the shorter one with a median containment of .65 or more, and their lengths.

    Points are dealt by track and put together by track and stretch of TWIN_FRAMES frames; a stretch of a video then compares its tracks in arrays. A
    pair whose tracks lie in one stretch is judged there; only of tracks that reach over several are the containments sent on."""
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    own = points.where("job_id IS NOT NULL AND track_id IS NOT NULL").select("job_id", *long("track_id", "frame"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    own = dealt(own, "job_id", "track_id").withColumn("stretch", F.floor(F.col("frame") / TWIN_FRAMES))
    parts = own.groupBy("job_id", "track_id", "stretch").agg(F.collect_list(F.struct("frame", "x1", "y1", "x2", "y2")).alias("boxes"), F.count("*").alias("n"))
    track = Window.partitionBy("job_id", "track_id")
    parts = parts.withColumns({"n": F.sum("n").over(track), "whole": F.count("stretch").over(track) == 1}).where("stretch IS NOT NULL")

    def judged(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        lists = rows.column("boxes").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        frame, *box = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("frame", "x1", "y1", "x2", "y2"))
        track, n, whole = (rows.column(c).to_numpy() for c in ("track_id", "n", "whole"))
        a, b, held = _held_pairs(group[row], frame, track[row], row, box)
        pair = a * rows.num_rows + b
        order = np.argsort(pair, kind="stable")
        pair, held = pair[order], held[order]
        start = np.nonzero(np.r_[True, pair[1:] != pair[:-1]])[0] if len(pair) else pair
        shared = np.diff(np.r_[start, len(pair)])
        known, much = (np.add.reduceat(v.astype(np.int64), start) if len(pair) else shared for v in (~np.isnan(held), held >= TWIN_HELD))
        first, second = np.divmod(pair[start], rows.num_rows)
        # of tracks in one stretch only pairs whose upper middle one is enough can be twins; what is sorted is theirs alone
        open_ = ~(whole[first] & whole[second]) | (2 * much >= known)
        some = np.repeat(open_, shared)
        held, start, shared, known, first, second = held[some], (np.cumsum(shared * open_) - shared)[open_], shared[open_], known[open_], first[open_], second[open_]
        held = held[np.lexsort((held, np.repeat(np.arange(len(start)), shared)))]  # null ones last
        low, high = held[start + np.maximum(known - 1, 0) // 2], held[start + np.minimum(known // 2, np.maximum(known - 1, 0))]
        median = np.where(low == high, low, 0.5 * low + 0.5 * high)
        closed = whole[first] & whole[second]
        twin = closed & (known > 0) & (shared >= TWIN_SHARED * np.minimum(n[first], n[second])) & (median >= TWIN_HELD)
        out = np.nonzero(twin | ~closed)[0]
        helds = [None if closed[i] else held[start[i] : start[i] + known[i]] for i in out]
        columns = [rows.column("job_id").combine_chunks().take(pa.array(first[out])), *[pa.array(v) for v in (track[first[out]], track[second[out]], n[first[out]], n[second[out]], shared[out])], pa.array(helds, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["job_id", "a", "b", "na", "nb", "shared", "helds"])

    def compare(batches):
        rest = None  # of the last stretch, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            job, stretch = rows.column("job_id").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("stretch").to_numpy()
            group = np.cumsum(np.r_[0, (job[1:] != job[:-1]) | (stretch[1:] != stretch[:-1])]) if len(job) else job
            last = int(np.searchsorted(group, group[-1])) if len(job) else 0
            if last:
                yield judged(rows.slice(0, last), group[:last])
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield judged(rest, np.zeros(rest.num_rows, np.int64))

    kind = points.schema["job_id"].dataType.simpleString()
    sorted_ = dealt(kept_table(parts, "parts"), "job_id", "stretch").sortWithinPartitions("job_id", "stretch")
    found = sorted_.mapInArrow(compare, f"job_id {kind}, a long, b long, na long, nb long, shared long, helds array<double>")
    found = kept_table(found, "twins")
    key = ["job_id", "a", "b", "na", "nb"]
    over = found.where("helds IS NOT NULL").groupBy(*key).agg(F.sum("shared").alias("shared"), F.sort_array(F.flatten(F.collect_list("helds"))).alias("v"))
    m = F.size("v")
    low, high = F.get("v", F.floor((m - 1) / 2).cast("int")), F.get("v", F.floor(m / 2).cast("int"))
    held = F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)
    over = over.where((F.col("shared") >= TWIN_SHARED * F.least("na", "nb")) & (m > 0)).where(held >= TWIN_HELD)
    return found.where("helds IS NULL").select(*key).unionByName(over.select(*key))


def _held_pairs(group: np.ndarray, frame: np.ndarray, track: np.ndarray, row: np.ndarray, box: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, containment) of all boxes of two tracks in one frame of a group, a the lesser track. What is null is NaN, and greatest and least pass it over as Spark's do."""
    order = np.lexsort((track, frame, group))
    group, frame, track, row = group[order], frame[order], track[order], row[order]
    x1, y1, x2, y2 = (c[order] for c in box)
    area = (x2 - x1) * (y2 - y1)
    found, step = [], 1
    while step < len(frame):
        i = np.nonzero((frame[step:] == frame[:-step]) & (group[step:] == group[:-step]))[0]
        if not len(i):
            break
        i = i[track[i] != track[i + step]]
        j = i + step
        inter = np.fmax(0.0, np.fmin(x2[i], x2[j]) - np.fmax(x1[i], x1[j])) * np.fmax(0.0, np.fmin(y2[i], y2[j]) - np.fmax(y1[i], y1[j]))
        least = np.fmin(area[i], area[j])
        found.append((row[i], row[j], np.divide(inter, least, out=np.full(len(i), np.nan), where=least != 0)))
        step += 1
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fused_twins(points: DataFrame) -> DataFrame:
    """points of a video with each group of twins fused: the longest track stays (ties: the least id), and takes the
    frames that it lacks from the next longest that has them. Tracks without a twin stay as they are."""
    pairs = kept_table(twin_pairs(points), "pairs")
    length = pairs.select("job_id", F.col("a").alias("track_id"), F.col("na").alias("frames")).union(pairs.select("job_id", "b", "nb")).distinct()
    sized = kept_table(twin_groups(pairs).join(length, ["job_id", "track_id"]), "groups")
    best = sized.groupBy("job_id", "head").agg(F.min_by("track_id", F.struct(-F.col("frames"), "track_id")).alias("longest"))
    placed = points.join(sized.join(best, ["job_id", "head"]).select("job_id", "track_id", "longest", "frames"), ["job_id", "track_id"], "left")
    placed = placed.withColumn("kept", F.coalesce("longest", "track_id"))
    first = Window.partitionBy("job_id", "kept", "frame").orderBy(F.desc("frames"), "track_id")
    out = placed.withColumn("place", F.row_number().over(first)).where("place = 1")
    return out.withColumn("track_id", F.col("kept")).drop("longest", "frames", "kept", "place")


def twin_groups(pairs: DataFrame) -> DataFrame:
    """(job_id, track_id, head): connected twins of a video under their least id, for all videos in the same joins."""
    node = lambda c: F.struct("job_id", F.col(c).alias("track_id"))
    parts = components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    return parts.select("node.job_id", "node.track_id", F.col("part.track_id").alias("head"))


class BoxTracker:
    """Constant-velocity Kalman filters on box centres and sizes, joined to detections by overlap."""

    def __init__(self, q: float = 0.01, r: float = 1.0, p: float = 10.0):
        self.q, self.r, self.p = q, r, p
        self.step = np.eye(8) + np.diag(np.ones(4), 4)
        self.see = np.eye(4, 8)
        self.tracks: list[dict] = []
        self.next_id = 1

    @staticmethod
    def measure(box):
        x1, y1, x2, y2 = box
        return np.array([(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1], float)

    @staticmethod
    def box(state):
        x, y, w, h = state[:4]
        return np.array([x - w / 2, y - h / 2, x + w / 2, y + h / 2])

    def advance(self, boxes: np.ndarray) -> list[int]:
        """Track id of each box of the next frame; 0 where its track isn't confirmed yet."""
        for t in self.tracks:
            t["m"] = self.step @ t["m"]
            t["c"] = self.step @ t["c"] @ self.step.T + self.q * np.eye(8)
        pairs = []
        if self.tracks and len(boxes):
            own = np.stack([self.box(t["m"]) for t in self.tracks])
            overlap = _ious(own, boxes)
            pairs = assign(np.where(overlap >= LEAST_IOU, 1 - overlap, FORBIDDEN))
        out, seen = [0] * len(boxes), set()
        for i, j in pairs:
            t = self.tracks[i]
            gain = t["c"] @ self.see.T @ np.linalg.inv(self.see @ t["c"] @ self.see.T + self.r * np.eye(4))
            t["m"] = t["m"] + gain @ (self.measure(boxes[j]) - self.see @ t["m"])
            t["c"] = (np.eye(8) - gain @ self.see) @ t["c"]
            t["hits"], t["misses"] = t["hits"] + 1, 0
            seen.add(j)
            out[j] = t["id"] if t["hits"] >= CONFIRM_HITS else 0
        matched = {i for i, _ in pairs}
        for i, t in enumerate(self.tracks):
            t["misses"] += i not in matched
        self.tracks = [t for t in self.tracks if t["misses"] <= MOST_MISSES]
        for j in range(len(boxes)):
            if j not in seen:
                self.tracks.append({"id": self.next_id, "m": np.r_[self.measure(boxes[j]), np.zeros(4)], "c": self.p * np.eye(8), "hits": 1, "misses": 0})
                self.next_id += 1
        return out


def _ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.maximum(0, high - low), axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return inter / np.maximum(1e-9, area(a)[:, None] + area(b)[None] - inter)


def track_boxes(detections: DataFrame) -> DataFrame:
    """(job_id, frame, track_id, x1, y1, x2, y2, class_name) of confirmed tracks, from detections by frame."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tracker, parts, last = BoxTracker(), [], None
        for frame, own in group.sort_values(["frame", "x1", "y1"]).groupby("frame"):
            for _ in range(int(min(frame - last - 1, MOST_MISSES + 1)) if last is not None else 0):
                tracker.advance(np.zeros((0, 4)))
            last = frame
            ids = tracker.advance(own[["x1", "y1", "x2", "y2"]].to_numpy(float))
            parts.append(own.assign(track_id=ids))
        out = pd.concat(parts)
        return out[out["track_id"] > 0][["job_id", "frame", "track_id", "x1", "y1", "x2", "y2", "class_name"]]

    return detections.groupBy("job_id").applyInPandas(run, "job_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, class_name string")


def greedy_pairs(candidates: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """One-to-one pairs of each group, best first by ``order``; a row or partner is used once."""
    schema = candidates.schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        group = group.sort_values([*order, left, right])
        for a, b in zip(group[left], group[right]):
            free = a not in used_l and b not in used_r
            keep.append(free)
            if free:
                used_l.add(a)
                used_r.add(b)
        return group[keep]

    return candidates.groupBy(*keys).applyInPandas(run, schema)


class _Free:
    """Rows in order of height, then id, of which some are taken: the free one of nearest height is found without passing the taken ones again."""

    def __init__(self, heights: list, places: list):
        self.heights, self.places = heights, places
        self.up, self.down = list(range(len(heights) + 1)), list(range(len(heights) + 1))  # the next free one from here on; one behind the last free one before

    @staticmethod
    def _find(to: list, i: int) -> int:
        end = i
        while to[end] != end:
            end = to[end]
        while to[i] != end:
            to[i], i = end, to[i]
        return end

    def take(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i

    def nearest(self, height: float) -> list[int]:
        """At most two rows: the first free one at this height or over it, and of the nearest free height under it the first."""
        i = bisect_left(self.heights, height)
        after, before, out = self._find(self.up, i), self._find(self.down, i) - 1, []
        if after < len(self.heights):
            out.append(after)
        if before >= 0:
            out.append(self._find(self.up, bisect_left(self.heights, self.heights[before])))
        return out


def _in_turn(stored: dict[str, list], measured: dict[str, list]) -> list[tuple[int, int]]:
    """(id, measured_id) of one line of a video: each stored crossing in order of id takes the free measured one of nearest height that ``remeasured_pairs`` allows it (ties: the least id)."""
    of = {c: measured[c] for c in ("measured_id", "m_s", "m_height")}
    order = sorted(range(len(of["m_s"])), key=lambda i: (-math.inf if of["m_height"][i] is None else of["m_height"][i], of["measured_id"][i]))
    groups, at, out = {None: []}, {}, []
    for i in order:
        groups[None].append(i)
        groups.setdefault(("s", of["m_s"][i]), []).append(i)
        at.setdefault(of["measured_id"][i], []).append(i)
    bare = [-math.inf if h is None else h for h in of["m_height"]]
    free = {k: _Free([bare[i] for i in rows], rows) for k, rows in groups.items()}
    place = {k: {i: n for n, i in enumerate(rows)} for k, rows in groups.items()}
    rows = sorted(range(len(stored["id"])), key=lambda i: stored["id"][i])
    for _, own in groupby(rows, key=lambda i: stored["id"][i]):
        best = None
        for r in own:
            s, height = stored["s"][r], stored["height"][r] or 0.0
            for k in [None] if s is None else [("s", s + d) for d in range(-REMEASURED_SECONDS, REMEASURED_SECONDS + 1)]:
                for i in [free[k].places[n] for goal in ([height] if height else [-math.inf, 0.0]) for n in free[k].nearest(goal)] if k in free else []:
                    if not height or (of["m_height"][i] is not None and abs(of["m_height"][i] - height) <= REMEASURED_SHARE * height):
                        gap = -math.inf if of["m_height"][i] is None else abs(of["m_height"][i] - height)
                        best = min(best or (math.inf, math.inf, 0), (gap, of["measured_id"][i], stored["id"][r]))
        if best:
            out.append((best[2], best[1]))
            for i in at[best[1]]:
                for k in (None, ("s", of["m_s"][i])):
                    free[k].take(place[k][i])
    return out


def remeasured_pairs(stored: DataFrame, measured: DataFrame) -> DataFrame:
    """(job_id, lane_id, id, measured_id): which of the crossings measured again belongs to each stored one, if any.

    Both: job_id, lane_id, id, track_id, s (seconds), height. Two are the same crossing if their whole seconds are at most one apart (a
    stored one without a time fits any) and the measured height is within 12 % of the stored one's (without a height: any). First by track: of several
    measured with one track the last, of several stored the first. Then, in order of the stored ids, each takes the free one of nearest height (ties: the least id).
    That order is by nature one after the other, as a row without a time may take any of its line; so what no track has paired of one line of one video (it lasts
    minutes) is walked in one call. Its memory and time grow with those rows, not with their pairs."""
    key = ["job_id", "lane_id"]
    other = measured.select(*key, F.col("id").alias("measured_id"), F.col("track_id").alias("m_track"), F.floor("s").alias("m_s"), F.col("height").alias("m_height"))
    same = (F.col("s").isNull() | (F.abs(F.col("m_s") - F.floor("s")) <= REMEASURED_SECONDS)) & (F.coalesce("height", F.lit(0)).eqNullSafe(0) | (F.abs(F.col("m_height") - F.col("height")) <= REMEASURED_SHARE * F.col("height")))
    last = other.groupBy(*key, "m_track").agg(F.max("measured_id").alias("measured_id"))
    by_track = stored.join(other.join(last, [*key, "m_track", "measured_id"]).withColumn("track_id", F.col("m_track")), [*key, "track_id"]).where(same)
    first = kept_table(by_track.groupBy(*key, "measured_id").agg(F.min("id").alias("id")).select(*key, "id", "measured_id"), "by_track")
    open_ = stored.join(first.select(*key, "id"), [*key, "id"], "left_anti")
    free = other.join(first.select(*key, "measured_id"), [*key, "measured_id"], "left_anti")
    open_ = open_.dropna(subset=[*key, "id"]).select(*[F.col(c).cast("long").alias(c) for c in (*key, "id")], F.floor("s").alias("s"), F.col("height").cast("double").alias("height"))
    free = free.dropna(subset=[*key, "measured_id"]).select(*[F.col(c).cast("long").alias(c) for c in (*key, "measured_id", "m_s")], F.col("m_height").cast("double").alias("m_height"))

    def solve(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        pairs = _in_turn(mine.to_pydict(), theirs.to_pydict()) if mine.num_rows and theirs.num_rows else []
        ends = [mine.column(c)[0].as_py() if pairs else None for c in key]
        columns = [*[[e] * len(pairs) for e in ends], *[[p[i] for p in pairs] for i in (0, 1)]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*key, "id", "measured_id"])

    rest = open_.groupBy(*key).cogroup(free.groupBy(*key)).applyInArrow(solve, "job_id long, lane_id long, id long, measured_id long")
    return first.unionByName(rest)


def class_by_vote(points: DataFrame, by: str = "confidence") -> DataFrame:
    """(job_id, track_id, class_name): the class with the greatest sum of confidence, or most frames; ties by name."""
    weight = F.sum("confidence") if by == "confidence" else F.count("*").cast("double")
    votes = points.groupBy("job_id", "track_id", "class_name").agg(F.round(weight, 9).alias("w"))
    return votes.groupBy("job_id", "track_id").agg(F.min_by("class_name", F.struct(-F.col("w"), "class_name")).alias("class_name"))
