"""The live counter: windows over streams of crossings and track points."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadtally.sources import segments

#: A track unseen for so long is forgotten.
FORGET_SECONDS = 3
FORGET_FRAMES, LEAST_POINTS, MOST_GAP = 30, 3, 3


def interval_counts(crossings: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """(start, lane_id, direction, vehicle_type, n) of tumbling intervals; ts is the event time."""
    rows = crossings.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "lane_id", "direction", "vehicle_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "lane_id", "direction", "vehicle_type", "n")


def sliding_hours(crossings: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """(start, lane_id, n) of 60-minute windows that slide by one interval."""
    rows = crossings.withWatermark("ts", late).groupBy(F.window("ts", "60 minutes", f"{minutes} minutes"), "lane_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "lane_id", "n")


def headway_sessions(crossings: DataFrame, wait: float, late: str = "1 minute") -> DataFrame:
    """(lane_id, start, n): crossings less than ``wait`` seconds apart are one session."""
    rows = crossings.withWatermark("ts", late).groupBy(F.session_window("ts", f"{int(wait * 1000)} milliseconds"), "lane_id").agg(F.count("*").alias("n"))
    return rows.select("lane_id", F.col("session_window.start").alias("start"), "n")


def without_repeats(crossings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (job_id, track_id, lane_id) once, however often it is sent."""
    return crossings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "track_id", "lane_id"])


#: Tracks are followed in so many groups; a call of Python follows all tracks of one group in arrays.
GROUPS = 1024
#: Stands for a null job or track inside a group.
NO_KEY = -(1 << 63)
KEYS = ["job_id", "track_id"]


class Turn:
    """The points that a batch brings to a group: ``rows`` by track and frame, ``head`` marks the first one of each track, ``of`` is each
    row's track by number, ``first`` and ``last`` are the tracks' rows, and ``before`` what was known of the tracks."""

    def __init__(self, rows: pd.DataFrame, held: pd.DataFrame, unknown: dict):
        self.rows = rows = rows.iloc[np.lexsort((rows["frame"], rows["track_id"], rows["job_id"]))]
        job, track = (rows[c].to_numpy() for c in KEYS)
        self.head = np.r_[True, (job[1:] != job[:-1]) | (track[1:] != track[:-1])]
        self.first = np.flatnonzero(self.head)
        self.last = np.r_[self.first[1:], len(rows)] - 1
        self.of = np.cumsum(self.head) - 1
        self.keys = rows[KEYS].iloc[self.first].reset_index(drop=True)
        at = pd.MultiIndex.from_frame(held[KEYS]).get_indexer(pd.MultiIndex.from_frame(self.keys)) if len(held) else np.full(len(self.keys), -1)
        self.known = at[at >= 0]
        self.before = {c: np.array([u] * len(at), dtype=np.array([u]).dtype) if not isinstance(u, tuple) else np.array([None] * len(at), dtype=object) for c, u in unknown.items()}
        for c, values in self.before.items():
            values[at >= 0] = held[c].to_numpy()[self.known]

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].to_numpy()

    def previous(self, name: str, values: np.ndarray) -> np.ndarray:
        """Each row's value one point earlier; for a track's first row what was known of the track."""
        out = np.r_[values[:1], values[:-1]].astype(self.before[name].dtype)
        out[self.first] = self.before[name]
        return out

    def count(self) -> np.ndarray:
        """1 for a track's first row of this batch, 2 for the next one and so on."""
        return np.arange(len(self.of)) - self.first[self.of] + 1

    def earliest(self, rows: np.ndarray) -> np.ndarray:
        """Of these rows the first one of each track."""
        return rows[np.unique(self.of[rows], return_index=True)[1]]

    def found(self, rows: np.ndarray, **more) -> pd.DataFrame:
        return self.rows.iloc[rows][KEYS].assign(**more)


def _followed(points: DataFrame, columns: list[str], unknown: dict, memory: str, judge: Callable[[Turn], tuple[dict, pd.DataFrame]], out: str) -> DataFrame:
    """What judge finds of tracks whose points come in batches, in order of their frames.

    unknown: what is known of a new track; memory: its type for each of these names. judge returns both what is known of the batch's tracks then and the rows
    of ``out``. A track is forgotten when the watermark passes its last point, or the batch that brought it, by FORGET_SECONDS.
    Points of a null frame or time are skipped."""
    ids = [F.coalesce(F.col(c).cast("long"), F.lit(NO_KEY)).alias(c) for c in KEYS]
    rows = points.where("frame IS NOT NULL AND ts IS NOT NULL").select(F.pmod(F.xxhash64(*KEYS), F.lit(GROUPS)).cast("int").alias("grp"), *ids, "frame", *columns, F.unix_micros("ts").alias("us"), "ts")
    names = [*KEYS, "latest", "until", *unknown]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({c: pd.Series(list(v), dtype=object if isinstance(unknown.get(c), tuple) else None) for c, v in zip(names, state.get)}) if state.exists else pd.DataFrame(columns=names)
        now = state.getCurrentWatermarkMs()
        own = pd.DataFrame() if state.hasTimedOut else pd.concat(list(batches))
        kept = [held]
        found = None
        if len(own):
            turn = Turn(own, held, {"latest": 0} | unknown)
            after, found = judge(turn)
            latest = np.maximum(np.maximum.reduceat(turn.column("us"), turn.first) // 1000, turn.before["latest"])
            kept = [held.drop(index=turn.known), turn.keys.assign(latest=latest, until=np.maximum(latest, now + 1) + FORGET_SECONDS * 1000, **{c: list(v) for c, v in after.items()})]
        kept[0] = kept[0][kept[0]["until"] >= now] if len(kept[0]) else kept[0]
        kept = [k for k in kept if len(k)]
        if kept:
            state.update(tuple([list(v) if isinstance(v, tuple) else v for k in kept for v in k[c].tolist()] for c in names))
            state.setTimeoutTimestamp(max(min(int(k["until"].min()) for k in kept), now + 1))
        elif state.exists:
            state.remove()
        if found is not None:
            yield found

    kinds = ", ".join(f"{c} array<{t.strip()}>" for c, t in zip(names, ["long"] * 4 + memory.split(",")))
    found = rows.groupBy("grp").applyInPandasWithState(step, out, kinds, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.nullif(F.col(c), F.lit(NO_KEY)) for c in KEYS})


def live_crossings(points: DataFrame, level: float) -> DataFrame:
    """(job_id, track_id, frame, direction): the first crossing of y = level by each track of a stream of points.

    points: job_id, track_id, frame, gy, ts (with a watermark). State of a track: its last height, how many points it
    had, and whether it has crossed; it goes when the watermark passes the last point by FORGET_SECONDS."""

    def judge(turn: Turn) -> tuple[dict, pd.DataFrame]:
        y, frame = turn.column("gy").astype(float), turn.column("frame")
        last, before = turn.previous("last", y), turn.previous("frame", frame)
        seen = turn.count() + turn.before["seen"][turn.of]
        enters, leaves = (last < level) & (level <= y), (last > level) & (level >= y)
        rows = turn.earliest(np.flatnonzero((enters | leaves) & (seen >= LEAST_POINTS) & (frame - before <= MOST_GAP) & ~turn.before["crossed"][turn.of]))
        crossed = turn.before["crossed"].copy()
        crossed[turn.of[rows]] = True
        after = {"last": y[turn.last], "seen": seen[turn.last], "crossed": crossed, "frame": frame[turn.last]}
        return after, turn.found(rows, frame=frame[rows], direction=np.where(enters[rows], "in", "out"))

    unknown = {"last": np.nan, "seen": 0, "crossed": False, "frame": -1}
    return _followed(points, ["gy"], unknown, "double, long, boolean, long", judge, "job_id long, track_id long, frame long, direction string")


def live_line_crossings(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_id, lane_id, track_id, frame, direction): the first crossing of each of its camera's lines by each track of a stream of points.

    points: project_id, job_id, track_id, frame, gx, gy, ts (with a watermark). lines: project_id, lane_id, x1, y1, x2, y2 of any slope, a
    table of its own that each point meets as one short array. A crossing counts if the track had three points by then and was
    unseen for two frames at most before it. A track unseen for over 30 frames starts to be followed anew, but no line counts it twice. State of a track: its last place, how many points it
    had, and the lines it has crossed; it goes when the watermark passes the last point by FORGET_SECONDS. Points of a null frame or place are skipped."""
    few = lines.groupBy("project_id").agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("lane_id", "x1", "y1", "x2", "y2")]))).alias("lines"))
    rows = points.where("gx IS NOT NULL AND gy IS NOT NULL").join(few, "project_id")
    side_of = lambda ax, ay, bx, by, cx, cy: (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)

    def judge(turn: Turn) -> tuple[dict, pd.DataFrame]:
        x, y, frame = (turn.column(c).astype(float) for c in ("gx", "gy", "frame"))
        px, py, pf = (turn.previous(c, v) for c, v in (("x", x), ("y", y), ("frame", frame)))
        fresh = frame - pf > FORGET_FRAMES
        # points so far, counted from the last fresh start
        count = turn.count() + turn.before["seen"][turn.of]
        start = np.maximum.accumulate(np.where(fresh | turn.head, np.arange(len(count)), 0))
        count = count - np.where(fresh[start], count[start] - 1, 0)
        usable = np.flatnonzero(~fresh & (count >= LEAST_POINTS) & (frame - pf <= MOST_GAP))
        crossed = [list(c or ()) for c in turn.before["crossed"]]
        hits, lanes, ways = [], [], []
        site = turn.column("project_id")[turn.last][turn.of[usable]]
        for project in np.unique(site):
            at = usable[site == project]
            a, b, c, d, p, q = px[at], py[at], x[at], y[at], x[at] - px[at], y[at] - py[at]
            for lane, ax, ay, bx, by in np.reshape(turn.rows["lines"].iat[turn.last[turn.of[at[0]]]], (-1, 5)):
                side = p * (by - ay) - q * (bx - ax)
                hit = (side_of(a, b, ax, ay, bx, by) != side_of(c, d, ax, ay, bx, by)) & (side_of(a, b, c, d, ax, ay) != side_of(a, b, c, d, bx, by)) & (side != 0)
                way = dict(zip(at[hit].tolist(), side[hit].tolist()))
                for k in turn.earliest(at[hit]).tolist():
                    if int(lane) not in crossed[turn.of[k]]:
                        crossed[turn.of[k]].append(int(lane))
                        hits.append(k)
                        lanes.append(int(lane))
                        ways.append("in" if way[k] > 0 else "out")
        after = {"x": x[turn.last], "y": y[turn.last], "frame": frame[turn.last], "seen": count[turn.last], "crossed": crossed}
        hits = np.array(hits, dtype=int)
        return after, turn.found(hits, frame=frame[hits].astype(int), lane_id=np.array(lanes, dtype=int), direction=np.array(ways, dtype=object))[["job_id", "lane_id", "track_id", "frame", "direction"]]

    unknown = {"x": np.nan, "y": np.nan, "frame": -1e9, "seen": 0, "crossed": ()}
    return _followed(rows, ["gx", "gy", "project_id", "lines"], unknown, "double, double, double, long, array<long>", judge, "job_id long, lane_id long, track_id long, frame long, direction string")


def speed_pairs(points: DataFrame, first: float, second: float) -> DataFrame:
    """(job_id, track_id, direction, seconds): the time between a track's first crossings of two levels, given out once, when both are known.

    points: job_id, track_id, frame, gy, ts (with a watermark). A track that reaches the first level before the second goes in.
    State of a track: its last height, the times of both crossings and whether the pair was given out; it goes when the watermark passes the
    last point by FORGET_SECONDS. Points of a null height are skipped."""

    def judge(turn: Turn) -> tuple[dict, pd.DataFrame]:
        y, at = turn.column("gy").astype(float), turn.column("us") / 1e6
        last = turn.previous("last", y)
        times = []
        for name, level in (("one", first), ("two", second)):
            rows = turn.earliest(np.flatnonzero((last == last) & ((last < level) != (y < level))))
            rows = rows[turn.before[name][turn.of[rows]] < 0]
            times.append(turn.before[name].copy())
            times[-1][turn.of[rows]] = at[rows]
        one, two = times
        ready = np.flatnonzero((one >= 0) & (two >= 0) & ~turn.before["given"])
        given = turn.before["given"].copy()
        given[ready] = True
        found = turn.found(turn.first[ready], direction=np.where(one[ready] < two[ready], "in", "out"), seconds=np.abs(two - one)[ready])
        return {"last": y[turn.last], "one": one, "two": two, "given": given}, found

    unknown = {"last": np.nan, "one": -1.0, "two": -1.0, "given": False}
    return _followed(points.where("gy IS NOT NULL"), ["gy"], unknown, "double, double, double, boolean", judge, "job_id long, track_id long, direction string, seconds double")


def segment_version(marks: str) -> str:
    """The version of segments that a stream writes: one for each folder of marks, so a stream that is started again goes on with its own."""
    return "stream-" + hashlib.sha256(marks.encode()).hexdigest()[:16]


def staged_stream(crossings: DataFrame, path: str, marks: str, closes: str | None = None) -> StreamingQuery:
    """A query that writes a stream's segments as one version of a store (``sources.segments``), whatever batches their rows come in.

    A batch that fails and runs again overwrites its own rows. closes: name of a boolean column; a row where it is true is
    the last of its segment, and the batch that brings it commits the segment. Without it the segments become visible when
    ``commit_stream`` is called. Late rows of a committed segment join the rows that are seen."""
    version = segment_version(marks)

    def put(batch: DataFrame, number: int) -> None:
        segments.stage(batch.drop(closes) if closes else batch, path, f"{version}-{number}", version)
        if closes:
            done = batch.where(closes).select("job_id").distinct()
            if not done.isEmpty():
                segments.commit(batch.sparkSession, path, done, version)

    return crossings.writeStream.trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(put).start()


def commit_stream(spark: SparkSession, path: str, marks: str) -> None:
    """Make all that a stream has written the version that readers see of its segments."""
    version = segment_version(marks)
    segments.commit(spark, path, segments.staged_segments(spark, path, version), version)
