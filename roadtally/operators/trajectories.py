"""Whole trajectories: broken tracks as one path, one crossing a line, movements, and paths held against templates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.operators import geometry, shapes, tracks
from roadtally.sources.sinks import dealt, kept_table

# Limits under which the counts were compared with hand counts.
YOUNG, PIECE_FRAMES, PIECE_SHARE = 20, 9, 0.7
LINE_MOVED, ACCESS_MOVED = 0.5, 2.0
APART, SPREAD, POSTERIOR, COVERED, FORWARD, BACKWARD = 1.0, 0.5, 0.9, 0.25, 0.8, -0.02
KEYS = ["project_id", "id", "origen_id", "destino_id", "n"]
BLOCK_PATHS, FIT_ROWS = 4096, 512
PIECE_POINTS, SECOND_POINTS, SECOND_NEAR = 16, 5, 1.0


def piece_then_whole(crossings: DataFrame, boxes: DataFrame) -> DataFrame:
    """crossings without those of young tracks whose box holds, or lies in, that of a track that has just crossed.

    crossings: job_id, lane_id, track_id, frame, direction, age, x1, y1, x2, y2. A track of at most 20 frames is left out
    if another one was counted on the line in the same direction in the nine frames before, and .7 of the smaller of both boxes is
    shared. The other's box is the one it has now (boxes: job_id, track_id, frame, x1, y1, x2, y2), else the one it crossed with.
    Spark pairs crossings of neighbouring steps of nine frames; only pairs that hold go to the short loop that decides in order.
    Rows with a null key or box are kept.
    """
    step = F.floor(F.col("frame") / PIECE_FRAMES)
    key = ["job_id", "lane_id", "direction", "step"]
    young = crossings.where(F.col("age") <= YOUNG).withColumn("step", F.explode(F.array(step - 1, step)))
    other = crossings.select("job_id", "lane_id", "direction", step.alias("step"), *[F.col(c).alias(f"o_{c}") for c in ("track_id", "frame", "x1", "y1", "x2", "y2")])
    near = young.join(other, key).where("o_track_id <> track_id AND (o_frame < frame OR (o_frame = frame AND o_track_id < track_id))").where(F.col("frame") - F.col("o_frame") <= PIECE_FRAMES)
    now = boxes.select("job_id", "frame", F.col("track_id").alias("o_track_id"), *[F.col(c).alias(f"n_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = near.join(now, ["job_id", "frame", "o_track_id"], "left")
    box = [F.coalesce(f"n_{c}", f"o_{c}") for c in ("x1", "y1", "x2", "y2")]
    held = geometry.containment(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], *box)
    pairs = near.where(held >= PIECE_SHARE).select("job_id", "lane_id", "direction", "frame", "track_id", "o_frame", "o_track_id")

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        out, rows = set(), group.sort_values(["frame", "track_id"])
        for f, t, of, ot in zip(rows["frame"], rows["track_id"], rows["o_frame"], rows["o_track_id"]):
            if (of, ot) not in out:
                out.add((f, t))
        first = group.iloc[0]
        return pd.DataFrame([(first["job_id"], first["lane_id"], first["direction"], *x) for x in out], columns=["job_id", "lane_id", "direction", "frame", "track_id"])

    gone = pairs.groupBy("job_id", "lane_id", "direction").applyInPandas(decide, "job_id long, lane_id long, direction string, frame long, track_id long")
    return crossings.join(gone, ["job_id", "lane_id", "direction", "frame", "track_id"], "left_anti").select(*crossings.columns)


def chained(points: DataFrame, chains: DataFrame) -> DataFrame:
    """points with piece (their track) and track_id (its chain). chains: job_id, track_id, chain; a track without a row is its own chain."""
    own = points.join(chains.select("job_id", "track_id", "chain"), ["job_id", "track_id"], "left").withColumn("piece", F.col("track_id"))
    return own.withColumn("track_id", F.coalesce("chain", "piece")).drop("chain")


def count_by_trajectory(points: DataFrame, chains: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_id, lane_id, track_id, piece, frame, direction, height): one crossing at most of each whole path and line.

    points: project_id, job_id, track_id, frame, gx, gy, x1, y1, x2, y2. Tracks of one point and those that never get half a
    box height away from their start are left out. The crossing is the path's first; piece is the track whose box crossed.
    """
    size = points.groupBy("job_id", "track_id").agg(F.count("*").alias("n")).where("n >= 2")
    alive = geometry.moved(points, LINE_MOVED).where("moved").join(size, ["job_id", "track_id"]).select("job_id", "track_id")
    own = chained(points.join(alive, ["job_id", "track_id"]), chains).withColumn("height", F.col("y2") - F.col("y1")).drop("x1", "y1", "x2", "y2")
    crossed = geometry.segment_crossings(geometry.steps(own), lines)
    first = Window.partitionBy("job_id", "track_id", "crossed_lane").orderBy("frame", "piece")
    rows = crossed.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.select("job_id", F.col("crossed_lane").alias("lane_id"), "track_id", "piece", "frame", "direction", "height")


def compared_methods(one: DataFrame, other: DataFrame) -> DataFrame:
    """(lane_id, direction, n_one, n_other, only_one, only_other): counts of two methods on the same tracks, and the rows (job_id, lane_id, track_id) of one alone."""
    a, b = (x.select("job_id", "lane_id", "track_id", "direction").distinct().withColumn(n, F.lit(1)) for x, n in ((one, "a"), (other, "b")))
    both = a.join(b, ["job_id", "lane_id", "track_id", "direction"], "full")
    return both.groupBy("lane_id", "direction").agg(
        F.count("a").alias("n_one"), F.count("b").alias("n_other"), F.count_if(F.col("b").isNull()).alias("only_one"), F.count_if(F.col("a").isNull()).alias("only_other")
    )


def segment_movements(points: DataFrame, chains: DataFrame, fps: Column | float = 15.0) -> DataFrame:
    """(job_id, track_id, origin, destination, first_frame, last_frame, class_name, height, confidence, pieces, complete, path) of each whole path.

    points: job_id, track_id, frame, gx, gy, x1, y1, x2, y2, class_name, confidence, access (null: the centre). Pieces that
    never get two box heights away from their start are left out before they are joined. A path that saw no access is no
    movement; an incomplete one must have moved as a whole. The class has most frames (ties: by name); the height is the upper
    median of the boxes in the origin, of all boxes without one. path is stored as ``shapes.STORED``. chains: as
    ``fragments.chains_of_points`` gives them.
    """
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    alive = geometry.moved(points, ACCESS_MOVED).where("moved").select("job_id", "track_id")
    own = chained(points.join(alive, ["job_id", "track_id"]), chains).select("job_id", "track_id", "piece", "frame", "gx", "gy", "y1", "y2", "class_name", "confidence", "access")
    own = dealt(kept_table(own, "joined"), "job_id", "track_id")  # read by each of the sums below
    ends = tracks.origins_destinations(own.select(F.col("job_id").cast("long").alias("job_id"), F.col("track_id").cast("long").alias("track_id"), "frame", "access"), deal=False).where("origin IS NOT NULL OR destination IS NOT NULL")
    far = geometry.moved(own, ACCESS_MOVED).select("job_id", "track_id", F.col("moved"))
    klass = tracks.class_by_vote(own, "frames")
    h = F.col("y2") - F.col("y1")
    median = lambda hs: F.get(hs, F.floor(F.size(hs) / 2).cast("int"))
    inside, every = F.array_sort(F.collect_list(F.when(F.col("access") == F.col("origin"), h))), F.array_sort(F.collect_list(h))
    sums = own.join(ends, ["job_id", "track_id"]).groupBy("job_id", "track_id", "origin", "destination").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), inside.alias("hs"), every.alias("all"), F.round(F.avg("confidence"), 3).alias("confidence"), F.count_distinct("piece").alias("pieces"),
        F.array_sort(F.collect_list(F.struct("frame", F.col("gx").alias("x"), F.col("gy").alias("y"), h.alias("h"), "access"))).alias("ps"),
    )
    whole = F.col("origin").isNotNull() & F.col("destination").isNotNull()
    out = sums.join(far, ["job_id", "track_id"]).where(whole | F.col("moved")).join(klass, ["job_id", "track_id"])
    height = F.when(F.size("hs") > 0, median(F.col("hs"))).otherwise(median(F.col("all")))
    return out.select("job_id", "track_id", "origin", "destination", "first_frame", "last_frame", "class_name", height.cast("int").alias("height"), "confidence", "pieces", whole.alias("complete"), shapes.packed(F.col("ps"), fps, F.element_at("ps", -1)["access"] == F.col("destination")).alias("path"))


def resampled_paths(paths: DataFrame, n: int = tracks.TEMPLATE_POINTS) -> DataFrame:
    """(job_id, track_id, place, x, y): n points at equal distances along each path (job_id, track_id, xs, ys), smoothed by a running median of five.

    Paths of two to four points are not smoothed. Null, empty and unequal arrays, single points and paths of no length give no rows."""

    def spread(batches):
        for batch in batches:
            xs, ys = batch.column("xs"), batch.column("ys")
            rows, x, y, _ = shapes.resampled_arrays(xs, ys, ys, n)
            keys = [batch.column(c).take(pa.array(np.repeat(rows, n))) for c in ("job_id", "track_id")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), pa.array(x.ravel()), pa.array(y.ravel())], names=["job_id", "track_id", "place", "x", "y"])

    own = paths.select(*[F.col(c).cast("long").alias(c) for c in ("job_id", "track_id")], *[F.col(c).cast("array<double>").alias(c) for c in ("xs", "ys")])
    return own.mapInArrow(spread, "job_id long, track_id long, place int, x double, y double")


def nearest_places(lines: tuple[np.ndarray, np.ndarray], points: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For many lines (a row each: x and y of its points; or one line for all) and the points that belong to each, how far every point is from its line and what share of the line lies before the nearest place.

    The legs are walked one by one, for all lines and points at once; the first of equally near legs counts, and a leg of no length is the place where it stands."""
    (lx, ly), (px, py) = lines, points
    best, way, done = np.full(px.shape, np.inf), np.zeros(px.shape), np.zeros((len(lx), 1))
    for k in range(lx.shape[1] - 1):
        sx, sy = lx[:, k, None], ly[:, k, None]
        ex, ey = lx[:, k + 1, None] - sx, ly[:, k + 1, None] - sy
        long = np.hypot(ex, ey)
        ex, ey = (np.divide(e, long, out=np.zeros_like(e), where=long > 0) for e in (ex, ey))
        dx, dy = px - sx, py - sy
        foot = dx * ex
        foot += dy * ey
        np.maximum(foot, 0.0, out=foot)
        np.minimum(foot, long, out=foot)
        dx -= foot * ex
        dy -= foot * ey
        dx *= dx
        dy *= dy
        dx += dy  # squares: the root is taken once, of the least
        nearer = dx < best
        np.copyto(best, dx, where=nearer)
        foot += done
        np.copyto(way, foot, where=nearer)
        done = done + long
    return np.sqrt(best), way / np.maximum(done, 1e-9)


def fits(x: np.ndarray, y: np.ndarray, h: np.ndarray, movements: np.ndarray, lines: np.ndarray, most: float):
    """For each movement its number, the paths (rows of x, y, h) that lie within ``most`` heights of one of its examples, and apart, first, last, forward of the nearest one.

    Only paths all of whose points lie that near the example's surrounding rectangle are held against it."""
    h = np.maximum(h, 1.0)
    best = {}
    for movement, line in zip(movements, lines):
        lx, ly = line[None, ::2], line[None, 1::2]
        aside = [np.maximum(np.maximum(v.min() - p, p - v.max()), 0.0) for v, p in ((lx, x), (ly, y))]
        near = np.nonzero((aside[0] ** 2 + aside[1] ** 2 <= (most * h) ** 2 * (1 + 1e-9)).all(axis=1))[0]
        m = best.setdefault(movement, np.full((4, len(x)), np.inf))
        for low in range(0, len(near), FIT_ROWS):
            rows = near[low : low + FIT_ROWS]
            gap, way = nearest_places((lx, ly), (x[rows], y[rows]))
            new = np.stack([(gap / h[rows]).max(axis=1), way[:, 0], way[:, -1], (np.diff(way, axis=1) >= BACKWARD).mean(axis=1)])
            old = m[:, rows]
            differ = new != old
            first = differ.argmax(axis=0)[None]
            less = differ.any(axis=0) & (np.take_along_axis(new, first, 0) < np.take_along_axis(old, first, 0))[0]
            m[:, rows[less]] = new[:, less]
    for movement, m in best.items():
        rows = np.nonzero(m[0] <= most)[0]
        yield movement, rows, m[:, rows]


def fitted(paths: DataFrame, templates: DataFrame, most: float = APART) -> DataFrame:
    """(project_id, id, origen_id, destino_id, n, apart, first, last, forward): every path (project_id, id, xs, ys, hs) held against
    the examples of every movement of its site: separation in heights, first and last place along the example, share of steps that go forward.

    The nearest example (least separation) stands for the movement: one row for each path and movement whose separation is at most ``most``.
    templates: project_id, origen_id, destino_id, n, points (x and y in turn, equally many of each). A site's paths fall into blocks of some
    thousands by their id, and each block meets the site's examples once."""
    lines = templates.select(*[F.col(c).cast("long").alias(c) for c in ("project_id", "origen_id", "destino_id", "n")], F.col("points").cast("array<double>").alias("points"))
    own = paths.select(F.col("project_id").cast("long").alias("project_id"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("array<double>").alias(c) for c in ("xs", "ys", "hs")])
    sites = kept_table(own.where("project_id IS NOT NULL").groupBy("project_id").agg(F.ceil(F.count("*") / BLOCK_PATHS).alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    own = own.join(sites, "project_id").withColumn("block", block).drop("blocks")
    lines = lines.join(sites, "project_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def measure(block: pa.Table, examples: pa.Table) -> pa.Table:
        block, examples = (t.combine_chunks() for t in (block, examples))
        column = lambda t, c: t.column(c).chunk(0) if t.num_rows else t.column(c).combine_chunks()
        parts = []
        if block.num_rows and examples.num_rows:
            rows, x, y, h = shapes.resampled_arrays(*[column(block, c) for c in ("xs", "ys", "hs")], PIECE_POINTS)
            points = column(examples, "points").flatten().to_numpy(zero_copy_only=False).reshape(examples.num_rows, -1)
            keys = list(zip(*[examples.column(c).to_pylist() for c in KEYS[2:]]))
            ids, site = block.column("id").to_numpy(), examples.column("project_id")[0].as_py()
            for movement, held, m in fits(x, y, h, keys, points, most):
                parts.append([np.full(len(held), site), ids[rows[held]], *[np.full(len(held), v) for v in movement], *m])
        columns = [np.concatenate(v) for v in zip(*parts)] if parts else [np.zeros(0, int)] * 5 + [np.zeros(0)] * 4
        return pa.Table.from_arrays([pa.array(v) for v in columns], names=[*KEYS, "apart", "first", "last", "forward"])

    key = ["project_id", "block"]
    return own.groupBy(*key).cogroup(lines.groupBy(*key)).applyInArrow(measure, ", ".join(f"{c} long" for c in KEYS) + ", apart double, first double, last double, forward double")


def assigned_paths(paths: DataFrame, templates: DataFrame) -> DataFrame:
    """(project_id, id, origen_id, destino_id, reason) of each incomplete path: the movement whose template it fits, or why none.

    paths: project_id, id, xs, ys and hs (or one height). templates: project_id, origen_id, destino_id, n, points (x and y in turn), as
    ``tracks.movement_templates`` gives: at most twelve a movement. A path fits an example if no point of it lies more than one of its
    heights away, it covers a quarter and four fifths of its steps go forward; the nearest example stands for the movement. Movements weigh
    exp(-(gap / .5)^2 / 2) (n + 1); the greatest must have nine tenths of all weight, else the path is ambiguous.
    Paths of under two points or no length, and sites without templates: sin plantilla.
    """
    own = shapes.with_heights(paths)
    held = fitted(own, templates).where((F.col("last") - F.col("first") >= COVERED) & (F.col("forward") >= FORWARD))
    held = held.withColumn("weight", F.exp(-0.5 * F.pow(F.col("apart") / SPREAD, F.lit(2))) * (F.col("n") + 1))
    best = held.groupBy("project_id", "id").agg(F.max_by(F.struct("origen_id", "destino_id"), F.struct("weight", -F.col("origen_id"), -F.col("destino_id"))).alias("m"), (F.max("weight") / F.sum("weight")).alias("share"))
    out = own.select("project_id", "id").join(best, ["project_id", "id"], "left")
    good = F.col("share") >= POSTERIOR
    reason = F.when(F.col("share").isNull(), "sin plantilla").when(good, "asignado").otherwise("ambiguo")
    return out.select("project_id", "id", F.when(good, F.col("m.origen_id")).alias("origen_id"), F.when(good, F.col("m.destino_id")).alias("destino_id"), reason.alias("reason"))


def second_boxes(pieces: DataFrame, wholes: DataFrame, step: float = 10.0) -> DataFrame:
    """(job_id, id) of the pieces that are a second box of a whole vehicle of their movement: of the piece's points in the whole one's time,
    five or more, half lie within one height of where the whole one was.

    Both: job_id, id, origen_id, destino_id, path (as stored: t, x, y, h). Time is cut into steps, and paths meet in the first
    step that both are in, so a piece is held against the paths of its own seconds only. Null and empty paths are no second boxes."""
    key = ["job_id", "origen_id", "destino_id"]

    def timed(rows: DataFrame, name: str) -> DataFrame:
        own = rows.where("size(path.t) > 0").select(*key, F.col("id").alias(f"{name}_id"), F.col("path").alias(name))
        low, high = F.floor(F.get(f"{name}.t", F.lit(0)) / step), F.floor(F.element_at(f"{name}.t", -1) / step)
        return own.withColumn(f"{name}_low", low).withColumn("step", F.explode(F.sequence(low, high)))

    both = timed(pieces, "p").join(timed(wholes, "w"), [*key, "step"]).where("step = greatest(p_low, w_low) AND p_id <> w_id")
    both = both.where((F.get("w.t", F.lit(0)) <= F.element_at("p.t", -1)) & (F.element_at("w.t", -1) >= F.get("p.t", F.lit(0))))
    inside = F.filter(F.arrays_zip("p.t", "p.x", "p.y"), lambda q: q["t"].between(F.get("w.t", F.lit(0)), F.element_at("w.t", -1)))
    both = both.select("job_id", "p_id", "w", inside.alias("seen"))
    then = shapes.between(F.col("w.t"), {c: F.col(f"w.{c}") for c in "xyh"}, F.col("seen.t"))
    gaps = F.zip_with("seen", then, lambda q, w: F.hypot(q["x"] - w["x"], q["y"] - w["y"]) / F.greatest(w["h"], F.lit(1.0)))
    near = both.select("job_id", F.col("p_id").alias("id"), gaps.alias("gaps"))
    return near.where((F.size("gaps") >= SECOND_POINTS) & (shapes.middle(F.col("gaps")) <= SECOND_NEAR)).select("job_id", "id").distinct()


def row_fates(movements: DataFrame, vehicles: DataFrame, undecided: DataFrame) -> DataFrame:
    """(id, counts, origen_id, destino_id, how) of every movement row (id, project_id, origen_id, destino_id, traced).

    vehicles: id, v_origin, v_destination, by_path of the rows that stand for a vehicle; undecided: id, why. Rows of neither
    are pieces of another vehicle. In a site where no row was traced, a row counts if it has both ends.
    """
    site = movements.groupBy("project_id").agg(F.max("traced").alias("any_traced"))
    rows = movements.join(site, "project_id").join(vehicles, "id", "left").join(undecided, "id", "left")
    traced, whole = F.col("any_traced"), F.col("origen_id").isNotNull() & F.col("destino_id").isNotNull()
    is_vehicle = F.col("by_path").isNotNull()
    how = F.when(~traced & whole, "por zonas").when(~traced, "incompleto").when(is_vehicle, F.when(F.col("by_path"), "por trayectoria").otherwise("por zonas")).otherwise(F.coalesce("why", F.lit("pedazo de otro vehículo")))
    end = lambda v, own: F.when(traced & is_vehicle, F.col(v)).otherwise(F.col(own))
    return rows.select("id", F.when(traced, is_vehicle).otherwise(whole).alias("counts"), end("v_origin", "origen_id").alias("origen_id"), end("v_destination", "destino_id").alias("destino_id"), how.alias("how"))
