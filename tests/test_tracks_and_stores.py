"""Broken tracks, chains, stored paths, templates, second boxes, regions, file runs and versioned segments, against plain versions and worked cases."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtally.operators import docsearch, fragments, graphs, joins, quality, regions, runs, shapes, tracks, trajectories
from roadtally.sources import segments
from roadtally.streaming import live


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- graphs


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(8)], [(5, 6), (6, 7), (1, 3), (3, 5), (20, 21), (22, 21), (4, 4), (30, None)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    head = {}
    for a, b in edges:
        if b is not None and a != b:
            for x in (a, b):
                head.setdefault(x, x)
    for _ in edges:
        for a, b in edges:
            if b is not None and a != b:
                head[a] = head[b] = min(head[a], head[b])
    assert rows_of(graphs.components(df)) == sorted(head.items())


def test_chains(spark):
    links = [(i, i + 1) for i in range(10, 30)] + [(40, 5), (5, 41)]
    got = rows_of(graphs.chains(spark.createDataFrame(links, "a long, b long")))
    assert got == sorted([(i, 10, i - 10) for i in range(10, 31)] + [(40, 40, 0), (5, 40, 1), (41, 40, 2)])
    assert graphs.chains(spark.createDataFrame([], "a long, b long")).count() == 0


# --- fragments


def piece(track, frames, x, y, vx, vy, h=40.0, access=None, job=1):
    return [(job, track, f, x + vx * (f - frames[0]), y + vy * (f - frames[0]), h, access) for f in frames]


POINTS = "job_id long, track_id long, frame long, gx double, gy double, h double, access long"


def candidates(spark, rows, **how):
    df = spark.createDataFrame(rows, POINTS)
    ends = fragments.piece_ends(df).join(tracks.origins_destinations(df).select("job_id", "track_id", "destination"), ["job_id", "track_id"])
    return {(r.a, r.b): round(r.cost, 6) for r in fragments.fragment_candidates(ends, 10.0, **how).collect()}


def test_candidates_by_each_condition(spark):
    lost = piece(1, range(0, 6), 0.0, 0.0, 0.0, 10.0)  # ends at frame 5, place (0, 50), ten pixels a frame
    # on the way and heading on: away 0, limit 2 x 40 + .5 x 10 x 2, cost .5 x 2 / 10 - .3
    assert candidates(spark, lost + piece(2, range(7, 12), 0.0, 70.0, 0.0, 10.0)) == {(1, 2): round(0.1 - 0.3, 6)}
    assert candidates(spark, lost + piece(2, range(5, 9), 0.0, 70.0, 0.0, 10.0)) == {}  # starts when 1 ends
    assert candidates(spark, lost + piece(2, range(16, 20), 0.0, 160.0, 0.0, 10.0)) == {}  # over a second later
    assert candidates(spark, lost + piece(2, range(15, 20), 0.0, 150.0, 0.0, 10.0)) == {(1, 2): round(0.5 - 0.3, 6)}
    assert candidates(spark, lost + piece(2, range(7, 12), 0.0, 70.0, 0.0, -10.0)) == {}  # heads back
    assert candidates(spark, lost + piece(2, range(7, 12), 0.0, 70.0, 0.0, 10.0, h=81.0)) == {}
    assert candidates(spark, lost + piece(2, range(7, 12), 0.0, 70.0, 0.0, 10.0, h=19.0)) == {}
    assert candidates(spark, lost + piece(2, range(7, 12), 95.0, 70.0, 0.0, 10.0)) == {}  # 95 off where 90 is the limit
    assert set(candidates(spark, lost + piece(2, range(7, 12), 85.0, 70.0, 0.0, 10.0))) == {(1, 2)}
    assert candidates(spark, lost + piece(2, range(7, 12), 0.0, 70.0, 0.0, 10.0, access=3)) == {}  # starts in an access of its own
    # ends in access 3: with a destination of its own only if it came from another one
    inside = piece(1, range(0, 6), 0.0, 0.0, 0.0, 10.0, access=3)
    assert set(candidates(spark, inside + piece(2, range(7, 12), 0.0, 70.0, 0.0, 10.0, access=3))) == {(1, 2)}
    through = piece(1, range(0, 3), 0.0, 0.0, 0.0, 10.0, access=2) + piece(1, range(3, 6), 0.0, 30.0, 0.0, 10.0, access=3)
    assert candidates(spark, through + piece(2, range(7, 12), 0.0, 70.0, 0.0, 10.0)) == {}
    assert candidates(spark, piece(1, [5], 0.0, 50.0, 0.0, 0.0) + piece(2, range(7, 12), 0.0, 50.0, 0.0, 0.0)) == {}  # one point


def test_standing_pieces_may_stay_away_longer(spark):
    lost = piece(1, range(0, 6), 0.0, 50.0, 0.0, 0.0)
    back = lambda x, at: lost + piece(2, range(at, at + 5), x, 50.0, 0.0, 10.0)
    assert candidates(spark, back(7.0, 25)) == {}
    assert candidates(spark, back(7.0, 25), standing_gap=3.0) == {(1, 2): round(1 + 7 / 14 + 20 / 30, 6)}
    assert candidates(spark, back(15.0, 25), standing_gap=3.0) == {}
    assert candidates(spark, back(7.0, 36), standing_gap=3.0) == {}
    # the greatest of the last five heights is compared, not the last
    shrunk = [(*r[:5], 12.0 if r[2] == 5 else r[5], r[6]) for r in lost]
    assert set(candidates(spark, shrunk + piece(2, range(7, 12), 0.0, 50.0, 0.0, 0.0))) == {(1, 2)}


def test_joins_are_the_most_then_the_cheapest(spark):
    draw = np.random.default_rng(5)
    rows, want = [], {}
    for job in range(12):
        cost = {(a, b): float(draw.integers(-3, 20)) / 10 for a in range(4) for b in range(10, 14) if draw.random() < 0.45}
        rows += [(job, a, b, c) for (a, b), c in cost.items()]
        best = (0, 0.0)
        for n in range(1, 5):
            for pairs in itertools.combinations(cost, n):
                if len({a for a, _ in pairs}) == n == len({b for _, b in pairs}):
                    best = min(best, (-n, round(sum(cost[p] for p in pairs), 9)))
        want[job] = best
    got = fragments.joined_fragments(spark.createDataFrame(rows, "job_id long, a long, b long, cost double")).collect()
    cost = {(j, a, b): c for j, a, b, c in rows}
    for job, (n, total) in want.items():
        own = [(r.job_id, r.a, r.b) for r in got if r.job_id == job]
        assert (-len(own), round(sum(cost[x] for x in own), 9)) == (n, total)
        assert len({a for _, a, _ in own}) == len(own) == len({b for _, _, b in own})


def test_chains_of_points(spark):
    rows = piece(1, range(0, 8), 0.0, 0.0, 0.0, 12.0) + piece(2, range(10, 18), 0.0, 120.0, 0.0, 12.0) + piece(3, range(20, 30), 0.0, 240.0, 0.0, 12.0) + piece(4, range(9, 14), 5.0, 100.0, 0.0, 0.0)
    df = spark.createDataFrame(rows, POINTS).withColumn("y2", F.col("gy")).withColumn("y1", F.col("gy") - F.col("h"))
    assert rows_of(fragments.chains_of_points(df, 10.0)) == [(1, 1, 1, 0), (1, 2, 1, 1), (1, 3, 1, 2)]  # 4 never moved
    assert fragments.chains_of_points(df.limit(0), 10.0).count() == 0


# --- paths


def plain_resampled(x, y, h, n):
    """Plain version: medians, ways and places one by one."""
    if not len(x) == len(y) == len(h) or len(x) < 2:
        return None
    if len(x) >= 5:
        x, y = ([float(np.median(v[max(0, i - 2) : i + 3])) for i in range(len(v))] for v in (x, y))
    way = [0.0]
    for i in range(1, len(x)):
        way.append(way[-1] + float(np.hypot(x[i] - x[i - 1], y[i] - y[i - 1])))
    if way[-1] < 1e-6:
        return None
    goals = [way[-1] * j / (n - 1) for j in range(n)]
    return [[float(np.interp(g, way, v)) for g in goals] for v in (x, y, h)]


def test_resampled_paths_equal_plain_ones(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(60):
        n = int(draw.integers(0, 14))
        x, y, h = (np.round(draw.normal(0, 50, n).cumsum(), 2).tolist() for _ in range(3))
        if i % 7 == 0 and n:
            x, y = [x[0]] * n, [y[0]] * n
        rows.append((i, x, y, h if i % 9 else h[:-1]))
    rows += [(100, None, None, None), (101, [0.0, 0.0, 9.0, 0.0, 0.0], [1.0] * 5, [1.0] * 5), (102, [0.0, 10.0], [0.0, 0.0], [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>, h array<double>")
    got = df.select("id", "x", "y", "h", shapes.resampled(F.col("x"), F.col("y"), F.col("h"), 7).alias("p"), shapes.has_length(F.col("x"), F.col("y")).alias("long")).collect()
    for r in got:
        want = None if r.x is None else plain_resampled(r.x, r.y, r.h, 7)
        assert (r.p is None) == (want is None)
        if want:
            assert np.allclose([[q[c] for q in r.p] for c in "xyh"], want)
        if r.x is not None and len(r.h or []) == len(r.x):
            assert r.long == (want is not None)


def test_packed_paths(spark):
    points = lambda n: [(f * 3, f + 0.123, 2.0 * f, 40.06) for f in range(n)]
    df = spark.createDataFrame([(n, points(n)) for n in (1, 48, 49, 100, 333)], "n long, p array<struct<frame:long,x:double,y:double,h:double>>")
    for r in df.select("n", shapes.packed(F.col("p"), F.lit(15.0), F.col("n") > 50).alias("path")).collect():
        kept = sorted({int(v) for v in np.linspace(0, r.n - 1, 48).round()}) if r.n > 48 else range(r.n)
        assert r.path.t == [round(i * 3 / 15, 2) for i in kept] and r.path.x == pytest.approx([round(i + 0.123, 1) for i in kept])
        assert r.path.h == [40.1] * len(kept) and r.path.ends_in_dest == (r.n > 50) and len(r.path.y) == min(r.n, 48)
    back = shapes.unpacked(df.select("n", shapes.packed(F.col("p"), F.lit(15.0), F.lit(None).cast("boolean")).alias("path"))).where("n = 48").first()
    assert back.seconds == round(47 * 3 / 15, 2) and back.inside is False and len(back.xs) == 48


def test_retimed_paths(spark):
    df = spark.createDataFrame([(([0.0, 1.0, 2.5], [0.0] * 3, [0.0] * 3, [1.0] * 3, True), [(0, 0.0), (20, 2.0), (40, 3.0)])], f"path {shapes.STORED}, clock array<struct<frame:long,at:double>>")
    assert df.select(shapes.retimed(F.col("path"), F.lit(20.0), F.col("clock")).alias("p")).first().p.t == [0.0, 2.0, 3.0]  # frames 0, 20 and 50, past the clock's end
    assert df.select(shapes.retimed(F.col("path"), F.lit(12.0), F.col("clock")).alias("p")).first().p.t == [0.0, 1.2, 2.5]
    assert df.select(shapes.retimed(F.col("path"), F.lit(20.0), F.array().cast("array<struct<frame:long,at:double>>")).alias("p")).first().p.t == [0.0, 1.0, 2.5]


def test_templates_by_percentile_and_without_standing_paths(spark):
    line = lambda k, dx, still=False: (1, 1, 2, k, [float(dx)] * 8, [5.0] * 8 if still else [10.0 * i for i in range(8)], 100.0, 1.0, True)
    schema = "project_id long, origen_id long, destino_id long, id long, xs array<double>, ys array<double>, height double, seconds double, inside boolean"
    got = lambda rows: sorted((r.example, r.n) for r in tracks.movement_templates(spark.createDataFrame(rows, schema)).collect())
    assert got([line(1, 0), line(2, 1), line(3, 500)]) == [(2, 3)]  # of three, the one far off is no example
    assert got([line(1, 0, True), line(2, 1, True), line(3, 2, True)]) == []  # standing paths make no movement
    assert got([line(1, 0), line(2, 1), line(3, 2), line(4, 60, True)]) == [(2, 3)]
    # the tenth is cut by the interpolated percentile: of twelve, two lie over it
    assert [e for e, _ in got([line(k, 0.001 * k) for k in range(10)] + [line(10, 300), line(11, -300)])] in ([4], [5])


def test_heights_are_compared_point_by_point(spark):
    ways = [float(v) for k in range(32) for v in (0.0, 10.0 * k)]
    templates = spark.createDataFrame([(1, 1, 2, 20, ways)], "project_id long, origen_id long, destino_id long, n long, points array<double>")
    ys = [20.0 * k for k in range(8)]
    near, far = [60.0] * 4 + [5.0] * 4, [60.0] * 8
    rows = [(1, 1, [50.0] * 4 + [0.0] * 4, ys, near), (1, 2, [0.0] * 4 + [50.0] * 4, ys, near), (1, 3, [0.0] * 4 + [50.0] * 4, ys, far), (1, 4, [1.0, 1.0], [0.0, 140.0], [60.0] * 2), (1, 5, [1.0] * 3, [7.0] * 3, [60.0] * 3)]
    paths = spark.createDataFrame(rows, "project_id long, id long, xs array<double>, ys array<double>, hs array<double>")
    got = {r.id: r.reason for r in trajectories.assigned_paths(paths, templates).collect()}
    # 2 is ten of its own heights off where it is small; two points along the way are as good as eight; a standing path has none
    assert got == {1: "asignado", 2: "sin plantilla", 3: "asignado", 4: "asignado", 5: "sin plantilla"}


def test_nearest_places_equal_a_fine_search():
    draw = np.random.default_rng(3)
    line, points = draw.normal(0, 10, (5, 6, 2)).cumsum(axis=1), draw.normal(0, 20, (5, 4, 2))
    line[2, 3] = line[2, 2]  # a leg of no length
    gap, share = trajectories.nearest_places((line[..., 0], line[..., 1]), (points[..., 0], points[..., 1]))
    for i in range(5):
        steps = np.concatenate([np.linspace(line[i, k], line[i, k + 1], 4001) for k in range(5)])
        way = np.concatenate([[0], np.hypot(*np.diff(steps, axis=0).T).cumsum()])
        for j in range(4):
            d = np.hypot(*(steps - points[i, j]).T)
            assert gap[i, j] == pytest.approx(d.min(), abs=1e-2) and share[i, j] == pytest.approx((way / way[-1])[d.argmin()], abs=2e-3)


def test_second_boxes(spark):
    path = lambda t0, n, x, dy=10.0, h=20.0: ([t0 + 0.1 * i for i in range(n)], [x] * n, [dy * i for i in range(n)], [h] * n, True)
    schema = f"job_id long, id long, origen_id long, destino_id long, path {shapes.STORED}"
    wholes = spark.createDataFrame([(1, 1, 1, 2, path(9.5, 20, 0.0)), (1, 2, 1, 3, path(9.5, 20, 0.0)), (1, 3, 1, 2, None)], schema)
    rows = [(1, 10, 1, 2, path(9.5, 8, 15.0)), (1, 11, 1, 2, path(9.5, 4, 15.0)), (1, 12, 1, 2, path(9.5, 8, 25.0)), (2, 13, 1, 2, path(9.5, 8, 0.0)), (1, 14, 1, 2, path(30.0, 8, 0.0)), (1, 15, 2, 2, path(9.5, 8, 0.0)), (1, 16, 1, 2, None), (1, 1, 1, 2, path(9.5, 20, 0.0))]
    pieces = spark.createDataFrame(rows, schema)
    assert rows_of(trajectories.second_boxes(pieces, wholes)) == [(1, 10)]
    assert trajectories.second_boxes(pieces.limit(0), wholes).count() == 0


# --- regions


def plain_clusters(points, k, rounds=50):
    """k-means of one site, seeds farthest first, one place at a time."""
    mean = np.mean(points, axis=0)
    seeds = [max(points, key=lambda p: (np.hypot(*np.subtract(p, mean)), *p))]
    while len(seeds) < k:
        seeds.append(max(points, key=lambda p: (min(np.hypot(*np.subtract(p, s)) for s in seeds), *p)))
    centres = np.array(seeds, float)
    for _ in range(rounds):
        d = ((np.array(points)[:, None] - centres) ** 2).sum(2)
        own = d.argmin(1)
        new = np.array([np.array(points)[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        if np.hypot(*(new - centres).T).max() <= 1e-6:
            break
        centres = new
    d = ((np.array(points)[:, None] - centres) ** 2).sum(2)
    return centres, d.min(1).sum()


def test_clusters_equal_plain_ones_for_all_sites_at_once(spark):
    draw = np.random.default_rng(8)
    rows, want = [], {}
    for site, n in ((1, 60), (2, 37), (3, 12), (4, 6)):
        centres = draw.uniform(0, 1000, (4, 2))
        points = [tuple(np.round(centres[i % 4] + draw.normal(0, 20, 2), 1).tolist()) for i in range(n)]
        rows += [(site, "in", *p) for p in points]
        want[site] = points
    places = spark.createDataFrame(rows, "project_id long, kind string, x double, y double").groupBy("project_id", "kind", "x", "y").agg(F.count("*").alias("n"))
    got = regions.clustered(places).collect()
    chosen = {r.project_id: r.k for r in regions.elbow(regions.clustered(places)).collect()}
    assert {r.project_id for r in got} == {1, 2, 3}  # six places are too few
    for site, points in want.items():
        spreads = []
        for k in range(2, min(9, max(2, len(points) // 5)) + 1 if len(points) >= 10 else 2):
            centres, spread = plain_clusters(points, k)
            own = sorted((r for r in got if (r.project_id, r.k) == (site, k)), key=lambda r: r.c)
            assert np.allclose([(r.x, r.y) for r in own], centres) and sum(r.spread for r in own) == pytest.approx(spread) and sum(r.n for r in own) == len(points)
            spreads.append(spread)
        if spreads:
            x, y = np.linspace(0, 1, len(spreads)), (np.array(spreads) - spreads[-1]) / max(spreads[0] - spreads[-1], 1e-9)
            assert chosen[site] == (2 + int(np.abs(x + y - 1).round(12).argmax()) if len(spreads) > 2 else 2)


def test_regions_and_votes(spark):
    rows = []
    for i in range(24):
        x = 0.0 if i % 2 else 900.0  # two ways in, both out at the right
        for f in range(20):
            rows.append((1, 1, i, f, x + (1000.0 - x) * f / 19 + i % 3, (0.0 if i % 2 else 20.0) + 50.0 * f))
    rows += [(1, 1, 50, f, 5.0, 5.0) for f in range(20)] + [(2, 1, 1, f, 10.0 * f, 0.0) for f in range(20)]
    df = spark.createDataFrame(rows, "project_id long, job_id long, track_id long, frame long, gx double, gy double")
    ends = regions.track_ends(df, 1920, 1080)
    assert ends.where("track_id = 50").count() == 0  # it stands
    found = regions.regions(ends)
    moves = regions.movements_by_region(ends, found)
    got = {r.track_id: r for r in moves.where("project_id = 1").collect()}
    assert len({got[i].origin for i in range(1, 24, 2)}) == 1 and got[1].origin != got[2].origin
    assert regions.region_matrix(moves).agg(F.sum("n")).first()[0] == 24
    assert [(r.origin, r.destination) for r in moves.where("project_id = 2").collect()] == [(None, None)]
    assert regions.regions(ends.limit(0)).count() == 0


# --- runs of files


def plain_runs(files, drift=1.5, most=60):
    out, run, number = {}, [], -1
    for _, s, d, i in sorted((site, s, d, i) for site, i, s, d in files if d is not None):
        pass
    by_site = {}
    for site, i, s, d in files:
        by_site.setdefault(site, []).append((s, i, d))
    for site, own in by_site.items():
        run, number = [], -1
        for s, i, d in sorted(own, key=lambda x: x[:2]):
            if d is None:
                run = []
                continue
            done = sum(x[1] for x in run)
            if not run or abs(round(s - run[0][0] - done, 6)) > drift or round(done, 6) >= most * 60:
                run, number = [], number + 1
            run.append((s, d))
            out[site, i] = number
    return out


@pytest.mark.parametrize("seed", range(4))
def test_minute_runs_equal_a_walk(spark, seed):
    draw = np.random.default_rng(seed)
    files = []
    for site in range(3):
        s = float(draw.integers(0, 90_000))
        for i in range(260):
            d = None if draw.random() < 0.02 else float(draw.choice([60.0, 59.8, 60.1, 7.5, 5000.0], p=[0.6, 0.2, 0.15, 0.04, 0.01]))
            files.append((site, i, round(s, 3), d))
            s += (d or 60.0) + float(draw.choice([0.0, 0.4, 5.0, 90_000.0], p=[0.7, 0.27, 0.02, 0.01]))
    df = spark.createDataFrame(files, "project_id long, id long, s double, duration double")
    assert {(r.project_id, r.id): r.run for r in runs.minute_runs(df).collect()} == plain_runs(files)
    assert runs.minute_runs(df.limit(0)).count() == 0


# --- versions of segments


@pytest.fixture
def store(spark, tmp_path):
    return str(tmp_path / "store")


def make(spark, rows):
    return spark.createDataFrame(rows, "job_id long, id long")


def test_rows_are_seen_when_they_are_committed(spark, store):
    assert segments.read_segments(spark, store, "job_id long, id long").count() == 0
    segments.replace_segments(make(spark, [(1, 1), (1, 2), (2, 3)]), store)
    segments.stage(make(spark, [(1, 7)]), store, "b0", "v")
    assert rows_of(segments.read_segments(spark, store)) == [(1, 1), (1, 2), (2, 3)]  # half of the new count isn't seen
    segments.stage(make(spark, [(1, 8)]), store, "b1", "v")
    segments.stage(make(spark, [(1, 8)]), store, "b1", "v")  # a batch that runs again
    segments.commit(spark, store, segments.staged_segments(spark, store, "v"), "v")
    segments.commit(spark, store, segments.staged_segments(spark, store, "v"), "v")
    assert rows_of(segments.read_segments(spark, store)) == [(1, 7), (1, 8), (2, 3)]


def test_two_writers_lose_nothing(spark, store):
    for version, rows in (("a", [(1, 1)]), ("b", [(257, 2)])):
        segments.stage(make(spark, rows), store, version, version)
    segments.commit(spark, store, segments.staged_segments(spark, store, "b"), "b")
    segments.commit(spark, store, segments.staged_segments(spark, store, "a"), "a")
    assert rows_of(segments.read_segments(spark, store)) == [(1, 1), (257, 2)]
    assert not segments.commit(spark, store, make(spark, [(1, 0)]).select("job_id"), "c", at=1)  # the number is taken
    assert rows_of(segments.read_segments(spark, store)) == [(1, 1), (257, 2)]


def test_compaction_keeps_what_is_seen_and_what_is_under_way(spark, store):
    segments.replace_segments(make(spark, [(1, 1), (2, 2)]), store)
    segments.replace_segments(make(spark, [(1, 5)]), store)
    segments.stage(make(spark, [(2, 9)]), store, "later", "later")
    segments.compact(spark, store)
    assert rows_of(segments.read_segments(spark, store)) == [(1, 5), (2, 2)]
    assert len(segments._names(spark, f"{store}/rows")) == 2 and len(segments._names(spark, f"{store}/commits")) == 1
    segments.commit(spark, store, segments.staged_segments(spark, store, "later"), "later")
    assert rows_of(segments.read_segments(spark, store)) == [(1, 5), (2, 9)]


def test_a_segment_in_two_batches_of_a_stream(spark, store, tmp_path):
    segments.replace_segments(make(spark, [(1, 100), (2, 200)]).withColumn("last", F.lit(False)).drop("last"), store)
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    schema = "job_id long, id long, last boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    put([(1, 1, False), (1, 2, False), (1, 3, False)])
    live.staged_stream(stream(), store, marks, "last").awaitTermination()
    assert rows_of(segments.read_segments(spark, store)) == [(1, 100), (2, 200)]
    put([(1, 4, False), (1, 5, True)])
    live.staged_stream(stream(), store, marks, "last").awaitTermination()
    assert rows_of(segments.read_segments(spark, store)) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 200)]
    segments.replace_segments(make(spark, [(1, 6)]), store)
    assert rows_of(segments.read_segments(spark, store)) == [(1, 6), (2, 200)]


# --- texts and fractions of seconds


@pytest.mark.parametrize(
    "text, want",
    [("informaci-\nón", "información"), ("a-\n1", "a1"), ("x-\n y", "x-\n y"), ("-\nuno", "uno"), ("uno\n dos", "uno\n dos"), ("uno\ndos", "uno dos"), ("uno.\ndos", "uno.\ndos"), ("fin.\n\n", "fin."), ("\n\nfin", "fin"), ("uno\n\n\n\ndos", "uno\n\ndos"), ("a \t b\r\nc", "a b c"), ("  x ", "x"), ("uno\n dos", "uno\n dos"), ("", ""), (None, None)],
)
def test_clean_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(docsearch.clean_text(F.col("t")).alias("c")).first().c == want


def test_fractions_of_seconds_count(spark):
    schema = "id long, project_id long, start_ts string, end_ts string"
    day = "2024-01-01 "
    rows = [(1, 1, "12:00:00", "12:15:00.6"), (2, 1, "12:15:02.5", "12:30:00"), (3, 1, "12:30:00.9", "12:45:00"), (4, 1, "12:30:00.9", "12:30:01.5"), (5, 2, "12:30:00", "12:31:00")]
    df = spark.createDataFrame([(i, p, day + a, day + b) for i, p, a, b in rows], schema).withColumns({c: F.to_timestamp_ntz(c) for c in ("start_ts", "end_ts")})
    # 2 starts 1.9 s after 1 ends; 3 starts .9 s after 2, but 4 starts with it and is taken as the one before; 4 has 3, which ends long after
    assert rows_of(joins.previous_segment(df)) == [(3, 4)]
    noon = 1_704_110_400
    buckets = spark.createDataFrame([(1, noon + 900 * k) for k in range(4)], "project_id long, bucket long")
    assert [b - noon for _, b in rows_of(quality.touching(buckets, df.where("id = 1"), 15).select("project_id", "bucket"))] == [0, 900]


# --- crossings measured again, and lines of a live camera


def plain_remeasured(stored, measured):
    """Stored rows in turn."""
    def same(g, c):
        return g[:2] == c[:2] and (g[4] is None or abs(int(c[4]) - int(g[4])) <= 1) and (not g[5] or abs(c[5] - g[5]) <= 0.12 * g[5])

    free, pairs, waiting = list(measured), [], []
    by_track = {(c[0], c[1], c[3]): c for c in sorted(measured, key=lambda c: c[2])}
    for g in sorted(stored, key=lambda g: g[2]):
        c = by_track.get((g[0], g[1], g[3]))
        if c and same(g, c):
            pairs.append((*g[:3], c[2]))
            free.remove(c)
            del by_track[g[0], g[1], g[3]]
        else:
            waiting.append(g)
    for g in waiting:
        fits = [c for c in free if same(g, c)]
        if fits:
            c = min(fits, key=lambda c: (abs(c[5] - (g[5] or 0)), c[2]))
            pairs.append((*g[:3], c[2]))
            free.remove(c)
    return sorted(pairs)


def test_remeasured_pairs_equal_a_walk(spark):
    draw = np.random.default_rng(11)
    one = lambda i: (int(draw.integers(0, 2)), int(draw.integers(0, 2)), i, int(draw.integers(0, 40)), float(draw.integers(0, 40)) / 2, float(draw.integers(90, 110)))
    stored = [one(i) for i in range(70)]
    stored = [(*g[:4], None, g[5]) if g[2] % 17 == 0 else (*g[:5], None) if g[2] % 19 == 0 else g for g in stored]
    measured = [one(1000 - i) for i in range(80)]
    schema = "job_id long, lane_id long, id long, track_id long, s double, height double"
    got = tracks.remeasured_pairs(spark.createDataFrame(stored, schema), spark.createDataFrame(measured, schema))
    assert rows_of(got) == plain_remeasured(stored, measured)
    assert tracks.remeasured_pairs(spark.createDataFrame([], schema), spark.createDataFrame(measured, schema)).count() == 0


def test_remeasured_pairs_of_one_busy_second(spark):
    """Every stored row wanted the same measured one, so rounds of mutually best pairs took one pair each."""
    schema = "job_id long, lane_id long, id long, track_id long, s double, height double"
    row = lambda i, track, k: (1, 1, i, track, None if k % 7 == 3 else 5.5, None if k % 11 == 5 else 100.0)
    stored, measured = [row(i, i, i) for i in range(400)], [(1, 1, 5000 - i, -1 - i, 5.0, 100.0) for i in range(380)]
    measured += [(1, 1, 6000, -900, 5.0, None), (1, 1, 4000, -901, 900.0, 100.0)]
    began = time.time()
    got = rows_of(tracks.remeasured_pairs(spark.createDataFrame(stored, schema), spark.createDataFrame(measured, schema)))
    # the first row without a time takes the least id, at whatever time it is; the first without a height the one without
    left, want = sorted(c[2] for c in measured if c[2] < 6000), {5: 6000}
    for g in stored:
        fits = [m for m in left if m != 4000 or g[4] is None]
        if g[2] not in want and fits:
            want[g[2]] = fits[0]
            left.remove(fits[0])
    assert got == [(1, 1, i, m) for i, m in sorted(want.items())]
    assert time.time() - began < 60


def test_live_lines_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "project_id long, job_id long, track_id long, frame long, gx double, gy double, ts timestamp"
    lines = spark.createDataFrame([(1, 7, 0.0, 0.0, 100.0, 100.0), (1, 8, 0.0, 60.0, 100.0, 60.0), (2, 9, 0.0, 0.0, 1.0, 1.0)], "project_id long, lane_id long, x1 double, y1 double, x2 double, y2 double")
    row = lambda track, frame, x, y: (1, 1, track, frame, None if x is None else float(x), float(y), None)
    first = [row(1, f, 50, 10 * f) for f in range(5)] + [row(2, f, 50, 200 - 10 * f) for f in range(5)] + [row(3, f, 50, 40 + 9 * f) for f in range(2)]
    second = [row(1, f, 50, 10 * f) for f in range(5, 9)] + [row(2, f, 50, 200 - 20 * f) for f in range(40, 44)] + [row(3, f, 50, 40 + 9 * f) for f in range(2, 5)] + [row(4, f, None, 1) for f in range(4)]
    for rows in (first, second):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(1_704_067_200 + F.col("frame") / 10))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "1 hour")
        live.live_line_crossings(stream, lines).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "marks")).format("parquet").option("path", out).start().awaitTermination()
    got = {(r.track_id, r.lane_id): (r.frame, r.direction) for r in spark.read.parquet(out).collect()}
    # 1 leaves each line behind in the point after the one on it; 2 is away for over 30 frames; 3 has its third point where it crosses
    assert got == {(1, 7): (6, "out"), (1, 8): (7, "out"), (3, 7): (2, "out"), (3, 8): (3, "out")}
