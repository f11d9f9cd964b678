"""Fixed cases of the order-dependent jobs, geometry, classes, speeds and streams."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtally.functions import columns as C
from roadtally.operators import classify, docsearch, fragments, geometry, imports, runs, speed, tracks
from roadtally.operators.assign import FORBIDDEN, assign
from roadtally.sources import files, segments, sinks
from roadtally.streaming import live


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    cost = rng.random((n, m)).round(2)
    got = sum(cost[i, j] for i, j in assign(cost))
    small, large = sorted((n, m))
    table = cost if n <= m else cost.T
    assert got == pytest.approx(min(sum(table[i, p[i]] for i in range(int(small))) for p in itertools.permutations(range(int(large)), int(small))))


def test_forbidden_pairs_are_left_out():
    assert assign(np.array([[FORBIDDEN, 1.0], [FORBIDDEN, 2.0]])) == [(0, 1)]
    assert assign(np.zeros((0, 3))) == []


@pytest.mark.parametrize(
    "kind, height, threshold, width, fine, ratio, want",
    [
        ("car", 40, None, 60, False, None, "SIN_RESOLVER"), ("car", 40, 50.0, 60, False, None, "A"), ("motorcycle", 90, 190.0, 60, True, 1.4, "MOTO"), ("motorcycle", 90, 190.0, 120, True, 1.4, "A"),
        ("motorcycle", 20, 30.0, 10, False, None, "A"), ("bus", 300, 190.0, 400, True, 1.4, "B"), ("bus", 80, 50.0, 90, False, None, "PESADO"), ("truck", 190, 190.0, 250, True, 1.4, "A"),
        ("truck", 191, 190.0, 250, True, 1.4, "C"), ("truck", 60, 50.0, 80, False, None, "PESADO"), ("truck", None, 50.0, 80, False, None, "SIN_RESOLVER"), ("bus", None, 50.0, 80, True, None, "SIN_RESOLVER"),
    ],
)
def test_class_rules(spark, kind, height, threshold, width, fine, ratio, want):
    row = spark.createDataFrame([(kind, height, threshold, width, fine, ratio)], "k string, h int, t double, w int, f boolean, r double")
    c = F.col
    assert row.select(classify.rule_class(c("k"), c("h"), c("t"), c("w"), c("f"), c("r"))).first()[0] == want


def test_final_class(spark):
    rows = [("B", None, "T-S", 0.6, True, "T-S"), ("B", None, "T-S", 0.4, True, "B"), ("A", None, "T-S", 0.9, True, "A"), ("PESADO", None, "T-S", 0.9, False, "PESADO"), ("A", "C", "T-S", 0.9, True, "C")]
    df = spark.createDataFrame(rows, "rule string, rev string, model string, p double, fine boolean, want string")
    got = df.select(classify.final_class(F.col("rule"), F.col("rev"), F.col("model"), F.col("p"), F.col("fine")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_speed_and_labels(spark):
    one = spark.range(1)
    assert one.select(speed.kmh(F.lit(9.0), F.lit((90 / 7) / 20))).first()[0] == pytest.approx(50.4)
    assert one.select(speed.kmh(F.lit(9.0), F.lit(0.1))).first()[0] is None
    assert [one.select(C.quarter_minute(F.lit(x))).first()[0] for x in ("4:45 PM - 5:00 PM", "12:00 AM - 12:15 AM", "12:30 PM - 12:45 PM", "total")] == [1005, 0, 750, None]
    assert one.select(C.geh(F.lit(0.0), F.lit(0.0))).first()[0] == 0


def test_polygon(spark):
    shape = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    inside = {(5.0, 4.0): True, (5.0, 6.0): False, (1.0, 8.0): True, (11.0, 5.0): False}
    df = spark.createDataFrame([(list(map(list, shape)), x, y) for x, y in inside], "p array<array<double>>, x double, y double")
    points = F.transform("p", lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    for r in df.select("x", "y", geometry.in_polygon(F.col("x"), F.col("y"), points).alias("got")).collect():
        assert r.got == inside[r.x, r.y]


def moving(job, track, start, dy, x=100.0, n=30, w=220.0, h=150.0, f0=0):
    return [(job, f0 + f, x, start + dy * f - h, x + w, start + dy * f, "car") for f in range(n)]


def test_tracker_keeps_identities(spark):
    rows = [r for k in range(15) for r in moving(1, k, 200.0 + 5 * k, 4.0, x=300.0 * k)]
    rows = [r for r in rows if not (r[2] == 1200.0 and 12 <= r[1] < 17)]  # one vehicle is unseen for five frames
    got = tracks.track_boxes(spark.createDataFrame(rows, "job_id long, frame long, x1 double, y1 double, x2 double, y2 double, class_name string")).toPandas()
    assert got["track_id"].nunique() == 15
    assert got.groupby("track_id")["x1"].nunique().max() == 1


def test_repeated_crossings(spark):
    rows = [(1, 1, 1, 10, 100.0, 960.0, 50.0), (2, 1, 1, 12, 105.0, 962.0, 50.0), (3, 1, 1, 14, 300.0, 960.0, 50.0), (4, 1, 1, 30, 100.0, 960.0, 50.0), (5, 1, 2, 11, 100.0, 960.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, job_id long, lane_id long, frame long, gx double, gy double, height double").withColumn("track_id", F.col("id"))
    assert sorted(r.id for r in tracks.drop_repeated_crossings(df).collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("seen, want", [([1, 1, None, None, 2, 2], (1, 2)), ([None, None, 2, 2], (None, 2)), ([1, 1, None], (1, None)), ([None] * 4, (None, None)), ([1, None, 1, None, 3], (1, 3)), ([3, None, 1], (3, 1)), ([None, 2, None], (2, None)), ([1, *[None] * 14, 1], (1, None)), ([1, *[None] * 16, 1], (1, 1)), ([1, *[None] * 15, 1], (1, None))])
def test_access_runs(spark, seen, want):
    df = spark.createDataFrame([(1, 2, f, a) for f, a in enumerate(seen)], "job_id long, track_id long, frame long, access int")
    assert [(r.origin, r.destination) for r in tracks.origins_destinations(df).collect()] == [want]


def test_clock_and_minute_runs(spark):
    df = spark.createDataFrame([(1, i, s, 10.0) for i, s in enumerate([0.0, 0.1, 0.1, 0.1, 5.0])], "job_id long, frame long, s double, fps double")
    assert [round(r.at, 3) for r in tracks.monotonic_clock(df).orderBy("frame").collect()] == [0.0, 0.1, 0.2, 0.3, 5.0]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.0, 60.5, 121.0, 182.0, 240.0])], "project_id long, id long, s double")
    assert [r.run for r in runs.minute_runs(df).orderBy("id").collect()] == [0, 0, 0, 1, 2]


def test_join_fragments_takes_the_least_total_cost(spark):
    df = spark.createDataFrame([(1, 1, 10, 0.2), (1, 1, 11, 0.3), (1, 2, 10, 0.25), (2, 5, 6, 0.9)], "job_id long, a long, b long, cost double")
    assert sorted((r.job_id, r.a, r.b) for r in fragments.joined_fragments(df).collect()) == [(1, 1, 11), (1, 2, 10), (2, 5, 6)]


def test_chunks(spark):
    assert docsearch.chunks_of("") == [] and docsearch.chunks_of("one two") == ["one two"]
    text = "This is a sentence. " * 200
    parts = docsearch.chunks_of(text)
    assert all(len(p) <= 1200 for p in parts) and all(p.endswith(".") for p in parts[:-1])
    # the latest of the marks counts, with one character of it: a paragraph ends at 700, a sentence at 1001
    text = "a" * 700 + "\n\n" + "b" * 300 + ". " + "c" * 900
    assert docsearch.chunks_of(text) == ["a" * 700 + "\n\n" + "b" * 300 + ".", "b" * 199 + ". " + "c" * 900]
    # no mark past the half: the whole length
    assert [len(p) for p in docsearch.chunks_of("a" * 500 + ". " + "b" * 1500)] == [1200, 1002]
    df = spark.createDataFrame([(1, "one\r\ntwo  three-\nfour"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.ord, r.text) for r in docsearch.chunk_documents(df).collect()] == [(1, 0, "one two threefour")]


@pytest.mark.parametrize("parts", [1, 3])
def test_nearest_vectors(spark, parts):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [1.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [9.0]), (12, None), (13, [1.0, 2.0, 3.0])], "query_id long, vector array<double>")
    got = sorted((r.query_id, r.pos, r.doc_id, r.distance) for r in docsearch.vector_top(df, asked, "doc_id", 3, parts=parts).collect())
    assert got == [(10, 0, 2, 0.0), (10, 1, 6, 0.0), (10, 2, 1, 1.0), (11, 0, 5, 64.0)]
    assert docsearch.vector_top(df.limit(0), asked, "doc_id", 3).count() == 0


def test_lexical_search_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "red car"), (2, None), (3, ""), (4, "red red bus")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a Red car"), (8, None)], "query_id long, query string")
    assert [(r.query_id, r.doc_id, r.pos) for r in docsearch.lexical_top(docs, asked, "doc_id", "text", 9).orderBy("pos").collect()] == [(7, 1, 0), (7, 4, 1)]


def test_templates_leave_out_the_least_typical(spark):
    line = lambda k, dx: (1, 1, 2, k, [float(dx)] * 20, [10.0 * i for i in range(20)], 100.0, 2.0 + k, k % 2 == 0)
    rows = [line(k, k) for k in range(9)] + [line(9, 500), (1, 1, 2, 10, [], [], 100.0, 1.0, True), (1, 1, 2, 11, None, None, 100.0, 1.0, True)]
    df = spark.createDataFrame(rows, "project_id long, origen_id long, destino_id long, id long, xs array<double>, ys array<double>, height double, seconds double, inside boolean")
    got = tracks.movement_templates(df).collect()
    assert [(r.example, r.medoid, r.n, r.seconds, r.ending) for r in got] == [(4, True, 10, 6.5, 0.5)]
    assert tracks.movement_templates(df.limit(0)).count() == 0


def test_fused_twins_keep_the_longest_track_and_its_missing_frames(spark):
    box = lambda track, frames, dx=0.0: [(1, f, track, dx, 0.0, 100.0 + dx, 100.0) for f in frames]
    df = spark.createDataFrame(box(1, range(5)) + box(2, [0, 1, 3, 4, 5, 6, 7], 5.0) + box(3, range(4), 900.0), "job_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    got = tracks.fused_twins(df).collect()
    assert {(r.track_id, r.frame, r.x1) for r in got} == {(2, f, 0.0 if f == 2 else 5.0) for f in range(8)} | {(3, f, 900.0) for f in range(4)}


def test_hand_count_blocks(spark):
    cells = [("b", "s1", 1, 3, "PTE - OTE"), ("b", "s1", 2, 1, "Hr/Mov"), ("b", "s1", 2, 8, "Hr/Mov"), ("b", "s1", 2, 9, "ote-pte"), ("b", "s1", 3, 2, "b"), ("b", "s1", 3, 3, "a")]
    for r, values in ((4, ["7:00 AM - 7:15 AM", "4", "2", None, None, None]), (5, ["7:15 AM - 7:30 AM", None, " ", "x", None, None]), (6, ["7:00 AM - 7:15 AM", "9", None, None, None, None])):
        cells += [("b", "s1", r, c, v) for c, v in enumerate(values, 1)] + [("b", "s1", r, c, v) for c, v in enumerate(values, 8)]
    got = imports.hand_counts(spark.createDataFrame(cells, "book string, sheet string, row int, col int, value string"))
    one = {(r.direction, r.minute, r.klass): r.n for r in got.collect()}
    assert one == {("pte-ote", 420, "B"): 4.0, ("pte-ote", 420, "A"): 2.0, **{("pte-ote", 420, k): 0.0 for k in ("C", "T-S", "T-S-R")}, ("ote-pte", 420, "A"): 4.0, ("ote-pte", 420, "B"): 2.0, **{("ote-pte", 420, k): 0.0 for k in ("C", "T-S", "T-S-R")}}


def test_track_and_detection_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"fps": 20.0, "width": 1920, "height": 1080, "frames": 3, "tracks": {"7": {"clases": {"car": 2}, "p": [[0, 1, 2, 3, 4, 0.5], [1, 2, 3, 4, 5, 0.6]]}}}))
    rows = files.read_track_files(spark, str(tmp_path / "a.json")).collect()
    assert [(r.track_id, r.frame, r.x1, r.confidence) for r in rows] == [(7, 0, 1.0, 0.5), (7, 1, 2.0, 0.6)]
    (tmp_path / "b.json").write_text(json.dumps({"frames": [[[1, 2, 3, 4, 0.5, 2], [1, 2, 3, 4, 0.9, 7]], [], [[0, 0, 1, 1, 0.4, 5]]]}))
    got = files.read_detection_files(spark, str(tmp_path / "b.json")).collect()
    assert [(r.frame, r.box_no, r.class_name) for r in got] == [(0, 0, "car"), (0, 1, "truck"), (2, 0, "bus")]


def test_paths(spark):
    cases = {"x/2026-10-05/14-56-00.mp4": ("2026-10-05", 53760), "x/20261005/14/05.mp4": ("2026-10-05", 50700), "05-10-2026/cam.mp4": ("2026-10-05", None), "a/b.mp4": (None, None)}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    for r in df.select("path", files.path_date(F.col("path")).cast("string").alias("d"), files.path_seconds(F.col("path")).alias("s")).collect():
        assert (r.d, r.s) == cases[r.path]


def test_replaced_segments(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "job_id long, id long")
    segments.replace_segments(make([(1, 1), (1, 2), (257, 3), (2, 4)]), path)
    segments.replace_segments(make([(1, 9)]), path)
    assert sorted((r.job_id, r.id) for r in segments.read_segments(spark, path).collect()) == [(1, 9), (2, 4), (257, 3)]


def streamed(spark, tmp_path, rows, schema, job, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = job(source).writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    return spark.sql("SELECT * FROM out").collect()


def at(s):
    return f"2024-01-01 08:{s // 60:02d}:{s % 60:02d}"


def test_stream_intervals_and_sessions(spark, tmp_path):
    rows = [(1, k, 1, "in", "car", at(s)) for k, s in enumerate([0, 1, 2, 400, 401, 1000, 3000])]
    df = [(*r[:5], r[5]) for r in rows]
    cast = lambda d: d.withColumn("ts", F.to_timestamp("ts"))
    schema = "job_id long, track_id long, lane_id long, direction string, vehicle_type string, ts string"
    got = streamed(spark, tmp_path, df, schema, lambda d: live.interval_counts(cast(d)))
    assert sorted(r.n for r in got if str(r.start).endswith("08:00:00")) == [5]
    (tmp_path / "two").mkdir()
    got = streamed(spark, tmp_path / "two", df, schema, lambda d: live.headway_sessions(cast(d), 4.0))
    assert sorted(r.n for r in got)[-2:] == [2, 3]


def test_stream_crossings(spark, tmp_path):
    rows = [(1, 1, f, 950.0 + 3 * f, at(f)) for f in range(8)] + [(1, 2, f, 970.0 - 3 * f, at(f)) for f in range(8)] + [(1, 3, f, 900.0, at(f)) for f in range(8)]
    job = lambda d: live.live_crossings(d.withColumn("ts", F.to_timestamp("ts")).withWatermark("ts", "1 second"), 960.0)
    got = streamed(spark, tmp_path, rows, "job_id long, track_id long, frame long, gy double, ts string", job)
    assert sorted((r.track_id, r.frame, r.direction) for r in got) == [(1, 4, "in"), (2, 4, "out")]


def test_paired_directions(spark):
    from roadtally.operators import validate

    ours = [(1, "a", b, n) for b, n in enumerate((1, 5, 9, 2))] + [(1, "b", b, n) for b, n in enumerate((9, 4, 1, 8))] + [(1, "c", 0, 3), (1, "a", 99, 50), (2, "e", 0, 1), (2, None, 1, 1)]
    hand = [(1, "x", b, n) for b, n in enumerate((2, 6, 9, 3))] + [(1, "y", 0, 8), (1, "y", 1, None), (1, "y", 3, 7)] + [(2, "z", 0, 1), (2, None, 1, 4)]
    ours = spark.createDataFrame(ours, "project_id long, zone string, bin long, n long")
    hand = spark.createDataFrame(hand, "project_id long, direction string, bin long, n long")
    got = {(r["project_id"], r["zone"]): (r["direction"], r["r"] and round(r["r"], 3)) for r in validate.paired_directions(ours, hand).collect()}
    r = lambda x, y: round(float(np.corrcoef(x, y)[0, 1]), 3)
    assert got == {(1, "a"): ("x", r((1, 5, 9, 2), (2, 6, 9, 3))), (1, "b"): ("y", r((9, 4, 1, 8), (8, 0, 0, 7))), (1, "c"): (None, None), (2, "e"): ("z", -2.0)}
    assert validate.paired_directions(ours.limit(0), hand).count() == 0


def test_axle_sheet(spark):
    from roadtally.operators import imports

    def numbers(row, *values, col=0):
        return [("b", row, col + i, None, float(v)) for i, v in enumerate(values) if v is not None]

    def words(row, *values):
        return [("b", row, i, v, None) for i, v in enumerate(values)]

    table = lambda *ns: [*ns, *[0] * (13 - len(ns))]
    speeds = lambda *ns: [*ns, *[0] * (16 - len(ns))]
    cells = [
        *words(0, "Classification Report"), *words(1, "Lane #2 Axle", " Data From: x"), *words(2, "Lane #2 Axle Data From: x"),
        *numbers(3, 45292, 23 / 24, *table(1, 4), 5), *numbers(4, 0.0, *table(0, 3), 3), *numbers(5, 1 / 24, *table(9), 8),
        *words(6, "Percent"), *numbers(6, 0.5, *table(1, 1), 2, col=1), *words(7, "Mon"), *numbers(7, 2 / 24, *table(0, 0, 2), 2, col=1),
        *words(8, "Summary"), *numbers(9, 45292, 0.5, *table(7), 7),
        *words(10, "Lane #1 Speed Data From: x"), *numbers(11, 45300, 0.25, *speeds(0, 6), 6), *words(12, None),
    ]
    df = spark.createDataFrame(cells, "book string, row int, col int, text string, number double")
    got = {(r.kind, r.lane, str(r.date), r.minute, r.label): r.n for r in imports.axle_counts(df).where("n > 0").collect()}
    assert got == {
        ("clasificatorio", 2, "2024-01-01", 1380, "Cycle"): 1, ("clasificatorio", 2, "2024-01-01", 1380, "Cars"): 4, ("clasificatorio", 2, "2024-01-02", 0, "Cars"): 3,
        ("clasificatorio", 2, "2024-01-02", 120, "2A-4T"): 2, ("velocidad", 1, "2024-01-09", 360, "32.2"): 6,
    }
    volume = [*words(0, "Volume Report"), *words(1, "Lane #1 Data From: x"), *numbers(2, 45292, 0.5, 3, 4, 5, 6, 18), *numbers(3, 13 / 24, 2, 1, 3)]
    rows = imports.axle_counts(spark.createDataFrame(volume, df.schema)).collect()
    assert {(r.kind, r.minute): r.n for r in rows} == {("volumen", 720): 3, ("volumen", 735): 4, ("volumen", 750): 5, ("volumen", 765): 6, ("volumen", 810): 2, ("volumen", 825): 1}
    assert imports.axle_counts(df.limit(0)).count() == 0


def test_assigned_paths(spark):
    from roadtally.operators import trajectories

    straight = [float(v) for k in range(32) for v in (0.0, 10.0 * k)]
    across = [float(v) for k in range(32) for v in (10.0 * k, 0.0)]
    beside = [float(v) for k in range(32) for v in (5.0, 10.0 * k)]
    templates = spark.createDataFrame([(1, 1, 2, 20, straight), (1, 1, 3, 20, across), (2, 1, 2, 5, straight), (2, 1, 4, 5, beside)], "project_id long, origen_id long, destino_id long, n long, points array<double>")
    ys = [20.0 * k for k in range(8)]
    rows = [
        (1, 10, [1.0] * 8, ys, 20.0), (1, 11, [1.0] * 8, ys[::-1], 20.0), (1, 12, [100.0] * 8, [100.0 + y for y in ys], 20.0), (1, 13, [1.0] * 2, [0.0, 20.0], 20.0),
        (1, 14, None, None, 20.0), (1, 15, [], [], 20.0), (2, 16, [2.5] * 8, ys, 20.0), (3, 17, [1.0] * 8, ys, 20.0),
    ]
    paths = spark.createDataFrame(rows, "project_id long, id long, xs array<double>, ys array<double>, height double")
    got = {r.id: (r.origen_id, r.destino_id, r.reason) for r in trajectories.assigned_paths(paths, templates).collect()}
    none, open_ = (None, None, "sin plantilla"), (None, None, "ambiguo")
    assert got == {10: (1, 2, "asignado"), 11: none, 12: none, 13: none, 14: none, 15: none, 16: open_, 17: none}
    assert trajectories.assigned_paths(paths.limit(0), templates).count() == 0


def test_piece_then_whole_in_order(spark):
    from roadtally.operators import trajectories

    box = (0.0, 0.0, 10.0, 10.0)
    rows = [(1, 1, t, f, d, a, *box) for t, f, d, a in [(1, 0, "in", 50), (2, 5, "in", 8), (3, 12, "in", 8), (4, 14, "in", 50), (5, 15, "out", 3), (6, 30, "in", 3)]]
    crossings = spark.createDataFrame(rows, "job_id long, lane_id long, track_id long, frame long, direction string, age int, x1 double, y1 double, x2 double, y2 double")
    boxes = crossings.select("job_id", "track_id", "frame", "x1", "y1", "x2", "y2").limit(0)
    got = {r.track_id for r in trajectories.piece_then_whole(crossings, boxes).collect()}
    # 2 goes with 1; 3 follows 2 only, which was not counted; 4 is old, 5 goes the other way, 6 comes late
    assert got == {1, 3, 4, 5, 6}
    assert trajectories.piece_then_whole(crossings.limit(0), boxes).count() == 0
