"""What one task reads or holds does not grow with the table."""

import glob
import math
import statistics
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from roadtally.llm import suffix_tree
from roadtally.llm.common import written
from roadtally.operators import classify, docsearch, intervals, review, tracks
from roadtally.plans.fixtures import Fixtures


def test_texts_are_cut_a_few_at_a_time(spark):
    """A batch of 10 000 texts was held as Python strings, with all of its pieces, before any was handed on."""
    texts = [None, "", *[f"Uno {i}. dos\n" * (i % 300) for i in range(400)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    out = docsearch.chunk_documents(rows)
    assert "MapInArrow" in out._jdf.queryExecution().toString() and len(texts) > 2 * docsearch.CUT_TEXTS
    clean = rows.select("doc_id", docsearch.clean_text(F.col("text")).alias("t")).collect()
    want = [(r.doc_id, k, p) for r in clean for k, p in enumerate(docsearch.chunks_of(r.t or ""))]
    assert sorted((r.doc_id, r.ord, r.text) for r in out.collect()) == want


def test_crossings_are_not_dealt_by_line_to_class_them(spark):
    """There are few lines, so one task read a line's share of the whole table."""
    crossings = Fixtures(spark, "/root/testdata/sf0.001").crossings
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = intervals.in_bucket(classify.classified(crossings), crossings.groupBy("project_id").agg(F.lit(0).cast("long").alias("lo"), F.lit(4e9).alias("hi")), 15)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert rows.count() == crossings.count()


def test_discarded_crossings_are_dealt_over_partitions_that_grow(spark):
    """Windows by line and joins by id were dealt over the session's partitions at every size."""
    crossings = Fixtures(spark, "/root/testdata/sf0.001").crossings
    doubles = review.possible_doubles(crossings, fps=20.0)
    left, side = review.discard(crossings, doubles, "cruce", "doble")
    for df in (doubles, left):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    assert side.count() == doubles.count() > 0 and left.count() == crossings.count() - side.count()
    assert review.restore(left, side).drop("ts").exceptAll(crossings.drop("ts")).isEmpty()


def test_twins_are_found_in_arrays(spark):
    """A row was made for each frame that two tracks share; now a stretch of a video is compared at once, and tracks may reach over several."""
    draw = np.random.default_rng(4)
    rows = []
    for job in (1, 2):
        for track in range(12):
            first, n = int(draw.integers(0, 700)), int(draw.integers(3, 600))
            x, y, size = float(draw.integers(0, 3)) * 40, float(draw.integers(0, 3)) * 40, float(draw.integers(20, 90))
            rows += [(job, f, track, x + f % 7, y, x + f % 7 + size, y + size if f % 50 else None) for f in range(first, first + n) if f % 11]
    rows += [(1, 5, 40 + k, 0.0, 0.0, 0.0, 9.0) for k in range(2)] + [(None, 5, 1, 0.0, 0.0, 1.0, 1.0), (1, None, 3, 0.0, 0.0, 1.0, 1.0)]
    length, held = Counter(), defaultdict(list)
    for job, frame, a, *p in rows:
        length[job, a] += 1
    lesser, greater = lambda *v: min((i for i in v if i is not None), default=None), lambda *v: max((i for i in v if i is not None), default=None)
    for job, frame, a, *p in rows:
        for other, at, b, *q in rows:
            if job is not None and frame is not None and (job, frame) == (other, at) and a < b:
                low, high = [greater(p[i], q[i]) for i in (0, 1)], [lesser(p[i], q[i]) for i in (2, 3)]
                inter = math.prod(greater(0.0, h - k) if h is not None else 0.0 for h, k in zip(high, low))
                area = lesser(*[None if r[3] is None else (r[2] - r[0]) * (r[3] - r[1]) for r in (p, q)])
                held[job, a, b].append(inter / area if area else None)
    want = set()
    for (job, a, b), values in held.items():
        known = [v for v in values if v is not None]
        if known and len(values) >= 0.5 * min(length[job, a], length[job, b]) and statistics.median(known) >= 0.65:
            want.add((job, a, b, length[job, a], length[job, b]))
    out = tracks.twin_pairs(spark.createDataFrame(rows, "job_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double"))
    assert {tuple(r) for r in out.select("job_id", "a", "b", "na", "nb").collect()} == want and len(want) > 3
    assert "percentile" not in out._jdf.queryExecution().toString()


def test_longer_runs_are_counted_only_where_triples_are_common(spark):
    """All runs of up to six words were sent wherever all pairs are common, after sums in the task that spilled as much again."""
    draw = np.random.default_rng(2).integers(0, 12, 900)
    words = ["abcdefg"[i % 15] if i % 15 < 7 else "abcdefghijkl"[draw[i]] for i in range(900)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 30 : k * 30 + 45])) for k in range(29)], "doc_id long, text string").repartition(3)
    raw = suffix_tree.counted(docs, 3)
    pairs = suffix_tree.frequent_pairs(raw, 4, 20)
    plan = suffix_tree.runs_counted(docs, pairs, 1, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    want, sent = Counter(), suffix_tree.runs_counted(docs, pairs, 1, 3, 5).agg(F.sum("n")).first()[0]
    for (_, text) in docs.collect():
        tokens = [*text.split(), "\n"]
        want.update((n - 1, tuple(tokens[i : i + n])) for n in range(2, 7) for i in range(len(tokens) - n + 1))
    common = Counter((level, n) for (level, _), n in want.items() if n >= 4)
    tables = suffix_tree.common_runs(docs, pairs, 5, 4, 20)
    assert Counter((r.level, r.n) for t in tables for r in t.collect()) == common and {level for level, _ in common} == {1, 2, 3, 4, 5}
    triples = suffix_tree.Filter.of(tables[0].where("level = 2").select("run"), 20)
    assert suffix_tree.runs_counted(docs, triples, 2, 3, 5).agg(F.sum("n")).first()[0] < sent


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in folders for p in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_shuffles_of_stored_tables_leave_no_files(spark):
    """They stayed until the driver happened to collect its garbage, and with those of all passes took more disk than there was."""
    rows = spark.range(1000).repartition(5, "id")
    before = _shuffle_files(spark)
    plain = written(rows, "plain")
    kept = _shuffle_files(spark) - before
    table = suffix_tree.stored(rows.where("id >= 0"), "table")
    for _ in range(40):
        left = _shuffle_files(spark) - before - kept
        if not left:
            break
        time.sleep(0.25)
    assert kept and not left and table.count() == plain.count() == 1000
    assert spark.conf.get(suffix_tree.CLEANUP) == "false" and "written" not in suffix_tree.score_documents.__code__.co_names + suffix_tree.grown.__code__.co_names


def test_runs_are_sent_packed_and_triples_only_if_common(spark):
    """Each pair and triple of common pairs was a row, 81 million on half a GB, of which 5 million were left when they were summed."""
    draw = np.random.default_rng(3).integers(0, 9, 3000)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in draw[k * 100 : k * 100 + 100])) for k in range(30)] + [(30, "w0 w0 w0 " * 400), (31, None)], "doc_id long, text string").repartition(3)
    pairs = suffix_tree.frequent_pairs(suffix_tree.counted(docs, 3), 4, 20)
    triples = suffix_tree.frequent_marks(suffix_tree.triple_marks(docs, pairs, 3), 4, 20)
    want = Counter()
    for (_, text) in docs.collect():
        tokens = [*(text or "").split(), "\n"]
        want.update(tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2))
    rows = suffix_tree.runs_counted(docs, pairs, 1, 1, 2, triples)
    assert "runs#" in rows._jdf.queryExecution().toString()
    got = Counter(r.n for r in rows.where("level = 2").collect())
    common = Counter(n for n in want.values() if n >= 4)
    assert got - common == Counter({n: k for n, k in got.items() if n < 4}) and common - got == Counter() and sum(got.values()) < len(want) and max(common) > 255 * 4


def test_open_runs_meet_their_values_packed(spark):
    """They were a row each, exploded, shuffled and summed."""
    rng = np.random.default_rng(4)
    runs = rng.integers(-(1 << 63), 1 << 63, 50)
    own = [rng.choice(runs, k).tolist() for k in (0, 5, 400, 1, 90)]
    parts = spark.createDataFrame([(k + (7 << 33), bytearray(np.array(x, np.int64).tobytes())) for k, x in enumerate(own)], "row long, runs binary")
    value = {int(r): float(i + 1) for i, r in enumerate(runs[:40])}
    values = spark.createDataFrame(list(value.items()), "run long, value double")
    got = suffix_tree.open_sums(parts, values)
    want = {k + (7 << 33): s / math.log(10) for k, x in enumerate(own) if (s := sum(value.get(r, 0) for r in x))}
    assert {r.row: round(r.more, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert {r.row: round(r.more, 9) for r in suffix_tree.sliced_sums(parts, values, 3).collect()} == {k: round(v, 9) for k, v in want.items()}
    assert suffix_tree.sliced_sums(parts, values.limit(0), 0).isEmpty()
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_tokens_hashed_in_arrays_are_those_of_words():
    texts = ["Ab cd", None, "", "  x\x0b\tYé  z ", "AB\ncd ab", "a" * 3000 + " b", "\r\x0c"]
    column = pa.array([t and t.encode() for t in texts], pa.binary())
    line, place, _, text = suffix_tree.hashed_tokens(column)
    tokens, _, want = suffix_tree.tokens_of(column)
    flat = [w for t in tokens for w in t]
    assert place.tolist() == want.tolist() and line.tolist() == suffix_tree.hashes_of(flat).tolist() and len(set(line.tolist())) == len(set(flat))
    assert suffix_tree._words(text, np.arange(len(flat)), place) == flat
