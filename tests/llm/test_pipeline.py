import itertools
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from roadtally.llm import line_dedup, quality_rules
from tests.llm.conftest import SCHEMA, prose, row
from tests.llm.test_duplicates import brute_classes, edited, near_corpus
from tests.llm.test_packing import check_places
from tests.llm.test_rules_and_mix import water_fill


def test_stages_keep_columns_and_rows_they_should(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs.unionByName(spark.createDataFrame([(r[0] + 1000, *r[1:]) for r in near_corpus()], SCHEMA))
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
    packed = corpus_pipeline.STAGES[-1][1](spark, own, str(tmp_path)).collect()
    check_places(packed)
    assert {r.doc_id for r in packed} <= {r.doc_id for r in own.collect()}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    no_docs.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def lines_left(texts, least=10):
    """Each text without the lines of blocks of ``least`` words or more that stand, as a block, in any text before it."""
    out = []
    for at, text in enumerate(texts):
        lines = text.split("\n")
        own, gone = [j for j, x in enumerate(lines) if x.split()], set()
        for other in texts[:at]:
            flat = [x for x in other.split("\n") if x.split()]
            for i, e in itertools.combinations(range(len(own) + 1), 2):
                block = [lines[j] for j in own[i:e]]
                if sum(len(x.split()) for x in block) >= least and any(flat[k : k + len(block)] == block for k in range(len(flat))):
                    gone.update(own[i:e])
        out.append("\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_line_dedup_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{k}" for k in range(rng.choice([3, 5, 6, 12]))) for i in range(9)] + ["", " "]
    texts = ["\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randint(1, 12))) for i in range(14)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    # blank lines may go with a block; words and their order tell
    assert {i: t.split() for i, t in got.items()} == {i: t.split() for i, t in enumerate(lines_left(texts))}


def test_stages_equal_plain_ones(spark, tmp_path):
    rng, rows = random.Random(11), []
    for g in range(4):
        words = prose(300 + g, 260).split()
        rows += [row(10 * g, " ".join(words), "abc"[g % 3])] + [row(10 * g + k, edited(words, 50 + 20 * k, f"y{g}{k}x"), "bca"[k % 3]) for k in range(1, 4)]
    pool = [" ".join(f"line{i}w{k}" for k in range(rng.choice([4, 6, 13]))) for i in range(7)]
    for i in range(50, 64):
        own = ["\n".join([" ".join(prose(4000 + 10 * i + k, 40).split()), rng.choice(pool)]) for k in range(4)]
        rows.append(row(i, "\n".join(own), "abc"[i % 3]))
    rows += [row(80, "too short a text"), row(81, "again and " * 60), row(82, None), row(83, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = {i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({quality_rules.oracle_sql()})").fetchall() if kept}
    stages, out = dict(corpus_pipeline.STAGES), {}
    own = docs
    for name in ("quality_rules", "line_dedup", "near_dedup", "source_mix"):
        own = stages[name](spark, own, str(tmp_path))
        own.write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
        out[name] = sorted(own.collect(), key=lambda r: r.doc_id)
    first = {r.doc_id: r.text for r in out["quality_rules"]}
    assert set(first) == want and not want & {80, 81, 82, 83} and len(want) == len(rows) - 4
    second = {r.doc_id: r.text for r in out["line_dedup"]}
    assert {i: t.split() for i, t in second.items()} == {i: t.split() for i, t in zip(sorted(first), lines_left([first[i] for i in sorted(first)]))}
    assert sum(len(t) for t in second.values()) < sum(len(t) for t in first.values())
    classes, links = brute_classes([row(r.doc_id, r.text) for r in out["line_dedup"]])
    third = {r.doc_id for r in out["near_dedup"]}
    assert links and all(len(third & set(c)) == 1 for c in classes) and len(third) == len(classes)
    sizes, taken = Counter(), Counter()
    for r in out["near_dedup"]:
        sizes[r.source] += len(r.text.split())
    for r in out["source_mix"]:
        taken[r.source] += len(r.text.split())
    largest = max(len(r.text.split()) for r in out["near_dedup"])
    assert {r.doc_id for r in out["source_mix"]} <= third
    assert all(abs(taken[s] - target) <= 2 * largest for s, target in water_fill(sizes).items())
    assert max(Counter(r.doc_id for r in out["source_mix"]).values()) <= 2
    packed = stages["packing"](spark, own, str(tmp_path)).collect()
    check_places(packed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in out["source_mix"]}
