import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from roadtally.llm import collocations as co
from tests.llm.conftest import SCHEMA, prose, row

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, shown=co.SHOWN):
    """The contract, a phrase at a time."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: c for p, c in f.items() if c >= least}
    out = []
    for lang in n:
        found = []
        for (of, words), a in often.items():
            if of != lang or len(words) < 2:
                continue
            cuts = [(2_000_000 * a // (often[lang, words[:k]] + often[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            inside = lambda y: any(y[i : i + len(words)] == words for i in range(len(y) - len(words) + 1))
            if any(o == lang and len(y) > len(words) and inside(y) and 100 * c >= 80 * a for (o, y), c in often.items()):
                continue
            found.append((-score, -a, " ".join(words).encode(), often[lang, words[:k]], often[lang, words[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:shown])]
    return sorted(out)


def got(spark, rows, least, parts=5):
    docs = spark.createDataFrame([row(i, t)[:2] + (lang,) + row(i, t)[3:] for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)
    found = co.collocations(docs, least)
    order = co.Window.partitionBy("lang").orderBy(co.F.desc("score"), co.F.desc("a"), "phrase")
    found = found.withColumn("rank", co.F.row_number().over(order))
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, size, words=7):
    draw = np.random.default_rng(seed)
    vocabulary = ["a", "A", "b", "a\x01", "É", "é", "of", "x-y", " z", "0"][:words]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ;", "\x0b"]
    text = lambda: "".join(draw.choice(vocabulary) + draw.choice(ends, p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03]) for _ in range(draw.integers(0, 90)))
    return [(text(), draw.choice([None, "und", "en", "fr"])) for _ in range(size)] + [(None, "en"), ("", None), (" \t\n.", "de")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_counts(spark, seed):
    rows = corpus(seed, 60)
    assert got(spark, rows, 8) == plain(rows, 8)


def test_phrases_over_bounds_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 50)  # for the driver; tasks have their own
    assert [bytes(x) for x in co.chunks([b"one two", b"three. four", b"x" * 200, b"y"])] != []
    assert b"".join(co.chunks([b"one two", b"three. four", b"x" * 200, b"y"])) == b"one two\nthree. four\n" + b"x" * 200 + b"\ny"
    rows = [("a b c d " * 400, "en")] * 5 + [("a b c e " * 300, "en")] + corpus(9, 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert got(spark, rows, 30) == plain(rows, 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bounds_part_windows_in_their_order():
    data = b"the cat sat on the mat. the dog sat on the cat, a cat"
    w = co.Windows(data)
    keys, n = w.counted()
    fours = [tuple((x.split(" ")[:-1] + [""] * 4)[:4]) for x in w.written_form(keys).to_pylist()]
    assert fours == sorted(fours) and n.sum() == 14
    for bound in [*fours, ("a", "", "", ""), ("cat", "sat", "zz", ""), ("dog", "a", "b", "c"), ("zz", "", "", ""), ("", "", "", "")]:
        assert int(np.searchsorted(keys, w.bounds([bound])[0], "right" if bound in fours else "left")) == sum(x <= bound for x in fours)


def test_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in co.top_collocations(odd_docs).collect()) == plain(rows, co.LEAST)
    assert co.top_collocations(no_docs).count() == 0
    assert co.top_collocations(no_docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert co.top_collocations(odd_docs.where("text is null")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "", 4 * big), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)], "lang string, phrase string, n long")
    monkeypatch.setattr(co, "phrase_counts", lambda docs, least: counts)
    r = co.collocations(counts).first()
    assert (r.a, r.l, r.r, r.n, r.score) == (big - 7, big, big + 1, 4 * big, 2_000_000 * (big - 7) // (2 * big + 1))


def test_sql_gives_the_same_rows(spark):
    rows = corpus(5, 150, 5) + [(prose(i % 4, 60), "en") for i in range(40)]
    docs = spark.createDataFrame([row(i, t)[:2] + (lang,) + row(i, t)[3:] for i, (t, lang) in enumerate(rows)], SCHEMA)
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = sorted(tuple(r) for r in c.sql(co.ORACLE).fetchall())
    assert want and sorted(tuple(r) for r in co.top_collocations(docs).collect()) == want
