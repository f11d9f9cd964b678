import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtally.llm import line_dedup, omh
from tests.llm.conftest import SCHEMA, prose, row


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("seed", range(30))
def test_banded_alignment_equals_full_alignment(seed):
    rng = random.Random(seed)
    a = rng.sample(range(1000), 60)
    b = list(a)
    for _ in range(rng.randint(0, 9)):
        k = rng.randrange(len(b))
        if rng.random() < 0.5:
            b[k] = 2000 + rng.randrange(1000)
        else:
            b.insert(k, 5000 + rng.randrange(1000))
    b = list(dict.fromkeys(b))
    m = lcs(a, b)
    full = m / (len(a) + len(b) - m)
    got = omh.alignment_similarity(np.array(a), np.array(b))
    assert got == pytest.approx(full) if full >= 0.8 else got < 0.8


def edited(words, step, tag):
    return " ".join(f"{tag}{i}" if i % step == step - 1 else w for i, w in enumerate(words))


def near_corpus():
    rows, base = [], [prose(100 + g, 300).split() for g in range(4)]
    for g, words in enumerate(base):
        rows.append(row(10 * g, " ".join(words)))
        rows += [row(10 * g + k, edited(words, 60 + 20 * k, f"z{g}{k}x")) for k in range(1, 5)]
    rows += [row(100 + i, prose(900 + i, 150)) for i in range(10)]
    # a passage that many different texts share
    passage = prose(5000, 60)
    rows += [row(200 + i, prose(700 + i, 120) + " " + passage) for i in range(12)]
    return rows


def brute_classes(rows):
    s = [omh.labelled_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        m = lcs(s[i].tolist(), s[j].tolist()) if np.intersect1d(s[i], s[j]).size else 0
        if m / max(1, len(s[i]) + len(s[j]) - m) >= 0.8:
            links.add((i, j))
            root[find(j)] = find(i)
    return {tuple(sorted(r[0] for k, r in enumerate(rows) if find(k) == find(x))) for x in range(len(rows))}, links


def test_classes_equal_brute_force(spark):
    rows = near_corpus()
    got = {}
    for r in omh.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    want, links = brute_classes(rows)
    assert len(links) >= 12
    assert {tuple(sorted(v)) for v in got.values()} == want


def test_short_texts_link_whenever_four_fifths_align(spark):
    """Texts of 1 to 30 words: every link between texts of up to 12 shingles is found, and 99 of 100 of all."""
    rng, rows = random.Random(5), [row(9000, " ".join(f"w{i}" for i in range(9))), row(9001, " ".join(f"w{i}" for i in range(8)))]
    for i in range(260):
        words = [f"{rng.choice('abcdefgh')}{i}q{k}" for k in range(1 + i % 30)]
        rows.append(row(4 * i, " ".join(words)))
        for copy in range(1, 4):
            other = list(words)
            for _ in range(copy):
                end = rng.random()
                if end < 0.4:
                    other.append(f"x{copy}")
                elif end < 0.8:
                    other = other[1:] if end < 0.6 else other[:-1]
                elif other:
                    other[rng.randrange(len(other))] = "changed"
            rows.append(row(4 * i + copy, " ".join(other)))
    out = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert out[9000] == out[9001] == 9000
    size = {r[0]: len(omh.labelled_shingles(r[1])) for r in rows}
    # only rows of one origin have words in common
    links = {k: [] for k in (True, False)}
    for at in range(2, len(rows), 4):
        own = rows[at : at + 4]
        for i, j in brute_classes(own)[1]:
            a, b = own[i][0], own[j][0]
            links[max(size[a], size[b]) <= omh.SHORT].append(out[a] == out[b])
    assert len(links[True]) > 100 and all(links[True])
    assert len(links[False]) > 100 and sum(links[False]) >= 0.99 * len(links[False])


def test_shingles_are_words_with_their_numbers():
    texts = ["a b c d e f", "", None, "a b", "x" * 3000 + " a b c d e f", " a\tb\nc d  e f ", "a b c d e a b c d e", "b a", "ab", "\u2028a b", "\x1ca b"]
    alone = [omh.labelled_shingles(t).tolist() for t in texts]
    assert [x.tolist() for x in omh.shingles_of(texts)] == alone and [len(x) for x in alone] == [2, 0, 0, 1, 3, 2, 6, 1, 1, 1, 1]
    assert alone[0] == alone[5] and alone[4][1:] == alone[0] and len({*alone[6]}) == 6 and alone[6][0] == alone[0][0]
    assert len({alone[k][0] for k in (3, 7, 8, 9, 10)}) == 5


def test_sketches_do_not_depend_on_the_batch():
    texts = [omh.labelled_shingles(prose(i, n)) for i, n in enumerate([0, 1, 5, 6, 9, 14, 16, 40, 200, 3000])]
    together = omh.sketch(texts)
    for s, got in zip(texts, together):
        assert omh.sketch([s])[0].tolist() == got.tolist()
    # the picks are the least-hashed symbols, in text order: a text without one symbol that is no pick keeps its bucket
    whole, less = set(omh.sketch([texts[8]])[0].tolist()), set(omh.sketch([np.delete(texts[8], 50)])[0].tolist())
    assert len(whole & less) >= 28


@pytest.mark.parametrize("block", [16, 2048])
def test_pairs_across_components_equal_all_pairs(spark, block):
    """Members of one bucket in many components, of like and unlike lengths, over several blocks."""
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 62, 900).astype(np.uint64)
    kept = [np.sort(rng.choice(900, rng.integers(60, 140), replace=False)) for _ in range(40)]
    kept += [np.sort(rng.choice(k, int(len(k) * rng.uniform(0.75, 0.99)), replace=False)) for k in kept for _ in range(8)]
    texts = [(i, len(k), bytearray(omh.marks_of(pool[k]))) for i, k in enumerate(kept)]
    frame = spark.createDataFrame(texts, "t long, n int, marks binary")
    members = frame.select(F.lit(7).cast("long").alias("bucket"), "t", "n")
    roots = spark.createDataFrame([(i, i % 3) for i in range(0, len(kept), 5)], "node long, root long")
    root = {i: i % 3 for i in range(0, len(kept), 5)}
    got = {(r.a, r.b) for r in omh.across_components(members, frame, roots, 0.8, block).collect()}
    want = set()
    for a, b in itertools.combinations(range(len(kept)), 2):
        if root.get(a, a) != root.get(b, b):
            m = len(np.intersect1d(kept[a], kept[b]))
            if m / (len(kept[a]) + len(kept[b]) - m) >= 0.8:
                want.add((a, b))
    assert len(want) > 50 and want <= got and len(got) < 3 * len(want)


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    out = omh.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    of = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert of[32] == of[31] == 31 and of[21] == of[20] == 20
    kept = omh.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids.count(31) == 1 and 32 not in ids and ids.count(4) == 2  # two different texts under one id
    assert omh.near_duplicates(no_docs).count() == 0 and omh.drop_near_duplicates(no_docs).count() == 0


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in omh.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("seed", range(30))
def test_patience_alignment_is_common_and_increasing(seed):
    rng = random.Random(seed)
    a = [rng.choice([None, *range(12)]) for _ in range(15)]
    b = [rng.choice([None, *range(12)]) for _ in range(15)]
    pairs = line_dedup.aligned(a, b)
    assert all(a[i] is not None and a[i] == b[j] for i, j in pairs)
    assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert len(line_dedup.aligned(a, a)) == sum(x is not None for x in a) if len(set(a)) == len(a) else True


LONG = "this passage of a dozen words or so stands in many of the documents"


def test_lines_leave_the_later_document(spark):
    docs = spark.createDataFrame([row(3, f"own three\n{LONG}\nend three"), row(1, f"own one\n{LONG}"), row(2, "short\nshort\nlines"), row(5, "short\nown five"), row(7, f"{LONG}\n\nsecond {LONG}"), row(8, f"{LONG}\nx\nsecond {LONG}")], SCHEMA)
    got = {r.doc_id: (r.text, r["__removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (f"own one\n{LONG}", [])
    assert got[3] == ("own three\nend three", [1])
    assert got[2][0] == "short\nshort\nlines" and got[5][0] == "short\nown five"
    assert got[7] == (f"\nsecond {LONG}", [0])
    assert got[8] == ("x", [0, 2])


def test_blocks_of_short_lines_with_other_first_holders_leave(spark):
    p, q = "six words are in this p", "six words are in this q"
    texts = {1: p, 2: q} | {i: f"own {i}\n{p}\n\n{q}\nend {i}" for i in range(3, 70)}
    docs = spark.createDataFrame([row(i, t) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r["__removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == got[2] == got[3] == []
    assert all([x for x in got[i] if x != 2] == [1, 3] for i in range(4, 70))


def test_moved_and_repeated_lines_leave(spark):
    one, two = f"one {LONG}", f"two {LONG}"
    texts = {1: f"{one}\na\n{two}\nb\n{one}", 2: f"c\n{two}\nd\n{one}\ne", 3: f"f\n{one}\ng\n{one}\nh"}
    docs = spark.createDataFrame([row(i, t) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r["__removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: [], 2: [1, 3], 3: [1, 3]}


@pytest.mark.parametrize("seed", range(20))
def test_removed_lines_are_those_of_all_common_blocks(seed):
    rng = random.Random(seed)
    words = {x: rng.choice([2, 4, 11]) for x in range(8)} | {None: 0}
    a, b = ([rng.choice(list(words)) for _ in range(25)] for _ in range(2))
    flat, at = [x for x in a if x is not None], [j for j, x in enumerate(b) if x is not None]
    want = set()
    for i, e in itertools.combinations(range(len(at) + 1), 2):
        block = [b[j] for j in at[i:e]]
        if sum(words[x] for x in block) >= 10 and any(flat[k : k + len(block)] == block for k in range(len(flat))):
            want.update(at[i:e])
    assert set(line_dedup.removable(a, b, [words[x] for x in b], 10)) == want


def test_line_dedup_on_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "__removed"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[20] == [None] and texts[21] == [""] and texts[22] == [" \t\n "]
    assert texts[31][0] == prose(51, 200) and len(set(texts[32])) == 1 and len(texts[32][0]) < len(texts[31][0])
    assert line_dedup.dedup_lines(no_docs).count() == 0
