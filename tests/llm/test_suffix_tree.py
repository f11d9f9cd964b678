import os
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadtally.llm import queries, suffix_tree
from roadtally.llm.common import id_crc32
from tests.llm.conftest import SCHEMA, prose, row

END = b"\n"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


class PlainTree:
    """The same tree by dictionaries over tuples of words, and the walk to the longest retained state."""

    def __init__(self, texts, depth, min_count):
        self.depth, self.words, runs = depth, Counter(), Counter()
        for t in texts:
            own = tokens(t)
            self.words.update(own)
            for n in range(2, depth + 2):
                runs.update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.nexts = defaultdict(dict)
        for run, k in runs.items():
            if k >= min_count:
                self.nexts[run[:-1]][run[-1]] = k
        self.total = {(w,): k for w, k in self.words.items()} | dict(runs)
        self.kept = {()}
        for length in range(1, depth + 1):
            for context in [c for c in self.nexts if len(c) == length and c[1:] in self.kept]:
                own, total = self.nexts[context], self.total[context]
                rest = total - sum(own.values())
                gain = sum(k * math.log(self.held(context, w) / self.p(context[1:], w)) for w, k in own.items())
                if gain + (rest * math.log(self.left(context)) if rest else 0) > 0.5 * len(own) * math.log(total):
                    self.kept.add(context)

    def left(self, context):
        own, total = self.nexts[context], self.total[context]
        return (total - sum(own.values()) + 0.75 * len(own)) / total

    def held(self, context, word):
        return max(self.nexts[context].get(word, 0) - 0.75, 0) / self.total[context] + self.left(context) * self.p(context[1:], word)

    def p(self, context, word):
        """Of the longest retained end of the context."""
        while context not in self.kept:
            context = context[1:]
        return self.held(context, word) if context else (self.words[word] + 1) / (self.n + self.v + 1)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.p(tuple(own[max(0, i - self.depth) : i]), w)) for i, w in enumerate(own))


def phrases(seed, n):
    """Words of which some always follow others."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        out += rng.choice([["in", "the", "end"], ["by", "the", "old", "oak"], ["in", "the", "old", "barn"], ["an", "old", "car"], ["an", "old", "hat"], ["at", "the", "door", "of", "the", "house"], [f"w{rng.randrange(60)}"], ["The", "end"]])
    return " ".join(out)


@pytest.mark.parametrize("cached, head, bits, depth", [(0, 1, 12, 3), (20, 10, 12, 3), (100_000, 100_000, 20, 3), (20, 10, None, suffix_tree.DEPTH)])
def test_scores_equal_a_walk_in_the_tree(spark, cached, head, bits, depth):
    texts = [phrases(i, 90) for i in range(30)] + ["", "zzz é qqq", None, "zq" * 5000, phrases(900, 400), "the end " * 40, phrases(3, 90)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    tree = PlainTree(texts[:30], depth, suffix_tree.MIN_COUNT)
    assert {len(c) for c in tree.kept} >= {0, 1, 2, 3} and len(tree.kept) < len(tree.nexts)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(docs, F.col("doc_id") < 30, depth=depth, head=head, cached=cached, filter_bits=bits).collect()}
    assert got == pytest.approx({i: tree.score(t) for i, t in enumerate(texts)}, rel=1e-9)


def test_filters_grow_with_what_they_hold():
    assert [suffix_tree.bits_for(n) for n in (0, 60_000, 3_000_000, 10**12)] == [20, 20, 26, 30]


def test_each_state_has_a_distribution():
    tree = PlainTree([phrases(i, 90) for i in range(30)], 3, 4)
    unknown = 1 / (tree.n + tree.v + 1)
    for context in sorted(tree.kept)[:40]:
        rest = unknown
        for k in range(len(context)):
            rest *= tree.left(context[k:])
        assert sum(tree.p(context, w) for w in tree.words) + rest == pytest.approx(1)


@pytest.mark.parametrize("head", [3, 100_000])
def test_base_scores(spark, odd_docs, head):
    fold = F.pmod(id_crc32(F.col("doc_id")), F.lit(7))
    out = suffix_tree.score_documents(odd_docs, fold != 2, head=head, filter_bits=14).collect()
    docs = odd_docs.collect()
    train = Counter()
    for d in docs:
        if zlib.crc32(str("" if d.doc_id is None else d.doc_id).encode()) % 7 != 2:
            train.update(tokens(d.text))
    n, v = sum(train.values()), len(train)
    want = [(d.doc_id if d.doc_id is not None else -1, len(own), sum(train[t] > 0 for t in own), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own), 6)) for d in docs for own in [tokens(d.text)]]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)


def test_scores_without_rows_or_training(odd_docs, no_docs):
    assert suffix_tree.score_documents(no_docs, F.col("doc_id") > 0, filter_bits=14).count() == 0
    assert suffix_tree.score_documents(odd_docs, F.lit(False), filter_bits=14).count() == odd_docs.count()


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    docs = spark.createDataFrame([row(i, phrases(i, 200) + prose(i, 50)) for i in range(60)], SCHEMA)
    r = suffix_tree.score_documents(docs, F.col("doc_id") % 5 != 0, filter_bits=14).where("doc_id % 5 = 0").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_totals(spark):
    """The query's own parameters."""
    rows = queries.op5_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert rows.base == pytest.approx(-234374.927, abs=0.01) and rows.score >= -225080
