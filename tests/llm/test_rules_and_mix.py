from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadtally.llm import mixing, quality_rules
from tests.llm.conftest import prose


def plain_repeats(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(inside)


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c a b c", "x x x x x", "a b c d a b c", prose(1, 300) + " " + prose(1, 40), "é\x0bé\x0cé é é é é"])
def test_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    got = quality_rules.measured(text)
    assert got[0] == len(words) and got[1] == sum(map(len, words)) and got[4] == plain_repeats(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert got[3] == len(lines) - len(set(lines))


def test_ledger_keeps_rows_and_columns(odd_docs, no_docs):
    kept = quality_rules.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 30}
    assert not {r.doc_id for r in kept.collect()} & {20, 21, 22}
    assert quality_rules.ledger(odd_docs, "ledger").count() == odd_docs.count()
    assert quality_rules.filter_documents(no_docs).count() == 0


def test_ablations(spark):
    bits = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "fail_bits long")
    got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in quality_rules.ablations(bits).collect()}
    assert got["min_words"] == (3, 2, 3) and got["repeat_words"] == (1, 0, 1) and got["symbol_words"] == (1, 1, 2) and got["run_words"] == (0, 0, 1)


def test_stored_ledger_serves_all_policies(spark, odd_docs, no_docs):
    """Policies, ablations and comparisons of the stored ledger against each document's own verdicts; no text is stored."""
    stored = quality_rules.store_ledger(odd_docs)
    assert stored.columns == ["doc_id", "rules"] and "FileScan parquet" in stored._jdf.queryExecution().executedPlan().toString()
    bits = [quality_rules_bits(r.text) for r in odd_docs.collect()]
    assert sorted(r[0] for r in stored.select("rules.fail_bits").collect()) == sorted(bits)
    kept = {p: [b & quality_rules.mask(p) == 0 for b in bits] for p in quality_rules.POLICIES}
    got = {(r.policy, r.other): tuple(r)[2:] for r in quality_rules.compare_policies(stored.select("rules.fail_bits")).collect()}
    assert set(got) == {("base", "v1"), ("base", "v2"), ("v1", "v2")}
    for (p, q), counts in got.items():
        a, b = kept[p], kept[q]
        assert counts == (sum(a), sum(b), sum(x and not y for x, y in zip(a, b)), sum(y and not x for x, y in zip(a, b)))
    whole = quality_rules.mask("v2")
    for r in quality_rules.ablations(stored.select("rules.fail_bits"), "v2").collect():
        bit = quality_rules.mask((r.rule,))
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit != 0 for b in bits), sum(b & whole == bit for b in bits), sum(b & whole in (0, bit) for b in bits))
    empty = quality_rules.store_ledger(no_docs).select("rules.fail_bits")
    assert quality_rules.ablations(empty).count() == 9 and quality_rules.compare_policies(empty).count() == 0


def quality_rules_bits(text):
    """Failed rules of one text by Python's arithmetic on its measurements."""
    names = [x.split()[0] for x in quality_rules.MEASURES.split(", ")]
    values = dict(zip(names, quality_rules.measured(text)))
    return sum(1 << k for k, rule in enumerate(quality_rules.RULES.values()) if eval(rule.replace("AND", "and"), {}, values))


def water_fill(sizes):
    """Targets by resharing what is above, step by step."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, full = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while left > 1e-9 and len(full) < len(names):
        share = left / sum(weight[s] for s in names if s not in full)
        left = 0.0
        for s in names:
            if s not in full:
                target[s] += share * weight[s]
                if target[s] >= 2 * sizes[s]:
                    left += target[s] - 2 * sizes[s]
                    target[s] = 2.0 * sizes[s]
                    full.add(s)
    return target


def test_mix(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns[:-1] == odd_docs.columns
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        m = r["__mix"]
        assert m.size == len((r.text or "").encode().split()) and m.taken <= 2 * m.size
        sizes[r.source] += m.size
        taken[r.source] += m.taken
        target[r.source] = m.target
        largest[r.source] = max(largest[r.source], m.size)
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = mixing.mix(odd_docs.repartition(5))
    key = lambda d: sorted((r.doc_id or -1, r.text or "", r["__mix"].taken) for r in d.collect())
    assert key(out) == key(again)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mixed_documents(odd_docs).count() == sum(r["__mix"].copies for r in rows)


def test_no_words_at_all(spark, odd_docs):
    assert all(r["__mix"].taken == 0 for r in mixing.mix(odd_docs.withColumn("text", F.lit(" "))).collect())
