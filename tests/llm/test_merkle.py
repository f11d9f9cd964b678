import hashlib
import zlib
from collections import defaultdict

import pytest

from roadtally.llm import merkle
from tests.llm.conftest import SCHEMA, prose, row


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_of(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])])


def climb(nodes):
    """Root of a list of digests, and for each of them its siblings level by level as (before, after)."""
    paths, level, where = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, w in enumerate(where):
            run = w // 16 * 16
            paths[i].append(("".join(level[run:w]), "".join(level[w + 1 : run + 16])))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        where = [w // 16 for w in where]
    return level[0], paths


def plain(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, kept = [], []
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        root, paths = climb([leaf_of(r) for r in own])
        subroots.append(root)
        kept.append((own, paths))
    root, tops = climb(subroots)
    out = []
    for (own, paths), top, subroot in zip(kept, tops, subroots):
        for r, path in zip(own, paths):
            proof = path + top
            low = dict(r)
            if r["text"] is not None and zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0:
                low["text"] = "".join(c.lower() if c.isascii() else c for c in r["text"])
            node = leaf_of(low)
            for before, after in proof:
                node = h(before, node, after)
            out.append((r["doc_id"], leaf_of(r), subroot, root, h(*[b + a for b, a in proof]), node, node == root))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in merkle.verify_manifest(docs).collect()), key=str)


@pytest.mark.parametrize("lower,portion,sizes", [(3, 1024, [1, 16, 17, 40, 256, 257, 300]), (1, 2, [1, 2, 16, 17, 257, 272, 273, 600]), (1, 1, [4097 // 8, 33] + [1] * 20)])
def test_equals_a_plain_tree(spark, monkeypatch, lower, portion, sizes):
    monkeypatch.setattr(merkle, "LOWER", lower)
    monkeypatch.setattr(merkle, "BLOCK", 16**lower)
    monkeypatch.setattr(merkle, "PORTION", portion)
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            n += 1
            rows.append(row((n * 7919) % 100_003, f"Text {n} Ä" if n % 9 else None, None if s == 1 else f"s{s}"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(docs) == plain([r.asDict() for r in docs.collect()])


def test_odd_tables(spark, odd_docs, no_docs):
    assert got(odd_docs) == plain([r.asDict() for r in odd_docs.collect()])
    assert merkle.verify_manifest(no_docs).count() == 0 and merkle.verify_manifest(no_docs).columns[-1] == "verified"
    one = spark.createDataFrame([row(1, prose(1, 5))], SCHEMA)
    r = merkle.verify_manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")


def test_proofs_find_what_was_changed(spark):
    docs = spark.createDataFrame([row(i, f"Document {i}" if i % 2 else f"document {i}", "ab"[i % 2]) for i in range(100)], SCHEMA)
    for r in merkle.verify_manifest(docs).collect():
        assert r.verified == (r.doc_id % 2 == 0 or zlib.crc32(str(r.doc_id).encode()) % 5 != 0)
