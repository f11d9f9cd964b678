import hashlib

import pytest

from roadtally.llm import fingerprints, url_filters
from tests.llm.conftest import SCHEMA, prose, row


def plain_anchors(text, k=fingerprints.K, s=fingerprints.S):
    """Places of closed syncmers, each k-mer on its own."""
    import numpy as np

    c = [ord(x) for x in text]
    hashes = []
    for i in range(len(c) - s + 1):
        h = 0
        for x in c[i : i + s]:
            h = (h + x) * 0x100000001B3 % (1 << 64)
        hashes.append(int(fingerprints._mix(np.array([h], np.uint64))[0]))
    width = k - s + 1
    return [i for i in range(len(hashes) - width + 1) if min(hashes[i : i + width]) in (hashes[i], hashes[i + width - 1])]


@pytest.mark.parametrize("text", [prose(1, 60), "ab" * 40, "x" * 30, "ñandú " * 9, prose(2, 4)[:20]])
def test_closed_syncmers(text):
    assert fingerprints.anchors(text)[1].tolist() == plain_anchors(text)


def test_anchors_do_not_depend_on_their_context():
    a, b = prose(1, 80), prose(2, 80)
    own = set(fingerprints.anchors(a)[0].tolist())
    assert own <= set(fingerprints.anchors(b + a)[0].tolist()) and own <= set(fingerprints.anchors(a + b)[0].tolist())


def test_rows_equal_plain_order(spark, odd_docs, no_docs):
    docs = [row(i * 3 % 101, prose(i, 20 + i)) for i in range(101)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect()}
    text = {d[0]: d[1] for d in docs}
    order = sorted(text, reverse=True)
    assert len(got) == 101
    for i, d in enumerate(order):
        following = text[order[(i + 1) % len(order)]]
        want = fingerprints.edited(text[d], following)
        r = got[d]
        assert r.n_chars == len(text[d]) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.near_next == pytest.approx(fingerprints.likeness(fingerprints.fingerprint(text[d]), fingerprints.fingerprint(following)))
        assert r.near_edited > r.near_next
    rows = fingerprints.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    same = {r.fingerprint for r in rows if r.doc_id in (31, 32)}
    assert len(same) == 1
    assert fingerprints.fingerprint_documents(no_docs).count() == 0
    one = fingerprints.fingerprint_documents(odd_docs.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def plain_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "?#":
            rest = rest.split(mark)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    best = None
    for verdict, rule in url_filters.RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [None, "", "no url", "http://", "http://com/", "https://A.Example.COM/en/x?q=1", "http://www.example.com/en/", "http://xwww.example.com/en/", "http://example.com/en", "http://example.com/EN/", "http://a.net/es/1#x", "http://net/fr/", "http://b.net?x=/es/", "http://a://b.com/c", "http://é.com/en/", "http://sub.www.example.com/en/1", "http://.com/", "http://example.com./en/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[5]])] + [(None, URLS[4], "y")], "page_id long, url string, verdict string")
    rows = url_filters.judge_urls(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        url = URLS[4] if r.page_id is None else [*URLS, URLS[5]][r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url)
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_equal_digests_are_told_apart_by_their_strings(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda x: 7)
    url_filters.DigestArray.build([("block", "a.com/"), ("allow", "b.com/x"), ("block", "c.com")], str(tmp_path), "t")
    table = url_filters.DigestArray(lambda f: str(tmp_path / f), "t")
    found = table.find(["b.com/x", "a.com/", "c.com", "d.com/"])
    assert found[3] == -1 and [int(table.block[i]) for i in found[:3]] == [0, 1, 1]
    assert table.lengths.tolist() == [0, 1, 2]
