import itertools
import random
import zlib

import numpy as np
import pytest

from roadtally.llm import packing
from roadtally.llm.common import tokenizer_path


def fewest(lengths, capacity):
    """Optimum by trying every assignment in order of length."""
    best = [len(lengths)]

    def put(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for r in {x for x in room if x >= lengths[i]}:
            k = room.index(r)
            put(i + 1, room[:k] + [r - lengths[i]] + room[k + 1 :])
        put(i + 1, [*room, capacity - lengths[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 30) for _ in range(9)), reverse=True)
    counts = {x: lengths.count(x) for x in lengths}
    packed = packing.complete_bins(counts, 30)
    assert packed.bins == fewest(lengths, 30)
    used = {}
    for pattern, n in packed.patterns:
        assert sum(pattern) <= 30
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_a_packing_that_needs_mixed_fillings():
    lengths = [56, 45, 40, 33, 31, 29, 27, 26, 26, 26, 25, 22]
    assert packing.complete_bins({x: lengths.count(x) for x in lengths}, 100).bins == 4


def test_a_thousand_small_cases_are_optimal():
    rng = random.Random(77)
    for _ in range(1000):
        n, top = rng.randint(4, 10), rng.choice((8, 14, 25))
        lengths = sorted((rng.randint(1, top) for _ in range(n)), reverse=True)
        assert packing.complete_bins({x: lengths.count(x) for x in lengths}, 25).bins == fewest(lengths, 25), lengths


def test_fillings_are_the_undominated_sets():
    rng = random.Random(4)
    for _ in range(60):
        pieces = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        room = rng.randint(1, 20)
        counts = np.bincount(pieces, minlength=room + 1)
        got = list(packing.fillings(counts, room, packing.reachable(sorted(set(pieces)), room), packing.Budget(100_000)))
        waste = [room - sum(f) for f in got]
        assert waste == sorted(waste) and len(set(got)) == len(got)
        sets = {tuple(sorted(c, reverse=True)) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= room}

        def beaten(own):
            """Some set keeps a part of own and puts one other piece in the place of the rest, which is smaller or several."""
            outside = list(pieces)
            for x in own:
                outside.remove(x)
            parts = {c for k in range(len(own) + 1) for c in itertools.combinations(own, k)}
            return any(sum(c) <= x <= sum(c) + room - sum(own) and (len(c) != 1 or c[0] < x) for c in parts for x in outside)

        assert set(got) == {s for s in sets if not beaten(s)}


def test_large_histograms_reach_the_bound():
    rng = random.Random(5)
    counts = {rng.randint(1, 4096): rng.randint(1, 5000) for _ in range(800)}
    packed = packing.complete_bins(counts, 4096)
    array = np.zeros(4097, np.int64)
    for k, v in counts.items():
        array[k] = v
    assert packing.lower_bound(array, 4096) <= packed.bins <= packing.best_fit(counts, 4096).bins
    assert packed.bins <= 1.01 * packing.lower_bound(array, 4096)


def test_encoder_equals_tokenizer():
    encoder = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["", " ", "İstanbul a’b it's don't x.y. A.B, “quoted” ２３ 12a", "a\x1cb c", "é fóo.", "ΣΑΣ ΟΔΟΣ. ΟΔΟΣ", "word! wo'll 'Tis we've.", "ﬁ ǅ. ß ㍿", "漢字 かな", "a\u0085b\u2003c"] * 2
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new, and known
        ids, sizes = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_encoder_equals_tokenizer_on_any_text():
    encoder, rng = packing.WordEncoder(tokenizer_path("word_bpe_49k.json")), random.Random(8)
    letters = "abcdefgABCXYZ ,.!?'0129-\n\t" + "éüßñÅŁſĲœ" + "ΣİǅΩжДß漢\u0301\u0130\u2028\x1c"
    for _ in range(30):
        texts = ["".join(rng.choice(letters[: rng.choice((20, 35, 60))]) for _ in range(rng.randrange(60))) for _ in range(40)]
        ids, sizes = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_places(rows):
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_pack(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    check_places(rows)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for d in odd_docs.collect():
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        want += [(d.doc_id or -1, p, p * 4096, len(ids[p * 4096 :][:4096]), zlib.crc32(np.array(ids[p * 4096 :][:4096], "<u4").tobytes())) for p in range(-(-len(ids) // 4096))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack(no_docs).collect() == []
