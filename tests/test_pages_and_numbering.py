"""Pages of the review queue, even samples and numberings of accesses against plain versions."""

import itertools
import random
from datetime import datetime, timedelta

import pytest

from roadtally.operators import calibrate, review

DAY = datetime(2024, 3, 1, 6)


def reason_rows(seed: int, n: int = 300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = None if rng.random() < 0.05 else DAY + timedelta(minutes=rng.choice([0, 1, 59, 60, 61, 500, 3000]), seconds=rng.choice([0, 0, 30]))
        site = rng.choice([1, 1, 1, 2, None])
        revised = "C" if rng.random() < 0.1 else None
        rows += [(i, site, ts, revised, r) for r in rng.sample(list(review.PRIORITY), rng.randint(1, 3))]
    return rows


@pytest.mark.parametrize("start,limit", [(0, 40), (35, 7), (140, 40), (10_000, 40), (0, 1)])
def test_queue_pages(spark, start, limit):
    rows = reason_rows(start)
    got = review.review_queue(spark.createDataFrame(rows, "id int, project_id int, ts timestamp, clase_revisada string, reason string"), start, limit)
    want = []
    for site in (1, 2, None):
        own = {}
        for i, s, ts, revised, reason in rows:
            if s == site and revised is None:
                own.setdefault((i, ts), []).append(reason)
        queue = sorted((min(review.PRIORITY[r] for r in rs), ts is not None, ts or DAY, i, tuple(sorted(rs))) for (i, ts), rs in own.items())
        want += [(site, i, p, rs, k, len(queue)) for k, (p, _, _, i, rs) in enumerate(queue, 1) if start < k <= start + limit]
    assert sorted(((r.project_id, r.id, r.priority, tuple(r.reasons), r.place, r.total) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n,quota", [(0, 20), (7, 20), (20, 20), (39, 20), (400, 20), (997, 13)])
def test_even_samples(spark, n, quota):
    rng = random.Random(n)
    rows = [(i, rng.choice([1, 1, 1, None]), None if rng.random() < 0.02 else DAY + timedelta(seconds=rng.choice([0, 5, 3599, 3600, 90_000]) + rng.randint(0, 3))) for i in range(n)]
    got = review.even_sample(spark.createDataFrame(rows, "id int, lane_id int, ts timestamp"), ["lane_id"], ["ts", "id"], quota)
    want = []
    for lane in (1, None):
        own = sorted((t is not None, t or DAY, i) for i, key, t in rows if key == lane)
        step = max(1, len(own) // quota)
        want += [i for _, _, i in own[::step][:quota]]
    assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == ["id", "lane_id", "ts"]


def plain_numbering(ours, hand, numbers, accesses):
    best = None
    for way in itertools.product(numbers, repeat=len(accesses)):
        name, left = dict(zip(accesses, way)), {}
        for o, d, n in ours:
            if o in name and d in name:
                left[name[o], name[d]] = left.get((name[o], name[d]), 0) + n
        for ho, hd, n in hand:
            left[ho, hd] = left.get((ho, hd), 0) - n
        error = sum(abs(v) for v in left.values())
        if best is None or error < best[0]:
            best = (error, ",".join(map(str, way)))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_numbering_is_the_least_error_in_product_order(spark, seed, monkeypatch):
    monkeypatch.setattr(calibrate, "WAYS", 7)  # several blocks
    rng = random.Random(seed)
    numbers, accesses = [1, 2, 4], [10, 20, 30, 40]
    pairs = list(itertools.product([*accesses, 99], repeat=2))
    ours = {s: [(o, d, rng.randint(1, 30)) for o, d in rng.sample(pairs, 9)] for s in (1, 2)}
    hand = {s: [(a, b, rng.randint(1, 30)) for a, b in itertools.product(numbers, repeat=2) if rng.random() < 0.8] for s in (1, 3)}
    hand[1].append((1, 7, 5))  # a number that no access can have
    got = calibrate.best_numbering(
        spark.createDataFrame([(s, *x) for s, v in ours.items() for x in v], "project_id int, o int, d int, n long"),
        spark.createDataFrame([(s, *x) for s, v in hand.items() for x in v], "project_id int, ho int, hd int, n_hand long"), numbers, accesses)
    assert {r.project_id: (r.error, r.assignment) for r in got.collect()} == {s: plain_numbering(ours.get(s, []), hand.get(s, []), numbers, accesses) for s in (1, 2, 3)}
