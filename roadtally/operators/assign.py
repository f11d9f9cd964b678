"""Small assignment solvers: one for whole tables of costs, one for few pairs of groups."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

FORBIDDEN = 1e6


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, every row or every column used, by shortest augmenting paths.

    Pairs at FORBIDDEN or more are left out of the result."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, last, base = start, -1, 0.0
        while True:
            step = base + cost[row] - row_price[row] - col_price
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], last
            open_ = np.where(done, np.inf, reach)
            col = int(open_.argmin())
            base = open_[col]
            done[col] = True
            if owner[col] < 0:
                break
            row, last = owner[col], col
        used = np.nonzero(done)[0]
        for c in used[used != col]:
            row_price[owner[c]] += base - reach[c]
        row_price[start] += base
        col_price[used] -= base - reach[used]
        while True:
            before = via[col]
            owner[col] = owner[before] if before >= 0 else start
            if before < 0:
                break
            col = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0 and cost[i, j] < FORBIDDEN)


def shared_out(a: list, b: list, cost: list[float], na: list[int], nb: list[int]) -> list[tuple]:
    """(a, b, n) of pairs of groups (a, b, cost) with na and nb members: as many members as can be are paired, and of those ways the one of least total cost.

    Shortest augmenting paths over the pairs that there are. A member may also stay alone at a cost beyond that of any way to pair it."""
    left, right, ways = dict(zip(a, na)), dict(zip(b, nb)), defaultdict(dict)
    least = min(cost, default=0.0)
    for i, j, c in zip(a, b, cost):
        ways[i][j] = min(c - least, ways[i].get(j, np.inf))
    alone = (max(cost, default=0.0) - least + 1) * (len(left) + len(right) + 1)
    row_price, col_price = {i: min(w.values()) for i, w in ways.items()}, defaultdict(float)
    flow = defaultdict(dict)  # of each right group, from each left one
    for start in sorted(left):
        while left[start] > 0:
            reach, rows, via, done = {}, {start: (0.0, None)}, {}, set()
            heap, end = [], (alone - row_price[start], start)  # the cheapest way to leave a member alone, and whose
            new = [start]
            while True:
                for i in new:
                    base = rows[i][0]
                    end = min(end, (base + alone - row_price[i], i))
                    for j, c in ways[i].items():
                        step = base + c - row_price[i] - col_price[j]
                        if j not in done and step < reach.get(j, np.inf):
                            reach[j], via[j] = step, i
                            heapq.heappush(heap, (step, j))
                while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                    heapq.heappop(heap)
                if not heap or heap[0][0] > end[0]:
                    last, col, row = end[0], None, end[1]
                    break
                last, col = heapq.heappop(heap)
                done.add(col)
                if right[col] > 0:
                    row = via[col]
                    break
                new = [i for i, n in flow[col].items() if n and i not in rows]
                rows |= {i: (last, col) for i in new}
            for i, (base, _) in rows.items():
                row_price[i] += last - base
            for j in done:
                col_price[j] -= last - reach[j]
            steps, at = [(row, col)], row  # from the end back to the start
            while rows[at][1] is not None:
                back = rows[at][1]
                steps += [(at, back), (via[back], back)]
                at = via[back]
            room = [flow[j][i] for i, j in steps[1::2]] + ([right[col]] if col is not None else [])
            n = min([left[start], *room])
            left[start] -= n
            for place, (i, j) in enumerate(steps):
                if j is not None:
                    flow[j][i] = flow[j].get(i, 0) + (-n if place % 2 else n)
            if col is not None:
                right[col] -= n
    return sorted((i, j, n) for j, of in flow.items() for i, n in of.items() if n)
