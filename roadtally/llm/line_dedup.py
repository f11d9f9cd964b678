"""Line dedup by pairwise alignment.

A document's lines become hashes. A run is the fewest consecutive lines, from a line on or up to a
line, that together reach ``min_block_words`` words. Each run links every document that holds it to
the first one that does, so a run on a third of all pages gives as many pairs as it has holders, not
their square. Every line of a block that can be deleted lies in a run inside the block, so these
pairs cover all blocks. Each pair is aligned with patience diff; aligned common blocks of
``min_block_words`` words or more are deleted from the later document, and then what alignment left:
runs of the later document that the earlier one has elsewhere (moved, or more than once). The first
holder of a run has no earlier one to lose it to, so every passage stays once.

Documents are ordered by doc_id (nulls last), then by text hash. Rows that repeat an id and a text
are one document here and keep the same lines. A null text stays null; an empty one stays empty;
lines without a word are neither compared nor deleted; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtally.llm.common import WORD, written

LAST = (1 << 63) - 1


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs (i, j) of equal lines of a and b in increasing order.

    Ranges match at both ends first, then at the longest increasing chain of the lines that are
    unique in both, and the gaps between those are aligned in the same way. None matches nothing.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] is not None and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] is not None and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        na, nb = Counter(a[i:ie]), Counter(b[j:je])
        where = {x: k for k, x in enumerate(b[j:je], j) if nb[x] == 1}
        both = [(k, where[x]) for k, x in enumerate(a[i:ie], i) if x is not None and na[x] == 1 and x in where]
        chain = _increasing(both)
        if not chain:
            continue
        ends = [(i - 1, j - 1), *chain, (ie, je)]
        out += chain
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:]) if r > p + 1 and s > q + 1]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that increases in both places; pairs come in order of the first."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        x = bisect.bisect_left(tails, j)
        tails[x : x + 1] = [j]
        at[x : x + 1] = [k]
        back[k] = at[x - 1] if x else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def removable(a: list, b: list, n_words: list[int], min_block_words: int) -> list[int]:
    """Lines of the later document b in aligned blocks that are long enough; a blank line doesn't end a block."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*aligned(a, b), (-9, -9)]:
        if last and (any(x is not None for x in b[last[1] + 1 : j]) or j < 0 or any(x is not None for x in a[last[0] + 1 : i])):
            if sum(n_words[x] for x in block) >= min_block_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out + _left_over(a, b, n_words, min_block_words, set(out))


def _left_over(a: list, b: list, n_words: list[int], min_block_words: int, gone: set[int]) -> list[int]:
    """Lines of b, not gone yet, in runs of b that a has anywhere."""
    held = {x for x in a if x is not None}
    if not any(x in held and j not in gone for j, x in enumerate(b)):
        return []
    at = [j for j, x in enumerate(b) if x is not None]
    own = np.array([b[j] for j in at], object)
    starts, ends = runs(np.array([n_words[j] for j in at]), np.zeros(len(at), int), min_block_words)
    lines = [x for x in a if x is not None]
    grams: dict[int, set[tuple]] = {}
    out: set[int] = set()
    for i, e in zip(starts.tolist(), ends.tolist()):
        if own[i] not in held or all(j in gone for j in at[i:e]):
            continue
        n = e - i
        if n not in grams:
            grams[n] = {tuple(lines[k : k + n]) for k in range(len(lines) - n + 1)}
        if tuple(own[i:e]) in grams[n]:
            out.update(at[i:e])
    return sorted(out - gone)


def runs(n_words: np.ndarray, owner: np.ndarray, min_block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end after) of the shortest runs from each line and up to each line that have enough words; lines of an owner are adjacent."""
    after = np.cumsum(n_words)
    before = after - n_words
    n = np.arange(len(n_words))
    end = np.searchsorted(after, before + min_block_words)
    start = np.searchsorted(before, after - min_block_words, "right") - 1
    i, e = np.r_[n, start], np.r_[end, n]
    inside = (i >= 0) & (e < len(n))
    i, e = i[inside], e[inside]
    same = owner[i] == owner[e]
    both = np.unique(np.stack([i[same], e[same] + 1]), axis=1)
    return both[0], both[1]


def line_table(docs: DataFrame) -> DataFrame:
    """(id, h, lines): the order key of a document and, for each of its lines, hash and words (null where it has none)."""
    text = F.col("text").cast("string")
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("x"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"), lines.alias("lines"))
    return keyed.where("lines IS NOT NULL").groupBy("id", "h").agg(F.first("lines").alias("lines"))


def run_table(table: DataFrame, min_block_words: int) -> DataFrame:
    """(id, h, x): the distinct runs of each document of a line table, as hashes."""

    def hashed(batches):
        for batch in batches:
            lines = batch.column("lines")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lines.offsets.to_numpy()))
            flat = lines.flatten()
            x, w = flat.field("x").to_numpy(zero_copy_only=False), flat.field("w").to_numpy(zero_copy_only=False)
            worded = w > 0
            x, w, owner = x[worded].view(np.uint64), w[worded].astype(np.int64), owner[worded]
            i, e = runs(w, owner, min_block_words)
            length = e - i
            value = length.astype(np.uint64)
            for k in range(int(length.max(initial=0))):
                on = length > k
                value[on] = (value[on] ^ (value[on] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[i[on] + k]
            of = pa.array(owner[i])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("h").take(of), pa.array(value.view(np.int64))], names=["id", "h", "x"])

    return table.mapInArrow(hashed, "id long, h long, x long").distinct()


def removed_lines(docs: DataFrame, min_block_words: int = 10) -> DataFrame:
    """(id, h, removed): the lines (from 0) to delete from each document that has any."""
    table = written(line_table(docs), "lines")
    held = run_table(table, min_block_words)
    shared = held.groupBy("x").agg(F.count("*").alias("n"), F.min(F.struct("id", "h")).alias("first")).where("n > 1")
    later = held.join(shared, "x").where("first < struct(id, h)")
    pairs = later.select("first.id", "first.h", F.col("id").alias("id2"), F.col("h").alias("h2")).distinct()

    @F.pandas_udf("array<int>")
    def cut(a: pd.Series, ha: pd.Series, b: pd.Series, wb: pd.Series) -> pd.Series:
        none = lambda xs, ws: [int(x) if w else None for x, w in zip(xs, ws)]
        return pd.Series([np.array(removable(none(x, v), none(y, w), list(w), min_block_words), np.int32) for x, v, y, w in zip(a, ha, b, wb)], dtype=object)

    earlier = table.select("id", "h", F.col("lines.x").alias("x1"), F.col("lines.w").alias("w1"))
    later = table.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("lines.x").alias("x2"), F.col("lines.w").alias("w2"))
    found = pairs.join(earlier, ["id", "h"]).join(later, ["id2", "h2"]).select("id2", "h2", F.explode(cut("x1", "w1", "x2", "w2")).alias("line"))
    return found.groupBy(F.col("id2").alias("id"), F.col("h2").alias("h")).agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, min_block_words: int = 10) -> DataFrame:
    """docs with the repeated blocks out of text, and a column ``removed`` of the deleted lines' numbers."""
    removed = removed_lines(docs, min_block_words).withColumnsRenamed({"id": "__id", "h": "__h", "removed": "__removed"})
    keyed = docs.withColumn("__own", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    both = keyed.join(removed, F.expr("__own = __id AND __hash = __h"), "left")
    kept = F.expr("concat_ws('\n', transform(filter(transform(split(text, '\n'), (x, i) -> struct(x AS x, i AS i)), y -> NOT array_contains(__removed, y.i)), z -> z.x))")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)
    own = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*own, F.coalesce("__removed", F.array().cast("array<int>")).alias("__removed"))
