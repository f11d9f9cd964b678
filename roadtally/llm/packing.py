"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity`` tokens. Two pieces of one length are
interchangeable, so the search for a packing runs on the histogram of piece lengths, which has at
most ``capacity`` rows whatever the corpus; Spark counts it, and Spark gives every piece its place
from the resulting table of patterns.

Defined results: a null text is an empty one and becomes the single closing id; repeated rows are
packed once each; an empty table gives no rows; extra columns are ignored; ties between pieces of
one length go by doc_id, piece and crc.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.llm.common import partitions, tokenizer_path, written

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Word-to-ids entries that a task keeps before it starts afresh.
CACHE_WORDS = 900_000


class IdTable(dict):
    """Strings numbered as they come, with the token ids of each."""

    def __init__(self):
        super().__init__()
        self.ids, self.used, self.done = np.zeros(1 << 16, "<u4"), 0, 0
        self.begin = self.size = np.zeros(1 << 16, np.int64)

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        return n

    def numbers(self, texts) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), np.int64)

    def new(self) -> list[str]:
        """The strings without ids, in order of their numbers."""
        return list(itertools.islice(reversed(self), len(self) - self.done))[::-1]

    def learn(self, order: np.ndarray, line: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of all new strings, one after another; order: which of the new strings each is."""
        if self.used + len(line) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(self.used + len(line), "<u4")]
        if len(self) > len(self.begin):
            self.begin, self.size = (np.r_[x[: self.done], np.zeros(2 * len(self) - self.done, np.int64)] for x in (self.begin, self.size))
        if self.begin is self.size:
            self.size = self.size.copy()
        self.ids[self.used : self.used + len(line)] = line
        self.begin[self.done + order] = self.used + np.cumsum(sizes) - sizes
        self.size[self.done + order] = sizes
        self.used += len(line)
        self.done = len(self)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered strings, one after another, and how many each has."""
        sizes = self.size[numbers]
        place = np.repeat(self.begin[numbers] - np.cumsum(sizes) + sizes, sizes)
        place += np.arange(len(place))
        return self.ids[place], sizes


class WordEncoder:
    """Token ids of texts, word by word.

    The vocabulary's splitter never joins characters across white space, nor a run of letters with
    a mark after it, so a text's ids are those of its parts one after another, and each distinct
    part is encoded once. A part of letters, with or without a mark, takes the ids of its stem; others are cut by
    the vocabulary's own pattern into pieces. New stems and pieces of characters up to U+017F need neither the vocabulary's
    normaliser nor its splitter any more and are encoded in lines: the last id of each is one that ends a word.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.splitter = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = {m: k for k, m in enumerate(self.MARKS, 1)}
        self.mark_ids = np.array([0, *(e.ids[0] for e in self.tokenizer.encode_batch(list(self.MARKS), add_special_tokens=False))], "<u4")
        self.parts, self.stems = IdTable(), IdTable()

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got))

    def _learn_stems(self) -> None:
        new = self.stems.new()
        narrow = np.array([s.isascii() or not _WIDE.search(s) for s in new], bool)
        lines, sizes = [], []
        own = list(itertools.compress(new, narrow.tolist()))
        for at in range(0, len(own), 2000):
            ids = np.array(self.plain.encode_batch_fast([" ".join(own[at : at + 2000])], add_special_tokens=False)[0].ids, "<u4")
            lines.append(ids)
            sizes.append(np.diff(np.nonzero(self.ends[ids])[0], prepend=-1))
        ids, n = self._each(list(itertools.compress(new, (~narrow).tolist())))
        self.stems.learn(np.r_[np.nonzero(narrow)[0], np.nonzero(~narrow)[0]], np.concatenate([*lines, ids]), np.concatenate([*sizes, n]))

    def _learn(self) -> None:
        new = self.parts.new()
        if not new:
            return
        marks = [self.mark.get(p[-1], 0) for p in new]
        stems = [p[:-1] if m else p for p, m in zip(new, marks)]
        good = [s.isalpha() and _DOTTED not in s for s in stems]
        numbers = self.stems.numbers([s.lower() if s.isascii() or not _WIDE.search(s) else s for s in itertools.compress(stems, good)])
        self._learn_stems()
        ids, sizes = self.stems.of(numbers)
        good = np.array(good, bool)
        mark = np.array(marks, np.int64)[good]
        sizes = sizes + (mark > 0)
        line, own = np.zeros(int(sizes.sum()), "<u4"), np.ones(int(sizes.sum()), bool)
        last = np.cumsum(sizes)[mark > 0] - 1
        own[last] = False
        line[last], line[own] = self.mark_ids[mark[mark > 0]], ids
        # other parts of letters up to U+017F are their pieces, unless a special token may be in them
        runs = np.array([not g and "<|" not in p and not _WIDE.search(p) for g, p in zip(good.tolist(), new)], bool)
        pieces = [self.splitter.findall(p.lower()) for p in itertools.compress(new, runs.tolist())]
        numbers = self.stems.numbers(itertools.chain.from_iterable(pieces))
        self._learn_stems()
        ids, n = self.stems.of(numbers)
        n = np.diff(np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum([len(x) for x in pieces], dtype=np.int64)]])
        whole = ~good & ~runs
        other, m = self._each(list(itertools.compress(new, whole.tolist())))
        self.parts.learn(np.concatenate([np.nonzero(x)[0] for x in (good, runs, whole)]), np.r_[line, ids, other], np.r_[sizes, n, m])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts, one after another, and how many each has."""
        # str.split() also parts at U+001C..U+001F, which the vocabulary takes for characters
        split = [[t] if _ODD.search(t) else (t.lower() if t.isascii() or not _WIDE.search(t) else t).split() for t in texts]
        if len(self.parts) > CACHE_WORDS:
            self.parts = IdTable()
            self.stems = self.stems if len(self.stems) < CACHE_WORDS // 2 else IdTable()
        numbers = self.parts.numbers(itertools.chain.from_iterable(split))
        self._learn()
        ids, sizes = self.parts.of(numbers)
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum([len(x) for x in split])]])


_ODD = re.compile("[\x1c-\x1f]")
#: Beyond these letters (and U+0130) the vocabulary's own rules of small letters are left to it.
_WIDE = re.compile("[^\x00-\u012f\u0131-\u017f]")
#: Its small form ends with a mark that joins what follows.
_DOTTED = "\u0130"


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: its ids' place in the document, their number and CRC."""

    def cut(batches):
        encoder = encoder_of(vocabulary)
        closing = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                ids, sizes = encoder.encode([t or "" for t in part["text"]])
                line, ends = memoryview(ids.tobytes()), 4 * np.cumsum(sizes)
                of, rows = [], []
                for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    own = line[end - 4 * n : end]
                    for piece, start in enumerate(range(0, n + 1, capacity)):  # the closing id is number n
                        crc = zlib.crc32(own[4 * start : 4 * (start + capacity)])
                        rows.append((piece, start, min(capacity, n + 1 - start), zlib.crc32(closing, crc) if n < start + capacity else crc))
                        of.append(k)
                out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").take(of).array)
                yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


# ---- the search on the histogram


@dataclass
class Packing:
    """Patterns (lengths, descending) and how many sequences follow each."""

    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.patterns)


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing, many equal pieces and equal sequences at a time."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    order: list[int] = []

    def put(left: int, pattern: tuple[int, ...], n: int) -> None:
        if left not in room or not room[left]:
            bisect.insort(order, left)
        room[left][pattern] = room[left].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fit = capacity // length
                full, rest = divmod(todo, fit)
                if full:
                    put(capacity - fit * length, (length,) * fit, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            left = order[at]
            pattern, n = next(iter(room[left].items()))
            fit = left // length
            m = min(n, todo // fit)
            if m == 0:
                m, fit = 1, todo
            del room[left][pattern]
            if n > m:
                room[left][pattern] = n - m
            elif not room[left]:
                order.pop(at)
            put(left - fit * length, pattern + (length,) * fit, m)
            todo -= m * fit
    return Packing([(p, n) for of in room.values() for p, n in of.items()])


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences by volume, or by the pieces of which no two share one, whichever is more (the L2 bound)."""
    lengths = np.nonzero(counts)[0]
    if not len(lengths):
        return 0
    n = counts[lengths].astype(np.int64)
    volume = lengths * n
    best = -(-int(volume.sum()) // capacity)
    for small in {0, *lengths[lengths <= capacity // 2].tolist()[:: max(1, len(lengths) // 64)]}:
        large = lengths > capacity - small
        middle = (lengths > capacity // 2) & ~large
        low = (lengths >= small) & (lengths <= capacity // 2)
        alone = int(n[large].sum() + n[middle].sum())
        spare = int(n[middle].sum()) * capacity - int(volume[middle].sum())
        best = max(best, alone + max(0, -(-(int(volume[low].sum()) - spare) // capacity)))
    return best


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps


def _spread(bits: int, slack: int) -> int:
    """The sums of a set of sums, each raised by 0 to slack."""
    width = 1
    while width <= slack:
        more = min(width, slack + 1 - width)
        bits |= bits << more
        width += more
    return bits


def dominated(filling: list[int], slack: int, unused: int) -> bool:
    """Whether a piece that is not in the filling could take the place of none, one smaller or several of its pieces.

    unused: bit x is set if a piece of length x is left outside.
    """
    single, several = 0, 0
    for x in filling:
        several |= (single | several) << x
        single |= 1 << x
    if unused & _spread(several | 1, slack) & ~1:
        return True
    return bool(slack and unused & (_spread(single, slack - 1) << 1))


def fillings(left: np.ndarray, room: int, sums: int, budget: Budget, largest: int = 0):
    """All undominated ways to fill up room from the histogram left (one piece of length largest is taken already), least waste first, one at a time.

    A filling is dominated if one that wastes no more leaves pieces that fit in the place of its own. sums: bit s is set
    if any number of pieces of the lengths there are can add up to s; other sums are not tried. Between two fillings left
    may change if it is put back; only the last filling is kept meanwhile, as thousands of enumerations are open at once.
    """

    def unused_by(chosen: list[int]) -> tuple[list[int], int]:
        """Lengths that fit, falling, and those of which the filling leaves a piece, as bits."""
        there = left[: room + 1] > 0
        there[0] = False
        descending = np.nonzero(there)[0][::-1].tolist()
        for x in {largest, *chosen}:
            if 0 < x <= room:
                there[x] = left[x] > (x == largest) + chosen.count(x)
        return descending, int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")

    for waste in range(room + 1):
        if not sums >> (room - waste) & 1:
            continue
        # pieces in falling order; at[k]: where to look on for piece k
        chosen, at, rest = [], [0], room - waste
        descending, unused = unused_by(chosen)
        while at:
            budget.left -= 1
            if budget.left < 0:
                return
            if not rest:
                if not dominated(chosen, waste, unused):
                    descending = unused = None
                    yield tuple(chosen)
                    descending, unused = unused_by(chosen)
                k = len(descending)
            else:
                k = at[-1]
                while k < len(descending) and (descending[k] > rest or not unused >> descending[k] & 1 or not sums >> (rest - descending[k]) & 1):
                    k += 1
            if k < len(descending):
                x = descending[k]
                at[-1] = k + 1
                at.append(k)
                chosen.append(x)
                rest -= x
                if left[x] <= (x == largest) + chosen.count(x):
                    unused &= ~(1 << x)
            else:
                at.pop()
                if chosen:
                    x = chosen.pop()
                    rest += x
                    unused |= 1 << x


def reachable(lengths: list[int], capacity: int) -> int:
    """Bit s is set if pieces of these lengths, each as often as one likes, can add up to s."""
    full, bits = (1 << (capacity + 1)) - 1, 1
    for x in lengths:
        step = x
        while step <= capacity:
            bits |= bits << step & full
            step *= 2
    return bits


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 20_000, steps: int = 400_000) -> Packing:
    """Branch and bound over the undominated fillings of the largest piece left.

    A node takes the largest length left with one of its fillings, as often as the histogram allows and
    then fewer times. A branch ends when its waste so far, or its sequences plus the bound of the rest,
    can't beat the incumbent, which starts as best fit. The search ends when it is through, when the incumbent meets
    the lower bound, or after ``nodes`` nodes or ``steps`` steps of enumeration; the incumbent is always a whole packing.
    """
    best = best_fit(counts, capacity)
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    volume = total = int((np.arange(capacity + 1) * left).sum())
    bound = lower_bound(left, capacity)
    if best.bins <= bound:
        return best
    sums = reachable([x for x, n in counts.items() if n], capacity)
    stack: list[dict] = []  # open nodes: largest length, the filling taken, how often, and those not yet tried
    bins = waste = 0
    budget = Budget(steps)

    def change(items: tuple[int, ...], m: int) -> None:
        nonlocal bins, waste, volume
        for x in items:
            left[x] -= m
        bins, waste, volume = bins + m, waste + m * (capacity - sum(items)), volume - m * sum(items)

    def advance() -> bool:
        """The next choice of the last open node that has one."""
        while stack:
            node = stack[-1]
            if node["m"]:
                change(node["items"], -1)  # one time fewer
                node["m"] -= 1
                if node["m"]:
                    return True
            filling = next(node["ways"], None)
            if filling is not None:
                node["items"] = items = (node["largest"], *filling)
                node["m"] = int(min(left[x] // n for x, n in Counter(items).items()))
                change(items, node["m"])
                return True
            stack.pop()
        return False

    for _ in range(nodes):
        if volume == 0 and bins < best.bins:
            best = Packing([(n["items"], n["m"]) for n in stack])
            if bins <= bound:
                break
        if volume and waste <= (best.bins - 1) * capacity - total and bins - (-volume // capacity) < best.bins:
            largest = int(np.nonzero(left)[0][-1])
            stack.append({"largest": largest, "ways": fillings(left, capacity - largest, sums, budget, largest), "items": (), "m": 0})
        if not advance() or budget.left < 0:
            break
    return best


# ---- giving the pieces their places


def slots(packing: Packing) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset), sorted: piece number r of a length
    lies in the last row with first rank <= r, in sequence (r - first rank) mod sequences."""
    rows, used, first = [], Counter(), 0
    for pattern, n in sorted(packing.patterns, key=lambda p: (tuple(-x for x in p[0]), p[1])):
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], n, first, offset))
            used[length] += n * copies
            offset += length * copies
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1, nodes: int = 20_000) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, vocabulary or tokenizer_path("word_bpe_49k.json"), capacity, end_id), "pieces")
    parts = partitions(spark)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    numbers = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(complete_bins(histogram, capacity, nodes))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbers.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("r") + F.col("before")).cast("long").alias("r"))
    shared = spark.sparkContext.broadcast(table)  # a few rows for each of at most capacity patterns' lengths

    def place(batches):
        t = shared.value
        key = t[:, 0] * (1 << 44) + t[:, 1]
        for batch in batches:
            length, r = batch["length"].to_numpy(np.int64), batch.pop("r").to_numpy(np.int64)
            row = t[np.searchsorted(key, length * (1 << 44) + r, "right") - 1]
            k = r - row[:, 1]
            batch["sequence_id"] = row[:, 3] + k % row[:, 2]
            batch["offset"] = row[:, 4] + k // row[:, 2] * length
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
