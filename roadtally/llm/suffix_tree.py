"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased words and one closing mark. A context is a run of at most ``depth`` words;
its next-symbol distribution holds the words that followed it ``min_count`` times or more,
discounted, and leaves the rest of its weight to the context one word shorter, down to the add-one
unigram distribution (which is the base score). The tree grows level by level: a context is looked at
only below a retained shorter one, and is retained if the divergence of its distribution from the
shorter context's, times its count, is worth half a logarithm of its count for each word it holds.
A word is scored in the state of the longest retained context that ends what stands before it.

With T the longest retained context, log p(w) is log p0(w), plus a context's log share of left
weight for each retained suffix of T, plus for each of these that holds w the logarithm of what holding it
changes. Each term belongs to one run of words, so a text's score is the base score plus a sum of
``values`` over its runs: Spark makes one table (run, value), tasks add up the commonest runs
from a bounded cache, a Bloom filter sized by their number drops runs that are in no table, and what is
left is looked up in slices of the table or, if it has too many, joined. Cache, slices and filters change no score. Runs are known by 64-bit hashes of their words.

Words are counted exactly, by their bytes; the hashes of the ``head`` commonest go to every task, others are joined by their bytes.
Most pairs of words are rarer than ``min_count``, and so are most triples. To leave these out before they are shuffled as rows, the first
pass sends 32-bit marks of pairs, packed by range; marks that come ``min_count`` times or more make a
Bloom filter, and the second pass sends marks of the triples all of whose pairs pass it, which make another one. The third pass counts
the pairs that pass the first filter and the longer runs all of whose triples pass the second. A full filter would let all pass.

Defined results: a null or empty text has one token, the end; with no training text every count is
0; repeated rows get equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtally.llm.common import drop_written, partitions, written

#: Words of the longest context. A stated bound: held-out log10 totals are -225184, -225080 and -225077 with 2, 3 and 5 words (sf0.01).
DEPTH = 5
MIN_COUNT = 4
DISCOUNT = 0.75
#: Words and runs that tasks hold. Scores do not depend on them.
HEAD, CACHED = 120_000, 1_500_000
#: What the cache does not hold is sent to all tasks in so many slices of its size at most; if there is more, it is joined by range.
SLICES = 8
#: Bits of a filter for each run that it is made for, and the binary logarithm of its least and greatest size in bits.
BITS_A_RUN, LEAST_BITS, MOST_BITS = 16, 20, 30
END = b"\n"
#: Words and places that a task holds before it hands them on: two such tasks must fit beside an executor's heap.
HELD = 500_000
#: Marks, and runs, that a task holds before it sums them and hands them on: 4 and 24 bytes each.
MARKS_HELD, RUNS_HELD = 4_000_000, 1_000_000
#: Texts taken at a time: as Python words, and as hashes in arrays over all their bytes.
TEXTS, HASHED = 256, 64
#: Files of a shuffle go when the table made of it is written, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """written(), after which no files of its shuffles are left on disk: what is stored is read from the table alone."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, label)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def lowered(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, which is what bytes.lower() does."""
    return text.lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run from those of the run without its last word and without its first."""
    return _mix(_mix(a) * np.uint64(0xD1342543DE82EF95) + b)


def _letters() -> np.ndarray:
    """A number for each byte of a word: nothing for what parts words, and capital letters as small ones."""
    out = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
    out[[0x20, *range(9, 14)]] = 0
    out[65:91] = out[97:123]
    return out


LETTERS, END_HASH = _letters(), np.uint64(0x5851F42D4C957F2D)
IN_WORD = LETTERS != 0
#: An odd number and its inverse modulo 2 to the 64th, and their powers as far as they were needed.
RATES = (0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_edges(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and where it has ended."""
    inside = np.r_[False, IN_WORD[np.frombuffer(flat, np.uint8)], False]
    edge = np.nonzero(inside[1:] != inside[:-1])[0]
    return edge[::2], edge[1::2]


def hashed_words(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash: its letters' numbers as a polynomial, taken from sums over all bytes."""
    b = np.frombuffer(flat, np.uint8)
    if len(b) > len(_powers[0]):
        for k, rate in enumerate(RATES):
            p = np.full(1 << len(b).bit_length(), rate, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    start, end = word_edges(flat)
    total = np.r_[np.uint64(0), np.cumsum(LETTERS[b] * _powers[0][: len(b)])]
    return start, _mix(_mix((total[end] - total[start]) * _powers[1][start]))


def hashed_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of the tokens of all texts, each token's place in its text, how many each text has, and the texts in a line."""
    texts = [t or b"" for t in column.to_pylist()]
    flat = b"\n".join([*texts, b""])
    start, x = hashed_words(flat)
    end = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])) + np.arange(len(texts))
    line, word = np.full(len(x) + len(texts), END_HASH), np.ones(len(x) + len(texts), bool)
    word[end] = False
    line[word] = x
    size = np.diff(np.r_[-1, end])
    return line, np.arange(len(line)) - np.repeat(end + 1 - size, size), size, flat


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The same hashes of tokens."""
    out, word = np.full(len(words), END_HASH), np.array([w != END for w in words], bool)
    out[word] = hashed_words(b"\n".join(words))[1]
    return out


class Numbers(dict):
    """Words numbered as they come, with arrays by number."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.done = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of all words of the texts, and the words that are new."""
        line = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        new = list(itertools.islice(reversed(self), len(self) - self.done))[::-1]
        if len(self) > len(self.hashes):
            self.hashes = np.r_[self.hashes, np.zeros(len(self), np.uint64)]
        self.hashes[self.done : len(self)] = hashes_of(new)
        self.done = len(self)
        return line, new


def tokens_of(column: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Tokens of each text, their numbers, and each token's place in its text."""
    texts = [[*lowered(t), END] for t in column.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    return texts, sizes, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def bits_for(n: int) -> int:
    """Size of the filter of n runs. From 67 million runs on it stays at 128 MB and lets more runs pass that are in no table, which costs time alone."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_A_RUN * n).bit_length()))


class Filter:
    """A Bloom filter of runs, of one probe."""

    def __init__(self, words: DataFrame, bits: int):
        """words: (at, word), the 64-bit words that are not zero."""
        got = words.toArrow()
        whole = np.zeros(1 << (bits - 6), np.int64)
        whole[got.column("at").to_numpy()] = got.column("word").to_numpy()
        self.bits, self.table = bits, whole.view(np.uint8)

    @classmethod
    def of(cls, runs: DataFrame, bits: int | None = None) -> Filter:
        bits = bits or bits_for(runs.count())

        def words(batches):
            for batch in batches:
                yield _filter_words(slot(batch.column(0).to_numpy().view(np.uint64), bits))

        return cls(runs.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")), bits)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = slot(x, self.bits)
        return ((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _filter_words(slots: np.ndarray) -> pa.RecordBatch:
    slots = np.unique(slots)
    at = slots >> 6
    start = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0] if len(at) else np.zeros(0, np.int64)
    word = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), start) if len(at) else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(at[start]), pa.array(word.view(np.int64))], names=["at", "word"])


def slot(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


# ---- counting


COUNTED = "word binary, h long, n long, part int, marks binary"


def counted(train: DataFrame, part_bits: int) -> DataFrame:
    """Words of a task with their hashes and counts, and (part null otherwise) packed marks of its pairs: 4 bytes each, then a count in one byte each."""

    def words(numbers, seen):
        n = len(seen)
        arrays = [pa.array(list(numbers), pa.binary()), pa.array(numbers.hashes[:n].view(np.int64)), pa.array(seen), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "h", "n", "part", "marks"])

    def marks(pairs):
        part, packed = _packed(pairs, part_bits)
        none = [pa.nulls(len(packed), t) for t in (pa.binary(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, part, packed], names=["word", "h", "n", "part", "marks"])

    def count(batches):
        numbers, seen, pairs, held = Numbers(), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                texts, _, place = tokens_of(batch.column("text").slice(at, TEXTS))
                line, _ = numbers.of(texts)
                n = np.bincount(line, minlength=len(numbers))
                n[: len(seen)] += seen
                seen = n
                run = numbers.hashes[line]
                pairs.append(mark(joined(run[:-1], run[1:])[place[1:] > 0]))
                held += len(line)
                if held > MARKS_HELD:
                    yield marks(pairs)
                    pairs, held = [], 0
                if len(numbers) > HELD:
                    yield words(numbers, seen)
                    numbers, seen = Numbers(), np.zeros(0, np.int64)
        if pairs:
            yield marks(pairs)
        if len(seen):
            yield words(numbers, seen)

    return _texts(train).select("text").mapInArrow(count, COUNTED)


def mark(x: np.ndarray) -> np.ndarray:
    """32-bit marks of runs."""
    return slot(x, 32).astype(np.uint32)


def _packed(marks: list[np.ndarray], part_bits: int) -> tuple[pa.Array, pa.Array]:
    """Ranges and their distinct marks: 4 bytes each, then a count in one byte each."""
    x = np.sort(np.concatenate(marks))
    start = np.nonzero(np.r_[True, x[1:] != x[:-1]])[0] if len(x) else np.zeros(0, np.int64)
    n = np.minimum(np.diff(np.r_[start, len(x)]), 255).astype(np.uint8)
    x = x[start]
    ends = np.searchsorted(x, (np.arange(1, 1 << part_bits) << (32 - part_bits)).astype(np.uint32)).tolist() + [len(x)]
    packed = [x[i:e].astype("<u4").tobytes() + n[i:e].tobytes() for i, e in zip([0, *ends], ends)]
    return pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(packed, pa.binary())


def triple_marks(train: DataFrame, pairs: Filter, part_bits: int) -> DataFrame:
    """(part, marks) of the triples both of whose pairs pass the filter."""
    shared = train.sparkSession.sparkContext.broadcast(pairs)

    def count(batches):
        found, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED):
                run, place, _, _ = hashed_tokens(batch.column("text").slice(at, HASHED))
                run = joined(run[:-1], run[1:])
                good = place[1:] >= 1
                good[good] = shared.value.has(run[good])
                on = np.nonzero(good[:-1] & good[1:])[0]
                found.append(mark(joined(run[on], run[on + 1])))
                held += len(on)
                if held > MARKS_HELD:
                    yield pa.RecordBatch.from_arrays(list(_packed(found, part_bits)), names=["part", "marks"])
                    found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(_packed(found, part_bits)), names=["part", "marks"])

    return _texts(train).select("text").mapInArrow(count, "part int, marks binary")


def frequent_marks(raw: DataFrame, min_count: int, bits: int | None) -> Filter:
    """The filter of the pairs, or triples, whose marks come min_count times or more; these are written first, and their number gives its size."""

    def merge(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint8) for x in table.column("marks").to_pylist()]
        x = np.concatenate([p[: len(p) // 5 * 4].view("<u4") for p in own])
        n = np.concatenate([p[len(p) // 5 * 4 :] for p in own]).astype(np.int64)
        order = np.argsort(x)
        x, n = x[order], n[order]
        start = np.nonzero(np.r_[True, x[1:] != x[:-1]])[0] if len(x) else np.zeros(0, np.int64)
        often = x[start][np.add.reduceat(n, start) >= min_count] if len(x) else x
        return pa.table({"mark": pa.array(often.astype(np.int64))})

    found = stored(raw.where("part IS NOT NULL").select("part", "marks").groupBy("part").applyInArrow(merge, "mark long"), "marks")
    bits = bits or bits_for(found.count())

    def words(batches):
        for batch in batches:
            yield _filter_words(batch.column(0).to_numpy() >> (32 - bits))

    often = Filter(found.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")), bits)
    drop_written(found)
    return often


frequent_pairs = frequent_marks


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def runs_counted(train: DataFrame, often: Filter, known: int, first: int, depth: int, triples: Filter | None = None, least: int = 1) -> DataFrame:
    """(level, a, b, n, run), with n of at least least, of runs of level + 1 words, from level first to depth, all of whose runs of level known pass the filter, and all of whose triples pass
    theirs if it is given; a and b are the hashes of a run without its last word and without its first. They are sent packed by range of the run's hash."""
    bits = part_bits(train)
    shared = train.sparkSession.sparkContext.broadcast({known: often} | ({2: triples} if triples else {}))

    def count(batches):
        found, held = [[] for _ in range(depth + 1)], 0

        def flush():
            for level in range(first, depth + 1):
                x, a, b = (np.concatenate(y) for y in zip(*found[level]))
                found[level].clear()
                x, at, n = np.unique(x, return_index=True, return_counts=True)
                again = (n - 1) // 255 + 1  # a count is one byte; greater ones go in pieces
                x, at, n = np.repeat(x, again), np.repeat(at, again), np.repeat(n - 255 * (again - 1), again)
                n[np.nonzero(x[1:] == x[:-1])[0]] = 255
                packed = [a[k].tobytes() + b[k].tobytes() + c.tobytes() for k, c in _ranges(x, bits, at, n.astype(np.uint8))]
                columns = [np.full(len(packed), level, np.int32), np.arange(len(packed), dtype=np.int32), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "part", "runs"])

        filters = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED):
                run, place, _, _ = hashed_tokens(batch.column("text").slice(at, HASHED))
                good = None
                for level in range(1, depth + 1):
                    longer = joined(run[:-1], run[1:])
                    good = place[level:] >= level if good is None else good[:-1] & good[1:]
                    if level in filters:
                        good[good] = filters[level].has(longer[good])
                    elif level < known:
                        good = None
                    if level >= first:
                        on = np.nonzero(good)[0]
                        found[level].append((longer[on], run[on], run[on + 1]))
                        held += len(on)
                    run = longer
                if held > RUNS_HELD:
                    yield from flush()
                    held = 0
        if found[first]:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        own = [(np.frombuffer(x, np.uint64, len(x) // 17 * 2), np.frombuffer(x, np.uint8, offset=len(x) // 17 * 16)) for x in table.column("runs").to_pylist()]
        a, b = (np.concatenate([x[i * len(n) : (i + 1) * len(n)] for x, n in own]) for i in (0, 1))
        n = np.concatenate([n for _, n in own]).astype(np.int64)
        x = joined(a, b)
        order = np.argsort(x)
        start = np.nonzero(np.r_[True, x[order[1:]] != x[order[:-1]]])[0] if len(x) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[order], start) if len(x) else n
        at = order[start[n >= least]]
        level = np.full(len(at), table.column("level")[0].as_py(), np.int32)
        return pa.table([pa.array(y) for y in (level, *(z[at].view(np.int64) for z in (a, b)), n[n >= least], x[at].view(np.int64))], names=["level", "a", "b", "n", "run"])

    # dealt before they are summed: runs of a task are summed in arrays above, and a row for each run cost Spark more than all reading of texts
    part = _texts(train).select("text").mapInArrow(count, "level int, part int, runs binary").repartition(partitions(train.sparkSession), "level", "part")
    return part.groupBy("level", "part").applyInArrow(merge, "level int, a long, b long, n long, run long")


def _ranges(x: np.ndarray, bits: int, *columns: np.ndarray):
    """The columns cut at the ranges of the sorted hashes x."""
    ends = [0, *np.searchsorted(x, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(x)]
    return [tuple(c[i:e] for c in columns) for i, e in itertools.pairwise(ends)]


def common_runs(train: DataFrame, pairs: Filter, depth: int, min_count: int, filter_bits: int | None = None) -> list[DataFrame]:
    """Tables (level, a, b, n, run) of all runs with min_count occurrences or more. A run has no more than each shorter one in it, so runs of three
    words or more are looked for only where all three words on end are common by their marks; before, triples were sent wherever all pairs are."""
    triples = frequent_marks(triple_marks(train, pairs, part_bits(train)), min_count, filter_bits) if depth > 1 else None
    return [stored(runs_counted(train, pairs, 1, 1, depth, triples, min_count), "runs")]


def part_bits(rows: DataFrame) -> int:
    """Binary logarithm of the number of ranges of marks."""
    return max(2, (2 * partitions(rows.sparkSession)).bit_length())


# ---- growing


def grown(words: DataFrame, runs: DataFrame, n_all: int, n_distinct: int, depth: int, min_count: int) -> DataFrame:
    """(run, value, n): what each run of words adds to the logarithm of a text's probability, where that is not nothing.

    words: (h, n); runs: (level, a, b, n, run) with at least min_count occurrences. A run of a level is a context a and
    its next word; b, the run without its first word, has the shorter context. Runs whose shorter context is not retained end at
    the join, and a context meets its own count where its runs are dealt, so that each run is dealt twice a level.
    """
    spark = words.sparkSession
    totals = words.where(F.col("n") >= min_count).select(F.col("h").alias("run"), "n", F.log((F.col("n") + 1) / F.lit(float(n_all + n_distinct + 1))).alias("logp"))
    kept, made = totals, []
    for level in range(1, depth + 1):
        own = runs.where(F.col("level") == level)
        rows = own.join(kept.select(F.col("run").alias("b"), F.col("logp").alias("shorter")).hint("shuffle_hash"), "b").select("a", "b", "n", "shorter")
        rows = rows.union(totals.select("run", F.lit(0).cast("long"), "n", F.lit(None).cast("double"))).repartition(partitions(spark), "a")
        made.append(stored(rows.mapInArrow(_grow, "run long, value double, n long, logp double"), f"level{level}"))
        kept, totals = made[-1].where("logp IS NOT NULL"), own
    out = stored(functools.reduce(DataFrame.union, made).groupBy("run").agg(F.sum("value").alias("value"), F.max("n").alias("n")), "values")
    for rows in made:
        drop_written(rows)
    return out


def _grow(batches):
    """Runs and contexts of the retained contexts of a part, from (a, b, n, shorter) of their runs and, without shorter, the counts of contexts."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    a, b, n, shorter = (table.column(c).to_numpy() for c in ("a", "b", "n", "shorter"))
    whole = np.isnan(shorter)
    context, count = a[whole], n[whole]
    order = np.argsort(context)
    context, count = context[order], count[order]
    rows = np.nonzero(~whole)[0]
    if not len(rows):
        return
    rows = rows[np.argsort(a[rows], kind="stable")]
    a, b, n, shorter = a[rows], b[rows], n[rows], shorter[rows]
    start = np.nonzero(np.r_[True, a[1:] != a[:-1]])[0]
    size, mass, total = np.diff(np.r_[start, len(a)]), np.add.reduceat(n, start), count[np.searchsorted(context, a[start])]
    left = (total - mass + DISCOUNT * size) / total
    logp = np.log((n - DISCOUNT) / np.repeat(total, size) + np.repeat(left, size) * np.exp(shorter))
    gain = np.add.reduceat(n * (logp - shorter), start) + (total - mass) * np.log(left) - 0.5 * size * np.log(total)
    kept = gain > 0
    held = np.repeat(kept, size)
    value = logp - np.repeat(np.log(left), size) - shorter
    run = joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64)
    names = ["run", "value", "n", "logp"]
    yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (run, value, n, logp)], names=names)
    yield pa.RecordBatch.from_arrays([*(pa.array(x[kept]) for x in (a[start], np.log(left), total)), pa.nulls(int(kept.sum()), pa.float64())], names=names)


def step(column: str) -> Column:
    """Eighths of a power of two."""
    return F.floor(8 * F.log2(column))


def lowest_step(rows: DataFrame, column: str, most: int) -> int | None:
    """The step from which on all rows with a value are at most so many."""
    sizes = sorted(((r["step"], r["n"]) for r in rows.where(F.col(column) > 0).groupBy(step(column).alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, lowest = 0, None
    for value, n in sizes:
        total += n
        if total > most:
            break
        lowest = value
    return lowest


def greatest(rows: DataFrame, column: str, most: int) -> DataFrame:
    """At most so many rows with the greatest values: all from some value on, found on a histogram of eighths of a power of two."""
    lowest = lowest_step(rows, column, most)
    return rows.where((F.col(column) > 0) & (step(column) >= lowest)) if lowest is not None else rows.limit(0)


class Cache:
    """Values of common runs, in order of their hashes scattered once more; a run is looked for among those of its slot."""

    @classmethod
    def of(cls, values: DataFrame) -> Cache:
        got = values.select("run", "value").toArrow()
        run, value = (got.column(c).to_numpy() for c in ("run", "value"))
        return cls(run.view(np.uint64), value)

    def __init__(self, run: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(run) * 2).bit_length())
        at = slot(run, self.bits)
        order = np.argsort(at)
        self.runs, self.values = np.r_[run[order], np.uint64(0)], np.r_[value[order], value.dtype.type(0)]  # the last stands for none
        self.first = np.searchsorted(at[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each run is held."""
        at = slot(x, self.bits)
        k, end = self.first[at], self.first[at + 1]
        held = (k < end) & (self.runs[k] == x)
        value = np.where(held, self.values[k], self.values[-1])
        rest = np.nonzero(~held & (k + 1 < end))[0]
        while len(rest):
            k[rest] += 1
            hit = self.runs[k[rest]] == x[rest]
            got = rest[hit]
            held[got], value[got] = True, self.values[k[got]]
            rest = rest[~hit]
            rest = rest[k[rest] + 1 < end[rest]]
        return value, held


# ---- scoring


PARTS = "doc_id long, n_tokens long, n_known long, base double, gain double, runs binary, words array<struct<word: binary, m: long>>"


def _lists(owner: np.ndarray, n: int, fields: list[pa.Array], names: list[str]) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names))


def score_documents(
    docs: DataFrame, in_training: Column, depth: int = DEPTH, min_count: int = MIN_COUNT, head: int = HEAD, cached: int = CACHED, filter_bits: int | None = None
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row; learns from the rows where in_training holds."""
    spark, train = docs.sparkSession, docs.where(in_training)
    raw = stored(counted(train, part_bits(train)), "counts")
    tokens = stored(raw.where("word IS NOT NULL").groupBy("word", "h").agg(F.sum("n").alias("n")), "tokens")
    size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, below = size["n"], math.log10(size["n"] + size["v"] + 1)
    common = greatest(tokens.select("h", "n"), "n", head).toArrow()
    own, at, twice = np.unique(common.column("h").to_numpy().view(np.uint64), return_index=True, return_counts=True)
    count_of = common.column("n").to_numpy()
    least = int(count_of.min()) if len(count_of) else n_all + 1
    known = Cache(own, count_of[at])
    assert (twice == 1).all(), "two common words of one hash"
    pairs = frequent_pairs(raw, min_count, filter_bits)
    drop_written(raw)
    runs = common_runs(train, pairs, depth, min_count, filter_bits)
    values = grown(tokens, functools.reduce(DataFrame.union, runs), n_all, size["v"], depth, min_count)
    for table in runs:
        drop_written(table)
    lowest = lowest_step(values, "n", cached)
    cache = Cache.of(values.where(step("n") >= lowest) if lowest is not None else values.limit(0))
    shared = spark.sparkContext.broadcast((known, cache, Filter.of(values.select("run"), filter_bits)))

    def score(batches):
        known, cache, there = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED):
                part = batch.slice(at, HASHED)
                line, place, sizes, flat = hashed_tokens(part.column("text"))
                of = np.repeat(np.arange(len(sizes)), sizes)
                first = np.cumsum(sizes) - sizes
                c, common = known.find(line)
                base = np.log10(c + 1.0) - below
                gain, to_join = np.zeros(len(line)), []
                run, end = line, np.arange(len(line))
                for length in range(1, depth + 2):
                    if length > 1:
                        run = joined(run[:-1], run[1:])
                        end = end[place[end] >= length - 1]
                    on = end[there.has(run[end - length + 1])]
                    x = run[on - length + 1]
                    value, held = cache.find(x)
                    gain[on] += value
                    to_join.append((of[on[~held]], x[~held]))
                    if length > 1:  # a run is in the table only if the one without its first word is, from two words on
                        end = on
                owner, runs = (np.concatenate(x) for x in zip(*to_join))
                runs = runs[np.argsort(owner.astype(np.int16), kind="stable")].astype("<u8")
                ends = 8 * np.cumsum(np.bincount(owner, minlength=len(sizes)))
                of_word, word, n_words, which = _tallied(of[~common], np.nonzero(~common)[0], line)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(gain, first) / math.log(10)),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(runs.tobytes())]),
                        _lists(of_word, len(sizes), [pa.array(_words(flat, which, place), pa.binary()), pa.array(n_words)], ["word", "m"]),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base", "gain", "runs", "words"],
                )

    # the row number is written with the row, so it stays the row's own
    parts = stored(_texts(docs).mapInArrow(score, PARTS).withColumn("row", F.monotonically_increasing_id()), "parts")
    shared.unpersist()
    rest = values if lowest is None else values.where(step("n") < lowest)
    slices = math.ceil(rest.count() / cached) if cached else SLICES + 1
    left = open_sums(parts.select("row", "runs"), rest) if slices > SLICES else sliced_sums(parts.select("row", "runs"), rest, slices)
    rare = tokens.where(F.col("n") < least).select("word", F.col("n").alias("c"))
    other = parts.select("row", F.explode("words").alias("x")).select("row", "x.word", "x.m").join(rare, "word")
    other = other.groupBy("row").agg(F.sum("m").alias("known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("counted"))
    both = parts.select("row", "doc_id", "n_tokens", "n_known", "base", "gain").join(left, "row", "left").join(other, "row", "left")
    none = F.lit(0.0)
    base_score = F.col("base") + F.coalesce("counted", none)
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        (base_score + F.col("gain") + F.coalesce("more", none)).alias("score"),
    )


def sliced_sums(parts: DataFrame, values: DataFrame, slices: int) -> DataFrame:
    """As open_sums: each slice of the values goes to all tasks in turn, and no run is sent."""
    spark = parts.sparkSession

    def found(shared):
        def look(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    own = batch.column("runs").slice(at, TEXTS).to_pylist()
                    value, _ = shared.value.find(np.frombuffer(b"".join(own), np.uint64))
                    more = np.bincount(np.repeat(np.arange(len(own)), [len(x) // 8 for x in own]), value, len(own)) / math.log(10)
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, TEXTS), pa.array(more)], names=["row", "more"])

        return parts.mapInArrow(look, "row long, more double")

    made = [spark.createDataFrame([], "row long, more double")]
    for k in range(slices):
        shared = spark.sparkContext.broadcast(Cache.of(values.where(F.pmod("run", F.lit(slices)) == k)))
        made.append(stored(found(shared).where("more <> 0"), "open"))
        shared.unpersist()
    return functools.reduce(DataFrame.union, made).groupBy("row").agg(F.sum("more").alias("more"))


def open_sums(parts: DataFrame, values: DataFrame) -> DataFrame:
    """(row, more): the sum of the values of each row's runs that are in the table. Runs and values meet by range of the hash, packed, and what each range adds to
    the rows comes together by rows."""
    bits = part_bits(parts)
    wide = 1 << (bits // 2 + 3)

    def deal(batches):
        owners, runs, held = [], [], 0

        def flush():
            x, owner = np.concatenate(runs), np.concatenate(owners)
            order = np.argsort(x)
            cut = _ranges(x[order], bits, order)
            columns = [pa.array(np.arange(len(cut), dtype=np.int32)), *(pa.array([y[k].tobytes() for (k,) in cut], pa.binary()) for y in (owner, x))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "owners", "runs"])

        for batch in batches:
            row = batch.column("row").to_numpy()
            for at in range(0, len(row), TEXTS):
                own = batch.column("runs").slice(at, TEXTS).to_pylist()
                runs.append(np.frombuffer(b"".join(own), np.uint64))
                owners.append(np.repeat(row[at : at + TEXTS], [len(x) // 8 for x in own]))
                held += len(runs[-1])
                if held > RUNS_HELD:
                    yield flush()
                    owners, runs, held = [], [], 0
        if held:
            yield flush()

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, x = (np.frombuffer(b"".join(left.column(c).to_pylist()), t) for c, t in (("owners", np.int64), ("runs", np.uint64)))
        run, value = right.column("run").to_numpy().view(np.uint64), right.column("value").to_numpy()
        order = np.argsort(run)
        run, value = np.r_[run[order], np.uint64(0)], np.r_[value[order], 0.0]
        k = np.searchsorted(run[:-1], x)
        hit = (k < len(run) - 1) & (run[k] == x)
        owner, value = _summed(owner[hit], value[k[hit]])
        to = owner % wide
        order = np.argsort(to, kind="stable")
        to, owner, value = to[order], owner[order], value[order]
        start = np.nonzero(np.r_[True, to[1:] != to[:-1]])[0] if len(to) else np.zeros(0, np.int64)
        cut = [slice(i, e) for i, e in itertools.pairwise([*start.tolist(), len(to)])] if len(to) else []
        return pa.table([pa.array(to[start].astype(np.int32)), *(pa.array([y[k].tobytes() for k in cut], pa.binary()) for y in (owner, value))], names=["to", "owners", "sums"])

    def add(table: pa.Table) -> pa.Table:
        owner, value = _summed(*(np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("owners", np.int64), ("sums", np.float64))))
        return pa.table([pa.array(owner), pa.array(value / math.log(10))], names=["row", "more"])

    ranges = values.select(F.shiftrightunsigned("run", 64 - bits).cast("int").alias("part"), "run", "value")
    met = parts.mapInArrow(deal, "part int, owners binary, runs binary").groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(look, "to int, owners binary, sums binary")
    return met.groupBy("to").applyInArrow(add, "row long, more double")


def _summed(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct owners in order, and the sum of the values of each."""
    owner, at = np.unique(owner, return_inverse=True)
    return owner, np.bincount(at, value, len(owner))


def _tallied(owner: np.ndarray, at: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) of the tokens at these places in order, how often each occurs, and the place of one."""
    x = line[at]
    order = np.lexsort((x, owner))
    owner, x, at = owner[order], x[order], at[order]
    start = np.nonzero(np.r_[True, (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])])[0] if len(x) else np.zeros(0, np.int64)
    return owner[start], x[start], np.diff(np.r_[start, len(x)]), at[start]


def _words(flat: bytes, tokens: np.ndarray, place: np.ndarray) -> list[bytes]:
    """The tokens of these numbers, from the texts in a line. A text's last token is its end."""
    last = np.r_[place[1:] == 0, True]
    start, end = word_edges(flat)
    word = tokens - np.cumsum(last)[tokens] + last[tokens]
    flat = flat.lower()
    return [END if no else flat[start[k] : end[k]] for k, no in zip(word.tolist(), last[tokens].tolist())]
