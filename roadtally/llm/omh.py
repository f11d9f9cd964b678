"""Near-duplicates by order MinHash, verified by banded alignment.

A text becomes its 5-word shingles, each labelled with its occurrence number, so that no symbol
comes twice. For each of ``tables`` hash functions the ``picks`` shingles with the least hashes are
put in text order; the hash of that sequence is a bucket. Two texts share a bucket only if they
have the same shingles in the same order, so the chance follows edit similarity, not only overlap. Where that
chance is small or none, with at most ``SHORT`` shingles, texts get buckets for their whole sequence
and for it without each one or two shingles: of two such texts that link, each is left with the other's.

Candidates are verified by aligning the labelled shingles inside the band that the threshold
leaves: with M aligned of n and m, the similarity is M / (n + m - M), and a pair links at
``threshold`` or more. Classes are the connected components of the links, exact copies included.

Copies of one text are folded into one representative first, numbered as they are written. Inside a bucket
every member is compared with one leader, and those outside its largest component then with one of that component's
members (linear in the bucket). Where members of a bucket are still in different components, pairs across them are looked at among members of like length (each length class with
itself and with the next), in blocks of at most about ``BLOCK`` members, so no task holds a whole bucket; only members outside
the bucket's largest component go to all of its blocks, and members of one component are not compared. Buckets with the
same members are looked at once. Only pairs whose bound
reaches the threshold are emitted and aligned: texts share no more symbols than the distinct 16-bit marks they share (and
so than the lesser counts of their marks in each of some ranges add up to) plus the lesser number of
symbols that a mark stands for twice; nothing that could link is lost.

Defined results: a null text counts as an empty one; texts of fewer words than a shingle have one
shingle, of all their words; empty texts are copies of each other; repeated rows share a class; ids that
come with several texts join those texts' classes; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtally.llm.common import drop_written, written

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares a bucket with chance 0.26 to 0.33 each; 32 tables all miss it with chance 6e-5 at most.
PICKS = 5
TABLES = 32
SHORT = 12
#: Members of a block, fewer of texts of over a thousand symbols.
BLOCK = 2048
#: Symbols that are sketched at once.
SYMBOLS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Words:
    """Hashes of the words of a line of bytes: a polynomial in an odd base, from prefix sums, whatever the place."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\v\f\r")] = True
        self.value = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.powers = self.back = np.ones(1, np.uint64)

    def of(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first place of each word; the line ends with white space."""
        if len(line) > len(self.powers):
            base = np.full(len(line), self.BASE, np.uint64)
            base[0] = 1
            self.powers = np.cumprod(base)
            base[1:] = pow(self.BASE, -1, 1 << 64)
            self.back = np.cumprod(base)
        white = self.space[line]
        before = np.r_[True, white[:-1]]
        starts, ends = np.nonzero(~white & before)[0], np.nonzero(white & ~before)[0]
        sums = np.r_[np.uint64(0), np.cumsum(self.value[line] * self.powers[: len(line)], dtype=np.uint64)]
        return _mix((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64)), starts


WORDS = _Words()


def shingles_of(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """A 64-bit symbol for each shingle of each text with its occurrence number, in text order."""
    out, part, size = [], [], 0
    for text in texts:
        own = text.encode("utf-8", "surrogatepass") if text else b""
        part.append(own)
        size += len(own) + 1
        if size > 1 << 20:
            out += _shingles(part, width)
            part, size = [], 0
    return out + (_shingles(part, width) if part else [])


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts])
    h, starts = WORDS.of(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
    of = np.searchsorted(ends, starts, "right")
    n_words = np.bincount(of, minlength=len(texts))
    n = max(0, len(h) - width + 1)
    s = h[:n].copy()
    for k in range(1, width):
        s = _mix(s) + h[k : n + k]
    s = _mix(s)
    inside = of[:n] == of[width - 1 :]
    s, owner = s[inside], of[:n][inside]
    # a text of fewer words than a shingle has one, of all its words
    first = np.cumsum(n_words) - n_words
    few = np.nonzero((n_words > 0) & (n_words < width))[0]
    for k in few.tolist():
        x = h[first[k] : first[k] + 1]
        for m in range(first[k] + 1, first[k] + n_words[k]):
            x = _mix(x) + h[m]
        at = np.searchsorted(owner, k)
        s, owner = np.insert(s, at, _mix(x)[0]), np.insert(owner, at, k)
    key = _mix(s + _mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    run = key[order]
    start = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    if not start.all():
        at = np.arange(len(run))
        number = np.empty(len(run), np.uint64)
        number[order] = at - np.maximum.accumulate(np.where(start, at, 0))
        s = np.where(number > 0, _mix(s + number), s)
    return np.split(s, np.searchsorted(owner, np.arange(1, len(texts))))


def labelled_shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    return shingles_of([text], width)[0]


def sketch(texts: list[np.ndarray], tables: int = TABLES, picks: int = PICKS) -> list[np.ndarray]:
    """Bucket hashes of each text: for each table the ordered sequence of the least-hashed symbols, then those of short texts.

    The least hashes of a text are looked for among those under a level that about 16 reach; where
    fewer than ``picks`` do, among all.
    """
    sizes = np.array([len(s) for s in texts], np.int64)
    out = np.zeros((len(texts), tables), np.uint64)
    seeds = _mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    line = np.concatenate([*texts, np.zeros(0, np.uint64)])
    first = np.cumsum(sizes) - sizes
    level = np.minimum(16.0 * (1 << 32) / np.maximum(sizes, 1), (1 << 32) - 1).astype(np.uint32)
    short = (line >> np.uint64(32)).astype(np.uint32) ^ line.astype(np.uint32)
    of, limit = np.repeat(np.arange(len(texts)), sizes), np.repeat(level, sizes)
    want = np.minimum(picks, sizes)
    for t, seed in enumerate(seeds):
        v = (short ^ np.uint32(seed & np.uint64(0xFFFFFFFF))) * np.uint32(0x85EBCA6B | 1)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        at = np.nonzero(v <= limit)[0]
        at = at[np.argsort((of[at] << 32) | v[at], kind="stable")]
        begin = np.searchsorted(of[at], np.arange(len(texts) + 1))
        few = np.nonzero(np.diff(begin) < want)[0]
        h = np.full(len(texts), seed, np.uint64)
        chosen = at[np.minimum(begin[:-1, None] + np.arange(picks), max(0, len(at) - 1))] if len(at) else np.zeros((len(texts), picks), np.int64)
        for k in few.tolist():
            own = np.argsort(v[first[k] : first[k] + sizes[k]], kind="stable")[: want[k]] + first[k]
            chosen[k, : len(own)] = own
        chosen[np.arange(picks) >= want[:, None]] = len(line)  # after all places
        chosen.sort(axis=1)
        symbols = np.r_[line, np.uint64(0)][chosen]
        for k in range(picks):
            h = np.where(k < want, _mix(h * np.uint64(0x9E3779B97F4A7C15) + symbols[:, k]), h)
        out[:, t] = h
    return [np.zeros(0, np.int64) if not n else (np.r_[row, without(s)] if n <= SHORT else row).view(np.int64) for s, n, row in zip(texts, sizes.tolist(), out)]


def without(s: np.ndarray) -> np.ndarray:
    """Hashes of a short sequence and of what is left of it without any one symbol, from 10 on also without any two."""
    n = len(s)
    sets = [()] + [(i,) for i in range(n)] * (n > 1) + [(i, j) for j in range(n) for i in range(j)] * (n >= 10)
    h = np.full(len(sets), 0x5851F42D4C957F2D, np.uint64)
    gone = np.zeros((len(sets), n), bool)
    for row, places in enumerate(sets):
        gone[row, list(places)] = True
    for k in range(n):
        h = np.where(gone[:, k], h, _mix(h * np.uint64(0x9E3779B97F4A7C15) + s[k]))
    return np.unique(h)


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """M / (n + m - M) for the longest banded alignment of M symbols; 0 where the band can't reach the threshold."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    need = threshold / (1 + threshold) * (n + m)  # M at least
    if min(n, m) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * need + 1e-9
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    path = j[np.argsort(i)]
    if (path[1:] > path[:-1]).all():
        best = len(path)
    else:
        tails: list[int] = []
        for x in path.tolist():
            k = bisect.bisect_left(tails, x)
            tails[k : k + 1] = [x]
        best = len(tails)
    return best / (n + m - best)


def marks_of(s: np.ndarray) -> bytes:
    """The distinct 16-bit marks of symbols, in order."""
    x = np.sort((s >> np.uint64(17)).astype("<u2"))
    return x[np.r_[True, x[1:] != x[:-1]]].tobytes() if len(x) else b""


def likeness_bound(shared, twice, total):
    """At most this similarity: shared marks, the lesser number of symbols without a mark of their own, and both texts' symbols."""
    most = np.minimum(shared + twice, total / 2)
    return np.where(total > 0, most / np.maximum(1, total - most), 1.0)


SKETCHED = "doc_id long, digest string, n_shingles int, buckets array<long>, marks binary"


def sketches(docs: DataFrame, tables: int = TABLES, picks: int = PICKS) -> DataFrame:
    def make(batches):
        for batch in batches:
            texts = shingles_of(list(batch["text"]))
            buckets, own, held = [], [], 0
            for s in texts:
                own.append(s)
                held += len(s)
                if held > SYMBOLS:
                    buckets += sketch(own, tables, picks)
                    own, held = [], 0
            buckets += sketch(own, tables, picks) if own else []
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "n_shingles": [len(s) for s in texts], "buckets": buckets, "marks": [marks_of(s) for s in texts]})

    return _digested(docs).mapInPandas(make, SKETCHED)


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.sha2(text, 256).alias("digest"), text.alias("text"))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for links (a, b): root is the least node that links reach.

    Each round takes the least root among a node's neighbours and then the root's own root; it is
    written once, and the rounds end when nothing changes.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), label)
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), label)
    while True:
        seen = now.select(F.col("node").alias("b"), F.col("root").alias("near"))
        low = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("low"))
        new = now.join(low, "node").select("node", "root", F.least("root", "low").alias("next"))
        up = now.select(F.col("node").alias("next"), F.col("root").alias("up"))
        new = new.join(up, "next").select("node", F.least("next", "up").alias("root"), (F.least("next", "up") != F.col("root")).alias("moved"))
        new = written(new, label)
        moved = not new.where("moved").isEmpty()
        drop_written(now)
        now = new
        if not moved:
            drop_written(both)
            return now.select("node", "root")


def bounded(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bound reaches the threshold."""

    @F.pandas_udf("boolean")
    def possible(p: pd.Series, q: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        marks = lambda x: np.frombuffer(x, "<u2")
        out = []
        for x, y, nx, ny in zip(p, q, n, m):
            a, b = marks(x), marks(y)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append(bool(likeness_bound(shared, min(nx - len(a), ny - len(b)), nx + ny) >= threshold - 1e-9))
        return pd.Series(out, dtype=bool)

    own = lambda x: texts.select(F.col("t").alias(x), F.col("marks").alias(f"c{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    return both.where(possible.asNondeterministic()("ca", "cb", "na", "nb")).select("a", "b")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links; of these only what they join matters: pairs of components."""
    root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    pairs = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    pairs = written(pairs.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "merges")
    if pairs.isEmpty():
        return roots
    last = components(pairs)
    alone = last.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti")  # single texts
    both = roots.select("node", "root").union(alone)
    out = both.join(last.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    return written(out.select("node", F.coalesce("last", "root").alias("root")), "components")


def pivot_pairs(members: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a member outside its bucket's largest component and one of that component, chosen by a hash of text and bucket."""
    placed = members.select("bucket", "t", "n").join(roots.select(F.col("node").alias("t"), "root"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    own = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.min_by(F.struct("t", "n"), F.xxhash64("t", "bucket")).alias("pivot"))
    own = own.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by(F.struct("root", "pivot"), F.struct("size", "root")).alias("main")).where("roots > 1")
    both = placed.join(own.select("bucket", F.col("main.root").alias("main"), "main.pivot"), "bucket").where("root <> main")
    ratio = F.least("n", "pivot.n") >= threshold * F.greatest("n", "pivot.n") - 1e-9
    return both.where(ratio).select(F.least("t", "pivot.t").alias("a"), F.greatest("t", "pivot.t").alias("b")).distinct()


def across_components(members: DataFrame, texts: DataFrame, roots: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of one bucket in different components whose bound reaches the threshold."""
    placed = members.select("bucket", "t", "n").join(roots.select(F.col("node").alias("t"), "root"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    # lengths of a pair that can link are of one class or of two adjacent ones
    size_class = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-math.log(threshold - 1e-6))).cast("int")
    placed = placed.withColumn("class", size_class)
    cells = placed.withColumn("cell", F.explode(F.array("class", F.col("class") - 1)))  # a cell: a class and the one above
    h = F.xxhash64("t", "class")
    found = cells.groupBy("bucket", "cell", "root").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"), F.min("t").alias("z"))
    found = found.groupBy("bucket", "cell").agg(F.sum("n").alias("size"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.min("z").alias("z"))
    # buckets with the same members need one look
    found = found.where("roots > 1").groupBy("cell", "size", "x", "y", "z", "main").agg(F.min("bucket").alias("bucket"))
    per_block = F.greatest(F.lit(block / 32), F.least(F.lit(block), F.lit(1024.0 * block) * F.pow(F.lit(threshold), "cell")))
    found = found.select("bucket", "cell", "main", F.ceil(F.col("size") / per_block).cast("int").alias("blocks"))
    rows = cells.join(found, ["bucket", "cell"]).withColumn("own", F.pmod(F.xxhash64("t", "bucket"), F.col("blocks")).cast("int"))
    # a pair across components has a member outside the largest one, and only such members go to all blocks
    rows = rows.withColumn("block", F.explode(F.when(F.col("root") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("bucket", "cell", "block", (F.col("own") == F.col("block")).alias("here"), (F.col("root") != F.col("main")).alias("outside"), "t", "root", "class")
    rows = rows.join(texts.select("t", "n", "marks"), "t")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        cell = group["cell"].iloc[0]
        t, root, n, here, outside, of = (group[c].to_numpy() for c in ("t", "root", "n", "here", "outside", "class"))
        marks = [np.frombuffer(x, "<u2") for x in group["marks"]]
        twice = n - np.array([len(x) for x in marks])
        shift = int(np.clip(17 - int(n.max(initial=1)).bit_length(), 4, 9))  # ranges of marks: about half as many as symbols
        bins = np.zeros((len(marks), 1 << (16 - shift)), np.uint16)
        for k, x in enumerate(marks):
            bins[k] = np.bincount(x >> shift, minlength=bins.shape[1])
        local = np.nonzero(here)[0]
        a, b = [], []
        for k in np.nonzero(outside)[0].tolist():
            # pairs of the upper class alone belong to its own cell; of two outside members the lesser comes to the other's block
            rest = local[(root[local] != root[k]) & ((of[local] == cell) | (of[k] == cell)) & (~outside[local] | (t[local] > t[k]))]
            rest = rest[likeness_bound(np.minimum(n[rest], n[k]), 0, n[rest] + n[k]) >= threshold - 1e-9]
            if not len(rest):
                continue
            shared = np.minimum(bins[rest], bins[k]).sum(axis=1, dtype=np.uint16).astype(np.int64)  # at most 65536 marks
            shared[(shared == 0) & (len(marks[k]) == 65536)] = 65536
            rest = rest[likeness_bound(shared, np.minimum(twice[rest], twice[k]), n[rest] + n[k]) >= threshold - 1e-9]
            for m in rest.tolist():
                both = len(np.intersect1d(marks[k], marks[m], assume_unique=True))
                if likeness_bound(both, min(twice[k], twice[m]), n[k] + n[m]) >= threshold - 1e-9:
                    a.append(min(t[k], t[m]))
                    b.append(max(t[k], t[m]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}).drop_duplicates()

    return rows.groupBy("bucket", "cell", "block").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, picks: int = PICKS) -> DataFrame:
    """One row for each row of docs: doc_id, its text's digest, class_id (the least doc_id of the class)
    and is_first (the one that stays)."""
    rows = written(sketches(docs, tables, picks), "sketches")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"), F.first("marks").alias("marks"))
    texts = written(texts.withColumn("t", F.monotonically_increasing_id()), "texts")  # t: a text's number, written with it
    members = texts.select("t", "n", F.explode("buckets").alias("bucket"))
    crowd = members.groupBy("bucket").agg(F.min("t").alias("leader"), F.min_by("n", "t").alias("n_leader"), F.count("*").alias("size")).where("size > 1")
    members = written(members.join(crowd, "bucket"), "members")
    ratio = F.least("n", "n_leader") >= threshold * F.greatest("n", "n_leader") - 1e-9
    first = members.where((F.col("leader") != F.col("t")) & ratio).select(F.col("leader").alias("a"), F.col("t").alias("b")).distinct()
    first = written(bounded(first, texts, threshold), "pairs")
    links = verify(first, docs, texts, threshold)
    roots = components(links)
    drop_written(links)
    # what is outside a bucket's largest component meets a member of it, another one in each bucket
    second = pivot_pairs(members, roots, threshold).join(first, ["a", "b"], "left_anti")
    second = written(bounded(second, texts, threshold), "pairs")
    roots = merged(roots, verify(second, docs, texts, threshold))
    across = written(across_components(members, texts, roots, threshold).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "pairs")
    for table in (members, first, second):
        drop_written(table)
    roots = merged(roots, verify(across, docs, texts, threshold))
    drop_written(across)
    named = texts.join(roots.select(F.col("node").alias("t"), "root"), "t", "left")
    named = named.select("digest", "doc_id", F.coalesce("root", "t").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("digest", F.struct("doc_id", "digest")).alias("first_digest"))
    named = named.drop("doc_id").join(least, "root")
    out = rows.select("doc_id", "digest").join(named, "digest")
    first_row = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("first_digest"))
    return out.select("doc_id", "class_id", first_row.alias("is_first"), "digest")


def _shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Labelled shingles of the wanted texts, once each."""

    def make(batches):
        for batch in batches:
            yield pd.DataFrame({"t": batch["t"], "s": [s.view(np.int64) for s in shingles_of(list(batch["text"]))]})

    # of a text's copies only the rows of its least id come along
    rows = _digested(docs)
    one = rows.join(wanted.withColumnRenamed("digest", "d"), rows["doc_id"].eqNullSafe(F.col("own_id")) & (rows["digest"] == F.col("d")))
    return one.dropDuplicates(["digest"]).select("t", "text").mapInPandas(make, "t long, s array<long>")


def verify(pairs: DataFrame, docs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold; only texts of pairs are shingled again."""

    @F.pandas_udf("double")
    def similarity(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([alignment_similarity(np.asarray(x), np.asarray(y), threshold) for x, y in zip(p, q)], dtype="float64")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct().join(texts.select("t", "digest", F.col("doc_id").alias("own_id")), "t")
    shingled = written(_shingle_table(docs, wanted), "shingles")
    left = shingled.select(F.col("t").alias("a"), F.col("s").alias("sa"))
    right = shingled.select(F.col("t").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", similarity.asNondeterministic()("sa", "sb").alias("similarity"))
    links = written(scored.where(F.col("similarity") >= threshold - 1e-9), "links")
    drop_written(shingled)
    return links


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with its own columns."""
    first = near_duplicates(docs, threshold).where("is_first").select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest")).distinct()
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    both = docs.withColumn("__digest_own", text)
    kept = both.join(first, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__digest_own") == F.col("__digest")))
    return kept.dropDuplicates(["__digest"]).select(*[F.col(f"`{c}`") for c in docs.columns])
