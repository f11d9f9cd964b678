"""Phrases that stand together more often than their parts apart, from sorted count streams.

The layout is that of external-memory language-model estimation. Every word starts one window of up to
four words of its piece. Tasks write their distinct windows with counts; Spark deals them by ranges of the
prefix order (language, then words) and sorts each range. One pass over a sorted range gives the counts of
every order at once: the count of a phrase is the sum over the windows that start with it, which stand
together. Only a prefix of one of the bounds between ranges can lie in two ranges, so all other phrases under the
threshold leave the stream there; what is left is summed by phrase.

The phrases kept are then joined with the stream of first parts (prefix order) and with the stream of rest parts
(suffix order); Spark sorts both sides of each join by key and merges them in lockstep. Every part of a
phrase occurs at least as often as the phrase, so it is in the stream. Longer phrases put their
counts beside all phrases that they extend to either side; the largest decides about dropping.

Bounds between ranges come from a sample of places and only balance the work. Nothing is broadcast
but those bounds, and there is no table of hashes.

Defined results: a null text has no words; a null language is ``und``, the same as a language of that name; texts
without words and empty tables give no rows; repeated rows count each time; all arithmetic is of exact decimals.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.llm.common import partitions, written

ORDER = 4
LEAST, SHOWN, COVERED = 30, 2000, 80
#: Bytes of text that a task counts at once (to the next end of a piece), and characters of text for each range.
CHUNK, RANGE_CHARS = 8 << 20, 128 << 20
#: Places looked at for each bound between ranges.
PLACES = 40

_BREAK, _BLANK = 10, 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_FOLD[9] = _BLANK


def word_stream(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text and the number of the piece that each stands in."""
    raw = _FOLD[np.frombuffer(data, np.uint8)]
    inside = (raw != _BREAK) & (raw != _BLANK)
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(raw == _BREAK, dtype=np.int32)[start]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]), piece


def chunks(texts: list[bytes]):
    """Texts joined by an end of piece, cut at ends of pieces."""
    data = b"\n".join(texts)
    at = 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and _FOLD[data[to]] != _BREAK:
            to += 1
        yield data[at:to]
        at = to


class Windows:
    """The distinct windows of a chunk in prefix order: local word numbers, pairs of them, pairs of pairs.

    Numbers are even and grow with the words' bytes, 0 stands for no word; a bound that falls between takes the odd number."""

    def __init__(self, data: bytes):
        words, piece = word_stream(data)
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.words = coded.dictionary.take(order)
        code = 2 * (rank[coded.indices.to_numpy()] + 1) if len(words) else np.zeros(0, np.int64)
        n = len(code)
        follows = np.zeros(n, np.int64)
        follows[: n - 1] = np.where(piece[1:] == piece[:-1], code[1:], 0)
        self.pairs, at = np.unique(code << 32 | follows, return_inverse=True)
        at = 2 * (at.astype(np.int64) + 1)
        rest = np.zeros(n, np.int64)
        rest[: max(0, n - 2)] = np.where(piece[2:] == piece[:-2], at[2:], 0)
        self.places = at << 32 | rest

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.places, return_counts=True)

    def bound(self, four: tuple[str, ...]) -> int:
        """Where a window of other texts would stand."""

        def of(pair) -> int:
            key = 0
            for word in pair:
                i = bisect_left(self._list, word.encode()) if word else -1
                found = word and i < len(self._list) and self._list[i] == word.encode()
                key = key << 32 | (0 if not word else 2 * i + 2 if found else 2 * i + 1)
            if not key:
                return 0
            j = int(np.searchsorted(self.pairs, key))
            return 2 * j + 2 if j < len(self.pairs) and self.pairs[j] == key else 2 * j + 1

        return of(four[:2]) << 32 | of(four[2:])

    def bounds(self, fours: list[tuple[str, ...]]) -> np.ndarray:
        self._list = self.words.cast(pa.binary()).to_pylist() if fours else []
        return np.array([self.bound(x) for x in fours], np.int64)

    def written_form(self, keys: np.ndarray) -> pa.Array:
        """Words with a blank behind each: texts with one prefix of words stand together in byte order."""
        first, rest = self.pairs[(keys >> 33) - 1], (keys & 0xFFFFFFFF) // 2 - 1
        rest = np.where(rest >= 0, self.pairs[np.maximum(rest, 0)], 0)
        parts = []
        for code in (first >> 32, first & 0xFFFFFFFF, rest >> 32, rest & 0xFFFFFFFF):
            parts.append(self.words.take(pa.array(np.maximum(code // 2 - 1, 0), mask=code == 0)))
        return pc.binary_join_element_wise(*parts, pa.scalar(""), " ", null_handling="skip")


def _by_lang(batch: pa.RecordBatch):
    langs = pc.fill_null(batch.column("lang"), "und")
    texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
    for lang in pc.unique(langs).to_pylist():
        yield lang, texts.filter(pc.equal(langs, lang)).to_pylist()


def places_of(batches, share: float, seed: int):
    """A sample of windows."""
    for nth, batch in enumerate(batches):
        draw = np.random.default_rng([seed, nth])
        for lang, texts in _by_lang(batch):
            for data in chunks(texts):
                w = Windows(data)
                picked = w.places[draw.random(len(w.places)) < share]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(picked), pa.string()), w.written_form(picked)], ["lang", "win"])


def windows_of(batches, bounds: list[tuple]):
    """Distinct windows of each chunk with their counts and the range that they belong to."""
    langs = [b[0].encode() for b in bounds]
    for batch in batches:
        for lang, texts in _by_lang(batch):
            low, high = bisect_left(langs, lang.encode()), bisect_left(langs, lang.encode() + b"\0")
            for data in chunks(texts):
                w = Windows(data)
                keys, n = w.counted()
                part = low + np.searchsorted(w.bounds([b[1] for b in bounds[low:high]]), keys, "right")
                win = w.written_form(keys)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([lang] * len(keys), pa.string()), win, pa.array(n, pa.int64())], ["part", "lang", "win", "n"])


def prefixes_of(batches, bounds: list[tuple], least: int):
    """Counts of the phrases of every order of one sorted range; under least only if a bound lies inside a phrase.

    The phrase of order 0 is empty and counts the words of a language."""
    held: list[tuple | None] = [None] * (ORDER + 1)  # lang, phrase, count, to be kept
    out: list[tuple] = []

    def close(k: int) -> None:
        if held[k] and (held[k][2] >= least or held[k][3]):
            out.append(held[k][:3])

    def flush():
        rows = list(out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column("n").to_numpy()
        lists = pc.split_pattern(batch.column("win"), " ")
        size = pc.list_value_length(lists).to_numpy() - 1
        flat = lists.flatten().dictionary_encode()
        start = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        codes, names = flat.indices.to_numpy(), flat.dictionary
        row = np.zeros((len(n), ORDER + 1), np.int64)
        row[:, 0] = batch.column("lang").dictionary_encode().indices.to_numpy()
        for k in range(1, ORDER + 1):
            has = size >= k
            row[has, k] = codes[start[has] + k - 1] + 1
        near = {bounds[i] for p in pc.unique(batch.column("part")).to_pylist() for i in (p - 1, p) if 0 <= i < len(bounds)}
        split = np.zeros((len(n), ORDER + 1), bool)
        split[:, 0] = True
        known = batch.column("lang").to_pylist() if near else []
        for lang, four in near:
            same = np.array([x == lang for x in known])
            for k in range(1, ORDER + 1):
                i = names.index(four[k - 1]).as_py() if four[k - 1] else -1
                same = same & (row[:, k] == i + 1) if i >= 0 else np.zeros(len(n), bool)
                split[:, k] |= same
        changed = np.zeros(len(n) - 1, bool)
        for k in range(ORDER + 1):
            changed |= row[1:, k] != row[:-1, k]
            begin = np.concatenate([[0], np.flatnonzero(changed) + 1])
            total, keep = np.add.reduceat(n, begin), np.logical_or.reduceat(split[:, k], begin)
            begin_has = size[begin] >= k
            shown = begin_has & ((total >= least) | keep)
            shown[[0, -1]] = begin_has[[0, -1]]
            for g in np.flatnonzero(shown | (np.arange(len(begin)) % max(1, len(begin) - 1) == 0)).tolist():
                at = int(begin[g])
                if not begin_has[g]:
                    now = None
                else:
                    now = (batch.column("lang")[at].as_py(), " ".join(names[int(c)].as_py() for c in codes[start[at] : start[at] + k]), int(total[g]), bool(keep[g]))
                if g == 0 and now and held[k] and now[:2] == held[k][:2]:
                    now = (*now[:2], now[2] + held[k][2], now[3] or held[k][3])
                elif g == 0 or g == len(begin) - 1:
                    close(k)
                    held[k] = None
                if g in (0, len(begin) - 1):
                    held[k] = now
                elif now:
                    out.append(now[:3])
        if out:
            yield flush()
    for k in range(ORDER + 1):
        close(k)
    yield flush()


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to four words that occur least times or more; the empty phrase counts the words."""
    spark = docs.sparkSession
    rows = docs.select(F.col("`lang`").cast("string").alias("lang"), F.col("`text`").cast("string").alias("text"))
    seen = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    ranges = max(partitions(spark), math.ceil(seen["chars"] / RANGE_CHARS))
    share = min(1.0, max(0.02, 2000 / max(1, seen["rows"])))
    each = min(1.0, PLACES * ranges * 6 / max(1.0, share * seen["chars"]))
    places = rows.sample(share, 7).mapInArrow(lambda b: places_of(b, each, 11), "lang string, win string").collect()  # PLACES for each range
    places = sorted((r["lang"].encode(), tuple(x.encode() for x in (r["win"].split(" ")[:-1] + [""] * ORDER)[:ORDER])) for r in places)
    bounds = sorted({places[len(places) * i // ranges] for i in range(1, ranges)}) if places else []
    bounds = [(lang.decode(), tuple(x.decode() for x in four)) for lang, four in bounds]
    dealt = rows.mapInArrow(lambda b: windows_of(b, bounds), "part int, lang string, win string, n long")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("lang", "win")
    return ordered.mapInArrow(lambda b: prefixes_of(b, bounds, least), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of two to four words, cut where their parts say least, without those that a longer one covers."""
    counts = written(phrase_counts(docs, least), "phrases")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ")
    found = counts.withColumn("words", words).where(F.size("words") >= 2)  # the empty phrase has one empty word
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    prefix_order = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")).hint("merge")
    suffix_order = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")).hint("merge")
    cuts = cuts.join(prefix_order, ["lang", "first"]).join(suffix_order, ["lang", "rest"])
    cuts = cuts.withColumn("two", exact("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("both", exact("l") + exact("r")).withColumn("score", F.expr("two div both"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [F.struct(F.lit(size).alias("size"), F.lit(at).alias("at")) for size in range(2, ORDER) for at in range(1, ORDER - size + 2)]
    spans = F.filter(F.array(*inner), lambda s: (s["size"] < F.size("words")) & (s["at"] + s["size"] - 1 <= F.size("words")))
    longer = found.where(F.size("words") > 2).select("lang", "words", "n", F.explode(spans).alias("s"))
    longer = longer.select("lang", F.expr("array_join(slice(words, s.at, s.size), ' ')").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    kept = best.join(longer.hint("merge"), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longest").isNull() | (exact("longest") * F.lit(100) < exact("a") * F.lit(covered)))
    n = counts.where("phrase = ''").select("lang", "n")  # a row for each language
    return kept.join(n, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def top_collocations(docs: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Each language's first phrases by score, then count, then bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
n AS (SELECT lang, count(*) AS n FROM word GROUP BY 1),
counted AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM word, (VALUES (1), (2), (3), (4)) o(k) WHERE i + k - 1 <= len(w))
  GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cut AS (
  SELECT c.lang, c.k AS size, c.phrase, c.f AS a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[j + 1:c.k], ' ') AS rest
  FROM counted c, (VALUES (1), (2), (3)) o(j) WHERE j < c.k),
scored AS (
  SELECT cut.*, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS score
  FROM cut JOIN counted l ON l.lang = cut.lang AND l.phrase = cut.first JOIN counted r ON r.lang = cut.lang AND r.phrase = cut.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f
  FROM (SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + z - 1], ' ') AS phrase FROM counted, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(z) WHERE z < k AND i + z - 1 <= k)
  GROUP BY 1, 2)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT b.*, n.n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
      WHERE x.f IS NULL OR 100 * x.f < 80 * b.a)
WHERE rank <= 2000
"""
