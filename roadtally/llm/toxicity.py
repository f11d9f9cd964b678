"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: an embedding of the word itself (if the training sample's vocabulary has it) and the mean
embedding of its hashed character trigrams. A text is cut into overlapping windows of ``WINDOW``
words, a new one every ``STRIDE``; every window of every text is scored. Each window gives, for each
word, an attention weight and a logit; a window's own score pools its words, a document's score pools
all words of all its windows, as in training.

The network is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` of each label, those
with the least hash of their id, without those that don't fit any more into ``SAMPLE_WINDOWS`` windows of a label. A row
of the sample is used whole; only if no row of a label fits, its shortest one gives every so-manieth window. Both bounds are
parameters; scoring has none.

Defined results: a null or empty text has one empty window and gets the score of no evidence; ids
with several label rows take the largest label; without both labels every score is the smoothed
share of label 1; repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtally.llm.discriminant import label_table

WINDOW, STRIDE = 24, 16
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 8, 4096
VOCABULARY = 30_000
SAMPLE, SAMPLE_WINDOWS = 1200, 50_000
EPOCHS, BATCH_DOCS, RATE = 4, 32, 0.01
#: A small sample is gone through more often, up to so many batches.
LEAST_BATCHES = 120
#: In training each word is left out with this chance, so that no text is known by a few rare words.
LEFT_OUT = 0.2
DECAY = 0.05
CACHE_WORDS = 200_000


def normal(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>*#&%$|").lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word between < and >, one word after another, and how many each word has."""
    own = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(w) for w in own], np.int64)
    line = np.frombuffer(b"".join(own) + b"\0\0", np.uint8).astype(np.uint32)
    code = line[:-2] * np.uint32(0x85EBCA6B) ^ line[1:-1] * np.uint32(0xC2B2AE35) ^ line[2:] * np.uint32(0x27D4EB2F)
    code ^= code >> np.uint32(15)
    code = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(20)  # 12 bits: CHAR_BUCKETS
    inside = np.ones(len(code), bool)  # all but a word's last two places; "<>" keeps its first
    ends = np.cumsum(sizes)
    inside[ends - 1] = False
    inside[(ends - 2)[sizes > 2]] = False
    return code[inside].astype(np.int64), np.maximum(sizes - 2, 1)


def window_starts(n: int) -> range:
    """Where the windows of a text of n words begin: every word lies in one, most in two."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def split_words(text: str | None) -> list[str]:
    return text.split() if text else []


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0)


class Network:
    """Parameters, the forward pass and its gradient."""

    def __init__(self, vocabulary: list[str], odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: not in the vocabulary
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        inputs = WORD_DIM + CHAR_DIM
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM) * 0.3, "char": draw(CHAR_BUCKETS, CHAR_DIM)}
        self.p["word"][0] = 0
        self.p["word"][1:, 0] = odds  # starts as the word's log odds between the labels
        for d in "fb":
            self.p |= {f"x{d}": draw(inputs, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
            self.p[f"c{d}"][:HIDDEN] = -1.0  # new words get through at first
        self.p |= {"att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.shift = 0.0

    # ---- inputs

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what the gradient needs."""
        plain = [normal(w) for w in words]
        ids = np.array([self.index.get(w, 0) for w in plain], np.int64)
        flat, sizes = trigrams(plain)
        starts = np.cumsum(sizes) - sizes
        chars = _sums(self.p["char"][flat], starts) / sizes[:, None].astype(np.float32)
        return np.hstack([self.p["word"][ids], chars]).astype(np.float32), (ids, flat, sizes)

    # ---- the recurrent part; half the arguments of the logistic are given, as 1/(1+exp(-x)) = (1+tanh(x/2))/2

    def run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """Hidden states (windows, words, HIDDEN) for the input parts of the gates (windows, words, 3 * HIDDEN)."""
        n, steps, h = len(gates), range(gates.shape[1]), HIDDEN
        state, u = np.zeros((n, h), np.float32), self.p[f"u{d}"]
        out, memory = np.empty((n, gates.shape[1], h), np.float32), []
        for t in steps if d == "f" else reversed(steps):
            own = state @ u
            zr = np.tanh((gates[:, t, : 2 * h] + own[:, : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[:, t, 2 * h :] + r * own[:, 2 * h :])
            m = mask[:, t, None]
            fresh = new + z * (state - new)
            after = state + m * (fresh - state)
            if keep:
                memory.append((t, state, z, r, new, own[:, 2 * h :], m))
            state = after
            out[:, t] = state
        return (out, memory) if keep else out

    def back(self, grad: np.ndarray, memory: list, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gates' input parts and of the recurrent weights."""
        u, h = self.p[f"u{d}"], HIDDEN
        dgates = np.zeros((*grad.shape[:2], 3 * h), np.float32)
        du = np.zeros_like(u)
        carry = np.zeros((len(grad), h), np.float32)
        for t, state, z, r, new, own, m in reversed(memory):
            g = carry + grad[:, t]
            f = g * m
            dz = f * (state - new) * z * (1 - z)
            dn = f * (1 - z) * (1 - new * new)
            dr = dn * own * r * (1 - r)
            dgates[:, t] = np.hstack([dz, dr, dn])
            local = np.hstack([dz, dr, dn * r])
            du += state.T @ local
            carry = g * (1 - m) + f * z + local @ u.T
        return dgates, du

    def heads(self, hidden: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(mask > 0, hidden @ self.p["att"], np.float32(-1e4)), hidden @ self.p["out"]

    def gradient(self, words: list[str], at: np.ndarray, docs: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss and gradient of one batch. at: (windows, WINDOW) places in words, -1 for none; docs: first window of each text."""
        x, (ids, flat, sizes) = self.inputs(words)
        mask = (at >= 0).astype(np.float32)
        seen = x[np.maximum(at, 0)]
        runs = {d: self.run(seen @ self.p[f"x{d}"] + self.p[f"c{d}"], mask, d, True) for d in "fb"}
        hidden = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        a, u = self.heads(hidden, mask)
        of = np.repeat(np.arange(len(docs)), np.diff(np.r_[docs, len(at)]))
        top = np.maximum.reduceat(a.max(axis=1), docs)
        e = np.exp(a - top[of, None])
        weight = e / _sums(e.sum(axis=1), docs)[of, None]
        pooled = _sums((weight * u).sum(axis=1), docs)
        p = 1 / (1 + np.exp(-(pooled + self.p["bias"][0])))
        loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
        g = ((p - labels) / len(labels)).astype(np.float32)
        du, da = g[of, None] * weight, g[of, None] * weight * (u - pooled[of, None])
        out = {"bias": g.sum(keepdims=True), "att": np.einsum("wth,wt->h", hidden, da), "out": np.einsum("wth,wt->h", hidden, du)}
        dh = da[..., None] * self.p["att"] + du[..., None] * self.p["out"]
        dx = 0.0
        for k, d in enumerate("fb"):
            dg, out[f"u{d}"] = self.back(dh[..., k * HIDDEN : (k + 1) * HIDDEN], runs[d][1], d)
            flat_g = dg.reshape(-1, 3 * HIDDEN)
            out[f"c{d}"] = flat_g.sum(axis=0)
            out[f"x{d}"] = seen.reshape(-1, seen.shape[2]).T @ flat_g
            dx = dx + flat_g @ self.p[f"x{d}"].T
        place = np.where(at >= 0, at, len(words)).reshape(-1)
        each = np.stack([np.bincount(place, dx[:, i], len(words) + 1)[:-1] for i in range(dx.shape[1])], axis=1)
        out["word"] = np.stack([np.bincount(ids, each[:, i], len(self.p["word"])) for i in range(WORD_DIM)], axis=1)
        out["word"][0] = 0
        spread = np.repeat(each[:, WORD_DIM:] / sizes[:, None], sizes, axis=0)
        out["char"] = np.stack([np.bincount(flat, spread[:, i], CHAR_BUCKETS) for i in range(CHAR_DIM)], axis=1)
        return loss, out

    def fit(self, texts: list[list[list[str]]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over batches of texts, each a list of windows of words. Returns the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        batches = -(-len(texts) // BATCH_DOCS)
        epochs = max(epochs, -(-LEAST_BATCHES // batches))
        for epoch in range(epochs):
            order, total = rng.permutation(len(texts)), 0.0
            for b in range(batches):
                mine = order[b * BATCH_DOCS : (b + 1) * BATCH_DOCS]
                words: dict[str, int] = {}
                at, docs = [], []
                for i in mine:
                    docs.append(len(at))
                    for window in texts[i]:
                        at.append([words.setdefault(w, len(words)) for w in window] + [-1] * (WINDOW - len(window)))
                words = words or {"": 0}
                places = np.array(at)
                places[rng.random(places.shape) < LEFT_OUT] = -1
                loss, grad = self.gradient(list(words), places, np.array(docs), labels[mine])
                total += loss / batches
                step += 1
                rate = RATE * (1 - 0.9 * step / (epochs * batches))
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    if k in ("word", "char"):
                        self.p[k] *= np.float32(1 - rate * DECAY)
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total)
        return losses


def fit_network(texts: list[list[list[str]]], labels: np.ndarray, share: float, epochs: int = EPOCHS) -> Network:
    """share: of label 1 among all training labels; the sample holds both labels evenly."""
    counts = {0: Counter(), 1: Counter()}
    for windows, y in zip(texts, labels):
        counts[int(y)].update({normal(w) for window in windows for w in window})
    n = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    both = counts[0] + counts[1]
    vocabulary = sorted((w for w, k in both.items() if k >= 3), key=lambda w: (-both[w], w))[:VOCABULARY]
    one, none = (np.array([counts[y][w] for w in vocabulary], np.float64) for y in (1, 0))
    odds = np.log((one + 1) / (n[1] + 2)) - np.log((none + 1) / (n[0] + 2))
    sure = odds**2 * (one + 1) * (none + 1) / (one + none + 2)  # squared standard scores
    net = Network(vocabulary, np.clip(odds * sure / (sure + 9), -2, 2).astype(np.float32))
    net.fit(texts, labels, epochs)
    sampled = ((labels == 1).sum() + 0.5) / (len(labels) + 1) if len(set(labels.tolist())) < 2 else (labels == 1).mean()
    net.shift = float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return net


class Scorer:
    """Scores texts with the gates' input parts of every word kept once."""

    def __init__(self, net: Network):
        self.net, self.row, self.table = net, {}, None
        self.weights = np.hstack([net.p["xf"], net.p["xb"]])
        self.biases = np.concatenate([net.p["cf"], net.p["cb"]])
        self.size = 0

    def rows(self, words: list[str]) -> None:
        if self.table is None or self.size + len(words) > CACHE_WORDS:
            self.row, self.size = {}, 0
        new = [w for w in words if w not in self.row]
        if not new:
            return
        gates = self.net.inputs(new)[0] @ self.weights + self.biases
        if self.table is None or self.size + len(new) > len(self.table):
            grown = np.zeros((max(CACHE_WORDS, self.size + len(new)), gates.shape[1]), np.float32)
            if self.table is not None:
                grown[: self.size] = self.table[: self.size]
            self.table = grown
        self.table[self.size : self.size + len(new)] = gates
        self.row.update(zip(new, range(self.size, self.size + len(new))))
        self.size += len(new)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document scores, the highest window score of each, and how many windows each has."""
        split = [split_words(t) for t in texts]
        distinct = set().union(*split)
        if not distinct <= self.row.keys():
            self.rows(list(distinct))
        ids = np.fromiter(map(self.row.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        sizes = np.array([len(ws) for ws in split])
        many = np.array([len(window_starts(n)) for n in sizes])
        of = np.repeat(np.arange(len(texts)), many)
        first = np.cumsum(many) - many
        begin = (np.arange(len(of)) - first[of]) * STRIDE
        place = begin[:, None] + np.arange(WINDOW)
        inside = place < sizes[of][:, None]
        at = np.where(inside, place + (np.cumsum(sizes) - sizes)[of][:, None], 0)
        a, u = np.empty(at.shape, np.float32), np.empty(at.shape, np.float32)
        for lo in range(0, len(at), 2048):
            part = slice(lo, lo + 2048)
            mask = inside[part].astype(np.float32)
            gates = self.table[ids[at[part]]] if len(ids) else np.zeros((*mask.shape, 6 * HIDDEN), np.float32)
            hidden = np.concatenate([self.net.run(gates[..., : 3 * HIDDEN], mask, "f"), self.net.run(gates[..., 3 * HIDDEN :], mask, "b")], axis=2)
            a[part], u[part] = self.net.heads(hidden, mask)
        bias = float(self.net.p["bias"][0]) + self.net.shift
        top = a.max(axis=1)
        e = np.exp(a - top[:, None])
        window = (e * u).sum(axis=1) / e.sum(axis=1)
        peak = np.maximum.reduceat(top, first)
        scale = np.exp(top - peak[of])
        pooled = _sums(scale * (e * u).sum(axis=1), first) / _sums(scale * e.sum(axis=1), first)
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        return logistic(pooled + bias), logistic(np.maximum.reduceat(window, first) + bias), many


SAMPLED = "label int, windows array<array<string>>"


def fitting(rows: list[tuple[int, int, int]], windows: int) -> list[tuple[int, float]]:
    """(doc_id, step) of the rows (doc_id, label, windows), in their order, that fit into so many windows a label.

    A row that doesn't fit is left out, and the rows after it are still taken. A label of which no row fits gives its
    shortest row, of whose windows every step-th is used; all others are used whole (step 1)."""
    out = []
    for label in sorted({y for _, y, _ in rows}):
        own, taken, left = [r for r in rows if r[1] == label], [], windows
        for doc_id, _, n in own:
            if n <= left:
                taken.append((doc_id, 1.0))
                left -= n
        if not taken:
            doc_id, _, n = min(own, key=lambda r: r[2])
            taken = [(doc_id, n / windows)]
        out += taken
    return out


def training_sample(docs: DataFrame, labels: DataFrame, in_training: Column, column: str, sample: int, windows: int) -> tuple[list, np.ndarray, float]:
    """Windows and labels of the bounded sample, and label 1's share of all training labels."""
    spark = docs.sparkSession
    labelled = docs.where(in_training).select(F.col("doc_id").cast("long").alias("doc_id")).join(label_table(labels, column), "doc_id").withColumn("label", (F.col("label") > 0).cast("int"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    ids = [r for y in (0, 1) for r in labelled.where(F.col("label") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if len(counts) < 2:
        return [], np.zeros(0), share
    chosen = spark.createDataFrame([(r["doc_id"], r["label"], k) for k, r in enumerate(ids)], "doc_id long, label int, place int")  # 2 * sample rows

    def cut(batches):
        for batch in batches:
            rows = []
            for label, text, step in zip(batch["label"], batch["text"], batch["step"]):
                words = split_words(text)
                starts = list(window_starts(len(words)))
                starts = starts if step <= 1 else [starts[int(k * step)] for k in range(int(len(starts) / step))]
                rows.append((label, [words[s : s + WINDOW] for s in starts]))
            yield pd.DataFrame(rows, columns=["label", "windows"])

    texts = docs.where(in_training).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.first("place").alias("place"), F.min("text").alias("text"))
    n_windows = F.coalesce(F.ceil(F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S+")) - (WINDOW - STRIDE)) / STRIDE), F.lit(1))
    sizes = texts.select("doc_id", "label", n_windows.alias("n")).orderBy("label", "place").collect()  # 2 * sample rows of numbers
    kept = fitting([(r["doc_id"], r["label"], r["n"]) for r in sizes], windows)
    kept = spark.createDataFrame(kept, "doc_id long, step double")
    got = texts.join(F.broadcast(kept), "doc_id").orderBy("doc_id").select("label", "text", "step").mapInPandas(cut, SAMPLED).collect()
    return [r["windows"] for r in got], np.array([r["label"] for r in got]), share


def score_toxicity(docs: DataFrame, labels: DataFrame, in_training: Column, column: str = "toxic", sample: int = SAMPLE, windows: int = SAMPLE_WINDOWS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, score, window_score (the highest of its windows), n_windows and predicted of each row."""
    texts, y, share = training_sample(docs, labels, in_training, column, sample, windows)
    net = fit_network(texts, y, share, epochs) if len(texts) else None
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                if scorer is None:
                    n = [len(window_starts(len(split_words(t)))) for t in part["text"]]
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": share, "window_score": share, "n_windows": n})
                    continue
                s, w, n = scorer.score(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": s, "window_score": w, "n_windows": n})

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(score, "doc_id long, score double, window_score double, n_windows long")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
