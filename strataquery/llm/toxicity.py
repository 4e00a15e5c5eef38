"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is cut into phrases of ``PHRASE`` words. A phrase is the bag of its words' character n-grams (a word's edges
count as characters), whose embeddings are averaged and put through a linear softmax, so a misspelling that was
never seen is scored by the n-grams it shares. A document's logit gathers those of its phrases (the logarithm of the sum of their
exponentials), so that one toxic phrase is enough in a long text and several count for more.

Embeddings and softmax are trained jointly, in numpy, on documents' labels alone. At first random
phrases of a document stand for it, so that n-grams which are commoner in toxic documents
stand out; then its highest phrases do, weighted by their share of the sum, as the gradient has it.
A logistic fit over training documents that the embeddings weren't learned from turns logits into scores.

Training takes at most ``per_class`` documents of either label (those with the least hash of
their id), however large the input; scoring reads every whole text once and shuffles nothing.

Defined results: a null or empty text, or one without words, has the score of the lowest training logit;
without both labels to learn from, every score is the share of toxic ones (0 with no
labels at all); of several labels of a document the highest counts; repeated rows each get a row; extra columns pass through; an
empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import held_out, map_arrow

PER_CLASS, THRESHOLD = 4000, 0.7
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5, 6)
#: Words of a phrase; bytes of a text that are scored at a time (only words longer than that are cut).
PHRASE, PIECE = 3, 1 << 20
#: Rounds with random phrases (so many of a document) and with the highest ones, and the step.
WARM, RANDOM, SHARP, HIGHEST, STEP, BATCH = 4, 12, 12, 3, 0.5, 256
#: Every ASCII byte that isn't a letter or a digit parts words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MULTIPLIER = np.uint32(0x01000193)


def words_of(text: str | None) -> bytes:
    """Lower-case words with a space before, between and after them."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_WORDS) + b"  "


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram of each size at each position, -1 where it would go over a word's edge; words' starts less one."""
    raw = np.frombuffer(data, np.uint8)
    space = raw == 32
    n = len(raw)
    out = np.full((len(GRAMS), n), -1, np.int32)
    h = raw.astype(np.uint32) + np.uint32(1)
    inside = np.ones(n, bool)  # no space between the ends
    for k in range(1, max(GRAMS)):
        if k >= n:
            break
        if k > 1:
            inside = inside[:-1] & ~space[k - 1 : n - 1]
        else:
            inside = inside[: n - 1]
        h = (h[:-1] * _MULTIPLIER) ^ (raw[k:].astype(np.uint32) + np.uint32(k * 257))
        if k + 1 in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            out[GRAMS.index(k + 1), : n - k] = np.where(inside, (mixed & np.uint32(BUCKETS - 1)).astype(np.int32), -1)
    start = np.flatnonzero(space[:-1] & ~space[1:])
    return out, start


@dataclass
class Model:
    """weight[g]: what an n-gram adds to a phrase's mean logit; the last entry is for none."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    floor: float

    def phrases(self, data: bytes) -> np.ndarray:
        """The logit of each phrase of :func:`words_of`."""
        g, start = grams(data)
        if not len(start):
            return np.empty(0)
        start = start[::PHRASE]
        add, count = self.weight[g].sum(axis=0, dtype=np.float64), (g >= 0).sum(axis=0)
        total, n = np.add.reduceat(add, start), np.add.reduceat(count, start)
        return total[n > 0] / n[n > 0] + self.bias

    def logit(self, text: str | None) -> float | None:
        """None for a text without words of at least one n-gram."""
        z = [self.phrases(part) for part in pieces(words_of(text))]
        z = np.concatenate(z)
        return float(np.logaddexp.reduce(z)) if len(z) else None

    def score(self, text: str | None) -> float:
        x = self.logit(text) if self.slope else None
        return self.floor if x is None else _sigmoid(self.slope * x + self.offset)


def pieces(data: bytes) -> list[bytes]:
    """The words in parts of about PIECE bytes, each with spaces around."""
    out, i, end = [], 0, len(data) - 2
    while end - i > PIECE + 2:
        cut = data.find(b" ", i + PIECE, min(end, i + 2 * PIECE))
        if cut < 0:
            cut = i + PIECE
        out.append(b" " + data[i:cut].strip(b" ") + b"  ")
        i = cut
    return [*out, b" " + data[i:end].strip(b" ") + b"  "]


def _sigmoid(x):
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def constant(share: float) -> Model:
    return Model(np.zeros(BUCKETS + 1, np.float32), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))), share)


class Embeddings:
    """The n-grams' table and the softmax over the mean of a phrase's, trained by Adagrad."""

    def __init__(self, rng: np.random.Generator):
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.fast_table, self.fast_out = np.full(BUCKETS, 1e-5, np.float32), np.full(self.out.shape, 1e-5, np.float32)

    def collapsed(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to a mean logit (the last one, for none, nothing) and the bias: the same as the softmax, as it is linear."""
        return np.append(self.table @ (self.out[:, 1] - self.out[:, 0]), 0).astype(np.float32), float(self.bias[1] - self.bias[0])

    def learn(self, bag: np.ndarray, owner: np.ndarray, target: np.ndarray, share: np.ndarray) -> None:
        """One step. bag: n-grams of phrases, owner: each one's phrase; target and share: class and weight of each phrase."""
        n = np.maximum(np.bincount(owner, minlength=len(target)), 1).astype(np.float32)
        at, back = np.unique(bag, return_inverse=True)
        rows = self.table[at]
        hidden = np.stack([np.bincount(owner, rows[back, d], len(target)) for d in range(DIM)], axis=1).astype(np.float32) / n[:, None]
        z = hidden @ self.out + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p *= (share / share.sum())[:, None]
        grad_out, grad_hidden = hidden.T @ p, (p @ self.out.T) / n[:, None]
        self.fast_out += grad_out**2
        self.out -= STEP * grad_out / np.sqrt(self.fast_out)
        self.bias -= STEP * p.sum(axis=0)
        step = np.stack([np.bincount(back, grad_hidden[owner, d], len(at)) for d in range(DIM)], axis=1).astype(np.float32)
        self.fast_table[at] += (step**2).mean(axis=1)
        self.table[at] = rows - STEP * step / np.sqrt(self.fast_table[at])[:, None]


class Corpus:
    """Training documents as words, words as bags of n-grams."""

    def __init__(self, texts: list[str]):
        ids: dict[bytes, int] = {}
        docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t).split()], np.int32) for t in texts]
        words, bags, sizes = list(ids), [], np.zeros(len(ids), np.int64)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            g, start = grams(b" " + b" ".join(part) + b"  ")
            size = np.add.reduceat((g >= 0).sum(axis=0), start)
            g = g.T.ravel()
            bags.append(g[g >= 0])
            sizes[i : i + len(part)] = size
        self.bag = np.concatenate(bags) if bags else np.empty(0, np.int32)
        self.first, self.sizes = np.append(0, np.cumsum(sizes)), sizes
        # phrases of all documents, one after the other: their words' places, n-grams, and each document's first one
        words, lengths = np.concatenate([*docs, np.empty(0, np.int32)]), np.array([len(d) for d in docs])
        self.words, begin = words, np.append(0, np.cumsum(lengths))
        self.starts = np.concatenate([*(np.arange(a, b, PHRASE) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)), np.empty(0, np.int64)])
        self.ends = np.minimum(self.starts + PHRASE, np.repeat(begin[1:], -(-lengths // PHRASE)))
        self.phrase = np.append(0, np.cumsum(-(-lengths // PHRASE)))
        self.counts = np.add.reduceat(sizes[words], self.starts) if len(words) else np.empty(0, np.int64)

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """Of all phrases; those without n-grams have none (minus infinity)."""
        if not len(self.words):
            return np.empty(0)
        sums = np.append(0, np.cumsum(weight[self.bag], dtype=np.float64))
        own = (sums[self.first[1:]] - sums[self.first[:-1]])[self.words]
        return np.where(self.counts > 0, np.add.reduceat(own, self.starts) / np.maximum(self.counts, 1) + bias, -np.inf)

    def gathered(self, z: np.ndarray) -> np.ndarray:
        """Each document's logit, nan without phrases."""
        out = np.full(len(self.phrase) - 1, np.nan)
        for i, (a, b) in enumerate(zip(self.phrase[:-1].tolist(), self.phrase[1:].tolist(), strict=True)):
            if b > a and np.isfinite(x := np.logaddexp.reduce(z[a:b])):
                out[i] = x
        return out

    def grams_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, which phrase each is of) of phrases by their numbers."""
        n = self.ends[phrases] - self.starts[phrases]
        word = self.words[np.repeat(self.starts[phrases] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())]
        owner, size = np.repeat(np.arange(len(phrases)), n), self.sizes[word]
        at = np.repeat(self.first[word] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        return self.bag[at], np.repeat(owner, size)


def learned(corpus: Corpus, own: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias from the documents ``own``."""
    model = Embeddings(rng)
    own = own[np.diff(corpus.phrase)[own] > 0]
    balance = {v: 0.5 / max(1, (y[own] == v).sum()) for v in (0, 1)}
    for turn in range(WARM + SHARP):
        order = rng.permutation(own)
        for j in range(0, len(order), BATCH):
            if turn >= WARM and j % (4 * BATCH) == 0:
                z = corpus.logits(*model.collapsed())
            phrases, target, share = [], [], []
            for i in order[j : j + BATCH].tolist():
                a, b = int(corpus.phrase[i]), int(corpus.phrase[i + 1])
                if turn < WARM:
                    some = np.arange(a, b) if b - a <= RANDOM else rng.integers(a, b, RANDOM)
                    mine = np.full(len(some), 1 / len(some))
                else:
                    part = z[a:b]
                    top = np.argpartition(-part, HIGHEST - 1)[:HIGHEST] if b - a > HIGHEST else np.arange(b - a)
                    mine, some = np.exp(np.clip(part[top] - part.max(), -30, 0)) if np.isfinite(part.max()) else np.ones(len(top)), a + top
                    mine /= mine.sum()
                phrases.append(some)
                target.append(np.full(len(some), y[i]))
                share.append(mine * balance[y[i]])
            model.learn(*corpus.grams_of(np.concatenate(phrases)), np.concatenate(target), np.concatenate(share).astype(np.float32))
    return model.collapsed()


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fits a model to labelled texts; numpy only."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    corpus = Corpus(texts)
    # the logits of each half of the documents come from the other half, for the logistic fit
    half = np.zeros(len(y), bool)
    for v in (0, 1):
        half[rng.permutation(np.flatnonzero(y == v))[::2]] = True
    x = np.full(len(y), np.nan)

    for side in (False, True):
        if len(np.unique(y[half == side])) == 2:
            z = corpus.gathered(corpus.logits(*learned(corpus, np.flatnonzero(half == side), y, rng)))
            x[half != side] = z[half != side]
    weight, bias = learned(corpus, np.arange(len(y)), y, rng)
    if np.isnan(x).all():
        x = corpus.gathered(corpus.logits(weight, bias))
    ok = ~np.isnan(x)
    if not ok.any():
        return constant(float(y.mean()))
    slope, offset = platt(x[ok], y[ok], balanced=True)
    return Model(weight, bias, slope, offset, _sigmoid(slope * x[ok].min() + offset))


def platt(x: np.ndarray, y: np.ndarray, balanced: bool = False) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton's method with a little weight decay. balanced: either class weighs as much."""
    a, b = 1.0, 0.0
    v = np.where(y == 1, len(y) / 2 / max(1, (y == 1).sum()), len(y) / 2 / max(1, (y == 0).sum())) if balanced else np.ones(len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = v * (p * (1 - p) + 1e-6)
        g = np.array([(v * (p - y) * x).sum() + 1e-2 * a, (v * (p - y)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 0.0)), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` documents of each label that aren't held out."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(~held_out("id"))
    picked = None
    for v in (0, 1):
        some = known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")).join(F.broadcast(picked), "id").orderBy(F.xxhash64("id"), "id", "text").limit(2 * per_class).collect()
    return [r.text or "" for r in rows], [r.y for r in rows]


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: list[str] | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """Adds held_out, score and predicted to ``keep`` (all columns by default) of ``docs`` (doc_id, text)."""
    added = ("held_out", "score", "predicted")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels, label, per_class)))
    free = [docs[c] for c in keep]
    src = docs.select(*free, held_out().alias("held_out"), docs["text"].alias("__text"))

    def make():
        m = model.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array([m.score(x.as_py()) for x in batch.column(len(keep) + 1)], np.float64)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, *added])

        return fn

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(src, make, schema)
