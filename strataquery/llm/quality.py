"""Quality by co-training of two views.

One classifier sees a text's content (shares of character classes and of each ASCII mark, word and line
statistics), the other the page's metadata (source, language, stated length). Both
are logistic. They start from the same labelled documents. In each round, every other document of the whole corpus
that isn't held out is shown to both; those that one view is sure of teach the other: a step (Newton's, with the Hessian's
bound, so that it never goes too far) over the labelled documents and all of these, which together weigh as much as
the labelled ones of their label at most, whatever the size of the corpus. How sure a view is comes from a logistic
fit over labelled documents that it wasn't fitted to, so a view that says little teaches nothing. Last, each view is calibrated on the labelled
documents, and a logistic fit over the two calibrated logits scores all documents. A view
that says nothing gets no weight.

The labelled documents are at most ``per_class`` of either label (those with the least hash of their id). The features of all
others are kept as a table, which each round reads once; its sums are added up in tasks, so that the
driver gets a fixed number of rows. Held-out documents aren't learned from.

Defined results: a null text is empty; null metadata are a value of their own; missing metadata
columns count as null; with one label only, or none, every score is 1 (all documents are kept); of several
labels of a document the highest counts; repeated rows each get a row; extra columns pass
through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import drop_stash, held_out, in_arrow, map_arrow, stash
from strataquery.llm.toxicity import platt

PER_CLASS, ROUNDS, THRESHOLD, DECAY = 3000, 5, 0.3, 2.0
#: The logit from which a view is sure (a probability of 0.95), and rows of sums that the driver gets.
SURE, ROWS = float(np.log(19)), 32
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_UPPER, _LOWER, _DIGIT = (np.array([i for i in range(128) if f(chr(i))]) for f in (str.isupper, str.islower, str.isdigit))
SOURCES, LANGS = 64, 16


def content(text: str | None) -> np.ndarray:
    """Features of the text's view."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    marks = count[_MARKS]
    k = max(1, len(words))
    upper, lower = count[_UPPER].sum(), count[_LOWER].sum()
    own = [
        upper / n, lower / n, count[_DIGIT].sum() / n, count[128:].sum() / n, count[32] / n, count[10] / n, marks.sum() / n, marks.sum() / k,
        upper / max(1, upper + lower), n / k / 10, len(set(words)) / k, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 10, np.log1p(k / max(1, len(lines))) / 10, float(not words),
    ]
    return np.concatenate([own, np.sqrt(marks / k), [1.0]])


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, float]:
    """What the page's view looks at: buckets of source and language, the logarithm of the stated length."""
    return crc32(repr(source).encode()) % SOURCES, crc32(repr(lang).encode()) % LANGS, float(np.log1p(max(0, n_chars or 0)))


def spread(rows: list[tuple[int, int, float]]) -> np.ndarray:
    """Features of the page's view from rows of :func:`metadata`."""
    out, size = np.zeros((len(rows), SOURCES + LANGS + 12)), np.array([r[2] for r in rows])
    at = np.arange(len(rows))
    out[at, [r[0] for r in rows]] = 1
    out[at, [SOURCES + r[1] for r in rows]] = 1
    out[at, SOURCES + LANGS + np.minimum(9, size.astype(int))] = 1
    out[:, -2], out[:, -1] = size / 10, 1.0
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    w: np.ndarray = field(default_factory=lambda: np.zeros(1))
    #: How sure a logit is: slope and offset of the logit of being right.
    slope: float = 1.0
    offset: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.mean, self.scale = np.where(self.scale < 1e-9, 0, self.mean), np.where(self.scale < 1e-9, 1, self.scale)
        self.w = np.zeros(x.shape[1])
        for _ in range(30):
            g, h = self.slopes(x, y)
            step = np.linalg.solve(h, g)
            self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def weighed(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """The same with slope and offset from logits of each half of the documents by a fit to the other half."""
        half, logit = np.arange(len(y)) % 2 == 0, np.zeros(len(y))
        if min(len(np.unique(y[half])), len(np.unique(y[~half]))) < 2:
            return Logistic(self.mean, self.scale, self.w, 0.0, 0.0)
        for side in (half, ~half):
            logit[~side] = Logistic().fit(x[side], y[side]).logit(x[~side])
        return Logistic(self.mean, self.scale, self.w, *platt(logit, y))

    def slopes(self, x: np.ndarray, y: np.ndarray, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian (or its bound) of the loss, in which either label weighs as much, with weight decay."""
        z = self.standard(x)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        g = z.T @ (weight * (p - y)) + DECAY * self.w
        curve = 0.25 if bound else p * (1 - p) + 1e-6
        return g, (z * (weight * curve)[:, None]).T @ z + DECAY * np.eye(len(self.w))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.standard(x) @ self.w, -30, 30)


@dataclass
class Model:
    """views: the classifiers; calibration: slope and offset of each; weights: of the calibrated logits and 1."""

    views: tuple[Logistic, Logistic] | None
    calibration: list[tuple[float, float]]
    weights: np.ndarray

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.ones(len(a))
        z = np.stack([s * v.logit(x) + o for v, (s, o), x in zip(self.views, self.calibration, (a, b), strict=True)] + [np.ones(len(a))], axis=1)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def told(views: tuple[Logistic, Logistic], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over documents that one view is sure of, for the other one's step; sums of parts add up.

    For each view and label (1, then 0): how many documents, gradient, bound of the Hessian.
    """
    x, out = (a, b), []
    logits = [v.logit(f) for v, f in zip(views, x, strict=True)]
    for i, v in enumerate(views):
        z, p = v.standard(x[i]), 1 / (1 + np.exp(-logits[i]))
        other = views[1 - i].slope * logits[1 - i] + views[1 - i].offset
        for label, sure in ((1, other >= SURE), (0, other <= -SURE)):
            own = z[sure]
            out += [[sure.sum()], own.T @ (p[sure] - label), 0.25 * (own.T @ own).ravel()]
    return np.concatenate(out)


def step(views: tuple[Logistic, Logistic], a: np.ndarray, b: np.ndarray, y: np.ndarray, sums: np.ndarray) -> tuple[Logistic, Logistic]:
    """Both views after a step over the labelled documents (a, b, y) and what the other view told them (sums)."""
    out, at = [], 0
    for v, x in zip(views, (a, b), strict=True):
        d = len(v.w)
        g, h = v.slopes(x, y, bound=True)
        for label in (1, 0):
            n, known = sums[at], (y == label).sum()
            weight = min(1.0, known / n) * 0.5 / known * len(y) if n else 0.0
            g = g + weight * sums[at + 1 : at + 1 + d]
            h = h + weight * sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
            at += 1 + d + d * d
        out.append(Logistic(v.mean, v.scale, v.w - np.linalg.solve(h, g), v.slope, v.offset))
    return out[0], out[1]


def train(a: np.ndarray, b: np.ndarray, y: np.ndarray, tell: Callable[[tuple[Logistic, Logistic]], np.ndarray]) -> Model:
    """Co-trains on two views of labelled documents; ``tell`` gives the sums of :func:`told` over all others."""
    if len(np.unique(y)) < 2:
        return Model(None, [], np.zeros(3))
    views, x = (Logistic().fit(a, y).weighed(a, y), Logistic().fit(b, y).weighed(b, y)), (a, b)
    for _ in range(ROUNDS):
        views = step(views, a, b, y, tell(views))
    calibration = [platt(v.logit(f), y) for v, f in zip(views, x, strict=True)]
    z = np.stack([s * v.logit(f) + o for v, (s, o), f in zip(views, calibration, x, strict=True)] + [np.ones(len(y))], axis=1)
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        prior = np.array([w[0] - 1, w[1], w[2]]) * 5.0
        move = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 5.0 * np.eye(3), z.T @ (p - y) + prior)
        w -= np.clip(move, -1, 1)
    return Model(views, calibration, w)


def with_metadata(docs: DataFrame) -> list[F.Column]:
    """(doc_id, text, source, lang, n_chars) of ``docs``, null where a column is missing."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return [(docs[c].try_cast(k) if c in docs.columns else F.lit(None).cast(k)).alias(f"__{c}") for c, k in kinds.items()]


def _features(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([content(x.as_py()) for x in batch.column(at + 1)])
    return a, spread([metadata(*x) for x in zip(*(batch.column(at + i).to_pylist() for i in (2, 3, 4)), strict=True)])


_KEPT = "a binary, source int, lang int, size double"


def _kept(rows: DataFrame) -> DataFrame:
    """The features of ``rows`` (see with_metadata) in a compact form."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            a = [content(x.as_py()).astype(np.float32).tobytes() for x in batch.column(1)]
            b = [metadata(*x) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            cols = list(zip(*b, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()), strict=True)]], names=["a", "source", "lang", "size"])

        return fn

    return map_arrow(rows, make, _KEPT)


def _sums(kept: DataFrame, views: tuple[Logistic, Logistic]) -> np.ndarray:
    """The sums of :func:`told` over a table of features: one row a task, which at most ROWS tasks add up."""
    shared = kept.sparkSession.sparkContext.broadcast(views)
    width = sum(2 * (1 + len(v.w) + len(v.w) ** 2) for v in views)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                a = np.frombuffer(b"".join(part.column(0).to_pylist()), np.float32).reshape(part.num_rows, -1)
                total += told(shared.value, a.astype(float), spread(list(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    rows = in_arrow(in_arrow(kept, tell, "m binary").repartition(ROWS), add, "m binary").collect()
    return sum((np.frombuffer(r.m) for r in rows), np.zeros(width))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Trains on a bounded sample of labelled documents and all others; see the module's notes."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(~held_out("id"))
    order = (F.xxhash64("id"), "id")
    picked = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    full = docs.select(*with_metadata(docs))
    rows = full.join(F.broadcast(picked), F.col("__doc_id") == F.col("id"))

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = _features(batch, 0)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(6), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64()))], names=["id", "y", "a", "b"])

        return fn

    got = map_arrow(rows.select("__doc_id", "__text", "__source", "__lang", "__n_chars", "id", "y"), make, "id long, y int, a array<double>, b array<double>").orderBy("id", "y", "a", "b").limit(2 * per_class).collect()
    y = np.array([r.y for r in got])
    if len(np.unique(y)) < 2:
        return Model(None, [], np.zeros(3))
    others = full.where(~held_out("__doc_id")).join(F.broadcast(picked.select(F.col("id").alias("__doc_id"))), "__doc_id", "left_anti")
    kept = stash(_kept(others.select("__doc_id", "__text", "__source", "__lang", "__n_chars")), "quality-features")
    model = train(np.array([r.a for r in got]), np.array([r.b for r in got]), y, lambda views: _sums(kept, views))
    drop_stash(kept)
    return model


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """Adds quality_score (0 to 1) and quality_pred (1 from THRESHOLD on) to ``keep`` (all columns by default) of ``docs``."""
    added = ("quality_score", "quality_pred")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class=per_class))
    src = docs.select(*[docs[c] for c in keep], *with_metadata(docs))

    def make():
        m = model.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = m.score(*_features(batch, len(keep)))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, *added])

        return fn

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("quality_score", T.DoubleType()), T.StructField("quality_pred", T.IntegerType())])
    return map_arrow(src, make, schema)
