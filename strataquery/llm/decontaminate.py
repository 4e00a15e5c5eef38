"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most ``WINDOW`` words. Words are weighted
   by their inverse document frequency over the whole corpus (counted in one pass, for the
   benchmark's words; others don't count). The weight is smoothed and never nothing, so
   an item that has leaked into most documents is still found by its own words.
2. A randomised SVD of the passages' TF-IDF matrix gives the latent space: random
   directions are put through A'A a few times, each product summed over the benchmark's partitions.
   Each ``RANK`` passages of a block have a space of their own, so that none is cut short in it
   and a leak is found whatever the number of items.
3. Every document is cut into overlapping windows of ``WINDOW`` words, which are projected into the
   space. A window is a candidate of a passage if its product with the passage is at least
   ``COVER`` of the passage's with itself, whatever other words it holds, so the size of the corpus
   doesn't matter. Windows whose words can't add up to that for any passage aren't projected.
4. A candidate is checked in the words: the longest common subsequence of the whole item and the
   stretch around the window must hold ``sure`` of the item's words, or ``likely`` of them with
   half of the answer's. The answer is the item's ``answer`` column if it has one, else
   its last fifth.

The corpus is read twice and never shuffled. The benchmark is broadcast in blocks of at most
``ITEMS`` items, one search pass a block, so what is broadcast doesn't grow with the number of items.

Defined results: null and empty texts, and items without words, match nothing; null item ids still
contaminate; among equally good items the smallest id is named; repeated rows each get a row; extra columns
pass through; an empty corpus gives an empty result, an empty benchmark clean documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, islice, product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import in_arrow, map_arrow, stash
from strataquery.llm.toxicity import words_of

BLOCK, WINDOW, RANK, POWER, ITEMS = 16, 48, 256, 2, 2000
SURE, LIKELY, COVER, PARTS = 0.75, 0.55, 0.35, 16


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def passages(words: list[bytes]) -> list[list[bytes]]:
    """At most WINDOW words each, so that every word is in one; a short rest goes with the one before."""
    if len(words) <= WINDOW:
        return [words]
    starts = list(range(0, len(words) - WINDOW, WINDOW // 2)) + [len(words) - WINDOW]
    return [words[s : s + WINDOW] for s in starts]


@dataclass
class Space:
    """Latent space of at most RANK passages."""

    row: np.ndarray  # of each word in the basis; words of no passage here have the last one, which is zero
    basis: np.ndarray  # word -> latent space, weighted
    points: np.ndarray  # passages in the space, each over its length there
    length: np.ndarray  # of the passages in the space
    item_of: np.ndarray


@dataclass
class Index:
    """Benchmark block: words, bounds of what they add, spaces of the passages, items."""

    vocab: dict[bytes, int]
    most: np.ndarray  # for each word and part of the passages, the most it adds to the cover of one; the last row is for other words
    spaces: list[Space]
    items: list[tuple[int | None, list[bytes], list[bytes]]]

    def search(self, text: str | None) -> tuple[bool, int | None, float, float]:
        """(contaminated, best item's id, share of its words in order, cosine)."""
        words = words_of(text).split()
        n, none = len(words), len(self.vocab)
        if not n or not self.spaces:
            return False, None, 0.0, 0.0
        ids = np.fromiter(map(self.vocab.get, words, repeat(none)), np.int64, n)
        held = np.add.reduceat(self.most[ids], np.arange(0, n, BLOCK))
        whole = held.copy()
        for k in range(1, WINDOW // BLOCK):
            whole[:-k] += held[k:]
        likely = np.flatnonzero(whole.max(axis=1) >= 0.999 * COVER)
        best = (False, None, 0.0, 0.0)
        tried: dict[int, list[tuple[int, int]]] = {}
        for b, space in product(likely.tolist(), self.spaces):
            lo, hi = b * BLOCK, min(n, b * BLOCK + WINDOW)
            own = ids[lo:hi]
            point = space.basis[space.row[own[own < none]]].sum(axis=0)
            along = space.points @ point
            cosine = along / max(np.linalg.norm(point), 1e-9)
            for p in np.flatnonzero(along >= COVER * space.length):
                i = int(space.item_of[p])
                item_id, item, answer = self.items[i]
                lo_i, hi_i = max(0, lo - len(item)), min(n, hi + len(item))
                if any(x <= lo and hi <= y for x, y in tried.get(i, ())):
                    continue
                tried.setdefault(i, []).append((lo_i + len(item) // 2, hi_i - len(item) // 2))
                part = words[lo_i:hi_i]
                share = common_subsequence(item, part) / len(item)
                if share >= SURE or share >= LIKELY and common_subsequence(answer, part) >= 0.5 * len(answer):
                    found = (True, item_id, share, float(cosine[p]))
                    if not best[0] or (share, -_key(item_id)) > (best[2], -_key(best[1])):
                        best = found
        return best


def _key(item_id: int | None) -> int:
    return 2**63 if item_id is None else item_id


def frequencies(docs: DataFrame, text: str, vocab: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """(documents, how many of them hold each word of the vocabulary): one pass, sums within tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        own, n = shared.value, 0
        df = np.zeros(len(own), np.int64)
        for b in batches:
            for x in b.column(0):
                words = set(words_of(x.as_py()).split()) if x.is_valid else ()
                hit = [own[w] for w in words if w in own]
                df[hit] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["w", "n"])

    rows = in_arrow(docs.select(docs[text].alias("text")), run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(vocab), np.int64), 0
    for r in rows:
        if r.w < 0:
            total = r.n
        else:
            out[r.w] = r.n
    return total, out


def latent_space(rows: DataFrame, width: int, rank: int = RANK, power: int = POWER, seed: int = 3) -> np.ndarray:
    """Right singular vectors (width x rank) of the sparse matrix ``rows`` (w: array<int>, x: array<double>).

    Randomised: products with A'A are summed over the partitions, each of which gives one block of
    width x rank numbers.
    """
    spark = rows.sparkSession

    def times(q: np.ndarray, gram: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def run(batches):
            m = shared.value
            out = np.zeros((m.shape[1] if gram else width, m.shape[1]))
            for b in batches:
                for w, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    y = np.array(x) @ m[w]
                    if gram:
                        out += np.outer(y, y)
                    else:
                        out[w] += np.outer(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["m"])

        parts = in_arrow(rows, run, "m binary").toLocalIterator()
        return sum(np.frombuffer(r.m).reshape(-1, q.shape[1]) for r in parts)

    q = np.random.default_rng(seed).normal(size=(width, min(width, rank)))
    for _ in range(power):
        q = np.linalg.qr(times(q, False))[0]
    _, u = np.linalg.eigh(times(q, True))
    return q @ u[:, ::-1]


def _space(spark: SparkSession, rows: list[tuple[list[int], list[float]]], weight: np.ndarray, item_of: np.ndarray) -> Space:
    """The space of some passages (words, weighted counts). They are put to length one first, which spans the same space."""
    used = np.unique(np.concatenate([w for w, _ in rows]))
    row = np.full(len(weight), len(used), np.int32)
    row[used] = np.arange(len(used))
    table = spark.createDataFrame([(row[w].tolist(), (np.array(x) / np.linalg.norm(x)).tolist()) for w, x in rows], "w array<int>, x array<double>")
    basis = latent_space(table.repartition(1), len(used), rank=len(rows))
    points = np.array([np.array(x) @ basis[row[w]] for w, x in rows])
    length = np.linalg.norm(points, axis=1)
    basis = np.append(basis * weight[used, None], np.zeros((1, basis.shape[1])), axis=0)
    return Space(row, basis.astype(np.float32), (points / length[:, None]).astype(np.float32), length, item_of)


def build(items: list, answers: bool, docs: DataFrame, text: str) -> Index:
    """The index of one block of items (rows id, text, and answer if ``answers``)."""
    own = []
    for r in items:
        words = words_of(r.text).split()
        if words:
            answer = words_of(r.answer).split() if answers and r.answer else []
            own.append((r.id, words, answer or words[-max(3, len(words) // 5) :]))
    cut = [(i, p) for i, (_, words, _) in enumerate(own) for p in passages(words)]
    vocab: dict[bytes, int] = {}
    for _, p in cut:
        for w in p:
            vocab.setdefault(w, len(vocab))
    if not cut:
        return Index({}, np.zeros((1, 1)), [], [])
    total, df = frequencies(docs, text, vocab)
    weight = np.log1p(max(total, 1) / (df + 1))
    parts = min(len(cut), max(PARTS, -(-len(cut) // PARTS)), 4 * PARTS)
    most = np.zeros((len(vocab) + 1, parts), np.float32)
    rows = []
    for k, (_, p) in enumerate(cut):
        w, tf = np.unique([vocab[x] for x in p], return_counts=True)
        x = tf * weight[w]
        most[w, k % parts] = np.maximum(most[w, k % parts], x * weight[w] / (x @ x))
        rows.append((w.tolist(), x.tolist()))
    item_of = np.array([i for i, _ in cut])
    spaces = [_space(docs.sparkSession, rows[k : k + RANK], weight, item_of[k : k + RANK]) for k in range(0, len(rows), RANK)]
    return Index(vocab, most, spaces, own)


ADDED = (("contaminated", T.BooleanType(), pa.bool_()), ("item_id", T.LongType(), pa.int64()), ("item_share", T.DoubleType(), pa.float64()), ("cosine", T.DoubleType(), pa.float64()))


def _searched(docs: DataFrame, keep: list[str], text: str, index: Index, hits_only: bool) -> DataFrame:
    """``keep`` with the result of one block of items, for all documents or only for hits."""
    names = [n for n, _, _ in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(index)
    src = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))

    def make():
        own = shared.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = list(zip(*(own.search(x.as_py()) for x in batch.column(len(keep))), strict=True))
            found = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, t) for c, (_, _, t) in zip(out, ADDED, strict=True)]], names=[*keep, *names])
            return found.filter(found.column(len(keep))) if hits_only else found

        return fn

    return map_arrow(src, make, T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t, _ in ADDED]))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, block: int = ITEMS) -> DataFrame:
    """Adds contaminated, item_id, item_share and cosine to ``keep`` (all columns by default) of ``docs`` (doc_id, text, ...).

    benchmark: item_id, text and maybe answer. With more than ``block`` items, each block is one pass that keeps its
    hits, which are few; the best hit of a document is joined to it at the end.
    """
    names = [n for n, _, _ in ADDED]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    answers = "answer" in benchmark.columns
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text", *(["answer"] if answers else [])).where("text IS NOT NULL")
    rows = iter(items.orderBy("id", "text").toLocalIterator())
    first = list(islice(rows, block))
    held = list(islice(rows, block))
    if not held:
        return _searched(docs, keep, text, build(first, answers, docs, text), False)
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(docs[text]).alias("k2")]
    light = docs.select(*key, docs[text].alias("text"))
    hits = None
    for part in chain([first, held], iter(lambda: list(islice(rows, block)), [])):
        found = stash(_searched(light, ["k1", "k2"], "text", build(part, answers, docs, text), True), "leaks")
        hits = found if hits is None else hits.unionByName(found)
    order = F.struct("item_share", F.negative(F.coalesce("item_id", F.lit(2**63 - 1))).alias("o"))
    best = stash(hits.groupBy("k1", "k2").agg(F.max_by(F.struct(*names), order).alias("best")), "leaks-best")
    out = docs.select(*key, F.struct(*[docs[c] for c in keep]).alias("kept") if keep else F.lit(0).alias("kept")).join(best, ["k1", "k2"], "left")
    none = {"contaminated": F.lit(False), "item_share": F.lit(0.0), "cosine": F.lit(0.0), "item_id": F.lit(None).cast("long")}
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], *[F.coalesce(F.col("best")[n], none[n]).alias(n) for n in names])
