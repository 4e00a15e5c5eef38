"""Removal of long repeated byte strings, with bucket-pointer refinement.

Every byte goes that lies in a string of ``length`` bytes which also starts anywhere else.

1. Buckets. Each window of ``length`` bytes is filed under its minimizer: the q-gram with
   the least hash, the leftmost of equals. Windows of a document with the same minimizer are
   neighbours and make a run, with the q-gram at the same place in each. Equal windows have equal
   minimizers, so runs are grouped by their q-gram (the initial bucket) and, within it, by the hash of
   their bytes. Runs that are alike are repeated as a whole, however many there are; that is found
   by counting (64-bit hash of the q-gram, 64-bit hash of the run), without refinement. Equal runs of
   one document are one row with its places.
2. Refinement. A bucket with different runs, one of them alone, needs its bytes: one run of each
   kind goes to the bucket's task. There, positions start in buckets of 8-grams, which
   are refined by sorting on the pair of bucket numbers at the position and at a later offset,
   8 to 16 to 32 bytes and so on up to ``length``: each round reuses the numbers of the
   last, and positions alone in their bucket drop out at once. Exact, without hashing.
3. A bucket with over ``hot`` kinds of run is split before it goes to tasks. All its windows hold the
   same fixed stretch (at first the q-gram) at the same place, and at least half of the window's other
   bytes lie to one side of it: windows with that half to the right are filed under the stretch lengthened
   by that half to the right, the others likewise to the left. So each run gives at most two pieces, each
   window is in one of them, and equal windows stay together. Pieces that are alike are counted as runs
   are; those of smaller buckets are refined as in 2, and larger ones are split again. The bytes that aren't
   fixed halve each time, so this ends after nine rounds at the latest, with pieces of one window.

Only light rows are grouped; a group of copies is one row after partial aggregation. Texts
are shuffled by document to cut out runs, and to remove what is repeated.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; rows that
repeat an id are documents of their own (equal texts repeat one another); a null id is an id; extra
columns pass through; an empty table gives an empty one. Kept bytes that no longer make whole
UTF-8 characters are left out of the kept text, never of the kept bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import in_arrow, map_arrow, stash

LENGTH, HOT, CHUNK = 400, 2048, 500_000
#: Low bits of a minimizer's key that hold its position, and the most bytes handled at a time.
POS_BITS, PIECE = 24, 4_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram(length: int) -> int:
    """q: a power of two, 32 at most."""
    q = 1
    while 2 * q <= min(32, length // 8):
        q *= 2
    return q


def runs(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(hash of q-gram, hash of bytes, first window, windows, place of the q-gram) of each run of a text."""
    parts = [_runs(data[i : i + PIECE + length - 1], length, i) for i in range(0, max(1, len(data) - length + 1), PIECE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def alike(h: np.ndarray, r: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of a text's runs by hashes, where each group of equal ones starts in it)."""
    order = np.lexsort((first, r, h))
    new = (h[order][1:] != h[order][:-1]) | (r[order][1:] != r[order][:-1])
    return order, np.flatnonzero(np.append(True, new)) if len(h) else np.empty(0, np.int64)


def _runs(data: bytes, length: int, shift: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
    q = gram(length)
    g = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _A
    k = 1
    while k < q:
        g = g[:-k] * _A + g[k:] * _B
        g ^= g >> np.uint64(31)
        k *= 2
    g *= _B
    g ^= g >> np.uint64(29)
    w, windows = length - q + 1, n - length + 1
    key = (g >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(len(g), dtype=np.uint64)
    # least key of each w neighbours: the least of a block's end and the next block's start
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    pos = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
    count = np.diff(np.append(first, windows))
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(data)
    own = np.array([digest(view[a : a + c + length - 1]) for a, c in zip(first.tolist(), count.tolist(), strict=True)], np.uint64)
    at = pos[first]
    return g[at].view(np.int64), own.view(np.int64), (first + shift).astype(np.int32), count.astype(np.int32), (at + shift).astype(np.int32)


def repeated(data: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Positions where a string of ``length`` bytes starts that also starts at another position.

    stop: for each position the end of its stretch, over which no string goes. Bucket-pointer
    refinement as in the module's notes.
    """
    n, k = len(data), 1
    while 2 * k <= min(8, length):
        k *= 2
    at = np.arange(n)
    pos = at[at + k <= stop]
    value = np.zeros(len(pos), np.uint64)
    for j in range(k):
        value |= data[pos + j].astype(np.uint64) << np.uint64(8 * j)
    bucket = _refined(n, pos, value)
    while k < length:
        longer = min(2 * k, length)
        pos = np.flatnonzero(bucket >= 0)
        pos = pos[pos + longer <= stop[pos]]
        later = bucket[pos + longer - k]
        pos, later = pos[later >= 0], later[later >= 0]
        bucket = _refined(n, pos, bucket[pos] * n + later)
        k = longer
    return np.flatnonzero(bucket >= 0)


def _refined(n: int, pos: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The bucket's number at each position, -1 for those alone."""
    bucket = np.full(n, -1, np.int64)
    if len(pos):
        order = np.argsort(value, kind="stable")
        value = value[order]
        new = np.append(True, value[1:] != value[:-1])
        alone = new & np.append(new[1:], True)
        number = np.cumsum(new)
        bucket[pos[order[~alone]]] = number[~alone]
    return bucket


def stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


_SLICE = "h long, k1 long, k2 long, first int, alone boolean, hot boolean, bytes binary"


def _slices(wanted: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs, cut out of their documents."""
    by_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "first", "windows", "alone", "hot")).alias("runs"))
    texts = keyed.where(F.octet_length("text") >= length)

    def cut(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            size = 0
            for k1, k2, text, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                for r in rs.as_py():
                    piece = data[r["first"] : r["first"] + r["windows"] + length - 1]
                    for column, x in zip(out, (r["h"], k1, k2, r["first"], r["alone"], r["hot"], piece), strict=True):
                        column.append(x)
                    size += len(piece)
                if size > 8_000_000:
                    yield _batch(out)
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield _batch(out)

    def _batch(out):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["h", "k1", "k2", "first", "alone", "hot", "bytes"])

    return in_arrow(texts.join(by_doc, ["k1", "k2"]).select("k1", "k2", "text", "runs"), cut, _SLICE)


def _refine(slices: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, b): windows a to b of a document's lone runs that are repeated; a bucket's slices are neighbours."""

    def run(batches):
        held, size = [], 0

        def done():
            data = np.frombuffer(b"".join(x[-1] for x in held), np.uint8)
            ends = np.cumsum([len(x[-1]) for x in held])
            hit = repeated(data, np.repeat(ends, [len(x[-1]) for x in held]), length)
            begin = ends - np.array([len(x[-1]) for x in held])
            which = np.searchsorted(ends, hit, "right")
            out = []
            for i in np.unique(which):
                if held[i][4]:
                    out += [(held[i][1], held[i][2], held[i][3] + a, held[i][3] + b) for a, b in stretches(hit[which == i] - begin[i])]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k1", "k2", "a", "b"])

        last = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= CHUNK and row[0] != last:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = row[0]
        if held:
            yield done()

    return in_arrow(slices.drop("hot"), run, "k1 long, k2 long, a int, b int")


_PIECE = "h long, k1 long, k2 long, first int, alone boolean, lo int, hi int, r long, bytes binary"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.binary())


def halves(data: bytes, lo: int, hi: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, fixed from, fixed to) of the pieces of a run whose windows all hold data[lo:hi]; see note 3."""
    last, rest = len(data) - length, length - (hi - lo)
    right = -(-rest // 2)
    left = rest - right + 1
    pieces = [(max(0, hi + right - length), min(last, lo), lo, hi + right), (max(0, hi - length), min(last, lo - left), lo - left, hi)]
    return [p for p in pieces if p[0] <= p[1]]


def _split(slices: DataFrame, length: int) -> DataFrame:
    """Pieces (_PIECE) of the slices of large buckets: h is their new bucket, r the hash of their bytes, lo and hi their fixed stretch."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in _PIECE_TYPES]
            size = 0
            for h, k1, k2, first, alone, lo, hi, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if hi < 0:
                    at = int(_runs(data, length, 0)[4][0])
                    lo, hi = at, at + gram(length)
                for a, z, f, t in halves(data, lo, hi, length):
                    piece = data[a : z + length]
                    key = xxhash.xxh3_64_intdigest(struct.pack("<qi", h, lo - f) + data[f:t])
                    row = (key - (1 << 63), k1, k2, first + a, alone, f - a, t - a, xxhash.xxh3_64_intdigest(piece) - (1 << 63), piece)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    size += len(piece)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PIECE_TYPES, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])
                    out, size = [[] for _ in _PIECE_TYPES], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PIECE_TYPES, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return in_arrow(slices, run, _PIECE)


def _divided(slices: DataFrame, length: int, hot: int) -> list[DataFrame]:
    """(k1, k2, a, b) as of :func:`_refine` for the slices of large buckets, which are split until they are small."""
    found, slices = [], slices.select("h", "k1", "k2", "first", "alone", F.lit(0).alias("lo"), F.lit(-1).alias("hi"), "bytes")
    while True:
        pieces = stash(_split(slices, length), "suffix-pieces")
        # a slice that isn't alone stands for several runs
        weight = F.when(F.col("alone"), 1).otherwise(2)
        kinds = stash(pieces.groupBy("h", "r").agg(F.sum(weight).alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one")), "suffix-piece-kinds")
        place = lambda: (F.col("first").alias("a"), (F.col("first") + F.octet_length("bytes") - length).alias("b"))
        found.append(pieces.where("alone").join(kinds.where("n > 1").select("h", "r"), ["h", "r"]).select("k1", "k2", *place()))
        buckets = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
        wanted = kinds.join(buckets, "h").select("h", "r", "one.*", (F.col("n") == 1).alias("single"), (F.col("kinds") > hot).alias("hot"))
        slices = stash(pieces.drop("alone").join(wanted, ["h", "r", "k1", "k2", "first"]).select("h", "k1", "k2", "first", F.col("single").alias("alone"), "lo", "hi", "bytes", "hot"), "suffix-piece-slices")
        found.append(_refine(slices.where("NOT hot").select("h", "k1", "k2", "first", "alone", "hot", "bytes").repartition("h").sortWithinPartitions("h"), length))
        if slices.where("hot").isEmpty():
            return found
        slices = slices.where("hot").drop("hot")


def repeated_windows(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(k1, k2, firsts, windows): so many windows from each of these on, of each document (k1, k2, text), also start elsewhere."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, starts, at = [], [], 0
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h, r, first, windows, _ = runs(text.as_py().encode("utf-8", "replace"), length)
                order, start = alike(h, r, first)
                one = order[start]
                out.append((np.full(len(start), a), np.full(len(start), b), h[one], r[one], windows[one], first[order]))
                starts.append(start + at)
                at += len(h)
            *cols, firsts = (np.concatenate(x) for x in zip(*out, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.concatenate(starts), at).astype(np.int32)), pa.array(firsts))
            return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), *map(pa.array, cols[2:]), lists], names=["k1", "k2", "h", "r", "windows", "firsts"])

        return fn

    long_enough = keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    rows = stash(map_arrow(long_enough, make, "k1 long, k2 long, h long, r long, windows int, firsts array<int>"), "suffix-runs")
    # what is counted is kept as a table before it is joined: both sides then are plain shuffles, which Spark splits where a group is large
    place = F.struct("k1", "k2", F.col("firsts")[0].alias("first"), "windows")
    kinds = stash(rows.groupBy("h", "r").agg(F.sum(F.size("firsts")).alias("n"), F.min(place).alias("one")), "suffix-kinds")
    whole = rows.join(kinds.where("n > 1").select("h", "r"), ["h", "r"]).select("k1", "k2", "firsts", "windows")
    buckets = stash(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1"), "suffix-buckets")
    wanted = kinds.join(buckets, "h").select("one.*", "h", (F.col("n") == 1).alias("alone"), (F.col("kinds") > hot).alias("hot"))
    slices = _slices(wanted, keyed, length)
    listed = lambda df: df.select("k1", "k2", F.array("a").alias("firsts"), (F.col("b") - F.col("a") + 1).alias("windows"))
    if buckets.where(F.col("kinds") > hot).isEmpty():
        return whole.unionByName(listed(_refine(slices.repartition("h").sortWithinPartitions("h"), length)))
    slices = stash(slices, "suffix-slices")
    out = whole.unionByName(listed(_refine(slices.where("NOT hot").repartition("h").sortWithinPartitions("h"), length)))
    for part in _divided(slices.where("hot"), length, hot):
        out = out.unionByName(listed(part))
    return out


OUTPUTS = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.BinaryType(), "kept_text": T.StringType()}
_ARROW = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string()}


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, keep: list[str] | None = None, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept"), hot: int = HOT) -> DataFrame:
    """``keep`` of ``docs`` (all columns by default) with ``outputs``, names from OUTPUTS, whose namesakes give way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    others = [c for c in keep if c.lower() != text.lower()]
    key = [F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(docs[text]).alias("k2")]
    keyed = docs.select(*key, docs[text].alias("text"))
    windows = repeated_windows(keyed, length, hot)
    spans = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("firsts", "windows")).alias("spans"))
    full = docs.select(*key, docs[text].alias("__text"), F.struct(*[docs[c] for c in others]).alias("__rest") if others else F.lit(0).alias("__rest"))
    joined = full.join(spans, ["k1", "k2"], "left").select("__rest", "__text", "spans")

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: dict[str, list] = {o: [] for o in outputs}
            for x, s in zip(batch.column(1), batch.column(2), strict=True):
                data = (x.as_py() or "").encode("utf-8", "replace")
                mine = s.values.flatten() if s.is_valid else None
                kept, removed, n_spans = data, 0, 0
                if mine is not None:
                    depth = np.zeros(len(data) + 1, np.int32)
                    begin, windows = mine[0].flatten().to_numpy(), np.repeat(mine[1].to_numpy(), mine[0].value_lengths().to_numpy())
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + windows - 1 + length, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed = int(gone.sum())
                    n_spans = int((gone & ~np.append(False, gone[:-1])).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                row = {"n_bytes": len(data), "n_removed": removed, "n_spans": n_spans}
                for o in outputs:
                    cols[o].append(row[o] if o in row else kept if o == "kept" else hashlib.sha256(kept).hexdigest() if o == "kept_sha256" else None if x.as_py() is None else kept.decode("utf-8", "ignore"))
            rest = batch.column(0)
            arrays = [(x if c.lower() == text.lower() else None) for c in keep for x in [batch.column(1)]]
            own = iter(rest.flatten()) if others else iter(())
            arrays = [a if a is not None else next(own) for a in arrays]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(cols[o], _ARROW[o]) for o in outputs]], names=[*keep, *outputs])

        return fn

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(o, OUTPUTS[o]) for o in outputs])
    return map_arrow(joined, make, schema)
