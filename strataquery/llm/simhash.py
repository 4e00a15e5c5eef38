"""SimHash near-duplicate groups with Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into segments of 23, 23 and 18 bits. If two fingerprints differ
in at most three bits, then either no segment differs in more than one bit, or two of the
segments differ in one bit between them at most. The perfect [23,12,7] Golay code decodes any
23 bits to the one codeword within three bits. Two words one bit apart: decoding either one,
or the other with one bit flipped, meets the same codeword. So each fingerprint is filed under
the codeword of a segment and looked up under the codewords of the segment and its one-bit
neighbours (six at most), joined with another segment's codeword or its exact bits:

* tag 0: codewords of segments one and two;
* tags 1 to 6: one segment's bits and another's codeword, for each ordered pair.

Rows that share a key and hold a filed one are compared, and a pair is linked if at most
three bits differ. A task streams its keys in order and gives, for what it has linked, one
edge for each member of a group, never all pairs. The rows of a key with more than ``limit`` are filed anew under
the key and each quarter of their bits, one of which two linked ones share; what is still over
``limit`` is dealt out in blocks, each pair of blocks to a task. Components of the edges
between distinct fingerprints are found by :mod:`components`.

Defined results: null and empty texts have fingerprint zero, which links like any other; texts
with one or two words are one shingle; repeated rows and ids each get a row; a null id is in its
group but never names it while another id is there; other columns pass through; an empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import free_name, in_arrow, map_arrow, stash
from strataquery.llm.components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Rows of a key that one task compares; more are dealt out in blocks of this many.
LIMIT = 4096
#: The binary Golay code's generator polynomial, and the segments as (shift, bits).
GENERATOR, SEGMENTS = 0xAE3, ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, distinct: bool = False) -> int:
    """Signed 64-bit fingerprint of a text; see the module's notes. distinct: a shingle counts once."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if shingle > 1 else words
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in (set(grams) if distinct else grams)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


class Golay:
    """Decoding of 23 bits to the index of the nearest codeword, for whole arrays."""

    def __init__(self):
        self.high = np.array([_remainder(x << 11) for x in range(4096)], np.int64)
        self.leader = np.zeros(2048, np.int64)
        bits = [1 << i for i in range(23)]
        for e in [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]:
            self.leader[_remainder(e)] = e

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.high[v >> 11] ^ (v & 0x7FF)

    def index(self, v: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword within three bits of v."""
        return (v ^ self.leader[self.syndrome(v)]) >> 11

    def indices(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each v its own index first, then those of its one-bit neighbours; a mask of the distinct ones."""
        near = np.concatenate([v[:, None], v[:, None] ^ (1 << np.arange(width))[None, :]], axis=1)
        own = self.index(v)
        idx = np.sort(self.index(near), axis=1)
        new = np.ones(idx.shape, bool)
        new[:, 1:] = idx[:, 1:] != idx[:, :-1]
        new &= idx != own[:, None]
        return np.concatenate([own[:, None], idx], axis=1), np.concatenate([np.ones((len(v), 1), bool), new], axis=1)


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of fp, filed) of each fingerprint (unsigned), as the module's notes say."""
    seg = [((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [golay.indices(v, n) for v, (_, n) in zip(seg, SEGMENTS, strict=True)]
    out_k, out_r, out_f = [], [], []

    def put(tag: int, k: np.ndarray, ok: np.ndarray) -> None:
        row, col = np.nonzero(ok)
        out_k.append(k[row, col] | tag << 36)
        out_r.append(row)
        out_f.append(col == 0)

    (a, ok_a), (b, ok_b) = near[0], near[1]
    n = len(fp)
    put(0, ((a[:, :, None] << 12) | b[:, None, :]).reshape(n, -1), (ok_a[:, :, None] & ok_b[:, None, :]).reshape(n, -1))
    tag = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                put(tag, (seg[i][:, None] << 12) | near[j][0], near[j][1])
                tag += 1
    return np.concatenate(out_k), np.concatenate(out_r), np.concatenate(out_f)


class Union:
    """Union-find over fingerprints of a batch."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        pairs = [(x, r) for x in self.up if (r := self.find(x)) != x]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def link(key: np.ndarray, fp: np.ndarray, filed: np.ndarray, union: Union) -> None:
    """Links what shares a key, one of a pair being filed; rows are sorted by key."""
    if not len(key):
        return
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    has = np.add.reduceat(filed.astype(np.int64), start) > 0
    small = has & (size > 1) & (size <= 64)
    run = np.repeat(np.arange(len(start)), size)
    left = np.flatnonzero(filed & small[run])
    if len(left):
        m = size[run[left]]
        a = np.repeat(left, m)
        b = np.repeat(start[run[left]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        ok = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS) & (fp[a] != fp[b])
        for x, y in zip(fp[a[ok]].view(np.int64).tolist(), fp[b[ok]].view(np.int64).tolist(), strict=True):
            union.add(x, y)
    for r in np.flatnonzero(has & (size > 64)):
        part = slice(start[r], start[r] + size[r])
        x = fp[part]
        label = np.arange(len(x))
        for i in np.flatnonzero(filed[part]):
            near = np.bitwise_count(x ^ x[i]) <= MAX_BITS
            hit = np.unique(label[near])
            if len(hit) > 1:
                label[np.isin(label, hit)] = hit[0]
        lead, values = x.view(np.int64)[label].tolist(), x.view(np.int64).tolist()
        for p, q in zip(values, lead, strict=True):
            if p != q:
                union.add(p, q)


def _linked(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (key, block, fp, filed) sorted by key and block within partitions -> edges (a, b) and, of keys over limit, the rows again."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("filed", pa.bool_()), ("block", pa.int32())])

    def run(batches):
        carry: list[tuple] = []  # the last group's rows so far, as arrays
        over, seen = None, 0  # a group over the limit and its rows so far

        def spilled(g, at):
            key, fp, filed = g
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), pa.array(key), pa.array(fp.view(np.int64)), pa.array(filed), pa.array(((at + np.arange(len(key))) // limit).astype(np.int32))], schema=schema)

        def edges(g):
            union = Union()
            link(*g, union)
            a, b = union.edges()
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int32))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            filed = batch.column(2).to_numpy(zero_copy_only=False)
            if carry:
                group, fp, filed = (np.concatenate([x, y]) for x, y in zip(carry, (group, fp, filed), strict=True))
            if over is not None:  # still inside the group that goes out again
                n = int(np.searchsorted(group, over, "right"))
                yield spilled((group[:n], fp[:n], filed[:n]), seen)
                seen += n
                group, fp, filed = group[n:], fp[n:], filed[n:]
                if not len(group):
                    carry = []
                    continue
                over = None
            cut = int(np.searchsorted(group, group[-1], "left"))
            start = np.flatnonzero(np.append(True, group[1:cut] != group[: max(cut - 1, 0)])) if cut else np.empty(0, int)
            size = np.diff(np.append(start, cut)) if cut else start
            for s, m in zip(start[size > limit], size[size > limit], strict=True):
                yield spilled((group[s : s + m], fp[s : s + m], filed[s : s + m]), 0)
                filed[s : s + m] = False
            if cut:
                yield edges((group[:cut], fp[:cut], filed[:cut]))
            carry = [group[cut:], fp[cut:], filed[cut:]]
            if len(carry[0]) > limit:
                over, seen = carry[0][0], len(carry[0])
                yield spilled(carry, 0)
                carry = []
        if carry:
            yield edges(carry)

    return in_arrow(rows, run, "kind int, a long, b long, filed boolean, block int")


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fps`` (distinct, column fp) within three bits."""

    def make():
        golay = Golay()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy().view(np.uint64)
            k, r, f = keys(fp, golay)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r].view(np.int64)), pa.array(f)], names=["key", "fp", "filed"])

        return fn

    edges, over = _found(map_arrow(fps, make, "key long, fp long, filed boolean"), limit)
    if over is None:
        return edges
    # fingerprints within three bits have one of four quarters in common, so a large key is split by each of them
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3)))
    split = over.withColumn("quarter", quarter).withColumn("bits", F.expr("shiftrightunsigned(fp, 16 * quarter) & 65535"))
    more, over = _found(split.select(F.xxhash64("key", "quarter", "bits").alias("key"), "fp", "filed"), limit)
    edges = edges.unionByName(more)
    if over is None:
        return edges
    # what is large even then goes in blocks: each pair of a key's blocks meets once, under a key of its own
    blocks = over.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = over.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp", "filed")
    return edges.unionByName(_linked(dealt.repartition("key").sortWithinPartitions("key"), 2 * limit + 1).where("kind = 0").select("a", "b"))


def _found(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges, rows of keys over ``limit`` or None) of rows (key, fp, filed)."""
    found = stash(_linked(rows.repartition("key").sortWithinPartitions("key"), limit), "simhash-links")
    over = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "filed", "block")
    return found.where("kind = 0").select("a", "b"), None if over.isEmpty() else over


#: Views (shingle's words, seed, count a shingle once) that together reach copies with four fifths of their five-word shingles alike.
WIDE = ((SHINGLE, SEED, False), (1, 1, True), (1, 2, True), (1, 3, True))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, limit: int = LIMIT, views: tuple[tuple[int, int, bool], ...] = WIDE[:1], root: str | None = None) -> DataFrame:
    """Adds fingerprint (16 hex digits) and component_id (the smallest id that links reach) to ``keep`` of ``docs``.

    keep: all columns by default; those called like the results give way. Texts are read
    once to hash them and not shuffled; only if texts or other columns are kept do they go along.
    views: the fingerprints that link, the first of which is given; two documents are linked if
    any view of theirs is within three bits. root: a further column with a number for each component, null ids or not.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("fingerprint", "component_id")]
    read = list(dict.fromkeys([*keep, id_col, text]))
    src = docs.select(*[docs[c] for c in read])
    at, id_at = read.index(text), read.index(id_col)
    cols = [f"__fp{i or ''}" for i in range(len(views))]

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x.as_py() for x in batch.column(at)]
            fps = [pa.array([fingerprint(x, *v) for x in texts], pa.int64()) for v in views]
            return pa.RecordBatch.from_arrays([batch.column(id_at).cast(pa.int64()), *[batch.column(read.index(c)) for c in keep], *fps], names=["__id", *keep, *cols])

        return fn

    schema = T.StructType([T.StructField("__id", T.LongType()), *[src.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in cols]])
    hashed = stash(map_arrow(src, make, schema), "simhash-fingerprints")
    fps = stash(hashed.groupBy("__fp").agg(F.min("__id").alias("least")), "simhash-distinct")
    edges = links(fps.select(F.col("__fp").alias("fp")), limit)
    for c in cols[1:]:
        # in a further view, the least first fingerprint stands for each of its fingerprints
        pairs = hashed.select("__fp", F.col(c).alias("fp")).distinct()
        named = stash(pairs.groupBy("fp").agg(F.min("__fp").alias("name")), "simhash-view")
        own = pairs.join(named, "fp").where("__fp <> name").select(F.col("__fp").alias("a"), F.col("name").alias("b"))
        far = links(named.select("fp"), limit)
        far = far.join(named.select(F.col("fp").alias("a"), F.col("name").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("name").alias("y")), "b")
        edges = edges.unionByName(own).unionByName(far.select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = components(edges, "simhash-components")
    # tables before joins: two plain shuffles, which Spark splits where a fingerprint or a group holds many rows
    named = stash(nodes.join(fps, nodes.node == fps["__fp"]).groupBy("root").agg(F.min("least").alias("name")), "simhash-names")
    member = nodes.join(named, "root").select(F.col("node").alias("__fp"), "name", "root")
    by_fp = stash(fps.join(member, "__fp", "left").select("__fp", F.coalesce("name", "least").alias("component_id"), F.coalesce("root", "__fp").alias("__root")), "simhash-by-fingerprint")
    out = [F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id", *([F.col("__root").alias(root)] if root else [])]
    return hashed.join(by_fp, "__fp").select(*keep, *out)


def one_of_each(docs: DataFrame, limit: int = LIMIT, views: tuple[tuple[int, int, bool], ...] = WIDE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay: one of each group, with the smallest id (nulls last)."""
    id_key, text_key = F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)), F.xxhash64(docs["text"])
    light = docs.select(id_key.alias("k1"), text_key.alias("k2"), docs["text"].alias("text"))
    groups = near_duplicates(light, "k1", keep=["k1", "k2"], limit=limit, views=views, root="group")
    stay = groups.groupBy("group").agg(F.min(F.struct("k1", "k2")).alias("one")).select("one.*")
    a, b, n = (free_name(docs, x) for x in ("k1", "k2", "n"))
    rows = docs.withColumns({a: id_key, b: text_key})
    if not light.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        # whole rows that repeat: each task keeps its first before the shuffle
        order = F.row_number().over(Window.partitionBy(a, b).orderBy(a))
        rows = rows.withColumn(n, order).where(F.col(n) == 1).drop(n)
    return rows.join(stay.toDF(a, b), [a, b]).select(*[F.col(f"`{c}`") for c in docs.columns])
