"""Language identification by prediction by partial matching.

For each language, counts of bytes after contexts of up to ``ORDER`` bytes make a context tree.
A byte seen after the longest context is coded by its count there; else an escape is
paid and the next shorter context tried, down to a uniform code over 256 for bytes never seen (escape
method C: a context with n bytes, d of them different, escapes with d / (n + d)); a context that
was never seen costs nothing. The counts are frozen after training, so the code length of each byte after each
context is fixed, and a text's is the sum over its bytes. The lengths of what any language has seen are kept as sparse
tables, an index of grams of each size pointing to rows of one length a language; for what none has seen
after a context, each language's escape and the next shorter gram's length are added.
The language with the shortest code wins; the score is its share of the languages' likelihoods.

Training takes at most ``per_lang`` documents a language (those with the least hash of their
id), and of these as many as come before ``LEARN`` bytes are reached, however large the input. Bytes are
those of the lower-cased text. All bytes that were learned are told apart; those that no language has seen have the same
code length everywhere, so they share a symbol.

Defined results: ``und`` with score 0 for a null text, one without a letter, or with nothing
learned; ties go to the language that sorts first; null languages and null texts aren't learned; repeated rows each get a
row; extra columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from strataquery.llm.common import held_out, map_arrow

PER_LANG, LEARN, ALL, ORDER, CHUNK = 500, 1_000_000, 4_000_000, 3, 1 << 16


@dataclass
class Model:
    """Frozen code lengths in bits, a column a language; m is a gram's size, from 1 to ORDER + 1.

    index[m]: from (row of the gram without its last byte, last symbol) to the gram's row, 0 if no language has it;
    length[m]: of each such gram's last byte after the others; escape[m]: what the gram costs as a context
    that doesn't tell the next byte. Row 0 costs nothing. Single symbols all have rows, which follow their order.
    """

    langs: list[str]
    symbol: np.ndarray
    index: dict[int, np.ndarray]
    length: dict[int, np.ndarray]
    escape: dict[int, np.ndarray]

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the lower-cased text in each language."""
        total, s = np.zeros(len(self.langs)), symbols(text, self.symbol)
        for i in range(ORDER, len(s), CHUNK):
            total += self._part(s[i - ORDER : i + CHUNK])
        return total

    def _part(self, s: np.ndarray) -> np.ndarray:
        """Of the bytes after the first ORDER ones."""
        width = len(self.length[1]) - 1
        rows = {1: s + 1}  # of the gram that ends at each place from m - 1 on
        for m in range(2, ORDER + 2):
            rows[m] = self.index[m][rows[m - 1][:-1] * width + s[m - 1 :]]
        total, left = np.zeros(len(self.langs)), np.arange(ORDER, len(s))
        for m in range(ORDER + 1, 0, -1):
            own = rows[m][left - m + 1]
            total += self.length[m][own].sum(axis=0, dtype=np.float64)
            left = left[own == 0]
            if not len(left):
                break
            total += self.escape[m - 1][rows[m - 1][left - m + 1]].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def symbols(text: str, symbol: np.ndarray) -> np.ndarray:
    """A text's bytes as symbols; spaces stand before it."""
    return symbol[np.frombuffer(b" " * ORDER + text.lower().encode("utf-8", "replace"), np.uint8)]


def train(texts: list[str], langs: list[str]) -> Model:
    """Context trees of each language's texts, frozen as tables of code lengths."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(256, np.int64), {}, {}, {})
    data = [b" " * ORDER + t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    seen = np.bincount(raw, minlength=256) > 0
    seen[32] = True
    width = int(seen.sum()) + 1
    symbol = np.where(seen, np.cumsum(seen) - 1, width - 1)
    sizes = np.array([len(x) for x in data], np.int64)
    s, place = symbol[raw].astype(np.int32), np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lang = np.repeat(np.array([names.index(x) for x in langs], np.int32), sizes)
    learned = place >= ORDER
    index, length, escape = {}, {0: np.full((1, len(names)), 8.0)}, {}
    row, grams = np.zeros(len(raw), np.int32), np.arange(width, dtype=np.int64)  # of the gram before, keys of the grams
    for m in range(1, ORDER + 2):
        # a gram's key: the row of what stands before its last byte, and that byte
        key = np.append(0, row[:-1]).astype(np.int64) * width + s if m > 1 else s.astype(np.int64)
        own = place >= m - 1
        if m > 1:
            grams = np.unique(key[own])
            index[m] = np.zeros(len(length[m - 1]) * width, np.int32)
            index[m][grams] = np.arange(1, len(grams) + 1)
            now = np.where(own, index[m][np.where(own, key, 0)], 0).astype(np.int32)
        else:
            now = s + 1
        count = np.bincount(now[learned].astype(np.int64) * len(names) + lang[learned], minlength=(len(grams) + 1) * len(names)).reshape(-1, len(names))[1:]
        shorter = np.zeros(len(grams), np.int64)
        shorter[now[own] - 1] = row[own] if m > 1 else 0
        context = grams // width if m > 1 else np.zeros(width, np.int64)
        n, d = np.zeros((2, len(length[m - 1]) if m > 1 else 1, len(names)))
        np.add.at(n, context, count)
        np.add.at(d, context, count > 0)
        out = np.log2(np.where(n > 0, (n + d) / np.maximum(d, 1), 1.0))
        bits = np.where(count > 0, np.log2(np.maximum((n + d)[context], 1) / np.maximum(count, 1)), out[context] + length[m - 1][shorter])
        escape[m - 1] = out.astype(np.float32)
        length[m] = np.concatenate([np.zeros((1, len(names))), bits])
        row = now
    return Model(names, symbol, index, {m: x.astype(np.float32) for m, x in length.items() if m}, escape)


def training_rows(docs: DataFrame, per_lang: int) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``per_lang`` documents a language that aren't held out."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("hash", "id"))
    known = docs.select(docs["doc_id"].cast("long").alias("id"), docs["lang"].alias("lang")).where("lang IS NOT NULL").where(~held_out("id"))
    known = known.withColumn("hash", F.xxhash64("id"))
    # a language may hold most rows, so its first ones are found in parts, and then among those
    parts = known.withColumn("rank", first("lang", F.pmod("hash", F.lit(64)))).where(F.col("rank") <= per_lang)
    ids = parts.withColumn("rank", first("lang")).where(F.col("rank") <= per_lang).select("id", "lang").distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["lang"].alias("lang"), docs["text"].alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), ["id", "lang"])
    # whole documents in the order of their hashes, until a language's share of the bytes is reached; an id may stand for many rows
    share = ids.groupBy("lang").count().count()
    share = min(LEARN, ALL // max(1, share))
    w = Window.partitionBy("lang").orderBy("hash", "id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("hash", F.xxhash64("id")).withColumn("before", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0))).where(F.col("before") < share).collect()
    rows.sort(key=lambda r: (r.lang, r.hash, r.id, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, keep: list[str] | None = None, per_lang: int = PER_LANG) -> DataFrame:
    """Adds held_out, lang_pred and score to ``keep`` (all columns by default) of ``docs`` (doc_id, text, lang)."""
    added = ("held_out", "lang_pred", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, per_lang)))
    src = docs.select(*[docs[c] for c in keep], held_out().alias("held_out"), docs["text"].alias("__text"))

    def make():
        m = model.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [m.predict(x.as_py()) for x in batch.column(len(keep) + 1)]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())], names=[*keep, *added])

        return fn

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(src, make, schema)
