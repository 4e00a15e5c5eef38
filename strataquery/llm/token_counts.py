"""Exact token counts of whole texts by a map-side two-tier lookup.

The model's pieces never hold a space after another character, so a text falls into
pre-tokens that start at a space and are encoded apart. Tier one is a compact table of the
frequent pre-tokens' lengths in tokens, broadcast to the workers: it comes from a sample of
about ``sample_docs`` documents and has at most ``table_size`` entries, and so is bounded
however large the input is; it changes speed, never a count. Tier two is each worker's
cache: the library encodes a missed pre-token once. Pre-tokens are never shuffled (the
sample's own counts apart).

Defined results: a null or empty text has no bytes and no tokens; repeated rows each get a
row; other columns are dropped but for those asked for; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.llm.common import drop_stash, map_arrow, stash, worker_state

SAMPLE_DOCS, TABLE_SIZE, CACHE_SIZE, CACHED_CHARS = 20_000, 100_000, 300_000, 64

_SPACED = re.compile(" +[^ ]*").findall


def pre_tokens(text: str) -> list[str] | None:
    """Pre-tokens without the space they start with; those after a line break start with it instead.

    Their lengths add up to the text's: the model puts a space before a text and has no piece
    with a line break. None for texts with runs of spaces, spaces at an edge or U+2581.
    """
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or "▁" in text:
        return None
    return text.replace("\n", " \n").split(" ")


def odd_pre_tokens(text: str) -> list[str]:
    """For texts with runs of spaces or breaks: cuts at spaces only."""
    return [x[1:] for x in _SPACED(" " + text.replace("▁", " "))]


def check_model(model) -> None:
    """Raises unless the model lets texts be cut as above."""
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or re.search("[^▁]▁", piece):
            raise ValueError(f"piece {piece!r} crosses a pre-token's edge")
    probe = "  a  b\n\n c▁d  "
    if "".join(model.id_to_piece(i) for i in model.encode(probe)).replace("<0x0A>", "\n") != "▁" + probe.replace(" ", "▁"):
        raise ValueError("the model changes white space")


class Counts:
    """Counts of one model, with a worker's cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        self.bare = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a space at the end of a text
        self.cache: dict[str, int] = {}

    def lengths(self, tokens: list[str]) -> list[int]:
        """A pre-token after a line break has the text's leading space counted with it; that goes."""
        return [len(ids) - x.startswith("\n") for x, ids in zip(tokens, self.model.encode(tokens, num_threads=1), strict=True)] if tokens else []

    def count(self, text: str | None, table: dict[str, int]) -> int:
        if not text:
            return 0
        tokens = pre_tokens(text)
        if tokens is None:
            tokens = odd_pre_tokens(text)  # these may start with a line break that follows a space
            found = [self.bare if not x else None if x.startswith("\n") else table.get(x) for x in tokens]
            return sum(n for n in found if n is not None) + sum(len(x) for x in self.model.encode([x for x, n in zip(tokens, found, strict=True) if n is None], num_threads=1))
        found = list(map(table.get, tokens))
        if None not in found:
            return sum(found)
        missed = [x for x, n in zip(tokens, found, strict=True) if n is None]
        total = sum(n for n in found if n is not None)
        cache = self.cache
        again = list(map(cache.get, missed))
        new = list({x for x, n in zip(missed, again, strict=True) if n is None})
        total += sum(n for n in again if n is not None)
        if new:
            own = dict(zip(new, self.lengths(new), strict=True))
            total += sum(own[x] for x, n in zip(missed, again, strict=True) if n is None)
            if len(cache) + len(own) > CACHE_SIZE:
                cache.clear()
            cache.update((k, v) for k, v in own.items() if len(k) <= CACHED_CHARS)
        return total


def load(path: str) -> Counts:
    return worker_state(("counts", path), lambda: Counts(path))


def frequent(docs: DataFrame, path: str, text: str = "text", sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """The broadcast table: pre-tokens of a bounded sample, the most frequent first, with their lengths."""
    n = docs.count()
    share = docs if n <= sample_docs else docs.sample(sample_docs / n, seed=1)

    def count(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for x in b.column(0):
                x = x.as_py()
                if x:
                    seen.update(t for t in pre_tokens(x) or () if len(t) <= CACHED_CHARS)
            if len(seen) > 4 * table_size:  # rare ones go, to bound the memory
                seen = Counter(dict(seen.most_common(2 * table_size)))
        for i in range(0, len(top := seen.most_common(table_size)), 20_000):
            part = top[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([v for _, v in part], pa.int64())], names=["t", "n"])

    parts = share.select(docs[text].alias("text")).mapInArrow(count, "t string, n bigint")
    counted = stash(parts.groupBy("t").agg(F.sum("n").alias("n")), "token-table")
    # the least level of counts that the table has room for, so that no more than the table goes to the driver
    level = F.floor(F.log2("n") * 8).cast("int")
    least, room = 1 << 30, table_size
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        least, room = r.level, room - r["count"]
    tokens = [r.t for r in counted.where(level >= least).select("t").collect()]
    drop_stash(counted)
    return dict(zip(tokens, load(path).lengths(tokens), strict=True))


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """Adds n_bytes and n_tokens to the columns ``keep`` (all by default) of ``docs``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_tokens")]
    read = list(dict.fromkeys([*keep, text]))
    src, at = docs.select(*[docs[c] for c in read]), list(dict.fromkeys([*keep, text])).index(text)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text, sample_docs, table_size))

    def make():
        counts, lengths = load(path), table.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at)
            n_bytes, n_tokens = [], []
            for x in texts:
                x = x.as_py()
                n_bytes.append(len(x.encode("utf-8", "replace")) if x else 0)
                n_tokens.append(counts.count(x, lengths))
            arrays = [batch.column(read.index(c)) for c in keep] + [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "n_tokens"])

        fn.keeps_state = True
        return fn

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return map_arrow(src, make, schema)
