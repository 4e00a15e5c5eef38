"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the tokenizer's pattern; each match is encoded on its own. Inside a
match the bytes are halved down to single bytes; two neighbouring encodings are joined by
re-encoding a window of tokens around the seam, which grows until the pairs at both of its
edges are stable. A sequence of tokens is the BPE encoding of its bytes exactly if each
pair of neighbours is the encoding of its own bytes, so tokens outside such a window can't
change. Matches never share tokens, so above them the join is plain concatenation.
Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows
each get a row; other columns pass through untouched; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataquery.llm.common import map_arrow, worker_state

#: White space as the tokenizer's pattern understands it.
SPACE = "\\t-\\r \\x85\\xa0"
#: The pattern's classes of letters and of numbers, up to U+00FF.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
#: Longest piece kept in a cache, and entries of a cache before it is emptied.
CACHED_BYTES, CACHE_SIZE = 48, 300_000


class TreeBpe:
    """Encoder and decoder for one vocabulary of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self._pieces: dict[bytes, tuple[int, ...]] = {}
        self._stable: dict[tuple[int, int], bool] = {}

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        own = self.ranks.get(piece)
        return (own,) if own is not None else self._encode(piece)

    def _encode(self, piece: bytes) -> tuple[int, ...]:
        found = self._pieces.get(piece)
        if found is not None:
            return found
        n = len(piece)
        if n < 2:
            out = (self.ranks[piece],) if n else ()
        else:
            out = self.join(self._encode(piece[: n // 2]), self._encode(piece[n // 2 :]))
        if n <= CACHED_BYTES:
            if len(self._pieces) >= CACHE_SIZE:
                self._pieces.clear()
            self._pieces[piece] = out
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings: the monoid's operation."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            grow_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            i, j = i * (1 + grow_left), j * (1 + grow_right)

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their own bytes."""
        key = (a, b)
        found = self._stable.get(key)
        if found is None:
            found = self.merged(self.bytes_of[a] + self.bytes_of[b]) == key
            if len(self._stable) >= CACHE_SIZE:
                self._stable.clear()
            self._stable[key] = found
        return found

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Plain BPE of a window: the lowest rank first, the leftmost of equals first."""
        ranks = self.ranks
        if len(data) > 64:
            return self._merged_by_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenates up a tree: runs of tokens, then neighbours pairwise."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class TextBpe:
    """Encodes whole texts: cuts by the pattern, memoises the ids of frequent matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe = TreeBpe(ranks)
        self.any_cut = regex.compile(pattern).findall
        words = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        from public_tokenizers import PATTERN

        #: The same pattern for texts below U+0100, where the standard library's faster engine will do.
        self.latin_cut = re.compile(words).findall if pattern == PATTERN else self.any_cut
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, "<u4")
        try:
            text.encode("latin-1")
            matches = self.latin_cut(text)
        except UnicodeEncodeError:
            matches = self.any_cut(text)
        cache = self.cache
        packed = list(map(cache.get, matches))
        if None in packed:
            for i, x in enumerate(packed):
                if x is None:
                    m = matches[i]
                    x = cache.get(m)
                    if x is None:
                        x = np.array(self.bpe.encode(m.encode("utf-8", "replace")), "<u4").tobytes()
                        if len(m) <= CACHED_BYTES:
                            if len(cache) >= CACHE_SIZE:
                                cache.clear()
                            cache[m] = x
                    packed[i] = x
        return np.frombuffer(b"".join(packed), "<u4")


def load(path: str, pattern: str) -> TextBpe:
    """One encoder for each Python worker, with its caches; the rank file is read where it runs."""

    def build() -> TextBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return TextBpe(ranks, pattern)

    return worker_state(("bpe", path, pattern), build)


#: Output columns that encode_decode can give.
OUTPUTS = {"token_ids": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"token_ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("token_ids", "decoded")) -> DataFrame:
    """Encodes column ``text`` of each row and decodes the ids again.

    keep: the columns of ``docs`` that stay (all by default); outputs: names from OUTPUTS. The
    digests are those of the ids in decimal, joined by a space, and of the decoded bytes.
    A column of ``docs`` with the name of an output gives way to it. No shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {o.lower() for o in outputs}]
    read = list(dict.fromkeys([*keep, text]))
    src = docs.select(*[docs[c] for c in read])
    at = read.index(text)

    def make():
        codec = load(path, pattern)
        bpe = codec.bpe
        strs = [str(i) for i in range(max(bpe.bytes_of) + 1)]

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: dict[str, list] = {o: [] for o in outputs}
            for x in batch.column(at):
                ids = codec.encode(x.as_py())
                as_list = ids.tolist()
                if "token_ids" in cols:
                    cols["token_ids"].append(ids.astype(np.int32))
                if "n_tokens" in cols:
                    cols["n_tokens"].append(len(as_list))
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(hashlib.sha256(" ".join(map(strs.__getitem__, as_list)).encode()).hexdigest())
                if "decoded" in cols or "decoded_sha256" in cols:
                    raw = bpe.decode(as_list)
                    if "decoded" in cols:
                        cols["decoded"].append(raw)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            arrays = [batch.column(read.index(c)) for c in keep] + [pa.array(cols[o], _ARROW[o]) for o in outputs]
            return pa.RecordBatch.from_arrays(arrays, names=[*keep, *outputs])

        fn.keeps_state = True
        return fn

    from pyspark.sql import types as T

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs])
    return map_arrow(src, make, schema)
