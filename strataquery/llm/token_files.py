"""Token ids as compressed binary files: an adaptive context-mixing range coder.

Format. A file is a table of chunks (Spark writes it, so a lost task leaves nothing behind, and any
store that Spark reaches will do). A chunk holds whole documents: their ids, their numbers of tokens, the tokens
before it in its part, and a payload: the chunk's id table, then blocks of at most ``BLOCK`` tokens. The
table and each block have a header (magic, tokens, bytes, crc32) and a code. A block's crc32 is
that of its ids as little-endian unsigned 16-bit numbers; a wrong checksum raises. Each block
is coded from the same fresh model, so that with the chunk's table any block can be decoded alone.

Model. The last id that followed the last two ids (order 2) and the last one (order 1), in this block, are
predictions. Two distributions of ids come from the chunk's table: the counts of ids (order 0), and the
counts of ids that follow an id of the last one's class (order 1, for pairs seen more than once; a class groups ids that are
followed by alike ids). The four are mixed: a token's symbol says which of them gives it, and the id follows by the
distribution, if it is one. Their weights are adaptive: a row for each state of the predictions' agreement, which
moves to what was right in that state. A range coder with 31-bit output words codes
symbol and id. Blocks are coded in lockstep, as numpy lanes: one step codes the next token of many
blocks, so the work is vectorised though each block is sequential.

Defined results: a null or empty text has the end id alone; documents with the same or no id stand side by
side, nulls first, equal ids in the order of their texts' hashes; an id of 65,536 or more raises
ValueError; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable
from zlib import compress, crc32, decompress
from zlib import error as ZlibError

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.llm.byte_bpe import LETTER, NUMBER, SPACE
from strataquery.llm.common import stash, worker_state

#: Tokens of a block, blocks coded in lockstep; a chunk ends after BLOCK * LANES tokens.
BLOCK, LANES = 2048, 4096
MAGIC, HEADER = 0x53514232, struct.Struct("<IIII")
#: Pieces of text that each of a worker's two caches holds, and the longest of them.
CACHE_SIZE, CACHED_CHARS = 700_000, 48

#: Symbols: hits of order 2 and 1, an id by the last one's class, an id by the counts alone; bits of the slots that a distribution's ids share out.
SYMBOLS, HIT2, HIT1, CLASS, ALONE = 4, 0, 1, 2, 3
CLASS_BITS, ALONE_BITS = 14, 16
_BITS = np.array([0, 0, CLASS_BITS, ALONE_BITS], np.uint64)
_SLOTS = (1 << _BITS.astype(np.int64)) - 1
#: Classes at most (one for each CLASS_TOKENS of a chunk), states of the predictions' agreement, entries of the predictions of order 1 and 2 (powers of two).
CLASSES, CLASS_TOKENS, STATES, LAST1, LAST2 = 16, 20_000, 4, 256, 1024
#: A row's total and what a seen symbol takes of the rest (as a shift); what each symbol has besides, so that none is impossible.
TOTAL, SHIFT, LEAST = 32512, 5, 64
_TOTAL_BITS, _LAST = np.uint64(15), np.uint64(1 << 63)
_BOT, _WORD, _MASK = np.uint64(1 << 31), np.uint64(31), np.uint64((1 << 31) - 1)
_32, _LOWER = np.uint64(32), np.uint64(0xFFFFFFFF)
_16, _FIELD, _EACH, _TOP = np.uint64(16), np.uint64(0xFFFF), np.uint64(0x0001000100010000), np.uint64(0x8000800080000000)


def _packed(sums: list[int]) -> np.uint64:
    """What stands before each symbol, as four fields of 16 bits in one number; the first is 0."""
    return np.uint64(sum(x << 16 * (i + 1) for i, x in enumerate(sums[:3])))


#: The least shares, what a seen symbol adds, and the bits that a shifted row's fields keep.
_FLOOR, _SEEN, _KEEP = _packed([LEAST, 2 * LEAST, 3 * LEAST]), np.array([_packed([(TOTAL >> SHIFT) * (j >= x) for j in range(3)]) for x in range(SYMBOLS)]), np.uint64(0x07FF07FF07FF0000)
#: Buckets of following ids that tell classes apart, rounds of grouping, tokens from one that is looked at to the next, tokens counted at a time.
FEATURES, GROUPINGS, SKIP, PIECE = 64, 6, 4, 1 << 18
#: Steps that the encoder looks ahead, and lanes that are turned from columns into lines at a time.
AHEAD, STRIP = 32, 64
#: What rows start with, by the state: shares of the symbols in sixtieths.
_START = np.array([_packed([sum(x[: i + 1]) * TOTAL // 60 for i in range(3)]) for x in ((2, 16, 38, 4), (16, 12, 30, 2), (2, 2, 48, 8), (30, 2, 26, 2))])


def _levels() -> np.ndarray:
    """The counts that a table can hold: 1, 2, ... and from there on steps of an eighth."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 9 // 8))
    return np.array(out)


_LEVELS = _levels()


class Table:
    """A chunk's ids: places 1 to n in ascending order, their classes, and their shares in each distribution.

    shares (where an id's slots start in the upper half of a number, how many there are in the lower) have a row for each class and
    one for the counts alone, and a last entry for hits.
    """

    def __init__(self, ids: np.ndarray, group: np.ndarray, level: np.ndarray, pairs: np.ndarray, pair_level: np.ndarray):
        self.packed = ids, group, level, pairs, pair_level
        n = len(ids)
        self.width = n + 1
        self.kind = np.uint16 if self.width <= 65536 else np.uint32  # of places
        self.ids, self.group = np.append(0, ids).astype(np.uint16), np.append(0, group).astype(np.int64)
        self.base = self.group * self.width
        self.shares = np.zeros((CLASSES + 1) * self.width + 1, np.uint64)
        self.shares[-1] = 1
        self.by_slot = np.zeros((CLASSES << CLASS_BITS) + (1 << ALONE_BITS) + 1, self.kind)
        self._share(CLASSES, np.arange(1, n + 1), _LEVELS[level], ALONE_BITS)
        row, at = np.divmod(pairs, self.width)
        for g in range(CLASSES):
            own = row == g
            self._share(g, at[own], _LEVELS[pair_level[own]], CLASS_BITS)

    def _share(self, row: int, at: np.ndarray, count: np.ndarray, bits: int) -> None:
        if len(at):
            share = 1 + count * ((1 << bits) - len(at)) // count.sum()
            share[np.argmax(count)] += (1 << bits) - share.sum()
            self.shares[row * self.width + at] = (np.cumsum(share) - share << 32) + share
            first = row << CLASS_BITS
            self.by_slot[first : first + (1 << bits)] = np.repeat(at, share)

    @staticmethod
    def of(tokens: np.ndarray) -> Table:
        """From all of a chunk's tokens; for the grouping alone, which changes no id, every SKIP-th one and what follows it do."""
        if not len(tokens):
            return Table(*(np.empty(0, t) for t in (np.uint16, np.uint8, np.uint8, np.int64, np.uint8)))
        count = np.bincount(tokens, minlength=65536)
        ids = np.flatnonzero(count)
        index = np.zeros(65536, np.int64)
        index[ids] = np.arange(len(ids))
        n = count[ids]
        # what follows an id, in buckets of which the commonest ids have one each
        order = np.argsort(-n, kind="stable")
        bucket = np.zeros(len(ids), np.int64)
        bucket[order] = np.arange(len(ids)) % FEATURES
        last = len(tokens) - 1
        seen = np.bincount(index[tokens[:last:SKIP]] * FEATURES + bucket[index[tokens[1::SKIP]]], minlength=len(ids) * FEATURES).reshape(-1, FEATURES)
        like = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
        centre = like[order[: min(CLASSES, 1 + len(tokens) // CLASS_TOKENS)]]
        for _ in range(GROUPINGS):
            group = np.argmin((centre**2).sum(axis=1) - 2 * like @ centre.T, axis=1)
            for g in range(len(centre)):
                own = group == g
                if own.any():
                    centre[g] = n[own] @ like[own] / n[own].sum()
        width = len(ids) + 1
        base, place = np.zeros(65536, np.int64), index + 1
        base[ids] = group * width
        follow = np.zeros(CLASSES * width, np.int64)
        for i in range(0, last, PIECE):
            x = tokens[i : min(last, i + PIECE) + 1].astype(np.intp)
            follow += np.bincount(base.take(x[:-1]) + place.take(x[1:]), minlength=CLASSES * width)
        pairs = np.flatnonzero(follow > 1)
        # a distribution has ids for half its slots at most
        most = 1 << CLASS_BITS - 1
        row = pairs // width
        if len(pairs) > most and np.bincount(row).max() > most:
            by = np.lexsort((-follow[pairs], row))
            place = np.arange(len(by)) - np.searchsorted(row[by], row[by])
            pairs = np.sort(pairs[by[place < most]])
        at = lambda c: (np.searchsorted(_LEVELS, c, "right") - 1).astype(np.uint8)
        return Table(ids.astype(np.uint16), group.astype(np.uint8), at(n), pairs, at(follow[pairs]))

    def pack(self) -> bytes:
        ids, group, level, pairs, pair_level = self.packed
        step = np.diff(pairs, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
        raw = np.diff(ids, prepend=np.uint16(0)).astype("<u2").tobytes() + group.tobytes() + level.tobytes() + step.T.tobytes() + pair_level.tobytes()
        code = compress(raw, 6)
        return HEADER.pack(MAGIC, len(ids), len(code), crc32(raw)) + code

    @staticmethod
    def unpack(data: bytes) -> tuple[Table, int]:
        """The table at the start of a payload, and where it ends."""
        n, size, crc = _header(data, 0)
        end = HEADER.size + size
        try:
            raw = decompress(data[HEADER.size : end])
        except ZlibError as e:
            raise ValueError("a table's checksum is wrong") from e
        m, rest = divmod(len(raw) - 4 * n, 5)
        if crc32(raw) != crc or m < 0 or rest:
            raise ValueError("a table's checksum is wrong")
        ids = np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.uint16)
        part = lambda at, k: np.frombuffer(raw, np.uint8, k, at)
        step = np.ascontiguousarray(part(4 * n, 4 * m).reshape(4, m).T).view("<u4").ravel()
        return Table(ids, part(2 * n, n), part(3 * n, n), np.cumsum(step, dtype=np.int64), part(4 * n + 4 * m, m)), end


def _header(data: bytes, i: int) -> tuple[int, int, int]:
    if i + HEADER.size > len(data):
        raise ValueError("not a block of tokens")
    magic, n, size, crc = HEADER.unpack_from(data, i)
    if magic != MAGIC:
        raise ValueError("not a block of tokens")
    return n, size, crc


class _Model:
    """Rows and predictions of each lane; lanes are the first k at every step, ids are their places in the table.

    A row is one number that holds what stands before each symbol (see _packed); with the least shares its total is 2 ** 15.
    """

    def __init__(self, lanes: int, table: Table):
        self.rows = np.tile(_START, lanes)
        self.last1, self.last2 = np.zeros(lanes * LAST1, table.kind), np.zeros(lanes * LAST2, table.kind)
        lane = np.arange(lanes)
        self.at, self.to1, self.to2 = lane * STATES, lane * LAST1, lane * LAST2
        self.prev, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def look(self, k: int) -> np.ndarray:
        """What stands before each symbol."""
        prev = self.prev[:k]
        h = prev * 40503
        self.slot1 = h & LAST1 - 1
        self.slot1 += self.to1[:k]
        h ^= self.mixed[:k]
        h >>= 7
        h &= LAST2 - 1
        h += self.to2[:k]
        self.slot2 = h
        self.guess1, self.guess2 = self.last1.take(self.slot1), self.last2.take(h)
        # the state: the predictions are alike, and order 2 has one
        state = (self.guess1 == self.guess2).view(np.int8)
        state += state
        state += (self.guess2 > 0).view(np.int8)
        self.row = self.at[:k] + state
        self.seen = self.rows.take(self.row)
        return self.seen + _FLOOR

    def learn(self, k: int, symbol: np.ndarray, ids: np.ndarray) -> None:
        seen = self.seen
        step = seen >> np.uint64(SHIFT)
        step &= _KEEP
        seen -= step
        seen += _SEEN.take(symbol)
        self.rows[self.row] = seen
        self.last1[self.slot1] = ids
        self.last2[self.slot2] = ids
        prev = self.prev[:k]
        np.multiply(prev, 2654435761, out=self.mixed[:k])
        prev[:] = ids


def _edges(row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a symbol's share starts, and its size."""
    shift = symbol.astype(np.uint64)
    shift <<= np.uint64(4)
    lo = row >> shift
    lo &= _FIELD
    after = row >> _16
    after |= _LAST
    after >>= shift
    after &= _FIELD
    after -= lo
    return lo, after


def encode_blocks(blocks: list[np.ndarray]) -> bytes:
    """A payload: the blocks' table, then each block of ids (below 65,536) as header and code."""
    if not blocks:
        return b""
    table = Table.of(np.concatenate(blocks))
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for s in range(0, len(order), LANES):
        some = order[s : s + LANES]
        for i, code in zip(some, _encode([blocks[i] for i in some], table), strict=True):
            ids = blocks[i]
            out[i] = HEADER.pack(MAGIC, len(ids), len(code), crc32(ids.astype("<u2").tobytes())) + code
    return table.pack() + b"".join(out)


def _active(sizes: np.ndarray) -> list[int]:
    """Lanes that have a token at each step; sizes go down."""
    steps = int(sizes[0]) if len(sizes) else 0
    return np.searchsorted(-sizes, -np.arange(steps), "left").tolist()


def _encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    n = len(blocks)
    sizes = np.array([len(b) for b in blocks])
    index = np.zeros(65536, table.kind)
    index[table.ids[1:]] = np.arange(1, table.width)
    ids = np.zeros((int(sizes[0]) if n else 0, n), table.kind)
    for i in range(0, n, STRIP):
        strip = np.zeros((len(blocks[i : i + STRIP]), len(ids)), table.kind)
        for line, b in zip(strip, blocks[i : i + STRIP], strict=True):
            line[: len(b)] = index.take(b)
        ids[:, i : i + STRIP] = strip.T
    model = _Model(n, table)
    low, span, at = np.zeros(n, np.uint64), np.full(n, 1 << 62, np.uint64), np.zeros(n, np.int64)
    words = np.zeros((n, len(ids) + 8), np.uint32)
    lane, one, active, flat = np.arange(n), np.uint64(1), _active(sizes), words.ravel()
    first = lane * words.shape[1]
    before = np.zeros((1, n), table.kind)
    for t, k in enumerate(active):
        if t % AHEAD == 0:
            # what depends on the ids alone, for some steps at once
            ahead = ids[t : t + AHEAD, :k].astype(np.int64)
            shares = table.shares.take(table.base.take(np.concatenate([before[:, :k], ids[t : t + AHEAD - 1, :k]])[: len(ahead)]) + ahead)
            rare = shares == 0
            shares[rare] = table.shares.take(CLASSES * table.width + ahead[rare])
            drawn = rare + CLASS
            before = ids[t + AHEAD - 1 : t + AHEAD]
        x, i = ids[t, :k], t % AHEAD
        row = model.look(k)
        symbol = np.where(x == model.guess2, HIT2, np.where(x == model.guess1, HIT1, drawn[i, :k]))
        own = np.where(symbol < CLASS, one, shares[i, :k])
        start, share = _edges(row, symbol)
        unit, lo = span[:k], low[:k]
        unit >>= _TOTAL_BITS
        start *= unit
        lo += start
        unit *= share
        unit >>= _BITS.take(symbol)
        lo += unit * (own >> _32)
        own &= _LOWER
        unit *= own
        small = np.flatnonzero(unit < _BOT)
        if len(small):
            v, w = low.take(small), at.take(small)
            flat[first.take(small) + w] = v >> _WORD  # a 32nd bit is a carry
            at[small] = w + 1
            v &= _MASK
            low[small] = v << _WORD
            span[small] = span.take(small) << _WORD
        model.learn(k, symbol, x)
    for half in (low >> _WORD, low & _MASK):
        words[lane, at] = half
        at += 1
    for j in range(int(at.max(initial=1)) - 1, 0, -1):
        words[:, j - 1] += words[:, j] >> np.uint32(31)
        words[:, j] &= np.uint32(_MASK)
    return [words[i, : at[i]].astype("<u4").tobytes() for i in range(n)]


def decode_blocks(data: bytes) -> list[np.ndarray]:
    """The blocks of a payload; raises ValueError for what isn't one or has another checksum."""
    if not data:
        return []
    table, i = Table.unpack(data)
    found: list[tuple[int, int, bytes]] = []
    while i < len(data):
        n, size, crc = _header(data, i)
        found.append((n, crc, data[i + HEADER.size : i + HEADER.size + size]))
        i += HEADER.size + size
    out: list = [None] * len(found)
    order = sorted(range(len(found)), key=lambda i: -found[i][0])
    for s in range(0, len(order), LANES):
        some = order[s : s + LANES]
        for i, ids in zip(some, _decode([found[i][2] for i in some], np.array([found[i][0] for i in some]), table), strict=True):
            if crc32(ids.astype("<u2").tobytes()) != found[i][1]:
                raise ValueError("a block's checksum is wrong")
            out[i] = ids
    return out


def _decode(codes: list[bytes], sizes: np.ndarray, table: Table) -> list[np.ndarray]:
    n = len(codes)
    words = np.zeros((n, max(map(len, codes), default=0) // 4 + 4), np.uint32)
    for i, c in enumerate(codes):
        words[i, : len(c) // 4] = np.frombuffer(c, "<u4", len(c) // 4)
    ids = np.zeros((int(sizes[0]) if n else 0, n), table.kind)
    model = _Model(n, table)
    code, span, at = (words[:, 0].astype(np.uint64) << _WORD) | words[:, 1], np.full(n, 1 << 62, np.uint64), np.full(n, 2)
    end, hit = words.shape[1] - 1, len(table.shares) - 1
    flat = words.ravel()
    first = np.arange(n) * words.shape[1]
    with np.errstate(divide="ignore"):  # nothing may be left of a damaged block's range
        for t, k in enumerate(_active(sizes)):
            held = model.look(k)
            unit, own = span[:k], code[:k]
            unit >>= _TOTAL_BITS
            v = own // unit
            v *= _EACH
            v |= _TOP
            v -= held
            v &= _TOP
            symbol = np.bitwise_count(v).astype(np.int64)
            start, share = _edges(held, symbol)
            start *= unit
            own -= start
            unit *= share
            unit >>= _BITS.take(symbol)
            drawn = symbol >= CLASS
            slot = (own // unit).view(np.int64)
            slot &= _SLOTS.take(symbol)  # a damaged block may go beyond
            row = np.where(symbol == ALONE, CLASSES, table.group.take(model.prev[:k]))
            slot += row << CLASS_BITS
            x = table.by_slot.take(slot)
            row *= table.width
            row += x
            place = np.where(drawn, row, hit)
            x = np.where(drawn, x, np.where(symbol == HIT1, model.guess1, model.guess2))
            found = table.shares.take(place)
            own -= unit * (found >> _32)
            found &= _LOWER
            unit *= found
            small = np.flatnonzero(unit < _BOT)
            if len(small):
                w = at.take(small)
                code[small] = (code.take(small) << _WORD) | flat.take(first.take(small) + np.minimum(w, end))  # a damaged block may run on
                at[small] = w + 1
                span[small] = span.take(small) << _WORD
            ids[t, :k] = x
            model.learn(k, symbol, x)
    out = []
    for i in range(0, n, STRIP):
        lines = table.ids.take(ids[:, i : i + STRIP].T)
        out += [line[:size] for line, size in zip(lines, sizes[i : i + STRIP].tolist(), strict=True)]
    return out


class _Odd(Exception):
    """A text with a piece that the library may cut otherwise."""


class _Pieces(dict):
    """Ids of pieces, as bytes; ``find`` gives those that aren't there."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        return self.find(piece)


class Encoder:
    """The tokenizers library's ids of whole texts; frequent pieces are memoised.

    A text is cut before each single space or line break between visible characters. The library's own
    pattern always cuts there too, so that the pieces' ids, one after the other, are the text's. A new piece of characters
    up to U+00FF is cut further by the library's pattern, and its parts go to the library's model; other new
    pieces go through the whole library. So do texts with other white space, with a space or a break at an end or next
    to another, or with a special token's string.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        visible = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        #: The characters that stand for bytes in the model's vocabulary.
        self.byte_chars = {c: c for c in visible} | {c: 256 + i for i, c in enumerate(sorted(set(range(256)) - set(visible)))}
        #: Pieces, spaces before them left out, used lately and before; parts of pieces without a space before.
        self.young = _Pieces(self._piece)
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.marks = {c: self._part(c) for c in ".,;:!?"}

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint16)
        # what can be printed has no white space but spaces
        if not text.replace("\n", "").isprintable() or any(s in text for s in self.specials):
            return np.frombuffer(self._whole(text), np.uint16)
        pieces = text.replace("\n", " \n").split(" ")
        first = pieces[0]
        try:
            if not first:
                raise _Odd
            packed = list(map(self.young.__getitem__, pieces[1:]))
            packed.insert(0, self._of(first))
        except _Odd:
            return np.frombuffer(self._whole(text), np.uint16)
        return np.frombuffer(b"".join(packed), np.uint16)

    def _piece(self, piece: str) -> bytes:
        """A piece that isn't among the young ones: with a space before it, unless it starts with a break."""
        if piece in ("", "\n"):
            raise _Odd
        x = self.young.get(piece) or self.old.get(piece)
        if x is None:
            # letters alone are never cut, and letters with a mark at their end only there
            if piece.isalpha() and (piece.isascii() or max(piece) <= "\xff"):
                x = self._part(f" {piece}")
            elif (mark := piece[-1]) in self.marks and (word := piece[:-1]).isalpha() and (word.isascii() or max(word) <= "\xff"):
                x = (self.young.get(word) or self._piece(word)) + self.marks[mark]
            else:
                x = self._of(piece if piece[0] == "\n" else f" {piece}")
        if len(piece) <= CACHED_CHARS:
            if len(self.young) >= CACHE_SIZE:
                self.old, self.young = self.young, _Pieces(self._piece)
            self.young[piece] = x
        return x

    def _of(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        found = self.cut(text)
        if len(found) == 1:
            return self._part(text)
        out = []
        for part in found:
            if part[0] == " " and len(part) > 1:
                out.append(self.young.get(part[1:]) or self._piece(part[1:]))
            else:
                x = self.parts.get(part)
                if x is None:
                    x = self._part(part)
                    if len(self.parts) >= CACHE_SIZE // 4:
                        self.parts.clear()
                    if len(part) <= CACHED_CHARS:
                        self.parts[part] = x
                out.append(x)
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        """What the library's pattern never cuts."""
        if part.isascii() and part[1:].isalpha() and part[0] == " ":
            chars = "\u0120" + part[1:]
        else:
            chars = part.encode().decode("latin-1").translate(self.byte_chars)
        return _short([t.id for t in self.model.tokenize(chars)])

    def _whole(self, text: str) -> bytes:
        return _short(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _short(ids: list[int]) -> bytes:
    try:
        return array("H", ids).tobytes()
    except OverflowError as e:
        raise ValueError("ids must be below 65,536") from e


def load(path: str) -> Encoder:
    return worker_state(("tokens", path), lambda: Encoder(path))


_FILE = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
FILE = "part int, start long, doc_ids array<long>, counts array<long>, payload binary"


def write(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes ``docs``, appends ``end_id`` to each, writes the files in ascending order of ids; gives the files' table.

    path: the tokenizer's file. Parts are ranges of ids; a part's chunks hold the tokens before them in the part.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = src.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("id"), "tie").sortWithinPartitions(F.asc_nulls_first("id"), "tie")

    def run(batches):
        encoder, part = load(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint16)
        ids, counts, tokens = [], [], []
        size = start = 0

        def chunk():
            nonlocal ids, counts, tokens, size, start
            joined = np.concatenate(tokens)
            payload = encode_blocks([joined[i : i + BLOCK] for i in range(0, len(joined), BLOCK)])
            rows = [[part], [start], [ids], [counts], [payload]]
            start += size
            ids, counts, tokens, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _FILE, strict=True)], schema=_FILE)

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.concatenate([encoder.encode(x.as_py()), end])
                ids.append(doc)
                counts.append(len(own))
                tokens.append(own)
                size += len(own)
                if size >= LANES * BLOCK:
                    yield chunk()
        if ids:
            yield chunk()

    return stash(ranged.select("id", "text").mapInArrow(run, FILE), "token-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, token_ids as little-endian unsigned 32-bit bytes) of every document in the files."""
    return _read(files, lambda ids: ids.astype("<u4").tobytes(), "token_ids binary", pa.binary(), "token_ids")


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, without giving the ids themselves to Spark."""
    return _read(files, lambda ids: crc32(ids.astype("<u4").tobytes()), "ids_crc32 long", pa.int64(), "ids_crc32")


def _read(files: DataFrame, of, column: str, kind: pa.DataType, name: str) -> DataFrame:
    """Each part's first place among all tokens is the sum of the parts before: one number a part."""
    spark = files.sparkSession
    per_part = files.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, before = {}, 0
    for r in sorted(per_part, key=lambda r: r.part):
        base[r.part] = before
        before += r.n
    shared = spark.sparkContext.broadcast(base)

    def run(batches):
        for b in batches:
            for part, start, ids, counts, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                joined, i = np.concatenate(decode_blocks(payload)), 0
                cols: list[list] = [[], [], [], []]
                for doc, n in zip(ids, counts, strict=True):
                    for c, x in zip(cols, (doc, shared.value[part] + start + i, n, of(joined[i : i + n])), strict=True):
                        c.append(x)
                    i += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], names=["doc_id", "start", "n_tokens", name])

    return files.select("part", "start", "doc_ids", "counts", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
