"""Kernels that Spark's functions can't express: plain Python and numpy, wrapped as pandas UDFs where they run."""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fingerprints -------------------------------------------------------------------------

#: The fingerprint's prefix, buckets, and what length and checksum add to a distance at most.
PREFIX, BUCKETS, MOST_LENGTH, MOST_DISTANCE = "H1", 128, 32, 801
#: Bytes below which there is too little to compare, the width of the size band, and the bands of confidence.
EVIDENCE_BYTES, SIZE_BAND, MATCH_FROM, REVIEW_FROM = 50, 0.2, 0.85, 0.55


def fingerprint(data: bytes) -> str:
    """Prefix, checksum, length code, and for each of 128 trigram buckets which quarter its count is in (two bits)."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    h = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) % BUCKETS if len(raw) > 2 else raw[:0]
    count = np.bincount(h, minlength=BUCKETS)
    cuts = np.sort(count)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    quarter = np.searchsorted(cuts, count, "left")
    packed = quarter.reshape(-1, 4) @ np.array([64, 16, 4, 1])
    length = min(255, int(np.floor(np.log2(len(data) + 1) * 8 + 0.5)))
    return PREFIX + bytes([int(raw.sum()) & 255, length, *packed.tolist()]).hex()


def _unpacked(fp: str | None) -> np.ndarray | None:
    if not fp or not fp.startswith(PREFIX) or len(fp) != 70:
        return None
    try:
        raw = np.frombuffer(bytes.fromhex(fp[2:]), np.uint8)
    except ValueError:
        return None
    return np.concatenate([raw[:2].astype(np.int64), (raw[2:, None] >> np.array([6, 4, 2, 0]) & 3).ravel().astype(np.int64)])


def fingerprint_distance(a: str | None, b: str | None) -> int:
    """0 for equal contents, 801 where one isn't a fingerprint; quarters three apart count double."""
    x, y = _unpacked(a), _unpacked(b)
    if x is None or y is None:
        return MOST_DISTANCE
    d = np.abs(x[2:] - y[2:])
    return int(d.sum() + 3 * (d == 3).sum() + min(MOST_LENGTH, abs(int(x[1]) - int(y[1]))) + (x[0] != y[0]))


@F.pandas_udf(T.StringType())
def fingerprint_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else fingerprint(bytes(c) if not isinstance(c, str) else c.encode()))


def distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    """fingerprint_distance for whole columns: each distinct fingerprint is unpacked once."""
    codes, values = pd.factorize(pd.concat([a, b], ignore_index=True), use_na_sentinel=False)
    unpacked = [_unpacked(v if isinstance(v, str) else None) for v in values]
    table = np.array([u if u is not None else np.full(BUCKETS + 2, -1) for u in unpacked], np.int16)
    x, y = codes[: len(a)], codes[len(a) :]
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 20_000):
        p, q = table[x[i : i + 20_000]], table[y[i : i + 20_000]]
        d = np.abs(p[:, 2:] - q[:, 2:])
        some = d.sum(axis=1) + 3 * (d == 3).sum(axis=1) + np.minimum(MOST_LENGTH, np.abs(p[:, 1] - q[:, 1])) + (p[:, 0] != q[:, 0])
        out[i : i + 20_000] = np.where((p[:, 0] < 0) | (q[:, 0] < 0), MOST_DISTANCE, some)
    return out


@F.pandas_udf(T.LongType())
def distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(distances(a, b), dtype="int64")


# ---- token bags ---------------------------------------------------------------------------


def bag_jaccard(a: list[str], b: list[str]) -> float:
    """Sum of least counts over sum of greatest; two empty bags are alike."""
    from collections import Counter

    x, y = Counter(a), Counter(b)
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


# ---- identifiers --------------------------------------------------------------------------

#: Fixed value: the digits of an identifier (no I, L, O, U).
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


class IdMinter:
    """26-character identifiers, 48 bits of time and 80 of chance; within a millisecond the chance part counts up."""

    def __init__(self, now=lambda: int(time.time() * 1000), chance=lambda: int.from_bytes(os.urandom(10))):
        self._now, self._chance = now, chance
        self._last, self._low = -1, 0

    def mint(self) -> str:
        ms = self._now()
        if ms > self._last:
            self._last, self._low = ms, self._chance()
        else:
            self._low += 1
            if self._low >> 80:
                self._last, self._low = self._last + 1, 0
        return encode_id(self._last, self._low)


def encode_id(ms: int, low: int) -> str:
    value = ms << 80 | low
    return "".join(ALPHABET[value >> 5 * i & 31] for i in reversed(range(26)))


def id_millis(identifier: str) -> int:
    """The time part; raises ValueError for what isn't an identifier."""
    if not is_id(identifier):
        raise ValueError(f"{identifier!r} isn't an identifier")
    value = 0
    for c in identifier[:10]:
        value = value << 5 | ALPHABET.index(c)
    return value


def is_id(identifier: object) -> bool:
    return isinstance(identifier, str) and len(identifier) == 26 and set(identifier) <= set(ALPHABET)


# ---- what a model says --------------------------------------------------------------------


def extract_json(text: str) -> object:
    """The JSON value of a model's answer: the whole of it, or from its first bracket to the last that closes it; else None."""
    try:
        return json.loads(text.strip())
    except ValueError:
        first = re.search(r"[\[{]", text)
        if first is None:
            return None
        last = text.rfind("]" if first[0] == "[" else "}")
        try:
            return json.loads(text[first.start() : last + 1]) if last > first.start() else None
        except ValueError:
            return None


def utf16_left(text: str, most: int) -> str:
    """At most so many UTF-16 units; a pair is never cut in two."""
    return text.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "ignore")


def utf8_left(text: str, most: int) -> str:
    """At most so many bytes of UTF-8, whole characters only."""
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def clean_description(raw: object, fallback: str, title_chars: int = 80, description_chars: int = 2000) -> dict | None:
    """title, description and concepts (a JSON array of at most five tags) of one described file; None if it isn't an object."""
    if not isinstance(raw, dict):
        return None
    title = raw.get("title").strip() if isinstance(raw.get("title"), str) else ""
    body = raw.get("description").strip() if isinstance(raw.get("description"), str) else ""
    tags = raw.get("concepts") if isinstance(raw.get("concepts"), list) else []
    clean = [t.strip().lower() for t in tags if isinstance(t, str) and t.strip()][:5]
    return {"title": utf16_left(title or fallback, title_chars), "description": utf16_left(body, description_chars), "concepts": json.dumps(clean, separators=(",", ":"), ensure_ascii=False)}


def match_answers(answers: object, ids: list[str]) -> dict[str, dict]:
    """Answers by the id they name; those without ids by place, but only if there are as many as were asked for."""
    if not isinstance(answers, list):
        return {}
    by_id = {a["id"]: a for a in answers if isinstance(a, dict) and a.get("id") in ids}
    if not by_id and len(answers) == len(ids):
        by_id = {i: a for i, a in zip(ids, answers, strict=True) if isinstance(a, dict)}
    return by_id


# ---- ignore rules -------------------------------------------------------------------------


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file: a matched directory takes all below it along."""

    regex: str
    negate: bool
    directory: bool


#: What a run of stars and a slash stand for: any folders, or none.
_FOLDERS = "(?:.*/)?"


def glob_regex(glob: str) -> str:
    """The body of a regular expression: one star stays inside a segment, more cross them, ? is one character."""
    out: list[str] = []
    rest = glob
    while rest:
        body = rest.lstrip("*")
        stars = len(rest) - len(body)
        if stars > 1 and body.startswith("/"):
            body = body[1:]
            if out[-1:] != [_FOLDERS]:  # any folders of any folders are any folders
                out.append(_FOLDERS)
        elif stars:
            out.append(".*" if stars > 1 else "[^/]*")
        else:
            out.append("[^/]" if rest[0] == "?" else re.escape(rest[0]))
            body = rest[1:]
        rest = body
    return "".join(out)


def ignore_rule(line: str) -> IgnoreRule | None:
    """None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    body = line[1:] if negate or line.startswith(("\\#", "\\!")) else line
    directory = body.endswith("/")
    body = body[:-1] if directory else body
    anchored = "/" in body
    body = body.removeprefix("/")
    return IgnoreRule(("" if anchored else "(?:.*/)?") + glob_regex(body), negate, directory) if body else None


def ignore_rules(text: str) -> list[IgnoreRule]:
    return [r for r in map(ignore_rule, text.split("\n")) if r]


def decide(rules: list[IgnoreRule], path: str, is_dir: bool = False) -> bool | None:
    """True: ignored, False: kept by a negated rule, None: no rule matches. The last that matches wins."""
    above = ["/".join(path.split("/")[:i]) for i in range(1, path.count("/") + 1)]
    out = None
    for r in rules:
        targets = above if r.directory and not is_dir else [*above, path]
        if any(re.fullmatch(r.regex, t) for t in targets):
            out = not r.negate
    return out


def decide_nested(files: dict[str, list[IgnoreRule]], path: str, is_dir: bool = False) -> bool:
    """Rules by directory ('' is the root): the deepest directory that decides wins."""
    parts = path.split("/")
    for depth in reversed(range(len(parts))):
        base = "/".join(parts[:depth])
        if base in files and (d := decide(files[base], "/".join(parts[depth:]), is_dir)) is not None:
            return d
    return False


def origin_url(config: str) -> str:
    """The url of section [remote "origin"] of an INI text, or ''."""
    inside = False
    for line in map(str.strip, config.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            inside = re.fullmatch(r'remote\s+"origin"', line[1:-1]) is not None
        elif inside and (m := re.match(r"url\s*=\s*(.+)$", line)):
            return m[1].strip()
    return ""
