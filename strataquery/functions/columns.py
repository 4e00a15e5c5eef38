"""Scalar functions as Spark columns: all run in the JVM, inside code generation where Spark can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File sizes in bytes, and tokens a byte, of the load's buckets.
BATCH_BYTES, DESCRIBE_BYTES, SNIFF_BYTES, BYTES_PER_TOKEN = 4096, 262_144, 8192, 4
#: Extensions that count as binary without reading the file.
BINARY_EXTENSIONS = (
    "png jpg jpeg gif bmp ico webp tiff tif avif heic pdf zip gz tgz bz2 xz 7z rar tar jar war woff woff2 ttf otf eot mp3 wav flac ogg m4a "
    "mp4 mov avi mkv webm exe dll so dylib bin o a class wasm node db sqlite sqlite3 pyc pdb"
).split()
#: What a secret looks like in a log line, and the longest line that is kept.
SECRET_PATTERNS = (
    r"""(?i)\bBearer\s+[^\s"',}\]]+""",
    r"""(?i)"?(authorization|api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|secret|password|client[_-]?secret)"?\s*[:=]\s*"?[^",}\s]+"?""",
)
LOG_CHARS = 2000
#: Fixed value: a token of source text. White space is that of Unicode, named one by one.
_BLANK = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
TOKEN_PATTERN = f"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^{_BLANK}A-Za-z0-9_]+"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def is_content_hash(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def slashed(path: Column) -> Column:
    """Forward slashes, no leading ./ or slash, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)?/*", ""), "/+$", "")


def filename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(filename(path), "^.+[.]([^.]*)$", 1))


def is_safe_path(path: Column) -> Column:
    """A relative path that stays inside: no drive, no root, no .. segment, no NUL, not empty."""
    return (path != "") & ~path.rlike("^[A-Za-z]:|^[/\\\\]|(^|[/\\\\])\\.\\.([/\\\\]|$)|\\x00")


def estimate_tokens(size: Column) -> Column:
    return F.ceil(size / BYTES_PER_TOKEN).cast("long")


def has_nul(content: Column) -> Column:
    return F.position(F.unhex(F.lit("00")), F.substring(content, 1, SNIFF_BYTES)) > 0


def bucket(ext: Column, size: Column, nul: Column) -> Column:
    """skip-binary, skip-too-large, batch or solo; the order of the tests matters."""
    return F.when(ext.isin(*BINARY_EXTENSIONS), "skip-binary").when(size > DESCRIBE_BYTES, "skip-too-large").when(nul, "skip-binary").when(size <= BATCH_BYTES, "batch").otherwise("solo")


def pseudo_hash(path: Column, size: Column) -> Column:
    """Stands for the content of files that aren't read."""
    return F.sha2(F.concat_ws(":", F.lit("unread"), path, size.cast("string")), 256)


def parse_concepts(c: Column) -> Column:
    """A JSON array's strings; [] for anything else."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    quoted = F.from_json(c, "array<variant>")
    only = F.transform(F.filter(quoted, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    return F.coalesce(only, F.filter(items, lambda x: F.lit(False)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; null for a zero or empty side, or sides of other lengths."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def recall_score(similarity: Column) -> Column:
    """(1 + cosine) / 2 in [0, 1]; what isn't a finite number counts as 0."""
    s = (1 + similarity) / 2
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).otherwise(0.0)


def is_vector(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def confidence(distance: Column, most: Column) -> Column:
    """1 for no distance, falling to 0 at ``most``; a bound that isn't positive counts as 801."""
    bound = F.when(most > 0, most).otherwise(801)
    return F.when(distance <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / bound)))


def most_distance(size_a: Column, size_b: Column) -> Column:
    """The largest distance that two contents of these sizes can have: six for each of 128 buckets they can fill, and 33."""
    fill = lambda s: F.least(F.lit(128), F.greatest(F.lit(0), s - 2))
    return F.least(F.lit(768), 6 * (fill(size_a) + fill(size_b))) + 33


def source_tokens(text: Column) -> Column:
    """Lower-cased tokens of source text, in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def redact(message: Column) -> Column:
    """Secrets out of a log line; null for a line too long to be one."""
    clean = reduce(lambda c, p: F.regexp_replace(c, p, "[REDACTED]"), SECRET_PATTERNS, message)
    return F.when(F.length(message) <= LOG_CHARS, clean)


def without_controls(c: Column) -> Column:
    """Control characters out, but for tab, line feed and carriage return."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def like_literal(term: str, escape: str = "!") -> str:
    """A term as the inside of a LIKE pattern that takes it literally."""
    return "".join(escape + c if c in "%_" or c == escape else c for c in term)


def contains_term(c: Column, term: str) -> Column:
    """Case-insensitive substring, without metacharacters; null never matches."""
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(term))), F.lit(False))


def canonical_remote(url: Column) -> Column:
    """host/path of a repository's address, lower case: no scheme, user, port, .git or empty segments; '' if unusable."""
    raw = F.trim(url)
    has_scheme = raw.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
    rest = F.when(has_scheme, F.regexp_replace(raw, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")).otherwise(F.regexp_replace(raw, "^([^/:]+):(.+)$", "$1/$2"))
    authority = F.regexp_extract(rest, "^([^/]*)/", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":.*$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/]*/(.*)$", 1), "/+$", ""), "(?i)\\.git$", "")
    parts = F.filter(F.transform(F.split(path, "/"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    return F.when((host != "") & (F.size(parts) > 0), F.concat_ws("/", host, F.concat_ws("/", parts))).otherwise("")


def embedding_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def inherited_marker(content_hash: Column) -> Column:
    return F.concat(F.lit("inherited-from:"), content_hash)


def clamp_title(title: Column, fallback: Column, most: int = 80) -> Column:
    clean = F.trim(F.coalesce(title, F.lit("")))
    return F.left(F.when(clean == "", fallback).otherwise(clean), F.lit(most))


def clamp_concepts(concepts: Column, most: int = 5) -> Column:
    """At most five trimmed lower-case tags, blanks dropped."""
    return F.slice(F.filter(F.transform(concepts, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")), 1, most)


def batch_output_tokens(files: Column, each: int = 120, head: int = 1024) -> Column:
    return files * each + head


def clamp_limit(limit: object, default: int = 20, most: int = 200) -> int:
    """A whole number from 1 to ``most``; what isn't a number, or is below 1, counts as ``default``."""
    if isinstance(limit, bool) or not isinstance(limit, int | float) or limit != limit or limit in (float("inf"), float("-inf")) or limit < 1:
        return default
    return min(int(limit), most)


def checked_limit(limit: object, default: int = 20, most: int = 200) -> int:
    """As clamp_limit, for callers outside: what isn't a positive whole number raises ValueError, none is the default."""
    if limit is None:
        return default
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a positive whole number")
    return min(limit, most)


def truncate_cell(c: Column, most: int = 72) -> Column:
    """For display: one line, cut with an ellipsis."""
    line = F.regexp_replace(c, "\\s+", " ")
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)
