"""Portable snapshots: build from the store, write as canonical JSON, check, and take over by content hash."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K
from strataquery.operators import matching as M
from strataquery.operators.versions import overlay_described
from strataquery.schemas import TENANCY

#: The document's version and the largest file that is read.
DOC_VERSION, MOST_BYTES = 1, 100 * 1024 * 1024
ENTRY = ["content_hash", "path", "title", "description", "concepts", "describe_model", "described_at"]
UNSAFE_KEYS = {"__proto__", "constructor", "prototype"}


def entries(identities: DataFrame, versions: DataFrame) -> DataFrame:
    """One row an entity: its last version, described as it last was; what was never described is blank."""
    told = ["title", "description", "concepts", "describe_model", "described_at", "describe_status"]
    rows = overlay_described(versions, told).join(identities.select("entity_id"), "entity_id", "left_semi")
    ever = F.col("describe_status") == "described"
    blank = {c: F.when(ever, F.col(c)).otherwise("") for c in ("title", "description", "describe_model", "described_at")}
    rows = rows.withColumns(blank | {"concepts": F.when(ever, C.parse_concepts(F.col("concepts"))).otherwise(F.array().cast("array<string>"))})
    return rows.select("entity_id", *ENTRY)


def edges(identities: DataFrame) -> DataFrame:
    """(entity_id, from_entity, fork_content_hash) where both are there."""
    return identities.where("derived_from <> '' AND fork_content_hash <> ''").select("entity_id", F.col("derived_from").alias("from_entity"), "fork_content_hash")


def document(identities: DataFrame, versions: DataFrame, project: dict[str, str], now: str, generator: str = "strataquery") -> dict:
    """The snapshot as one document, on the driver: it is a file, made for one project."""
    files = {r.entity_id: {c: r[c] for c in ENTRY} for r in entries(identities, versions).orderBy("entity_id").toLocalIterator()}
    derived = {r.entity_id: {"from_entity": r.from_entity, "fork_content_hash": r.fork_content_hash} for r in edges(identities).orderBy("entity_id").toLocalIterator()}
    return {"version": DOC_VERSION, "generated_at": now, "generator": generator, "project": {k: project[k] for k in TENANCY}, "files": files, "derived": derived}


def canonical(doc: dict) -> str:
    """Fixed order of keys, entities in order of ids, no blanks, one line feed at the end."""
    order = {"files": ENTRY, "derived": ["from_entity", "fork_content_hash"]}
    fixed = {k: {e: {c: doc[k][e][c] for c in cols} for e in sorted(doc[k])} for k, cols in order.items()}
    whole = {k: doc[k] for k in ("version", "generated_at", "generator")} | {"project": {k: doc["project"][k] for k in TENANCY}} | fixed
    return json.dumps(whole, separators=(",", ":"), ensure_ascii=False) + "\n"


def write_atomic(text: str, path: str) -> None:
    """Whole or not at all: a neighbouring file takes the name."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def rejection(doc: object, tenancy: dict[str, str]) -> str | None:
    """Why a parsed document isn't taken, or None; the first reason in a fixed order counts, and it is all or nothing."""
    texts = lambda d, names: isinstance(d, dict) and all(isinstance(d.get(n), str) for n in names)
    if not isinstance(doc, dict) or not isinstance(doc.get("version"), int) or not texts(doc.get("project"), TENANCY) or not all(isinstance(doc.get(k), dict) for k in ("files", "derived")):
        return "invalid_shape"
    if UNSAFE_KEYS & {*doc["files"], *doc["derived"]}:
        return "invalid_shape"
    plain = [c for c in ENTRY if c != "concepts"]
    if not all(texts(e, plain) and isinstance(e.get("concepts"), list) and all(isinstance(x, str) for x in e["concepts"]) for e in doc["files"].values()):
        return "invalid_shape"
    if not all(texts(e, ("from_entity", "fork_content_hash")) for e in doc["derived"].values()):
        return "invalid_shape"
    if doc["version"] > DOC_VERSION:
        return "future_version"
    if any(doc["project"][k] != tenancy[k] for k in TENANCY):
        return "project_mismatch"
    is_hash = lambda h: len(h) == 64 and set(h) <= set("0123456789abcdef")
    for key, e in doc["files"].items():
        if not K.is_id(key):
            return "invalid_key"
        if not is_hash(e["content_hash"]):
            return "invalid_content_hash"
    for key, e in doc["derived"].items():
        if not K.is_id(key) or not K.is_id(e["from_entity"]):
            return "invalid_key"
        if not is_hash(e["fork_content_hash"]):
            return "invalid_content_hash"
    return None


def load(path: str, tenancy: dict[str, str]) -> tuple[dict | None, str | None]:
    """(document, None) or (None, reason)."""
    if not os.path.exists(path):
        return None, "file_missing"
    if os.path.getsize(path) > MOST_BYTES:
        return None, "file_too_large"
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
    except ValueError:
        return None, "invalid_json"
    reason = rejection(doc, tenancy)
    return (None, reason) if reason else (doc, None)


def entry_rows(spark: SparkSession, doc: dict) -> DataFrame:
    """The document's files as rows (entity_id and the entry's fields)."""
    rows = [(k, *(e[c] for c in ENTRY)) for k, e in doc["files"].items()]
    return spark.createDataFrame(rows, "entity_id string, " + ", ".join(f"{c} {'array<string>' if c == 'concepts' else 'string'}" for c in ENTRY))


def inherit(disk: DataFrame, snapshot: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """Version rows that the snapshot gives to files on disk: seq 0, no size, pending and without a vector.

    The k-th path of a hash takes the k-th entity of it. An entity that is already there gives no row but uses up its
    place; a path past the last one is minted (entity_id null) from the first one's entry.
    """
    pairs = M.inherit_bijective(disk, snapshot.select("entity_id", "content_hash"))
    fresh = pairs.join(existing.select("entity_id"), "entity_id", "left_anti")
    told = snapshot.select(F.col("entity_id").alias("template_id"), "title", "description", F.to_json("concepts").alias("concepts"), "describe_model", "described_at")
    rows = fresh.join(told, F.coalesce("entity_id", "template") == F.col("template_id")).drop("template_id", "template", "ordinal")
    fixed = {"seq": F.lit(0).cast("long"), "size_bytes": F.lit(0).cast("long"), "describe_status": F.lit("pending"), "embedding": F.lit(None).cast("array<float>"), "filename": C.filename(F.col("path")), "ext": C.extension(F.col("path")), "observed_at": F.lit(now)}
    return rows.withColumns(fixed)


def provenance(entity_ids: DataFrame, derived: DataFrame) -> DataFrame:
    """Ids with their edge, or '' where they have none."""
    return entity_ids.join(derived, "entity_id", "left").na.fill("", ["from_entity", "fork_content_hash"])
