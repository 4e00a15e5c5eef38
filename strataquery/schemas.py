"""Pinned schemas of the catalog's tables, their validation and their additive evolution."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The statuses of a version and of a pending queue; the order is that of reports.
STATUSES = ("pending", "described", "failed", "skipped-binary", "skipped-too-large", "deleted")
UNDONE = ("pending", "failed")
TENANCY = ("org_id", "workspace_id", "project_id")


@dataclass(frozen=True)
class Column:
    """A column of the catalog: SQL type, and whether it may be null; the others have a default."""

    name: str
    kind: str
    nullable: bool = False
    default: object = None


#: Durable types and what Spark holds them in.
KINDS = {"TEXT": T.StringType(), "BIGINT": T.LongType(), "REAL": T.FloatType(), "FLOAT4[]": T.ArrayType(T.FloatType())}


def _text(*names: str) -> list[Column]:
    return [Column(n, "TEXT", default="") for n in names]


IDENTITIES = [Column("entity_id", "TEXT", default=""), Column("kind", "TEXT", default="file"), *_text("created_at", "derived_from", "fork_content_hash", *TENANCY, "last_update_date")]
VERSIONS = [
    *_text("entity_id", "content_hash"),
    Column("seq", "BIGINT", default=0),
    *_text("path", "filename", "ext"),
    Column("size_bytes", "BIGINT", default=0),
    *_text("mtime_observed", "title", "description"),
    Column("concepts", "TEXT", default="[]"),
    Column("embedding", "FLOAT4[]", True),
    Column("confidence", "REAL", True),
    Column("fingerprint", "TEXT", True),
    *_text("described_at", "describe_model"),
    Column("embed_model", "TEXT", True),
    Column("describe_status", "TEXT", default="pending"),
    *_text("observed_at", *TENANCY, "last_update_date"),
]
REVIEWS = [
    *_text("id", "candidate", "new_path"),
    Column("confidence", "REAL", True),
    Column("distance", "REAL", True),
    *_text("content_hash"),
    Column("size_bytes", "BIGINT", default=0),
    *_text("mtime_observed", "minted_id", "created_at"),
]
TABLES = {"identities": IDENTITIES, "versions": VERSIONS, "reviews": REVIEWS}


def validate(columns: list[Column]) -> None:
    """Raises ValueError for a bad or repeated name, an unknown type, or a column that needs a default and has none."""
    seen: set[str] = set()
    for c in columns:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", c.name):
            raise ValueError(f"bad column name {c.name!r}")
        if c.name in seen:
            raise ValueError(f"column {c.name!r} twice")
        if c.kind not in KINDS:
            raise ValueError(f"unknown type {c.kind!r}")
        if not c.nullable and c.default is None:
            raise ValueError(f"column {c.name!r} needs a default")
        seen.add(c.name)


for _columns in TABLES.values():
    validate(_columns)


def struct(columns: list[Column]) -> T.StructType:
    """The Spark schema. Fields are nullable, as parquet's are; conform() fills in defaults."""
    return T.StructType([T.StructField(c.name, KINDS[c.kind]) for c in columns])


def conform(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``df`` with exactly these columns: missing ones null or default, nulls of others defaulted, types cast where they can be."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for c in columns:
        value = F.col(f"`{have[c.name]}`").try_cast(KINDS[c.kind]) if c.name in have else F.lit(None).cast(KINDS[c.kind])
        out.append((value if c.nullable else F.coalesce(value, F.lit(c.default).cast(KINDS[c.kind]))).alias(c.name))
    return df.select(*out)


def evolve(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Adds the catalog's nullable columns that ``df`` lacks; a lacking column that isn't nullable is an error."""
    missing = [c for c in columns if c.name not in df.columns]
    if bad := [c.name for c in missing if not c.nullable]:
        raise ValueError(f"columns {bad} can't be added: they aren't nullable")
    return df.withColumns({c.name: F.lit(None).cast(KINDS[c.kind]) for c in missing})


def create_table_sql(name: str, columns: list[Column]) -> str:
    """CREATE TABLE for a session catalog; tables are partitioned by tenancy where they have it."""
    validate(columns)
    fields = ", ".join(f"{c.name} {KINDS[c.kind].simpleString()}" for c in columns)
    by = [c.name for c in columns if c.name in TENANCY]
    return f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet" + (f" PARTITIONED BY ({', '.join(by)})" if by else "")


def add_column_sql(name: str, column: Column) -> str:
    if not column.nullable:
        raise ValueError("only a nullable column can be added")
    return f"ALTER TABLE {name} ADD COLUMNS ({column.name} {KINDS[column.kind].simpleString()})"


def known_status(status: F.Column) -> F.Column:
    """A status outside of the domain counts as failed."""
    return F.when(status.isin(*STATUSES), status).otherwise(F.lit("failed"))
