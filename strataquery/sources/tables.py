"""Reading and writing the catalog's tables: tolerant reads, tenancy, inserts, appends, supersedes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.operators.versions import allocate_seq
from strataquery.schemas import IDENTITIES, TENANCY, VERSIONS, Column, conform, evolve, known_status, struct
from strataquery.session import cut_lineage


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store has the path; any file system that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Tenants that a filter on partitions names one by one; more are read as a whole.
MOST_TENANTS = 200


def read_tolerant(spark: SparkSession, path: str, columns: list[Column], *tenants: tuple[str, str, str]) -> DataFrame:
    """A table under its pinned schema: a missing one is empty, columns that old files lack are null or default; other errors are raised.

    tenants: only their rows; the filter stands below the defaults, so it prunes partitions.
    """
    schema = struct(columns)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.schema(schema).parquet(path)
    if tenants:
        raw = raw.where(reduce(or_, (reduce(and_, (F.col(c) == v for c, v in zip(TENANCY, t, strict=True))) for t in tenants)))
    return conform(raw, columns)


def stored_for(spark: SparkSession, batch: DataFrame, path: str, columns: list[Column]) -> DataFrame:
    """The stored rows of a batch's entities: its tenants' folders alone are read."""
    tenants = []
    if all(c in batch.columns for c in TENANCY):
        tenants = [tuple(r) for r in batch.select(*TENANCY).distinct().limit(MOST_TENANTS + 1).collect()]
    few = tenants if 0 < len(tenants) <= MOST_TENANTS and all(None not in t for t in tenants) else []
    return read_tolerant(spark, path, columns, *few).join(batch.select("entity_id").distinct(), "entity_id", "left_semi")


def scan(spark: SparkSession, path: str, org: str, workspace: str, project: str) -> DataFrame:
    """All versions of a tenant; tables written by append() are partitioned by tenancy, so only its folders are read."""
    df = read_tolerant(spark, path, VERSIONS, (org, workspace, project))
    return df.withColumn("describe_status", known_status(F.col("describe_status")))


def lookup(identities: DataFrame, entity_id: str) -> DataFrame:
    return identities.where(F.col("entity_id") == entity_id).limit(1)


def from_rows(spark: SparkSession, rows: list[dict], columns: list[Column]) -> DataFrame:
    """A table from memory, with defaults for what rows leave out."""
    names = [c.name for c in columns]
    return spark.createDataFrame([tuple(r.get(n, next(c.default for c in columns if c.name == n)) for n in names) for r in rows], struct(columns))


def append(df: DataFrame, path: str, columns: list[Column]) -> None:
    """Appends rows, partitioned by tenancy where the table has it."""
    out = conform(df, columns).write.mode("append")
    by = [c for c in TENANCY if c in [x.name for x in columns]]
    (out.partitionBy(*by) if by else out).parquet(path)


def healed(write: Callable[[DataFrame], None], df: DataFrame, columns: list[Column]) -> None:
    """Writes ``df``; if a column that it lacks is the reason that this fails, adds the catalog's nullable ones and tries once more."""
    try:
        write(df)
    except AnalysisException:
        if all(c.name in df.columns for c in columns):
            raise
        write(evolve(df, columns))


def mint_identities(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Appends identities that aren't there yet; raises ValueError if ``new`` has one twice, RuntimeError if one isn't found afterwards. Gives what it added."""
    if not new.groupBy("entity_id").count().where("count > 1").isEmpty():
        raise ValueError("an identity is given twice")
    fresh = cut_lineage(new.join(stored_for(spark, new, path, IDENTITIES).select("entity_id"), "entity_id", "left_anti"))
    append(fresh, path, IDENTITIES)
    if not fresh.join(stored_for(spark, fresh, path, IDENTITIES).select("entity_id"), "entity_id", "left_anti").isEmpty():
        raise RuntimeError("an identity that was written isn't there")
    return fresh


def append_versions(spark: SparkSession, new: DataFrame, path: str, arrival: str = "observed_at") -> None:
    """Appends versions at each entity's next seq, in order of arrival. One writer at a time."""
    append(allocate_seq(new, stored_for(spark, new, path, VERSIONS), arrival), path, VERSIONS)


def write_batch(identities_path: str, versions_path: str):
    """A foreachBatch writer of (identity columns, version columns) rows: identities first, so no version is without one.

    A batch that comes again after a failure adds nothing twice: rows that are stored (entity, content, time) are left out. If
    identities can't be written, the batch fails before its versions and waits as a whole to be run again. Of what is stored, only
    the batch's tenants and entities are looked at.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        have = [c.name for c in IDENTITIES if c.name in batch.columns]
        new = batch.select(*have).dropDuplicates(["entity_id"])
        append(new.join(stored_for(spark, new, identities_path, IDENTITIES).select("entity_id"), "entity_id", "left_anti"), identities_path, IDENTITIES)
        key = ["entity_id", "content_hash", "observed_at"]
        stored = stored_for(spark, batch, versions_path, VERSIONS).select(*key)
        append_versions(spark, batch.dropDuplicates(key).join(stored, key, "left_anti"), versions_path)

    return write


def touched(versions: DataFrame) -> DataFrame:
    """(entity_id, last_update_date): what an update in place would keep, from the versions."""
    return versions.groupBy("entity_id").agg(F.max("observed_at").alias("last_update_date"))


def supersede(stored: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over both; of equals the update's (an update in place, an upsert)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def rotate_logs(logs: DataFrame, now_ms: int, age_ms: int = 86_400_000) -> DataFrame:
    """Log rows that are still young enough."""
    return logs.where(F.col("ts") >= now_ms - age_ms)


def counters(events: DataFrame) -> DataFrame:
    """(metric, n) from an event stream's kinds: the same sums for a batch or a stream."""
    return events.groupBy(F.col("kind").alias("metric")).agg(F.sum("n").alias("n"))
