"""Latest, as-of and queue views over an append-only table of versions.

A version is a row (entity_id, seq, ...); a later seq replaces an earlier one. Each view is one
scan and one shuffle by entity: Spark limits each partition to the groups' first rows before
the shuffle. A tie in seq goes to the newest observed_at, then to the greatest content, so results don't depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.schemas import STATUSES, TENANCY, UNDONE
from strataquery.session import cut_lineage


def in_tenancy(df: DataFrame, org: str, workspace: str, project: str) -> DataFrame:
    """Rows of one tenant; on a table partitioned by tenancy it prunes partitions."""
    return df.where((F.col(TENANCY[0]) == org) & (F.col(TENANCY[1]) == workspace) & (F.col(TENANCY[2]) == project))


#: What settles a tie in seq, in turn: the greatest comes last.
TIES = ("observed_at", "content_hash", "path", "describe_status")


def ties(df: DataFrame) -> list[Column]:
    return [F.desc(c) for c in TIES if c in df.columns]


def latest(versions: DataFrame, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """The last version of each entity."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *ties(versions))
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_where(versions: DataFrame, condition: Column | str, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """The last version that qualifies: an entity with a newer one that doesn't still shows its older one."""
    return latest(versions.where(condition), key, order)


def latest_by_join(versions: DataFrame, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """As latest(), by grouping and joining back; keeps all rows of a tie."""
    top = versions.groupBy(key).agg(F.max(order).alias(order))
    return versions.join(top, [key, order])


def latest_with_value(versions: DataFrame, column: str, value: object, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """Entities whose last version has the value; the filter stays above the reduction."""
    return latest(versions, key, order).where(F.col(column) == F.lit(value))


def with_identities(identities: DataFrame, versions: DataFrame) -> DataFrame:
    """Identities with their last version; either side alone is dropped."""
    return identities.join(latest(versions.drop(*[c for c in versions.columns if c in identities.columns and c != "entity_id"])), "entity_id")


def overlay_described(versions: DataFrame, columns: list[str]) -> DataFrame:
    """Last versions, with ``columns`` from the last described version where there is one."""
    done = latest_where(versions, F.col("describe_status") == "described").select("entity_id", F.struct(*columns).alias("_done"))
    both = latest(versions).join(done, "entity_id", "left")
    return both.withColumns({c: F.when(F.col("_done").isNotNull(), F.col("_done")[c]).otherwise(F.col(c)) for c in columns}).drop("_done")


def prior_matching(versions: DataFrame, condition: Column | str, value: str, name: str, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """Adds ``value`` of the last qualifying version strictly before each one (as-of join, exclusive)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return versions.withColumn(name, F.last(F.when(cond, F.col(value)), ignorenulls=True).over(w))


def next_seq(versions: DataFrame, key: str = "entity_id") -> DataFrame:
    """(entity, next_seq): one past the largest; an entity without versions isn't there and starts at 0."""
    return versions.groupBy(key).agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


def allocate_seq(new: DataFrame, versions: DataFrame, arrival: str = "observed_at", key: str = "entity_id") -> DataFrame:
    """``new`` rows with their seq: after the stored ones, in order of arrival."""
    w = Window.partitionBy(key).orderBy(arrival, *[c for c in ("content_hash", "path") if c in new.columns])
    base = next_seq(versions, key)
    return new.drop("seq").join(base, key, "left").withColumn("seq", F.coalesce("next_seq", F.lit(0)) + F.row_number().over(w) - 1).drop("next_seq")


def pending_queue(versions: DataFrame, limit: int | None = 10) -> DataFrame:
    """Entities whose last version is pending or failed, oldest first."""
    rows = latest(versions).where(F.col("describe_status").isin(*UNDONE)).orderBy("observed_at", "entity_id")
    return rows if limit is None else rows.limit(limit)


def status_histogram(versions: DataFrame) -> DataFrame:
    """(describe_status, n) over all version rows: every known status, 0 where there is none; others dropped."""
    spark = versions.sparkSession
    domain = spark.createDataFrame([(s, i) for i, s in enumerate(STATUSES)], "describe_status string, ord int")
    counts = versions.groupBy("describe_status").agg(F.count("*").alias("n"))
    return domain.join(counts, "describe_status", "left").select("describe_status", F.coalesce("n", F.lit(0)).alias("n"))


def queue_depths(versions: DataFrame) -> DataFrame:
    """One row: entities with any pending version, and entities whose last version is pending or failed. They differ."""
    per = versions.groupBy("entity_id").agg(
        F.max(F.when(F.col("describe_status") == "pending", 1).otherwise(0)).alias("any"),
        F.max(F.struct("seq", *[c for c in TIES if c in versions.columns], F.col("describe_status").isin(*UNDONE).cast("int").alias("undone"))).alias("last"),
    )
    return per.agg(F.coalesce(F.sum("any"), F.lit(0)).alias("any_pending"), F.coalesce(F.sum(F.col("last.undone")), F.lit(0)).alias("latest_undone"))


def duplicate_seqs(versions: DataFrame) -> DataFrame:
    """(entity_id, seq, n) where an entity's largest seq stands more than once."""
    w = Window.partitionBy("entity_id")
    top = versions.groupBy("entity_id", "seq").agg(F.count("*").alias("n")).withColumn("_max", F.max("seq").over(w))
    return top.where("seq = _max AND n > 1").drop("_max")


def lineage_depth(edges: DataFrame, child: str = "entity_id", parent: str = "derived_from", rounds: int = 32) -> DataFrame:
    """(entity, root, depth) over provenance edges, by pointer doubling: a chain of 2^rounds is followed. A cycle keeps its last pointer."""
    now = edges.select(F.col(child).alias("node"), F.when(F.col(parent) != "", F.col(parent)).alias("up")).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    now = now.withColumn("up", F.coalesce("up", "node"))
    for _ in range(rounds):
        far = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        joined = now.join(far, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.coalesce("_up", "up") != F.col("up")).alias("moved"))
        joined = cut_lineage(joined)
        now = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    return now.select(F.col("node").alias(child), F.col("up").alias("root"), "depth")


def status(versions: DataFrame | None) -> dict[str, object]:
    """The status view: rows by status and entities with anything pending; zeros where there is nothing to read."""
    if versions is None:
        return {"counts": dict.fromkeys(STATUSES, 0), "queue_depth": 0}
    counts = {r.describe_status: r.n for r in status_histogram(versions).collect()}
    return {"counts": {s: counts[s] for s in STATUSES}, "queue_depth": queue_depths(versions).first().any_pending}


def unchanged_by_stat(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, size and time are those of the last version: they needn't be read."""
    return disk.join(known.select("path", "size_bytes", F.col("mtime_observed").alias("mtime")).distinct(), ["path", "size_bytes", "mtime"], "left_semi")
