"""Incremental enrichment: drain the pending queue, inherit cosmetic edits, describe the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.operators import load as L
from strataquery.operators import matching as M
from strataquery.operators.versions import pending_queue, prior_matching

#: Likeness from which an edit is cosmetic, failed cycles after which work halts, files a cycle.
COSMETIC_FROM, HALT_AFTER, BATCH = 0.85, 5, 10


def reembed_only(rows: DataFrame) -> DataFrame:
    """Described in words but without a vector."""
    return rows.where(F.col("embedding").isNull() & ((F.coalesce("title", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")))


def requeue_reembed(latest_rows: DataFrame, now: str) -> DataFrame:
    """Described rows as new pending versions without a vector."""
    done = latest_rows.where("describe_status = 'described'")
    return done.withColumns({"seq": F.col("seq") + 1, "describe_status": F.lit("pending"), "embedding": F.lit(None).cast("array<float>"), "embed_model": F.lit(None).cast("string"), "observed_at": F.lit(now)})


def prior_described(versions: DataFrame) -> DataFrame:
    """Each version with the last described one before it, as struct prior."""
    cols = [c for c in ("content_hash", "title", "description", "concepts", "embedding", "describe_model") if c in versions.columns]
    return prior_matching(versions.withColumn("_self", F.struct(*cols)), "describe_status = 'described'", "_self", "prior").drop("_self")


def split_work(queue: DataFrame, contents: DataFrame, prior_contents: DataFrame, cosmetic_from: float = COSMETIC_FROM) -> DataFrame:
    """Adds work: deleted, reembed, cosmetic or describe, and the jaccard of contents where both are known.

    queue: pending rows with prior (see prior_described); contents: path, content; prior_contents: content_hash, content.
    """
    rows = queue.join(contents.select("path", F.col("content").alias("_now")), "path", "left")
    old = prior_contents.select(F.col("content_hash").alias("_hash"), F.col("content").alias("_old"))
    rows = rows.join(old, F.col("prior.content_hash") == F.col("_hash"), "left").withColumn("id", F.concat_ws("|", "entity_id", "seq"))
    likeness = M.bag_jaccard(rows.where("_now IS NOT NULL AND _old IS NOT NULL").select("id", F.col("_now").alias("a"), F.col("_old").alias("b"))).select("id", "jaccard")
    rows = rows.join(likeness, "id", "left")
    words = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")
    work = F.when(F.col("_now").isNull(), "deleted").when(F.col("embedding").isNull() & words, "reembed").when(F.col("jaccard") >= cosmetic_from, "cosmetic").otherwise("describe")
    return rows.withColumn("work", work).withColumnRenamed("_now", "content").drop("_old", "_hash", "id")


def inherited(rows: DataFrame) -> DataFrame:
    """Cosmetic rows with the prior description and a marker of where it comes from."""
    p = F.col("prior")
    return rows.where("work = 'cosmetic'").withColumns({"title": p["title"], "description": p["description"], "concepts": p["concepts"], "embedding": p["embedding"], "describe_status": F.lit("described"), "describe_model": C.inherited_marker(p["content_hash"])})


@dataclass
class Cycle:
    """What a cycle wrote (rows to append, by kind) and found."""

    deleted: DataFrame
    reembedded: DataFrame
    cosmetic: DataFrame
    described: DataFrame
    stats: DataFrame


def run_cycle(versions: DataFrame, contents: DataFrame, prior_contents: DataFrame, client: L.Client, model: str, now: str, provider: Callable | None = None, dim: int = 0, embed_model: str | None = None, limit: int = BATCH) -> Cycle:
    """One cycle over the queue. The caller appends the rows; a row that is appended ends its turn in the queue."""
    queue = pending_queue(prior_described(versions), limit)
    work = split_work(queue, contents, prior_contents)
    gone = work.where("work = 'deleted'").withColumn("describe_status", F.lit("deleted"))
    again = L.embed(work.where("work = 'reembed'").drop("embedding", "embed_model"), provider, dim, embed_model).withColumn("describe_status", F.lit("described"))
    files = work.where("work = 'describe'").select("entity_id", "path", "content", F.lit(0).alias("shard"), F.floor(F.pmod(F.xxhash64("entity_id"), F.lit(max(1, limit // 5)))).alias("batch"))
    told = L.embed(L.describe(files, client, model, now), provider, dim, embed_model)
    stats = work.agg(F.count("*").alias("seen"), *[F.count_if(F.col("work") == w).alias(w) for w in ("deleted", "reembed", "cosmetic", "describe")])
    return Cycle(gone, again, inherited(work), told, stats)


@dataclass
class Failures:
    """Halts after so many failed cycles in a row until acknowledged; a cycle without work changes nothing."""

    most: int = HALT_AFTER
    row: int = 0

    def saw(self, worked: int, failed: int) -> bool:
        """Whether work halts after this cycle."""
        if worked:
            self.row = self.row + 1 if failed == worked else 0
        return self.halted

    @property
    def halted(self) -> bool:
        return self.row >= self.most

    def acknowledge(self) -> None:
        self.row = 0


def failure_runs(cycles: DataFrame) -> DataFrame:
    """Adds run: failed cycles in a row up to each cycle (cycle, worked, failed); idle cycles are passed over."""
    from pyspark.sql import Window

    w = Window.partitionBy("loop").orderBy("cycle")
    busy = F.col("worked") > 0
    bad = busy & (F.col("failed") == F.col("worked"))
    part = F.sum(F.when(busy & ~bad, 1).otherwise(0)).over(w)
    rows = cycles.withColumn("_part", part)
    return rows.withColumn("run", F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy("loop", "_part").orderBy("cycle"))).drop("_part")


def merge_stats(cycles: DataFrame) -> DataFrame:
    """Totals of cycles; the queue's depth is that of the last."""
    sums = [c for c in cycles.columns if c not in ("cycle", "queue_depth")]
    return cycles.agg(*[F.sum(c).alias(c) for c in sums], F.max_by("queue_depth", "cycle").alias("queue_depth"))
