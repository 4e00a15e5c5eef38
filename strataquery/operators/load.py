"""Bulk load: discover, hash, inherit, resume, bucket, pack, describe, embed, persist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K
from strataquery.operators import matching as M
from strataquery.session import cut_lineage

#: What one batch holds at most.
PACK_FILES, PACK_BYTES, PACK_TOKENS = 50, 102_400, 20_000
#: The cost model's answer tokens a call, files a batch call, and dollars a million tokens in and out.
CALL_OUT, CALL_FILES, USD_IN, USD_OUT = 3000, 40, 0.30, 2.50


def prepared(files: DataFrame) -> DataFrame:
    """path, size_bytes, content -> with ext, content_hash, has_nul and bucket. Content past the hash stays only where it is described."""
    path, size = F.col("path"), F.col("size_bytes")
    ext = C.extension(path)
    unread = ext.isin(*C.BINARY_EXTENSIONS)
    rows = files.withColumns({"ext": ext, "filename": C.filename(path), "has_nul": F.when(unread, False).otherwise(C.has_nul(F.col("content"))), "content_hash": F.when(unread, C.pseudo_hash(path, size)).otherwise(F.sha2(F.col("content"), 256))})
    rows = rows.withColumn("bucket", C.bucket(F.col("ext"), size, F.col("has_nul")))
    return rows.withColumn("content", F.when(F.col("bucket").isin("batch", "solo"), F.col("content")))


def resume_states(files: DataFrame, latest_rows: DataFrame, force: bool = False) -> DataFrame:
    """Adds resume (fresh, enqueue or skip) by the last version at each path."""
    last = latest_rows.select("path", F.col("content_hash").alias("_hash"), F.col("describe_status").alias("_status")).dropDuplicates(["path"])
    s = F.col("_status")
    forced = F.lit(force) & ~s.isin("skipped-binary", "skipped-too-large")
    edited = (s == "described") & (F.col("_hash") != F.col("content_hash"))
    done = s.isin("described", "skipped-binary", "skipped-too-large", "deleted")
    state = F.when(s.isNull(), "fresh").when(forced | edited, "enqueue").when(done, "skip").otherwise("enqueue")
    return files.join(last, "path", "left").withColumn("resume", state).drop("_hash", "_status")


def redescribe(latest_rows: DataFrame) -> DataFrame:
    """Everything that isn't skipped for what it is, pending again."""
    return latest_rows.where(~F.col("describe_status").startswith("skipped-")).withColumn("describe_status", F.lit("pending"))


def bucket_counts(files: DataFrame, size: str = "size_bytes") -> DataFrame:
    """(bucket, files, bytes, tokens)."""
    return files.groupBy("bucket").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.sum(C.estimate_tokens(F.col(size))).alias("tokens"))


def cost_estimate(files: DataFrame, size: str = "size_bytes", in_usd: float = USD_IN, out_usd: float = USD_OUT, packed: DataFrame | None = None) -> DataFrame:
    """(calls, tokens_in, tokens_out, usd) of a load: a call a solo file and a call a batch.

    packed: the batches, if they have been packed; else forty files count as a batch.
    """
    tokens = C.estimate_tokens(F.col(size))
    s = files.agg(
        F.count_if(F.col("bucket") == "solo").alias("solo"),
        F.count_if(F.col("bucket") == "batch").alias("batch"),
        F.coalesce(F.sum(F.when(F.col("bucket").isin("solo", "batch"), tokens)), F.lit(0)).alias("tokens_in"),
    )
    if packed is None:
        s = s.withColumn("batches", F.ceil(F.col("batch") / CALL_FILES).cast("long"))
    else:
        by = [c for c in ("shard", "batch") if c in packed.columns]
        s = s.join(packed.select(*by).distinct().agg(F.count("*").alias("batches")), F.lit(True))
    calls = F.col("solo") + F.col("batches")
    usd = F.col("tokens_in") * in_usd / 1e6 + calls * CALL_OUT * out_usd / 1e6
    return s.select(calls.alias("calls"), "tokens_in", (calls * CALL_OUT).alias("tokens_out"), F.round(usd, 6).alias("usd"))


def usage_usd(usage: DataFrame, in_usd: float = USD_IN, out_usd: float = USD_OUT) -> DataFrame:
    """Sums of prompt_tokens and completion_tokens and their price."""
    return usage.agg(F.sum("prompt_tokens").alias("tokens_in"), F.sum("completion_tokens").alias("tokens_out"), F.round(F.sum(F.col("prompt_tokens") * in_usd / 1e6 + F.col("completion_tokens") * out_usd / 1e6), 6).alias("usd"))


def pack(files: DataFrame, shard: str | None = None, files_cap: int = PACK_FILES, bytes_cap: int = PACK_BYTES, tokens_cap: int = PACK_TOKENS) -> DataFrame:
    """Adds batch (a number in the shard): next-fit in order of paths under three caps; a file too large for any has a batch of its own.

    Packing is a sequential fold, so each ``shard`` (a column, such as the project) is packed in one task, streamed in order
    without being gathered; without one the files are packed in ranges of paths, a range a partition.
    """
    schema = files.drop("batch").withColumn("batch", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, number = None, -1
        n = size = tokens = 0
        for pdf in batches:
            out = []
            for s, b in zip(pdf[shard] if shard else [0] * len(pdf), pdf["size_bytes"], strict=True):
                b, t = int(b), -(-int(b) // C.BYTES_PER_TOKEN)
                if number < 0 or s != last or n + 1 > files_cap or size + b > bytes_cap or tokens + t > tokens_cap:
                    number, n, size, tokens = (number + 1 if s == last and number >= 0 else 0), 0, 0, 0
                last, n, size, tokens = s, n + 1, size + b, tokens + t
                out.append(number)
            yield pdf.assign(batch=out)

    dealt = files.repartition(shard).sortWithinPartitions(shard, "path") if shard else files.repartitionByRange("path").sortWithinPartitions("path")
    return dealt.mapInPandas(run, schema)


Client = Callable[[list[dict]], tuple[str, bool]]
"""A model: files (id, path, content) -> (answer, whether it was cut off). May raise."""


def describe(packed: DataFrame, client: Client, model: str, now: str) -> DataFrame:
    """(entity_id, title, description, concepts, describe_status, describe_model, described_at) of files (entity_id, path, content, batch, shard).

    An answer that was cut off is asked for again in halves; a file without a usable answer is asked for alone; what
    fails then, or a client that raises, gives a failed row. Rows of a batch are neighbours after the shuffle.
    """
    schema = "entity_id string, title string, description string, concepts string, describe_status string, describe_model string, described_at string"

    def ask(files: list[dict]) -> dict[str, dict]:
        try:
            text, cut = client(files)
        except Exception:  # noqa: BLE001  whatever the client raises, the rows are kept as failed
            return {}
        if cut and len(files) > 1:
            half = len(files) // 2
            return ask(files[:half]) | ask(files[half:])
        return K.match_answers(K.extract_json(text), [f["id"] for f in files])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        files = [{"id": e, "path": p, "content": c} for e, p, c in zip(pdf.entity_id, pdf.path, pdf.content, strict=True)]
        found = ask(files)
        for f in files:
            if f["id"] not in found and len(files) > 1:
                found |= ask([f])
        rows = []
        for f in files:
            d = K.clean_description(found.get(f["id"]), f["path"].rsplit("/", 1)[-1])
            rows.append((f["id"], *(d.values() if d else ("", "", "[]")), "described" if d else "failed", model if d else "", now if d else ""))
        return pd.DataFrame(rows, columns=["entity_id", "title", "description", "concepts", "describe_status", "describe_model", "described_at"])

    return packed.groupBy("shard", "batch").applyInPandas(run, schema)


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float] | None]] | None, dim: int, model: str | None) -> DataFrame:
    """Adds embedding and embed_model from title and description; no provider, or a vector of the wrong size or with a value that isn't finite, gives null."""
    if provider is None:
        return rows.withColumns({"embedding": F.lit(None).cast("array<float>"), "embed_model": F.lit(None).cast("string")})

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(provider(texts.tolist()))

    v = run(C.embedding_text(F.col("title"), F.col("description")))
    guarded = rows.withColumn("_v", v)
    return guarded.withColumn("embedding", F.when(C.is_vector(F.col("_v"), dim), F.col("_v"))).withColumn("embed_model", F.when(F.col("embedding").isNotNull(), F.lit(model))).drop("_v")


def plan(files: DataFrame, latest_rows: DataFrame, snapshot: DataFrame, force: bool = False, limit: int | None = None) -> dict[str, DataFrame]:
    """A load's stages before anything is asked or written (the dry run): inherited, skipped, todo, buckets, cost, packed."""
    return _planned(prepared(files), latest_rows, snapshot, force, limit)


def _planned(ready: DataFrame, latest_rows: DataFrame, snapshot: DataFrame, force: bool, limit: int | None) -> dict[str, DataFrame]:
    inherited, survivors = M.split_by_hash(ready, snapshot)
    states = resume_states(survivors, latest_rows, force)
    todo = states.where("resume <> 'skip'")
    if limit is not None:
        todo = todo.orderBy("path").limit(max(0, limit))
    return {"inherited": inherited, "skipped": states.where("resume = 'skip'"), "todo": todo, "buckets": bucket_counts(todo), "cost": cost_estimate(todo), "packed": pack(todo.where("bucket = 'batch'"))}


def terminal_rows(todo: DataFrame) -> DataFrame:
    """Version rows of files that aren't described: skipped for what they are, titled by their names."""
    status = F.when(F.col("bucket") == "skip-binary", "skipped-binary").otherwise("skipped-too-large")
    return todo.where(F.col("bucket").startswith("skip-")).withColumns({"title": F.col("filename"), "describe_status": status})


def needs_load(versions: DataFrame, has_projection: bool) -> bool:
    return not has_projection or versions.isEmpty()


def with_retries(client: Client, attempts: int = 3, wait: Callable[[float], None] | None = None) -> Client:
    """A client that asks again, a little later each time, when the call raises a ConnectionError or TimeoutError; other errors pass at once."""
    import time

    pause = wait or time.sleep

    def ask(files: list[dict]) -> tuple[str, bool]:
        for n in range(1, attempts + 1):
            try:
                return client(files)
            except (ConnectionError, TimeoutError):
                if n == attempts:
                    raise
                pause(0.5 * n)
        raise AssertionError

    return ask


def run(files: DataFrame, versions: DataFrame, snapshot: DataFrame, ids: DataFrame, client: Client, model: str, now: str, persist: Callable[[str, DataFrame], None], provider: Callable | None = None, dim: int = 0, embed_model: str | None = None, force: bool = False, limit: int | None = None) -> dict[str, DataFrame]:
    """A bulk load. Gives the plan; hands rows to ``persist`` (stage, rows) in order: inherited, pending, skipped, described.

    ids: path, entity_id for every file, minted once by the caller and stored, so that a task that is run again gives no new ones.
    Each stage is durable before the next one asks a model anything. Files are read and hashed once, into a checkpoint.
    """
    from strataquery.operators.versions import latest

    p = _planned(cut_lineage(prepared(files)), latest(versions), snapshot, force, limit)
    named = p["todo"].join(ids, "path")
    stages = {
        "inherited": p["inherited"].join(ids, "path").drop("content"),
        "pending": named.where(F.col("bucket").isin("batch", "solo")).drop("content").withColumn("describe_status", F.lit("pending")),
        "skipped": terminal_rows(named).drop("content"),
    }
    for stage, rows in stages.items():
        persist(stage, rows)
    batched = pack(named.where("bucket = 'batch'")).withColumn("shard", F.spark_partition_id())
    alone = named.where("bucket = 'solo'").withColumn("batch", F.xxhash64("path")).withColumn("shard", F.lit(-1))
    cols = ["entity_id", "path", F.col("content").cast("string").alias("content"), "shard", "batch"]
    told = describe(batched.select(*cols).unionByName(alone.select(*cols)), client, model, now)
    done = embed(told, provider, dim, embed_model).join(named.select("entity_id", "path", "content_hash", "size_bytes", "filename", "ext"), "entity_id")
    persist("described", done)
    return p
