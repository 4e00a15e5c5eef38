"""Queries over versions derived from ``events``, with their DuckDB twins.

An event is a version of its user: seq counts a user's events by time, the status comes from the event's type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.operators import enrich, projection, resolve
from strataquery.operators import load as L
from strataquery.operators import versions as V
from strataquery.session import table
from strataquery.sources import tables as S
from strataquery.streaming import debounce

STATUS = {"click": "pending", "purchase": "described", "error": "failed", "signup": "skipped-binary", "view": "skipped-too-large"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'failed' END"
#: The derived relation in DuckDB.
V_SQL = f"""v AS (
  SELECT user_id AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, {_CASE} AS describe_status,
         epoch_us(ts) AS observed_at, sha256(props) AS content_hash, 'p' || CAST(event_id % 97 AS VARCHAR) AS path, event_id, value
  FROM events)"""
LATEST_SQL = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS rn FROM v) WHERE rn = 1)"
DONE_SQL = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS rn FROM v WHERE describe_status = 'described') WHERE rn = 1)"


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) if dict(e.dtypes)["ts"] == "timestamp" else F.unix_micros(F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("entity_id"), seq.cast("long").alias("seq"), F.expr(_CASE).alias("describe_status"), micros.alias("observed_at"),
        F.sha2("props", 256).alias("content_hash"), F.concat(F.lit("p"), (F.col("event_id") % 97).cast("string")).alias("path"), "event_id", "value",
    )


ROW = ["entity_id", "seq", "describe_status", "observed_at"]


def latest_per_entity(spark, d):
    return V.latest(derived(spark, d)).select(*ROW)


def latest_self_join(spark, d):
    return V.latest_by_join(derived(spark, d)).select(*ROW)


def latest_filtered_status(spark, d):
    return V.latest_where(derived(spark, d), "describe_status = 'described'").select(*ROW)


def latest_is_pending_queue(spark, d):
    return V.pending_queue(derived(spark, d), 10).select(*ROW)


def queue_depth_any_vs_latest(spark, d):
    return V.queue_depths(derived(spark, d))


def status_histogram_zero_filled(spark, d):
    return V.status_histogram(derived(spark, d))


def next_seq(spark, d):
    return V.next_seq(derived(spark, d))


def prior_matching_version(spark, d):
    return V.prior_matching(derived(spark, d), "describe_status = 'described'", "seq", "prior_seq").select("entity_id", "seq", "prior_seq")


def latest_then_filter_by_value(spark, d):
    return V.latest_with_value(derived(spark, d), "path", "p13").select(*ROW)


def ever_had_value(spark, d):
    v = derived(spark, d)
    ever = v.where("path = 'p13'").select("entity_id").distinct()
    return ever.join(V.latest(v), "entity_id").select("entity_id", (F.col("path") == "p13").alias("still"))


def described_overlay(spark, d):
    return V.overlay_described(derived(spark, d), ["content_hash", "path"]).select("entity_id", "seq", "content_hash", "path")


def _twice(spark, d):
    return derived(spark, d).withColumn("seq", F.floor(F.col("seq") / 2).cast("long"))


def duplicate_seqs(spark, d):
    return V.duplicate_seqs(_twice(spark, d))


def duplicate_seq_repair(spark, d):
    return resolve.repair_duplicate_seq(_twice(spark, d)).select("entity_id", "seq", "observed_at")


def duplicate_path_survivor(spark, d):
    return resolve.duplicate_path_survivors(V.latest(derived(spark, d))).select("path", "entity_id", "copies", "survivor")


def _identities(spark, d):
    return derived(spark, d).groupBy("entity_id").agg(F.min("observed_at").alias("last_update_date"))


def stale_touch_repair(spark, d):
    return resolve.stale_touches(_identities(spark, d), derived(spark, d))


def touched(spark, d):
    return S.touched(derived(spark, d))


def superseded(spark, d):
    v = derived(spark, d).select("entity_id", "path", "observed_at", "describe_status")
    fixed = v.where("describe_status = 'failed'").withColumn("describe_status", F.lit("pending"))
    return S.supersede(v, fixed, ["entity_id", "path"], "observed_at")


def deleted_entities(spark, d):
    v = derived(spark, d)
    gone = V.latest(v).where("describe_status = 'failed'")
    return resolve.delete_entities([v], gone)[0].groupBy("entity_id").agg(F.count("*").alias("n"))


def log_rotation(spark, d):
    logs = derived(spark, d).select((F.floor(F.col("observed_at") / 1000)).cast("long").alias("ts"), "event_id")
    return S.rotate_logs(logs, logs.agg(F.max("ts")).first()[0] or 0)


def event_counters(spark, d):
    return S.counters(table(spark, d, "events").select(F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n")))


def orphans_both_ways(spark, d):
    """A third of the customers isn't there, and a fifth of their orders neither."""
    c, o = table(spark, d, "customer").where("c_custkey % 3 <> 0"), table(spark, d, "orders").where("o_custkey % 5 <> 0")
    ids, own = c.select(F.col("c_custkey").alias("entity_id")), o.select(F.col("o_custkey").alias("entity_id"), "o_orderkey")
    a = resolve.orphan_identities(ids, own).select(F.lit("identity").alias("kind"), F.col("entity_id").alias("id"))
    return a.unionByName(resolve.orphan_versions(ids, own).select(F.lit("version").alias("kind"), F.col("o_orderkey").alias("id")))


def repair_findings(spark, d):
    """What each check of the sweep finds, and what is left: users of even ids have no identity, some identities no version."""
    v = _twice(spark, d)
    ids = _identities(spark, d).where("entity_id % 2 = 1").unionByName(v.select((-F.col("entity_id") - 1).alias("entity_id"), F.lit(0).cast("long").alias("last_update_date")).distinct())
    found = resolve.repair_sweep(ids, v)
    out = None
    for kind, df in found.items():
        row = df.agg(F.count("*").alias("n"), F.sum("entity_id").alias("ids")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out.select("kind", "n", "ids")


def allocated_seqs(spark, d):
    """Purchases come after all other events of their user."""
    v = derived(spark, d)
    new = v.where("describe_status = 'described'").select("entity_id", "observed_at", "content_hash", "path")
    return V.allocate_seq(new, v.where("describe_status <> 'described'")).select("entity_id", "observed_at", "content_hash", "path", F.col("seq").cast("long").alias("seq"))


def reembed_requeue(spark, d):
    v = V.latest(derived(spark, d)).withColumns({"embedding": F.array(F.lit(1.0)).cast("array<float>"), "embed_model": F.lit("m")})
    return enrich.requeue_reembed(v.withColumn("observed_at", F.col("observed_at").cast("string")), "now").select("entity_id", "seq", "describe_status", F.size("embedding").isNull().alias("without_vector"), "observed_at")


def unchanged_files(spark, d):
    """Each user is a file; its last version has the last event's time, and the disk that of its last click."""
    v = derived(spark, d)
    seen = v.where("describe_status = 'pending'").groupBy("entity_id").agg(F.max("observed_at").alias("mtime"))
    disk = seen.select(F.col("entity_id").alias("path"), F.lit(1).alias("size_bytes"), "mtime")
    known = V.latest(v).select(F.col("entity_id").alias("path"), F.lit(1).alias("size_bytes"), F.col("observed_at").alias("mtime_observed"))
    return V.unchanged_by_stat(disk, known).select("path", "mtime")


def identities_with_latest(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return V.with_identities(c, o)


def prune_candidates(spark, d):
    """A path counts as on disk while any pending version names it; now is sixty days past the last event."""
    v = derived(spark, d)
    now = v.agg(F.max("observed_at")).first()[0] or 0
    rows = V.latest(v).withColumn("observed_at", F.timestamp_micros("observed_at").cast("string"))
    disk = v.where("describe_status = 'pending' AND value > 100").select("path")
    return resolve.prune_candidates(rows, disk, str(_utc(now + 60 * 86_400_000_000))).select("path", "entity_id")


def _utc(micros: int):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(micros / 1e6, UTC).strftime("%Y-%m-%d %H:%M:%S")


def review_upsert(spark, d):
    v = derived(spark, d).select(F.col("entity_id").cast("string").alias("candidate"), F.col("path").alias("new_path"), F.col("observed_at").alias("created_at"), "content_hash", "describe_status")
    old, new = v.where("describe_status <> 'described'"), v.where("describe_status = 'described'")
    return resolve.upsert_reviews(old, new).select(resolve.review_id().alias("id"), "candidate", "new_path", "created_at", "content_hash")


def projection_snapshot(spark, d):
    v = derived(spark, d)
    rows = v.select("entity_id", "seq", "content_hash", "path", "describe_status", "observed_at", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.lit("d").alias("description"), F.lit('["a",1,"b"]').alias("concepts"), F.lit("m").alias("describe_model"), F.lit("").alias("described_at"))
    out = projection.entries(_identities(spark, d), rows)
    return out.select("entity_id", "content_hash", "path", "title", "description", F.array_join("concepts", ",").alias("concepts"))


def session_debounce(spark, d):
    """Bursts of a user's events with pauses of at most six hours."""
    rows = derived(spark, d).select(F.col("entity_id").alias("path"), F.timestamp_micros("observed_at").alias("ts"))
    s = debounce.sessions(rows, "6 hours")
    return s.select("path", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def max_wait_cap(spark, d):
    """The same bursts, but fired after a day at most."""
    rows = derived(spark, d).select(F.col("entity_id").alias("path"), F.floor(F.col("observed_at") / 1000).cast("long").alias("ts_ms"))
    return debounce.capped_sessions(rows, 6 * 3_600_000, 24 * 3_600_000)


def resync_needed(spark, d):
    return debounce.needs_resync(table(spark, d, "events").select(F.get_json_object("props", "$.path").alias("path"), F.lit(False).alias("is_dir")))


def failure_runs(spark, d):
    """Each user is a loop, each event a cycle; errors fail, views are idle."""
    e = derived(spark, d).select(F.col("entity_id").alias("loop"), F.col("seq").alias("cycle"), F.when(F.col("describe_status") == "skipped-too-large", 0).otherwise(1).alias("worked"), F.when(F.col("describe_status") == "failed", 1).otherwise(0).alias("failed"))
    return enrich.failure_runs(e).select("loop", "cycle", F.col("run").cast("long").alias("run"))


def cycle_stats(spark, d):
    e = derived(spark, d).select(F.col("event_id").alias("cycle"), F.lit(1).cast("long").alias("seen"), (F.col("describe_status") == "failed").cast("long").alias("failed"), F.col("seq").alias("queue_depth"))
    return enrich.merge_stats(e)


def usage_cost(spark, d):
    return L.usage_usd(derived(spark, d).select((F.col("event_id") % 5000).alias("prompt_tokens"), (F.col("seq") * 3).alias("completion_tokens")))


def reembed_candidates(spark, d):
    v = V.latest(derived(spark, d)).select("entity_id", "seq", F.when(F.col("describe_status") == "described", F.lit("t")).otherwise("").alias("title"), F.lit("").alias("description"), F.lit(None).cast("array<float>").alias("embedding"))
    return enrich.reembed_only(v).select("entity_id", "seq")


def redescribe_reset(spark, d):
    return L.redescribe(V.latest(derived(spark, d))).select("entity_id", "seq", "describe_status")


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_entity, latest_self_join, latest_filtered_status, latest_is_pending_queue, queue_depth_any_vs_latest, status_histogram_zero_filled, next_seq,
        prior_matching_version, latest_then_filter_by_value, ever_had_value, described_overlay, duplicate_seqs, duplicate_seq_repair, duplicate_path_survivor, stale_touch_repair,
        repair_findings, allocated_seqs, reembed_requeue, unchanged_files, touched, superseded, deleted_entities, log_rotation, event_counters, orphans_both_ways, identities_with_latest, prune_candidates, review_upsert, projection_snapshot, session_debounce,
        max_wait_cap, resync_needed, failure_runs, cycle_stats, usage_cost, reembed_candidates, redescribe_reset,
    )
}

_W = "WITH " + V_SQL
_WL = f"{_W}, {LATEST_SQL}"
_ROW = ", ".join(ROW)
_TWICE = f"{_W}, t AS (SELECT * REPLACE (CAST(floor(seq / 2) AS BIGINT) AS seq) FROM v)"
ORACLE_SQL = {
    "latest_per_entity": f"{_WL} SELECT {_ROW} FROM l",
    "latest_self_join": f"{_W} SELECT v.entity_id, v.seq, describe_status, observed_at FROM v JOIN (SELECT entity_id, max(seq) AS m FROM v GROUP BY 1) x ON v.entity_id = x.entity_id AND v.seq = x.m",
    "latest_filtered_status": f"{_W}, {DONE_SQL} SELECT {_ROW} FROM d",
    "latest_is_pending_queue": f"{_WL} SELECT {_ROW} FROM l WHERE describe_status IN ('pending', 'failed') ORDER BY observed_at, entity_id LIMIT 10",
    "queue_depth_any_vs_latest": f"{_WL} SELECT (SELECT count(DISTINCT entity_id) FROM v WHERE describe_status = 'pending') AS any_pending, (SELECT count(*) FROM l WHERE describe_status IN ('pending', 'failed')) AS latest_undone",
    "status_histogram_zero_filled": f"{_W} SELECT s.describe_status, count(v.entity_id) AS n FROM (VALUES ('pending'), ('described'), ('failed'), ('skipped-binary'), ('skipped-too-large'), ('deleted')) s(describe_status) LEFT JOIN v USING (describe_status) GROUP BY 1",
    "next_seq": f"{_W} SELECT entity_id, max(seq) + 1 AS next_seq FROM v GROUP BY 1",
    "prior_matching_version": f"{_W} SELECT entity_id, seq, max(CASE WHEN describe_status = 'described' THEN seq END) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_seq FROM v",
    "latest_then_filter_by_value": f"{_WL} SELECT {_ROW} FROM l WHERE path = 'p13'",
    "ever_had_value": f"{_WL} SELECT entity_id, path = 'p13' AS still FROM l WHERE entity_id IN (SELECT entity_id FROM v WHERE path = 'p13')",
    "described_overlay": f"{_WL}, {DONE_SQL} SELECT l.entity_id, l.seq, coalesce(d.content_hash, l.content_hash) AS content_hash, coalesce(d.path, l.path) AS path FROM l LEFT JOIN d USING (entity_id)",
    "duplicate_seqs": f"{_TWICE} SELECT entity_id, seq, n FROM (SELECT entity_id, seq, count(*) AS n, max(seq) OVER (PARTITION BY entity_id) AS m FROM t GROUP BY 1, 2) WHERE seq = m AND n > 1",
    "duplicate_seq_repair": f"{_TWICE} SELECT entity_id, seq, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC, observed_at DESC, content_hash DESC, path DESC) AS rn FROM t) WHERE rn = 1",
    "duplicate_path_survivor": f"{_WL} SELECT path, entity_id, copies, rn2 = 1 AS survivor FROM (SELECT *, count(*) OVER (PARTITION BY path) AS copies, row_number() OVER (PARTITION BY path ORDER BY observed_at DESC, entity_id) AS rn2 FROM l) WHERE copies > 1",
    "stale_touch_repair": f"{_W} SELECT entity_id, min(observed_at) AS last_update_date, max(observed_at) AS newest FROM v GROUP BY 1 HAVING max(observed_at) > min(observed_at)",
    "touched": f"{_W} SELECT entity_id, max(observed_at) AS last_update_date FROM v GROUP BY 1",
    "superseded": f"{_W} SELECT entity_id, path, observed_at, CASE describe_status WHEN 'failed' THEN 'pending' ELSE describe_status END AS describe_status FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, path ORDER BY observed_at DESC) AS rn FROM v) WHERE rn = 1",
    "deleted_entities": f"{_WL} SELECT entity_id, count(*) AS n FROM v WHERE entity_id NOT IN (SELECT entity_id FROM l WHERE describe_status = 'failed') GROUP BY 1",
    "log_rotation": f"{_W} SELECT observed_at // 1000 AS ts, event_id FROM v WHERE observed_at // 1000 >= (SELECT max(observed_at // 1000) FROM v) - 86400000",
    "event_counters": "SELECT event_type AS metric, count(*) AS n FROM events GROUP BY 1",
    "orphans_both_ways": "WITH c AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT * FROM orders WHERE o_custkey % 5 <> 0) SELECT 'identity' AS kind, c_custkey AS id FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o) UNION ALL SELECT 'version', o_orderkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)",
    "repair_findings": f"""{_TWICE}, i AS (SELECT entity_id, min(observed_at) AS last_update_date FROM v GROUP BY 1 HAVING entity_id % 2 = 1 UNION ALL SELECT DISTINCT -entity_id - 1, CAST(0 AS BIGINT) FROM t),
ki AS (SELECT * FROM i WHERE entity_id IN (SELECT entity_id FROM t)), kv AS (SELECT * FROM t WHERE entity_id IN (SELECT entity_id FROM i)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, seq ORDER BY observed_at DESC, content_hash DESC, path DESC, describe_status DESC) AS r FROM kv) WHERE r = 1),
st AS (SELECT ki.entity_id FROM ki JOIN (SELECT entity_id, max(observed_at) AS m FROM one GROUP BY 1) x USING (entity_id) WHERE m > last_update_date),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS q FROM one) WHERE q = 1),
dp AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY observed_at DESC, entity_id) AS s FROM (SELECT *, count(*) OVER (PARTITION BY path) AS c FROM la) WHERE c > 1),
ds AS (SELECT entity_id, seq FROM (SELECT entity_id, seq, count(*) AS n, max(seq) OVER (PARTITION BY entity_id) AS m FROM kv GROUP BY 1, 2) WHERE seq = m AND n > 1)
SELECT 'orphan_identities' AS kind, count(*) AS n, CAST(sum(entity_id) AS BIGINT) AS ids FROM i WHERE entity_id NOT IN (SELECT entity_id FROM t)
UNION ALL SELECT 'orphan_versions', count(*), CAST(sum(entity_id) AS BIGINT) FROM t WHERE entity_id NOT IN (SELECT entity_id FROM i)
UNION ALL SELECT 'duplicate_seqs', count(*), CAST(sum(entity_id) AS BIGINT) FROM ds
UNION ALL SELECT 'stale', count(*), CAST(sum(entity_id) AS BIGINT) FROM st
UNION ALL SELECT 'duplicate_paths', count(*), CAST(sum(entity_id) AS BIGINT) FROM dp
UNION ALL SELECT 'identities', count(*), CAST(sum(entity_id) AS BIGINT) FROM ki WHERE entity_id NOT IN (SELECT entity_id FROM dp WHERE s > 1)
UNION ALL SELECT 'versions', count(*), CAST(sum(entity_id) AS BIGINT) FROM one WHERE entity_id NOT IN (SELECT entity_id FROM dp WHERE s > 1)""",
    "allocated_seqs": f"{_W} SELECT v.entity_id, observed_at, content_hash, path, coalesce(m + 1, 0) + row_number() OVER (PARTITION BY v.entity_id ORDER BY observed_at, content_hash, path) - 1 AS seq FROM v LEFT JOIN (SELECT entity_id, max(seq) AS m FROM v WHERE describe_status <> 'described' GROUP BY 1) x ON v.entity_id = x.entity_id WHERE describe_status = 'described'",
    "reembed_requeue": f"{_WL} SELECT entity_id, seq + 1 AS seq, 'pending' AS describe_status, true AS without_vector, 'now' AS observed_at FROM l WHERE describe_status = 'described'",
    "unchanged_files": f"{_WL} SELECT l.entity_id AS path, observed_at AS mtime FROM l JOIN (SELECT entity_id, max(observed_at) AS m FROM v WHERE describe_status = 'pending' GROUP BY 1) x ON l.entity_id = x.entity_id AND l.observed_at = x.m",
    "max_wait_cap": f"""WITH RECURSIVE {V_SQL}, e AS (SELECT entity_id, observed_at // 1000 AS t, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at // 1000) AS rn FROM v),
r AS (SELECT entity_id, rn, t, t AS first FROM e WHERE rn = 1
 UNION ALL SELECT e.entity_id, e.rn, e.t, CASE WHEN e.t - r.t > 21600000 OR e.t - r.first > 86400000 THEN e.t ELSE r.first END FROM r JOIN e ON e.entity_id = r.entity_id AND e.rn = r.rn + 1)
SELECT entity_id AS path, least(max(t) + 21600000, first + 86400000) AS fired_ms, count(*) AS n FROM r GROUP BY entity_id, first""",
    "identities_with_latest": "SELECT c_custkey AS entity_id, c_name, o_orderkey AS seq, o_orderstatus FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) ON c_custkey = o_custkey AND rn = 1",
    "prune_candidates": f"{_WL} SELECT path, entity_id FROM l WHERE path NOT IN (SELECT path FROM v WHERE describe_status = 'pending' AND value > 100) AND ((SELECT max(observed_at) FROM v) + 60 * 86400000000) // 1000000 - observed_at // 1000000 > 30 * 86400",
    "review_upsert": f"{_W} SELECT sha256(CAST(entity_id AS VARCHAR) || '|' || path) AS id, CAST(entity_id AS VARCHAR) AS candidate, path AS new_path, observed_at AS created_at, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, path ORDER BY (describe_status = 'described') DESC, observed_at DESC, content_hash DESC) AS rn FROM v) WHERE rn = 1",
    "projection_snapshot": f"{_WL}, {DONE_SQL} SELECT l.entity_id, l.content_hash, l.path, CASE WHEN d.entity_id IS NULL THEN '' ELSE 't' || CAST(d.event_id AS VARCHAR) END AS title, CASE WHEN d.entity_id IS NULL THEN '' ELSE 'd' END AS description, CASE WHEN d.entity_id IS NULL THEN '' ELSE 'a,b' END AS concepts FROM l LEFT JOIN d USING (entity_id)",
    "session_debounce": f"""{_W}, g AS (SELECT *, sum(brk) OVER (PARTITION BY entity_id ORDER BY observed_at, event_id) AS s FROM (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY entity_id ORDER BY observed_at, event_id) <= 21600000000 THEN 0 ELSE 1 END AS brk FROM v))
SELECT entity_id AS path, count(*) AS n, min(observed_at) AS first, max(observed_at) AS last FROM g GROUP BY entity_id, s""",
    "resync_needed": "SELECT coalesce(bool_or(json_extract_string(props, '$.path') IS NULL OR json_extract_string(props, '$.path') = ''), false) AS resync FROM events",
    "failure_runs": f"""{_W}, c AS (SELECT entity_id AS loop, seq AS cycle, describe_status = 'failed' AS bad, describe_status <> 'skipped-too-large' AS busy FROM v),
p AS (SELECT *, sum(CASE WHEN busy AND NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY loop ORDER BY cycle) AS part FROM c)
SELECT loop, cycle, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY loop, part ORDER BY cycle) AS BIGINT) AS run FROM p""",
    "cycle_stats": f"{_W} SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (describe_status = 'failed') AS BIGINT) AS failed, arg_max(seq, event_id) AS queue_depth FROM v",
    "usage_cost": f"{_W} SELECT CAST(sum(event_id % 5000) AS BIGINT) AS tokens_in, CAST(sum(seq * 3) AS BIGINT) AS tokens_out, round(sum((event_id % 5000) * 0.3 / 1e6 + seq * 3 * 2.5 / 1e6), 6) AS usd FROM v",
    "reembed_candidates": f"{_WL} SELECT entity_id, seq FROM l WHERE describe_status = 'described'",
    "redescribe_reset": f"{_WL} SELECT entity_id, seq, 'pending' AS describe_status FROM l WHERE describe_status NOT LIKE 'skipped-%'",
}
