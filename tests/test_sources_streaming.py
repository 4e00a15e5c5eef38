import json
import os
import random
import subprocess
import time
import types

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strataquery import schemas
from strataquery.operators.enrich import Failures
from strataquery.sources import files, tables
from strataquery.streaming import debounce, ingest


def row(**kw):
    return {"entity_id": "e", "content_hash": "h", "path": "p", "observed_at": "1", "org_id": "o", "workspace_id": "w", "project_id": "p"} | kw


def test_missing_tables_are_empty_and_old_files_are_filled(spark, tmp_path):
    path = str(tmp_path / "versions")
    assert tables.scan(spark, path, "o", "w", "p").columns == [c.name for c in schemas.VERSIONS]
    spark.createDataFrame([("e", 3, "weird", "o", "w", "p")], "entity_id string, seq int, describe_status string, org_id string, workspace_id string, project_id string").select("entity_id", "describe_status", "org_id", "workspace_id", "project_id").write.parquet(path)
    (r,) = tables.scan(spark, path, "o", "w", "p").collect()
    assert (r.describe_status, r.seq, r.concepts, r.embedding) == ("failed", 0, "[]", None)
    assert tables.scan(spark, path, "o", "w", "other").isEmpty()


def test_minting_and_appending(spark, tmp_path):
    ids, vs = str(tmp_path / "ids"), str(tmp_path / "vs")
    new = tables.from_rows(spark, [row(entity_id="a"), row(entity_id="b")], schemas.IDENTITIES)
    tables.mint_identities(spark, new, ids)
    assert tables.read_tolerant(spark, ids, schemas.IDENTITIES).count() == 2
    assert tables.mint_identities(spark, new, ids).count() == 0
    with pytest.raises(ValueError):
        tables.mint_identities(spark, new.union(new), ids)
    assert tables.lookup(tables.read_tolerant(spark, ids, schemas.IDENTITIES), "a").count() == 1
    for t in ("1", "2"):
        tables.append_versions(spark, tables.from_rows(spark, [row(entity_id="a", observed_at=t)], schemas.VERSIONS), vs)
    got = tables.scan(spark, vs, "o", "w", "p")
    assert sorted((r.seq, r.observed_at) for r in got.collect()) == [(0, "1"), (1, "2")]
    assert "PartitionFilters: [isnotnull(org_id" in got._jdf.queryExecution().executedPlan().toString()


def test_stream_writes_identities_first_and_nothing_twice(spark, tmp_path):
    src, ids, vs = (str(tmp_path / x) for x in ("src", "ids", "vs"))
    batch = tables.from_rows(spark, [row(entity_id="a"), row(entity_id="a", observed_at="2", content_hash="g"), row(entity_id="b")], schemas.VERSIONS)
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    ingest.start(stream, ids, vs, str(tmp_path / "cp"), None).awaitTermination(120)
    ingest.start(stream, ids, vs, str(tmp_path / "cp-lost"), None).awaitTermination(120)  # the batch comes again
    assert tables.read_tolerant(spark, ids, schemas.IDENTITIES).count() == 2
    assert sorted((r.entity_id, r.seq) for r in tables.read_tolerant(spark, vs, schemas.VERSIONS).collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_cycles_halt(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(3).write.parquet(src)
    failures = Failures(most=1)
    q = ingest.cycles(spark.readStream.schema("id long").parquet(src), lambda b, n: (b.count(), b.count()), str(tmp_path / "cp"), failures, None)
    q.awaitTermination(120)
    assert failures.halted


def brute_bursts(times, pause, most):
    out, first, last, n = [], None, None, 0
    for t in times:
        if first is not None and (t - last > pause or t - first > most):
            out.append((min(last + pause, first + most), n))
            first, n = None, 0
        first = t if first is None else first
        last, n = t, n + 1
    return out + ([(min(last + pause, first + most), n)] if n else [])


def test_capped_sessions(spark):
    rng = random.Random(3)
    rows = [(p, rng.randrange(20_000)) for p in "abc" for _ in range(80)]
    got = debounce.capped_sessions(spark.createDataFrame(rows, "path string, ts_ms long"), 300, 1500)
    want = sorted((p, *b) for p in "abc" for b in brute_bursts(sorted(t for q, t in rows if q == p), 300, 1500))
    assert sorted(map(tuple, got.collect())) == want


def test_debouncer_sets_and_caps_timers():
    now, timers, state, out = [0], set(), {}, []
    handle = types.SimpleNamespace(getValueState=lambda *_: types.SimpleNamespace(get=lambda: state["v"], exists=lambda: "v" in state, update=lambda v: state.update(v=v), clear=state.clear), registerTimer=timers.add, deleteTimer=timers.discard)
    d = debounce.Debouncer(500, 1200)
    d.init(handle)
    clock = types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now[0])
    for t in (0, 400, 800, 1100):
        now[0] = t
        list(d.handleInputRows(("p",), iter([[1, 2]]), clock))
    assert timers == {1200}
    out = list(d.handleExpiredTimer(("p",), clock, types.SimpleNamespace(getExpiryTimeInMs=lambda: 1200)))
    assert out[0].values.tolist() == [["p", 1200, 8]] and not state


def test_debounce_on_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "src")
    events = lambda n: spark.createDataFrame([("a", i) for i in range(n)] + [("b", 0)], "path string, ts_ms long").coalesce(1).write.mode("append").parquet(src)
    events(3)
    stream = spark.readStream.schema("path string, ts_ms long").parquet(src)
    q = debounce.debounce(stream, 200, 1000).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        fired, end = lambda: {(r.path, r.n) for r in spark.table("fired").collect()}, time.time() + 90
        while fired() != {("a", 3), ("b", 1)} and time.time() < end:
            time.sleep(0.3)
        assert fired() == {("a", 3), ("b", 1)}
        events(2)  # a burst of its own
        while len(fired()) < 3 and time.time() < end:
            time.sleep(0.3)
        assert ("a", 2) in fired()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_looks_on_a_beat(spark, tmp_path):
    looks = []
    q = ingest.on_a_beat(spark, lambda: looks.append(1), str(tmp_path / "cp"), 0.2)
    end = time.time() + 60
    while len(looks) < 2 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert len(looks) >= 2


def test_new_files_as_a_stream_and_repeats_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    seen = []
    q = ingest.file_stream(spark, str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: seen.extend((os.path.basename(r.path), bytes(r.content)) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert seen == [("a.txt", b"one")]
    src = str(tmp_path / "events")
    spark.sql("SELECT explode(array('a', 'a', 'b')) AS path, timestamp'2024-01-01' AS ts").write.parquet(src)
    kept = []
    q = ingest.unseen(spark.readStream.schema("path string, ts timestamp").parquet(src), "1 hour", ["path"]).writeStream.option("checkpointLocation", str(tmp_path / "cp2")).foreachBatch(lambda b, n: kept.extend(r.path for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(kept) == ["a", "b"]


def test_heal_once(spark):
    columns = schemas.VERSIONS
    df, tries = spark.createDataFrame([("e",)], "entity_id string"), []

    def write(d):
        tries.append(d.columns)
        d.select("embedding").count()

    nullable = [c for c in columns if c.nullable]
    tables.healed(write, df, nullable)
    assert len(tries) == 2 and set(tries[1]) == {"entity_id", *[c.name for c in nullable]}
    with pytest.raises(ValueError):
        schemas.evolve(df, columns)  # not all can be added
    with pytest.raises(AnalysisException):
        tables.healed(lambda d: d.select("nowhere").count(), schemas.evolve(df, nullable).withColumns({c.name: F.lit(None) for c in nullable}), nullable)


def test_resync_is_asked_for(spark):
    f = lambda rows: debounce.needs_resync(spark.createDataFrame(rows, "path string, is_dir boolean")).first().resync
    assert not f([("a", False)]) and f([("a", False), (None, None)]) and f([("d", True)]) and not f([])


def tree(root):
    for p, c in {"a.txt": b"a", "src/b.py": b"bb", "src/deep/c.py": b"c", ".git/x": b"x", "src/node_modules/y": b"y"}.items():
        os.makedirs(os.path.dirname(root / p), exist_ok=True)
        (root / p).write_bytes(c)
    os.symlink(root / "a.txt", root / "src/link")


def test_walk_prunes_and_reads(spark, tmp_path):
    tree(tmp_path)
    got = {r.path: bytes(r.content) for r in files.walk(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": b"a", "src/b.py": b"bb", "src/deep/c.py": b"c"}
    assert files.walk(spark, str(tmp_path), contents=False).where("content IS NOT NULL").isEmpty()
    stored = {r.path for r in files.stored_files(spark, f"file://{tmp_path}/src").select("path").collect()}
    assert "deep/c.py" in stored and "b.py" in stored
    assert files.contained(str(tmp_path), "../x") is None and files.contained(str(tmp_path), "src/link") is None and files.contained(str(tmp_path), "src/b.py")


def test_discovery_policies(spark, tmp_path):
    tree(tmp_path)
    listed = lambda *a, **k: subprocess.CompletedProcess(a, 0, b"a.txt\0src/b.py\0a.txt\0", b"")
    broken = lambda *a, **k: subprocess.CompletedProcess(a, 1, b"", b"")

    def absent(*a, **k):
        raise FileNotFoundError

    df, why = files.discover(spark, str(tmp_path), run=listed)
    assert sorted(r.path for r in df.collect()) == ["a.txt", "src/b.py"] and why is None
    assert {r.path: bytes(r.content) for r in df.collect()}["a.txt"] == (tmp_path / "a.txt").read_bytes()
    assert [r.path for r in files.discover(spark, str(tmp_path), run=listed, prefixes=["src"])[0].collect()] == ["a.txt"]
    walked = files.discover(spark, str(tmp_path), run=absent, rules={"": "*.py"}, contents=False)[0]
    assert "a.txt" in (paths := [r.path for r in walked.collect()]) and not any(p.endswith(".py") for p in paths)
    assert files.discover(spark, str(tmp_path), run=broken)[1] == "version-control-error"
    assert files.discover(spark, str(tmp_path), run=absent)[1] is None
    with pytest.raises(RuntimeError):
        files.discover(spark, str(tmp_path), "abort", run=broken)


def test_json_files(spark, tmp_path):
    def put(doc):
        (tmp_path / "f.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
        return str(tmp_path / "f.json")

    ok = {"version": 1, "org_id": "o", "workspace_id": "w", "bindings": [{"prefix": "/a", "project_id": "p"}, {"prefix": 3}]}
    assert files.projects(spark, put(ok), "o", "w").count() == 1 and files.projects(spark, put(ok), "x", "w").count() == 0 and files.projects(spark, put("{"), "o", "w").count() == 0
    assert files.load_state(put({"paused": True, "projects": {"a": False, "b": "x"}})) == {"paused": True, "projects": {"a": False}}
    assert files.load_state(put("[]")) == {"paused": False, "projects": {}}
    assert files.reviews(spark, put([{"id": "1", "candidate": "c", "new_path": "p"}, {"id": "2"}])).count() == 1
    assert files.ignore_prefixes(put({"ignore": ["a", 1, ""]})) == ["a"] and files.ignore_prefixes(put("x")) == []


def test_supervision_waits_longer_and_gives_up(spark, tmp_path):
    waits, runs = [], []

    def fails():
        runs.append(1)
        raise OSError

    assert ingest.supervise(fails, wait=waits.append) == "degraded" and waits == [1, 2, 4, 8, 16] and len(runs) == 6
    src, seen = str(tmp_path / "src"), []
    spark.range(3).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    beat = ingest.Heartbeat()
    spark.streams.addListener(beat)
    assert ingest.supervise(lambda: ingest.write_last(stream, lambda b: seen.append(b.count()), str(tmp_path / "cp"), None)) == "stopped"
    spark.streams.removeListener(beat)
    assert seen == [3]
