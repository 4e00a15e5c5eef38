"""Operators that SQL can't express, and scenarios of the catalog, on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataquery import schemas
from strataquery.functions import kernels as K
from strataquery.operators import enrich, load, matching, paths, projection, recall, resolve
from strataquery.operators import versions as V


def test_pack_is_next_fit(spark):
    rng = random.Random(1)
    files = [(f"p{rng.randrange(10**6):07d}-{i}", rng.choice([10, 3000, 4096, 50_000, 200_000]), rng.choice("ab")) for i in range(300)]
    got = {r.path: r.batch for r in load.pack(spark.createDataFrame(files, "path string, size_bytes long, shard string"), "shard").collect()}
    for shard in "ab":
        batch, n, size, tokens = -1, 99, 0, 0
        for p, b, _ in sorted(f for f in files if f[2] == shard):
            t = -(-b // 4)
            if n + 1 > load.PACK_FILES or size + b > load.PACK_BYTES or tokens + t > load.PACK_TOKENS:
                batch, n, size, tokens = batch + 1, 0, 0, 0
            n, size, tokens = n + 1, size + b, tokens + t
            assert got[p] == batch, p


def test_describe_bisects_and_asks_alone(spark):
    files = [(f"e{i}", f"p{i}.py", f"c{i}", "s", 0) for i in range(8)]

    def client(batch):
        if any(f["id"] == "e7" for f in batch) and len(batch) == 1:
            raise OSError
        if len(batch) > 4:
            return "[", True
        return json.dumps([{"id": f["id"], "title": "T" + f["id"], "description": "d", "concepts": ["X"]} for f in batch if f["id"] not in ("e2", "e7") or len(batch) == 1]), False

    rows = {r.entity_id: r for r in load.describe(spark.createDataFrame(files, "entity_id string, path string, content string, shard string, batch int"), client, "m", "now").collect()}
    assert len(rows) == 8 and {i for i, r in rows.items() if r.describe_status == "failed"} == {"e7"}
    assert rows["e2"].title == "Te2" and rows["e0"].concepts == '["x"]' and rows["e7"].describe_model == ""


def test_embed_guards_vectors(spark):
    rows = spark.createDataFrame([("a", "b"), ("bad", ""), ("nan", "")], "title string, description string")

    def provider(texts):
        return [[1.0, 2.0] if t.startswith("a") else [1.0] if t.startswith("bad") else [float("nan"), 0.0] for t in texts]

    got = {r.title: r for r in load.embed(rows, provider, 2, "m").collect()}
    assert got["a"].embedding == [1.0, 2.0] and got["a"].embed_model == "m"
    assert got["bad"].embedding is None and got["nan"].embedding is None and got["bad"].embed_model is None
    assert load.embed(rows, None, 2, None).where("embedding IS NOT NULL").isEmpty()


def test_prepared_buckets(spark):
    files = spark.createDataFrame([("a.png", 9, bytearray(b"x")), ("b.txt", 3, bytearray(b"a\0b")), ("c.py", 5000, bytearray(b"abc")), ("d.py", 3, bytearray(b"abc")), ("e.txt", 10**6, bytearray(b"z"))], "path string, size_bytes long, content binary")
    got = {r.path: r for r in load.prepared(files).collect()}
    assert {p: r.bucket for p, r in got.items()} == {"a.png": "skip-binary", "b.txt": "skip-binary", "c.py": "solo", "d.py": "batch", "e.txt": "skip-too-large"}
    assert got["c.py"].content_hash == got["d.py"].content_hash and got["a.png"].content is None and len(got["a.png"].content_hash) == 64


def known_rows(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, path string, content_hash string, size_bytes long, fingerprint string")


def sequential_ladder(observed, known):
    """The ladder one file at a time, in order of paths."""
    at, first = {k[1]: k for k in known}, {}
    for k in sorted(known):
        first.setdefault(k[2], k)
    disk = {o[0] for o in observed}
    gone = {k[0]: k for k in known if k[1] not in disk}
    out, minted = {}, set()
    for path, h, _size, content in sorted(observed):
        if path in at:
            out[path] = ("unchanged" if at[path][2] == h else "edit", at[path][0])
    fresh = sorted(o for o in observed if o[0] not in at)
    for path, h, _size, content in fresh:
        if h in first:
            # the first entity of the hash, and no other: carried if its path is gone, after which it is there again
            out[path] = ("move" if first[h][0] in gone else "copy", first[h][0])
            gone.pop(first[h][0], None)
    for path, h, size, content in fresh:
        if path in out:
            continue
        if h in minted:
            out[path] = ("copy", None)
            continue
        minted.add(h)
        mine, best = K.fingerprint(content.encode()), []
        for k in gone.values():
            if k[4] and min(size, k[3]) >= 50 and size * 0.8 <= k[3] <= size * 1.2:
                best.append((K.fingerprint_distance(mine, k[4]), k[0], k[3]))
        scored = sorted((-(1.0 if d <= 0 else max(0.0, 1 - d / (min(768, 6 * (min(128, size - 2) + min(128, s - 2))) + 33))), e) for d, e, s in best)
        if not scored or -scored[0][0] < 0.55:
            out[path] = ("mint", None)
        elif -scored[0][0] >= 0.85 and (len(scored) < 2 or scored[1][0] != scored[0][0]):
            out[path] = ("carry", scored[0][1])
            del gone[scored[0][1]]
        else:
            out[path] = ("review", scored[0][1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ladder_against_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(15, 60)))
    contents = [text() for _ in range(12)]
    known = [(f"e{i:02d}", f"k/{i:02d}", f"h{i % 10}", len(contents[i % 10]), K.fingerprint(contents[i % 10].encode())) for i in range(12)]
    observed = [(f"k/{i:02d}", f"h{i % 10}" if i % 2 else f"new{i}", 60, contents[i]) for i in range(0, 6)]
    observed += [(f"n/{j:02d}", f"h{j % 10}", len(contents[j % 10]), contents[j % 10]) for j in rng.sample(range(12), 4)]
    for j in range(8):
        c = contents[6 + j % 4]
        c = c[: 20 + j] + "zq" + c[20 + j :]
        observed.append((f"x/{j:02d}", f"f{j // 2}" if j > 5 else f"g{j}", len(c), c))
    got = {r.path: (r.action, r.entity_id) for r in resolve.resolve(spark.createDataFrame(observed, "path string, content_hash string, size_bytes long, content string"), known_rows(spark, known), resolve.by_likeness()).collect() if r.action != "missing"}
    assert got == sequential_ladder(observed, known)


def test_ties_are_for_review(spark):
    new = spark.createDataFrame([("n", 100, K.fingerprint(b"ab" * 50))], "path string, size_bytes long, fingerprint string")
    missing = spark.createDataFrame([(e, 100, K.fingerprint(b"ab" * 50)) for e in "xy"] + [("z", 10, K.fingerprint(b"abc"))], "entity_id string, size_bytes long, fingerprint string")
    (r,) = matching.fuzzy_matches(new, missing).collect()
    assert (r.outcome, r.entity_id, r.confidence) == ("review", "x", 1.0)
    (r,) = matching.fuzzy_matches(new, missing.where("entity_id = 'x'")).collect()
    assert r.outcome == "match"


def test_repair_is_idempotent(spark):
    ids = spark.createDataFrame([("a", "1"), ("b", "9"), ("lonely", "1"), ("c", "0")], "entity_id string, last_update_date string")
    vs = spark.createDataFrame([("a", 0, "p", "1", "h"), ("a", 0, "p", "3", "g"), ("b", 0, "q", "2", "h"), ("c", 0, "p", "2", "h"), ("ghost", 0, "z", "1", "h")], "entity_id string, seq long, path string, observed_at string, content_hash string")
    out = resolve.repair_sweep(ids, vs)
    assert [out[k].count() for k in ("orphan_identities", "orphan_versions", "duplicate_seqs", "stale", "duplicate_paths")] == [1, 1, 1, 2, 2]
    assert {r.entity_id: r.observed_at for r in out["versions"].collect()} == {"a": "3", "b": "2"}
    again = resolve.repair_sweep(out["identities"], out["versions"])
    assert all(again[k].isEmpty() for k in ("orphan_identities", "orphan_versions", "duplicate_seqs", "stale", "duplicate_paths"))


def test_only_the_first_entity_of_a_hash_moves_and_once(spark):
    disk = lambda *rows: spark.createDataFrame(rows, "path string, content_hash string")
    known = disk(("a", "h"), ("b", "h"), ("k", "i"), ("Foo", "j")).withColumn("entity_id", F.concat(F.lit("e"), "path"))
    got = {r.path: (r.action, r.entity_id, r.source_path) for r in matching.moves_copies_mints(disk(("x", "h"), ("y", "h"), ("z", "new"), ("zz", "new"), ("foo", "j")), known).collect()}
    assert got == {"x": ("move", "ea", None), "y": ("copy", "ea", "a"), "z": ("mint", None, None), "zz": ("copy", None, "z"), "foo": ("move", "eFoo", None)}
    # the first one is still there: its copies copy it, though another entity's path is gone
    got = {r.path: (r.action, r.entity_id) for r in matching.moves_copies_mints(disk(("a", "h"), ("x", "h")), known).collect()}
    assert got == {"x": ("copy", "ea")}
    # without case, another spelling is the same file; a copy elsewhere that sorts first stays a copy
    folded = {r.path: (r.action, r.entity_id) for r in matching.moves_copies_mints(disk(("foo", "j"), ("a/c", "j")), known, fold=True).collect()}
    assert folded == {"a/c": ("copy", "eFoo"), "foo": ("move", "eFoo")}
    states = {r.path: r.state for r in matching.classify_paths(disk(("foo", "j"), ("K", "i"), ("n", "x")), known, fold=True).collect()}
    assert states == {"foo": "changed", "K": "changed", "n": "new", "a": "missing", "b": "missing"}
    steps = {r.path: r.action for r in resolve.resolve(disk(("foo", "j"), ("a", "h"), ("b", "h"), ("k", "i")), known, fold=True).collect()}
    assert steps == {"foo": "move", "a": "unchanged", "b": "unchanged", "k": "unchanged"}


def test_the_fuzzy_step_can_be_another(spark):
    known = known_rows(spark, [("e1", "a", "h", 100, None)])
    new = spark.createDataFrame([("b", "x", 100, "text")], "path string, content_hash string, size_bytes long, content string")
    step = lambda files, gone: files.select("path").crossJoin(gone.select("entity_id")).withColumns({"distance": F.lit(3), "confidence": F.lit(0.9), "outcome": F.lit("match")})
    assert {r.path: (r.step, r.action, r.entity_id) for r in resolve.resolve(new, known, step).collect()}["b"] == (4, "carry", "e1")


def test_reviews(spark):
    reviews = spark.createDataFrame([(i, f"c{i}", f"p{i}", f"h{i}", 5, 0.6, f"m{i}") for i in "123456"], "id string, candidate string, new_path string, content_hash string, size_bytes long, confidence double, minted_id string")
    known = [("c1", "x"), ("c2", "x"), ("c3", "x"), ("c5", "x"), ("c6", "x"), ("m1", "h1"), ("m2", "other"), ("m3", "h3"), ("m4", "h4")]
    known = spark.createDataFrame([version(entity_id=e, content_hash=h, seq=4) for e, h in known], VERSION)
    decisions = [("1", "accept"), ("2", "accept"), ("3", "reject"), ("4", "accept"), ("5", "accept"), ("6", "skip")]
    got = resolve.accept_reviews(reviews, spark.createDataFrame(decisions, "id string, decision string"), known)
    # 2: the placeholder has other content by now; 4: the candidate is gone; 5: the placeholder never was
    assert {r.id: r.outcome for r in got["outcomes"].collect()} == {"1": "carried", "2": "stale", "3": "rejected", "4": "stale", "5": "carried", "6": "skipped"}
    assert {(r.entity_id, r.path, r.content_hash, r.seq, r.title, r.describe_status) for r in got["carried"].collect()} == {("c1", "p1", "h1", 5, "t", "pending"), ("c5", "p5", "h5", 5, "t", "pending")}
    assert [r.entity_id for r in got["retired"].collect()] == ["m1"]


def test_deletion_keeps_other_tenants_and_pruning_looks_again(spark):
    rows = spark.createDataFrame([("e", "o", "w", "p"), ("e", "o", "w", "q"), ("f", "o", "w", "p")], "entity_id string, org_id string, workspace_id string, project_id string")
    (left,) = resolve.delete_entities([rows], spark.createDataFrame([("e",)], "entity_id string"), ("o", "w", "p"))
    assert sorted((r.entity_id, r.project_id) for r in left.collect()) == [("e", "q"), ("f", "p")]
    last = spark.createDataFrame([("e", "a", "2020-01-01"), ("f", "b", "2020-01-01")], "entity_id string, path string, observed_at string")
    disk = spark.createDataFrame([("a",)], "path string")
    assert [r.entity_id for r in resolve.confirm_prune(last, last, disk, "2021-01-01").collect()] == ["f"]


def version(**kw):
    base = {"entity_id": "e", "seq": 0, "path": "p", "title": "t", "description": "d", "concepts": "[]", "content_hash": "h", "embedding": None, "embed_model": None, "describe_status": "described", "observed_at": "1", "describe_model": "m", "described_at": "x", "size_bytes": 1, "fingerprint": None}
    return tuple((base | kw).values())


VERSION = "entity_id string, seq long, path string, title string, description string, concepts string, content_hash string, embedding array<float>, embed_model string, describe_status string, observed_at string, describe_model string, described_at string, size_bytes long, fingerprint string"


def test_recall_uses_the_last_described_version(spark):
    rows = [
        version(entity_id="a", title="needle", embedding=[1.0, 0.0], embed_model="m1"), version(entity_id="a", seq=1, title="later", describe_status="pending"),
        version(entity_id="b", title="x", description="a Needle", embedding=[0.0, 1.0], embed_model="m2"), version(entity_id="c", title="%", description="_"), version(entity_id="", title="needle"),
    ]
    vs = spark.createDataFrame(rows, VERSION)
    r = recall.recall(vs, " needle ", [1.0, 0.0], 10, dim=2)
    hits = r.hits.collect()
    assert [h.id for h in hits] == ["a", "b"] and not r.degraded and hits[0].title == "needle"
    assert hits[0].rrf == pytest.approx(1 / 61 + 1 / 61) and hits[1].rrf == pytest.approx(1 / 62 + 1 / 62)
    assert [h.id for h in recall.recall(vs, "%", None).hits.collect()] == ["c"]
    assert [h.id for h in recall.recall(vs, "needle", [1.0, 0.0], 10, dim=2, active_model="m2").hits.collect()] == ["b", "a"]
    assert [h.id for h in recall.recall(vs, "needle", [1.0, 0.0], 10, dim=2, active_model="m2").requeue.collect()] == ["a"]
    for q, v, why in (("", [1.0, 0.0], None), ("needle", [1.0], "wrong-dimension"), ("needle", None, "no-query-vector"), ("needle", [float("nan"), 0.0], "bad-query-vector")):
        r = recall.recall(vs, q, v, 10, dim=2)
        assert r.degraded and r.reason == why and r.hits.count() == (0 if not q else 2)


def test_snapshot_round_trip(spark, tmp_path):
    a, b = K.encode_id(1, 1), K.encode_id(2, 2)
    h = "a" * 64
    ids = spark.createDataFrame([(a, "", ""), (b, a, h)], "entity_id string, derived_from string, fork_content_hash string")
    vs = spark.createDataFrame([version(entity_id=a, content_hash=h, concepts='["x"]'), version(entity_id=b, content_hash=h, describe_status="pending")], VERSION)
    project = {"org_id": "o", "workspace_id": "w", "project_id": "p"}
    doc = projection.document(ids, vs, project, "now")
    text = projection.canonical(doc)
    assert text == projection.canonical(projection.document(ids, vs, project, "now")) and text.endswith("}\n")
    assert doc["files"][a]["concepts"] == ["x"] and doc["files"][b]["title"] == "" and doc["derived"] == {b: {"from_entity": a, "fork_content_hash": h}}
    path = str(tmp_path / "snap.json")
    projection.write_atomic(text, path)
    assert projection.load(path, project) == (json.loads(text), None)
    assert projection.load(path, project | {"org_id": "x"}) == (None, "project_mismatch")
    assert projection.load(path + "x", project) == (None, "file_missing")
    for change, why in (({"version": 99}, "future_version"), ({"files": {"bad": doc["files"][a]}}, "invalid_key"), ({"files": {a: doc["files"][a] | {"content_hash": "z"}}}, "invalid_content_hash"), ({"files": {"__proto__": doc["files"][a]}}, "invalid_shape"), ({"derived": []}, "invalid_shape")):
        assert projection.rejection(doc | change, project) == why
    disk = spark.createDataFrame([("p1", h), ("p2", h), ("p3", h)], "path string, content_hash string")
    rows = {r.path: r for r in projection.inherit(disk, projection.entry_rows(spark, doc), spark.createDataFrame([(a,)], "entity_id string"), "now").collect()}
    assert rows.keys() == {"p2", "p3"} and rows["p2"].entity_id == b and rows["p3"].entity_id is None and rows["p3"].title == "t" and rows["p3"].describe_status == "pending"


def test_enrichment_cycle(spark):
    rows = [
        version(entity_id="gone", describe_status="pending", path="gone"), version(entity_id="vec", describe_status="pending", path="vec"),
        version(entity_id="cos", content_hash="h0", title="old", embedding=[1.0]), version(entity_id="cos", seq=1, content_hash="h1", path="cos", describe_status="pending", title="", description=""),
        version(entity_id="new", describe_status="failed", path="new", title="", description=""), version(entity_id="done"),
    ]
    contents = spark.createDataFrame([("vec", "v"), ("cos", "def f ( x ): return x"), ("new", "n")], "path string, content string")
    before = spark.createDataFrame([("h0", "def f(x):\n  return x")], "content_hash string, content string")

    def client(batch):
        return json.dumps([{"id": f["id"], "title": "T", "description": "D", "concepts": []} for f in batch]), False

    c = enrich.run_cycle(spark.createDataFrame(rows, VERSION), contents, before, client, "m", "now", lambda ts: [[0.5] for _ in ts], 1, "em")
    assert [r.entity_id for r in c.deleted.collect()] == ["gone"] and [(r.entity_id, r.embedding) for r in c.reembedded.collect()] == [("vec", [0.5])]
    (cos,) = c.cosmetic.collect()
    assert (cos.entity_id, cos.title, cos.describe_model, cos.describe_status) == ("cos", "old", "inherited-from:h0", "described")
    assert [(r.entity_id, r.title) for r in c.described.collect()] == [("new", "T")]
    assert c.stats.first().asDict() == {"seen": 4, "deleted": 1, "reembed": 1, "cosmetic": 1, "describe": 1}


def test_failures_halt_until_acknowledged():
    f = enrich.Failures()
    assert not any(f.saw(1, 1) for _ in range(4)) and not f.saw(0, 0) and f.saw(2, 2)
    f.acknowledge()
    assert not f.halted and not f.saw(1, 1) and not f.saw(2, 1) and f.row == 0


def test_load_plan(spark):
    files = spark.createDataFrame([("a.txt", 3, bytearray(b"aaa")), ("b.txt", 3, bytearray(b"bbb")), ("c.txt", 3, bytearray(b"ccc")), ("d.png", 3, bytearray(b"ddd"))], "path string, size_bytes long, content binary")
    snapshot = load.prepared(files).where("path = 'a.txt'").select("content_hash")
    last = load.prepared(files).where("path = 'b.txt'").select("path", "content_hash", F.lit("described").alias("describe_status"))
    p = load.plan(files, last, snapshot)
    names = {k: sorted(r.path for r in p[k].collect()) for k in ("inherited", "skipped", "todo", "packed")}
    assert names == {"inherited": ["a.txt"], "skipped": ["b.txt"], "todo": ["c.txt", "d.png"], "packed": ["c.txt"]}
    assert load.plan(files, last, snapshot, limit=1)["todo"].count() == 1 and load.plan(files, last, snapshot, force=True)["skipped"].isEmpty()
    assert [r.describe_status for r in load.terminal_rows(p["todo"]).collect()] == ["skipped-binary"]


def test_schema_rules(spark):
    for bad in ([schemas.Column("a b", "TEXT", default="")], [schemas.Column("a", "TEXT", True)] * 2, [schemas.Column("a", "TEXT")], [schemas.Column("a", "BLOB", True)]):
        with pytest.raises(ValueError):
            schemas.validate(bad)
    spark.sql(schemas.create_table_sql("made_here", schemas.VERSIONS))
    assert spark.table("made_here").count() == 0
    spark.sql("DROP TABLE made_here")
    assert "ADD COLUMNS" in schemas.add_column_sql("t", schemas.Column("x", "REAL", True))
    with pytest.raises(ValueError):
        schemas.add_column_sql("t", schemas.Column("x", "REAL", default=0))


def test_allocated_seqs(spark):
    stored = spark.createDataFrame([("a", 4)], "entity_id string, seq long")
    new = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1")], "entity_id string, observed_at string")
    assert sorted((r.entity_id, r.observed_at, r.seq) for r in V.allocate_seq(new, stored).collect()) == [("a", "1", 5), ("a", "2", 6), ("b", "1", 0)]


def test_ignored_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("a/.git/x", "src/a.py", "dist/x", "dist", "distant", "", "q/node_modules/z")], "path string")
    assert sorted(r.path for r in paths.without_ignored(df, ["./dist/"]).collect()) == ["distant", "src/a.py"]


def test_bulk_load_persists_in_order(spark):
    rows = [("a.txt", 3, b"aaa"), ("b.png", 3, b"bbb"), ("c.txt", 5000, b"c" * 5000), ("d.txt", 3, b"ddd"), ("e.txt", 3, b"eee")]
    files = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in rows], "path string, size_bytes long, content binary")
    ids = spark.createDataFrame([(p, "id-" + p) for p, _, _ in rows], "path string, entity_id string")
    snapshot = load.prepared(files).where("path = 'e.txt'").select("content_hash")
    done = []

    def client(batch):
        return json.dumps([{"id": f["id"], "title": f["content"][:3], "description": "d", "concepts": []} for f in batch]), False

    empty = spark.createDataFrame([], VERSION)
    load.run(files, empty, snapshot, ids, load.with_retries(client), "m", "now", lambda stage, df: done.append((stage, sorted(r.entity_id for r in df.collect()))))
    assert done == [("inherited", ["id-e.txt"]), ("pending", ["id-a.txt", "id-c.txt", "id-d.txt"]), ("skipped", ["id-b.png"]), ("described", ["id-a.txt", "id-c.txt", "id-d.txt"])]


def test_retries():
    calls, waits = [], []

    def client(files):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "[]", False

    assert load.with_retries(client, wait=waits.append)([]) == ("[]", False) and waits == [0.5, 1.0]
    with pytest.raises(KeyError):
        load.with_retries(lambda f: {}["x"])([])


def test_status_view(spark):
    assert V.status(None)["queue_depth"] == 0
    s = V.status(spark.createDataFrame([version(), version(entity_id="b", describe_status="pending"), version(entity_id="b", seq=1)], VERSION))
    assert s["queue_depth"] == 1 and s["counts"]["described"] == 2 and s["counts"]["deleted"] == 0


def test_stat_fast_path(spark):
    disk = spark.createDataFrame([("a", 1, "t"), ("b", 2, "t")], "path string, size_bytes long, mtime string")
    known = spark.createDataFrame([("a", 1, "t"), ("b", 2, "u")], "path string, size_bytes long, mtime_observed string")
    assert [r.path for r in V.unchanged_by_stat(disk, known).collect()] == ["a"]


def test_small_rules(spark):
    from strataquery.functions import columns as C

    assert [recall.rrf_multiplier(x) for x in (2, 0.5, 0, -1, float("inf"), "3", None, True)] == [2.0, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    got = spark.range(3).select(C.batch_output_tokens(F.col("id")).alias("n"), C.without_controls(F.lit("a\x00b\tc\x1f\n")).alias("t")).collect()
    assert [r.n for r in got] == [1024, 1144, 1264] and got[0].t == "ab\tc\n"
    files = spark.createDataFrame([(p,) for p in ("a.log", "kept.log", "b.txt", "sub/c.log")], "path string")
    assert sorted(r.path for r in paths.within_snapshot(files, files.where("path = 'kept.log'"), {"": "*.log"}).collect()) == ["b.txt", "kept.log"]
    none = spark.createDataFrame([], VERSION)
    assert load.needs_load(none, True) and load.needs_load(spark.createDataFrame([version()], VERSION), False) and not load.needs_load(spark.createDataFrame([version()], VERSION), True)


@pytest.mark.parametrize("glob, yes, no", [("*.py", "a.py", "a/b.py"), ("a/**/b", "a/b", "ab"), ("a/**/**/b", "a/x/y/b", "a/xb"), ("***/x", "p/q/x", "p/qx"), ("a**z", "a/b/z", "az/"), ("f?.c", "fo.c", "f/.c"), ("[x]+", "[x]+", "x")])
def test_globs(glob, yes, no):
    import re

    assert re.fullmatch(K.glob_regex(glob), yes) and not re.fullmatch(K.glob_regex(glob), no)
