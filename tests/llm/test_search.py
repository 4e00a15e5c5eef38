"""Operator 1 against brute force."""

import random

import duckdb
import numpy as np
import pytest

from strataquery.llm import maxscore, queries


def brute(rows, k):
    import math

    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in own:
        if q % 3 == 0:
            held = lambda x: max(-(2**63), min(2**63 - 1, x))
            s = sorted((-held(sum(x * y for x, y in zip(a, b, strict=False))), d) for d, b in own if d != q)[:k]
            out |= {(q, n + 1, d, -x) for n, (x, d) in enumerate(s)}
    return out


@pytest.mark.parametrize("shard", [4, 1000])
def test_any_vectors(spark, shard):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(i, [0.5] * 8) for i in range(60, 90)]  # ties
    rows += [(90, None), (91, [1.0, None]), (92, [float("nan")]), (93, [float("inf")]), (94, []), (None, [1.0] * 8), (95, [2.0]), (96, [-0.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in maxscore.search(df, "id % 3 = 0", 5, shard_rows=shard, query_rows=max(2, shard // 3)).collect()}
    assert got == brute(rows, 5)


def test_ids_that_repeat(spark):
    """Each row is a candidate of its own but for the query's own id; a query's rows are ranked together, as in the SQL."""
    rng = random.Random(5)
    rows = [(i % 70, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(140)] + [(7, [1.0] * 6)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    embeddings = df.toPandas()  # noqa: F841  read by the SQL
    want = duckdb.sql(queries.ORACLE_SQL["op1_top_k_search"]).fetchall()
    got = maxscore.search(df, "id % 50 = 0", 5, shard_rows=20).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r[0] for r in want} == {0, 50}


def test_sums_past_float(spark):
    rows = [(i, [1e9 * (i + 1), -3e7]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in maxscore.search(df, "id % 3 = 0", 3).collect()} == brute(rows, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.search(df, "id % 3 = 0").count() == 0


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(0)
    docs = np.floor(rng.normal(0, 40, (5000, 16)) * (rng.random((5000, 16)) < 0.2))
    q = np.floor(rng.normal(0, 40, (20, 16)))
    r, i, s = maxscore.top_k(q, np.full(20, -1), docs, np.arange(5000), 5)
    full = q @ docs.T
    for j in range(20):
        want = np.lexsort((np.arange(5000), -full[j]))[:5]
        assert i[r == j].tolist() == want.tolist() and s[r == j].tolist() == full[j][want].tolist()


def test_oracle(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    want = c.sql(queries.ORACLE_SQL["op1_top_k_search"]).fetchall()
    assert sorted(map(tuple, queries.op1_top_k_search(spark, sf_dir).collect())) == sorted(want) and want
