"""Exact top-k search by inner product with MaxScore.

Vectors are turned into integers; each dimension is a term and its column of a shard the
term's postings. With a query's weight w and the shard's range [lo, hi] of a term, the
term adds at least min(w * lo, w * hi) and at most max(w * lo, w * hi). Terms are split, by
those bounds, into essential ones and a tail that can't lift a document with the least in
the essential ones to the k-th best score so far. The essential postings are traversed for a
whole block of documents; the tail is probed only for documents that can still compete. Each shard gives its own k best, and the
shards' lists are merged.

Both sides go in blocks of fixed size, and every block of queries meets every shard once, so
a task's memory doesn't depend on the tables' sizes; no document or query is dropped.

Defined results: a null vector and one with a null or non-finite component take no part; a
dimension that one vector lacks adds nothing (an empty vector scores 0 everywhere); rows
that repeat an id are candidates of their own, each but the query's own id, and a query's rows are ranked together; ties go to the
smaller id, and equal ids with equal scores are all kept apart; a null id takes no part; fewer
candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block, documents traversed at a time.
SHARD_ROWS, QUERY_ROWS, BLOCK = 16_384, 2_048, 2_048
EXACT = 2.0**53


def as_matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(queries: np.ndarray, own: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, document's id, score) of the k best of a shard for each query, by MaxScore.

    Values are whole numbers in float64; the caller sees to it that sums stay exact.
    """
    order = np.argsort(ids, kind="stable")
    docs, ids = docs[order], ids[order]
    postings = np.ascontiguousarray(docs.T)
    lo, hi = postings.min(axis=1), postings.max(axis=1)
    rows, found, scores = [], [], []
    for q in range(len(queries)):
        w = queries[q]
        bound, least = np.maximum(w * lo, w * hi), np.minimum(w * lo, w * hi)
        spread = bound - least  # what a term's postings can add to its least
        terms = np.argsort(-spread, kind="stable")
        terms = terms[spread[terms] > 0]
        fixed = bound.sum() - bound[terms].sum()  # of terms that are the same for every document
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0) + fixed  # rest[j]: the most that terms[j:] can add
        lift = least.sum() + np.append(np.cumsum(spread[terms][::-1])[::-1], 0.0)  # the best score if terms[:j] give their least
        best_s, best_i = np.empty(0), np.empty(0, ids.dtype)
        theta = -np.inf
        for start in range(0, len(ids), BLOCK):
            block = slice(start, min(start + BLOCK, len(ids)))
            essential = int(np.count_nonzero(lift[:-1] >= theta))
            part = w[terms[:essential]] @ postings[terms[:essential], block]
            alive = np.flatnonzero(part + rest[essential] >= theta)
            part = part[alive]
            for j in range(essential, len(terms), 4):
                if not len(alive):
                    break
                some = terms[j : j + 4]
                part = part + w[some] @ postings[np.ix_(some, alive + start)]
                ok = part + rest[min(j + 4, len(terms))] >= theta
                alive, part = alive[ok], part[ok]
            here = ids[alive + start]
            ok = here != own[q]
            s, i = np.concatenate([best_s, part[ok] + fixed]), np.concatenate([best_i, here[ok]])
            if len(s) > k:
                keep = np.lexsort((i, -s))[:k]
                s, i = s[keep], i[keep]
            best_s, best_i = s, i
            if len(s) == k:
                theta = s.min()
        rows.append(np.full(len(best_s), q))
        found.append(best_i)
        scores.append(best_s)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows that take no part are gone."""
    x = F.col("v")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & x.isNotNull())
        .where(~bad)
        .select("id", F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("double")).alias("v"))
    )


def search(df: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    is_query: a condition on ``id`` that picks the queries; every row is a candidate for the
    others. Sums are exact while |score| < 2^53; beyond it the shard counts with Python integers
    and a score outside of long is held at long's limit.
    """
    rows = integer_vectors(df, id_col, vector, scale)
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    part = lambda count, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(count)).cast("int")
    docs = rows.withColumn("shard", part(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where(is_query).withColumn("block", part(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def both(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(max(map(len, q.v)), max(map(len, d.v)))
        a, b = as_matrix(q.v.tolist(), dims), as_matrix(d.v.tolist(), dims)
        if dims and np.abs(a).max() * np.abs(b).max() * 4 * dims >= EXACT:
            to_int = np.frompyfunc(int, 1, 1)
            a, b = to_int(a), to_int(b)
            out = [(qi, di, max(-(2**63), min(2**63 - 1, int((a[i] * b[j]).sum())))) for i, qi in enumerate(q.id) for j, di in enumerate(d.id) if qi != di]
            got = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
            return got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        r, i, s = top_k(a, q.id.to_numpy(), b, d.id.to_numpy(), k)
        return pd.DataFrame({"query_id": q.id.to_numpy()[r], "vec_id": i, "score": s.astype("int64")})

    local = queries.groupBy("block", "shard").cogroup(docs.groupBy("block", "shard")).applyInPandas(both, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
