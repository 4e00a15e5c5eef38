"""Hybrid recall: a lexical and a vector arm over the last described versions, fused by reciprocal rank."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.operators.versions import latest_where

#: The rank constant of the fusion, and how much deeper the vector arm goes.
RRF_K, OVERFETCH = 60, 3


def lexical_arm(rows: DataFrame, term: str, fields: list[str], limit: int, id_col: str = "id") -> DataFrame:
    """Rows that hold the term in a field; the first field that does ranks, then the id. Adds priority."""
    hit = [C.contains_term(F.col(f), term) for f in fields]
    rank = F.lit(len(fields))
    for i in reversed(range(len(fields))):
        rank = F.when(hit[i], i).otherwise(rank)
    found = hit[0]
    for h in hit[1:]:
        found = found | h
    return rows.where(found & (F.col(id_col) != "") if dict(rows.dtypes)[id_col] == "string" else found).withColumn("priority", rank).orderBy("priority", id_col).limit(limit)


def vector_arm(rows: DataFrame, query: list[float], limit: int, id_col: str = "id", vector: str = "embedding", active_model: str | None = None, model_col: str = "embed_model") -> tuple[DataFrame, DataFrame]:
    """(usable, left out) of the limit's threefold best by cosine; rows of another embedding model than the active one are left out after the cut."""
    lit = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.size(vector) > 0).withColumn("score", C.recall_score(C.cosine(F.col(vector), lit)))
    top = scored.orderBy(F.desc("score"), id_col).limit(limit * OVERFETCH)
    if active_model is None or model_col not in rows.columns:
        return top, top.where("false")
    same = F.col(model_col).isNull() | (F.col(model_col) == active_model)
    return top.where(same), top.where(~same)


def ranked(arm: DataFrame, number: int, id_col: str, *order: object) -> DataFrame:
    """An arm's rows with their place in it (ties have places of their own) and the arm's number."""
    one = Window.partitionBy(F.lit(number)).orderBy(*order, id_col)
    return arm.withColumn("_rank", F.row_number().over(one)).withColumn("_arm", F.lit(number))


def rrf_multiplier(setting: object) -> float:
    """A configured multiplier: any finite number above 0, else 1. Both arms search one table, so fusion gives it to neither."""
    good = isinstance(setting, int | float) and not isinstance(setting, bool) and math.isfinite(setting) and setting > 0
    return float(setting) if good else 1.0


def fuse(arms: list[DataFrame], hit: list[str], limit: int, id_col: str = "id", k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) by id; the first arm's row is kept. Arms come from ranked() and are short."""
    union = arms[0].select(id_col, *hit, "_rank", "_arm")
    for a in arms[1:]:
        union = union.unionByName(a.select(id_col, *hit, "_rank", "_arm"))
    fused = union.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("_rank"))).alias("rrf"), F.min_by(F.struct(*hit), "_arm").alias("_hit"))
    return fused.select(id_col, *[F.col("_hit")[h].alias(h) for h in hit], "rrf").orderBy(F.desc("rrf"), id_col).limit(limit)


@dataclass
class Recall:
    """hits and what became of the arms; reason is None when both ran."""

    hits: DataFrame
    degraded: bool
    reason: str | None = None
    arms: dict[str, str] = field(default_factory=dict)
    #: Ids among the vector arm's best whose vector is of another model than the active one: to be embedded anew.
    requeue: DataFrame | None = None


HIT = ["source", "path", "title", "body", "concepts", "content_hash"]


def recall(versions: DataFrame, query: str, vector: list[float] | None, limit: object = 20, dim: int | None = None, active_model: str | None = None) -> Recall:
    """Searches the last described version of each entity.

    An empty query gives nothing and counts as degraded, as does a vector that is missing, has the wrong size or a
    value that isn't finite: the lexical arm then answers alone, as either does if the other fails. The vector arm goes first, so its row wins.
    """
    n = C.clamp_limit(limit)
    rows = latest_where(versions, F.col("describe_status") == "described").where(F.col("entity_id") != "")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.select(F.col("entity_id").alias("id"), F.lit("entity").alias("source"), text("path").alias("path"), text("title").alias("title"), text("description").alias("body"), text("concepts").alias("concepts"), text("content_hash").alias("content_hash"), "embedding", "embed_model")
    term = query.strip()
    if not term:
        return Recall(rows.where("false").select("id", *HIT, F.lit(0.0).alias("rrf")), True)
    lexical = _answer(lambda: ranked(lexical_arm(rows, term, ["title", "body", "concepts"], n), 1, "id", "priority"))
    state = "ok" if lexical is not None else "error"
    nothing = rows.where("false").select("id", *HIT, F.lit(0.0).alias("rrf"))
    bad = "no-query-vector" if vector is None else "wrong-dimension" if dim is not None and len(vector) != dim else "bad-query-vector" if not all(map(math.isfinite, vector)) else None
    if bad:
        return Recall(fuse([lexical], HIT, n) if lexical is not None else nothing, True, bad, {"lexical": state, "vector": "off"})
    found = _answer(lambda: _marked(rows, vector, n, active_model))
    if found is None:
        return Recall(fuse([lexical], HIT, n) if lexical is not None else nothing, True, "vector-arm-error", {"lexical": state, "vector": "error"})
    near = ranked(found.where("_usable"), 0, "id", F.desc("score"))
    arms = [near] if lexical is None else [near, lexical]
    return Recall(fuse(arms, HIT, n), lexical is None, None if lexical is not None else "lexical-arm-error", {"lexical": state, "vector": "ok"}, found.where("NOT _usable").select("id"))


def _marked(rows: DataFrame, vector: list[float], n: int, active_model: str | None) -> DataFrame:
    """The vector arm's best, with whether their model is the active one."""
    usable, out = vector_arm(rows, vector, n, active_model=active_model)
    return usable.withColumn("_usable", F.lit(True)).unionByName(out.withColumn("_usable", F.lit(False)))


def _answer(arm: Callable[[], DataFrame]) -> DataFrame | None:
    """An arm's rows, worked out (at most OVERFETCH times the limit), or None if it fails: the other arm then answers alone."""
    try:
        df = arm()
        return df.sparkSession.createDataFrame(df.collect(), df.schema)
    except PySparkException:
        return None
