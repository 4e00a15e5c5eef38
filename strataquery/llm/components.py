"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a minimum over neighbours and a join, both on light rows (two longs); nothing
goes to the driver but two numbers a round. Rounds grow with the logarithm of the longest path. The minima are
kept as a table before the join: both sides then are plain shuffles, which Spark splits where a
hub has many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import drop_stash, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components-least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = stash(down.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b: long); root is the least node of its component."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while state[0]:
        new = stash(_small_star(_large_star(now)), name)
        drop_stash(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0
