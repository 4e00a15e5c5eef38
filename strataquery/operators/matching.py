"""Matching of observed files to known entities: by path, by content hash, by occurrence, and by likeness.

Shapes: ``disk`` (path, content_hash, size_bytes, ...), ``known`` (entity_id, path, content_hash, size_bytes,
fingerprint: the last version of each entity).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K


def classify_paths(disk: DataFrame, known: DataFrame, fold: bool = False) -> DataFrame:
    """(path, state): new, missing, changed or unchanged, by a full outer join of paths.

    fold: the workspace takes no heed of case, so a path in another case is known. Its content hasn't been compared under the
    exact name, so it counts as changed; see :func:`moves_copies_mints` for what becomes of it.
    """
    d = disk.select("path", F.col("content_hash").alias("_new"))
    k = known.select("path", F.col("content_hash").alias("_old")).dropDuplicates(["path"])
    if fold:
        d, k = d.withColumn("_key", F.lower("path")), k.select(F.lower("path").alias("_key"), F.col("path").alias("_known"), "_old").dropDuplicates(["_key"])
        same = (F.col("_old") == F.col("_new")) & (F.col("path") == F.col("_known"))
        state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(same, "unchanged").otherwise("changed")
        return d.join(k, "_key", "full_outer").select(F.coalesce("path", "_known").alias("path"), state.alias("state"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return d.join(k, "path", "full_outer").select("path", state.alias("state"))


def split_by_hash(disk: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inherited, survivors): files whose content the snapshot has, and the others."""
    return disk.join(snapshot.select("content_hash").distinct(), "content_hash", "left_semi"), disk.join(snapshot.select("content_hash").distinct(), "content_hash", "left_anti")


def inherit_bijective(disk: DataFrame, entities: DataFrame) -> DataFrame:
    """The k-th path of a hash takes the k-th entity of that hash.

    (path, content_hash, ordinal, entity_id, minted): a path past the last entity of its hash has no entity and is to be
    minted from the first one's entry. Paths and entities are counted in their binary order.
    """
    at = lambda *o: F.row_number().over(Window.partitionBy("content_hash").orderBy(*o))
    d = disk.select("path", "content_hash", at("path").alias("ordinal"))
    e = entities.select("entity_id", "content_hash", at("entity_id").alias("ordinal"))
    first = e.groupBy("content_hash").agg(F.min("entity_id").alias("template"))
    return d.join(first, "content_hash").join(e, ["content_hash", "ordinal"], "left").select("path", "content_hash", "ordinal", "entity_id", "template", F.col("entity_id").isNull().alias("minted"))


def moves_copies_mints(disk: DataFrame, known: DataFrame, fold: bool = False) -> DataFrame:
    """(path, content_hash, action, entity_id, source_path) for paths that aren't known, as if they came in the order of paths.

    Only the first entity of a hash (the least id) counts. If its own path is gone, the hash's first new path
    carries it (move); it then stands on disk again, so any other new path is a copy of it, as all are if its path is still there. Other
    entities of the hash stay where they are. The first path of an unknown hash is minted, and later ones copy that
    (entity null, source_path the minted one).
    fold: the workspace takes no heed of case; a path that differs from the first entity's in case alone carries it, wherever it comes.
    """
    name = (lambda c: F.lower(c)) if fold else (lambda c: F.col(c))
    new = disk.join(known.select("path").distinct(), "path", "left_anti")
    first = known.groupBy("content_hash").agg(F.min_by(F.struct("entity_id", "path"), "entity_id").alias("first")).select("content_hash", F.col("first.entity_id").alias("source"), F.col("first.path").alias("_own"))
    there = disk.select(name("path").alias("_at")).distinct()
    first = first.withColumn("_at", name("_own")).join(there.withColumn("_there", F.lit(True)), "_at", "left").drop("_at")
    w = Window.partitionBy("content_hash")
    rows = new.select("path", "content_hash", F.row_number().over(w.orderBy("path")).alias("rn")).join(first, "content_hash", "left")
    moved = F.col("source").isNotNull() & F.col("_there").isNull() & (F.col("rn") == 1)
    if fold:
        moved |= F.coalesce(F.lower("path") == F.lower("_own"), F.lit(False))
    action = F.when(moved, "move").when(F.col("source").isNotNull() | (F.col("rn") > 1), "copy").otherwise("mint")
    minted = F.min(F.when(F.col("rn") == 1, F.col("path"))).over(w)
    rows = rows.withColumn("_minted", minted)
    return rows.select("path", "content_hash", action.alias("action"), F.col("source").alias("entity_id"), F.when(action == "copy", F.when(F.col("source").isNull(), F.col("_minted")).otherwise(F.col("_own"))).alias("source_path"))


def size_band_pairs(new: DataFrame, candidates: DataFrame, band: float = K.SIZE_BAND, size: str = "size_bytes") -> DataFrame:
    """Pairs whose candidate's size is within ``band`` of the new one's.

    Sizes are binned on a log scale as wide as the band, so a match is in the same bin or one next to it: an
    equi-join with three probes a row instead of a comparison of all pairs.
    """
    width = math.log((1 + band) / (1 - band))
    bin_of = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / width).cast("long")
    left = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])
    left = left.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bin_of(F.col(f"new_{size}")) + d)))
    right = candidates.withColumn("_bin", bin_of(F.col(size)))
    lo, hi = F.col(f"new_{size}") * (1 - band), F.col(f"new_{size}") * (1 + band)
    return left.join(right, "_bin").where((F.col(size) >= lo) & (F.col(size) <= hi)).drop("_bin")


def fuzzy_matches(new: DataFrame, missing: DataFrame, match_from: float = K.MATCH_FROM, review_from: float = K.REVIEW_FROM) -> DataFrame:
    """(path, entity_id, distance, confidence, outcome): the likeliest missing entity for each new file, where there is one.

    new: path, size_bytes, fingerprint; missing: entity_id, size_bytes, fingerprint. Both sides need a fingerprint
    and enough bytes. A tie at the top never matches; it is for review.
    """
    top = likeliest(scored_pairs(new, missing))
    outcome = F.when((F.col("confidence") >= match_from) & (F.col("tied") == 1), "match").when(F.col("confidence") >= review_from, "review").otherwise("none")
    return top.select("path", "entity_id", "distance", "confidence", outcome.alias("outcome"))


def scored_pairs(new: DataFrame, missing: DataFrame) -> DataFrame:
    """(path, entity_id, distance, confidence) of all pairs of new and missing files in the size band."""
    enough = f"size_bytes >= {K.EVIDENCE_BYTES} AND fingerprint IS NOT NULL"
    pairs = size_band_pairs(new.where(enough).select("path", "size_bytes", "fingerprint"), missing.where(enough).select("entity_id", "size_bytes", "fingerprint"))
    d = pairs.withColumn("distance", K.distance_udf("new_fingerprint", "fingerprint"))
    return d.select(F.col("new_path").alias("path"), "entity_id", "distance", C.confidence(F.col("distance"), C.most_distance(F.col("new_size_bytes"), F.col("size_bytes"))).alias("confidence"))


def likeliest(scored: DataFrame) -> DataFrame:
    """(path, entity_id, distance, confidence, tied): each path's likeliest entity, the least id of equals, and how many are equal. One pass over the pairs."""
    level = scored.groupBy("path", "confidence").agg(F.count("*").alias("tied"), F.min("entity_id").alias("entity_id"), F.min_by("distance", "entity_id").alias("distance"))
    top = level.groupBy("path").agg(F.max("confidence").alias("confidence"), F.max_by(F.struct("entity_id", "distance", "tied"), "confidence").alias("top"))
    return top.select("path", "top.entity_id", "top.distance", "confidence", "top.tied")


def bag_jaccard(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds jaccard of the two texts' token bags: the sum of least over the sum of greatest counts. Rows need an ``id``.

    Both sides' tokens go through one shuffle and are counted together, so no join of the two is needed.
    """
    side = lambda c, x, y: F.transform(C.source_tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    tokens = pairs.select("id", F.inline(F.concat(side(a, 1, 0), side(b, 0, 1))))
    both = tokens.groupBy("id", "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = both.groupBy("id").agg(F.sum(F.least("x", "y")).alias("_least"), F.sum(F.greatest("x", "y")).alias("_most"))
    return pairs.join(sums, "id", "left").withColumn("jaccard", F.coalesce(F.col("_least") / F.col("_most"), F.lit(1.0))).drop("_least", "_most")


def longest_prefix(paths: DataFrame, bindings: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """The binding of the longest folder that holds each path (itself or above it): an equi-join on the path's ancestors."""
    clean = F.regexp_replace(F.col(path), "/+$", "")
    depth = F.size(F.split(clean, "/"))
    above = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split(clean, "/"), F.lit(1), i), "/"))
    keyed = paths.withColumn("_above", F.explode(above))
    bound = bindings.withColumn("_above", F.regexp_replace(F.col(prefix), "/+$", ""))
    w = Window.partitionBy(path).orderBy(F.desc(F.length("_above")), prefix)
    return keyed.join(bound, "_above").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_above")


def resolve_scope(paths: DataFrame, bindings: DataFrame, remotes: DataFrame, unsorted: str = "__unsorted__") -> DataFrame:
    """Adds project_id: the path's own environment's project, the longest bound folder's, the one with the same remote, or ``unsorted``.

    paths: path, env_project, remote; bindings: prefix, project_id; remotes: remote, project_id.
    """
    bound = longest_prefix(paths.select("path").distinct(), bindings).select("path", F.col("project_id").alias("_bound"))
    by_remote = remotes.where("remote <> ''").groupBy("remote").agg(F.min("project_id").alias("_remote"))
    rows = paths.join(bound, "path", "left").join(by_remote, "remote", "left")
    own = F.when(F.col("env_project") != "", F.col("env_project"))
    return rows.withColumn("project_id", F.coalesce(own, "_bound", "_remote", F.lit(unsorted))).drop("_bound", "_remote")
