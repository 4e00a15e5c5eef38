"""Entity resolution of a batch of observed files, the repair sweep, reviews and pruning.

The ladder (the first step that applies wins): 1 nothing changed; 2 a known path with new content; 3 content whose first entity's
path is gone (a move); 4 likeness to a file that is gone; 5 a new entity, as a copy
of a known one or on its own. Steps 1, 2, 3 and 5 are joins. Step 4 depends on the order of files, since a carried
entity is no longer missing for later ones: pairs are scored by a band join, and turns are taken by rounds of proposals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K
from strataquery.operators import matching as M
from strataquery.operators.versions import latest, ties
from strataquery.schemas import TENANCY
from strataquery.session import cut_lineage

CARRIED = ["title", "description", "concepts", "embedding", "described_at", "describe_model", "describe_status"]


def _best(scored: DataFrame, held: DataFrame | None) -> DataFrame:
    """Each path's likeliest entity that no earlier path holds."""
    return M.likeliest(scored if held is None else scored.join(held, "entity_id", "left").where("holder IS NULL OR holder >= path"))


def greedy(scored: DataFrame, match_from: float = K.MATCH_FROM, review_from: float = K.REVIEW_FROM) -> DataFrame:
    """(path, entity_id, distance, confidence, outcome): as if each path in turn took its likeliest entity that is left.

    Taking turns is a stable matching in which every entity prefers the earlier path, so it is reached by rounds of
    proposals, all paths at once: a path proposes to its best entity that no earlier path holds, an entity keeps its earliest
    suitor. What a path may have only shrinks, so the rounds end; a tie at the top proposes nothing until it is broken.
    """
    scored = cut_lineage(scored)
    held, state = None, None
    while True:
        best = _best(scored, held)
        held = cut_lineage(best.where((F.col("confidence") >= match_from) & (F.col("tied") == 1)).groupBy("entity_id").agg(F.min("path").alias("holder")))
        row = held.agg(F.count("*"), F.bit_xor(F.xxhash64("entity_id", "holder"))).first()
        if (row[0], row[1]) == state:
            break
        state = row[0], row[1]
    best = _best(scored, held).join(held.withColumnRenamed("entity_id", "_held"), (F.col("entity_id") == F.col("_held")) & (F.col("path") == F.col("holder")), "left")
    outcome = F.when(F.col("_held").isNotNull(), "match").otherwise("review")
    return best.where(F.col("confidence") >= review_from).select("path", "entity_id", "distance", "confidence", outcome.alias("outcome"))


Fuzzy = Callable[[DataFrame, DataFrame], DataFrame]
"""Step 4: (new files with fingerprints, missing entities) -> (path, entity_id, distance, confidence, outcome match or review)."""


def by_likeness(match_from: float = K.MATCH_FROM, review_from: float = K.REVIEW_FROM) -> Fuzzy:
    """The step by fingerprints."""
    return lambda new, missing: greedy(M.scored_pairs(new, missing), match_from, review_from)


def resolve(observed: DataFrame, known: DataFrame, fuzzy: Fuzzy | None = None, fold: bool = False) -> DataFrame:
    """(path, step, action, entity_id, confidence, source_path): what becomes of each path, gone ones (action missing) included.

    observed: path, content_hash, size_bytes and (for step 4) content; known: last versions (entity_id, path,
    content_hash, size_bytes, fingerprint). fuzzy: step 4, left out if None. fold: the workspace takes no heed of case.
    entity_id is the copied one for copies, null for mints; source_path is the copied one's path.
    """
    state = M.classify_paths(observed, known)
    own = known.select("path", "entity_id").groupBy("path").agg(F.min("entity_id").alias("entity_id"))
    mcm = M.moves_copies_mints(observed, known, fold)
    seen = state.where("state <> 'new'").join(own, "path", "left")
    if fold:
        # a path whose entity goes on under another case isn't missing
        again = mcm.where("action = 'move'").select(F.col("entity_id"))
        seen = seen.where("state <> 'missing'").unionByName(seen.where("state = 'missing'").join(again, "entity_id", "left_anti").select(*seen.columns))
    steps = seen.select(
        "path",
        F.when(F.col("state") == "unchanged", 1).when(F.col("state") == "changed", 2).otherwise(0).alias("step"),
        F.when(F.col("state") == "unchanged", "unchanged").when(F.col("state") == "changed", "edit").otherwise("missing").alias("action"),
        "entity_id",
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("source_path"),
    )
    exact = mcm.where("action <> 'mint'").select("path", F.when(F.col("action") == "move", 3).otherwise(5).alias("step"), "action", "entity_id", F.lit(1.0).alias("confidence"), "source_path")
    fresh = mcm.where("action = 'mint'")
    none = F.lit(None).cast("string").alias("source_path")
    if fuzzy is None or "content" not in observed.columns:
        return steps.unionByName(exact).unionByName(fresh.select("path", F.lit(5).alias("step"), "action", F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("double").alias("confidence"), none))
    moved = mcm.where("action = 'move'").select("entity_id")
    gone = known.join(observed.select("path").distinct(), "path", "left_anti").join(moved, "entity_id", "left_anti")
    new = observed.join(fresh.select("path"), "path", "left_semi").withColumn("fingerprint", K.fingerprint_udf(F.col("content").cast("binary")))
    near = fuzzy(new, gone)
    decided = fresh.select("path").join(near, "path", "left")
    rest = decided.select(
        "path",
        F.when(F.col("outcome") == "match", 4).otherwise(5).alias("step"),
        F.when(F.col("outcome") == "match", "carry").when(F.col("outcome") == "review", "review").otherwise("mint").alias("action"),
        F.when(F.col("outcome").isNotNull(), F.col("entity_id")).alias("entity_id"),
        "confidence",
        none,
    )
    return steps.unionByName(exact).unionByName(rest)


def carried_versions(carried: DataFrame, known: DataFrame) -> DataFrame:
    """New version rows for moved or carried files (path, entity_id, confidence, content_hash, size_bytes): the description goes along, the embedding's model doesn't."""
    old = known.select("entity_id", (F.col("seq") + 1).alias("seq"), *CARRIED)
    return carried.join(old, "entity_id").withColumns({"filename": C.filename(F.col("path")), "ext": C.extension(F.col("path")), "embed_model": F.lit(None).cast("string")})


def copies(copied: DataFrame, identities: DataFrame) -> DataFrame:
    """Identity rows of copies (entity_id, source, content_hash, created_at): the provenance edge and the hash at the fork."""
    return copied.select("entity_id", F.lit("file").alias("kind"), "created_at", F.col("source").alias("derived_from"), F.col("content_hash").alias("fork_content_hash")).join(identities.select("entity_id"), "entity_id", "left_anti")


# ---- repair -----------------------------------------------------------------------------------


def orphan_identities(identities: DataFrame, versions: DataFrame, key: str = "entity_id") -> DataFrame:
    return identities.join(versions.select(key), key, "left_anti")


def orphan_versions(identities: DataFrame, versions: DataFrame, key: str = "entity_id") -> DataFrame:
    return versions.join(identities.select(key), key, "left_anti")


def repair_duplicate_seq(versions: DataFrame) -> DataFrame:
    """Where the last seq stands more than once, the newest row stays last and the others get no place in the view."""
    return latest(versions)


def duplicate_path_survivors(latest_rows: DataFrame) -> DataFrame:
    """Adds survivor: of entities at one path, the one observed last (then the least id) stays."""
    w = Window.partitionBy("path").orderBy(F.desc("observed_at"), "entity_id")
    n = F.count("*").over(Window.partitionBy("path"))
    return latest_rows.withColumn("copies", n).where("copies > 1").withColumn("survivor", F.row_number().over(w) == 1)


def stale_touches(identities: DataFrame, versions: DataFrame) -> DataFrame:
    """(entity_id, last_update_date, newest) where an identity's date is behind its newest version's."""
    newest = versions.groupBy("entity_id").agg(F.max("observed_at").alias("newest"))
    return identities.select("entity_id", "last_update_date").join(newest, "entity_id").where("newest > last_update_date")


def repair_sweep(identities: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """The five checks in order, each on what the ones before leave; running it again on the result finds nothing.

    Keys: orphan_identities, orphan_versions, duplicate_seqs, stale, duplicate_paths, and the repaired
    identities and versions.
    """
    from strataquery.operators.versions import duplicate_seqs

    empty, loose = orphan_identities(identities, versions), orphan_versions(identities, versions)
    kept_ids, kept = identities.join(versions.select("entity_id").distinct(), "entity_id", "left_semi"), versions.join(identities.select("entity_id"), "entity_id", "left_semi")
    twice = duplicate_seqs(kept)
    w = Window.partitionBy("entity_id", "seq").orderBy(*ties(kept))
    single = kept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    stale = stale_touches(kept_ids, single)
    fixed = kept_ids.join(single.groupBy("entity_id").agg(F.max("observed_at").alias("_newest")), "entity_id").withColumn("last_update_date", F.greatest("last_update_date", "_newest")).drop("_newest")
    paths = duplicate_path_survivors(latest(single))
    losers = paths.where("NOT survivor").select("entity_id")
    return {
        "orphan_identities": empty, "orphan_versions": loose, "duplicate_seqs": twice, "stale": stale, "duplicate_paths": paths,
        "identities": fixed.join(losers, "entity_id", "left_anti"), "versions": single.join(losers, "entity_id", "left_anti"),
    }


# ---- reviews and pruning ------------------------------------------------------------------------


def review_id(candidate: str = "candidate", path: str = "new_path") -> F.Column:
    return F.sha2(F.concat_ws("|", candidate, path), 256)


def upsert_reviews(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (candidate, new_path): the newest; of equals the new one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("candidate", "new_path").orderBy(F.desc("_new"), F.desc("created_at"), F.desc("content_hash"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def accept_reviews(reviews: DataFrame, decisions: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """What decisions on reviews lead to: outcomes (id, outcome), carried version rows, and retired entities (entity_id).

    reviews: id, candidate, new_path, content_hash, size_bytes, confidence, minted_id; decisions: id, decision (accept, reject or
    skip); known: the tenant's last versions. An accepted review is stale if its candidate isn't in the tenant any more or the
    placeholder that was minted for the path has other content by now. Else the candidate goes on at the path,
    pending, and the placeholder retires, so that one entity alone is there. Skipped reviews stay as they are.
    """
    last = known.select("entity_id", F.col("content_hash").alias("_hash"))
    mine = last.select(F.col("entity_id").alias("candidate"), F.lit(True).alias("_there"))
    minted = last.select(F.col("entity_id").alias("minted_id"), F.col("_hash").alias("_now"))
    rows = reviews.join(decisions.select("id", "decision"), "id").join(mine, "candidate", "left").join(minted, "minted_id", "left")
    stale = F.col("_there").isNull() | F.coalesce(F.col("_now") != F.col("content_hash"), F.lit(False))
    outcome = F.when(F.col("decision") == "accept", F.when(stale, "stale").otherwise("carried")).when(F.col("decision") == "reject", "rejected").otherwise("skipped")
    rows = rows.withColumn("outcome", outcome)
    done = rows.where("outcome = 'carried'")
    moved = done.select(F.col("candidate").alias("entity_id"), F.col("new_path").alias("path"), "confidence", "content_hash", "size_bytes")
    retired = done.where("_now IS NOT NULL AND minted_id <> candidate").select(F.col("minted_id").alias("entity_id")).distinct()
    return {"outcomes": rows.select("id", "outcome"), "carried": carried_versions(moved, known).withColumn("describe_status", F.lit("pending")), "retired": retired}


def prune_candidates(latest_rows: DataFrame, on_disk: DataFrame, now: str, grace_days: int = 30) -> DataFrame:
    """Entities whose path isn't on disk and that weren't seen within the grace; a date that can't be read is old enough."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(F.col("observed_at").cast("string")))
    gone = latest_rows.join(on_disk.select("path").distinct(), "path", "left_anti")
    return gone.where(F.coalesce(age, F.lit(2**62)) > grace_days * 86_400).orderBy("path")


def confirm_prune(chosen: DataFrame, latest_rows: DataFrame, on_disk: DataFrame, now: str, grace_days: int = 30) -> DataFrame:
    """Of the entities chosen some time ago, those that are still candidates by what is known and on disk now."""
    return prune_candidates(latest_rows, on_disk, now, grace_days).join(chosen.select("entity_id").distinct(), "entity_id", "left_semi")


def delete_entities(tables: list[DataFrame], gone: DataFrame, tenancy: tuple[str, str, str] | None = None) -> list[DataFrame]:
    """Each table without the entities of ``gone``: plain parquet is rewritten, so the caller writes the results anew.

    tenancy: rows of other tenants stay, whatever their entity.
    """
    ids = gone.select("entity_id").distinct()
    if tenancy is None:
        return [t.join(ids, "entity_id", "left_anti") for t in tables]
    own = ids.withColumns({c: F.lit(v) for c, v in zip(TENANCY, tenancy, strict=True)})
    return [t.join(own, ["entity_id", *TENANCY], "left_anti") for t in tables]
