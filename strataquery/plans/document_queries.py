"""Queries over ``documents``, ``embeddings``, ``benchmark`` and ``labels``, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K
from strataquery.operators import load as L
from strataquery.operators import matching as M
from strataquery.operators import projection
from strataquery.operators import recall as R
from strataquery.operators import resolve
from strataquery.session import table

TERM = "idiot"
FIELDS = ["title", "body", "concepts"]


def searchable(spark, d):
    """Documents as hits: the title is the text's start, the concepts are language and source."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.left("text", F.lit(200)).alias("title"), F.col("text").alias("body"), F.concat_ws(",", "lang", "source").alias("concepts"))


def _vector(spark, d):
    """The query's vector: that of the smallest id."""
    r = table(spark, d, "embeddings").where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()
    return list(r.embedding) if r else [0.0]


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") != 5, F.col("label").cast("string")).alias("embed_model"))


def lexical_search_ranked(spark, d):
    return R.lexical_arm(searchable(spark, d), TERM, FIELDS, 20).select("id", F.col("priority").cast("long").alias("priority"))


def lexical_search_escaped_meta(spark, d):
    """Per cent signs are looked for as such."""
    rows = searchable(spark, d)
    pattern = "%" + C.like_literal("%%% ") + "%"
    return rows.where(F.expr(f"body ILIKE '{pattern}' ESCAPE '!'")).select("id")


def vector_top_k(spark, d):
    usable, _ = R.vector_arm(_vectors(spark, d), _vector(spark, d), 20)
    return usable.select("id", F.round("score", 6).alias("score"))


def vector_model_partition(spark, d):
    usable, out = R.vector_arm(_vectors(spark, d), _vector(spark, d), 20, active_model="3")
    return usable.select("id", F.lit(True).alias("usable")).unionByName(out.select("id", F.lit(False).alias("usable")))


def hybrid_rrf(spark, d):
    """Both arms over documents that have a vector (doc_id = vec_id); the vector arm goes first."""
    rows = searchable(spark, d).join(_vectors(spark, d), "id")
    usable, _ = R.vector_arm(rows, _vector(spark, d), 20)
    vector = R.ranked(usable, 0, "id", F.desc("score"))
    lexical = R.ranked(R.lexical_arm(rows, TERM, FIELDS, 20), 1, "id", "priority")
    return R.fuse([vector, lexical], ["concepts"], 20).select("id", "concepts", F.round("rrf", 9).alias("rrf"))


def hydrated_scores(spark, d):
    """Scored vectors with their documents; those without one are dropped."""
    usable, _ = R.vector_arm(_vectors(spark, d), _vector(spark, d), 20)
    return usable.join(searchable(spark, d).select("id", "concepts"), "id").select("id", "concepts", F.round("score", 6).alias("score"))


def valid_vectors(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(C.is_vector(F.col("embedding"), 64)).alias("valid"), F.count_if(C.is_vector(F.col("embedding"), 768)).alias("wide"))


def _hashed(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", C.sha256_hex(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


def content_hash_duplicates(spark, d):
    return _hashed(spark, d).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def hash_to_entities(spark, d):
    """Each hash's entities as rows of a bounded size, with how many it has and the last of them."""
    h = _hashed(spark, d)
    g = h.groupBy("content_hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_entity"))
    return h.select("content_hash", F.col("doc_id").alias("entity")).join(g, "content_hash")


def _id(c="doc_id"):
    return F.lpad(F.col(c).cast("string"), 12, "0")


def _moved(spark, d):
    """Documents known at k/<id> and found at k/<twice the id>."""
    h = _hashed(spark, d)
    known = h.select(F.concat(F.lit("e"), _id()).alias("entity_id"), F.concat(F.lit("k/"), _id()).alias("path"), "content_hash", "size_bytes")
    disk = h.select(F.concat(F.lit("k/"), F.lpad((2 * F.col("doc_id")).cast("string"), 12, "0")).alias("path"), "content_hash", "size_bytes")
    return disk, known


def classify_paths(spark, d):
    return M.classify_paths(*_moved(spark, d))


def move_copy_mint_classification(spark, d):
    return M.moves_copies_mints(*_moved(spark, d)).select("path", "action", "entity_id", "source_path")


def _recased(spark, d):
    """As _moved, where every third path comes back in upper case instead."""
    h = _hashed(spark, d)
    known = h.select(F.concat(F.lit("e"), _id()).alias("entity_id"), F.concat(F.lit("k/"), _id()).alias("path"), "content_hash", "size_bytes")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("K/"), _id())).otherwise(F.concat(F.lit("k/"), F.lpad((F.col("doc_id") + 7).cast("string"), 12, "0")))
    return h.select(path.alias("path"), "content_hash", "size_bytes").where(F.col("doc_id") % 5 != 4), known


def moves_without_case(spark, d):
    """The same classification where paths take no heed of case."""
    return M.moves_copies_mints(*_recased(spark, d), fold=True).select("path", "action", "entity_id", "source_path")


def resolve_exact_paths(spark, d):
    """The ladder without likeness, with new contents beside what is known."""
    disk, known = _moved(spark, d)
    b = table(spark, d, "benchmark").select(F.explode(F.array(F.lit("n/"), F.lit("m/"))).alias("at"), "item_id", "text")
    found = disk.unionByName(b.select(F.concat("at", _id("item_id")).alias("path"), C.sha256_hex(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes")))
    return resolve.resolve(found, known).select("path", F.col("step").cast("long").alias("step"), "action", "entity_id", "source_path")


def review_decisions(spark, d):
    """Each label is a review of its document, decided by its quality; the placeholder is the document's double."""
    h = _hashed(spark, d)
    known = h.select(F.concat(F.lit("e"), _id()).alias("entity_id"), "content_hash", F.col("doc_id").alias("seq"), *[F.lit(None).cast("string").alias(c) for c in resolve.CARRIED])
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x")).join(h.select("doc_id", "content_hash", "size_bytes"), "doc_id")
    reviews = labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("e"), _id()).alias("candidate"), F.lit("p").alias("new_path"), "content_hash", "size_bytes", F.lit(0.6).alias("confidence"), F.concat(F.lit("e"), F.lpad((2 * F.col("doc_id")).cast("string"), 12, "0")).alias("minted_id"))
    decisions = labels.select(F.col("doc_id").alias("id"), F.when(F.col("x") == 1, "skip").when(F.col("q") == 1, "accept").otherwise("reject").alias("decision"))
    got = resolve.accept_reviews(reviews, decisions, known)
    rows = got["outcomes"].select(F.col("id").cast("string").alias("id"), "outcome")
    carried = got["carried"].select(F.col("entity_id").alias("id"), F.concat(F.lit("seq "), F.col("seq").cast("string")).alias("outcome"))
    return rows.unionByName(carried).unionByName(got["retired"].select(F.col("entity_id").alias("id"), F.lit("retired").alias("outcome")))


def provenance_edges(spark, d):
    """Every document with its edge; those with a toxic label derive from the one before."""
    edges = table(spark, d, "labels").where("toxic = 1").select(_id().alias("entity_id"), F.lpad((F.col("doc_id") - 1).cast("string"), 12, "0").alias("from_entity"), F.lit("f").alias("fork_content_hash")).distinct()
    return projection.provenance(table(spark, d, "documents").select(_id().alias("entity_id")), edges)


def snapshot_inherits(spark, d):
    """What a snapshot of the labelled documents gives to all files; entities of good quality are there already."""
    disk, entities = _inherit(spark, d)
    told = {"title": F.concat(F.lit("t "), "entity_id"), "description": F.lit("d"), "concepts": F.array(F.lit("c")), "describe_model": F.lit("m"), "described_at": F.lit("")}
    existing = table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("e"), _id()).alias("entity_id")).distinct()
    out = projection.inherit(disk, entities.withColumns(told), existing, "now")
    return out.select("path", "entity_id", "title", "concepts", "minted", F.col("seq").cast("long").alias("seq"), "describe_status", "filename")


def _inherit(spark, d):
    h = _hashed(spark, d)
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    return h.select(F.concat(F.lit("k/"), _id()).alias("path"), "content_hash"), h.join(labelled, "doc_id", "left_semi").select(F.concat(F.lit("e"), _id()).alias("entity_id"), "content_hash")


def bijective_inherit(spark, d):
    return M.inherit_bijective(*_inherit(spark, d)).select("path", "entity_id", "minted", "template")


def inherit_split_semi_anti(spark, d):
    disk, snapshot = _inherit(spark, d)
    a, b = M.split_by_hash(disk, snapshot)
    return a.select("path", F.lit(True).alias("inherited")).unionByName(b.select("path", F.lit(False).alias("inherited")))


def _files(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", "source", F.concat(F.lit("k/"), _id()).alias("path"), F.col("n_chars").alias("size_bytes"), C.bucket(F.lit("txt"), F.col("n_chars"), C.has_nul(F.col("text").cast("binary"))).alias("bucket"))


def bucket_counts(spark, d):
    return L.bucket_counts(_files(spark, d))


def cost_estimate(spark, d):
    return L.cost_estimate(_files(spark, d))


def resume_states(spark, d):
    """Documents with a label were described (of another content if toxic) or skipped (of low quality)."""
    h = _hashed(spark, d).withColumn("path", F.concat(F.lit("k/"), _id()))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    last = h.join(labels, "doc_id").select("path", F.when(F.col("x") == 1, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("q") == 1, "described").otherwise("failed").alias("describe_status"))
    return L.resume_states(h.select("path", "content_hash"), last).select("path", "resume")


def pack_batches(spark, d):
    """Each source's batch files are packed in order of paths."""
    return L.pack(_files(spark, d).where("bucket = 'batch'"), "source").select("source", "path", "batch")


def bag_jaccard_pairs(spark, d):
    """Each document and the next one of its source."""
    t = table(spark, d, "documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    pairs = t.select(F.col("doc_id").alias("id"), F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b IS NOT NULL")
    return M.bag_jaccard(pairs).select("id", F.round("jaccard", 9).alias("jaccard"), (F.col("jaccard") >= 0.85).alias("cosmetic"))


def _sized(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.char_length("text").cast("long").alias("size_bytes"))
    return b, table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size_bytes"))


def size_band_join(spark, d):
    """For each benchmark text, the documents within a fifth of its size."""
    pairs = M.size_band_pairs(*_sized(spark, d))
    return pairs.groupBy(F.col("new_id").alias("id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _prints(spark, d, name, key):
    t = table(spark, d, name)
    return t.select(F.concat(F.lit(name[0]), F.lpad(F.col(key).cast("string"), 12, "0")).alias("key"), F.octet_length("text").cast("long").alias("size_bytes"), K.fingerprint_udf("text").alias("fingerprint"))


def fingerprint_near_dups(spark, d):
    """The likeliest document for each benchmark text."""
    new = _prints(spark, d, "benchmark", "item_id").withColumnRenamed("key", "path")
    return M.fuzzy_matches(new, _prints(spark, d, "documents", "doc_id").withColumnRenamed("key", "entity_id"))


def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", K.fingerprint_udf("text").alias("fingerprint"))


def resolve_paths(spark, d):
    """The ladder: documents are known, and half of their paths are gone; the benchmark's texts are found beside the rest."""
    disk, known = _moved(spark, d)
    found = disk.withColumn("content", F.lit(None).cast("string")).unionByName(table(spark, d, "benchmark").select(F.concat(F.lit("n/"), _id("item_id")).alias("path"), C.sha256_hex(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content")))
    prints = _prints(spark, d, "documents", "doc_id").select(F.concat(F.lit("e"), F.substring("key", 2, 12)).alias("entity_id"), "fingerprint")
    return resolve.resolve(found, known.join(prints, "entity_id"), resolve.by_likeness()).select("path", F.col("step").cast("long").alias("step"), "action", "entity_id")


def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.sha256_hex(C.redact(F.col("text"))).alias("redacted"))


def lineage_depth(spark, d):
    """A copy derives from the copy before it."""
    from strataquery.operators.versions import lineage_depth as follow

    w = Window.partitionBy("content_hash").orderBy("doc_id")
    edges = _hashed(spark, d).select(_id().alias("entity_id"), F.coalesce(F.lag(_id()).over(w), F.lit("")).alias("derived_from"))
    return follow(edges)


def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", C.estimate_tokens(F.col("n_chars")).alias("tokens"))


def clamped_titles(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", C.clamp_title(F.col("text"), F.col("source")).alias("title"), F.array_join(C.clamp_concepts(F.array("source", F.lit(" A "), F.lit(""), "lang", F.lit("b"), F.lit("c"), F.lit("d"))), ",").alias("concepts"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_search_ranked, lexical_search_escaped_meta, vector_top_k, vector_model_partition, hybrid_rrf, hydrated_scores, valid_vectors, content_hash_duplicates, hash_to_entities,
        classify_paths, move_copy_mint_classification, moves_without_case, resolve_exact_paths, review_decisions, provenance_edges, snapshot_inherits, bijective_inherit, inherit_split_semi_anti, bucket_counts, cost_estimate, resume_states, pack_batches, bag_jaccard_pairs,
        size_band_join, fingerprint_near_dups, fingerprints, resolve_paths, redact_text, lineage_depth, token_estimates, clamped_titles,
    )
}

_S = "s AS (SELECT doc_id AS id, left(text, 200) AS title, text AS body, concat_ws(',', lang, source) AS concepts FROM documents)"
_PRIO = f"CASE WHEN contains(lower(title), '{TERM}') THEN 0 WHEN contains(lower(body), '{TERM}') THEN 1 ELSE 2 END"
_HIT = f"(contains(lower(title), '{TERM}') OR contains(lower(body), '{TERM}') OR contains(lower(concepts), '{TERM}'))"
_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)"
_E = "e AS (SELECT vec_id AS id, label, greatest(0, least(1, (1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv)) / 2)) AS score FROM embeddings, q WHERE len(embedding) > 0)"
_H = "h AS (SELECT doc_id, source, sha256(text) AS content_hash, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS pid, lpad(CAST(2 * doc_id AS VARCHAR), 12, '0') AS pid2 FROM documents)"
_K = _H + ", k AS (SELECT 'e' || pid AS entity_id, 'k/' || pid AS path, content_hash FROM h), dk AS (SELECT 'k/' || pid2 AS path, content_hash FROM h)"
_FIRST = "first_of AS (SELECT content_hash, entity_id, path FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY entity_id) AS o FROM k) WHERE o = 1)"
_TOK = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}A-Za-z0-9_]+"
_BUCKET = "CASE WHEN n_chars > 262144 THEN 'skip-too-large' WHEN contains(left(text, 8192), chr(0)) THEN 'skip-binary' WHEN n_chars <= 4096 THEN 'batch' ELSE 'solo' END"
_FILES = f"f AS (SELECT doc_id, n_chars AS size_bytes, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tok, {_BUCKET} AS bucket FROM documents)"
ORACLE_SQL = {
    "lexical_search_ranked": f"WITH {_S} SELECT id, CAST({_PRIO} AS BIGINT) AS priority FROM s WHERE {_HIT} ORDER BY priority, id LIMIT 20",
    "lexical_search_escaped_meta": "SELECT doc_id AS id FROM documents WHERE contains(text, '%%% ')",
    "vector_top_k": f"WITH {_Q}, {_E} SELECT id, round(score, 6) AS score FROM e ORDER BY e.score DESC, id LIMIT 60",
    "vector_model_partition": f"WITH {_Q}, {_E} SELECT id, label = 5 OR label = 3 AS usable FROM e ORDER BY score DESC, id LIMIT 60",
    "hybrid_rrf": f"""WITH {_S}, {_Q}, {_E}, j AS (SELECT s.*, e.score FROM s JOIN e USING (id)),
va AS (SELECT id, concepts, row_number() OVER (ORDER BY score DESC, id) AS r, 0 AS arm FROM j QUALIFY r <= 60),
la AS (SELECT id, concepts, row_number() OVER (ORDER BY {_PRIO}, id) AS r, 1 AS arm FROM j WHERE {_HIT} QUALIFY r <= 20)
SELECT id, arg_min(concepts, arm) AS concepts, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM (SELECT * FROM va UNION ALL SELECT * FROM la) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 20""",
    "hydrated_scores": f"WITH {_S}, {_Q}, {_E}, t AS (SELECT * FROM e ORDER BY score DESC, id LIMIT 60) SELECT t.id, concepts, round(score, 6) AS score FROM t JOIN s USING (id)",
    "valid_vectors": "SELECT count(*) AS n, CAST(count(*) FILTER (len(embedding) = 64) AS BIGINT) AS valid, CAST(count(*) FILTER (len(embedding) = 768) AS BIGINT) AS wide FROM embeddings",
    "content_hash_duplicates": f"WITH {_H} SELECT content_hash, count(*) AS n, min(doc_id) AS first_doc FROM h GROUP BY 1 HAVING count(*) > 1",
    "hash_to_entities": f"WITH {_H} SELECT content_hash, doc_id AS entity, count(*) OVER (PARTITION BY content_hash) AS n, max(doc_id) OVER (PARTITION BY content_hash) AS last_entity FROM h",
    "classify_paths": f"WITH {_K} SELECT coalesce(dk.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN dk.path IS NULL THEN 'missing' WHEN k.content_hash = dk.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM dk FULL JOIN k ON dk.path = k.path",
    # by the rules: only the first entity of a hash counts; it moves once, if its own path is gone
    "move_copy_mint_classification": f"""WITH {_K}, {_FIRST},
n AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS rn FROM dk WHERE path NOT IN (SELECT path FROM k))
SELECT n.path, CASE WHEN e.entity_id IS NULL THEN CASE WHEN rn = 1 THEN 'mint' ELSE 'copy' END WHEN e.path NOT IN (SELECT path FROM dk) AND rn = 1 THEN 'move' ELSE 'copy' END AS action, e.entity_id,
  CASE WHEN e.entity_id IS NOT NULL AND (rn > 1 OR e.path IN (SELECT path FROM dk)) THEN e.path WHEN e.entity_id IS NULL AND rn > 1 THEN (SELECT min(path) FROM n y WHERE y.content_hash = n.content_hash) END AS source_path
FROM n LEFT JOIN first_of e USING (content_hash)""",
    "moves_without_case": f"""WITH {_H}, k AS (SELECT 'e' || pid AS entity_id, 'k/' || pid AS path, content_hash FROM h), {_FIRST},
dk AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'K/' || pid ELSE 'k/' || lpad(CAST(doc_id + 7 AS VARCHAR), 12, '0') END AS path, content_hash FROM h WHERE doc_id % 5 <> 4),
n AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS rn FROM dk WHERE path NOT IN (SELECT path FROM k)),
x AS (SELECT n.*, e.entity_id, e.path AS own, lower(n.path) = lower(e.path) OR (rn = 1 AND lower(e.path) NOT IN (SELECT lower(path) FROM dk)) AS goes FROM n LEFT JOIN first_of e USING (content_hash))
SELECT path, CASE WHEN entity_id IS NULL AND rn = 1 THEN 'mint' WHEN entity_id IS NOT NULL AND goes THEN 'move' ELSE 'copy' END AS action, entity_id,
  CASE WHEN entity_id IS NULL AND rn > 1 THEN (SELECT min(path) FROM n y WHERE y.content_hash = x.content_hash) WHEN entity_id IS NOT NULL AND NOT goes THEN own END AS source_path FROM x""",
    "resolve_exact_paths": f"""WITH {_K}, {_FIRST}, b AS (SELECT folder || lpad(CAST(item_id AS VARCHAR), 12, '0') AS path, sha256(text) AS content_hash FROM benchmark, (VALUES ('n/'), ('m/')) a(folder)),
o AS (SELECT path, content_hash FROM dk UNION ALL SELECT path, content_hash FROM b),
own AS (SELECT path, min(entity_id) AS entity_id, min(content_hash) AS h FROM k GROUP BY 1),
n AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS rn FROM o WHERE path NOT IN (SELECT path FROM k)),
x AS (SELECT n.*, e.entity_id, e.path AS src, rn = 1 AND e.path NOT IN (SELECT path FROM o) AS goes FROM n LEFT JOIN first_of e USING (content_hash))
SELECT coalesce(o.path, own.path) AS path, CASE WHEN o.path IS NULL THEN 0 WHEN o.content_hash = own.h THEN 1 ELSE 2 END::BIGINT AS step,
  CASE WHEN o.path IS NULL THEN 'missing' WHEN o.content_hash = own.h THEN 'unchanged' ELSE 'edit' END AS action, own.entity_id, CAST(NULL AS VARCHAR) AS source_path
FROM own LEFT JOIN o ON o.path = own.path
UNION ALL
SELECT path, CASE WHEN entity_id IS NOT NULL AND goes THEN 3 ELSE 5 END, CASE WHEN entity_id IS NOT NULL AND goes THEN 'move' WHEN entity_id IS NULL AND rn = 1 THEN 'mint' ELSE 'copy' END, entity_id,
  CASE WHEN entity_id IS NULL AND rn > 1 THEN (SELECT min(path) FROM n y WHERE y.content_hash = x.content_hash) WHEN entity_id IS NOT NULL AND NOT goes THEN src END FROM x""",
    "review_decisions": f"""WITH {_H}, l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1),
r AS (SELECT h.doc_id, CASE WHEN x = 1 THEN 'skipped' WHEN q <> 1 THEN 'rejected' WHEN m.content_hash <> h.content_hash THEN 'stale' ELSE 'carried' END AS outcome, m.doc_id AS minted
  FROM l JOIN h USING (doc_id) LEFT JOIN h m ON m.doc_id = 2 * h.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS id, outcome FROM r
UNION ALL SELECT 'e' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), 'seq ' || CAST(doc_id + 1 AS VARCHAR) FROM r WHERE outcome = 'carried'
UNION ALL SELECT 'e' || lpad(CAST(minted AS VARCHAR), 12, '0'), 'retired' FROM r WHERE outcome = 'carried' AND minted <> doc_id""",
    "provenance_edges": f"WITH {_H} SELECT pid AS entity_id, CASE WHEN t THEN lpad(CAST(doc_id - 1 AS VARCHAR), 12, '0') ELSE '' END AS from_entity, CASE WHEN t THEN 'f' ELSE '' END AS fork_content_hash FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS t FROM h)",
    "snapshot_inherits": f"""WITH {_H}, dk AS (SELECT 'k/' || pid AS path, pid, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY pid) AS rn FROM h),
en AS (SELECT 'e' || pid AS entity_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY pid) AS rn FROM h WHERE doc_id IN (SELECT doc_id FROM labels)),
t AS (SELECT content_hash, min(entity_id) AS template FROM en GROUP BY 1)
SELECT path, en.entity_id, 't ' || coalesce(en.entity_id, template) AS title, '["c"]' AS concepts, en.entity_id IS NULL AS minted, CAST(0 AS BIGINT) AS seq, 'pending' AS describe_status, pid AS filename
FROM dk JOIN t USING (content_hash) LEFT JOIN en ON dk.content_hash = en.content_hash AND dk.rn = en.rn
WHERE en.entity_id IS NULL OR en.entity_id NOT IN (SELECT 'e' || lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM labels WHERE quality = 1)""",
    "pack_batches": f"""WITH RECURSIVE {_FILES}, g AS (SELECT source, 'k/' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS path, size_bytes AS b, tok, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS rn FROM documents d JOIN f ON d.doc_id = f.doc_id WHERE bucket = 'batch'),
r AS (SELECT source, path, rn, CAST(0 AS BIGINT) AS batch, 1 AS n, b AS size, tok AS tokens FROM g WHERE rn = 1
 UNION ALL SELECT g.source, g.path, g.rn, r.batch + CAST(o AS INTEGER), CASE WHEN o THEN 1 ELSE n + 1 END, CASE WHEN o THEN b ELSE size + b END, CASE WHEN o THEN tok ELSE tokens + tok END
 FROM r JOIN (SELECT * FROM g) g ON g.source = r.source AND g.rn = r.rn + 1, LATERAL (SELECT n + 1 > {L.PACK_FILES} OR size + b > {L.PACK_BYTES} OR tokens + tok > {L.PACK_TOKENS} AS o))
SELECT source, path, batch FROM r""",
    "bijective_inherit": f"""WITH {_H}, dk AS (SELECT 'k/' || pid AS path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY pid) AS rn FROM h),
en AS (SELECT 'e' || pid AS entity_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY pid) AS rn FROM h WHERE doc_id IN (SELECT doc_id FROM labels)),
t AS (SELECT content_hash, min(entity_id) AS template FROM en GROUP BY 1)
SELECT dk.path, en.entity_id, en.entity_id IS NULL AS minted, template FROM dk JOIN t USING (content_hash) LEFT JOIN en ON dk.content_hash = en.content_hash AND dk.rn = en.rn""",
    "inherit_split_semi_anti": f"WITH {_H} SELECT 'k/' || pid AS path, content_hash IN (SELECT content_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels)) AS inherited FROM h",
    "bucket_counts": f"WITH {_FILES} SELECT bucket, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(tok) AS BIGINT) AS tokens FROM f GROUP BY 1",
    "cost_estimate": f"""WITH {_FILES}, a AS (SELECT count(*) FILTER (bucket = 'solo') + CAST(ceil(count(*) FILTER (bucket = 'batch') / 40.0) AS BIGINT) AS calls, CAST(coalesce(sum(tok) FILTER (bucket IN ('solo', 'batch')), 0) AS BIGINT) AS tokens_in FROM f)
SELECT calls, tokens_in, calls * 3000 AS tokens_out, round(tokens_in * 0.3 / 1e6 + calls * 3000 * 2.5 / 1e6, 6) AS usd FROM a""",
    "resume_states": f"""WITH {_H}, x AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1)
SELECT 'k/' || pid AS path, CASE WHEN x.doc_id IS NULL THEN 'fresh' WHEN q = 1 AND x = 1 THEN 'enqueue' WHEN q = 1 THEN 'skip' ELSE 'enqueue' END AS resume FROM h LEFT JOIN x USING (doc_id)""",
    "bag_jaccard_pairs": f"""WITH p AS (SELECT doc_id AS id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL),
x AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(list_transform(regexp_extract_all(a, '{_TOK}'), lambda z: lower(z))) AS t FROM p) GROUP BY 1, 2),
y AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(list_transform(regexp_extract_all(b, '{_TOK}'), lambda z: lower(z))) AS t FROM p) GROUP BY 1, 2),
j AS (SELECT coalesce(x.id, y.id) AS id, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS lo, sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0))) AS hi FROM x FULL JOIN y ON x.id = y.id AND x.t = y.t GROUP BY 1)
SELECT p.id, round(coalesce(lo / hi, 1.0), 9) AS jaccard, coalesce(lo / hi, 1.0) >= 0.85 AS cosmetic FROM p LEFT JOIN j ON p.id = j.id""",
    "size_band_join": "SELECT item_id AS id, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT item_id, length(text) AS s FROM benchmark) b JOIN documents ON n_chars >= s * 0.8::DOUBLE AND n_chars <= s * 1.2::DOUBLE GROUP BY 1",
    "redact_text": r"""SELECT doc_id, CASE WHEN length(text) <= 2000 THEN sha256(regexp_replace(regexp_replace(text, '\bBearer\s+[^\s"'',}\]]+', '[REDACTED]', 'gi'),
 '"?(authorization|api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|secret|password|client[_-]?secret)"?\s*[:=]\s*"?[^",}\s]+"?', '[REDACTED]', 'gi')) END AS redacted FROM documents""",
    "lineage_depth": f"WITH {_H} SELECT pid AS entity_id, first_value(pid) OVER (PARTITION BY content_hash ORDER BY doc_id) AS root, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) - 1 AS depth FROM h",
    "token_estimates": "SELECT doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens FROM documents",
    "clamped_titles": "SELECT doc_id, left(CASE WHEN trim(text) = '' THEN source ELSE trim(text) END, 80) AS title, lower(source) || ',a,' || lower(lang) || ',b,c' AS concepts FROM documents",
}
