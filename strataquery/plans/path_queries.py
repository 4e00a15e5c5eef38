"""Queries over the urls of ``pages`` as paths, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.operators import matching as M
from strataquery.operators import paths as P
from strataquery.session import table


def _paths(spark, d):
    t = table(spark, d, "pages")
    return t.select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def _bindings(spark, d):
    """Each host is bound to a project, and each of its first folders to one of its own."""
    p = _paths(spark, d)
    hosts = p.select(F.substring_index("path", "/", 1).alias("prefix")).distinct().select("prefix", F.concat(F.lit("host:"), "prefix").alias("project_id"))
    folders = p.select(F.substring_index("path", "/", 2).alias("prefix")).distinct().where("prefix LIKE '%/__'").select("prefix", F.concat(F.lit("folder:"), "prefix").alias("project_id"))
    return hosts.unionByName(folders)


def path_scalars(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("page_id", C.filename(p).alias("filename"), C.extension(p).alias("ext"), C.is_safe_path(p).alias("safe"), C.is_content_hash(C.sha256_hex(F.col("url"))).alias("hashed"), C.sha256_hex(F.col("url")).alias("url_hash"))


def canonical_remote(spark, d):
    return table(spark, d, "pages").select("page_id", C.canonical_remote(F.col("url")).alias("remote"))


def longest_prefix_binding(spark, d):
    return M.longest_prefix(_paths(spark, d).select("path").distinct(), _bindings(spark, d)).select("path", "prefix", "project_id")


def resolve_scope(spark, d):
    """Only hosts of example.com are bound; example.net's addresses are known as remotes."""
    p = _paths(spark, d).select("path", F.lit("").alias("env_project"), C.canonical_remote(F.col("url")).alias("remote")).distinct()
    bound = _bindings(spark, d).where("prefix LIKE '%.example.com%'")
    remotes = p.where("path LIKE '%.example.net/%'").select("remote", F.concat(F.lit("remote:"), "remote").alias("project_id"))
    return M.resolve_scope(p, bound, remotes).select("path", "remote", "project_id")


def ignore_filter(spark, d):
    return P.without_ignored(_paths(spark, d), ["spam-farm.example.org", "./blog.ththan.example.net/en/"], (".git", "node_modules", "es")).select("page_id")


def ignore_rules(spark, d):
    """Ignore files at the root and in a folder."""
    rules = {"": "*.html\n!/m.*/**/*.html\nspam-farm.*/\n**/es/\n", "spam-farm.example.org": "!en/\n"}
    return P.without_rules(_paths(spark, d).select("page_id", F.regexp_replace("path", "[?#].*$", "").alias("path")), rules).select("page_id")


def known_folders(spark, d):
    """Folders among gone paths: every first-level prefix of the pages is one."""
    p = _paths(spark, d)
    gone = p.select(F.substring_index("path", "/", 2).alias("path")).distinct()
    return P.missing_folders(gone, p)


def active_projects(spark, d):
    p = _paths(spark, d)
    listed = p.select(F.col("page_id").alias("place"), F.substring_index("path", "/", 1).alias("project_id"), F.concat(F.lit("/"), F.substring_index("path", "/", -1)).alias("root"))
    paused = listed.groupBy("project_id").agg((F.count("*") > 20).alias("paused"))
    return P.active_projects(listed, paused, False)


def project_changes(spark, d):
    p = _paths(spark, d)
    a, b = p.where("url LIKE 'http:%'").select(F.substring_index("path", "/", 1).alias("id")).distinct(), p.where("url LIKE 'https:%'").select(F.substring_index("path", "/", 1).alias("id")).distinct()
    start, stop = P.project_changes(a, b)
    return start.withColumn("change", F.lit("start")).unionByName(stop.withColumn("change", F.lit("stop")))


QUERIES = {f.__name__: f for f in (path_scalars, canonical_remote, longest_prefix_binding, resolve_scope, ignore_filter, ignore_rules, known_folders, active_projects, project_changes)}

_P = "p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
_B = """b AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix, 'host:' || split_part(path, '/', 1) AS project_id FROM p
 UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'folder:' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE length(split_part(path, '/', 2)) = 2 AND contains(path, '/'))"""
_CLEAN = "regexp_replace(path, '/+$', '')"
_REMOTE = "rtrim(lower(split_part(path, '/', 1)) || '/' || array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(substr(path, strpos(path, '/') + 1), '/+$', ''), '\\.git$', '', 'i'), '/'), lambda x: lower(trim(x))), lambda x: x <> ''), '/'), '/')"
_LONGEST = f"FROM (SELECT p.path, b.prefix, b.project_id, row_number() OVER (PARTITION BY p.path ORDER BY length(b.prefix) DESC, b.prefix) AS rn FROM (SELECT DISTINCT path FROM p) p JOIN b ON {_CLEAN.replace('path', 'p.path')} = b.prefix OR starts_with({_CLEAN.replace('path', 'p.path')}, b.prefix || '/')"
ORACLE_SQL = {
    "path_scalars": rf"WITH {_P} SELECT page_id, regexp_extract(path, '[^/]*$') AS filename, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+[.]([^.]*)$', 1)) AS ext, NOT regexp_matches(path, '^[A-Za-z]:|^[/\\]|(^|[/\\])\.\.([/\\]|$)') AND path <> '' AS safe, true AS hashed, sha256(url) AS url_hash FROM p",
    "canonical_remote": f"WITH {_P} SELECT page_id, {_REMOTE} AS remote FROM p",
    "longest_prefix_binding": f"WITH {_P}, {_B} SELECT path, prefix, project_id {_LONGEST}) WHERE rn = 1",
    "resolve_scope": f"""WITH {_P}, {_B}, f AS (SELECT path, project_id {_LONGEST} WHERE b.prefix LIKE '%.example.com%') WHERE rn = 1)
SELECT DISTINCT p.path, {_REMOTE.replace('path', 'p.path')} AS remote, coalesce(f.project_id, CASE WHEN r.remote IS NOT NULL THEN 'remote:' || r.remote END, '__unsorted__') AS project_id
FROM p LEFT JOIN f ON p.path = f.path LEFT JOIN (SELECT DISTINCT {_REMOTE} AS remote FROM p WHERE path LIKE '%.example.net/%') r ON r.remote = {_REMOTE.replace('path', 'p.path')}""",
    "ignore_filter": f"""WITH {_P} SELECT page_id FROM (SELECT page_id, regexp_replace(path, '/+$', '') AS path FROM p) WHERE path <> '' AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'es'])
 AND NOT (path = 'spam-farm.example.org' OR starts_with(path, 'spam-farm.example.org/') OR path = 'blog.ththan.example.net/en' OR starts_with(path, 'blog.ththan.example.net/en/'))""",
    "known_folders": f"WITH {_P}, g AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE path END AS path FROM p) SELECT path FROM g WHERE EXISTS (SELECT 1 FROM p WHERE starts_with(p.path, g.path || '/'))",
    "active_projects": rf"""WITH {_P}, l AS (SELECT page_id, split_part(path, '/', 1) AS project_id, '/' || regexp_extract(path, '[^/]*$') AS root FROM p)
SELECT project_id, root, CASE WHEN regexp_matches(regexp_replace(root, '[/\\]+$', ''), '^$|^[A-Za-z]:$|^/(home|Users)(/[^/]+)?$|^/root$') THEN 'refused' WHEN n > 20 THEN 'paused' ELSE 'active' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_id) AS rn, count(*) OVER (PARTITION BY project_id) AS n FROM l) WHERE rn = 1""",
    "project_changes": f"""WITH {_P}, a AS (SELECT DISTINCT split_part(path, '/', 1) AS id FROM p WHERE url LIKE 'http:%'), b AS (SELECT DISTINCT split_part(path, '/', 1) AS id FROM p WHERE url LIKE 'https:%')
SELECT id, 'start' AS change FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'stop' FROM a WHERE id NOT IN (SELECT id FROM b)""",
}
