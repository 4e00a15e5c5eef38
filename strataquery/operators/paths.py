"""Which paths count: ignore rules, prefixes, safety, active projects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K

#: Directories that are always ignored; a caller adds its own.
IGNORED_SEGMENTS = (".git", "node_modules")


def ignored_by_segment(path: F.Column, segments: tuple[str, ...] = IGNORED_SEGMENTS) -> F.Column:
    return (path == "") | F.exists(F.split(path, "/"), lambda s: s.isin(*segments))


def without_ignored(paths: DataFrame, prefixes: list[str], segments: tuple[str, ...] = IGNORED_SEGMENTS) -> DataFrame:
    """Paths outside of ignored directories and of the prefixes (a folder, or the path itself)."""
    p = C.slashed(F.col("path"))
    drop = ignored_by_segment(p, segments)
    for x in prefixes:
        clean = x.replace("\\", "/").removeprefix("./").strip("/")
        if clean:
            drop = drop | (p == clean) | p.startswith(clean + "/")
    return paths.where(~drop)


def without_rules(paths: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Paths that the ignore files (directory -> text, '' for the root) don't ignore."""
    compiled = {d: K.ignore_rules(t) for d, t in rules.items()}

    @F.pandas_udf("boolean")
    def ignored(p: pd.Series) -> pd.Series:
        return p.map(lambda x: K.decide_nested(compiled, x))

    return paths.where(~ignored(C.slashed(F.col("path"))))


def within_snapshot(paths: DataFrame, tracked: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Paths in the version control's list, and of the others those that no rule ignores."""
    known = paths.join(tracked.select("path").distinct(), "path", "left_semi")
    other = paths.join(tracked.select("path").distinct(), "path", "left_anti")
    return known.unionByName(without_rules(other, rules))


def ancestors(path: F.Column) -> F.Column:
    """Folders above a path, from the top."""
    n = F.size(F.split(path, "/"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def missing_folders(gone: DataFrame, known: DataFrame) -> DataFrame:
    """Gone paths that are folders: some known path lies below. An equi-join on the known paths' folders."""
    folders = known.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return gone.join(folders, "path", "left_semi")


def active_projects(projects: DataFrame, paused: DataFrame, all_paused: bool) -> DataFrame:
    """(project_id, root, state): one row a project, the first listed; a root that is the file system's or a home is refused; a general pause beats a project's own state.

    projects: place, project_id, root; paused: project_id, paused.
    """
    w = Window.partitionBy("project_id").orderBy("place")
    one = projects.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    clean = F.regexp_replace(F.col("root"), "[/\\\\]+$", "")
    odd = clean.rlike("^$|^[A-Za-z]:$|^/(home|Users)(/[^/]+)?$|^/root$")
    state = F.when(odd, "refused").when(F.lit(all_paused), "paused").when(F.coalesce("paused", F.lit(False)), "paused").otherwise("active")
    return one.join(paused, "project_id", "left").select("project_id", "root", state.alias("state"))


def project_changes(running: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to start, to stop): rows of one side that the other lacks."""
    return wanted.exceptAll(running), running.exceptAll(wanted)
