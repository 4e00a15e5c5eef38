"""File discovery and JSON files: version control's list, a pruned walk, contents, projects, reviews, settings."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataquery.operators.paths import IGNORED_SEGMENTS, without_ignored, without_rules
from strataquery.schemas import REVIEWS, conform, struct

FILE = "path string, size_bytes long, mtime string, content binary"


def tracked_paths(root: str, run: Callable = subprocess.run, most: int = 64 << 20) -> tuple[list[str] | None, str]:
    """(paths, state) of version control: tracked and untracked but not ignored. State is ok, absent or error."""
    try:
        got = run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, timeout=120)
    except FileNotFoundError:
        return None, "absent"
    except (OSError, subprocess.SubprocessError):
        return None, "error"
    if got.returncode == 128 and b"not a git repository" in got.stderr:
        return None, "absent"
    if got.returncode or len(got.stdout) > most:
        return None, "error"
    return sorted(set(got.stdout.decode("utf-8", "replace").split("\0")) - {""}), "ok"


def contained(root: str, rel: str) -> str | None:
    """The real path of a relative one, or None if it is unsafe, a link, or leads out of the root."""
    if not rel or os.path.isabs(rel) or "\0" in rel or ".." in rel.replace("\\", "/").split("/"):
        return None
    top = os.path.realpath(root)
    full = os.path.join(top, rel)
    if os.path.islink(full) or os.path.commonpath([top, os.path.realpath(full)]) != top:
        return None
    return full


class TreeSource(DataSource):
    """Python data source ``tree``: files below a folder, without links; ignored folders aren't entered.

    Options: path; skip (names of folders, separated by commas); contents ("false": without). Each folder at the top is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.skip = set(filter(None, options.get("skip", ",".join(IGNORED_SEGMENTS)).split(",")))
        self.contents = options.get("contents", "true") != "false"

    def partitions(self):
        top = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.skip)
        return [InputPartition(""), *map(InputPartition, top)]

    def read(self, partition):
        start = os.path.join(self.root, partition.value)
        for folder, dirs, names in os.walk(start, followlinks=False):
            dirs[:] = [] if not partition.value else sorted(d for d in dirs if d not in self.skip and not os.path.islink(os.path.join(folder, d)))
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.islink(full):
                    continue
                try:
                    stat = os.stat(full)
                    content = open(full, "rb").read() if self.contents else None
                except OSError:
                    continue  # gone meanwhile
                yield os.path.relpath(full, self.root).replace(os.sep, "/"), stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), content


def walk(spark: SparkSession, root: str, skip: tuple[str, ...] = IGNORED_SEGMENTS, contents: bool = True) -> DataFrame:
    """The files below a folder that all executors see."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(path=root, skip=",".join(skip), contents=str(contents).lower()).load()


def stored_files(spark: SparkSession, url: str) -> DataFrame:
    """The files below a url of any store, with contents: path is relative; contents aren't read unless used."""
    base = url.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return raw.select(F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() else c for c in base.split("://")[-1]) + "/", "").alias("path"), F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mtime"), "content")


def discover(spark: SparkSession, root: str, policy: str = "warn", run: Callable = subprocess.run, prefixes: list[str] | None = None, rules: dict[str, str] | None = None, contents: bool = True) -> tuple[DataFrame, str | None]:
    """(files, why degraded): version control's list if there is one, else a walk. An error of it aborts under policy abort.

    prefixes and rules (directory -> text of an ignore file) hold for a walk; prefixes and the directories that are
    always ignored hold for a listing too. Files are chosen by their paths first; contents are read of those alone.
    """
    listed, state = tracked_paths(root, run)
    if state == "error" and policy == "abort":
        raise RuntimeError("version control failed")
    if listed is None:
        files = walk(spark, root, contents=False)
        if rules:
            files = without_rules(files, rules)
    else:
        files = walk(spark, root, contents=False).join(spark.createDataFrame([(p,) for p in listed], "path string").distinct(), "path", "left_semi")
    files = without_ignored(files, prefixes or [])
    why = "version-control-error" if listed is None and state != "absent" else None
    return (with_contents(files, root) if contents else files), why


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """Files with what they hold now; those that have gone meanwhile are left out."""

    def run(batches):
        for pdf in batches:
            held = []
            for p in pdf["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
            yield pdf.assign(content=held)[[x is not None for x in held]]

    return files.mapInPandas(run, files.schema)


def _json(path: str) -> object:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def projects(spark: SparkSession, path: str, org: str, workspace: str, version: int = 1) -> DataFrame:
    """Bindings (prefix, project_id) of a cache file; another version or tenant, or a bad file, gives none."""
    doc = _json(path)
    ok = isinstance(doc, dict) and doc.get("version") == version and doc.get("org_id") == org and doc.get("workspace_id") == workspace and isinstance(doc.get("bindings"), list)
    rows = [(b["prefix"], b["project_id"]) for b in doc["bindings"] if isinstance(b, dict) and isinstance(b.get("prefix"), str) and isinstance(b.get("project_id"), str)] if ok else []
    return spark.createDataFrame(rows, "prefix string, project_id string")


def load_state(path: str) -> dict:
    """{paused: bool, projects: {id: bool}}; keys of other kinds are passed over."""
    doc = _json(path)
    doc = doc if isinstance(doc, dict) else {}
    own = doc.get("projects")
    return {"paused": doc.get("paused") is True, "projects": {k: v for k, v in own.items() if isinstance(v, bool)} if isinstance(own, dict) else {}}


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Pending reviews of a JSON file (an array of rows); rows without an id, candidate or path are dropped, a bad file is empty."""
    if not os.path.exists(path):
        return spark.createDataFrame([], struct(REVIEWS))
    raw = spark.read.schema(struct(REVIEWS)).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return conform(raw.where("id IS NOT NULL AND candidate IS NOT NULL AND new_path IS NOT NULL"), REVIEWS)


def ignore_prefixes(path: str) -> list[str]:
    """Prefixes of an ignore file: a JSON array, or an object with one under ``ignore``."""
    doc = _json(path)
    found = doc.get("ignore") if isinstance(doc, dict) else doc
    return [x for x in found if isinstance(x, str) and x] if isinstance(found, list) else []
