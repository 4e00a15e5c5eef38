"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_dir(spark)


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='strataquery-')}"
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Paths of the tables that this process has made with :func:`stash` and not deleted since.
_MADE: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def stashes() -> set[str]:
    """The tables that are there: to be kept when others are swept."""
    return set(_MADE)


def sweep(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Deletes the tables made by :func:`stash` that aren't to be kept. Results that were written, or are no longer wanted, don't need them."""
    for path in [p for p in _MADE if p not in keep]:
        _delete(spark, path)


def drop_stash(df: DataFrame) -> None:
    """Deletes a table made by :func:`stash` that no later plan reads."""
    _delete(df.sparkSession, df._stash_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _MADE:
        _MADE.remove(path)


#: What a Python worker keeps between tasks: one operator's state at a time.
_STATE: dict[object, object] = {}


def worker_state(key: object, build: Callable[[], object]) -> object:
    """State (a model, caches) that a worker's tasks share; that of another key goes first."""
    if key not in _STATE:
        release()
        _STATE[key] = build()
    return _STATE[key]


def release() -> None:
    """Drops the worker's state and gives its memory back to the system."""
    if _STATE:
        _STATE.clear()
        gc.collect()
        trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _held() -> set[object]:
    """What the worker holds. Functions sent to workers take a copy of a global that they name, but call this one in place."""
    return set(_STATE)


#: Rows of a batch that are worked on at a time, and the most bytes of a batch that Spark sends to a worker (but for a longer row).
SLICE, BATCH_BYTES = 1000, 4_000_000


def bounded(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES: at Spark's own 64 MB, either side keeps several such buffers for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` by bounded batches, in workers that drop what other operators kept there and give back what a task took."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        trim()

    bounded(df.sparkSession)
    return df.mapInArrow(freed, schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a per-task function that ``make`` builds once; it gets at most SLICE rows at a time.

    What an operator keeps in a worker beyond the task comes from :func:`worker_state` within ``make``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = _held()
        fn = make()
        if before and before == _held() and not getattr(fn, "keeps_state", False):
            release()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                yield fn(batch.slice(i, SLICE))
        trim()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def fields(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])
