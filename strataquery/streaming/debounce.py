"""Debounced change events: a burst of events on a path fires once when it pauses, or when it has gone on too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The pause that ends a burst, and the longest burst.
PAUSE_MS, MOST_MS = 500, 5000


def sessions(events: DataFrame, gap: str, key: str = "path", ts: str = "ts") -> DataFrame:
    """(key, start, end, n) of bursts, for a batch or a stream with a watermark; without a longest burst."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def capped_sessions(events: DataFrame, pause_ms: int = PAUSE_MS, most_ms: int = MOST_MS, key: str = "path", ts_ms: str = "ts_ms") -> DataFrame:
    """(key, fired_ms, n) over a bounded table: a burst fires ``pause_ms`` after its last event, or ``most_ms`` after its first.

    The cap makes a burst's end depend on where it began, so each key is a fold over its events in order. They are
    streamed through a task in that order, which holds but the open burst.
    """
    rows = events.select(key, F.col(ts_ms).cast("long").alias("_at")).where("_at IS NOT NULL")
    schema = T.StructType([rows.schema[key], T.StructField("fired_ms", T.LongType()), T.StructField("n", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, n = None, 0, 0, 0
        kinds = [None, pa.int64(), pa.int64()]

        def fired(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            kinds[0], out = batch.schema.field(0).type, []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and (k != now or t - last > pause_ms or t - first > most_ms):
                    out.append((now, min(last + pause_ms, first + most_ms), n))
                    n = 0
                now, first, last, n = k, first if n else t, t, n + 1
            yield fired(out)
        if n:
            yield fired([(now, min(last + pause_ms, first + most_ms), n)])

    return rows.repartition(key).sortWithinPartitions(key, "_at").mapInArrow(run, schema)


class Debouncer(StatefulProcessor):
    """For transformWithStateInPandas on a stream of (path, ts_ms), in processing time: a timer a path, set anew by each event up to the cap."""

    def __init__(self, pause_ms: int = PAUSE_MS, most_ms: int = MOST_MS):
        self.pause_ms, self.most_ms = pause_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", T.StructType([T.StructField(c, T.LongType()) for c in ("first", "due", "n")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, now = sum(len(r) for r in rows), timerValues.getCurrentProcessingTimeInMs()
        first, due, seen = self.burst.get() if self.burst.exists() else (now, None, 0)
        if due is not None:
            self.handle.deleteTimer(due)
        due = min(now + self.pause_ms, first + self.most_ms)
        self.handle.registerTimer(due)
        self.burst.update((first, due, seen + n))
        yield pd.DataFrame({"path": [], "fired_ms": [], "n": []}).astype({"path": "str", "fired_ms": "int64", "n": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.burst.exists():
            _, _, n = self.burst.get()
            self.burst.clear()
            yield pd.DataFrame({"path": [key[0]], "fired_ms": [expiredTimerInfo.getExpiryTimeInMs()], "n": [n]})

    def close(self) -> None:
        pass


def debounce(stream: DataFrame, pause_ms: int = PAUSE_MS, most_ms: int = MOST_MS) -> DataFrame:
    """(path, fired_ms, n) of a stream of change events."""
    schema = "path string, fired_ms long, n long"
    return stream.groupBy("path").transformWithStateInPandas(Debouncer(pause_ms, most_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


def needs_resync(events: DataFrame) -> DataFrame:
    """One row with resync: whether any event names no path or a folder, so that all paths are to be looked at."""
    return events.agg(F.coalesce(F.bool_or(F.col("path").isNull() | (F.col("path") == "") | F.coalesce(F.col("is_dir"), F.lit(False))), F.lit(False)).alias("resync"))
