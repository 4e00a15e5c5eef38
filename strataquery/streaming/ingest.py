"""Observation streams into the store: one micro-batch at a time, on a fixed beat, and halting on failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strataquery.operators.enrich import Failures
from strataquery.sources.tables import write_batch

#: Seconds between enrichment cycles and between full looks at all paths.
CYCLE_S, RESYNC_S = 30, 600


def file_stream(spark: SparkSession, url: str) -> DataFrame:
    """New files of a store as a stream (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(url)


def start(stream: DataFrame, identities_path: str, versions_path: str, checkpoint: str, seconds: int | None = CYCLE_S) -> StreamingQuery:
    """Appends observed rows: Spark runs one batch at a time and gathers what arrives meanwhile. seconds None: what is there, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch(identities_path, versions_path))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def cycles(stream: DataFrame, cycle: Callable[[DataFrame, int], tuple[int, int]], checkpoint: str, failures: Failures, seconds: int | None = CYCLE_S) -> StreamingQuery:
    """Runs ``cycle`` (batch, number) -> (worked, failed) on each micro-batch until ``failures`` halts; halted batches raise, so nothing is lost."""

    def each(batch: DataFrame, number: int) -> None:
        if failures.halted:
            raise RuntimeError("halted after failed cycles; acknowledge to go on")
        failures.saw(*cycle(batch, number))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def on_a_beat(spark: SparkSession, look: Callable[[], None], checkpoint: str, seconds: float = RESYNC_S) -> StreamingQuery:
    """Calls ``look`` (a full look at all paths, say) once a beat, for as long as the query runs; a look that takes longer delays the next one."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _batch, _number: look())
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def unseen(stream: DataFrame, delay: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Drops events that repeat within the watermark: paths pending between cycles count once."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def supervise(begin: Callable[[], StreamingQuery], restarts: int = 5, first_wait: float = 1.0, most_wait: float = 30.0, wait: Callable[[float], None] | None = None) -> str:
    """Runs a query and begins it anew when it fails, waiting longer each time; 'stopped' if it ends well, 'degraded' after too many failures."""
    import time

    pause, delay = wait or time.sleep, first_wait
    for n in range(restarts + 1):
        try:
            begin().awaitTermination()
            return "stopped"
        except Exception:  # noqa: BLE001  a stream fails with whatever its source or sink raised
            if n < restarts:
                pause(delay)
                delay = min(2 * delay, most_wait)
    return "degraded"


def write_last(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, seconds: int | None = CYCLE_S) -> StreamingQuery:
    """Writes a snapshot at most once a beat: what changes meanwhile is one batch, and an empty one writes nothing."""

    def each(batch: DataFrame, _number: int) -> None:
        if not batch.isEmpty():
            write(batch)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


class Heartbeat(StreamingQueryListener):
    """Keeps the time and counts of each query's last progress, for a status table or a health view."""

    def __init__(self) -> None:
        self.last: dict[str, dict[str, object]] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {"state": "started", "at": event.timestamp, "rows": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = self.last.get(str(p.id), {}).get("rows", 0)
        self.last[str(p.id)] = {"state": "running", "at": p.timestamp, "rows": rows + p.numInputRows}

    def onQueryIdle(self, event) -> None:
        self.last.setdefault(str(event.id), {"rows": 0}).update(state="idle", at=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self.last.setdefault(str(event.id), {"rows": 0}).update(state="failed" if event.exception else "stopped")
