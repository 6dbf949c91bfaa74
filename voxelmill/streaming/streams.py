"""Task and transfer streams: bounded micro-batches, locks, quiet spells, throttling, history.

The window counts at the end are additions of this engine; all else has a counterpart
among the batch operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import Row

from voxelmill.session import shared_folder


def file_stream(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    """Parquet files as they land, at most so many a micro-batch; the bound is what a full queue was to a producer."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_at_once)
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [path.rsplit("/", 1)[-1]]:  # a table of one file: watch its folder for that name
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote, in the folder that the cluster shares.

    In mode ``batches`` every batch goes to the place that its number names.
    """
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append" if mode == "batches" else mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    elif mode == "batches":
        query = writer.foreachBatch(numbered_sink(f"{folder}/rows")).start()
    else:
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")


def on_batch(stream: DataFrame, handle, checkpoint: str):
    """Call ``handle(batch, number)`` for what completes, once for each micro-batch; the caller stops the query."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def completed_once(events: DataFrame, key: str, at: str, keep: str = "24 hours") -> DataFrame:
    """Finished tasks, each once; identifiers are forgotten after ``keep``, as histories expire."""
    return events.where(F.col("status") == "completed").withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def quiet_sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Spells of changes that ended because nothing came for ``gap``."""
    spell = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("changes"))
    return spell.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "changes")


def failure_ledger(events: DataFrame, key: str) -> DataFrame:
    """Failures of each key so far; under two it may be tried again."""
    return events.where(F.col("status") == "failed").groupBy(key).agg(F.count(F.lit(1)).alias("failures")).withColumn("retry", F.col("failures") < 2)


def throttled(events: DataFrame, key: str, at: str, seconds: float = 0.5, late: str = "1 minute") -> DataFrame:
    """Updates of each key at least ``seconds`` after the last one that was let through; state is dropped an hour after the last."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(batches)).sort_values("at")
        kept = []
        for moment in frame["at"]:
            if last is None or moment - last >= int(seconds * 1_000_000):
                kept.append(moment)
                last = moment
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last // 1000) + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [keys[0]] * len(kept), "at": kept})

    timed = events.withWatermark(at, late).select(F.col(key).alias("key"), F.unix_micros(at).alias("at"), F.col(at))
    return timed.groupBy("key").applyInPandasWithState(run, "key long, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


#: The state store that timers need.
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FlowGate(StatefulProcessor):
    """Holds a key back from the high mark until its level is down at the low one, and tells when it falls silent.

    State of a key: whether it is held, the moment of its last row (microseconds), and
    whether its silence has been told.
    """

    def __init__(self, high: float, low: float, idle_ms: int, event_time: bool) -> None:
        self.high, self.low, self.idle_ms, self.event_time = high, low, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "held boolean, last long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held, last, told = self.state.get() if self.state.exists() else (False, None, True)
        for row in sorted(rows, key=lambda r: (r.at, r.level)):
            if self.event_time and not told and row.at - last > self.idle_ms * 1000:
                yield Row(key=key[0], at=last + self.idle_ms * 1000, level=None, signal="idle")
            if row.level >= self.high:
                signal, held = "wait" if held else "pause", True
            elif row.level <= self.low:
                signal, held = "resume" if held else "go", False
            else:
                signal = "wait" if held else "go"
            last, told = row.at if last is None else max(last, row.at), False
            yield Row(key=key[0], at=row.at, level=row.level, signal=signal)
        self.state.update((held, last, told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        begin = -(-last // 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(max(begin + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1 if self.event_time else 0))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held, last, told = self.state.get()
        if not told:
            self.state.update((held, last, True))
            yield Row(key=key[0], at=last + self.idle_ms * 1000, level=None, signal="idle")

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, by: str, processor: StatefulProcessor, schema: str, event_time: bool) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", TIMER_STORE)
    return stream.groupBy(by).transformWithState(processor, schema, "append", "eventTime" if event_time else "processingTime")


class StartLocks(StatefulProcessor):
    """Lets a start through if no other of its key was let through within the lock."""

    def __init__(self, lock: int) -> None:
        self.lock = lock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = last = self.last.get()[0] if self.last.exists() else None
        for at in sorted(r.at for r in rows):
            if last is None or at - last >= self.lock:
                last = at
                yield Row(key=key[0], at=at)
        if last != before:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((last + self.lock) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def locked_starts(events: DataFrame, key: str, at: str, lock_seconds: float = 300.0, late: str = "0 seconds") -> DataFrame:
    """``key, at`` (microseconds) of the starts that find no lock of their key younger than ``lock_seconds``; one that is turned away renews no lock."""
    told = events.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("at"), F.col(at).alias("moment"))
    return _timed(told, "key", StartLocks(int(lock_seconds * 1_000_000)), "key string, at long", True)


def flow_control(levels: DataFrame, key: str, at: str, level: str, high: float = 45.0, low: float = 40.0, idle_seconds: float = 300.0, event_time: bool = True, late: str = "0 seconds") -> DataFrame:
    """What a producer is told at each row of its level: ``key, at, level, signal``.

    ``pause`` at the high mark, ``wait`` until the level is at the low mark, ``resume``
    there, else ``go``. A key that is silent for ``idle_seconds`` gets one row ``idle``
    at that moment and no other until it speaks again: by the watermark, so that a
    rerun tells the same, or by the clock, for a watchdog. ``at`` is in microseconds; rows
    of one moment count in the order of their levels.
    """
    stream = levels.withWatermark(at, late) if event_time else levels
    told = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("at"), F.col(level).cast("double").alias("level"), F.col(at).alias("moment"))
    return _timed(told, "key", FlowGate(high, low, int(idle_seconds * 1000), event_time), "key string, at long, level double, signal string", event_time)


class TaskUpdates(StatefulProcessor):
    """The last log lines of a task, told at most once in so many microseconds unless a row is forced."""

    def __init__(self, lines: int, every: int, forget_ms: int) -> None:
        self.lines, self.every, self.forget_ms = lines, every, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.logs = handle.getListState("logs", "message string")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        logs = [r[0] for r in self.logs.get()] if self.logs.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        at = 0
        for row in sorted(rows, key=lambda r: (r.at, r.message)):
            logs, at = [*logs, row.message][-self.lines :], row.at
            due = last is None or at - last >= self.every
            if row.forced or due:
                # a forced row doesn't put off the next one
                last = last if row.forced else at
                yield Row(key=key[0], at=at, status=row.status, logs=logs)
        self.logs.put([(line,) for line in logs])
        if last is not None:
            self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at // 1000 + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.logs.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def task_updates(events: DataFrame, key: str, at: str, message: str, status: str, forced: str, lines: int = 5, seconds: float = 0.5, forget_seconds: float = 86400.0, late: str = "0 seconds") -> DataFrame:
    """Updates of each task with its last ``lines`` log lines: ``key, at, status, logs``.

    A row is told if it is forced or ``seconds`` after the last unforced one that was.
    The lines of a task that has been silent for ``forget_seconds`` are dropped.
    """
    told = events.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("at"), F.col(message).alias("message"), F.col(status).alias("status"), F.col(forced).alias("forced"), F.col(at).alias("moment"))
    processor = TaskUpdates(lines, int(seconds * 1_000_000), int(forget_seconds * 1000))
    return _timed(told, "key", processor, "key string, at long, status string, logs array<string>", True)


def numbered_sink(folder: str):
    """A function for ``foreachBatch`` that puts each batch in the place its number names: one that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return put


def window_counts(events: DataFrame, at: str, width: str, slide: str | None = None, by: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows; a window is told once no late row can change it."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counted = events.withWatermark(at, late).groupBy(window.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("begin"), *(by or []), "n")
