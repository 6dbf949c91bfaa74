"""Streams with state and timers, against lists made by hand."""

import time

import pytest
from pyspark.sql import functions as F

from voxelmill.streaming import streams as S

LEVELS = "folder string, ts timestamp, gb double"


def batches(spark, path, *tables):
    """A stream that gets one table a batch."""
    for k, rows in enumerate(tables):
        spark.createDataFrame(rows, LEVELS).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(LEVELS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def at(second):
    import datetime

    return datetime.datetime.fromtimestamp(1_700_000_000 + second)


def test_marks_and_silence_by_event_time(spark, tmp_path):
    first = [("a", at(0), 44.0), ("a", at(10), 46.0), ("a", at(20), 42.0), ("b", at(0), 39.0)]
    second = [("a", at(30), 39.0), ("a", at(40), 44.0), ("a", at(700), 45.0)]
    third = [("c", at(2000), 1.0)]
    stream = batches(spark, tmp_path / "in", first, second, third)
    told = S.drain(S.flow_control(stream, "folder", "ts", "gb"))
    found = sorted((r.key, r.at // 1_000_000 - 1_700_000_000, r.level, r.signal) for r in told.where("signal <> 'idle'").collect())
    a = [(0, 44.0, "go"), (10, 46.0, "pause"), (20, 42.0, "wait"), (30, 39.0, "resume"), (40, 44.0, "go"), (700, 45.0, "pause")]
    assert found == [("a", *x) for x in a] + [("b", 0, 39.0, "go"), ("c", 2000, 1.0, "go")]
    idle = sorted((r.key, r.at // 1_000_000 - 1_700_000_000) for r in told.where("signal = 'idle'").collect())
    assert idle == [("a", 340), ("a", 1000), ("b", 300)]


def test_silence_by_the_clock(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", [("a", at(0), 50.0), ("b", at(0), 1.0)])
    query = S.flow_control(stream, "folder", "ts", "gb", idle_seconds=1.0, event_time=False).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("gate").where("signal = 'idle'").count() < 2:
            time.sleep(0.5)
        time.sleep(3)
        rows = sorted((r.key, r.signal) for r in spark.table("gate").collect())
    finally:
        query.stop()
    assert rows == [("a", "idle"), ("a", "pause"), ("b", "go"), ("b", "idle")]


def test_last_lines_and_forced_updates(spark, tmp_path):
    rows = [(f"{k}", at(k), 0.0) for k in range(8)]
    stream = batches(spark, tmp_path / "in", rows[:4], rows[4:]).select(F.lit("t").alias("task"), "ts", F.col("folder").alias("line"), F.lit("running").alias("status"), F.col("folder").isin("1", "6").alias("forced"))
    told = S.drain(S.task_updates(stream, "task", "ts", "line", "status", "forced", lines=3, seconds=3.0), "batches").orderBy("at").collect()
    assert [(r.at // 1_000_000 - 1_700_000_000, "".join(r.logs)) for r in told] == [(0, "0"), (1, "01"), (3, "123"), (6, "456"), (7, "567")]


def test_a_batch_replaces_itself(spark, tmp_path):
    put = S.numbered_sink(str(tmp_path))
    put(spark.range(3), 0)
    put(spark.range(5), 1)
    put(spark.range(4), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 7


@pytest.mark.parametrize("seconds", [0.0, 2.0])
def test_throttled(spark, tmp_path, seconds):
    stream = batches(spark, tmp_path / "in", [("1", at(k), 0.0) for k in range(5)], [("1", at(k), 0.0) for k in (5, 8)])
    told = S.drain(S.throttled(stream.withColumn("folder", F.col("folder").cast("long")), "folder", "ts", seconds))
    assert sorted(r["at"] // 1_000_000 - 1_700_000_000 for r in told.collect()) == ([0, 1, 2, 3, 4, 5, 8] if seconds == 0 else [0, 2, 4, 8])


def test_locks_and_quiet_sessions(spark, tmp_path):
    first = [("a", at(0), 0.0), ("a", at(100), 0.0), ("b", at(50), 0.0)]
    second = [("a", at(1000), 0.0), ("a", at(1010), 0.0), ("z", at(9000), 0.0)]
    third = [("z", at(9001), 0.0)]
    stream = batches(spark, tmp_path / "in", first, second, third)
    moment = lambda t: round((t - at(0)).total_seconds())
    starts = sorted((r.key, r["at"] // 1_000_000 - 1_700_000_000) for r in S.drain(S.locked_starts(stream, "folder", "ts")).collect())
    assert starts == [("a", 0), ("a", 1000), ("b", 50), ("z", 9000)]
    quiet = sorted((r.folder, moment(r["first"]), moment(r.until), r.changes) for r in S.drain(S.quiet_sessions(stream, "folder", "ts", "200 seconds")).collect())
    assert quiet == [("a", 0, 300, 2), ("a", 1000, 1210, 2), ("b", 50, 250, 1)]
