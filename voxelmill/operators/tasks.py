"""Task tables: counts, history, queue, state and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "running", "completed", "failed", "cancelled")
FINISHED = ("completed", "failed", "cancelled")


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def queue_status(tasks: DataFrame, slots: int = 3) -> DataFrame:
    running, waiting = F.count_if(F.col("status") == "running"), F.count_if(F.col("status") == "pending")
    return tasks.agg(running.alias("running"), waiting.alias("waiting"), F.round(100.0 * running / slots, 1).alias("utilisation"))


def queue_positions(tasks: DataFrame, queue: str, order: list[str]) -> DataFrame:
    """Place of each waiting task in its queue."""
    return tasks.where(F.col("status") == "pending").withColumn("position", F.row_number().over(Window.partitionBy(queue).orderBy(*order)))


def history_page(tasks: DataFrame, page: int | str, size: int | str, rows: int, order: list[Column]) -> DataFrame:
    """One page of finished tasks; page and size are brought into their limits, a bad value gives the default."""

    def whole(value: int | str, default: int) -> int:
        try:
            return int(value)
        except (TypeError, ValueError):
            return default

    size_ = min(max(whole(size, 20), 1), 200)
    page_ = min(max(whole(page, 1), 1), max(1, -(-rows // size_)))
    return tasks.orderBy(*order).offset((page_ - 1) * size_).limit(size_)


def last_per_key(logs: DataFrame, key: str, order: list[Column], n: int = 5) -> DataFrame:
    """The last ``n`` entries of each key."""
    return logs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def final_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """State after all events: once cancelled, only cancelled and failed are taken."""
    story = F.transform(F.array_sort(F.collect_list(F.struct(order, "status"))), lambda e: e["status"])
    told = events.groupBy(key).agg(story.alias("_story"))
    step = lambda now, new: F.when((now == "cancelled") & ~new.isin("cancelled", "failed"), now).otherwise(new)
    return told.select(key, F.aggregate("_story", F.lit("pending"), step).alias("state"))


def unlocked(starts: DataFrame, key: str, at: str, seconds: int = 300) -> DataFrame:
    """Whether a start comes while the lock of the start before is younger than ``seconds``."""
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    gap = moment - F.lag(moment).over(Window.partitionBy(key).orderBy(at))
    return starts.withColumn("locked", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


def quiet_spells(changes: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Spells of changes with no gap over ``seconds``: first and last change, and how many."""
    w = Window.partitionBy(key).orderBy(at)
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce(moment - F.lag(moment).over(w) > int(seconds * 1_000_000), F.lit(True))
    spelled = changes.withColumn("_spell", F.sum(new.cast("int")).over(w))
    return spelled.groupBy(key, "_spell").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("changes")).drop("_spell")


def concurrency(spans: DataFrame, group: str, begin: str, end: str) -> DataFrame:
    """Most spans of a group open at once; an end at the moment of a begin comes first."""
    marks = spans.select(group, F.explode(F.array(F.struct(F.col(begin).alias("at"), F.lit(1).alias("by")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("by")))).alias("m")).select(group, "m.*")
    open_ = F.sum("by").over(Window.partitionBy(group).orderBy("at", "by").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("_open", open_).groupBy(group).agg(F.max("_open").alias("most"))


def backoff(attempt: Column, base: float = 2.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def progress_percent(done: Column, total: Column, start: int = 40, share: int = 40) -> Column:
    return F.lit(start) + F.floor(done / total * share)


def result_choice(kind: Column, workbook: Column, archive: Column, fallback: Column, size: Column) -> Column:
    """Which file a download asks for, and what is wrong with it; archives fall back on the older name."""
    path = F.when(kind == "excel", workbook).when(kind.isin("zip", "result_zip"), F.coalesce(archive, fallback))
    return F.struct(path.alias("path"), F.when(~kind.isin("excel", "zip", "result_zip"), "unsupported").when(path.isNull(), "missing").when(size == 0, "empty").otherwise("ok").alias("state"))


def ledger(requested: DataFrame, finished: DataFrame, key: str, seconds: str) -> DataFrame:
    """Completed keys in order with their times, as a batch resumes from."""
    return requested.join(finished, key).groupBy(key).agg(F.round(F.sum(seconds), 6).alias("seconds")).orderBy(key)
