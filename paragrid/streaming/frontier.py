"""The state of a queue of work over its event log: transitions, claims, delays, budgets, resumption, tombstones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Which event leads to which state, and from which states it may come ("" before the first event).
TRANSITIONS = {
    "enqueue": ("queued", ("",)), "claim": ("fetching", ("queued",)), "finish": ("done", ("fetching",)), "fail": ("error", ("fetching", "queued")),
    "requeue": ("queued", ("error", "fetching")), "refresh": ("queued", ("done", "error")),
}


def _state_of(event: Column) -> Column:
    return reduce(lambda rest, kv: F.when(event == kv[0], F.lit(kv[1][0])).otherwise(rest), TRANSITIONS.items(), F.lit(None).cast("string"))


def enqueued(queue: DataFrame, found: DataFrame, key: str, *order: Column) -> DataFrame:
    """The rows of ``found`` that are new: not in the queue yet, the first of each key."""
    fresh = found.join(queue.select(key).distinct(), key, "left_anti")
    fields = F.struct(*(F.col(c) for c in found.columns))
    return fresh.groupBy(key).agg(F.min_by(fields, F.struct(*order)).alias("_f")).select("_f.*")


def transitions(events: DataFrame, key: str, event: str, *order: str) -> DataFrame:
    """``events`` with ``state`` after each, ``before``, and whether the step was ``allowed``.

    Each event sets the state of its key, allowed or not, as a log is a record of what
    happened; an event of another kind leaves it as it is.
    """
    window = W.partitionBy(key).orderBy(*order)
    state = _state_of(F.col(event))
    marked = events.withColumn("state", F.last(state, ignorenulls=True).over(window))
    before = F.coalesce(F.lag("state").over(window), F.lit(""))
    allowed = reduce(lambda rest, kv: F.when(F.col(event) == kv[0], F.col("before").isin(*kv[1][1])).otherwise(rest), TRANSITIONS.items(), F.lit(True))
    return marked.withColumn("before", before).withColumn("allowed", allowed)


def final_states(events: DataFrame, key: str, event: str, *order: str) -> DataFrame:
    """``(key, state, attempts, failures)`` at the end of the log; no window, so a hot key is combined where it lies."""
    known = events.where(F.col(event).isin(*TRANSITIONS))
    last = F.max_by(_state_of(F.col(event)), F.struct(*order))
    return known.groupBy(key).agg(last.alias("state"), F.count_if(F.col(event) == "claim").alias("attempts"), F.count_if(F.col(event) == "fail").alias("failures"))


def claimed(items: DataFrame, n: int, *order: Column) -> DataFrame:
    """The next ``n`` items to work on; the number is the feature."""
    return items.orderBy(*order).limit(n)


def paced(items: DataFrame, host: str, seconds: Column, delay: float, *order: Column) -> DataFrame:
    """``items`` with ``start`` (seconds): not before their time, and ``delay`` after the start of the one before at their host."""
    window = W.partitionBy(host).orderBy(*order)
    place = F.row_number().over(window) - 1
    earliest = F.max(F.col("_s") - F.col("_n") * delay).over(window.rowsBetween(W.unboundedPreceding, 0))
    return items.withColumn("_s", seconds).withColumn("_n", place).withColumn("start", earliest + F.col("_n") * delay).drop("_s", "_n")


def within_budget(items: DataFrame, group: str, size: Column, most_items: int, most_size: int, *order: Column) -> DataFrame:
    """``items`` with ``taken``: whether the group's number and total size still allow them, in order."""
    window = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.coalesce(size, F.lit(0))).over(window)
    return items.withColumn("taken", (F.count("*").over(window) <= most_items) & (total <= most_size))


def resumed(log: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """The work that a log does not have yet, so that a run goes on where it ended."""
    return work.join(log.select(key).distinct(), key, "left_anti")


def ledger(entries: DataFrame, key: str, kind: str, amount: str, cap: float) -> DataFrame:
    """``(key, reserved, finished, open, spent, over_cap, sound)`` of a ledger of reservations ("reserve") and ends ("finish"); a seal ends an account."""
    count = lambda k: F.count_if(F.col(kind) == k)
    made = entries.groupBy(key).agg(count("reserve").alias("reserved"), count("finish").alias("finished"), count("seal").alias("seals"), F.round(F.coalesce(F.sum(F.when(F.col(kind) == "finish", F.col(amount))), F.lit(0.0)), 6).alias("spent"))
    unfinished = F.col("reserved") - F.col("finished")
    return made.select(key, "reserved", "finished", unfinished.alias("open"), "spent", (F.col("spent") > cap).alias("over_cap"), ((unfinished >= 0) & (F.col("seals") <= 1)).alias("sound"))


def live_items(changes: DataFrame, key: str, kind: str, token: str, *order: str) -> DataFrame:
    """``(key, live, token)`` after all changes: a "delete" leaves a tombstone with its token, a "restore" counts only with the last tombstone's token, an "upsert" only on what is not deleted."""
    window = W.partitionBy(key).orderBy(*order)
    tomb = F.last(F.when(F.col(kind) == "delete", F.col(token)), ignorenulls=True).over(window)
    marked = changes.withColumn("_tomb", tomb)
    held = marked.withColumn("_lives", F.when(F.col(kind) == "delete", False).when((F.col(kind) == "restore") & (F.col(token) == F.col("_tomb")), True).when((F.col(kind) == "upsert") & F.col("_tomb").isNull(), True))
    last = F.struct(*order)
    return held.groupBy(key).agg(F.coalesce(F.max_by("_lives", F.when(F.col("_lives").isNotNull(), last)), F.lit(False)).alias("live"), F.max_by("_tomb", last).alias("token"))


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """A stream's first row of each key within the watermark, on tables simply one row of each key."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])
