"""State kept over events: the same operators on tables and, where it says so, on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def latest_state(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last event of each key; the aggregation combines on the map side, so a hot key is no single task."""
    fields = F.struct(*(F.col(c) for c in events.columns))
    return events.groupBy(key).agg(F.max_by(fields, F.struct(*order)).alias("_last")).select("_last.*")


def windowed_counts(events: DataFrame, time: str, width: str, *by: str, late: str | None = None) -> DataFrame:
    """Rows and sums of ``value`` by time window and ``by``; ``late`` is a stream's watermark."""
    source = events.withWatermark(time, late) if late else events
    found = source.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """``(key, session, started, ended, n)``: runs of events with no gap over ``gap_seconds``."""
    order = W.partitionBy(key).orderBy(time, "event_id")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    fresh = F.coalesce((seconds(F.col(time)) - seconds(F.lag(time).over(order)) > gap_seconds).cast("int"), F.lit(1))
    numbered = events.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(order))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))


def newest(events: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The ``most`` newest rows of each key with their place; the limit is the feature."""
    return events.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("place") <= most)


def claim_order(items: DataFrame, host: str, *order: Column) -> DataFrame:
    """Queued items in the order a crawler claims them: by host in turn, within a host by ``order``."""
    turn = F.row_number().over(W.partitionBy(host).orderBy(*order)).cast("long")
    return items.withColumn("turn", turn)


def retries(events: DataFrame, key: str, time: str, failed: Column) -> DataFrame:
    """For each key: attempts, failures, the longest run of failures, and whether the last attempt failed."""
    order = W.partitionBy(key).orderBy(time, "event_id")
    marked = events.withColumn("_bad", failed.cast("int"))
    runs = marked.withColumn("_run", F.sum(1 - F.col("_bad")).over(order))
    longest = runs.groupBy(key, "_run").agg(F.sum("_bad").alias("_n"), F.count("*").alias("n"), F.max(F.struct(time, "event_id", "_bad")).alias("_last"))
    return longest.groupBy(key).agg(
        F.sum("n").alias("attempts"), F.sum("_n").alias("failures"), F.max("_n").alias("longest_run"),
        (F.max("_last")["_bad"] == 1).alias("ends_failed"),
    )


def running_totals(events: DataFrame, key: str) -> DataFrame:
    """A stream's running ``(key, n, total)``, kept as state for each key and given out with each batch it changes in."""
    shape = f"{key} {dict(events.dtypes)[key]}, n long, total double"

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame([(keys[0], n, total)], columns=[c.split()[0] for c in shape.split(", ")])

    return events.select(key, "value").groupBy(key).applyInPandasWithState(
        update, shape, "n long, total double", "update", GroupStateTimeout.NoTimeout
    )


def stream_of(spark: SparkSession, folder: str, name: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/{name}.parquet")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over all that is there, into parquet files with exactly-once checkpoints beside them."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/_checkpoint").option("path", f"{path}/data")
    query.trigger(availableNow=True).start().awaitTermination()
