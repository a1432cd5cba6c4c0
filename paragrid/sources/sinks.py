"""Publication: canonical JSON lines, safe CSV, tables that are there as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object with its keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("json"))


def csv_safe(value: Column) -> Column:
    """A text that no spreadsheet runs as a formula."""
    return F.when(value.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), value)).otherwise(value)


def _paths(spark: SparkSession, *names: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    paths = [hadoop.Path(n) for n in names]
    return paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), paths


def _move(df: DataFrame, target: str, write: Callable[[str], None]) -> None:
    mark = uuid.uuid4().hex
    write(f"{target}.{mark}")
    system, (place, new, aside) = _paths(df.sparkSession, target, f"{target}.{mark}", f"{target}.{mark}.old")
    held = system.exists(place)
    if held and not system.rename(place, aside):
        raise OSError(f"{target} could not be set aside")
    if not system.rename(new, place):
        if held:
            system.rename(aside, place)
        raise OSError(f"{target}.{mark} could not be moved to {target}")
    if held:
        system.delete(aside, True)


def publish(df: DataFrame, target: str, *partition: str) -> None:
    """Write a parquet table beside its target, then set the old one aside and move the new one in.

    A reader finds the old table, for the moment between the two moves none, or the new
    one, never a part; if the move fails the old one comes back.
    """
    _move(df, target, lambda path: df.write.partitionBy(*partition).parquet(path))


def publish_json_lines(df: DataFrame, target: str, *order: str) -> None:
    """Write canonical JSON lines, sorted within range-partitioned files, and move them to their target."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    _move(df, target, lambda path: canonical_json(rows).write.text(path))


def publish_once(df: DataFrame, target: str) -> bool:
    """Write a table that is never overwritten: false, and nothing is written, if the target is there already.

    Of two writers at once one wins, as the table moves in under its name in one step.
    """
    system, (place,) = _paths(df.sparkSession, target)
    if system.exists(place):
        return False
    new = f"{target}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    system, (place, written) = _paths(df.sparkSession, target, new)
    if system.exists(place) or not system.rename(written, place):
        system.delete(written, True)
        return False
    return True


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file below a folder, hidden ones left out: what a manifest pins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.rlike("^[._]")).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(then: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)`` between two inventories: added, missing or different."""
    old, new = then.select("path", F.col("sha256").alias("old")), now.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "different")
    return old.join(new, "path", "full").select("path", change.alias("change")).where("change is not null")


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row, with their number; empty for a sound table."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
