"""Corpus curation: latest versions, duplicates, quotas, rejects, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.session import materialize

#: Hashes of repeated keys that are sent to all tasks at once.
REPEATED = 1_000_000


def least(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, with the least value of each other column.

    Only rows whose key's hash stands more than once are exchanged; the others stay where they are read.
    Over ``REPEATED`` such hashes all rows are grouped.
    """
    mark = F.xxhash64(key)
    repeated = materialize(rows.groupBy(mark.alias("_mark")).agg(F.count("*").alias("_n")).where("_n > 1").select("_mark"))
    merged = lambda df: df.groupBy(key).agg(*(F.min(c).alias(c) for c in rows.columns if c != key)).select(*rows.columns)
    if repeated.count() > REPEATED:
        return merged(rows)
    marked, held = rows.withColumn("_mark", mark), F.broadcast(repeated)
    once = marked.join(held, "_mark", "left_anti").select(*rows.columns)
    return once.unionByName(merged(marked.join(held, "_mark", "left_semi")))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``; exact copies count once."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.dropDuplicates().withColumn("_n", place).where("_n = 1").drop("_n")


def duplicates(rows: DataFrame, group: Column, *order: Column, winner: str) -> DataFrame:
    """``rows`` with ``duplicate_of``: null for the best row of a group, else the best one's ``winner`` column.

    A null group has no duplicates.
    """
    window = W.partitionBy("_group").orderBy(*order)
    marked = rows.withColumn("_group", group)
    best = F.first(winner).over(window)
    other = F.when(F.col("_group").isNotNull() & (F.row_number().over(window) > 1), best)
    return marked.withColumn("duplicate_of", other).drop("_group")


def host_quota(rows: DataFrame, limits: DataFrame, host: str, limit: str, *order: Column) -> DataFrame:
    """``rows`` with ``place`` among their host's rows and ``kept``: within the host's limit (all, where it has none)."""
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(host).orderBy(*order)).cast("long"))
    return placed.join(limits, host, "left").withColumn("kept", F.col(limit).isNull() | (F.col("place") <= F.col(limit)))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules))


def contiguity(rows: DataFrame, group: str, order: str) -> DataFrame:
    """For each group: rows, distinct places, gaps and repeats of a number that should run from 0 without gaps."""
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.countDistinct(order).alias("places"),
        (F.max(order) + 1 - F.countDistinct(order)).cast("long").alias("gaps"), (F.count("*") - F.countDistinct(order)).alias("repeats"),
    )


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows of ``children`` whose key no row of ``parents`` has; null keys are orphans."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def budget_prefix(rows: DataFrame, group: str, size: Column, budget: int, *order: Column) -> DataFrame:
    """Rows in order as long as their sizes fit the budget; the row that crosses it keeps what is left of it."""
    window = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("_size").over(window) - F.col("_size")
    used = rows.withColumn("_size", size).withColumn("_before", before).where(F.col("_before") < budget)
    return used.withColumn("taken", F.least("_size", budget - F.col("_before")).cast("long")).drop("_size", "_before")
