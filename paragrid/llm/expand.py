"""Joins that expand groups of any size: a large group's rows are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one group that meet the other side in one task.
ROWS = 2_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], item: str) -> DataFrame:
    """``left`` joined with ``right`` on ``on``; a key with over ``ROWS`` rows of ``right`` is salted by ``item``.

    Its rows on the left are repeated for each part, so that a task holds ``ROWS`` rows of a
    key on one side. The result is that of a plain join.
    """
    sizes = right.groupBy(*on).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_parts")).where("_parts > 1")
    if sizes.isEmpty():
        return left.join(right, on)
    parts = F.coalesce("_parts", F.lit(1))
    repeated = left.join(sizes, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    placed = right.join(sizes, on, "left").withColumn("_part", F.pmod(F.xxhash64(item), parts).cast("int")).drop("_parts")
    return repeated.join(placed, [*on, "_part"]).drop("_part")
