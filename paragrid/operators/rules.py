"""Small generic operators: rules as data, caller's order, multisets, samples, vector checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule (name, term) whose term the text holds: whole words for Latin terms, any place else; null if none."""
    folded = F.lower(text)

    def holds(term: str) -> Column:
        return folded.rlike(rf"(^|[^a-z0-9]){term}($|[^a-z0-9])") if term.isascii() else F.contains(folded, F.lit(term))

    return F.coalesce(*(F.when(holds(term.lower()), F.lit(name)) for name, term in rules))


def in_order(asked: DataFrame, ids: str, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` for each list of ids, with ``place``: the first place of the id in its list. Unknown ids have no row."""
    places = asked.select(*(c for c in asked.columns if c != ids), F.posexplode(F.array_distinct(ids)).alias("place", key))
    return places.join(rows, key)


def multiset_difference(rows: DataFrame, group: str, value: str, after: Column) -> DataFrame:
    """For each group how many values are kept, deleted and added from before to ``after``, copies counted."""
    counted = rows.groupBy(group, value).agg(F.count_if(after).alias("b"), F.count_if(~after).alias("a"))
    return counted.groupBy(group).agg(
        F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("deleted"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"),
    )


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows, the same for the same seed anywhere; the limit is the feature."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed + "\0"), key.cast("string")), 256), key).limit(n)


def balanced_assignment(rows: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """``rows`` with ``first_arm``: A or B in turn by a seeded order within each stratum."""
    order = W.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(seed + "\0"), F.col(key)), 256), key)
    return rows.withColumn("first_arm", F.when(F.row_number().over(order) % 2 == 1, "A").otherwise("B"))


def vector_report(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """Rows, sizes, vectors with values that are no numbers, and the range of lengths."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(F.size(vector)).cast("long").alias("least_size"), F.max(F.size(vector)).cast("long").alias("most_size"),
        F.count_if(bad).alias("bad"), F.round(F.min(norm), 5).alias("least_norm"), F.round(F.max(norm), 5).alias("most_norm"),
    )
