"""Retrieval measures, agreement, votes and exact tests, as aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_hit(ranked: DataFrame, gold: DataFrame, query: str, key: str) -> DataFrame:
    """``(query, hit_rank)`` for every query of ``gold``: the best rank of a gold row, null if none is ranked."""
    met = ranked.join(gold, [query, key]).groupBy(query).agg(F.min("rank").alias("hit_rank"))
    return gold.select(query).distinct().join(met, query, "left")


def hit_rates(hits: DataFrame, *by: str) -> DataFrame:
    """Queries, hits at 1, 5 and 10 and the mean reciprocal rank; a query without a hit counts 0."""
    at = lambda k: F.round(F.avg(F.coalesce((F.col("hit_rank") <= k).cast("double"), F.lit(0.0))), 6)
    return hits.groupBy(*by).agg(
        F.count("*").alias("queries"), at(1).alias("hit_1"), at(5).alias("hit_5"), at(10).alias("hit_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def rank_changes(before: DataFrame, after: DataFrame, query: str, key: str) -> DataFrame:
    """``(query, gained, lost, moved, kept)`` between two ranked lists of each query."""
    a, b = before.select(query, key, F.col("rank").alias("a")), after.select(query, key, F.col("rank").alias("b"))
    both = a.join(b, [query, key], "full")
    return both.groupBy(query).agg(
        F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("b").isNull()).alias("lost"),
        F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count_if(F.col("a") == F.col("b")).alias("kept"),
    )


def confusion(rows: DataFrame, actual: Column, predicted: Column, *by: str) -> DataFrame:
    """Counts of the four outcomes, accuracy, balanced accuracy and F1; an undefined rate is null."""
    a, p = F.coalesce(actual, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counted = rows.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    share = lambda x, y: F.when(y > 0, x / y)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counted.withColumn("accuracy", F.round(share(tp + tn, tp + fp + fn + tn), 6))
        .withColumn("balanced", F.round((share(tp, tp + fn) + share(tn, tn + fp)) / 2, 6))
        .withColumn("f1", F.round(share(2 * tp, 2 * tp + fp + fn), 6))
    )


def kappa(rows: DataFrame, left: Column, right: Column, weights: str = "none", levels: int = 2) -> DataFrame:
    """One row ``(n, agreement, kappa)`` of two labels; ``weights`` "quadratic" for ordered labels 0 to levels-1.

    Only rows with both labels count; kappa is null where chance agreement is complete or nothing
    counts. One aggregation: with quadratic weights chance follows from the labels' first two
    moments, without weights from the products of the margins.
    """
    pairs = rows.select(left.alias("l"), right.alias("r")).where("l is not null and r is not null").groupBy("l", "r").agg(F.count("*").alias("n"))
    total = F.sum("n")
    if weights == "quadratic":
        scale = F.lit(float((levels - 1) ** 2))
        mean = lambda x: F.sum(F.col("n") * x) / total
        l, r = F.col("l").cast("double"), F.col("r").cast("double")
        found = pairs.agg(
            total.alias("n"), (1 - mean((l - r) * (l - r)) / scale).alias("po"),
            (1 - (mean(l * l) - 2 * mean(l) * mean(r) + mean(r * r)) / scale).alias("pe"),
        )
    else:
        # Each label's three sums: how often both gave it, the left one, the right one.
        sides = F.inline(F.array(
            F.struct(F.col("l").alias("v"), F.when(F.col("l") == F.col("r"), F.col("n")).otherwise(0).alias("both"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")),
            F.struct(F.col("r").alias("v"), F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")),
        ))
        margins = pairs.select(sides).groupBy("v").agg(*(F.sum(c).alias(c) for c in ("both", "a", "b")))
        whole = F.sum("a").cast("double")
        found = margins.agg(F.sum("a").alias("n"), (F.sum("both") / whole).alias("po"), (F.sum(F.col("a").cast("double") * F.col("b")) / (whole * whole)).alias("pe"))
    value = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return found.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round("po", 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def unique_mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, mode, votes)``: the most frequent value, null if two are as frequent."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    top = counted.groupBy(group).agg(F.max("n").alias("votes"))
    best = counted.join(top, group).where("n = votes").groupBy(group).agg(F.min(value).alias("_v"), F.count("*").alias("_ties"), F.max("votes").alias("votes"))
    return best.select(group, F.when(F.col("_ties") == 1, F.col("_v")).alias("mode"), "votes")


def strict_majority(yes: Column, total: Column) -> Column:
    """True or false by more than half of the votes, null if they are even."""
    return F.when(yes * 2 > total, True).when(yes * 2 < total, False)


def exact_mcnemar(gained: Column, lost: Column) -> Column:
    """The two-sided binomial probability of the discordant pairs; 1 if there are none.

    The tail's largest term comes from a sum of logarithms and the others as ratios to
    it, so nothing underflows however many pairs there are.
    """
    n, least = (gained + lost).cast("double"), F.least(gained, lost).cast("int")
    steps = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    largest = F.aggregate(steps, -n * math.log(2), lambda s, i: s + F.log((n - i + 1) / i))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(held: Column, i: Column) -> Column:
        term = held["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (held["total"] + term).alias("total"))

    tail = F.exp(largest) * F.aggregate(F.reverse(steps), start, down)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(rows: DataFrame, p: str) -> DataFrame:
    """``rows`` (one family of tests) with ``p_holm``: the step-down adjusted probability."""
    order = W.orderBy(p)  # a family of tests: a few rows
    scaled = F.least(F.lit(1.0), (F.count("*").over(W.partitionBy()) - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def _flipped_sums(deltas: DataFrame, group: str, delta: str, place: str, draws: int, seed: int) -> DataFrame:
    """``(group, sums)``: for each group the sums of its deltas under ``draws`` random choices of signs.

    Each row's signs come from its place and the seed, each task sends one vector for a group it holds.
    """
    shape = f"{group} {dict(deltas.dtypes)[group]}, total double, sums array<double>"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for name, value, at in zip(frame[group], frame[delta], frame[place]):
                signs = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, int(at)])).integers(0, 2, draws, dtype=np.int8)
                total, sums = held.get(name, (0.0, np.zeros(draws)))
                held[name] = total + value, sums + np.where(signs == 1, value, -value)
        yield pd.DataFrame([(k, t, v.tolist()) for k, (t, v) in held.items()], columns=[group, "total", "sums"])

    parts = deltas.select(group, delta, place).mapInPandas(add, shape)
    each = parts.select(group, "total", F.posexplode("sums").alias("draw", "sum"))
    return each.groupBy(group, "draw").agg(F.sum("total").alias("total"), F.sum("sum").alias("sum"))


def sign_flip(deltas: DataFrame, group: str, delta: str, most: int = 20, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """``(group, n, p)``: the sign-flip probability of the sum of each group's deltas other than 0.

    Up to ``most`` deltas all choices of signs are counted; beyond that ``draws`` random ones give
    (hits + 1) / (draws + 1). A group without such deltas has the probability 1. Null deltas do not count.
    """
    rows = deltas.where(F.col(delta).isNotNull())
    sizes = rows.groupBy(group).agg(F.count_if(F.col(delta) != 0).alias("n"))
    other = rows.where(F.col(delta) != 0).join(sizes, group)
    held = other.where(F.col("n") <= most).groupBy(group).agg(F.collect_list(delta).alias("d"))  # at most ``most`` values
    flips = held.select(group, "d", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("d")).cast("int") - 1)).alias("m"))
    signed = F.aggregate(
        F.sequence(F.lit(0), F.size("d") - 1), F.lit(0.0), lambda s, i: s + F.when(F.getbit("m", i) == 1, -1.0).otherwise(1.0) * F.get("d", i)
    )
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    hit = (F.abs(signed) >= F.abs(total) - 1e-9).cast("double")
    exact = flips.groupBy(group).agg(F.avg(hit).alias("p"))
    many = other.where(F.col("n") > most).withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(delta)))
    drawn = _flipped_sums(many, group, delta, "_at", draws, seed).groupBy(group)
    random = drawn.agg(((F.count_if(F.abs("sum") >= F.abs("total") - 1e-9) + 1) / (F.count("*") + 1)).alias("p"))
    found = exact.unionByName(random)
    return sizes.join(found, group, "left").select(group, "n", F.round(F.coalesce("p", F.lit(1.0)), 9).alias("p"))


def cluster_bootstrap(deltas: DataFrame, group: str, cluster: str, delta: str, iterations: int = 10_000) -> DataFrame:
    """``(group, mean, low, high)``: percentile interval of the mean over clusters drawn anew by a hash."""
    means = deltas.groupBy(group, cluster).agg(F.sum(delta).alias("s"), F.count(delta).alias("c"))
    number = F.row_number().over(W.partitionBy(group).orderBy(cluster)) - 1
    placed = means.withColumn("i", number.cast("long")).withColumn("m", F.count("*").over(W.partitionBy(group)))
    sizes = placed.groupBy(group).agg(F.max("m").alias("m"))
    draws = sizes.select(group, "m", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b")).select(
        group, "m", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j")
    )
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long")
    picked = draws.select(group, "b", F.pmod(number, "m").alias("i")).join(placed.select(group, "i", "s", "c"), [group, "i"])
    drawn = picked.groupBy(group, "b").agg((F.sum("s") / F.sum("c")).alias("v"))
    ends = drawn.groupBy(group).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    mean = means.groupBy(group).agg((F.sum("s") / F.sum("c")).alias("mean"))
    return mean.join(ends, group).select(group, F.round("mean", 6).alias("mean"), F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))
