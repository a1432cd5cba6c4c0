"""Reports of runs: conditions, repeats, strata, lanes, bounds, paired tests, causes, guards, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.operators import evaluation

SIX = 6


def question_means(rows: DataFrame, case: str, arm: str, score: str) -> DataFrame:
    """``(case, arm, mean, runs)``: a question's mean over its repeats; null scores do not count."""
    return rows.groupBy(case, arm).agg(F.round(F.avg(score), SIX).alias("mean"), F.count(score).alias("runs"))


def condition_summary(rows: DataFrame, case: str, arm: str, run: str, score: str) -> DataFrame:
    """One row of each arm: questions, the mean of question means, and the spread of the means of runs.

    Repeats of a question never count as more questions.
    """
    by_case = rows.groupBy(arm, case).agg(F.avg(score).alias("m")).groupBy(arm).agg(F.count("m").alias("questions"), F.round(F.avg("m"), SIX).alias("mean"), F.round(F.min("m"), SIX).alias("least"), F.round(F.max("m"), SIX).alias("most"))
    by_run = rows.groupBy(arm, run).agg(F.avg(score).alias("m")).groupBy(arm).agg(F.count("m").alias("runs"), F.round(F.min("m"), SIX).alias("worst_run"), F.round(F.max("m"), SIX).alias("best_run"), F.round(F.stddev_pop("m"), SIX).alias("spread"))
    return by_case.join(by_run, arm)


def score_histogram(rows: DataFrame, arm: str, score: Column, values: list[int]) -> DataFrame:
    """A row of each arm with the number of rows of each score as ``score_n``, and of those without as ``score_none``."""
    counted = [F.count_if(score == v).alias(f"score_{v}") for v in values]
    return rows.groupBy(arm).agg(*counted, F.count_if(score.isNull()).alias("score_none"))


def slot_bounds(rows: DataFrame, by: str, passed: Column, failed: Column) -> DataFrame:
    """Planned, valid and failed slots, the rate of the valid ones, and its bounds if every unknown outcome were bad or good."""
    good = F.count_if(passed & ~failed)
    unknown = F.count_if(passed.isNull() | failed)
    n = F.count("*")
    return rows.groupBy(by).agg(
        n.alias("planned"), (n - unknown).alias("valid"), F.count_if(failed).alias("errors"),
        F.round(F.when(n > unknown, good / (n - unknown)), SIX).alias("rate"), F.round(good / n, SIX).alias("lower"), F.round((good + unknown) / n, SIX).alias("upper"),
    )


def repeat_votes(rows: DataFrame, case: str, arm: str, vote: Column) -> DataFrame:
    """``(case, arm, yes, total, verdict, agreement)``: the strict majority of the repeats (null if even), and the share of the greater side."""
    held = rows.where(vote.isNotNull()).groupBy(case, arm).agg(F.count_if(vote).alias("yes"), F.count("*").alias("total"))
    side = F.greatest(F.col("yes"), F.col("total") - F.col("yes"))
    return held.withColumn("verdict", evaluation.strict_majority(F.col("yes"), F.col("total"))).withColumn("agreement", F.round(side / F.col("total"), SIX))


def paired(rows: DataFrame, case: str, family: str, arm: str, score: str, vote: str, left: str, right: str) -> DataFrame:
    """One row of two arms: questions, delta of question means, wins and losses, the sign-flip test on family sums, and McNemar's on majority votes.

    A family gets one sign; only questions that both arms answered count.
    """
    cut = rows.groupBy(case, family).agg(*(F.avg(F.when(F.col(arm) == a, F.col(score))).alias(n) for a, n in ((left, "a"), (right, "b"))), *(
        evaluation.strict_majority(F.count_if((F.col(arm) == a) & F.col(vote)), F.count(F.when(F.col(arm) == a, F.col(vote)))).alias(n) for a, n in ((left, "va"), (right, "vb"))
    )).where("a is not null and b is not null").withColumn("delta", F.round(F.col("b") - F.col("a"), SIX))
    one = F.lit("all").alias("_all")
    sums = cut.groupBy(family).agg(F.round(F.sum("delta"), SIX).alias("d")).select("d", one)
    flips = evaluation.sign_flip(sums, "_all", "d").select("_all", F.col("n").alias("families"), F.col("p").alias("p_families"))
    totals = cut.agg(
        F.count("*").alias("questions"), F.round(F.avg("delta"), SIX).alias("delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"),
        F.count_if(F.col("vb") & ~F.col("va")).alias("gained"), F.count_if(F.col("va") & ~F.col("vb")).alias("lost"),
    )
    tested = totals.withColumn("p_mcnemar", F.round(evaluation.exact_mcnemar(F.col("gained"), F.col("lost")), 9)).withColumn("_all", F.lit("all"))
    return tested.join(flips, "_all").drop("_all")


def causes(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, in order; a null rule does not hold."""
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules)), lambda c: c.isNotNull())


def cause_counts(rows: DataFrame, by: str, found: str) -> DataFrame:
    """``(by, cause, rows, first)``: how many rows have a cause, and how many have it first; "none" for rows without any."""
    each = rows.select(by, F.posexplode(F.when(F.size(found) > 0, F.col(found)).otherwise(F.array(F.lit("none")))).alias("n", "cause"))
    return each.groupBy(by, "cause").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("first"))


def strata(hits: DataFrame, *fields: str) -> DataFrame:
    """``(field, value, questions, unevaluable, hit_5, mrr)`` by each field and over all; unevaluable questions leave the denominators.

    ``hits`` (hit_rank, evaluable and the fields).
    """
    whole = hits.select("hit_rank", "evaluable", F.explode(F.array(F.struct(F.lit("all").alias("field"), F.lit("all").alias("value")), *(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("none")).alias("value")) for f in fields))).alias("f"))
    rank = F.when(F.col("evaluable"), F.coalesce(F.col("hit_rank"), F.lit(1_000_000)))
    return whole.groupBy("f.field", "f.value").agg(
        F.count_if("evaluable").alias("questions"), F.count_if(~F.col("evaluable")).alias("unevaluable"),
        F.round(F.avg((rank <= 5).cast("double")), SIX).alias("hit_5"), F.round(F.avg(F.when(rank < 1_000_000, 1 / rank).when(rank.isNotNull(), 0.0)), SIX).alias("mrr"),
    )


def lanes(hits: dict[str, DataFrame]) -> DataFrame:
    """``(lane, metric, value)``: hits at 1, 5, 10 and the mean reciprocal rank of several lanes."""
    rows = reduce(lambda a, b: a.unionByName(b), (h.select(F.lit(n).alias("lane"), "hit_rank") for n, h in hits.items()))
    rates = evaluation.hit_rates(rows, "lane")
    return rates.unpivot(["lane"], ["hit_1", "hit_5", "hit_10", "mrr"], "metric", "value")


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Number, sum, mean, median, least and most of a value, and how many are 0 and 1."""
    return rows.groupBy(by).agg(
        F.count(value).alias("n"), F.round(F.sum(value), SIX).alias("total"), F.round(F.avg(value), SIX).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), SIX).alias("median"),
        F.round(F.min(value), SIX).alias("least"), F.round(F.max(value), SIX).alias("most"), F.count_if(F.col(value) == 0).alias("zeros"), F.count_if(F.col(value) == 1).alias("ones"),
    )


def join_faults(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of what keeps two tables from being joined one to one: missing and extra keys, keys that repeat on either side."""
    a, b = (t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((left, "_a"), (right, "_b")))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a") > 1).alias("left_repeats"), F.count_if(F.col("_b") > 1).alias("right_repeats"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("matched"),
    )


def key_stats(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``(artifact, records, unique, missing, duplicates)`` of a table's key."""
    return rows.agg(F.lit(name).alias("artifact"), F.count("*").alias("records"), F.countDistinct(key).alias("unique"), F.count_if(F.col(key).isNull()).alias("missing"), (F.count(key) - F.countDistinct(key)).alias("duplicates"))


def schedule(cases: DataFrame, case: str, arms: list[str], repeats: int, seed: str) -> DataFrame:
    """``(slot, case, arm, repeat, place)``: every case in every arm as often as asked, arms in a seeded order for each case and repeat."""
    grid = cases.select(case).distinct().withColumn("arm", F.explode(F.array(*map(F.lit, arms)))).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    parts = F.concat_ws("|", F.lit(seed), F.col(case).cast("string"), F.col("repeat").cast("string"), "arm")
    marked = grid.withColumn("slot", F.substring(F.sha2(parts, 256), 1, 16))
    return marked.withColumn("place", F.row_number().over(W.partitionBy(case, "repeat").orderBy("slot")).cast("long"))


def audit(planned: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``state``: done, missing (planned only), unplanned (done only), repeated (done more than once)."""
    a = planned.select(*keys).distinct().withColumn("_p", F.lit(True))
    b = done.groupBy(*keys).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_p").isNull(), "unplanned").when(F.col("_n") > 1, "repeated").otherwise("done")
    return a.join(b, list(keys), "full").groupBy(state.alias("state")).agg(F.count("*").alias("slots"))


def guarded(score: Column, *rules: tuple[str, Column, int]) -> tuple[Column, Column]:
    """A judge's score after the rules ``(name, test, most)`` that cap it, and the names of the rules that took something away."""
    capped = reduce(lambda s, r: F.when(F.coalesce(r[1], F.lit(False)), F.least(s, F.lit(r[2]))).otherwise(s), rules, score)
    used = causes(*((name, test & (score > most)) for name, test, most in rules))
    return capped, used


def violations(name: str, rows: DataFrame) -> DataFrame:
    """``(rule, violations)``: the rows that break a rule, counted."""
    return rows.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
