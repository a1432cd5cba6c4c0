"""Claims against the texts they cite: containment, shared terms, facts, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import text
from paragrid.operators.retrieval import overlap

LEAST_SHARE = 0.4


def claim_sources(cases: DataFrame) -> DataFrame:
    """``(id, claim, place, chunk_id, source)``: a row for each claim and source; a claim without sources has none."""
    rows = cases.select("id", "claim", "sources").dropDuplicates(["id"])
    return rows.select("id", "claim", F.posexplode("sources").alias("place", "s")).select(
        "id", "claim", F.col("place").cast("long").alias("place"), F.col("s.chunk_id").alias("chunk_id"), F.col("s.text").alias("source")
    )


def support(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``contained``, ``share`` of the claim's terms in the source, and ``facts_missing``."""
    folded = F.contains(text.rank_form(F.col("source")), text.rank_form(F.col("claim")))
    share = F.round(overlap(text.terms(F.col("claim")), text.terms(F.col("source"))), 6)
    missing = F.size(F.array_except(text.critical_values(F.col("claim")), text.critical_values(F.col("source")))).cast("long")
    return pairs.withColumn("contained", folded).withColumn("share", share).withColumn("facts_missing", missing)


def attribute(supported: DataFrame, keep: int = 2) -> DataFrame:
    """The ``keep`` best sources of each claim: contained ones first, then by share and place; with ``accepted``.

    A source is accepted if the claim stands in it, or shares enough terms and misses no fact.
    """
    accepted = F.col("contained") | ((F.col("share") >= LEAST_SHARE) & (F.col("facts_missing") == 0))
    order = W.partitionBy("id").orderBy(F.desc(F.col("contained").cast("int")), F.desc("share"), "place")
    ranked = supported.withColumn("accepted", accepted).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= keep)


def reasons(cases: DataFrame, attributed: DataFrame) -> DataFrame:
    """``(id, supported, reason)`` of every claim."""
    best = attributed.groupBy("id").agg(F.max("accepted").alias("accepted"), F.max("share").alias("share"), F.min("facts_missing").alias("missing"))
    rows = cases.select("id").distinct().join(best, "id", "left")
    reason = (
        F.when(F.col("share").isNull(), "no_source").when(F.col("accepted"), "supported")
        .when(F.col("share") < LEAST_SHARE, "low_lexical_overlap").otherwise("critical_value_mismatch")
    )
    return rows.select("id", F.coalesce("accepted", F.lit(False)).alias("supported"), reason.alias("reason"))
