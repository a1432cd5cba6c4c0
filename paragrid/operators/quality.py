"""Quality of parsed text: character classes, decisions, page coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS, CONTROL, MOJIBAKE, HANGUL = 20, 0.01, 0.005, 0.2


def _count(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]", "")).cast("long")


def block_metrics(blocks: DataFrame) -> DataFrame:
    """Character counts, table counts and order of each document's distinct blocks."""
    rows = blocks.select("document_id", "block_id", "block_type", "text", "reading_order").dropDuplicates(["document_id", "block_id"])
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.groupBy("document_id").agg(
        F.count("*").alias("block_count"),
        F.sum(F.length(text)).alias("total_chars"),
        F.sum(_count(text, "가-힣")).alias("hangul_chars"),
        F.sum(_count(text, "a-zA-Z가-힣")).alias("letter_chars"),
        F.sum(_count(text, r"\x{fffd}\x{e000}-\x{f8ff}")).alias("mojibake_chars"),
        F.count_if(F.col("block_type") == "table").alias("table_count"),
        F.count_if(F.col("block_type") == "table_cell").alias("table_cell_count"),
        (F.max("reading_order") + 1 == F.countDistinct("reading_order")).alias("contiguous"),
    )


def decision(metrics: DataFrame) -> DataFrame:
    """``decision`` and ``score`` of metrics rows: hard_fail, suspect or pass, and 100 less the deductions, never under 0."""
    ratio = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    hangul, mojibake = ratio("hangul_chars", "letter_chars"), ratio("mojibake_chars", "total_chars")
    hard = (F.col("total_chars") < MIN_CHARS) | (F.coalesce("control_ratio", F.lit(0.0)) > CONTROL)
    doubts = [
        (mojibake > MOJIBAKE, F.lit(35.0)), (F.coalesce("page_coverage", F.lit(1.0)) < 1.0, F.lit(30.0)),
        (~F.coalesce("contiguous", F.lit(True)), F.lit(20.0)), (hangul < HANGUL, (HANGUL - hangul) * 100),
    ]
    lost = sum((F.when(test, cost).otherwise(0.0) for test, cost in doubts), F.lit(0.0))
    suspect = doubts[0][0] | doubts[1][0] | doubts[2][0] | doubts[3][0]
    return metrics.withColumn("decision", F.when(hard, "hard_fail").when(suspect, "suspect").otherwise("pass")).withColumn(
        "score", F.when(hard, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 100.0 - lost), 3))
    )
