"""Queries of parsing and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.sources import parsing, sinks
from paragrid.sources.tables import spread, table


def html_blocks(spark, folder):
    rows = spread(table(spark, folder, "documents").select("doc_id", "title", "text"))
    page = F.concat(
        F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><p>"),
        F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"),
    )
    blocks = parsing.parse(rows.select(F.col("doc_id").cast("string").alias("document_id"), F.encode(page, "utf-8").alias("content")), "native/html")
    return blocks.groupBy("block_type").agg(F.count("*").alias("blocks"), F.countDistinct("document_id").alias("documents"))


def csv_safe_values(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", sinks.csv_safe(F.col("text")).alias("value"))
    return rows.select("doc_id", F.md5("value").alias("mark"))


def duplicate_keys(spark, folder):
    return sinks.unique_key(table(spark, folder, "chunks"), "chunk_id").select("chunk_id", "n")


def parse_choice(spark, folder):
    metrics = table(spark, folder, "quality_metrics").select("document_id", "decision", "score", F.col("non_whitespace_chars").alias("characters"))
    runs = table(spark, folder, "parsed_documents").select("document_id", "parser", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("attempt")).join(metrics, "document_id")
    return parsing.best_attempt(runs).select("document_id", "parser", "attempt", "decision")


QUERIES = {f.__name__: f for f in (html_blocks, csv_safe_values, duplicate_keys, parse_choice)}

SQL = {
    "csv_safe_values": r"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^[=+@\t\r-]') THEN '''' || text ELSE text END) AS mark FROM documents",
    "duplicate_keys": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "parse_choice": """SELECT document_id, parser, attempt, decision FROM (SELECT document_id, parser, epoch_us(ingested_at) AS attempt, decision, row_number() OVER (PARTITION BY document_id
        ORDER BY CASE WHEN decision = 'pass' THEN 1 ELSE 0 END DESC, CASE WHEN decision = 'pass' THEN -epoch_us(ingested_at) ELSE 0 END DESC, score DESC, non_whitespace_chars DESC) AS n
        FROM parsed_documents JOIN quality_metrics USING (document_id)) WHERE n = 1""",
}
