"""Queries of curation, integrity, quality, chunking and context."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import text, urls
from paragrid.operators import chunking, curation, quality
from paragrid.sources.tables import table


def _parsed(spark, folder):
    return table(spark, folder, "parsed_documents")


def _chunks(spark, folder):
    return table(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", "institution", "source_host", "page_start", "page_end", "section_path_json", "text").distinct()


def latest_ingest(spark, folder):
    rows = curation.latest(_parsed(spark, folder), "document_id", F.desc("ingested_at"), F.col("status"))
    return rows.select("document_id", "status", "parser", "size_bytes", "ingested_at")


def late_arrivals(spark, folder):
    rows = _parsed(spark, folder).select("document_id", "institution", F.floor((F.unix_micros("ingested_at") - F.unix_micros("fetched_at")) / 86_400_000_000).alias("days"))
    return rows.groupBy("institution").agg(F.count("*").alias("documents"), F.count_if(F.col("days") >= 7).alias("late"), F.max("days").alias("most_days"))


def canonical_dedupe(spark, folder):
    rows = curation.latest(_parsed(spark, folder), "document_id", F.desc("ingested_at"), F.col("status"))
    marked = curation.duplicates(rows, urls.canonical(F.col("source_url")), F.col("fetched_at"), F.col("document_id"), winner="document_id")
    return marked.select("document_id", "duplicate_of")


def exact_dedupe_sha(spark, folder):
    rows = _parsed(spark, folder).select("document_id", "source_sha256", "ingested_at").distinct()
    marked = curation.duplicates(rows, F.col("source_sha256"), F.col("ingested_at"), F.col("document_id"), winner="document_id")
    return marked.groupBy(F.col("duplicate_of").isNotNull().alias("is_duplicate")).agg(F.count("*").alias("rows"))


def host_quota(spark, folder):
    hosts = table(spark, folder, "chunks").groupBy("document_id").agg(F.min(F.lower("source_host")).alias("source_host")).where("source_host is not null")
    rows = curation.latest(_parsed(spark, folder), "document_id", F.desc("ingested_at"), F.col("status")).select("document_id", "file_extension", "size_bytes").join(hosts, "document_id")
    limits = table(spark, folder, "source_hosts").select("source_host", "max_items_per_host")
    page = F.when(F.col("file_extension") == ".html", 1).otherwise(0)
    kept = curation.host_quota(rows, limits, "source_host", "max_items_per_host", page, F.col("document_id"))
    return kept.select("document_id", "source_host", "place", "kept")


def reject_reasons(spark, folder):
    rows = _parsed(spark, folder).join(table(spark, folder, "quality_metrics").select("document_id", "decision", "total_chars"), "document_id", "left").distinct()
    reason = curation.first_reason(
        ("failed", F.col("status") == "error"), ("hard_fail", F.col("decision") == "hard_fail"), ("no_metrics", F.col("decision").isNull()),
        ("short", F.col("total_chars") < 200), ("untitled", F.trim(F.coalesce("source_title", F.lit(""))) == ""), ("suspect", F.col("decision") == "suspect"),
    )
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"))


def manifest_semi_join(spark, folder):
    passed = table(spark, folder, "quality_metrics").where("decision = 'pass'").select("document_id")
    rows = _chunks(spark, folder).join(passed, "document_id", "left_semi")
    return rows.groupBy("institution").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def orphan_anti_join(spark, folder):
    named = table(spark, folder, "chunks").select("chunk_id", F.explode(F.from_json("block_ids_json", "array<string>")).alias("block_id")).distinct()
    return curation.orphans(named, table(spark, folder, "blocks"), "block_id").select("chunk_id", "block_id")


def integrity_contiguity(spark, folder):
    rows = table(spark, folder, "blocks").select("document_id", "block_id", F.col("reading_order").cast("long").alias("reading_order")).distinct()
    return curation.contiguity(rows, "document_id", "reading_order")


def frontier_counts(spark, folder):
    rows = _parsed(spark, folder)
    return rows.groupBy("status", "file_extension").agg(F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"), F.sum("size_bytes").alias("bytes"))


def quality_metrics(spark, folder):
    return quality.block_metrics(table(spark, folder, "blocks"))


def quality_decision(spark, folder):
    rows = table(spark, folder, "quality_metrics").select(
        "document_id", *(F.col(c).cast("long").alias(c) for c in ("total_chars", "hangul_chars", "letter_chars", "mojibake_chars")),
        "control_ratio", "page_coverage", F.col("reading_order_contiguous").alias("contiguous"),
    )
    return quality.decision(rows).select("document_id", "decision", "score")


def ocr_confidence_buckets(spark, folder):
    rows = table(spark, folder, "quality_metrics").join(_parsed(spark, folder).select("document_id", "parser").distinct(), "document_id")
    bucket = F.floor(F.col("ocr_confidence") * 10)
    return rows.groupBy("parser", bucket.alias("bucket")).agg(F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"))


def fixed_stride_chunks(spark, folder):
    rows = table(spark, folder, "documents").where("length(text) > 0").select("doc_id", F.posexplode(chunking.stride_windows(F.col("text"), 1800, 250)).alias("n", "piece"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("mark"))


def block_chunks(spark, folder):
    rows = chunking.pack_blocks(table(spark, folder, "blocks"))
    return rows.select("document_id", "chunk_index", "char_count", "page_start", "page_end", "section", F.size("block_ids").alias("n_blocks"), F.md5("text").alias("mark"))


def table_cells(spark, folder):
    rows = table(spark, folder, "blocks").where("block_type = 'table_cell'").select("table_id", "row_no", "column_no", "text").distinct()
    return rows.groupBy("table_id").agg(F.count("*").alias("cells"), (F.max("row_no") + 1).cast("long").alias("n_rows"), (F.max("column_no") + 1).cast("long").alias("n_columns"), F.count_if(F.col("text").rlike("^[0-9][0-9,.]*(만)? ?원?$")).alias("numeric"))


def documents_joined(spark, folder):
    rows = table(spark, folder, "chunks").select("document_id", "chunk_index", "text").dropDuplicates(["document_id", "chunk_index"])
    joined = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    return joined.select("document_id", F.size("c").cast("long").alias("chunks"), F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("mark"))


def distinct_contexts(spark, folder):
    rows = _chunks(spark, folder).select("chunk_id", F.lower("institution").alias("institution"), text.rank_form(F.col("text")).alias("form")).where("form <> ''")
    order = W.partitionBy("institution", F.md5("form")).orderBy("chunk_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n > 1").select("chunk_id", "institution")


def neighbor_expand(spark, folder):
    rows = _chunks(spark, folder).select("chunk_id", "document_id", F.col("chunk_index").cast("long").alias("place"), "section_path_json")
    hits = rows.where("place % 20 = 0")
    other = rows.select(F.col("chunk_id").alias("neighbor_id"), "document_id", F.col("place").alias("there"), F.col("section_path_json").alias("path"))
    # The equality on the document and the exploded place make this a hash join, not a range scan.
    asked = hits.withColumn("there", F.explode(F.array(*(F.col("place") + d for d in (-2, -1, 1, 2)))))
    met = asked.join(other, ["document_id", "there"])
    return met.select("chunk_id", "neighbor_id", (F.col("there") - F.col("place")).alias("distance"), F.col("path").eqNullSafe(F.col("section_path_json")).alias("same_section")).distinct()


def context_budget_prefix(spark, folder):
    rows = _chunks(spark, folder).select("chunk_id", "document_id", "chunk_index", F.length("text").cast("long").alias("size")).dropDuplicates(["document_id", "chunk_index"])
    return curation.budget_prefix(rows, "document_id", F.col("size"), 6000, F.col("chunk_index")).select("document_id", "chunk_index", "taken")


def section_lengths(spark, folder):
    rows = _chunks(spark, folder).select("document_id", F.coalesce(F.try_element_at(F.from_json("section_path_json", "array<string>"), F.lit(1)), F.lit("")).alias("section"), F.length("text").alias("size"))
    return rows.groupBy("document_id", "section").agg(F.sum("size").alias("n_chars"), F.count("*").alias("chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_ingest, late_arrivals, canonical_dedupe, exact_dedupe_sha, host_quota, reject_reasons, manifest_semi_join, orphan_anti_join,
        integrity_contiguity, frontier_counts, quality_metrics, quality_decision, ocr_confidence_buckets, fixed_stride_chunks, block_chunks,
        table_cells, documents_joined, distinct_contexts, neighbor_expand, context_budget_prefix, section_lengths,
    )
}

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC, status) AS v FROM (SELECT DISTINCT * FROM parsed_documents)) WHERE v = 1"
_CHUNKS = "(SELECT DISTINCT chunk_id, document_id, chunk_index, institution, source_host, page_start, page_end, section_path_json, text FROM chunks)"
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:@]+)(:[0-9]+)?([^?#]*)[?]?([^#]*)"
_HANGUL = "length(regexp_replace(coalesce(text, ''), '[^{0}]', '', 'g'))"
SQL = {
    "latest_ingest": f"SELECT document_id, status, parser, size_bytes, CAST(ingested_at AS TIMESTAMP) AS ingested_at FROM ({_LATEST})",
    "late_arrivals": """SELECT institution, count(*) AS documents, count(*) FILTER (days >= 7) AS late, max(days) AS most_days FROM (
        SELECT institution, CAST(floor((epoch_us(ingested_at) - epoch_us(fetched_at)) / 86400000000.0) AS BIGINT) AS days FROM parsed_documents) GROUP BY 1""",
    "canonical_dedupe": f"""WITH l AS (SELECT *, lower(regexp_extract(source_url, '{_URL}', 1)) || '://' || lower(regexp_extract(source_url, '{_URL}', 2)) || regexp_replace(regexp_extract(source_url, '{_URL}', 4), '/+$', '')
        || CASE WHEN regexp_extract(source_url, '{_URL}', 5) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(source_url, '{_URL}', 5), '&')), '&') ELSE '' END AS g FROM ({_LATEST}))
        SELECT document_id, CASE WHEN g IS NOT NULL AND row_number() OVER w > 1 THEN first_value(document_id) OVER w END AS duplicate_of FROM l
        WINDOW w AS (PARTITION BY g ORDER BY fetched_at, document_id)""",
    "exact_dedupe_sha": """SELECT is_duplicate, count(*) AS rows FROM (SELECT row_number() OVER (PARTITION BY source_sha256 ORDER BY ingested_at, document_id) > 1 AND source_sha256 IS NOT NULL AS is_duplicate
        FROM (SELECT DISTINCT document_id, source_sha256, ingested_at FROM parsed_documents)) GROUP BY 1""",
    "host_quota": f"""WITH h AS (SELECT document_id, min(lower(source_host)) AS source_host FROM chunks GROUP BY 1), p AS (SELECT document_id, source_host,
        row_number() OVER (PARTITION BY source_host ORDER BY CASE WHEN file_extension = '.html' THEN 1 ELSE 0 END, document_id) AS place FROM ({_LATEST}) JOIN h USING (document_id) WHERE source_host IS NOT NULL)
        SELECT document_id, source_host, place, max_items_per_host IS NULL OR place <= max_items_per_host AS kept FROM p LEFT JOIN source_hosts USING (source_host)""",
    "reject_reasons": """SELECT CASE WHEN status = 'error' THEN 'failed' WHEN decision = 'hard_fail' THEN 'hard_fail' WHEN decision IS NULL THEN 'no_metrics' WHEN total_chars < 200 THEN 'short'
        WHEN trim(coalesce(source_title, ''), ' ') = '' THEN 'untitled' WHEN decision = 'suspect' THEN 'suspect' ELSE 'accepted' END AS reason, count(*) AS rows, count(DISTINCT document_id) AS documents
        FROM (SELECT DISTINCT p.*, decision, total_chars FROM parsed_documents p LEFT JOIN quality_metrics USING (document_id)) GROUP BY 1""",
    "manifest_semi_join": f"SELECT institution, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM {_CHUNKS} WHERE document_id IN (SELECT document_id FROM quality_metrics WHERE decision = 'pass') GROUP BY 1",
    "orphan_anti_join": "SELECT DISTINCT chunk_id, block_id FROM (SELECT chunk_id, unnest(CAST(block_ids_json AS JSON)::VARCHAR[]) AS block_id FROM chunks) WHERE block_id NOT IN (SELECT block_id FROM blocks WHERE block_id IS NOT NULL)",
    "integrity_contiguity": """SELECT document_id, count(*) AS n, count(DISTINCT reading_order) AS places, max(reading_order) + 1 - count(DISTINCT reading_order) AS gaps, count(*) - count(DISTINCT reading_order) AS repeats
        FROM (SELECT DISTINCT document_id, block_id, reading_order FROM blocks) GROUP BY 1""",
    "frontier_counts": "SELECT status, file_extension, count(*) AS rows, count(DISTINCT document_id) AS documents, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM parsed_documents GROUP BY 1, 2",
    "quality_metrics": rf"""SELECT document_id, count(*) AS block_count, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total_chars, CAST(sum({_HANGUL.format("가-힣")}) AS BIGINT) AS hangul_chars,
        CAST(sum({_HANGUL.format("a-zA-Z가-힣")}) AS BIGINT) AS letter_chars, CAST(sum({_HANGUL.format(r"\x{fffd}\x{e000}-\x{f8ff}")}) AS BIGINT) AS mojibake_chars,
        count(*) FILTER (block_type = 'table') AS table_count, count(*) FILTER (block_type = 'table_cell') AS table_cell_count, max(reading_order) + 1 = count(DISTINCT reading_order) AS contiguous
        FROM (SELECT DISTINCT ON (document_id, block_id) * FROM blocks) GROUP BY 1""",
    "quality_decision": """WITH r AS (SELECT *, coalesce(hangul_chars / nullif(letter_chars, 0), 0.0) AS h, coalesce(mojibake_chars / nullif(total_chars, 0), 0.0) AS m,
        total_chars < 20 OR coalesce(control_ratio, 0.0) > 0.01 AS hard, coalesce(page_coverage, 1.0) < 1.0 AS pages, NOT coalesce(reading_order_contiguous, true) AS jumps FROM quality_metrics)
        SELECT document_id, CASE WHEN hard THEN 'hard_fail' WHEN m > 0.005 OR pages OR jumps OR h < 0.2 THEN 'suspect' ELSE 'pass' END AS decision, CASE WHEN hard THEN 0.0 ELSE
        round(greatest(0.0, 100.0 - (CASE WHEN m > 0.005 THEN 35.0 ELSE 0.0 END + CASE WHEN pages THEN 30.0 ELSE 0.0 END + CASE WHEN jumps THEN 20.0 ELSE 0.0 END
        + CASE WHEN h < 0.2 THEN (0.2 - h) * 100 ELSE 0.0 END)), 3) END AS score FROM r""",
    "ocr_confidence_buckets": """SELECT parser, CAST(floor(ocr_confidence * 10) AS BIGINT) AS bucket, count(*) AS documents, round(avg(score), 6) AS mean_score
        FROM quality_metrics JOIN (SELECT DISTINCT document_id, parser FROM parsed_documents) USING (document_id) GROUP BY 1, 2""",
    "fixed_stride_chunks": """SELECT doc_id, n, length(piece) AS n_chars, md5(piece) AS mark FROM (SELECT doc_id, n, trim(substring(text, CAST(n * 1550 + 1 AS BIGINT), 1800), ' ') AS piece FROM (
        SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1800) / 1550.0), 0) AS BIGINT) + 1)) AS n FROM documents WHERE length(text) > 0))""",
    "table_cells": """SELECT table_id, count(*) AS cells, max(row_no) + 1 AS n_rows, max(column_no) + 1 AS n_columns, count(*) FILTER (regexp_matches(text, '^[0-9][0-9,.]*(만)? ?원?$')) AS numeric
        FROM (SELECT DISTINCT table_id, row_no, column_no, text FROM blocks WHERE block_type = 'table_cell') GROUP BY 1""",
    "documents_joined": """SELECT document_id, count(*) AS chunks, length(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS n_chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS mark
        FROM (SELECT DISTINCT document_id, chunk_index, text FROM chunks) GROUP BY 1""",
    "distinct_contexts": rf"""SELECT chunk_id, institution FROM (SELECT chunk_id, institution, row_number() OVER (PARTITION BY institution, form ORDER BY chunk_id) AS n FROM (
        SELECT chunk_id, lower(institution) AS institution, lower(trim(regexp_replace(text, '{text.SPACE}+', ' ', 'g'), ' ')) AS form FROM {_CHUNKS}) WHERE form <> '') WHERE n > 1""",
    "neighbor_expand": f"""SELECT DISTINCT a.chunk_id, b.chunk_id AS neighbor_id, CAST(b.chunk_index - a.chunk_index AS BIGINT) AS distance, a.section_path_json IS NOT DISTINCT FROM b.section_path_json AS same_section
        FROM {_CHUNKS} a JOIN {_CHUNKS} b ON a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) BETWEEN 1 AND 2 WHERE a.chunk_index % 20 = 0""",
    "context_budget_prefix": """SELECT document_id, chunk_index, CAST(least(size, 6000 - before) AS BIGINT) AS taken FROM (SELECT *, sum(size) OVER (PARTITION BY document_id ORDER BY chunk_index) - size AS before
        FROM (SELECT DISTINCT document_id, chunk_index, length(text) AS size FROM chunks)) WHERE before < 6000""",
    "section_lengths": f"""SELECT document_id, section, CAST(sum(size) AS BIGINT) AS n_chars, count(*) AS chunks FROM (SELECT document_id,
        coalesce(CASE WHEN section_path_json IS NULL OR section_path_json = 'null' THEN NULL ELSE (CAST(section_path_json AS JSON)::VARCHAR[])[1] END, '') AS section, length(text) AS size FROM {_CHUNKS}) GROUP BY 1, 2""",
}
