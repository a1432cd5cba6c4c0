"""Queries of reports. The event log stands for a log of answers: a user is a question, the last bit of the id an arm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from paragrid.functions import normal, text, urls
from paragrid.operators import evaluation, reports
from paragrid.plans.context import _best, _claims, _gold, _pieces, _wordings, evidence_recall
from paragrid.plans.measures import _judged
from paragrid.plans.search import ranked, reranked
from paragrid.session import materialize
from paragrid.sources.tables import table


def _answers(spark, folder):
    rows = table(spark, folder, "events")
    arm = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    return rows.select(
        F.col("user_id").alias("case"), (F.col("user_id") % 15).alias("family"), arm.alias("arm"), (F.floor(F.col("event_id") / 2) % 3).alias("run"), "event_type",
        F.least(F.floor(F.col("value") / 20), F.lit(2)).cast("double").alias("score"), (F.col("value") > 25).alias("passed"), (F.col("event_type") == "error").alias("failed"), "event_id", "ts",
    )


def question_means(spark, folder):
    return reports.question_means(_answers(spark, folder), "case", "arm", "score")


def condition_summary(spark, folder):
    return reports.condition_summary(_answers(spark, folder), "case", "arm", "run", "score")


def score_counts(spark, folder):
    return reports.score_histogram(_answers(spark, folder), "arm", F.col("score"), [0, 1, 2])


def slot_bounds(spark, folder):
    return reports.slot_bounds(_answers(spark, folder), "arm", F.col("passed"), F.col("failed"))


def repeat_votes(spark, folder):
    return reports.repeat_votes(_answers(spark, folder), "case", "arm", F.col("passed")).select("case", "arm", "yes", "total", "verdict", "agreement")


def paired_report(spark, folder):
    return reports.paired(_answers(spark, folder), "case", "family", "arm", "score", "passed", "a", "b")


def failure_causes(spark, folder):
    rows = _answers(spark, folder)
    found = reports.causes(("error", F.col("failed")), ("low_score", F.col("score") < 1), ("not_passed", ~F.col("passed")), ("late_run", F.col("run") == 2))
    return reports.cause_counts(rows.withColumn("causes", found), "arm", "causes")


def value_distribution(spark, folder):
    return reports.distribution(_answers(spark, folder), "event_type", "score")


def context_recall(spark, folder):
    found = evidence_recall(spark, folder)
    kinds = _claims(spark, folder, True).join(table(spark, folder, "parsed_documents").groupBy("document_id").agg(F.min("file_extension").alias("kind")), "document_id").select("id", "kind")
    return reports.distribution(found.join(kinds, "id"), "kind", "recall")


def _first_hits(spark, folder, hits):
    gold = table(spark, folder, "documents").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "doc_id")
    return evaluation.first_hit(hits, gold, "query_id", "doc_id")


def strata_report(spark, folder):
    documents = table(spark, folder, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "doc_type", "category", (F.coalesce(F.length("text"), F.lit(0)) >= 40).alias("evaluable"))
    hits = _first_hits(spark, folder, ranked(spark, folder, 10).select("query_id", "doc_id", "rank"))
    return reports.strata(hits.join(documents, "query_id"), "doc_type", "category")


def lane_report(spark, folder):
    first = materialize(ranked(spark, folder, 20).select("query_id", "doc_id", "rank"))
    lanes = {"bm25": first.where("rank <= 10"), "lexical": reranked(spark, folder, first)}
    return reports.lanes({n: _first_hits(spark, folder, h) for n, h in lanes.items()})


def unique_documents(spark, folder):
    claims, wordings = _wordings(spark, folder, True)
    mark = normal.first_filled(F.col("document_id"), F.col("relative_path"), F.col("source_title"), F.col("chunk_id"))
    about = _pieces(spark, folder).select("chunk_id", mark.alias("document"), normal.first_filled(F.col("source_title"), F.col("document_id")).alias("title"))
    hits = _best(spark, folder, wordings, "mark", 10).join(about, "chunk_id")
    counted = hits.groupBy("mark").agg(F.count("*").alias("chunks"), F.countDistinct("document").alias("documents"), F.countDistinct("title").alias("titles"))
    return claims.join(counted, "mark").drop("mark")


def category_rates(spark, folder):
    rows = _judged(spark, folder)
    return rows.groupBy("category").agg(F.count("*").alias("cases"), F.count_if(F.col("expected_reason") == F.col("reason")).alias("reasons"), F.round(F.avg((F.col("expected_supported") == F.col("supported")).cast("double")), 6).alias("right"), F.round(F.avg(F.when(~F.col("expected_supported"), F.col("supported").cast("double"))), 6).alias("false_pass"))


def guarded_scores(spark, folder):
    rows = _judged(spark, folder).withColumn("score", F.when(F.col("supported"), 2).when(F.col("reason") == "low_lexical_overlap", 1).otherwise(0))
    capped, used = reports.guarded(F.col("score"), ("reversal", F.col("category").endswith("reversal"), 1), ("no_source", F.col("expected_reason") == "no_source", 0), ("unsupported", ~F.col("expected_supported"), 0))
    return rows.select("id", "score", capped.alias("guarded"), F.array_join(used, ",").alias("rules"))


def join_guard(spark, folder):
    parsed, metrics = table(spark, folder, "parsed_documents"), table(spark, folder, "quality_metrics")
    blocks = table(spark, folder, "blocks").select("document_id").distinct()
    pairs = {"parsed": parsed, "blocks": blocks}
    found = (reports.join_faults(metrics, rows, "document_id").withColumn("table", F.lit(n)) for n, rows in pairs.items())
    return reduce(lambda a, b: a.unionByName(b), found)


def artifact_stats(spark, folder):
    keys = (("blocks", "block_id"), ("chunks", "chunk_id"), ("parsed_documents", "document_id"), ("quality_metrics", "document_id"), ("grounding_cases", "id"), ("documents", "doc_id"))
    return reduce(lambda a, b: a.unionByName(b), (reports.key_stats(table(spark, folder, t), k, t) for t, k in keys))


def run_integrity(spark, folder):
    """The rules of a sound run with the number of rows that break each."""
    blocks = table(spark, folder, "blocks").select("document_id", "block_id", "block_type", "text", "reading_order", "table_id", "row_no", "column_no").distinct()
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "char_count", "block_ids_json", "table_ids_json").distinct()
    parsed, metrics = table(spark, folder, "parsed_documents"), table(spark, folder, "quality_metrics")
    ids = chunks.select("chunk_id", "document_id", F.explode(F.from_json("block_ids_json", "array<string>")).alias("block_id"))
    tables = blocks.where("block_type = 'table'").select("table_id", F.col("reading_order").alias("parent")).distinct()
    cells = blocks.where("block_type = 'table_cell'")
    counted = blocks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("block_type") == "table").alias("tables"))
    places = chunks.groupBy("document_id").agg(F.countDistinct("chunk_index").alias("n"), F.max("chunk_index").alias("last"))
    rules = {
        "block_id_repeated": blocks.groupBy("block_id").agg(F.count("*").alias("n")).where("n > 1"),
        "block_without_document": blocks.join(parsed.select("document_id").distinct(), "document_id", "left_anti"),
        "block_of_another_document": blocks.where(~F.startswith("block_id", F.concat("document_id", F.lit(":")))),
        "order_with_gap": blocks.groupBy("document_id").agg((F.max("reading_order") + 1 - F.countDistinct("reading_order")).alias("n")).where("n <> 0"),
        "cell_without_table": cells.join(tables, "table_id", "left_anti"),
        "cell_before_table": cells.join(tables, "table_id").where("reading_order < parent"),
        "cell_without_place": cells.where("row_no is null or column_no is null"),
        "chunk_of_unknown_block": ids.join(blocks.select("block_id").distinct(), "block_id", "left_anti"),
        "chunk_of_another_document": ids.join(blocks.select("block_id", F.col("document_id").alias("owner")).distinct(), "block_id").where("owner <> document_id"),
        "chunk_index_with_gap": places.where("last + 1 <> n"), "chunk_count_wrong": chunks.where("char_count is not null and char_count <> length(text)"), "chunk_empty": chunks.where("coalesce(length(trim(text)), 0) = 0"),
        "metrics_count_wrong": metrics.join(counted, "document_id").where("block_count <> n"), "metrics_tables_wrong": metrics.join(counted, "document_id").where("table_count <> tables"),
        "document_without_metrics": parsed.select("document_id").distinct().join(metrics, "document_id", "left_anti"),
    }
    return reduce(lambda a, b: a.unionByName(b), (reports.violations(name, rows) for name, rows in rules.items()))


def corpus_gate(spark, folder):
    """The documents that may be indexed (parsed, passed or suspect, no chunk with an unknown block), by institution, with a mark of the set."""
    status = table(spark, folder, "parsed_documents").groupBy("document_id").agg(F.max_by("status", "ingested_at").alias("status"), F.min("institution").alias("institution"))
    decided = table(spark, folder, "quality_metrics").where("decision in ('pass', 'suspect')").select("document_id")
    ids = table(spark, folder, "chunks").select("document_id", F.explode(F.from_json("block_ids_json", "array<string>")).alias("block_id"))
    broken = ids.join(table(spark, folder, "blocks").select("block_id").distinct(), "block_id", "left_anti").select("document_id").distinct()
    allowed = status.where("status <> 'error'").join(decided, "document_id", "left_semi").join(broken, "document_id", "left_anti")
    # The mark is a sum of hashes, so no list of all ids comes together.
    part = F.conv(F.substring(F.md5("document_id"), 1, 12), 16, 10).cast("decimal(20,0)")
    return allowed.groupBy("institution").agg(F.count("*").alias("documents"), F.sum(part).cast("string").alias("revision"))


def derived_run(spark, folder):
    """The chunks of the documents that a manifest (the passed ones, by path) selects, with the manifest's title put over their own."""
    latest = table(spark, folder, "parsed_documents").groupBy("document_id").agg(F.max_by("relative_path", "ingested_at").alias("relative_path"), F.max_by(F.struct("source_title"), "ingested_at").alias("t"))
    manifest = latest.join(table(spark, folder, "quality_metrics").where("decision = 'pass'").select("document_id"), "document_id", "left_semi").select("relative_path", F.col("t.source_title").alias("manifest_title"))
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "relative_path", "source_title").distinct()
    rows = chunks.join(manifest, "relative_path")
    title = F.coalesce("manifest_title", "source_title")
    return rows.groupBy("document_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.min(title).alias("title"), F.count_if(~F.col("source_title").eqNullSafe(title)).alias("overlaid"))


def source_families(spark, folder):
    """Families of sources: documents whose titles differ only in years, sizes and endings."""
    rows = table(spark, folder, "parsed_documents").where("source_title is not null").select("document_id", text.title_key(F.col("source_title")).alias("key"), urls.part(F.col("source_url"), "host").alias("host")).where("key <> ''").distinct()
    return rows.groupBy(F.substring(F.sha2("key", 256), 1, 16).alias("family")).agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("host").alias("hosts"), F.min("document_id").alias("first"))


def oracle_contexts(spark, folder):
    """The evidence of each case as numbered contexts, each chunk once, in the order of the sentences."""
    first = _gold(spark, folder).groupBy("id", "chunk_id").agg(F.min("place").alias("place"))
    from pyspark.sql import Window as W

    return first.withColumn("number", F.row_number().over(W.partitionBy("id").orderBy("place", "chunk_id")).cast("long")).select("id", "number", "chunk_id")


def run_schedule(spark, folder):
    cases = table(spark, folder, "events").select(F.col("user_id").alias("case"))
    return reports.schedule(cases, "case", ["a", "b"], 3, "seed").select("case", "arm", F.col("repeat").cast("long").alias("repeat"), "slot", "place")


def schedule_audit(spark, folder):
    planned = run_schedule(spark, folder).select("case", "arm", (F.col("repeat") - 1).alias("run"))
    done = _answers(spark, folder).where("event_type <> 'view'")
    return reports.audit(planned, done, "case", "arm", "run")


QUERIES = {
    f.__name__: f
    for f in (
        question_means, condition_summary, score_counts, slot_bounds, repeat_votes, paired_report, failure_causes, value_distribution, context_recall, strata_report, lane_report,
        unique_documents, category_rates, guarded_scores, join_guard, artifact_stats, run_integrity, corpus_gate, derived_run, source_families, oracle_contexts, run_schedule, schedule_audit,
    )
}

from paragrid.plans import context as _context  # noqa: E402
from paragrid.plans import measures as _measures  # noqa: E402
from paragrid.plans import search as _search  # noqa: E402

_A = """answers AS (SELECT user_id AS "case", user_id % 15 AS family, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, (event_id // 2) % 3 AS run, event_type, CAST(least(floor(value / 20), 2) AS DOUBLE) AS score,
    value > 25 AS passed, event_type = 'error' AS failed FROM events)"""
_HITS = f"""{_search._PLAIN}, first AS (SELECT d.doc_id AS query_id, doc_type, category, coalesce(length(text), 0) >= 40 AS ok, r.rank AS hit FROM documents d LEFT JOIN ranked r ON r.query_id = d.doc_id AND r.doc_id = d.doc_id AND r.rank <= 10
    WHERE d.doc_id % 20 = 0 AND title IS NOT NULL)"""
_RULES = {
    "block_id_repeated": "SELECT 1 FROM b GROUP BY block_id HAVING count(*) > 1", "block_without_document": "SELECT 1 FROM b WHERE document_id NOT IN (SELECT document_id FROM parsed_documents)",
    "block_of_another_document": "SELECT 1 FROM b WHERE NOT starts_with(block_id, document_id || ':')", "order_with_gap": "SELECT 1 FROM b GROUP BY document_id HAVING max(reading_order) + 1 <> count(DISTINCT reading_order)",
    "cell_without_table": "SELECT 1 FROM b WHERE block_type = 'table_cell' AND (table_id IS NULL OR table_id NOT IN (SELECT table_id FROM t))", "cell_before_table": "SELECT 1 FROM b JOIN t USING (table_id) WHERE block_type = 'table_cell' AND reading_order < parent",
    "cell_without_place": "SELECT 1 FROM b WHERE block_type = 'table_cell' AND (row_no IS NULL OR column_no IS NULL)", "chunk_of_unknown_block": "SELECT 1 FROM i WHERE block_id NOT IN (SELECT block_id FROM b)",
    "chunk_of_another_document": "SELECT 1 FROM i JOIN (SELECT DISTINCT block_id, document_id AS owner FROM b) USING (block_id) WHERE owner <> document_id", "chunk_index_with_gap": "SELECT 1 FROM c GROUP BY document_id HAVING max(chunk_index) + 1 <> count(DISTINCT chunk_index)",
    "chunk_count_wrong": "SELECT 1 FROM c WHERE char_count <> length(text)", "chunk_empty": "SELECT 1 FROM c WHERE coalesce(length(trim(text, ' ')), 0) = 0",
    "metrics_count_wrong": "SELECT 1 FROM quality_metrics JOIN (SELECT document_id, count(*) AS n FROM b GROUP BY 1) USING (document_id) WHERE block_count <> n",
    "metrics_tables_wrong": "SELECT 1 FROM quality_metrics JOIN (SELECT document_id, count(*) FILTER (block_type = 'table') AS n FROM b GROUP BY 1) USING (document_id) WHERE table_count <> n",
    "document_without_metrics": "SELECT DISTINCT document_id FROM parsed_documents WHERE document_id NOT IN (SELECT document_id FROM quality_metrics)",
}
SQL = {
    "question_means": f'WITH {_A} SELECT "case", arm, round(avg(score), 6) AS mean, count(score) AS runs FROM answers GROUP BY 1, 2',
    "condition_summary": f"""WITH {_A}, q AS (SELECT arm, "case", avg(score) AS m FROM answers GROUP BY 1, 2), r AS (SELECT arm, run, avg(score) AS m FROM answers GROUP BY 1, 2)
        SELECT * FROM (SELECT arm, count(m) AS questions, round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS most FROM q GROUP BY 1)
        JOIN (SELECT arm, count(m) AS runs, round(min(m), 6) AS worst_run, round(max(m), 6) AS best_run, round(stddev_pop(m), 6) AS spread FROM r GROUP BY 1) USING (arm)""",
    "score_counts": f"WITH {_A} SELECT arm, count(*) FILTER (score = 0) AS score_0, count(*) FILTER (score = 1) AS score_1, count(*) FILTER (score = 2) AS score_2, count(*) FILTER (score IS NULL) AS score_none FROM answers GROUP BY 1",
    "slot_bounds": f"""WITH {_A} SELECT arm, count(*) AS planned, count(*) FILTER (passed IS NOT NULL AND NOT failed) AS valid, count(*) FILTER (failed) AS errors, round(avg(CASE WHEN passed IS NOT NULL AND NOT failed THEN CAST(passed AS INT) END), 6) AS rate,
        round(count(*) FILTER (passed AND NOT failed) / count(*), 6) AS lower, round(count(*) FILTER (passed OR failed OR passed IS NULL) / count(*), 6) AS upper FROM answers GROUP BY 1""",
    "repeat_votes": f"""WITH {_A}, v AS (SELECT "case", arm, count(*) FILTER (passed) AS yes, count(passed) AS total FROM answers GROUP BY 1, 2 HAVING count(passed) > 0)
        SELECT *, CASE WHEN yes * 2 > total THEN true WHEN yes * 2 < total THEN false END AS verdict, round(greatest(yes, total - yes) / total, 6) AS agreement FROM v""",
    "paired_report": f"""WITH {_A}, c AS (SELECT "case", family, avg(score) FILTER (arm = 'a') AS a, avg(score) FILTER (arm = 'b') AS b, count(*) FILTER (arm = 'a' AND passed) * 2 - count(passed) FILTER (arm = 'a') AS va, count(*) FILTER (arm = 'b' AND passed) * 2 - count(passed) FILTER (arm = 'b') AS vb FROM answers GROUP BY 1, 2),
        d AS (SELECT *, round(b - a, 6) AS delta FROM c WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT list(x) AS d FROM (SELECT round(sum(delta), 6) AS x FROM d GROUP BY family) WHERE x <> 0),
        m AS (SELECT d, unnest(range(0, CAST(pow(2, len(d)) AS BIGINT))) AS m FROM s), p AS (SELECT max(len(d)) AS families, round(avg(CASE WHEN abs(list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN -1.0 ELSE 1.0 END * d[i + 1])))
        >= abs(list_sum(d)) - 1e-9 THEN 1.0 ELSE 0.0 END), 9) AS p_families FROM m), t AS (SELECT count(*) AS questions, round(avg(delta), 6) AS delta, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses,
        count(*) FILTER (vb > 0 AND va < 0) AS gained, count(*) FILTER (va > 0 AND vb < 0) AS lost FROM d)
        SELECT t.*, families, p_families, round(CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) END, 9) AS p_mcnemar FROM t, p""",
    "failure_causes": f"""WITH {_A}, f AS (SELECT arm, list_filter([CASE WHEN failed THEN 'error' END, CASE WHEN score < 1 THEN 'low_score' END, CASE WHEN NOT passed THEN 'not_passed' END, CASE WHEN run = 2 THEN 'late_run' END], lambda x: x IS NOT NULL) AS l FROM answers),
        g AS (SELECT arm, CASE WHEN len(l) = 0 THEN ['none'] ELSE l END AS l FROM f) SELECT arm, cause, count(*) AS rows, count(*) FILTER (n = 1) AS first FROM (SELECT arm, unnest(l) AS cause, unnest(range(1, len(l) + 1)) AS n FROM g) GROUP BY 1, 2""",
    "value_distribution": f"""WITH {_A} SELECT event_type, count(score) AS n, round(sum(score), 6) AS total, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, min(score) AS least, max(score) AS most,
        count(*) FILTER (score = 0) AS zeros, count(*) FILTER (score = 1) AS ones FROM answers GROUP BY 1""",
    "context_recall": f"""WITH {_context._EVERY}, f AS (SELECT id, round(count(rank) / count(*), 6) AS recall FROM (SELECT DISTINCT id, chunk_id FROM gold) LEFT JOIN (SELECT * FROM hits WHERE rank <= 8) USING (id, chunk_id) GROUP BY 1)
        SELECT kind, count(*) AS n, round(sum(recall), 6) AS total, round(avg(recall), 6) AS mean, round(quantile_cont(recall, 0.5), 6) AS median, min(recall) AS least, max(recall) AS most, count(*) FILTER (recall = 0) AS zeros, count(*) FILTER (recall = 1) AS ones
        FROM f JOIN claims USING (id) JOIN (SELECT document_id, min(file_extension) AS kind FROM parsed_documents GROUP BY 1) USING (document_id) GROUP BY 1""",
    "strata_report": f"""WITH {_HITS}, s AS (SELECT 'all' AS field, 'all' AS value, * FROM first UNION ALL SELECT 'doc_type', coalesce(doc_type, 'none'), * FROM first UNION ALL SELECT 'category', coalesce(category, 'none'), * FROM first)
        SELECT field, value, count(*) FILTER (ok) AS questions, count(*) FILTER (NOT ok) AS unevaluable, round(avg(CASE WHEN ok THEN CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END END), 6) AS hit_5, round(avg(CASE WHEN ok THEN coalesce(1.0 / hit, 0.0) END), 6) AS mrr FROM s GROUP BY 1, 2""",
    "lane_report": f"""WITH {_search._RESCORED}, l AS (SELECT 'bm25' AS lane, query_id, doc_id, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT 'lexical', query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM rescored) WHERE rank <= 10),
        q AS (SELECT lane, doc_id AS query_id FROM documents, (VALUES ('bm25'), ('lexical')) v(lane) WHERE doc_id % 20 = 0 AND title IS NOT NULL), h AS (SELECT q.lane, l.rank AS hit FROM q LEFT JOIN l ON l.lane = q.lane AND l.query_id = q.query_id AND l.doc_id = q.query_id)
        SELECT lane, m.metric, round(avg(CASE m.metric WHEN 'mrr' THEN coalesce(1.0 / hit, 0.0) ELSE CASE WHEN hit <= m.k THEN 1.0 ELSE 0.0 END END), 6) AS value FROM h, (VALUES ('hit_1', 1), ('hit_5', 5), ('hit_10', 10), ('mrr', 0)) m(metric, k) GROUP BY 1, 2""",
    "unique_documents": f"""WITH {_context._EVERY} SELECT id, count(*) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT CASE WHEN trim(coalesce(source_title, ''), ' ') <> '' THEN source_title ELSE document_id END) AS titles FROM hits JOIN pieces USING (chunk_id) WHERE rank <= 10 GROUP BY 1""",
    "category_rates": f"""WITH {_measures._SUPPORT} SELECT category, count(*) AS cases, count(*) FILTER (expected_reason = reason) AS reasons, round(avg(CAST(expected_supported = supported AS DOUBLE)), 6) AS "right", round(avg(CASE WHEN NOT expected_supported THEN CAST(supported AS DOUBLE) END), 6) AS false_pass FROM judged GROUP BY 1""",
    "guarded_scores": f"""WITH {_measures._SUPPORT}, s AS (SELECT *, CASE WHEN supported THEN 2 WHEN reason = 'low_lexical_overlap' THEN 1 ELSE 0 END AS score FROM judged)
        SELECT id, score, least(score, CASE WHEN category LIKE '%reversal' THEN 1 ELSE 2 END, CASE WHEN expected_reason = 'no_source' OR NOT expected_supported THEN 0 ELSE 2 END) AS guarded,
        concat_ws(',', CASE WHEN category LIKE '%reversal' AND score > 1 THEN 'reversal' END, CASE WHEN expected_reason = 'no_source' AND score > 0 THEN 'no_source' END, CASE WHEN NOT expected_supported AND score > 0 THEN 'unsupported' END) AS rules FROM s""",
    "join_guard": " UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a > 1) AS left_repeats, count(*) FILTER (b > 1) AS right_repeats, count(*) FILTER (a = 1 AND b = 1) AS matched
        FROM (SELECT document_id, count(*) AS a FROM quality_metrics GROUP BY 1) FULL JOIN (SELECT document_id, count(*) AS b FROM {t} GROUP BY 1) USING (document_id)""" for n, t in (("parsed", "parsed_documents"), ("blocks", "(SELECT DISTINCT document_id FROM blocks)"))),
    "artifact_stats": " UNION ALL ".join(f"""SELECT '{t}' AS artifact, count(*) AS records, count(DISTINCT {k}) AS "unique", count(*) FILTER ({k} IS NULL) AS missing, count({k}) - count(DISTINCT {k}) AS duplicates FROM {t}""" for t, k in (("blocks", "block_id"), ("chunks", "chunk_id"), ("parsed_documents", "document_id"), ("quality_metrics", "document_id"), ("grounding_cases", "id"), ("documents", "doc_id"))),
    "run_integrity": """WITH b AS (SELECT DISTINCT document_id, block_id, block_type, text, reading_order, table_id, row_no, column_no FROM blocks), c AS (SELECT DISTINCT chunk_id, document_id, chunk_index, text, char_count, block_ids_json, table_ids_json FROM chunks),
        i AS (SELECT chunk_id, document_id, unnest(CAST(block_ids_json AS JSON)::VARCHAR[]) AS block_id FROM c), t AS (SELECT DISTINCT table_id, reading_order AS parent FROM b WHERE block_type = 'table') """ + " UNION ALL ".join(f"SELECT '{n}' AS rule, (SELECT count(*) FROM ({q})) AS violations" for n, q in _RULES.items()),
    "corpus_gate": """WITH s AS (SELECT document_id, arg_max(status, ingested_at) AS status, min(institution) AS institution FROM parsed_documents GROUP BY 1), i AS (SELECT document_id, unnest(CAST(block_ids_json AS JSON)::VARCHAR[]) AS block_id FROM chunks)
        SELECT institution, count(*) AS documents, CAST(sum(CAST('0x' || substring(md5(document_id), 1, 12) AS BIGINT)) AS VARCHAR) AS revision FROM s WHERE status <> 'error' AND document_id IN (SELECT document_id FROM quality_metrics WHERE decision IN ('pass', 'suspect'))
        AND document_id NOT IN (SELECT document_id FROM i WHERE block_id NOT IN (SELECT block_id FROM blocks)) GROUP BY 1""",
    "derived_run": """WITH l AS (SELECT document_id, relative_path, source_title AS mt FROM parsed_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC) = 1),
        m AS (SELECT relative_path, mt FROM l WHERE document_id IN (SELECT document_id FROM quality_metrics WHERE decision = 'pass')), c AS (SELECT DISTINCT chunk_id, document_id, relative_path, source_title FROM chunks)
        SELECT document_id, count(DISTINCT chunk_id) AS chunks, min(coalesce(mt, source_title)) AS title, count(*) FILTER (source_title IS DISTINCT FROM coalesce(mt, source_title)) AS overlaid FROM c JOIN m USING (relative_path) GROUP BY 1""",
    "source_families": r"""WITH k AS (SELECT DISTINCT document_id, regexp_replace(regexp_replace(regexp_replace(lower(source_title), '[.](pdf|hwpx?|docx?|xlsx?|html?|zip)$', ''), '(19|20)[0-9]{2}(학년도|년도|년)?|[0-9.]+ ?[kmg]b', '', 'g'), '[^0-9a-z가-힣]+', '', 'g') AS key,
        regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)', 1) AS host FROM parsed_documents WHERE source_title IS NOT NULL)
        SELECT substring(sha256(key), 1, 16) AS family, count(DISTINCT document_id) AS documents, count(DISTINCT host) AS hosts, min(document_id) AS first FROM k WHERE key <> '' GROUP BY 1""",
    "oracle_contexts": f"""WITH {_context._ASKED}, f AS (SELECT id, chunk_id, min(place) AS place FROM gold GROUP BY 1, 2) SELECT id, row_number() OVER (PARTITION BY id ORDER BY place, chunk_id) AS number, chunk_id FROM f""",
    "run_schedule": """WITH g AS (SELECT "case", arm, repeat, substring(sha256('seed|' || "case" || '|' || repeat || '|' || arm), 1, 16) AS slot FROM (SELECT DISTINCT user_id AS "case" FROM events), (VALUES ('a'), ('b')) a(arm), (SELECT unnest(range(1, 4)) AS repeat))
        SELECT *, row_number() OVER (PARTITION BY "case", repeat ORDER BY slot) AS place FROM g""",
    "schedule_audit": f"""WITH {_A}, p AS (SELECT DISTINCT "case", arm, run FROM (SELECT DISTINCT "case" FROM answers), (VALUES ('a'), ('b')) a(arm), (VALUES (0), (1), (2)) r(run)), d AS (SELECT "case", arm, run, count(*) AS n FROM answers WHERE event_type <> 'view' GROUP BY ALL)
        SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'done' END AS state, count(*) AS slots FROM p LEFT JOIN d USING ("case", arm, run) GROUP BY 1""",
}
