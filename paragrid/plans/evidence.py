"""Queries of evidence, citations, assignment and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.functions import text
from paragrid.operators import grounding, rules
from paragrid.plans.measures import _SUPPORT
from paragrid.sources.tables import table

RULES = [("scholarship", "장학금"), ("leave", "휴학"), ("registration", "수강신청"), ("graduation", "졸업"), ("tuition", "tuition"), ("aid", "학자금")]
_LOCATIONS = "array<struct<block_id:string,page:int,section_path:array<string>,table_id:string,row:int,column:int>>"


def _cases(spark, folder):
    return table(spark, folder, "grounding_cases").dropDuplicates(["id"])


def category_rules(spark, folder):
    rows = table(spark, folder, "documents").select("category", rules.first_rule(F.col("title"), RULES).alias("rule"))
    return rows.groupBy("category", "rule").agg(F.count("*").alias("documents"))


def load_by_ids_ordered(spark, folder):
    asked = table(spark, folder, "chunks").select("chunk_id", F.from_json("block_ids_json", "array<string>").alias("ids")).distinct()
    blocks = table(spark, folder, "blocks").select("block_id", "block_type", F.md5("text").alias("mark")).distinct()
    return rules.in_order(asked, "ids", blocks, "block_id").select("chunk_id", F.col("place").cast("long").alias("place"), "block_id", "block_type", "mark")


def citation_explode(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_id", F.explode_outer(F.slice(F.from_json("locations_json", _LOCATIONS), 1, 100)).alias("at")).distinct()
    return rows.select("chunk_id", F.col("at.block_id").alias("block_id"), F.col("at.page").cast("long").alias("page"), F.col("at.table_id").alias("table_id"))


def parent_self_join(spark, folder):
    rows = table(spark, folder, "blocks").select("block_id", "block_type", "table_id", "reading_order").distinct()
    parents = rows.where("block_type = 'table'").select("table_id", F.col("reading_order").alias("parent_order"))
    cells = rows.where("block_type = 'table_cell'").join(parents, "table_id", "left")
    return cells.groupBy("table_id").agg(F.count("*").alias("cells"), F.count_if(F.col("parent_order").isNull()).alias("without_parent"), F.count_if(F.col("reading_order") < F.col("parent_order")).alias("before_parent"))


def context_trace(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 80).alias("preview"))


def char_count_check(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_id", "char_count", F.length("text").alias("real")).distinct()
    verdict = F.when(F.col("char_count").isNull(), "missing").when(F.col("char_count") == F.col("real"), "right").otherwise("wrong")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("chunks"))


def numbers_subset(spark, folder):
    pairs = grounding.claim_sources(table(spark, folder, "grounding_cases"))
    missing = F.array_except(text.numbers(F.col("claim")), text.numbers(F.col("source")))
    return pairs.select("id", "place", (F.size(missing) == 0).alias("all_there"), F.size(missing).cast("long").alias("missing"))


def answer_assemble(spark, folder):
    kept = grounding.attribute(grounding.support(grounding.claim_sources(table(spark, folder, "grounding_cases")))).where("accepted")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place"))), lambda s: F.concat(F.lit("["), (s["place"] + 1).cast("string"), F.lit("]"))), "")
    return kept.groupBy("id").agg(F.first("claim").alias("claim"), listed.alias("cited")).select("id", F.concat_ws(" ", "claim", "cited").alias("answer"))


def multiset_diff(spark, folder):
    return rules.multiset_difference(table(spark, folder, "events"), "user_id", "event_type", F.col("event_id") % 2 == 1)


def balanced_assignment(spark, folder):
    return rules.balanced_assignment(_cases(spark, folder).select("id", "category"), "category", "id", "arms")


def seeded_sample(spark, folder):
    return rules.seeded_sample(table(spark, folder, "embeddings").select("vec_id", "label"), F.col("vec_id"), 100, "sample")


def vector_report(spark, folder):
    return rules.vector_report(table(spark, folder, "embeddings"), "embedding", "label")


def coverage_by_group(spark, folder):
    rows = table(spark, folder, "quality_metrics").join(table(spark, folder, "parsed_documents").groupBy("document_id").agg(F.min("file_extension").alias("file_extension")), "document_id")
    return rows.groupBy("file_extension").agg(F.count("*").alias("documents"), F.round(F.avg("page_coverage"), 6).alias("coverage"), F.count_if(F.col("pages_with_output") < F.col("expected_pages")).alias("incomplete"))


QUERIES = {
    f.__name__: f
    for f in (
        category_rules, load_by_ids_ordered, citation_explode, parent_self_join, context_trace, char_count_check, numbers_subset,
        answer_assemble, multiset_diff, balanced_assignment, seeded_sample, vector_report, coverage_by_group,
    )
}

_CASES = "(SELECT DISTINCT ON (id) * FROM grounding_cases)"


def _rule(name, term):
    test = f"regexp_matches(lower(title), '(^|[^a-z0-9]){term}($|[^a-z0-9])')" if term.isascii() else f"contains(lower(title), '{term}')"
    return f"WHEN {test} THEN '{name}'"


def _numbers(column):
    return f"list_transform(regexp_extract_all({column}, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda x: replace(x, ',', ''))"


SQL = {
    "category_rules": f"SELECT category, CASE {' '.join(_rule(*r) for r in RULES)} END AS rule, count(*) AS documents FROM documents GROUP BY 1, 2",
    "load_by_ids_ordered": """WITH l AS (SELECT DISTINCT chunk_id, CAST(block_ids_json AS JSON)::VARCHAR[] AS ids FROM chunks), p AS (SELECT chunk_id, unnest(range(0, len(ids))) AS place, unnest(ids) AS block_id FROM l),
        f AS (SELECT chunk_id, block_id, min(place) AS place FROM p GROUP BY 1, 2) SELECT chunk_id, place, block_id, block_type, md5(text) AS mark FROM f JOIN (SELECT DISTINCT block_id, block_type, text FROM blocks) USING (block_id)""",
    "citation_explode": """SELECT DISTINCT chunk_id, json_extract_string(a, '$.block_id') AS block_id, CAST(json_extract_string(a, '$.page') AS BIGINT) AS page, json_extract_string(a, '$.table_id') AS table_id
        FROM (SELECT chunk_id, unnest((CAST(locations_json AS JSON)::JSON[])[1:100]) AS a FROM chunks)
        UNION SELECT chunk_id, NULL, NULL, NULL FROM chunks WHERE locations_json IS NULL OR json_array_length(locations_json) = 0""",
    "parent_self_join": """WITH b AS (SELECT DISTINCT block_id, block_type, table_id, reading_order FROM blocks), t AS (SELECT table_id, reading_order AS parent_order FROM b WHERE block_type = 'table')
        SELECT table_id, count(*) AS cells, count(*) FILTER (parent_order IS NULL) AS without_parent, count(*) FILTER (reading_order < parent_order) AS before_parent
        FROM b LEFT JOIN t USING (table_id) WHERE block_type = 'table_cell' GROUP BY 1""",
    "context_trace": "SELECT DISTINCT chunk_id, sha256(text) AS sha256, substring(text, 1, 80) AS preview FROM chunks",
    "char_count_check": "SELECT CASE WHEN char_count IS NULL THEN 'missing' WHEN char_count = real THEN 'right' ELSE 'wrong' END AS verdict, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, char_count, length(text) AS real FROM chunks) GROUP BY 1",
    "numbers_subset": f"""SELECT id, place - 1 AS place, len(m) = 0 AS all_there, len(m) AS missing FROM (SELECT id, place, list_filter(list_distinct({_numbers("claim")}),
        lambda x: NOT list_contains({_numbers("s.text")}, x)) AS m FROM (SELECT id, claim, unnest(range(1, len(sources) + 1)) AS place, unnest(sources) AS s FROM {_CASES}))""",
    "answer_assemble": f"""WITH {_SUPPORT} SELECT t.id, any_value(claim) || ' ' || string_agg('[' || (place + 1) || ']', '' ORDER BY rank) AS answer FROM top t JOIN {_CASES} c USING (id) WHERE accepted GROUP BY 1""",
    "multiset_diff": """SELECT user_id, CAST(sum(least(a, b)) AS BIGINT) AS kept, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS deleted, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added
        FROM (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2) GROUP BY 1""",
    "balanced_assignment": f"SELECT id, category, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY sha256('arms' || chr(0) || id), id) % 2 = 1 THEN 'A' ELSE 'B' END AS first_arm FROM {_CASES}",
    "seeded_sample": "SELECT vec_id, label FROM embeddings ORDER BY sha256('sample' || chr(0) || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100",
    "vector_report": """SELECT label, count(*) AS n, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS bad,
        round(min(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 5) AS least_norm,
        round(max(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 5) AS most_norm FROM embeddings GROUP BY 1""",
    "coverage_by_group": """SELECT file_extension, count(*) AS documents, round(avg(page_coverage), 6) AS coverage, count(*) FILTER (pages_with_output < expected_pages) AS incomplete
        FROM quality_metrics JOIN (SELECT document_id, min(file_extension) AS file_extension FROM parsed_documents GROUP BY 1) USING (document_id) GROUP BY 1""",
}
