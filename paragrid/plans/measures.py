"""Queries of evaluation, agreement, statistics and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.functions import text
from paragrid.operators import evaluation, grounding
from paragrid.plans import search
from paragrid.plans.texts import FACTS
from paragrid.session import materialize
from paragrid.sources.tables import table


def _cases(spark, folder):
    return table(spark, folder, "grounding_cases")


def _hits(spark, folder):
    ranked = search.ranked(spark, folder, 10).select("query_id", "doc_id", "rank")
    gold = table(spark, folder, "documents").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "doc_id")
    return evaluation.first_hit(ranked, gold, "query_id", "doc_id")


def hit_at_k(spark, folder):
    kinds = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), "doc_type")
    return evaluation.hit_rates(_hits(spark, folder).join(kinds, "query_id"), "doc_type")


def category_precision(spark, folder):
    kinds = table(spark, folder, "documents").select("doc_id", "category")
    rows = search.ranked(spark, folder, 10).join(kinds, "doc_id").join(kinds.select(F.col("doc_id").alias("query_id"), F.col("category").alias("asked")), "query_id")
    return rows.groupBy("asked").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("asked") == F.col("category")).cast("double")), 6).alias("precision"))


def rank_changes(spark, folder):
    first = materialize(search.ranked(spark, folder, 20).select("query_id", "doc_id", "rank"))
    return evaluation.rank_changes(first.where("rank <= 10"), search.reranked(spark, folder, first), "query_id", "doc_id")


def latency_quantiles(spark, folder):
    rows = table(spark, folder, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"))
    return rows.select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "mean", "spread")


def score_histogram_pivot(spark, folder):
    rows = table(spark, folder, "quality_metrics").select(F.floor(F.col("score") / 10).alias("bucket"), "decision")
    return rows.groupBy("bucket").pivot("decision", ["pass", "suspect", "hard_fail"]).agg(F.count(F.lit(1))).na.fill(0).withColumnRenamed("pass", "passed")


def run_rollup(spark, folder):
    return table(spark, folder, "parsed_documents").rollup("status", "file_extension").agg(F.count("*").alias("rows"), F.sum("size_bytes").alias("bytes"))


def cross_table(spark, folder):
    return _cases(spark, folder).dropDuplicates(["id"]).groupBy("category", "expected_reason", "expected_supported").agg(F.count("*").alias("cases"))


def claim_lexical_support(spark, folder):
    rows = grounding.support(grounding.claim_sources(_cases(spark, folder)))
    return rows.select("id", "place", "contained", "share", "facts_missing")


def claim_topk_sources(spark, folder):
    rows = grounding.attribute(grounding.support(grounding.claim_sources(_cases(spark, folder))))
    return rows.select("id", "place", "chunk_id", "accepted", "rank")


def _judged(spark, folder):
    cases = _cases(spark, folder)
    found = grounding.reasons(cases, grounding.attribute(grounding.support(grounding.claim_sources(cases))))
    return found.join(cases.select("id", "category", "expected_supported", "expected_reason").dropDuplicates(["id"]), "id")


def claim_reasons(spark, folder):
    return _judged(spark, folder).groupBy("reason", "expected_reason").agg(F.count("*").alias("cases"))


def confusion_matrix(spark, folder):
    return evaluation.confusion(_judged(spark, folder), F.col("expected_supported"), F.col("supported"), "category")


def cohen_kappa(spark, folder):
    return evaluation.kappa(_judged(spark, folder), F.col("expected_supported").cast("int"), F.col("supported").cast("int"))


def quadratic_kappa(spark, folder):
    level = lambda c: F.when(F.col(c).isin("pass", "success"), 2).when(F.col(c) == "suspect", 1).otherwise(0)
    parsed = table(spark, folder, "parsed_documents").groupBy("document_id").agg(F.max("status").alias("status"))
    rows = table(spark, folder, "quality_metrics").join(parsed, "document_id")
    return evaluation.kappa(rows, level("decision"), level("status"), "quadratic", 3)


def unique_mode(spark, folder):
    return evaluation.unique_mode(table(spark, folder, "events"), "user_id", "event_type")


def majority_vote(spark, folder):
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 10).alias("yes"), F.count("*").alias("total"))
    return rows.select("user_id", "yes", "total", evaluation.strict_majority(F.col("yes"), F.col("total")).alias("verdict"))


def _halves(spark, folder):
    rows = table(spark, folder, "events").where("value is not null")
    late = (F.col("event_id") % 2) == 1
    cut = rows.groupBy("event_type", "user_id").agg(F.avg(F.when(late, F.col("value"))).alias("b"), F.avg(F.when(~late, F.col("value"))).alias("a"))
    return cut.where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def win_tie_loss(spark, folder):
    sign = F.signum(F.round("delta", 6))
    return _halves(spark, folder).groupBy("event_type").agg(F.count_if(sign > 0).alias("wins"), F.count_if(sign == 0).alias("ties"), F.count_if(sign < 0).alias("losses"))


def mcnemar_exact(spark, folder):
    wins = win_tie_loss(spark, folder)
    return wins.select("event_type", "wins", "losses", F.round(evaluation.exact_mcnemar(F.col("wins"), F.col("losses")), 9).alias("p"))


def holm_adjust(spark, folder):
    return evaluation.holm(mcnemar_exact(spark, folder), "p").select("event_type", "p", F.round("p_holm", 9).alias("p_holm"))


def sign_flip_exact(spark, folder):
    rows = table(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 12).alias("family"))
    late = (F.col("event_id") % 2) == 1
    cut = rows.agg((F.avg(F.when(late, F.col("value"))) - F.avg(F.when(~late, F.col("value")))).alias("d")).where("d is not null")
    return evaluation.sign_flip(cut.withColumn("d", F.round("d", 6)), "event_type", "d")


def cluster_bootstrap_ci(spark, folder):
    rows = _halves(spark, folder).withColumn("delta", F.round("delta", 6)).withColumn("family", F.col("user_id") % 40)
    return evaluation.cluster_bootstrap(rows, "event_type", "family", "delta")


QUERIES = {
    f.__name__: f
    for f in (
        hit_at_k, category_precision, rank_changes, latency_quantiles, score_histogram_pivot, run_rollup, cross_table, claim_lexical_support,
        claim_topk_sources, claim_reasons, confusion_matrix, cohen_kappa, quadratic_kappa, unique_mode, majority_vote,
        win_tie_loss, mcnemar_exact, holm_adjust, sign_flip_exact, cluster_bootstrap_ci,
    )
}

_P = search._PLAIN
_FOLD = search._folded
_T = search._T
_HALVES = """halves AS (SELECT event_type, user_id, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
    wtl AS (SELECT event_type, count(*) FILTER (round(b - a, 6) > 0) AS wins, count(*) FILTER (round(b - a, 6) = 0) AS ties, count(*) FILTER (round(b - a, 6) < 0) AS losses
    FROM halves WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
    mc AS (SELECT event_type, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1),
    lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END, 9) AS p FROM wtl)"""


def _facts(column):
    folded = f"trim(regexp_replace({column}, '{text.SPACE}+', ' ', 'g'), ' ')"
    each = (f"list_transform(regexp_extract_all({folded}, '{p}'), lambda v: '{k}:' || replace(replace(v, ',', ''), ' ', ''))" for k, p in FACTS)
    return f"list_sort(list_distinct(list_concat({', '.join(each)})))"


_PAIRS = "pairs AS (SELECT id, claim, place - 1 AS place, s.chunk_id AS chunk_id, s.text AS source FROM (SELECT id, claim, unnest(range(1, len(sources) + 1)) AS place, unnest(sources) AS s FROM (SELECT DISTINCT ON (id) * FROM grounding_cases)))"
_SUPPORT = f"""{_PAIRS}, support AS (SELECT id, place, chunk_id, contains({_FOLD("source")}, {_FOLD("claim")}) AS contained,
    round(CASE WHEN len(q) > 0 THEN CAST(len(list_intersect(q, b)) AS DOUBLE) / len(q) ELSE 0 END, 6) AS share,
    len(list_filter(fc, lambda x: NOT list_contains(fs, x))) AS facts_missing FROM (SELECT *, list_distinct({_T.format("claim")}) AS q, {_T.format("source")} AS b,
    {_facts("claim")} AS fc, {_facts("source")} AS fs FROM pairs)),
    top AS (SELECT *, contained OR (share >= 0.4 AND facts_missing = 0) AS accepted, row_number() OVER (PARTITION BY id ORDER BY CAST(contained AS INT) DESC, share DESC, place) AS rank FROM support QUALIFY rank <= 2),
    best AS (SELECT id, bool_or(accepted) AS accepted, max(share) AS share FROM top GROUP BY 1),
    judged AS (SELECT c.id, category, expected_supported, expected_reason, coalesce(accepted, false) AS supported, CASE WHEN share IS NULL THEN 'no_source' WHEN accepted THEN 'supported'
    WHEN share < 0.4 THEN 'low_lexical_overlap' ELSE 'critical_value_mismatch' END AS reason FROM (SELECT DISTINCT ON (id) * FROM grounding_cases) c LEFT JOIN best USING (id))"""
_KAPPA = """tab AS (SELECT l, r, count(*) AS n FROM labels WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2), tot AS (SELECT sum(n) AS n FROM tab),
    po AS (SELECT sum(tab.n * {0}) / max(tot.n) AS po FROM tab, tot), pe AS (SELECT sum(a.n * b.n * {1}) / max(tot.n * tot.n) AS pe
    FROM (SELECT l, sum(n) AS n FROM tab GROUP BY 1) a, (SELECT r, sum(n) AS n FROM tab GROUP BY 1) b, tot)
    SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM po, pe, tot"""
SQL = {
    "hit_at_k": f"""WITH {_P}, h AS (SELECT d.doc_id, doc_type, r.rank AS hit FROM documents d LEFT JOIN ranked r ON r.query_id = d.doc_id AND r.doc_id = d.doc_id AND r.rank <= 10 WHERE d.doc_id % 20 = 0 AND title IS NOT NULL)
        SELECT doc_type, count(*) AS queries, round(avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
        round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1.0 / hit, 0.0)), 6) AS mrr FROM h GROUP BY 1""",
    "category_precision": f"""WITH {_P} SELECT a.category AS asked, count(*) AS rows, round(avg(CASE WHEN a.category = d.category THEN 1.0 WHEN a.category <> d.category THEN 0.0 END), 6) AS precision
        FROM ranked r JOIN documents d USING (doc_id) JOIN documents a ON a.doc_id = r.query_id WHERE r.rank <= 10 GROUP BY 1""",
    "rank_changes": f"""WITH {search._RESCORED}, a AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10), b AS (SELECT * FROM (SELECT query_id, doc_id,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM rescored) WHERE rank <= 10)
        SELECT query_id, count(*) FILTER (a.rank IS NULL) AS gained, count(*) FILTER (b.rank IS NULL) AS lost, count(*) FILTER (a.rank <> b.rank) AS moved, count(*) FILTER (a.rank = b.rank) AS kept
        FROM a FULL JOIN b USING (query_id, doc_id) GROUP BY 1""",
    "latency_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1",
    "score_histogram_pivot": """SELECT CAST(floor(score / 10) AS BIGINT) AS bucket, count(*) FILTER (decision = 'pass') AS passed, count(*) FILTER (decision = 'suspect') AS suspect,
        count(*) FILTER (decision = 'hard_fail') AS hard_fail FROM quality_metrics GROUP BY 1""",
    "run_rollup": "SELECT status, file_extension, count(*) AS rows, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM parsed_documents GROUP BY ROLLUP (status, file_extension)",
    "cross_table": "SELECT category, expected_reason, expected_supported, count(DISTINCT id) AS cases FROM grounding_cases GROUP BY 1, 2, 3",
    "claim_lexical_support": f"WITH {_SUPPORT} SELECT id, place, contained, share, facts_missing FROM support",
    "claim_topk_sources": f"WITH {_SUPPORT} SELECT id, place, chunk_id, accepted, rank FROM top",
    "claim_reasons": f"WITH {_SUPPORT} SELECT reason, expected_reason, count(*) AS cases FROM judged GROUP BY 1, 2",
    "confusion_matrix": f"""WITH {_SUPPORT}, t AS (SELECT category, count(*) FILTER (expected_supported AND supported) AS tp, count(*) FILTER (NOT expected_supported AND supported) AS fp,
        count(*) FILTER (expected_supported AND NOT supported) AS fn, count(*) FILTER (NOT expected_supported AND NOT supported) AS tn FROM judged GROUP BY 1)
        SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) / 2, 6) AS balanced,
        round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM t""",
    "cohen_kappa": f"WITH {_SUPPORT}, labels AS (SELECT CAST(expected_supported AS INT) AS l, CAST(supported AS INT) AS r FROM judged), " + _KAPPA.format("CAST(l = r AS DOUBLE)", "CAST(a.l = b.r AS DOUBLE)"),
    "quadratic_kappa": """WITH labels AS (SELECT CASE decision WHEN 'pass' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END AS l, CASE status WHEN 'success' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END AS r
        FROM quality_metrics JOIN (SELECT document_id, max(status) AS status FROM parsed_documents GROUP BY 1) USING (document_id)), """ + _KAPPA.format("(1 - pow((l - r) / 2.0, 2))", "(1 - pow((a.l - b.r) / 2.0, 2))"),
    "unique_mode": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS votes FROM c)
        SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS mode, max(votes) AS votes FROM t WHERE n = votes GROUP BY 1""",
    "majority_vote": "SELECT user_id, yes, total, CASE WHEN yes * 2 > total THEN true WHEN yes * 2 < total THEN false END AS verdict FROM (SELECT user_id, count(*) FILTER (value > 10) AS yes, count(*) AS total FROM events GROUP BY 1)",
    "win_tie_loss": f"WITH {_HALVES} SELECT event_type, wins, ties, losses FROM wtl",
    "mcnemar_exact": f"WITH {_HALVES} SELECT event_type, wins, losses, p FROM mc",
    "holm_adjust": f"""WITH {_HALVES} SELECT event_type, p, round(max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS s FROM mc)""",
    "sign_flip_exact": """WITH d AS (SELECT event_type, list(d) AS d FROM (SELECT event_type, user_id % 12 AS f, round(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0), 6) AS d
        FROM events GROUP BY 1, 2) WHERE d <> 0 GROUP BY 1), m AS (SELECT event_type, d, unnest(range(0, CAST(pow(2, len(d)) AS BIGINT))) AS m FROM d)
        SELECT event_type, CAST(max(len(d)) AS BIGINT) AS n, round(avg(CASE WHEN abs(list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN -1.0 ELSE 1.0 END * d[i + 1])))
        >= abs(list_sum(d)) - 1e-9 THEN 1.0 ELSE 0.0 END), 9) AS p FROM m GROUP BY 1""",
    "cluster_bootstrap_ci": f"""WITH {_HALVES}, c AS (SELECT event_type, user_id % 40 AS f, sum(round(b - a, 6)) AS s, count(*) AS c FROM halves WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM c),
        draws AS (SELECT event_type, b, CAST('0x' || substring(md5(b || ':' || j), 1, 8) AS BIGINT) % m AS i FROM (SELECT event_type, m, b, unnest(range(0, m)) AS j FROM (SELECT event_type, max(m) AS m, unnest(range(0, 10000)) AS b FROM p GROUP BY 1))),
        v AS (SELECT event_type, b, sum(s) / sum(c) AS v FROM draws JOIN p USING (event_type, i) GROUP BY 1, 2)
        SELECT event_type, round(mean, 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v JOIN (SELECT event_type, sum(s) / sum(c) AS mean FROM p GROUP BY 1) USING (event_type) GROUP BY 1, mean""",
}
