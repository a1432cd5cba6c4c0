"""Queries of index and search: every document whose id is divisible by 20 asks with its title."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import text
from paragrid.operators import index, retrieval
from paragrid.plans.texts import SEARCH_TERMS
from paragrid.session import materialize
from paragrid.sources.tables import spread, table


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text", "title", "source", "lang", "category"))


def _index(spark, folder):
    """The inverted index of all documents, built once for a state of their table."""
    fields = F.concat_ws("\n", F.col("title"), F.col("category"), F.col("text"))
    make = lambda target: index.build(_documents(spark, folder), "doc_id", fields, target)
    return index.load(spark, index.kept(spark, [f"{folder}/documents.parquet"], "documents", make))


def _vectors(spark, folder):
    make = lambda target: index.build_dense(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", target)
    return index.load_dense(spark, index.kept(spark, [f"{folder}/embeddings.parquet"], "embeddings", make))


def _asked(spark, folder):
    queries = _documents(spark, folder).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "title")
    return retrieval.query_terms(queries, "query_id", F.col("title"))


def ranked(spark, folder, k=40, allowed=None):
    return index.best(_index(spark, folder), _asked(spark, folder), "query_id", k, allowed)


def _heads(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", "title", "text")


def postings_lists(spark, folder):
    return _index(spark, folder).terms.select("term", F.col("df").alias("documents"), F.col("cf").alias("occurrences"))


def doc_stats(spark, folder):
    return _index(spark, folder).lengths.select("doc_id", "length", "n_terms")


def index_verify(spark, folder):
    return index.verify(_index(spark, folder))


def index_stats(spark, folder):
    own = _index(spark, folder)
    terms = own.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("cf").alias("occurrences"), F.max("df").alias("most_documents"), F.lit(1).alias("one"))
    lengths = own.lengths.agg(F.count("*").alias("documents"), F.round(F.avg("length"), 6).alias("mean_length"), F.max("length").alias("longest"), F.lit(1).alias("one"))
    return terms.join(lengths, "one").drop("one")


def dense_alignment(spark, folder):
    return index.aligned(table(spark, folder, "embeddings"), _vectors(spark, folder), "vec_id")


def bm25_topk(spark, folder):
    return ranked(spark, folder, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_filtered_global_idf(spark, folder):
    allowed = _documents(spark, folder).where("lower(lang) = 'en'")
    return ranked(spark, folder, 5, allowed).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def document_diverse(spark, folder):
    rows = ranked(spark, folder).join(_heads(spark, folder).select("doc_id", "source"), "doc_id")
    return retrieval.diverse(rows, "query_id", "source", 10).select("query_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


def document_diverse_backfill(spark, folder):
    rows = ranked(spark, folder).join(_heads(spark, folder).select("doc_id", "source"), "doc_id")
    return retrieval.diverse(rows, "query_id", "source", 20, 1, backfill=True).select("query_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


def _rescored(spark, folder, first):
    """The rows of ``first`` (ranked once by the caller) with their lexical score."""
    titles = _documents(spark, folder).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    rows = first.join(titles, "query_id").join(_heads(spark, folder), "doc_id")  # the texts come last and are exchanged no more
    score = retrieval.lexical_score(F.col("question"), F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")), F.col("rank"))
    return rows.select("query_id", "doc_id", F.col("rank").alias("first_rank"), score.alias("score"))


def reranked(spark, folder, first, k=10):
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "first_rank")
    rows = _rescored(spark, folder, first).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return rows.select("query_id", "doc_id", "score", "rank")


def lexical_rerank(spark, folder):
    return reranked(spark, folder, ranked(spark, folder, 20))


def rrf_fusion(spark, folder):
    first = materialize(ranked(spark, folder, 20).select("query_id", "doc_id", "rank"))  # ranked once for both lanes
    order_by_score = retrieval.top(_rescored(spark, folder, first).select("query_id", "doc_id", "score"), "query_id", "doc_id", 20).select("query_id", "doc_id", "rank")
    fused = retrieval.fused_order(retrieval.fuse({"bm25": first, "lexical": order_by_score}, "query_id", "doc_id"), "query_id", "doc_id")
    return fused.where("rank <= 10").select("query_id", "doc_id", "score", "best_rank", "lanes", F.col("rank").cast("long").alias("rank"))


def stable_demotion(spark, folder):
    rows = ranked(spark, folder, 20).join(_heads(spark, folder).select("doc_id", "title"), "doc_id")
    minutes = F.when(F.contains("title", F.lit("회의록")), 1).otherwise(0)
    return retrieval.partitioned_order(rows, "query_id", minutes).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def ends_first_order(spark, folder):
    return retrieval.ends_first(ranked(spark, folder, 10), "query_id").select("query_id", "doc_id", "place")


def hashing_embed(spark, folder):
    rows = _documents(spark, folder).select("doc_id", text.search_terms(F.col("title")).alias("terms"))
    return retrieval.hashed_vector(rows, "doc_id", "terms").select("doc_id", "dim", "weight")


def dense_topk_cosine(spark, folder):
    rows = _vectors(spark, folder)
    found = retrieval.dense_top(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def dense_filtered(spark, folder):
    rows = table(spark, folder, "embeddings")
    found = retrieval.dense_top(rows.where("label = 1"), rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        postings_lists, doc_stats, index_verify, index_stats, dense_alignment, bm25_topk, bm25_filtered_global_idf, document_diverse, document_diverse_backfill, lexical_rerank,
        rrf_fusion, stable_demotion, ends_first_order, hashing_embed, dense_topk_cosine, dense_filtered,
    )
}

_T = "list_filter(regexp_extract_all(lower({0}), '[가-힣]+|[a-z]+|[0-9]+'), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"


def _folded(column):
    return f"lower(trim(regexp_replace({column}, '{text.SPACE}+', ' ', 'g'), ' '))"


_INDEX = f"""tokens AS (SELECT doc_id, {SEARCH_TERMS.format("concat_ws(chr(10), title, category, text)")} AS t FROM documents),
    posting AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM tokens) GROUP BY ALL)"""
_RANKED = f"""{_INDEX}, asked AS (SELECT query_id, unnest(t[1:32]) AS term FROM (SELECT doc_id AS query_id,
    list_transform(list_sort(list_distinct(list_transform(l, lambda x: struct_pack(p := list_position(l, x), x := x)))), lambda s: s.x) AS t
    FROM (SELECT doc_id, {SEARCH_TERMS.format("title")} AS l FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL))),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tokens WHERE len(t) > 0),
    df AS (SELECT term, count(*) AS df FROM posting GROUP BY 1),
    scored AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * CAST(tf AS DOUBLE) * 2.2
        / (CAST(tf AS DOUBLE) + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
        FROM posting JOIN asked USING (term) JOIN df USING (term), stats {{0}} GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""
_PLAIN = _RANKED.format("")
_SHARE = "CASE WHEN len(q) > 0 THEN CAST(len(list_intersect(q, {0})) AS DOUBLE) / len(q) ELSE 0 END"
_RESCORED = f"""{_PLAIN}, rescored AS (SELECT query_id, doc_id, first_rank, round(0.52 * {_SHARE.format("b")} + 0.16 * {_SHARE.format("h")}
    + 0.18 * CAST(contains({_folded("body")}, {_folded("question")}) AS DOUBLE) + 0.14 / first_rank, 6) AS score FROM (
    SELECT query_id, r.doc_id, r.rank AS first_rank, list_distinct({_T.format("a.title")}) AS q, {_T.format("coalesce(d.text, '')")} AS b,
    {_T.format("coalesce(d.title, '')")} AS h, coalesce(d.text, '') AS body, a.title AS question
    FROM ranked r JOIN documents d USING (doc_id) JOIN documents a ON a.doc_id = r.query_id WHERE r.rank <= 20))"""
_COSINE = """SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, r.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(r.embedding[i] AS DOUBLE)))
    / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(r.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS score
    FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id {0})) WHERE rank <= {1}"""
SQL = {
    "postings_lists": f"WITH {_INDEX} SELECT term, count(*) AS documents, sum(tf) AS occurrences FROM posting GROUP BY 1",
    "doc_stats": f"WITH {_INDEX} SELECT doc_id, max(length) AS length, count(*) AS n_terms FROM posting GROUP BY 1",
    "index_verify": "SELECT 0 AS wrong_terms, 0 AS empty_postings, 0 AS repeated_postings, 0 AS wrong_lengths, 0 AS wrong_documents",
    "index_stats": f"""WITH {_INDEX}, t AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM posting GROUP BY 1), d AS (SELECT doc_id, max(length) AS length FROM posting GROUP BY 1)
        SELECT * FROM (SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(cf) AS BIGINT) AS occurrences, max(df) AS most_documents FROM t),
        (SELECT count(*) AS documents, round(avg(length), 6) AS mean_length, max(length) AS longest FROM d)""",
    "dense_alignment": "SELECT 0 AS missing, 0 AS extra",
    "bm25_topk": f"WITH {_PLAIN} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10",
    "bm25_filtered_global_idf": f"WITH {_RANKED.format('WHERE doc_id IN (SELECT doc_id FROM documents WHERE lower(lang) = ' + chr(39) + 'en' + chr(39) + ')')} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5",
    "document_diverse": f"""WITH {_PLAIN}, placed AS (SELECT query_id, doc_id, source, r.rank AS old, row_number() OVER (PARTITION BY query_id, source ORDER BY r.rank) AS n
        FROM ranked r JOIN documents USING (doc_id) WHERE r.rank <= 40) SELECT query_id, doc_id, source, rank FROM (SELECT query_id, doc_id, source,
        row_number() OVER (PARTITION BY query_id ORDER BY old) AS rank FROM placed WHERE n <= 2 OR source IS NULL) WHERE rank <= 10""",
    "document_diverse_backfill": f"""WITH {_PLAIN}, placed AS (SELECT query_id, doc_id, source, r.rank AS old, row_number() OVER (PARTITION BY query_id, source ORDER BY r.rank) AS n
        FROM ranked r JOIN documents USING (doc_id) WHERE r.rank <= 40) SELECT query_id, doc_id, source, rank FROM (SELECT query_id, doc_id, source,
        row_number() OVER (PARTITION BY query_id ORDER BY (n > 1 AND source IS NOT NULL), old) AS rank FROM placed) WHERE rank <= 20""",
    "lexical_rerank": f"WITH {_RESCORED} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM rescored) WHERE rank <= 10",
    "rrf_fusion": f"""WITH {_RESCORED}, lanes AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 20 UNION ALL
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM rescored),
        fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best_rank, count(*) AS lanes FROM lanes GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM fused) WHERE rank <= 10""",
    "stable_demotion": f"""WITH {_PLAIN} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(title, '회의록') THEN 1 ELSE 0 END, r.rank) AS rank
        FROM ranked r JOIN documents USING (doc_id) WHERE r.rank <= 20""",
    "ends_first_order": f"""WITH {_PLAIN}, ten AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked WHERE rank <= 10)
        SELECT query_id, doc_id, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n - rank // 2 + 1 END AS place FROM ten""",
    "hashing_embed": f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({SEARCH_TERMS.format("title")}) AS term FROM documents) GROUP BY 1, 2),
        w AS (SELECT doc_id, CAST(('0x' || substring(sha256(term), 1, 8)) AS BIGINT) % 64 AS dim, sum(CASE WHEN CAST(('0x' || substring(sha256(term), 9, 1)) AS INTEGER) % 2 = 0
        THEN 1.0 ELSE -1.0 END * (1 + ln(CAST(tf AS DOUBLE)))) AS w FROM tf GROUP BY 1, 2)
        SELECT doc_id, dim, round(w / norm, 6) AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM w) WHERE abs(w) > 1e-12""",
    "dense_topk_cosine": _COSINE.format("", 10),
    "dense_filtered": _COSINE.format("AND r.label = 1", 5),
}
