"""Queries of evidence and context: every paragraph whose place is divisible by 20 (for recalls and unique documents, every paragraph) asks the chunks with
its first sentence; its evidence are the chunks that hold one of its sentences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import text
from paragrid.operators import context, curation, evidence, index, retrieval
from paragrid.plans.search import _PLAIN, _T, _documents, _folded, _heads, ranked
from paragrid.plans.texts import SEARCH_TERMS
from paragrid.session import materialize
from paragrid.sources.tables import spread, table

_FIELDS = ("institution", "file_name", "relative_path", "file_extension", "source_title", "source_host", "category", "text")


def _pieces(spark, folder):
    columns = "chunk_id", "document_id", "chunk_index", "section_path_json", *_FIELDS
    return curation.least(spread(table(spark, folder, "chunks").select(*columns)), "chunk_id")


def _index(spark, folder):
    make = lambda target: index.build(_pieces(spark, folder), "chunk_id", F.concat_ws("\n", *_FIELDS), target)
    return index.load(spark, index.kept(spark, [f"{folder}/chunks.parquet"], "chunks", make))


def _claims(spark, folder, every=False):
    """The claims of the paragraphs whose place is divisible by 20, or of ``every`` paragraph."""
    rows = table(spark, folder, "blocks").where("block_type = 'paragraph' and text is not null")
    rows = rows if every else rows.where("reading_order % 20 = 0")
    rows = rows.groupBy(F.col("block_id").alias("id")).agg(F.min("text").alias("text"), F.min("document_id").alias("document_id"))
    cut = rows.select("id", "document_id", text.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return cut.select("id", "document_id", F.get("s", 0).alias("claim"), F.transform("s", lambda x: F.struct(x.alias("text"))).alias("sources"))


def _marked(spark, folder, every=False):
    """The claims with ``mark``, the same for those of one wording, white space aside: one search and one answer hold for all of these."""
    return _claims(spark, folder, every).withColumn("mark", F.md5(text.fold_space(F.col("claim"))))


def _best(spark, folder, wordings, key, k):
    """The ``k`` best chunks of ``wordings``, which have a claim for each ``key``."""
    return index.best(_index(spark, folder), retrieval.query_terms(wordings, key, F.col("claim")), key, k)


def _wordings(spark, folder, every=False):
    """``(id, mark)`` of the claims, and ``(mark, claim)`` once for all of one wording."""
    marked = materialize(_marked(spark, folder, every).select("id", "claim", "mark"))
    return marked.select("id", "mark"), marked.groupBy("mark").agg(F.min("claim").alias("claim"))


def _ranked(spark, folder, k):
    claims, wordings = _wordings(spark, folder)
    return claims.join(_best(spark, folder, wordings, "mark", k), "mark").drop("mark")


def _cases(spark, folder):
    """``(id, case)`` of the claims of every paragraph, and ``(case, claim, quotes)`` once for all that have the same sentences, white space aside."""
    rows = _claims(spark, folder, True).select("id", "claim", F.transform("sources.text", text.fold_space).alias("quotes"))
    rows = materialize(rows.withColumn("case", F.md5(F.to_json("quotes"))))
    return rows.select("id", "case"), rows.groupBy("case").agg(F.min("claim").alias("claim"), F.min("quotes").alias("quotes"))


def _spaced(spark, folder):
    return _pieces(spark, folder).select("chunk_id", text.fold_space(F.col("text")).alias("text"))


def _gold(spark, folder):
    """``(id, place, chunk_id)``: the chunks that hold a source text, white space aside."""
    quotes = _claims(spark, folder).select("id", F.posexplode("sources.text").alias("place", "quote"))
    quotes = quotes.select(F.struct("id", F.col("place").cast("long").alias("place")).alias("quote_id"), text.fold_space(F.col("quote")).alias("quote"))
    return evidence.contained(quotes, "quote_id", "quote", _spaced(spark, folder), "chunk_id", "text", unique=True).select("quote_id.*", "chunk_id")


def quote_containment(spark, folder):
    quotes = _claims(spark, folder).select("id", F.posexplode("sources.text").alias("place", "quote")).select(F.concat_ws("#", "id", "place").alias("quote_id"), text.rank_form(F.col("quote")).alias("quote"))
    blocks = table(spark, folder, "blocks").select("block_id", text.rank_form(F.col("text")).alias("text"))
    return evidence.contained(quotes, "quote_id", "quote", blocks, "block_id", "text")


def leakage_intersect(spark, folder):
    """Sentences of the cases that stand in other documents too, with the number of those: leaks if the cases are held out."""
    quotes = _claims(spark, folder).select(F.col("document_id").alias("own"), F.posexplode("sources.text").alias("n", "quote"), "id")
    quotes = quotes.select("own", F.concat_ws("#", "id", "n").alias("part"), text.rank_form(F.col("quote")).alias("quote"))
    blocks = table(spark, folder, "blocks").select("document_id", text.rank_form(F.col("text")).alias("text")).where("document_id is not null")
    # The documents of a sentence are counted once for all cases that have it; the case's own one is taken off.
    quotes = quotes.withColumn("mark", F.md5("quote"))
    found = materialize(evidence.contained(quotes, "mark", "quote", blocks, "document_id", "text"))
    counted = quotes.select("part", "own", "mark").join(found.groupBy("mark").agg(F.count("*").alias("n")), "mark")
    own = found.select("mark", F.col("document_id").alias("own"), F.lit(1).alias("here"))
    others = counted.join(own, ["mark", "own"], "left").select("part", (F.col("n") - F.coalesce("here", F.lit(0))).alias("documents"))
    return others.where("documents > 0")


def near_evidence(spark, folder):
    cases = table(spark, folder, "grounding_cases").groupBy("id").agg(F.min("claim").alias("claim"), F.min_by("sources", "claim").alias("sources"))
    pairs = cases.select("id", "claim", F.posexplode("sources.text").alias("place", "source"))
    found = evidence.near(pairs.select("id", "place", text.fold_space(F.col("claim")).alias("claim"), text.fold_space(F.col("source")).alias("source")), "claim", "source")
    return found.select("id", F.col("place").cast("long").alias("place"), "ratio", "matched", "reason")


def evidence_recall(spark, folder):
    claims, cases = _cases(spark, folder)
    counted = evidence.holding(cases, "case", "quotes", _best(spark, folder, cases, "case", 8), _spaced(spark, folder), "chunk_id", "text")
    wanted, found = F.col("wanted"), F.col("found")
    return claims.join(counted, "case").select("id", "wanted", "found", F.round(found / wanted, 6).alias("recall"), (found > 0).alias("any_found"), (found == wanted).alias("all_found"))


def claim_recall(spark, folder):
    claims, cases = _cases(spark, folder)
    first = materialize(_best(spark, folder, cases, "case", 5).select("case", "chunk_id"))
    places = cases.select("case", F.posexplode("quotes").alias("place", "quote")).select("case", F.concat_ws("#", "case", "place").alias("part"), F.array("quote").alias("quotes"))
    counted = evidence.holding(places, "part", "quotes", places.select("case", "part").join(first, "case"), _spaced(spark, folder), "chunk_id", "text")
    met = counted.groupBy(F.substring_index("part", "#", 1).alias("case")).agg(F.count("*").alias("claims"), F.count_if(F.col("found") > 0).alias("found"))
    return claims.join(met, "case").select("id", "claims", "found", F.round(F.col("found") / F.col("claims"), 6).alias("recall"))


def table_relations(spark, folder):
    rows = table(spark, folder, "blocks")
    tables = rows.where("block_type = 'table'").select("table_id", "text").distinct()
    stored = rows.where("block_type = 'table_cell'").select("table_id", "row_no", "column_no", F.col("text").alias("stored")).distinct()
    found = evidence.cells(tables, "table_id", "text").join(stored, ["table_id", "row_no", "column_no"], "full")
    return found.groupBy("table_id").agg(F.count("*").alias("cells"), F.count_if(F.col("value") == F.trim("stored")).alias("equal"), F.count_if(F.col("stored").isNull()).alias("only_text"), F.count_if(F.col("value").isNull()).alias("only_cells"))


def table_value_relations(spark, folder):
    rows = table(spark, folder, "blocks").where("block_type = 'table'").select("table_id", "text").distinct()
    own = evidence.cells(rows, "table_id", "text").where("row_no in (1, 2) and column_no > 0")
    shift = F.lead("value").over(W.partitionBy("table_id").orderBy("row_no", "column_no"))
    asked = own.withColumn("value", F.when(F.col("row_no") == 2, F.coalesce(shift, F.lit("none"))).otherwise(F.col("value"))).select("table_id", "header", "anchor", "value").distinct()
    return evidence.relation_holds(asked, rows, "table_id", "text").groupBy("holds").agg(F.count("*").alias("relations"))


def folded_documents(spark, folder):
    hits = _ranked(spark, folder, 40).join(_pieces(spark, folder).select("chunk_id", "document_id"), "chunk_id")
    return evidence.folded(hits, "id", F.col("document_id")).where("document_rank <= 10").select("id", "document_rank", "document_id", "chunk_id")


def title_hits(spark, folder):
    pieces = _pieces(spark, folder)
    about = pieces.select("chunk_id", "source_title", "source_host")
    hits = _ranked(spark, folder, 40).select("id", "rank", "chunk_id").join(pieces.select("chunk_id", "document_id"), "chunk_id")
    first = evidence.folded(hits, "id", F.col("document_id")).where("document_rank <= 10").join(about, "chunk_id")  # only these need their titles
    documents = first.select("id", "document_rank", F.lower(text.fold_space(F.coalesce("source_title", F.lit("")))).alias("title_form"), F.lower("source_host").alias("host"))
    # A wording's least title and host are found once for all claims that have it, so no pair of claim and chunk is exchanged.
    quotes = _claims(spark, folder).select("id", F.explode("sources.text").alias("quote")).select("id", text.fold_space(F.col("quote")).alias("quote")).withColumn("mark", F.md5("quote"))
    titled = F.struct(F.lower(text.fold_space(F.col("source_title"))).alias("title"), F.lower("source_host").alias("host"))
    met = evidence.contained(quotes, "mark", "quote", pieces.select(titled.alias("titled"), text.fold_space(F.col("text")).alias("text")), "titled", "text", unique=True)
    least = met.groupBy("mark").agg(F.min("titled.title").alias("title"), F.min("titled.host").alias("host"))
    expected = quotes.select("id", "mark").join(least, "mark").groupBy("id").agg(F.min("title").alias("wanted_title"), F.min("host").alias("wanted_host")).where("wanted_title is not null")
    return evidence.title_hits(documents, expected, "id", 10).select("id", "hit_rank", "same_host")


def fallback_rerank(spark, folder):
    """BM25's first 40 by the fallback score, two of a source first, the others behind them."""
    titles = _documents(spark, folder).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    rows = ranked(spark, folder, 40).join(titles, "query_id").join(_documents(spark, folder), "doc_id")  # the texts come last and are exchanged no more
    about = F.concat_ws(" ", "source", "title", "category")
    scored = rows.select("query_id", "doc_id", "source", F.col("rank").alias("first_rank"), context.fallback_score(F.col("question"), F.coalesce("text", F.lit("")), about, F.col("rank")).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "first_rank", "doc_id")
    placed = scored.withColumn("rank", F.row_number().over(order))
    return retrieval.diverse(placed, "query_id", "source", 10, backfill=True).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def anchor_protection(spark, folder):
    hits = materialize(ranked(spark, folder, 20).join(_heads(spark, folder).select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "source", "rank"))
    anchors = hits.withColumn("n", F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))).where("n = 3").groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    return context.protected(hits, "query_id", "source", anchors, "doc_id", 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def ends_first_sources(spark, folder):
    hits = ranked(spark, folder, 10).join(_heads(spark, folder).select("doc_id", "source"), "doc_id")
    return context.ends_first_documents(hits, "query_id", F.coalesce("source", F.col("doc_id").cast("string"))).select("query_id", "doc_id", "place")


def fallback_slots(spark, folder):
    hits = materialize(ranked(spark, folder, 20).join(_heads(spark, folder).select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "source", "rank"))
    first = retrieval.diverse(hits, "query_id", "source", 8)
    found = context.fallback_rows(first, hits, "query_id", "doc_id", 3)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def answer_sentences(spark, folder):
    claims, wordings = _wordings(spark, folder)
    hits = _best(spark, folder, wordings, "mark", 5).join(wordings, "mark").join(_pieces(spark, folder).select("chunk_id", "text"), "chunk_id")
    found = context.answer_sentences(hits, "mark", F.col("claim"), F.col("text")).select("mark", "place", F.md5("sentence").alias("sentence"), "score")
    return claims.join(found, "mark").select("id", "place", F.col("sentence").alias("mark"), "score")


def expand_sections(spark, folder):
    pieces = _pieces(spark, folder).where("text is not null and chunk_index is not null")
    section = F.when(~F.col("section_path_json").isin("null", "[]"), F.col("section_path_json"))
    sized = pieces.select("document_id", F.col("chunk_index").cast("long").alias("place"), F.struct("chunk_id", section.alias("section"), F.length("text").alias("size")).alias("p"))
    sized = sized.groupBy("document_id", "place").agg(F.min("p").alias("p")).select("document_id", "place", "p.*")  # of several at one place the one of the least id
    claims, wordings = _wordings(spark, folder)
    hits = _best(spark, folder, wordings, "mark", 5).select("mark", "rank", "chunk_id")
    found = context.expanded(hits, sized, "mark", texts=pieces.select("chunk_id", "text")).select(F.col("mark").alias("wording"), "chunk_id", "mode", "pieces", "chars", F.md5("text").alias("mark"))
    return claims.withColumnRenamed("mark", "wording").join(found, "wording").drop("wording").select("id", "chunk_id", "mode", "pieces", "chars", "mark")


def merged_occurrences(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_id", "institution", "source_title", "source_host", "published_at", "char_count", F.from_json("block_ids_json", "array<string>").alias("block_ids"))
    found = context.merged(rows, "chunk_id", ["block_ids"], F.coalesce("source_host", F.lit("none")), F.coalesce("char_count", F.lit(1_000_000)).cast("long"))
    return found.select("chunk_id", "best_rank", F.size("block_ids").cast("long").alias("blocks"), "occurrences")


def hybrid_search(spark, folder):
    """BM25 and signed hashing of terms as a dense lane, four times as wide as the ten results, fused by rank."""
    rows = _documents(spark, folder).select("doc_id", F.concat_ws("\n", "title", "category", "text").alias("body"), "title")
    kept = index.kept(spark, [f"{folder}/documents.parquet"], "hashed", lambda target: index.build_dense(retrieval.dense_rows(rows, "doc_id", text.term_bag(F.col("body"))), "doc_id", "vector", target))
    queries = retrieval.dense_rows(rows.where("doc_id % 20 = 0 and title is not null"), "doc_id", text.term_bag(F.col("title")))
    dense = retrieval.dense_top(index.load_dense(spark, kept), queries, "doc_id", "vector", 40, itself=True).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    fused = retrieval.fused_order(retrieval.fuse({"bm25": ranked(spark, folder, 40).select("query_id", "doc_id", "rank"), "dense": dense}, "query_id", "doc_id"), "query_id", "doc_id")
    return fused.where("rank <= 10").select("query_id", "doc_id", "score", "lanes", F.col("rank").cast("long").alias("rank"))


def asked_widths(spark, folder):
    rows = table(spark, folder, "events").select(F.get_json_object("props", "$.k").alias("k")).distinct()
    k = context.clamp(F.col("k"), 5)
    return rows.select("k", k.alias("results"), context.widths(k).alias("candidates"), context.widths(k, 1, 80).alias("chat")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        quote_containment, leakage_intersect, near_evidence, evidence_recall, claim_recall, table_relations, table_value_relations, folded_documents, title_hits,
        fallback_rerank, anchor_protection, ends_first_sources, fallback_slots, answer_sentences, expand_sections, merged_occurrences, hybrid_search, asked_widths,
    )
}

_C = """claims AS (SELECT id, document_id, l[1] AS claim, list_transform(l, lambda x: struct_pack(text := x)) AS sources FROM (SELECT block_id AS id, min(document_id) AS document_id,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(min(text), '([가-힣A-Za-z)\\]’"][.!?])[ \\t]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS l
    FROM blocks WHERE block_type = 'paragraph' AND reading_order % 20 = 0 AND text IS NOT NULL GROUP BY 1) WHERE len(l) > 0)"""
_Q = f"{_C}, quotes AS (SELECT id, n - 1 AS place, sources[n].text AS quote FROM (SELECT id, sources, unnest(range(1, len(sources) + 1)) AS n FROM claims))"
_P = "pieces AS (SELECT chunk_id, " + ", ".join(f"min({c}) AS {c}" for c in ("document_id", "chunk_index", "section_path_json", *_FIELDS)) + " FROM chunks GROUP BY 1)"
_SPACED = f"trim(regexp_replace({{0}}, '{text.SPACE}+', ' ', 'g'), ' ')".replace("{0}", "@")


def _fold(column):
    return _SPACED.replace("@", column)


_ASKED = f"""{_Q}, {_P}, tokens AS (SELECT chunk_id, {SEARCH_TERMS.format("concat_ws(chr(10), " + ", ".join(_FIELDS) + ")")} AS t FROM pieces),
    posting AS (SELECT chunk_id, term, length, count(*) AS tf FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM tokens) GROUP BY ALL),
    asked AS (SELECT id, unnest(t[1:32]) AS term FROM (SELECT id, list_transform(list_sort(list_distinct(list_transform(l, lambda x: struct_pack(p := list_position(l, x), x := x)))), lambda s: s.x) AS t
    FROM (SELECT id, {SEARCH_TERMS.format("claim")} AS l FROM claims))),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tokens WHERE len(t) > 0), df AS (SELECT term, count(*) AS df FROM posting GROUP BY 1),
    scored AS (SELECT id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * CAST(tf AS DOUBLE) * 2.2 / (CAST(tf AS DOUBLE) + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
        FROM posting JOIN asked USING (term) JOIN df USING (term), stats GROUP BY 1, 2),
    hits AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM scored),
    gold AS (SELECT DISTINCT id, place, chunk_id FROM quotes JOIN pieces ON quote <> '' AND contains({_fold("text")}, {_fold("quote")}))"""
_EVERY = _ASKED.replace(" AND reading_order % 20 = 0", "")  # the claims of every paragraph
_SOURCES = f"{_PLAIN}, s AS (SELECT query_id, doc_id, source, r.rank AS old FROM ranked r JOIN documents USING (doc_id) WHERE r.rank <= 20), g AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY old) AS n FROM s)"
_MATRIX = r"""m AS (SELECT table_id, list_transform(list_filter(string_split(text, chr(10)), lambda r: trim(r, ' ') <> ''), lambda r: list_transform(CASE WHEN contains(r, chr(9)) THEN string_split(r, chr(9))
        WHEN regexp_matches(r, '[|│]') THEN regexp_split_to_array(regexp_replace(r, '^\s*[|│]|[|│]\s*$', '', 'g'), '[|│]') ELSE regexp_split_to_array(r, ' {2,}') END, lambda c: trim(c, ' '))) AS m
        FROM (SELECT DISTINCT table_id, text FROM blocks WHERE block_type = 'table')),
    r AS (SELECT table_id, m[1] AS head, i - 1 AS row_no, m[i] AS r FROM (SELECT table_id, m, unnest(range(1, len(m) + 1)) AS i FROM m)),
    c AS (SELECT table_id, row_no, j - 1 AS column_no, head[j] AS header, r[1] AS anchor, r[j] AS value FROM (SELECT *, unnest(range(1, len(r) + 1)) AS j FROM r))"""
SQL = {
    "quote_containment": f"WITH {_Q} SELECT DISTINCT id || '#' || place AS quote_id, block_id FROM quotes JOIN blocks ON quote <> '' AND contains({_folded('text')}, {_folded('quote')})",
    "leakage_intersect": f"""WITH {_Q}, parts AS (SELECT document_id AS own, id || '#' || place AS part, {_folded("quote")} AS q FROM quotes JOIN claims USING (id)),
        b AS (SELECT DISTINCT document_id, {_folded("text")} AS t FROM blocks) SELECT part, count(DISTINCT document_id) AS documents FROM parts JOIN b ON document_id <> own AND contains(t, q) GROUP BY 1""",
    "evidence_recall": f"""WITH {_EVERY} SELECT id, count(*) AS wanted, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, count(rank) > 0 AS any_found, count(rank) = count(*) AS all_found
        FROM (SELECT DISTINCT id, chunk_id FROM gold) LEFT JOIN (SELECT * FROM hits WHERE rank <= 8) USING (id, chunk_id) GROUP BY 1""",
    "claim_recall": f"""WITH {_EVERY}, c AS (SELECT id, place, count(rank) > 0 AS f FROM gold LEFT JOIN (SELECT * FROM hits WHERE rank <= 5) USING (id, chunk_id) GROUP BY 1, 2)
        SELECT id, count(*) AS claims, count(*) FILTER (f) AS found, round(count(*) FILTER (f) / count(*), 6) AS recall FROM c GROUP BY 1""",
    "table_relations": f"""WITH {_MATRIX}, s AS (SELECT DISTINCT table_id, row_no, column_no, text AS stored FROM blocks WHERE block_type = 'table_cell')
        SELECT table_id, count(*) AS cells, count(*) FILTER (value = trim(stored, ' ')) AS equal, count(*) FILTER (stored IS NULL) AS only_text, count(*) FILTER (value IS NULL) AS only_cells FROM c FULL JOIN s USING (table_id, row_no, column_no) GROUP BY 1""",
    "table_value_relations": f"""WITH {_MATRIX}, o AS (SELECT * FROM c WHERE row_no IN (1, 2) AND column_no > 0), a AS (SELECT DISTINCT table_id, header, anchor, CASE WHEN row_no = 2
        THEN coalesce(lead(value) OVER (PARTITION BY table_id ORDER BY row_no, column_no), 'none') ELSE value END AS value FROM o)
        SELECT holds, count(*) AS relations FROM (SELECT EXISTS (SELECT 1 FROM c WHERE c.row_no > 0 AND c.table_id = a.table_id AND c.header = a.header AND c.anchor = a.anchor AND c.value = a.value) AS holds FROM a) GROUP BY 1""",
    "folded_documents": f"""WITH {_ASKED}, f AS (SELECT id, document_id, min(h.rank) AS rank, arg_min(chunk_id, h.rank) AS chunk_id FROM hits h JOIN pieces USING (chunk_id) WHERE h.rank <= 40 GROUP BY 1, 2)
        SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY rank) AS document_rank, document_id, chunk_id FROM f) WHERE document_rank <= 10""",
    "title_hits": f"""WITH {_ASKED}, f AS (SELECT id, document_id, min(h.rank) AS rank, arg_min(chunk_id, h.rank) AS chunk_id FROM hits h JOIN pieces USING (chunk_id) WHERE h.rank <= 40 GROUP BY 1, 2),
        d AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY rank) AS r, lower({_fold("source_title")}) AS title, lower(source_host) AS host FROM f JOIN pieces USING (chunk_id)),
        e AS (SELECT id, min(lower({_fold("source_title")})) AS want, min(lower(source_host)) AS h FROM gold JOIN pieces USING (chunk_id) GROUP BY 1)
        SELECT id, min(r) AS hit_rank, arg_min(h IS NULL OR h = host, r) AS same_host FROM e LEFT JOIN (SELECT * FROM d WHERE r <= 10) d USING (id) WHERE want IS NOT NULL AND contains(title, want) AND want <> '' GROUP BY 1
        UNION ALL SELECT id, NULL, NULL FROM e WHERE want IS NOT NULL AND id NOT IN (SELECT id FROM e JOIN d USING (id) WHERE r <= 10 AND contains(title, want) AND want <> '')""",
    "fallback_rerank": f"""WITH {_PLAIN}, x AS (SELECT query_id, r.doc_id, d.source, r.rank AS fr, list_distinct({_T.format("a.title")}[1:24]) AS q, coalesce(d.text, '') AS body, concat_ws(' ', d.source, d.title, d.category) AS about, a.title AS question
        FROM ranked r JOIN documents d USING (doc_id) JOIN documents a ON a.doc_id = r.query_id WHERE r.rank <= 40),
        y AS (SELECT query_id, doc_id, source, fr, CASE WHEN len(q) > 0 THEN round(0.42 * len(list_intersect(q, {_T.format("body")})) / len(q) + 0.10 * len(list_intersect(q, {_T.format("about")})) / len(q)
        + 0.12 * CAST(contains({_folded("body")}, {_folded("question")}) AS DOUBLE) + 0.36 * len(list_filter(q, lambda t: contains(array_to_string(regexp_extract_all(lower(body), '{context.ARTICLE}'), ' '), t))) / len(q) + 0.10 / fr, 6) ELSE 0.0 END AS score FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, doc_id) AS o FROM y), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY o) AS n FROM z)
        SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY (n > 2 AND source IS NOT NULL), o) AS rank FROM w) WHERE rank <= 10""",
    "anchor_protection": f"""WITH {_SOURCES}, a AS (SELECT query_id, arg_min(doc_id, old) AS anchor FROM g WHERE n = 3 GROUP BY 1),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY old) AS pick FROM g WHERE n <= 2 OR source IS NULL) WHERE pick <= 10),
        e AS (SELECT query_id, max(pick) AS c, max(old) AS far FROM p GROUP BY 1),
        t AS (SELECT g.query_id, g.doc_id, max(p.pick) AS pick FROM g JOIN a ON a.query_id = g.query_id AND a.anchor = g.doc_id JOIN e ON e.query_id = g.query_id JOIN p ON p.query_id = g.query_id AND p.source = g.source
            WHERE g.n > 2 AND (g.old < far OR c < 10) GROUP BY 1, 2)
        SELECT p.query_id, coalesce(t.doc_id, p.doc_id) AS doc_id, pick AS rank FROM p LEFT JOIN t USING (query_id, pick)""",
    "ends_first_sources": f"""WITH {_PLAIN}, h AS (SELECT query_id, doc_id, r.rank AS old, coalesce(source, CAST(doc_id AS VARCHAR)) AS s FROM ranked r JOIN documents USING (doc_id) WHERE r.rank <= 10),
        f AS (SELECT *, min(old) OVER (PARTITION BY query_id, s) AS first FROM h), t AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) - 1 AS turn FROM f)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN turn % 2 = 0 THEN turn ELSE 1000 - turn END, old) AS place FROM t""",
    "fallback_slots": f"""WITH {_SOURCES}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY old) AS pick FROM g WHERE n <= 2 OR source IS NULL) WHERE pick <= 8)
        SELECT query_id, doc_id, slot + last AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY old) AS slot FROM g ANTI JOIN p USING (query_id, doc_id)) JOIN (SELECT query_id, max(pick) AS last FROM p GROUP BY 1) USING (query_id) WHERE slot <= 3""",
    "answer_sentences": f"""WITH {_ASKED}, l AS (SELECT id, h.rank, claim, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([가-힣A-Za-z)\\]’"][.!?])[ \\t]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS l
        FROM hits h JOIN pieces USING (chunk_id) JOIN claims USING (id) WHERE h.rank <= 5), s AS (SELECT id, rank, claim, n, l[n] AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM l)),
        u AS (SELECT *, list_distinct({_T.format("claim")}) AS q, {_T.format("s")} AS b FROM s QUALIFY row_number() OVER (PARTITION BY id, substring(s, 1, 80) ORDER BY rank, n) = 1),
        v AS (SELECT id, rank, n, s, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, b)) / len(q) ELSE 0 END + 1 / (rank + 2), 6) AS score FROM u)
        SELECT id, place, md5(s) AS mark, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank, n) AS place FROM v) WHERE place <= 8""",
    "merged_occurrences": """SELECT chunk_id, CAST(min(coalesce(char_count, 1000000)) AS BIGINT) AS best_rank, max(n) AS blocks, count(*) AS occurrences FROM chunks JOIN (SELECT chunk_id, count(DISTINCT b) AS n
        FROM (SELECT chunk_id, unnest(CAST(block_ids_json AS JSON)::VARCHAR[]) AS b FROM chunks) GROUP BY 1) USING (chunk_id) GROUP BY 1""",
    "hybrid_search": f"""WITH {_PLAIN}, bag AS (SELECT doc_id, 0 AS side, {SEARCH_TERMS.format("concat_ws(chr(10), title, category, text)")} AS t FROM documents UNION ALL SELECT doc_id, 1, {SEARCH_TERMS.format("title")} FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
        tfs AS (SELECT doc_id, side, term, count(*) AS tf FROM (SELECT doc_id, side, unnest(t) AS term FROM bag) GROUP BY ALL),
        h AS (SELECT term, CAST('0x' || substring(sha256(term), 1, 8) AS BIGINT) % 64 AS dim, CASE WHEN CAST('0x' || substring(sha256(term), 9, 1) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT term FROM tfs)),
        w AS (SELECT doc_id, side, dim, sum(sign * (1 + ln(CAST(tf AS DOUBLE)))) AS w FROM tfs JOIN h USING (term) GROUP BY ALL), nrm AS (SELECT doc_id, side, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1, 2),
        v AS (SELECT doc_id, side, dim, CAST(round(w / nrm, 6) AS FLOAT) AS w FROM w JOIN nrm USING (doc_id, side)), vn AS (SELECT doc_id, side, sqrt(sum(CAST(w AS DOUBLE) * w)) AS nrm FROM v GROUP BY 1, 2),
        cs AS (SELECT q.doc_id AS query_id, d.doc_id, sum(CAST(q.w AS DOUBLE) * d.w) AS dot FROM v q JOIN v d USING (dim) WHERE q.side = 1 AND d.side = 0 GROUP BY 1, 2),
        al AS (SELECT q.doc_id AS query_id, d.doc_id, round(coalesce(dot, 0) / q.nrm / d.nrm, 6) AS score FROM vn q JOIN vn d ON q.side = 1 AND d.side = 0 LEFT JOIN cs ON cs.query_id = q.doc_id AND cs.doc_id = d.doc_id),
        dense AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al) WHERE rank <= 40),
        fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS b, count(*) AS lanes FROM (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 40 UNION ALL SELECT * FROM dense) GROUP BY 1, 2)
        SELECT query_id, doc_id, score, lanes, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b, doc_id) AS rank FROM fu) WHERE rank <= 10""",
    "asked_widths": """SELECT DISTINCT k, r AS results, greatest(20, r, 4 * r) AS candidates, least(80, greatest(1, r, 4 * r)) AS chat FROM (SELECT k, greatest(1, least(20, coalesce(TRY_CAST(k AS INT), 5))) AS r FROM (SELECT json_extract_string(props, '$.k') AS k FROM events))""",
}
