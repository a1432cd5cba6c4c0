"""Queries of the scalar text, URL and identifier functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.functions import ids, text, urls
from paragrid.sources.tables import spread, table

_SPACE = text.SPACE
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[가-힣]+|[a-z]+|[0-9]+'), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"
SEARCH_TERMS = (
    "flatten(list_transform(" + _TERMS + ", lambda t: CASE WHEN regexp_matches(t, '^[가-힣]') "
    "THEN list_concat([t], list_transform(range(1, length(t)), lambda n: substring(t, n, 2))) ELSE [t] END))"
)


def tokenize_terms(spark, folder):
    found = spread(table(spark, folder, "documents")).select("doc_id", text.terms(F.col("text")).alias("terms"))
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.md5(F.array_join("terms", " ")).alias("mark")).where("n_terms >= 0")


def search_text(spark, folder):
    fields = F.concat_ws("\n", "institution", "file_name", "relative_path", "file_extension", "source_title", "source_host", "category", "text")
    found = table(spark, folder, "chunks").select("chunk_id", text.search_terms(fields).alias("terms")).distinct()
    return found.select("chunk_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("mark"))


def fold_whitespace(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", F.md5(text.fold_space(F.col("text"))).alias("mark"), F.length(text.fold_space(F.col("text"))).cast("long").alias("n_chars"))


def clean_text(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", F.md5(text.clean(F.col("text"))).alias("mark"))


def title_fingerprint(spark, folder):
    keyed = spread(table(spark, folder, "documents")).select(text.title_key(F.col("title")).alias("title_key"))
    return keyed.where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("documents"))


def content_terms(spark, folder):
    found = spread(table(spark, folder, "documents")).select(F.explode(text.stems(F.col("text"))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("documents"))


def number_values(spark, folder):
    found = spread(table(spark, folder, "documents")).select("doc_id", text.numbers(F.col("text")).alias("n"))
    return found.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.md5(F.array_join("n", " ")).alias("mark")).where("n_numbers >= 0")


def critical_values(spark, folder):
    cases = table(spark, folder, "grounding_cases").select("id", "claim").distinct()
    return cases.select("id", F.explode(text.critical_values(F.col("claim"))).alias("fact"))


def sentence_split(spark, folder):
    rows = spread(table(spark, folder, "documents")).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.md5("sentence").alias("mark"), F.length("sentence").cast("long").alias("n_chars"))


def document_ids(spark, folder):
    rows = table(spark, folder, "parsed_documents")
    return rows.select(ids.document_id(F.col("relative_path"), F.col("source_sha256")).alias("made_id"), "source_sha256").distinct()


def block_ids(spark, folder):
    rows = table(spark, folder, "blocks").select("block_id", ids.block_id(F.col("document_id"), F.col("reading_order")).alias("made"))
    return rows.distinct().groupBy((F.col("block_id") == F.col("made")).alias("same")).agg(F.count("*").alias("blocks"))


def url_parts(spark, folder):
    u = F.col("source_url")
    rows = table(spark, folder, "parsed_documents").select(*(urls.part(u, p).alias(p) for p in ("scheme", "host", "path", "query")))
    return rows.groupBy("scheme", "host").agg(F.countDistinct("path").alias("paths"), F.count_if(F.col("query") != "").alias("with_query"))


def url_canonical(spark, folder):
    rows = table(spark, folder, "chunks").select(F.explode(F.array("source_url", "download_url")).alias("url"))
    return rows.where("url is not null").select("url", urls.canonical(F.col("url")).alias("canonical_url")).distinct()


def blind_order(spark, folder):
    from pyspark.sql import Window as W

    cases = table(spark, folder, "grounding_cases").select("id", "category").distinct()
    order = W.partitionBy("category").orderBy(ids.seeded_order("review", F.col("id")), "id")
    return cases.select("id", "category", F.row_number().over(order).cast("long").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, search_text, fold_whitespace, clean_text, title_fingerprint, content_terms, number_values,
        critical_values, sentence_split, document_ids, block_ids, url_parts, url_canonical, blind_order,
    )
}

_STEMS = f"list_distinct(list_transform({_TERMS.format('text')}, lambda t: regexp_replace(t, '^(..+?)({text.PARTICLES})$', '\\1')))"
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:@]+)(:[0-9]+)?([^?#]*)[?]?([^#]*)"
_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
FACTS = (
    ("date", r"[0-9]{4}(?:-[0-9]{1,2}-[0-9]{1,2}|년 [0-9]{1,2}월 [0-9]{1,2}일|[.] [0-9]{1,2}[.] [0-9]{1,2}[.])"),
    ("term", r"[0-9]{4}학년도(?: [0-9]학기)?(?: [0-9]{1,2}주차)?"),
    ("day", r"[0-9]{1,2}월 [0-9]{1,2}일"),
    ("time", r"[0-9]{1,2}:[0-9]{2}"),
    ("amount", r"[0-9][0-9,]*(?:만)? ?원"),
    ("percent", r"[0-9]+(?:[.][0-9]+)?%"),
    ("quantity", r"[0-9]+(?:명|건|회|점|일|시간|학점|개 반)"),
    ("article", r"제[0-9]+조(?:제[0-9]+항)?"),
    ("file", r"[A-Z]{2}-[0-9]{4}-[0-9]{4}"),
    ("extension", r"내선 [0-9]{4}"),
)
SQL = {
    "tokenize_terms": f"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS mark FROM (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents) WHERE t IS NOT NULL",
    "search_text": f"""SELECT chunk_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS mark FROM (
        SELECT DISTINCT chunk_id, {SEARCH_TERMS.format('f')} AS t FROM (SELECT chunk_id, concat_ws(chr(10), institution, file_name, relative_path,
        file_extension, source_title, source_host, category, text) AS f FROM chunks))""",
    "fold_whitespace": f"SELECT doc_id, md5(f) AS mark, length(f) AS n_chars FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'), ' ') AS f FROM documents)",
    "clean_text": rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '\r\n?', chr(10), 'g'), '[\x{{0}}-\x{{8}}\x{{b}}-\x{{1f}}\x{{7f}}-\x{{9f}}]', ' ', 'g'), '[ \t\x{{a0}}\x{{3000}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'),
        '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS mark FROM documents""",
    "title_fingerprint": """SELECT title_key, count(*) AS documents FROM (SELECT regexp_replace(regexp_replace(regexp_replace(lower(title),
        '[.](pdf|hwpx?|docx?|xlsx?|html?|zip)$', ''), '(19|20)[0-9]{2}(학년도|년도|년)?|[0-9.]+ ?[kmg]b', '', 'g'), '[^0-9a-z가-힣]+', '', 'g') AS title_key
        FROM documents) WHERE title_key <> '' GROUP BY 1""",
    "content_terms": f"SELECT term, count(*) AS documents FROM (SELECT unnest({_STEMS}) AS term FROM documents) GROUP BY 1",
    "number_values": "SELECT doc_id, len(n) AS n_numbers, md5(array_to_string(n, ' ')) AS mark FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda x: replace(x, ',', '')) AS n FROM documents) WHERE n IS NOT NULL",
    "critical_values": "SELECT DISTINCT id, fact FROM (" + " UNION ALL ".join(
        f"SELECT id, '{k}:' || replace(replace(unnest(regexp_extract_all(f, '{p}')), ',', ''), ' ', '') AS fact FROM folded" for k, p in FACTS
    ) + ")",
    "sentence_split": r"""SELECT doc_id, n - 1 AS n, md5(s) AS mark, length(s) AS n_chars FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS s FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([가-힣A-Za-z)\]’"][.!?])[ \t]+', '\1' || chr(10), 'g'), '\n+'),
        lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS l FROM documents))""",
    "document_ids": "SELECT DISTINCT 'doc_' || substring(sha256(relative_path || chr(0) || source_sha256), 1, 24) AS made_id, source_sha256 FROM parsed_documents",
    "block_ids": "SELECT same, count(*) AS blocks FROM (SELECT DISTINCT block_id, document_id || ':b' || lpad(CAST(reading_order AS VARCHAR), 6, '0') AS made, block_id = made AS same FROM blocks) GROUP BY 1",
    "url_parts": f"""SELECT scheme, host, count(DISTINCT path) AS paths, count(*) FILTER (query <> '') AS with_query FROM (
        SELECT CASE WHEN ok THEN regexp_extract(source_url, '{_URL}', 1) END AS scheme, CASE WHEN ok THEN regexp_extract(source_url, '{_URL}', 2) END AS host,
        CASE WHEN ok THEN regexp_extract(source_url, '{_URL}', 4) END AS path, CASE WHEN ok THEN regexp_extract(source_url, '{_URL}', 5) END AS query
        FROM (SELECT source_url, regexp_matches(source_url, '^[hH][tT][tT][pP][sS]?://[^/?#@]+([/?#]|$)') AS ok FROM parsed_documents)) GROUP BY 1, 2""",
    "url_canonical": f"""SELECT DISTINCT url, CASE WHEN length(url) <= 4096 THEN lower(scheme) || '://' || lower(host) || CASE WHEN port = '' OR (lower(scheme) = 'http' AND port = ':80')
        OR (lower(scheme) = 'https' AND port = ':443') THEN '' ELSE port END || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url
        FROM (SELECT url, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS host, regexp_extract(url, '{_URL}', 3) AS port,
        regexp_extract(url, '{_URL}', 4) AS path, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{_URL}', 5), '&'),
        lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({_TRACK}))), '&') AS q
        FROM (SELECT source_url AS url FROM chunks UNION SELECT download_url FROM chunks) WHERE url IS NOT NULL)""",
    "blind_order": "SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY sha256('review' || chr(0) || id), id) AS place FROM (SELECT DISTINCT id, category FROM grounding_cases)",
}
SQL["critical_values"] = f"WITH folded AS (SELECT DISTINCT id, trim(regexp_replace(claim, '{_SPACE}+', ' ', 'g'), ' ') AS f FROM grounding_cases) " + SQL["critical_values"]
