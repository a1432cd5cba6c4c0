"""Queries of normal forms, typed facts, units and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.functions import facts, normal, text
from paragrid.operators import grounding
from paragrid.sources.tables import spread, table


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "title", "text"))


def _pairs(spark, folder):
    return grounding.claim_sources(table(spark, folder, "grounding_cases"))


def title_forms(spark, folder):
    t = F.col("title")
    rows = _documents(spark, folder).where("title is not null")
    return rows.select("doc_id", normal.evidence_text(t).alias("evidence"), normal.anchor_key(t).alias("anchor"), normal.spaceless(t).alias("spaceless"), normal.stable_id(t).alias("id"))


def path_forms(spark, folder):
    p = F.col("source_path")
    rows = table(spark, folder, "chunks").select("source_path", "relative_path", "institution").distinct()
    return rows.select("source_path", normal.relative_path(p).alias("path"), normal.inside(F.lit("downloads"), p).alias("inside"), normal.relative_path(F.concat(F.lit("../"), p)).alias("climbing"), (normal.inside(F.col("institution"), F.col("relative_path"))).alias("by_institution"))


def body_sections(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_id", "text", "section_path_json").distinct()
    whole = normal.body_and_sections(F.col("text"), F.from_json("section_path_json", "array<string>"))
    return rows.select("chunk_id", F.md5(whole).alias("mark"))


def typed_facts(spark, folder):
    rows = _documents(spark, folder).select("doc_id", F.explode(facts.typed_facts(F.col("text"))).alias("fact"))
    return rows.groupBy("fact").agg(F.count("*").alias("documents"))


def claim_conflicts(spark, folder):
    rows = _pairs(spark, folder)
    return rows.select("id", "place", F.array_join(facts.conflicts(F.col("claim"), F.col("source")), ",").alias("conflicts"))


def scope_conflicts(spark, folder):
    rows = _pairs(spark, folder).select("id", "place", facts.typed_facts(F.col("claim")).alias("a"), facts.typed_facts(F.col("source")).alias("b"))
    return rows.select("id", "place", F.array_join(facts.scope_facts(F.col("a")), ",").alias("scope"), facts.scopes_conflict(F.col("a"), F.col("b")).alias("conflict"))


def unit_lengths(spark, folder):
    rows = _documents(spark, folder).select("doc_id", facts.evidence_units(F.col("text")).alias("units")).where("units is not null")
    return rows.select("doc_id", F.size("units").cast("long").alias("units"), F.md5(F.array_join("units", "|")).alias("mark"))


def clause_split(spark, folder):
    rows = spread(table(spark, folder, "grounding_cases").select("id", "claim").distinct())
    return rows.select("id", F.posexplode(facts.clauses(F.col("claim"))).alias("place", "clause")).select("id", F.col("place").cast("long").alias("place"), "clause")


def draft_lines(spark, folder):
    rows = _documents(spark, folder).select("doc_id", facts.draft_claims(F.col("text")).alias("claims")).where("claims is not null")
    return rows.select("doc_id", F.size("claims").cast("long").alias("claims"), F.md5(F.array_join("claims", "\n")).alias("mark"))


def table_matrices(spark, folder):
    rows = table(spark, folder, "blocks").where("block_type = 'table'").select("block_id", "text").distinct().select("block_id", facts.table_matrix(F.col("text")).alias("m"))
    widths = F.transform("m", lambda r: F.size(r))
    return rows.select("block_id", F.size("m").cast("long").alias("n_rows"), F.array_max(widths).cast("long").alias("widest"), F.array_min(widths).cast("long").alias("narrowest"), F.md5(F.array_join(F.flatten("m"), "|")).alias("mark"))


def supported_terms(spark, folder):
    rows = _pairs(spark, folder)
    return rows.select("id", "place", F.size(F.array_distinct(text.terms(F.col("claim")))).cast("long").alias("asked"), F.size(facts.terms_supported(F.col("claim"), F.col("source"))).cast("long").alias("held"))


def document_identifiers(spark, folder):
    rows = _documents(spark, folder).select("doc_id", F.explode(facts.identifiers(F.col("text"))).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


def category_in_text(spark, folder):
    rows = spread(table(spark, folder, "documents").select("doc_id", "category", "title", "text"))
    first = F.get(text.terms(F.col("title")), 0)
    return rows.select("doc_id", F.coalesce(facts.term_in_text(F.col("category"), F.col("text")), F.lit(False)).alias("category"), F.coalesce(facts.term_in_text(first, F.col("text")), F.lit(False)).alias("first_term"), F.coalesce(facts.longest_known_prefix(first, F.col("text")), F.lit("")).alias("prefix"))


def time_facets(spark, folder):
    rows = _documents(spark, folder).select(F.array_join(facts.temporal_facets(F.col("text")), ",").alias("facets"))
    return rows.where("facets is not null").groupBy("facets").agg(F.count("*").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        title_forms, path_forms, body_sections, typed_facts, claim_conflicts, scope_conflicts, unit_lengths, clause_split, draft_lines,
        table_matrices, supported_terms, document_identifiers, category_in_text, time_facets,
    )
}

# The SQL is written from the meaning of each form, with patterns of its own.
_S = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _flat(column):
    return f"trim(regexp_replace({column}, '{_S}+', ' ', 'g'), ' ')"


_NUM = "list_transform(regexp_extract_all({0}, '[0-9]+'), lambda q: CAST(q AS INT))"
_ISO = r"([0-9]{4})(년 ?[0-9]{1,2}월 ?[0-9]{1,2}일|[.] ?[0-9]{1,2}[.] ?[0-9]{1,2}[.]?|-[0-9]{1,2}-[0-9]{1,2})"
_WON = r"([0-9][0-9,]*([.][0-9]+)? ?(조|억|천만|백만|십만|만|천|백)? ?)+원"
_WORTH = r"""CAST(list_sum(list_transform(regexp_extract_all(m, '[0-9][0-9,]*(?:[.][0-9]+)? ?(?:조|억|천만|백만|십만|만|천|백)?'), lambda p: CAST(replace(regexp_extract(p, '[0-9,.]+'), ',', '') AS DOUBLE)
    * CASE WHEN p LIKE '%조' THEN 1e12 WHEN p LIKE '%억' THEN 1e8 WHEN p LIKE '%천만' THEN 1e7 WHEN p LIKE '%백만' THEN 1e6 WHEN p LIKE '%십만' THEN 1e5 WHEN p LIKE '%만' THEN 1e4 WHEN p LIKE '%천' THEN 1e3 WHEN p LIKE '%백' THEN 1e2 ELSE 1 END)) AS BIGINT)"""


def _facts(column):
    flat = _flat(column)
    each = lambda kind, pattern, value, source=flat: f"list_transform(regexp_extract_all({source}, '{pattern}'), lambda m: '{kind}:' || {value})"
    n = _NUM.format("m")
    iso = f"{n}[1] || '-' || lpad(CAST({n}[2] AS VARCHAR), 2, '0') || '-' || lpad(CAST({n}[3] AS VARCHAR), 2, '0')"
    day = f"lpad(CAST({n}[1] AS VARCHAR), 2, '0') || '-' || lpad(CAST({n}[2] AS VARCHAR), 2, '0')"
    minutes = f"(CASE WHEN m LIKE '오%' THEN {n}[1] % 12 ELSE {n}[1] % 24 END * 60 + CASE WHEN m LIKE '오후%' THEN 720 ELSE 0 END + coalesce({n}[2], 0))"
    parts = (
        each("academic_year", "[0-9]{4}학년도", "m[1:4]"), each("semester", "[1-4]학기", "m[1:1]"), each("date", _ISO, iso),
        each("month_day", "[0-9]{1,2}월 ?[0-9]{1,2}일", day, f"regexp_replace({flat}, '{_ISO}', '|', 'g')"),
        each("time_minutes", "(?:오전|오후) ?[0-9]{1,2}시(?: ?[0-9]{1,2}분)?|[0-9]{1,2}:[0-9]{2}", minutes), each("amount_krw", _WON, _WORTH),
        each("percent", "[0-9]+(?:[.][0-9]+)? ?%", "replace(replace(m, ' ', ''), '%', '')"),
        each("quantity", "[0-9][0-9,]*(?:[.][0-9]+)? ?(?:학점|시간|개월|명|건|회|점|부|주)", "replace(replace(m, ' ', ''), ',', '')"),
        each("phone", "0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|내선 ?[0-9]{4}", "regexp_replace(m, '[^0-9]', '', 'g')"),
    )
    return f"list_distinct(list_concat({', '.join(parts)}))"


_PAIRS = "pairs AS (SELECT id, claim, place - 1 AS place, s.text AS source FROM (SELECT id, claim, unnest(range(1, len(sources) + 1)) AS place, unnest(sources) AS s FROM (SELECT DISTINCT ON (id) * FROM grounding_cases)))"
_BOTH = f"{_PAIRS}, f AS (SELECT *, {_facts('claim')} AS a, {_facts('source')} AS b FROM pairs)"
_OWN = "list_filter({0}, lambda x: starts_with(x, '{1}'))"
_CLASH = "(len(" + _OWN.format("a", "{0}") + ") > 0 AND len(" + _OWN.format("b", "{0}") + ") > 0 AND NOT list_has_any(" + _OWN.format("a", "{0}") + ", " + _OWN.format("b", "{0}") + "))"
_SCOPE = f"({_CLASH.format('academic_year:')} OR {_CLASH.format('semester:')})"
_BOUND = r"[0-9][0-9,.]* ?(?:%|명|건|회|점|시간|학점|일|원|만 ?원)? ?(?:이상|이하|초과|미만)"


def _bounds(column):
    return f"list_transform(regexp_extract_all({_flat(column)}, '{_BOUND}'), lambda m: CASE WHEN contains(m, '원') THEN CAST({_WORTH} AS VARCHAR) ELSE replace(regexp_extract(m, '[0-9][0-9,.]*'), ',', '') END || ':' || right(m, 2))"


_LINES = "list_filter(list_transform(regexp_split_to_array({0}, '\\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')"
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[가-힣]+|[a-z]+|[0-9]+'), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"
_VARIANT = f"regexp_replace({{0}}, '^(..+?)({text.PARTICLES})$', '\\1')"
SQL = {
    "title_forms": r"""SELECT doc_id, trim(regexp_replace(lower(title), '[\p{P}\p{S}\p{Z}\p{C}\s]+', ' ', 'g'), ' ') AS evidence, regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g') AS anchor,
        lower(regexp_replace(title, '\s+', '', 'g')) AS spaceless, substring(sha1(title), 1, 16) AS id FROM documents WHERE title IS NOT NULL""",
    "path_forms": """SELECT DISTINCT source_path, source_path AS path, starts_with(source_path, 'downloads/') AS inside, CAST(NULL AS VARCHAR) AS climbing, coalesce(starts_with(relative_path, institution || '/'), false) AS by_institution FROM chunks""",
    "body_sections": """SELECT chunk_id, md5(text || chr(10) || coalesce(array_to_string((CASE WHEN section_path_json = 'null' THEN NULL ELSE CAST(section_path_json AS JSON)::VARCHAR[] END), chr(10)), '')) AS mark
        FROM (SELECT DISTINCT chunk_id, text, section_path_json FROM chunks)""",
    "typed_facts": f"SELECT fact, count(*) AS documents FROM (SELECT doc_id, unnest({_facts('text')}) AS fact FROM documents) GROUP BY 1",
    "claim_conflicts": f"""WITH {_BOTH} SELECT id, place, concat_ws(',', CASE WHEN regexp_matches(claim, '{facts.DENIED}') <> regexp_matches(source, '{facts.DENIED}') THEN 'polarity' END,
        CASE WHEN len(list_filter({_bounds('claim')}, lambda x: NOT list_contains({_bounds('source')}, x))) > 0 THEN 'bound' END, CASE WHEN {_SCOPE} THEN 'scope' END,
        CASE WHEN {_CLASH.format('phone:')} THEN 'phone' END, CASE WHEN NOT list_has_all(b, a) THEN 'fact' END) AS conflicts FROM f""",
    "scope_conflicts": f"WITH {_BOTH} SELECT id, place, array_to_string(list_sort(list_filter(a, lambda x: starts_with(x, 'academic_year:') OR starts_with(x, 'semester:'))), ',') AS scope, {_SCOPE} AS conflict FROM f",
    "unit_lengths": f"""WITH l AS (SELECT doc_id, {_LINES.format('text')} AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, list_concat(l,
        list_filter(list_transform(range(1, greatest(len(l), 1)), lambda i: l[i] || chr(10) || l[i + 1]), lambda p: length(p) <= 500)) AS u FROM l) SELECT doc_id, len(u) AS units, md5(array_to_string(u, '|')) AS mark FROM u""",
    "clause_split": f"""SELECT id, n - 1 AS place, l[n] AS clause FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace({_flat('claim')},
        '(하고|하며|하되|이며|이고|지만|으나),? |[;·]| 및 ', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM (SELECT DISTINCT id, claim FROM grounding_cases)))""",
    "draft_lines": r"""SELECT doc_id, len(l) AS claims, md5(array_to_string(l, chr(10))) AS mark FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
        lambda s: trim(regexp_replace(regexp_replace(s, '^[ \t]*([-*•·○□]|[0-9]{1,2}[.)])[ \t]+', ''), '\[[0-9]+\]', '', 'g'), ' ')), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL)""",
    "table_matrices": r"""WITH m AS (SELECT block_id, list_transform(list_filter(string_split(text, chr(10)), lambda r: trim(r, ' ') <> ''), lambda r: list_transform(CASE WHEN contains(r, chr(9)) THEN string_split(r, chr(9))
        WHEN regexp_matches(r, '[|│]') THEN regexp_split_to_array(regexp_replace(r, '^\s*[|│]|[|│]\s*$', '', 'g'), '[|│]') ELSE regexp_split_to_array(r, ' {2,}') END, lambda c: trim(c, ' '))) AS m
        FROM (SELECT DISTINCT block_id, text FROM blocks WHERE block_type = 'table'))
        SELECT block_id, len(m) AS n_rows, list_max(list_transform(m, lambda r: len(r))) AS widest, list_min(list_transform(m, lambda r: len(r))) AS narrowest, md5(array_to_string(flatten(m), '|')) AS mark FROM m""",
    "supported_terms": f"""WITH {_PAIRS}, t AS (SELECT id, place, list_distinct({_TERMS.format('claim')}) AS q, list_distinct(flatten(list_transform({_TERMS.format('source')}, lambda t: [t, {_VARIANT.format('t')}]))) AS h FROM pairs)
        SELECT id, place, len(q) AS asked, len(list_filter(q, lambda t: len(list_filter(h, lambda x: x = t OR x = {_VARIANT.format('t')} OR (length(x) > 1 AND length(t) > 1 AND (contains(x, t) OR contains(t, x) OR contains(x, {_VARIANT.format('t')}) OR contains({_VARIANT.format('t')}, x))))) > 0)) AS held FROM t""",
    "document_identifiers": "SELECT code, count(DISTINCT doc_id) AS documents, min(doc_id) AS first FROM (SELECT doc_id, upper(unnest(regexp_extract_all(text, '[A-Za-z]{2,}(?:-[A-Za-z0-9]+)+|[0-9]{5,}'))) AS code FROM documents) GROUP BY 1",
    "category_in_text": f"""WITH d AS (SELECT doc_id, text, category, {_TERMS.format('text')} AS t, ({_TERMS.format('title')})[1] AS f FROM documents),
        p AS (SELECT *, replace(text, ' ', '') AS bare FROM d) SELECT doc_id, coalesce(CASE WHEN regexp_matches(category, '^[A-Za-z0-9]+$') THEN list_contains(t, lower(category)) ELSE contains(bare, replace(category, ' ', '')) END, false) AS category,
        coalesce(CASE WHEN regexp_matches(f, '^[A-Za-z0-9]+$') THEN list_contains(t, lower(f)) ELSE contains(bare, f) END, false) AS first_term,
        coalesce(list_filter(list_transform(range(0, greatest(length(f) - 1, 0)), lambda i: substring(f, 1, CAST(length(f) - i AS BIGINT))), lambda x: contains(text, x))[1], '') AS prefix FROM p""",
    "time_facets": f"""SELECT facets, count(*) AS documents FROM (SELECT concat_ws(',', CASE WHEN regexp_matches(text, '{_ISO}|[0-9]{{1,2}}월 ?[0-9]{{1,2}}일') THEN 'date' END,
        CASE WHEN regexp_matches(text, '(오전|오후) ?[0-9]{{1,2}}시|[0-9]{{1,2}}:[0-9]{{2}}') THEN 'time' END, CASE WHEN regexp_matches(text, '[0-9]{{4}}학년도|[1-4]학기') THEN 'term' END,
        CASE WHEN regexp_matches(text, '까지|마감') THEN 'deadline' END, CASE WHEN regexp_matches(text, '부터|기간|동안') THEN 'period' END) AS facets FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
}
