"""The registered queries of the text-preparation operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.llm import bpe, lines, mainbody, mojibake, neardup, packing, pieces, scans, spans, unify
from paragrid.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of texts that are not the same string but look the same."""
    return unify.look_alike_pairs(unify.texts_of(table(spark, folder, "blocks"), table(spark, folder, "grounding_cases")))


def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every block, claim and source text in one consistent form."""
    texts = unify.texts_of(table(spark, folder, "blocks"), table(spark, folder, "grounding_cases"))
    return unify.unify(texts).select("key", "unified").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every block and chunk over 1,800 characters."""
    items = pieces.items(table(spark, folder, "blocks"), table(spark, folder, "chunks"))
    return pieces.split_items(items, "item_id", "text", "section_path")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every block and chunk over 1,800 characters."""
    return p2_pieces(spark, folder).select("item_id").distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text of every block with noise from scanning."""
    return scans.repaired_blocks(table(spark, folder, "blocks"), table(spark, folder, "parsed_documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each block with noise from scanning."""
    return p3_repaired(spark, folder).select("block_id").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that are at least 0.7 alike."""
    return neardup.alike_pairs(table(spark, folder, "blocks"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its group of near-duplicates."""
    return neardup.groups(table(spark, folder, "blocks"))


def _page_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = mainbody.web_pages(table(spark, folder, "parsed_documents"))
    return mainbody.judged(table(spark, folder, "blocks"), pages, lines.hosts_of(table(spark, folder, "chunks")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each block of a web page that is not part of its main body."""
    return _page_verdicts(spark, folder).where("not body").select("block_id").distinct()


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of every web page's main body."""
    bodies = mainbody.main_bodies(table(spark, folder, "blocks"), _page_verdicts(spark, folder))
    return bodies.select("document_id", "block_id", "block_type", "reading_order", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each line that its host repeats."""
    return lines.found_lines(table(spark, folder, "blocks"), table(spark, folder, "chunks"))


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block without the lines that its host repeats in excess of other hosts or in a quarter of its documents."""
    blocks = table(spark, folder, "blocks").select("document_id", "block_id", "block_type", "reading_order", "text")
    cleaned = lines.without_lines(blocks, lines.excess_lines(blocks, table(spark, folder, "chunks")))
    return cleaned.select("document_id", "block_id", "block_type", "reading_order", "text")


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The restored text of every block that was read with a wrong encoding."""
    blocks = table(spark, folder, "blocks")
    return mojibake.restored_blocks(blocks, *mojibake.word_counts(blocks))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each block that was garbled by a wrong encoding."""
    return p7_restored(spark, folder).select("block_id").distinct()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return bpe.encode(table(spark, folder, "documents").select("doc_id", "text"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their containers of 8,192 tokens."""
    sizes = bpe.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return packing.pack(sizes, "doc_id", "tokens")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share a passage of at least 150 characters."""
    return spans.sharing_pairs(table(spark, folder, "documents"))


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each document's characters that stands in another document too."""
    return spans.shared_share(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    own = (p1_found, p1_texts, p2_found, p2_pieces, p3_found, p3_repaired, p4_found, p4_groups, p5_found, p5_bodies, p6_found, p6_blocks, p7_found, p7_restored, p8_ids, p9_containers, p10_found, p10_shares)
    return {query.__name__: query for query in own}


_WINDOWS = """windows AS (SELECT DISTINCT doc_id, start, md5(substring(text, start + 1, 150)) AS mark FROM (
    SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS start FROM documents WHERE length(text) >= 150)),
    shared AS (SELECT mark FROM windows GROUP BY mark HAVING count(DISTINCT doc_id) > 1)"""
# The white space of Unicode.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_ALIKE = rf"""own AS (SELECT DISTINCT document_id, block_id, reading_order, text FROM blocks WHERE block_type IS DISTINCT FROM 'table_cell' AND text IS NOT NULL AND document_id IS NOT NULL),
            whole AS (SELECT document_id, regexp_replace(string_agg(text, chr(10) ORDER BY coalesce(reading_order, -1), block_id, text), '{_SPACE}', ' ', 'g') AS t FROM own GROUP BY 1),
            parts AS (SELECT DISTINCT document_id, substring(t, i, 5) AS s FROM (SELECT document_id, t, unnest(range(1, length(t) - 3)) AS i FROM whole)),
            sizes AS (SELECT document_id, count(*) AS n FROM parts GROUP BY 1),
            both_have AS (SELECT a.document_id AS x, b.document_id AS y, count(*) AS n FROM parts a JOIN parts b ON a.s = b.s AND a.document_id < b.document_id GROUP BY 1, 2),
    pairs AS (SELECT x, y FROM both_have p JOIN sizes a ON a.document_id = x JOIN sizes b ON b.document_id = y WHERE p.n >= 0.7 * (a.n + b.n - p.n))"""
_LINES = r"""hosts AS (SELECT document_id, min(lower(source_host)) AS host FROM chunks WHERE source_host IS NOT NULL GROUP BY 1), sizes AS (SELECT host, count(*) AS n FROM hosts GROUP BY 1),
    cut AS (SELECT DISTINCT document_id, block_id, line_no, line FROM (SELECT document_id, block_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
        FROM (SELECT document_id, block_id, string_split(text, chr(10)) AS l FROM blocks WHERE block_type IS DISTINCT FROM 'table_cell'))),
    formed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, '[0-9]', '', 'g'), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS form FROM cut),
    lettered AS (SELECT f.*, host FROM formed f JOIN hosts USING (document_id) WHERE regexp_matches(form, '\p{L}')),
    counted AS (SELECT host, form, n, count(DISTINCT document_id) AS k FROM lettered JOIN sizes USING (host) GROUP BY 1, 2, 3)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": f"""WITH {_WINDOWS}, places AS (SELECT DISTINCT doc_id, mark FROM windows WHERE mark IN (SELECT mark FROM shared))
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM places a JOIN places b ON a.mark = b.mark AND a.doc_id < b.doc_id""",
        "p10_shares": f"""WITH {_WINDOWS}, starts AS (SELECT doc_id, start FROM windows WHERE mark IN (SELECT mark FROM shared)),
            covered AS (SELECT doc_id, least(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - start, 150), 150) AS own FROM starts),
            found AS (SELECT doc_id, CAST(sum(own) AS BIGINT) AS own FROM covered GROUP BY 1)
            SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(own, 0) AS shared_chars,
            CASE WHEN length(text) > 0 THEN round(coalesce(own, 0) / length(text), 6) ELSE 0.0 END AS share FROM documents LEFT JOIN found USING (doc_id)""",
        "p4_found": f"WITH {_ALIKE} SELECT x AS document_id_a, y AS document_id_b FROM pairs",
        "p6_found": f"WITH {_LINES} SELECT DISTINCT block_id, CAST(line_no AS INTEGER) AS line_no FROM lettered JOIN counted USING (host, form) WHERE k >= 5 AND k >= 0.25 * n",
        "p6_blocks": f"""WITH {_LINES}, everything AS (SELECT count(*) AS n_all FROM hosts), whole AS (SELECT form, sum(k) AS total FROM counted GROUP BY 1),
            r AS (SELECT host, form, CAST(k AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n, CAST(total - k AS DOUBLE) AS o, CAST(n_all - n AS DOUBLE) AS m FROM counted JOIN whole USING (form), everything WHERE k >= 5),
            p AS (SELECT *, (k + o) / (n + m) AS p FROM r),
            g AS (SELECT *, CASE WHEN k / n > CASE WHEN m > 0 THEN o / m ELSE 0 END THEN greatest(2 * (CASE WHEN k > 0 THEN k * ln(k / (n * p)) ELSE 0 END + CASE WHEN n - k > 0 THEN (n - k) * ln((n - k) / (n * (1 - p))) ELSE 0 END
                + CASE WHEN o > 0 THEN o * ln(o / (m * p)) ELSE 0 END + CASE WHEN m - o > 0 THEN (m - o) * ln((m - o) / (m * (1 - p))) ELSE 0 END), 0.0) ELSE 0.0 END AS g FROM p),
            z AS (SELECT *, sqrt(greatest(g, 1e-12)) AS z, 1 / (1 + 0.2316419 * sqrt(greatest(g, 1e-12))) AS t FROM g),
            s AS (SELECT host, form, k, n, CAST(least(round((z * z / 2 + ln(2.5066282746310002) - ln(2.0 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))))) / ln(10.0) * 50), 15000) AS INT) AS step FROM z),
            q AS (SELECT *, count(*) OVER (ORDER BY step DESC) AS rank, count(*) OVER () AS family FROM s),
            e AS (SELECT *, min(-step / 50.0 + log10(family / rank)) OVER (ORDER BY step) AS q FROM q),
            gone AS (SELECT DISTINCT block_id, line_no FROM lettered JOIN e USING (host, form) WHERE (q <= -2 AND k / n >= 0.05) OR k >= 0.25 * n),
            kept AS (SELECT block_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM cut ANTI JOIN gone USING (block_id, line_no) WHERE block_id IN (SELECT block_id FROM gone) GROUP BY 1)
            SELECT DISTINCT document_id, b.block_id, block_type, reading_order, CASE WHEN text IS NOT NULL AND block_id IN (SELECT block_id FROM gone) THEN coalesce(t, '') ELSE text END AS text
            FROM blocks b LEFT JOIN kept USING (block_id)""",
        "p4_groups": f"""WITH RECURSIVE {_ALIKE}, e AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs), reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
            far AS (SELECT x, min(y) AS least FROM reach GROUP BY 1), size AS (SELECT t, count(*) AS copies FROM whole WHERE length(t) > 4 GROUP BY 1),
            degree AS (SELECT e.x, count(DISTINCT b.t) AS links FROM e JOIN whole a ON a.document_id = e.x JOIN whole b ON b.document_id = e.y WHERE a.t <> b.t GROUP BY 1)
            SELECT document_id, least(document_id, coalesce(least, document_id)) AS group_id, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links
            FROM (SELECT DISTINCT document_id FROM blocks WHERE document_id IS NOT NULL) LEFT JOIN whole USING (document_id) LEFT JOIN size USING (t) LEFT JOIN far ON far.x = document_id LEFT JOIN degree d ON d.x = document_id""",
        "p2_found": """
            SELECT DISTINCT block_id AS item_id FROM blocks WHERE block_type IS DISTINCT FROM 'table_cell' AND length(text) > 1800
            UNION SELECT chunk_id FROM chunks WHERE length(text) > 1800""",
    }
