"""The main body of web pages, without the host's furniture.

A page's containers are its blocks. Each has a path, generalised in steps: its
first and last word, separator and sentence form; its last or its first word with
separator and form; only separator, form and size (digits are no difference). Containers score 1 where
they stand under a heading and 0 where they hang on the page itself. The scores vote by
path, per host and over all hosts; a thin vote leans on the more general path. A
container outside every section whose path is voted under ``threshold`` is furniture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.session import materialize

THRESHOLD = 0.1
LEAN = 4.0
LOOSE = ("paragraph", "list_item")
# Separators of menus, trails and link lists, in order of preference.
SEPARATORS = (" | ", " · ", " > ", " » ", " / ", "  ", "\n")


def _generalised(word: Column) -> Column:
    return F.regexp_replace(word, "[0-9]+", "#")


def paths(text: Column) -> list[Column]:
    """The container's paths from the most special to the most general, as hashes."""
    count = lambda s: F.size(F.split(text, "\\Q" + s + "\\E", -1)) - 1
    separator = F.coalesce(*(F.when(count(s) >= 2, F.lit(n)) for n, s in enumerate(SEPARATORS)), F.lit(-1))
    bare = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    words = F.split(bare, " ", -1)
    first, last = _generalised(F.element_at(words, 1)), _generalised(F.element_at(words, -1))
    sentence = bare.rlike(r"(다|오|요)[.．]|[a-z0-9][.] |[a-z0-9][.]$")
    size = F.least(F.floor(F.log2(F.length(bare) + 1)), F.lit(9))
    return [
        F.xxhash64(F.lit(1), first, last, separator, sentence),
        F.xxhash64(F.lit(2), last, separator, sentence),
        F.xxhash64(F.lit(3), first, separator, sentence),
        F.xxhash64(F.lit(4), separator, sentence, size),
    ]


def judged(blocks: DataFrame, pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(document_id, block_id, body)`` of the pages' blocks other than table cells.

    ``pages`` has the document_id of each web page, ``hosts`` a host for each document
    (a page without one votes and is judged over all hosts). A block counts once however
    often it stands in ``blocks``. Headings, tables, captions, null and blank texts and
    blocks inside a section are body.
    """
    inside = F.coalesce(F.size("section_path") > 0, F.lit(False))
    levels = [f"l{n}" for n in range(4)]
    loose = F.col("block_type").isin(*LOOSE) & F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    marked = (
        blocks.where("block_type is distinct from 'table_cell'")
        .select("document_id", "block_id", loose.alias("loose"), inside.alias("inside"), *(p.alias(n) for p, n in zip(paths(F.col("text")), levels)))
        # Only hashes go through the join, so a document of a tenth of all blocks weighs little in its task.
        .join(pages.select("document_id").distinct(), "document_id", "left_semi")
        .groupBy("document_id", "block_id")
        .agg(*(F.max(c).alias(c) for c in ("loose", "inside", *levels)))
        .join(hosts, "document_id", "left")
    )
    marked = materialize(marked)
    voters, score = marked.where("loose"), F.col("inside").cast("double")
    open_ones = marked.where("loose and not inside")
    result = open_ones.withColumn("vote", F.lit(0.5))
    # Votes are sums over all rows, pre-aggregated before their shuffle; from the general path to the special.
    for keys in (["l3"], ["l2"], ["l1"], ["l0"], ["host", "l0"]):
        votes = voters.groupBy(*keys).agg(F.sum(score).alias("for"), F.count("*").alias("all"))
        if keys == ["l3"]:
            votes = F.broadcast(votes)  # separators x sentence forms x sizes: at most 160 rows
        leaning = (F.coalesce(F.col("for"), F.lit(0.0)) + LEAN * F.col("vote")) / (F.coalesce(F.col("all"), F.lit(0)) + LEAN)
        result = result.join(votes, keys, "left").withColumn("vote", leaning).drop("for", "all")
    furniture = result.where(F.col("vote") < THRESHOLD).select("document_id", "block_id", F.lit(False).alias("body"))
    return marked.select("document_id", "block_id").join(furniture, ["document_id", "block_id"], "left").select(
        "document_id", "block_id", F.coalesce("body", F.lit(True)).alias("body")
    )


def web_pages(parsed: DataFrame) -> DataFrame:
    """The document_id of every web page."""
    return parsed.where(F.lower("file_extension").isin(".html", ".htm")).select("document_id").distinct()


def main_bodies(blocks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The pages' blocks, once each, without the furniture; table cells stay."""
    gone = verdicts.where("not body").select("block_id")
    pages = verdicts.select("document_id").distinct()
    return blocks.join(pages, "document_id", "left_semi").join(gone, "block_id", "left_anti").dropDuplicates(["document_id", "block_id"])
