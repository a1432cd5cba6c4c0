"""Pages and blocks of parsed files: layout, headings, merged tables, composed pages, keys, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions.text import fold_space

# Gaps between columns and steps back in height that count, at least and as shares of the page.
COLUMN_GAP, COLUMN_SHARE, MOST_COLUMNS = 40.0, 0.12, 3
BACK_GAP, BACK_SHARE = 30.0, 0.05
HEADING_RATIO, HEADING_CHARS = 1.2, 160
MOST_BLOCKS = 250_000


def columns(blocks: DataFrame, page: list[str], centre: str, width: Column) -> DataFrame:
    """``(page, columns)``: 1 and the gaps between the sorted centres of a page's blocks that are wide enough, at most 3."""
    gap = F.col(centre) - F.lag(centre).over(W.partitionBy(*page).orderBy(centre))
    wide = gap > F.greatest(F.lit(COLUMN_GAP), COLUMN_SHARE * width)
    return blocks.withColumn("_wide", wide).groupBy(*page).agg(F.least(F.count_if("_wide") + 1, F.lit(MOST_COLUMNS)).alias("columns"))


def reading_anomaly(blocks: DataFrame, page: list[str], y: str, height: Column, *order: str) -> DataFrame:
    """``(page, anomaly)``: whether any block stands higher than the one before by more than the least step back."""
    back = F.lag(y).over(W.partitionBy(*page).orderBy(*order)) - F.col(y)
    far = back > F.greatest(F.lit(BACK_GAP), BACK_SHARE * height)
    return blocks.withColumn("_far", far).groupBy(*page).agg(F.coalesce(F.bool_or("_far"), F.lit(False)).alias("anomaly"))


def is_heading(text: Column, size: Column, body_size: Column) -> Column:
    """Whether a line is set larger than the body, is short, and ends in no full stop."""
    return F.coalesce((size >= HEADING_RATIO * body_size) & (F.length(text) <= HEADING_CHARS) & ~F.trim(text).rlike("[.。]$"), F.lit(False))


def overlaid(blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """The blocks without the paragraphs that equal a row or a cell of a table on their page, with new contiguous ``place``.

    Tables found by another parser repeat in the running text; white space is no difference.
    """
    form = fold_space(F.col("text"))
    in_tables = blocks.where("block_type in ('table', 'table_cell')").select(document, "page", F.explode(F.when(F.col("block_type") == "table", F.split("text", "\n", -1)).otherwise(F.array("text"))).alias("line"))
    cells = in_tables.select(document, F.coalesce("page", F.lit(-1)).alias("_page"), fold_space(F.col("line")).alias("_form")).where("_form <> ''").distinct()
    marked = blocks.withColumn("_form", F.when(F.col("block_type") == "paragraph", form)).withColumn("_page", F.coalesce("page", F.lit(-1)))
    kept = marked.join(cells, [document, "_page", "_form"], "left_anti").drop("_form", "_page")
    return renumbered(kept, document)


def renumbered(blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """The blocks with ``place`` from 0 without gaps and ``new_id`` made of it, in their old order."""
    place = F.row_number().over(W.partitionBy(document).orderBy("reading_order", "block_id")) - 1
    return blocks.withColumn("place", place).withColumn("new_id", F.concat(document, F.lit(":b"), F.lpad(F.col("place").cast("string"), 6, "0")))


def composed(attempts: DataFrame, document: str, page: str, priority: str) -> DataFrame:
    """The blocks of each page from the attempt of the highest ``priority`` that has the page.

    A document any of whose attempts lacks page numbers is taken whole from its best attempt that has blocks.
    """
    rows = attempts.withColumn("_whole", F.bool_or(F.col(page).isNull()).over(W.partitionBy(document)))
    where = F.when(~F.col("_whole"), F.col(page)).otherwise(F.lit(-1))
    marked = rows.withColumn("_page", where)
    best = marked.groupBy(document, "_page").agg(F.max(priority).alias("_best"))
    return marked.join(best, [document, "_page"]).where(F.col(priority) == F.col("_best")).drop("_whole", "_page", "_best")


def outcomes(documents: DataFrame, blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """``(document, outcome, blocks)``: error for a failed parse or too many blocks, empty without text, else parsed; every document has a row."""
    counted = blocks.groupBy(document).agg(F.count("*").alias("blocks"), F.sum(F.length(F.trim("text"))).alias("_chars"))
    joined = documents.join(counted, document, "left")
    outcome = F.when((F.col("status") == "error") | (F.col("blocks") > MOST_BLOCKS), "error").when(F.coalesce("_chars", F.lit(0)) == 0, "empty").otherwise("parsed")
    return joined.select(document, outcome.alias("outcome"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


FIELDS = "block_id string, block_type string, text string, reading_order int, page int, section_path array<string>, table_id string, row_no int, column_no int"
TYPES = ("heading", "paragraph", "list_item", "table", "table_cell", "caption")


def from_workers(rows: DataFrame, document: str, json: str) -> DataFrame:
    """``(document, block fields, fault)`` of blocks that a worker gave as JSON: no_object, type, text, order or cell; null for sound ones."""
    parsed = rows.select(document, F.from_json(json, FIELDS).alias("b"), F.col(json).alias("_raw"))
    b = F.col("b")
    fault = (
        F.when(b.isNull() | ~F.trim("_raw").startswith("{"), "no_object").when(~F.coalesce(b["block_type"].isin(*TYPES), F.lit(False)), "type").when(b["text"].isNull(), "text")
        .when(F.coalesce(b["reading_order"] < 0, F.lit(True)), "order").when((b["block_type"] == "table_cell") & (b["row_no"].isNull() | b["column_no"].isNull() | b["table_id"].isNull()), "cell")
    )
    return parsed.select(document, "b.*", fault.alias("fault"))
