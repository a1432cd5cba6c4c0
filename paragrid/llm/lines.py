"""Lines that one source repeats across its documents.

For every line of a source the number of its documents is compared with the number of
documents elsewhere by a one-sided log-likelihood ratio; a line is in excess if its
q-value (Benjamini and Hochberg over all lines of the least support) is at most ``alpha``
and it stands in ``FLOOR`` of the source's documents, or if it stands in ``min_share`` of
them whatever the others do. ``found_lines`` keeps those of the share only, as the
definition of p6_found has it; ``without_lines`` takes all lines in excess out of the
blocks, by an anti-join of their lines, and puts the rest together by position. Blocks
are split into lines once; what goes on are the hashes of the lines' forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.session import materialize

# The white space of Unicode and the separators that count as such.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MIN_DOCUMENTS = 5
MIN_SHARE = 0.25
ALPHA = 0.01
#: A line under this share of its source's documents stays, however rare it is elsewhere.
FLOOR = 0.05
#: p-values are told apart in steps of 0.02 decades down to 1e-300.
STEPS, LAST_STEP = 50, 15_000


def line_form(line: Column) -> Column:
    """A line without the digits 0-9 and then without white space at both ends; null if no letter is left."""
    bare = F.btrim(F.translate(line, "0123456789", ""), F.lit(WHITE))
    return F.when(bare.rlike(r"\p{L}"), bare)


def hosts_of(chunks: DataFrame) -> DataFrame:
    """``(document_id, host)``: the lower-case host that a document's chunks name."""
    return chunks.groupBy("document_id").agg(F.min(F.lower("source_host")).alias("host")).where("host is not null")


def lines_of(blocks: DataFrame) -> DataFrame:
    """``(document_id, block_id, marks)`` of each distinct block: for each line the hash of its form, null where it has no letter."""
    own = blocks.where("block_type is distinct from 'table_cell' and text is not null").select("document_id", "block_id", "text")
    marks = F.transform(F.split("text", "\n", -1), lambda line: F.when(line_form(line).isNotNull(), F.xxhash64(line_form(line))))
    return own.select("document_id", "block_id", marks.alias("marks"))


def _tail(statistic: Column) -> Column:
    """-log10 of the upper tail of chi-square with one degree: exact to about 1 % for large values."""
    z = F.sqrt(F.greatest(statistic, F.lit(1e-12)))
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return (z * z / 2 + F.log(F.lit(2.5066282746310002)) - F.log(F.lit(2.0) * series)) / F.log(F.lit(10.0))


def repeated_lines(
    lines: DataFrame, hosts: DataFrame, min_documents: int = MIN_DOCUMENTS, alpha: float = ALPHA, min_share: float = MIN_SHARE, floor: float = FLOOR
) -> DataFrame:
    """Lines in excess: ``(host, mark, documents, host_documents, share, outside, log_ratio, log10_q)``.

    ``lines`` as of :func:`lines_of`, ``hosts`` one row for each document. A line counts
    once in a document. Documents without a host and lines of fewer than
    ``min_documents`` documents of a host are in no row; empty tables give none.
    """
    sizes = hosts.groupBy("host").agg(F.count("*").alias("host_documents"))
    everything = hosts.count()
    each = lines.select("document_id", F.explode("marks").alias("mark")).where("mark is not null").distinct()
    seen = each.join(hosts, "document_id").groupBy("host", "mark").agg(F.count("*").alias("documents"))
    # A line's total comes from the counts of its hosts, so no source's rows meet in one task.
    counts = materialize(seen)
    totals = counts.groupBy("mark").agg(F.sum("documents").alias("total"))
    k, n = F.col("documents").cast("double"), F.col("host_documents").cast("double")
    outside = (F.col("total") - F.col("documents")).cast("double")
    others = (F.lit(everything) - F.col("host_documents")).cast("double")
    pooled = (k + outside) / (n + others)
    term = lambda x, size, p: F.when(x > 0, x * F.log(x / (size * p))).otherwise(0.0)
    ratio = 2 * (term(k, n, pooled) + term(n - k, n, 1 - pooled) + term(outside, others, pooled) + term(others - outside, others, 1 - pooled))
    tested = (
        counts.where(F.col("documents") >= min_documents)
        .join(totals, "mark")
        .join(sizes, "host")
        .withColumn("share", k / n)
        .withColumn("outside", F.when(others > 0, outside / others).otherwise(0.0))
        .withColumn("log_ratio", F.when(F.col("share") > F.col("outside"), F.greatest(ratio, F.lit(0.0))).otherwise(0.0))
        .withColumn("step", F.least(F.round(_tail(F.col("log_ratio")) * STEPS), F.lit(LAST_STEP)).cast("int"))
    )
    # The ranks of all p-values come from their histogram: at most ``LAST_STEP`` rows for any number of lines.
    steps = tested.groupBy("step").agg(F.count("*").alias("tests"))
    down = W.orderBy(F.desc("step"))
    ranked = steps.select("step", F.sum("tests").over(down).alias("rank"), F.sum("tests").over(W.partitionBy()).alias("family"))
    raw = -F.col("step") / STEPS + F.log10(F.col("family") / F.col("rank"))
    q = ranked.select("step", F.min(raw).over(W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)).alias("log10_q"))
    judged = tested.join(F.broadcast(q), "step")  # at most ``LAST_STEP`` rows
    significant = (F.col("log10_q") <= F.log10(F.lit(alpha))) & (F.col("share") >= floor)
    return judged.where(significant | (F.col("share") >= min_share)).select(
        "host", "mark", "documents", "host_documents", "share", "outside", "log_ratio", "log10_q"
    )


def _placed(lines: DataFrame, hosts: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = lines.select("document_id", "block_id", F.posexplode("marks").alias("line_no", "mark")).where("mark is not null").join(hosts, "document_id")
    return rows.join(chosen.select("host", "mark"), ["host", "mark"], "left_semi").select("block_id", "line_no").distinct()


def found_lines(blocks: DataFrame, chunks: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(block_id, line_no)`` of the lines in excess that stand in ``min_share`` of their host's documents."""
    lines, hosts = materialize(lines_of(blocks)), hosts_of(chunks)
    excess = repeated_lines(lines, hosts, min_documents, min_share=min_share)
    return _placed(lines, hosts, excess.where((F.col("share") >= min_share) & (F.col("documents") >= min_documents)))


def excess_lines(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(block_id, line_no)`` of all lines in excess, by the ratio or by their share."""
    lines, hosts = materialize(lines_of(blocks)), hosts_of(chunks)
    return _placed(lines, hosts, repeated_lines(lines, hosts))


def without_lines(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``blocks`` (rows that appear twice once) with the found lines taken out of their texts.

    The lines of the blocks concerned lose the found ones by an anti-join and come together
    again by position. A block whose lines are all taken out has an empty text; blocks
    without such a line, null texts and all other columns stay as they are.
    """
    concerned = found.select("block_id").distinct()
    # Rows of one block_id with different texts stay apart by the text's hash.
    rows = blocks.dropDuplicates().withColumn("_text", F.xxhash64("text"))
    texts = rows.join(concerned, "block_id", "left_semi").where("text is not null").select("block_id", "_text", "text").dropDuplicates(["block_id", "_text"])
    lines = texts.select("block_id", "_text", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "_line"))
    kept = lines.join(found.select("block_id", "line_no"), ["block_id", "line_no"], "left_anti")
    whole = kept.groupBy("block_id", "_text").agg(F.array_sort(F.collect_list(F.struct("line_no", "_line"))).alias("_kept"))  # a block's lines
    clean = F.array_join(F.transform(F.coalesce("_kept", F.array().cast("array<struct<line_no:int,_line:string>>")), lambda x: x["_line"]), "\n")
    marked = rows.join(concerned.withColumn("_hit", F.lit(True)), "block_id", "left").join(whole, ["block_id", "_text"], "left")
    return marked.withColumn("text", F.when(F.col("_hit") & F.col("text").isNotNull(), clean).otherwise(F.col("text"))).select(*blocks.columns)
