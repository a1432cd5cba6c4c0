"""What goes to an answer: expanded hits, protected and deferred ones, merged occurrences, sentences, rendered blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import text
from paragrid.operators.retrieval import overlap

# Budgets of an expanded hit and of all of a question, in characters, and the reach of neighbours.
PARENT_CHARS, TOTAL_CHARS, REACH = 3_000, 13_000, 2
BREAK = "\n\n"
# Weights of body, data about the document, phrase, headings and first rank.
BODY, ABOUT, PHRASE, HEADING, RANK = 0.42, 0.10, 0.12, 0.36, 0.10
ARTICLE = r"제[0-9]+조(?:의[0-9]+)? ?\([^)]*\)"


def widths(k: Column | int, least: int = 20, most: int | None = None) -> Column:
    """How many candidates to rank for ``k`` results: four times as many, at least ``least`` and at most ``most``."""
    k = F.lit(k) if isinstance(k, int) else k
    wide = F.greatest(F.lit(least), k, 4 * k)
    return wide if most is None else F.least(F.lit(most), wide)


def clamp(value: Column, default: int, most: int = 20) -> Column:
    """A number of results asked for, within 1 and ``most``; the default for what is no number."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.try_to_number(F.trim(value), F.lit("999999999")).cast("int"), F.lit(default))))


def fallback_score(query: Column, body: Column, about: Column, rank: Column) -> Column:
    """Weighted shares of the first 24 terms of a query in body, data about the document and article headings, the phrase, and the rank."""
    asked = F.array_distinct(F.slice(text.terms(query), 1, 24))
    headings = F.array_join(F.regexp_extract_all(F.lower(body), F.lit(ARTICLE), F.lit(0)), " ")
    in_headings = F.size(F.filter(asked, lambda t: F.contains(headings, t))) / F.size(asked)
    phrase = F.contains(text.rank_form(body), text.rank_form(query)).cast("double")
    score = BODY * overlap(asked, text.terms(body)) + ABOUT * overlap(asked, text.terms(about)) + PHRASE * phrase + HEADING * in_headings + RANK / rank
    return F.when(F.size(asked) > 0, F.round(score, 6)).otherwise(0.0)


def protected(ranked: DataFrame, query: str, group: str, anchors: DataFrame, key: str, k: int, per_group: int = 2) -> DataFrame:
    """At most ``per_group`` rows of a group, the first ``k``; a query's anchor that only the group's limit cut takes its group's last place.

    ``anchors`` has a query and the ``key`` of its anchor. An anchor behind the k-th pick is not seen.
    """
    marked = ranked.join(anchors.select(query, F.col(key).alias("_anchor")), query, "left")
    placed = marked.withColumn("_in", F.row_number().over(W.partitionBy(query, group).orderBy("rank")))
    picked = placed.where((F.col("_in") <= per_group) | F.col(group).isNull()).withColumn("_pick", F.row_number().over(W.partitionBy(query).orderBy("rank"))).where(F.col("_pick") <= k)
    ends = picked.groupBy(query).agg(F.max("_pick").alias("_n"), F.max("rank").alias("_end"))
    last = picked.groupBy(query, group).agg(F.max("_pick").alias("_pick"))
    cut = placed.where((F.col(key) == F.col("_anchor")) & (F.col("_in") > per_group) & F.col(group).isNotNull()).join(ends, query)
    cut = cut.where((F.col("rank") < F.col("_end")) | (F.col("_n") < k)).drop("_n", "_end").join(last, [query, group])
    rows = picked.join(cut.select(query, "_pick"), [query, "_pick"], "left_anti").unionByName(cut)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy("_pick"))).drop("_in", "_pick", "_anchor")


def ends_first_documents(ranked: DataFrame, query: str, document: Column) -> DataFrame:
    """Rows with ``place``: whole documents by turns to the front and the back, the best ones at the two ends, rows of a document in order."""
    rows = ranked.withColumn("_document", document).withColumn("_first", F.min("rank").over(W.partitionBy(query, "_document")))
    turn = F.dense_rank().over(W.partitionBy(query).orderBy("_first")) - 1
    side = F.when(F.col("_turn") % 2 == 0, F.col("_turn")).otherwise(F.lit(1_000_000_000) - F.col("_turn"))
    return rows.withColumn("_turn", turn).withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(side, "rank")).cast("long")).drop("_document", "_first", "_turn")


def fallback_rows(primary: DataFrame, fallback: DataFrame, query: str, key: str, slots: int) -> DataFrame:
    """The first ``slots`` rows of each query's fallback list that its primary list does not have, ranked behind it."""
    extra = fallback.join(primary.select(query, key).distinct(), [query, key], "left_anti")
    placed = extra.withColumn("_slot", F.row_number().over(W.partitionBy(query).orderBy("rank"))).where(F.col("_slot") <= slots)
    ends = primary.groupBy(query).agg(F.max("rank").alias("_end"))
    return placed.join(ends, query, "left").withColumn("rank", F.coalesce("_end", F.lit(0)) + F.col("_slot")).drop("_slot", "_end")


def merged(rows: DataFrame, key: str, lists: list[str], stage: Column, rank: Column) -> DataFrame:
    """One row of each key: the richest record (most filled fields), the union of its lists, its best ``rank`` and the ``stage`` that gave it."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in rows.columns), F.lit(0))
    marked = rows.withColumn("_filled", filled).withColumn("_rank", rank).withColumn("_stage", stage)
    plain = [c for c in rows.columns if c != key and c not in lists]
    best = F.max_by(F.struct(*plain), F.struct("_filled", -F.col("_rank")))
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array()))))).alias(c) for c in lists]  # a key's occurrences
    joined = marked.groupBy(key).agg(best.alias("_best"), *unions, F.min("_rank").alias("best_rank"), F.min_by("_stage", F.struct("_rank", "_stage")).alias("best_stage"), F.count("*").alias("occurrences"))
    return joined.select(key, "_best.*", *lists, "best_rank", "best_stage", "occurrences")


def expanded(hits: DataFrame, pieces: DataFrame, query: str, parent_chars: int = PARENT_CHARS, total_chars: int = TOTAL_CHARS, reach: int = REACH, texts: DataFrame | None = None) -> DataFrame:
    """``(query, chunk_id, mode, pieces, chars, text)``: each hit with pieces of its section, or (without one) its neighbours.

    ``hits`` (query, rank, chunk_id); ``pieces`` (chunk_id, document_id, place, section, text), one row
    for each, or with ``size`` instead of the text, which ``texts`` (chunk_id, text) has. Pieces are chosen by
    their sizes, and only the chosen ones' texts are fetched. Hits are visited in order; a hit that an earlier one took in is left out. A hit's own
    text always counts, then the nearest pieces by turns before and after it, as long as one of the two
    at a distance fits the rest of the budget. Every step takes a piece, so no piece further
    than ``parent_chars`` places can be taken and none is fetched.
    """
    order = W.partitionBy("document_id", "section").orderBy("place")
    texts = (pieces if texts is None else texts).select(F.col("chunk_id").alias("piece"), "text")
    if "size" not in pieces.columns:
        pieces = pieces.select("chunk_id", "document_id", "place", "section", F.length("text").alias("size"))
    rows = pieces.withColumn("_in", F.row_number().over(order))
    seeds = hits.join(rows, "chunk_id").select(query, "rank", F.col("chunk_id").alias("hit"), "document_id", F.col("section").alias("_section"), F.col("_in").alias("_at"), F.col("place").alias("_place"))
    inside = rows.where("section is not null and section <> ''").select("document_id", "section", F.col("chunk_id").alias("piece"), F.col("_in").alias("_pos"), "size")
    of_section = seeds.join(inside, (seeds["document_id"] == inside["document_id"]) & (F.col("_section") == F.col("section")))
    of_section = of_section.where(F.abs(F.col("_pos") - F.col("_at")) <= parent_chars).select(query, "rank", "hit", "piece", (F.col("_pos") - F.col("_at")).alias("distance"), "size", F.lit("section").alias("mode"))
    loose = seeds.where("_section is null or _section = ''").withColumn("place", F.explode(F.sequence(F.col("_place") - reach, F.col("_place") + reach)))
    near = pieces.select("document_id", "place", F.col("chunk_id").alias("piece"), "size")
    of_place = loose.join(near, ["document_id", "place"])
    rank_in = F.row_number().over(W.partitionBy(query, "rank", "hit").orderBy("place"))
    own = F.max(F.when(F.col("piece") == F.col("hit"), F.col("_r"))).over(W.partitionBy(query, "rank", "hit"))
    of_place = of_place.withColumn("_r", rank_in).select(query, "rank", "hit", "piece", (F.col("_r") - own).alias("distance"), "size", F.lit("neighbor").alias("mode"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        used, out, total = set(), [], 0
        for (_, hit), group in frame.groupby(["rank", "hit"], sort=True):
            if hit in used:
                continue
            near = {int(d): (p, int(n)) for d, p, n in zip(group["distance"], group["piece"], group["size"])}
            chosen, size, offset = {0}, near[0][1], 1
            budget = min(parent_chars, max(size, total_chars - total))
            while True:
                added = False
                for at in (-offset, offset):
                    if at in near and near[at][0] not in used and size + near[at][1] <= budget:
                        chosen.add(at)
                        size += near[at][1]
                        added = True
                if not added:
                    break
                offset += 1
            used |= {near[at][0] for at in chosen}
            chars = size + len(BREAK) * (len(chosen) - 1)
            total += chars
            out += [(frame[query].iloc[0], hit, group["mode"].iloc[0], len(chosen), chars, at, near[at][0]) for at in sorted(chosen)]
        return pd.DataFrame(out, columns=[query, "chunk_id", "mode", "pieces", "chars", "at", "piece"])

    kind = dict(hits.dtypes)[query]
    found = of_section.unionByName(of_place)
    chosen = found.groupBy(query).applyInPandas(choose, f"{query} {kind}, chunk_id string, mode string, pieces long, chars long, at int, piece string")  # a question's hits
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"])  # within ``parent_chars``, or the hit alone
    return chosen.join(texts, "piece").groupBy(query, "chunk_id", "mode", "pieces", "chars").agg(F.array_join(parts, BREAK).alias("text"))


def answer_sentences(ranked: DataFrame, query: str, question: Column, body: Column, most: int = 8) -> DataFrame:
    """``(query, place, sentence, score)``: the ``most`` best sentences of the results, by shared terms and rank; one of those that begin with the same 80 characters."""
    whole = ranked.select(query, "rank", question.alias("_question"), body.alias("_body")).repartition(query)  # whole texts come to their query once, both windows fit it
    rows = whole.select(query, "rank", "_question", F.posexplode(text.sentences(F.col("_body"))).alias("_n", "sentence"))
    first = rows.withColumn("_copy", F.row_number().over(W.partitionBy(query, F.substring("sentence", 1, 80)).orderBy("rank", "_n"))).where("_copy = 1")
    score = F.round(overlap(text.terms(F.col("_question")), text.terms(F.col("sentence"))) + 1 / (F.col("rank") + 2), 6)
    order = W.partitionBy(query).orderBy(F.desc("score"), "rank", "_n")
    return first.withColumn("score", score).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select(query, "place", "sentence", "score")


def rendered(number: Column, title: Column, body: Column, most: int) -> Column:
    """A numbered context block for a prompt, its text cut at ``most`` characters."""
    return F.concat_ws("\n", F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit(""))), F.substring(body, 1, most))
