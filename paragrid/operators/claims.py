"""Claims of an answer against their contexts: bound quotes, verdicts, retained facts, excerpts, hostile instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import facts, text
from paragrid.operators.retrieval import overlap

# Signs of text that gives orders to a model, with their weights.
HOSTILE = (
    (r"(?i)ignore (all|any|the)? ?(previous|prior|above) (instructions|rules)", 0.9), (r"(이전|위의|앞의) ?(지시|명령|규칙)(를|을)? ?(모두 )?(무시|잊)", 0.9),
    (r"(?i)system prompt|시스템 ?프롬프트", 0.5), (r"(?i)you are now|너는 이제", 0.4), (r"(?i)api[_ ]?key|password|비밀번호를 (알려|출력)", 0.5),
)
EXCLUDE = 0.85


def bound(pairs: DataFrame, child: str, parent: str) -> DataFrame:
    """``pairs`` with ``times`` and, for a child that stands in its parent exactly once, its ``start`` and ``end`` (from 0), else null."""
    first = F.expr(f"locate({child}, {parent})")
    again = F.expr(f"locate({child}, {parent}, locate({child}, {parent}) + 1)")
    times = F.when(F.coalesce(F.length(child), F.lit(0)) == 0, 0).when(F.coalesce(first, F.lit(0)) == 0, 0).when(again == 0, 1).otherwise(2)
    marked = pairs.withColumn("times", times)
    start = F.when(F.col("times") == 1, first - 1)
    return marked.withColumn("start", start).withColumn("end", start + F.length(child))


def units(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """``(key, unit, start, end, sentence)``: the sentences of a text with their places (from 0); nothing of the text is lost but white space between them."""
    # Sentences follow each other, so each is looked for from the end of the one before.
    at = F.expr(
        "aggregate(_sentences, named_struct('at', 1, 'starts', cast(array() as array<int>)), (s, x) -> named_struct('at', locate(x, _body, s.at) + length(x), "
        "'starts', concat(s.starts, array(locate(x, _body, s.at) - 1))), s -> s.starts)"
    )
    cut = rows.select(key, body.alias("_body"), text.sentences(body).alias("_sentences")).select(key, "_body", "_sentences", at.alias("_starts"))
    cut = cut.select(key, F.posexplode(F.arrays_zip("_sentences", "_starts")).alias("unit", "z")).select(key, "unit", F.col("z._starts").alias("start"), F.col("z._sentences").alias("sentence"))
    return cut.select(key, F.col("unit").cast("long").alias("unit"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("sentence")).cast("long").alias("end"), "sentence")


def verdicts(pairs: DataFrame, claim: str, source: str, least: float = 0.4) -> DataFrame:
    """``pairs`` with ``verdict``: matched, mismatch (a fact, bound or scope contradicts) or uncertain (too little in common)."""
    found = facts.conflicts(F.col(claim), F.col(source))
    share = F.round(overlap(text.terms(F.col(claim)), text.terms(F.col(source))), 6)
    hard = F.arrays_overlap(found, F.array(F.lit("bound"), F.lit("scope"), F.lit("phone"), F.lit("fact")))
    verdict = F.when(share < least, "uncertain").when(hard | F.array_contains(found, "polarity"), "mismatch").otherwise("matched")
    return pairs.withColumn("conflicts", found).withColumn("share", share).withColumn("verdict", verdict)


def verified_answers(judged: DataFrame, key: str, claim: str, place: str) -> DataFrame:
    """``(key, supported, answer)``: the claim with the numbers of the sources that match it, or without an answer."""
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == "matched", F.col(place)))), lambda p: F.concat(F.lit("["), (p + 1).cast("string"), F.lit("]"))), "")
    made = judged.groupBy(key).agg(F.min(claim).alias("_c"), F.count_if(F.col("verdict") == "matched").alias("supported"), marks.alias("_m"))  # a claim's sources
    return made.select(key, "supported", F.when(F.col("supported") > 0, F.concat_ws(" ", "_c", "_m")).alias("answer"))


def retention(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """``rows`` with ``facts``, ``kept`` and ``retention``: how many facts of a text its later form still has; 1 without facts."""
    a, b = facts.typed_facts(before), facts.typed_facts(after)
    made = rows.withColumn("facts", F.size(a).cast("long")).withColumn("kept", F.size(F.array_intersect(a, b)).cast("long"))
    return made.withColumn("retention", F.when(F.col("facts") > 0, F.round(F.col("kept") / F.col("facts"), 6)).otherwise(1.0))


def excerpts(pairs: DataFrame, keys: list[str], claim: str, source: str, most: int = 300) -> DataFrame:
    """``(keys, unit, excerpt)``: the unit of evidence that has most of the claim's facts, then of its terms, then comes first; cut at ``most``."""
    each = pairs.select(*keys, claim, F.posexplode(facts.evidence_units(F.col(source))).alias("unit", "_text"))
    held = F.size(F.array_intersect(facts.typed_facts(F.col(claim)), facts.typed_facts(F.col("_text"))))
    shared = F.size(F.array_intersect(F.array_distinct(text.terms(F.col(claim))), text.terms(F.col("_text"))))
    best = F.max_by(F.struct(F.col("unit").cast("long").alias("unit"), F.substring("_text", 1, most).alias("excerpt")), F.struct(held, shared, -F.col("unit")))
    return each.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def hostility(body: Column) -> Column:
    """How much a text looks like orders to a model, from 0 to 1: the weights of the signs it holds, as independent chances."""
    miss = F.lit(1.0)
    for pattern, weight in HOSTILE:
        miss = miss * F.when(F.coalesce(body.rlike(pattern), F.lit(False)), 1 - weight).otherwise(1.0)
    return F.round(1 - miss, 6)


def gate(rows: DataFrame, body: str, about: str) -> DataFrame:
    """``rows`` with ``decision`` and ``safe`` text: excluded if the text scores ``EXCLUDE`` or its data show any sign, sanitised if it scores less, else passed."""
    score = hostility(F.col(body))
    cleaned = F.col(body)
    for pattern, _ in HOSTILE:
        cleaned = F.regexp_replace(cleaned, pattern, "…")
    decision = F.when((score >= EXCLUDE) | (hostility(F.col(about)) > 0), "exclude").when(score > 0, "sanitise").otherwise("pass")
    return rows.withColumn("hostility", score).withColumn("decision", decision).withColumn("safe", F.when(decision == "pass", F.col(body)).when(decision == "sanitise", cleaned))


def adjacent_replacement(hits: DataFrame, pieces: DataFrame, query: str, question: str) -> DataFrame:
    """``hits`` with ``chosen``: a neighbour (one place before or after) that shares strictly more terms with the question, else the hit itself.

    ``pieces`` (chunk_id, document_id, place, text); of two neighbours the better, then the one after, is taken.
    """
    own = hits.join(pieces, "chunk_id").withColumn("_score", F.round(overlap(text.terms(F.col(question)), text.terms(F.col("text"))), 6))
    beside = own.select(query, "rank", "chunk_id", question, "_score", "document_id", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), F.col("place").alias("_from"))
    other = pieces.select("document_id", "place", F.col("chunk_id").alias("_other"), F.col("text").alias("_text"))
    met = beside.join(other, ["document_id", "place"]).withColumn("_new", F.round(overlap(text.terms(F.col(question)), text.terms(F.col("_text"))), 6)).where("_new > _score")
    order = W.partitionBy(query, "rank").orderBy(F.desc("_new"), F.desc("place"), "_other")
    best = met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(query, "rank", "_other")
    return hits.join(best, [query, "rank"], "left").withColumn("chosen", F.coalesce("_other", "chunk_id")).drop("_other")
