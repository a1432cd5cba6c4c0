"""Evidence in ranked results: quotes within texts, near quotes, table relations, and what of the wanted evidence was returned."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.functions import facts
from paragrid.session import materialize, sent_packed

#: Most letters by which quotes and texts meet, wordings that are sent to all tasks at once, and letters of texts held at once.
WINDOW, QUOTES, LETTERS = 12, 200_000, 500_000
#: Pairs of case and text that a task marks at once.
CELLS = 8_000_000
#: A near quote is this alike.
NEAR = 0.85


def contained(quotes: DataFrame, quote_id: str, quote: str, texts: DataFrame, text_id: str, text: str, unique: bool = False) -> DataFrame:
    """``(quote_id, text_id)`` of each quote that stands in a text, word for word.

    Quotes and texts come in the normal form to compare in. Each wording goes once to all tasks, in
    groups of about ``QUOTES``, each group in a pass of its own over the texts; so no text is
    exchanged. Null and empty quotes stand in none; rows that appear twice count
    once. ``unique`` says that an id has one quote, or one text.
    """
    asked = quotes.select(F.col(quote_id), F.col(quote).alias("_quote")).where("_quote <> ''").distinct()
    own = texts.select(F.col(text_id), F.col(text).alias("_text")).where("_text <> ''")
    words = materialize(asked.select("_quote").distinct().withColumn("_q", F.monotonically_increasing_id()))
    groups = max(1, -(-words.count() // QUOTES))
    part = F.pmod(F.xxhash64("_q"), F.lit(groups))
    met = reduce(DataFrame.unionByName, (_met(words.where(part == n), own, text_id) for n in range(groups)))
    found = met.join(asked.join(words, "_quote").select(quote_id, "_q"), "_q").select(quote_id, text_id)
    return found if unique else found.distinct()


def _met(words: DataFrame, own: DataFrame, text_id: str) -> DataFrame:
    """``(_q, text_id)`` of the wordings ``(_q, _quote)``, which go to all tasks, and the texts ``(text_id, _text)`` that hold them."""
    held = words.select("_q", "_quote").toArrow()  # about ``QUOTES`` rows
    sent = words.sparkSession.sparkContext.broadcast((held.column("_q").to_numpy(), held.column("_quote").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, wordings = sent.value
        sought = _Wordings(wordings)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in bodies])
            at = 0
            while at < len(bodies):
                last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, side="right")))
                q, t = sought.within(bodies[at:last])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), batch.column(0).take(pa.array(t + at))], ["_q", text_id])
                at = last

    return own.mapInArrow(run, f"_q long, `{text_id}` {dict(own.dtypes)[text_id]}")


def holding(cases: DataFrame, case: str, quotes: str, ranked: DataFrame, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """``(case, wanted, found)``: the texts that hold any of a case's quotes, and how many of them ``ranked`` (case, text_id) has for it.

    ``cases`` has an array of quotes for each case, ``texts`` and ``ranked`` no row twice. Cases go to all tasks with
    their quotes and ranked texts, in groups of about ``QUOTES`` quotes, each group in a pass of its own over
    the texts. A task counts, so pairs of case and text, which grow with the square of
    repeated sentences, are exchanged nowhere. A case without such a text has no row.
    """
    asked = materialize(cases.select(F.col(case), F.array_distinct(F.filter(quotes, lambda q: q != "")).alias("_quotes")).where("size(_quotes) > 0"))
    own = texts.select(F.col(text_id), F.col(text).alias("_text")).where("_text <> ''").coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, -(-(asked.agg(F.sum(F.size("_quotes"))).first()[0] or 0) // QUOTES))
    wanted = ranked.select(case, text_id) if groups == 1 else materialize(ranked.select(case, text_id))
    part = F.pmod(F.xxhash64(case), F.lit(groups))
    met = reduce(DataFrame.unionByName, (_holding(asked.where(part == n), wanted.where(part == n), own, case, text_id) for n in range(groups)))
    return met.groupBy(case).agg(F.sum("wanted").alias("wanted"), F.sum("found").alias("found"))


def _by(number: pa.Array | np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of each of ``n`` numbers: an order of all places, and where each number's begin in it and how many they are."""
    count = np.bincount(number, minlength=n)
    return np.argsort(number, kind="stable"), np.cumsum(count) - count, count


def _spread(number: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the numbers all its places in the order of :func:`_by`, and which of the numbers it was."""
    many = count[number]
    return np.repeat(start[number] - np.cumsum(many) + many, many) + np.arange(many.sum()), np.repeat(np.arange(len(number)), many)


def _holding(asked: DataFrame, ranked: DataFrame, own: DataFrame, case: str, text_id: str) -> DataFrame:
    """``(case, wanted, found)`` of each task for the cases ``(case, _quotes)``, which go to all tasks."""
    kinds = dict(asked.dtypes)[case]
    held, hits = asked.toArrow(), ranked.toArrow()  # about ``QUOTES`` quotes
    names, lists = held.column(case).combine_chunks(), held.column("_quotes").combine_chunks()
    words, size = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    word, first = words.indices.to_numpy(), np.cumsum(size) - size
    owner = np.repeat(np.arange(len(names)), size)
    several = np.repeat(size > 1, size)  # a case of one quote needs no pairs, its texts are the quote's
    order, start, count = _by(word[several], len(words.dictionary))
    whose = pc.index_in(hits.column(case).combine_chunks(), value_set=names)
    there = whose.is_valid()
    keys = hits.column(text_id).combine_chunks().filter(there).dictionary_encode()
    key_order, key_start, key_count = _by(keys.indices.to_numpy(), len(keys.dictionary))
    whose = whose.filter(there).to_numpy()[key_order]
    sent = sent_packed(asked.sparkSession, (names, words.dictionary, word, first, size, owner[several][order], start, count, keys.dictionary, whose, key_start, key_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wordings, word, first, size, owner, start, count, keys, whose, key_start, key_count = sent()
        sought, wanted, found = _Wordings(wordings.to_pylist()), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        texts_of, here, marked, number = np.zeros(len(wordings), np.int64), np.zeros(len(wordings), bool), np.full(len(names), -1), 0
        for batch in batches:
            bodies, ranked_at = batch.column(1).to_pylist(), pc.fill_null(pc.index_in(batch.column(0), value_set=keys), -1).to_numpy()
            ends = np.cumsum([len(t) for t in bodies])
            at = 0
            while at < len(bodies):
                last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, side="right")))
                q, t = sought.within(bodies[at:last])
                texts_of += np.bincount(q, minlength=len(wordings))
                q = q[np.argsort(t, kind="stable")]
                to = np.cumsum(np.bincount(t, minlength=last - at))
                for n, (low, high) in enumerate(zip([0, *to[:-1].tolist()], to.tolist())):
                    if low == high:
                        continue
                    held, done = q[low:high], 0
                    pairs = np.cumsum(count[held])
                    while done < len(held):  # as many pairs as are marked at once
                        past = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + CELLS, side="right")))
                        places, _ = _spread(held[done:past], start, count)
                        cases = owner[places]
                        cases = cases[marked[cases] != number]
                        wanted[cases] += 1  # once for a case that has several of the quotes
                        marked[cases] = number
                        done = past
                    number += 1
                    if (key := ranked_at[at + n]) >= 0:
                        here[held] = True
                        cases = whose[key_start[key] : key_start[key] + key_count[key]]
                        places, which = _spread(cases, first, size)
                        found[cases] += np.bincount(which, here[word[places]], len(cases)) > 0
                        here[held] = False
                at = last
        alone = size == 1
        wanted[alone] = texts_of[word[first[alone]]]
        some = np.flatnonzero(wanted)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(wanted[some]), pa.array(found[some])], [case, "wanted", "found"])

    return own.mapInArrow(run, f"`{case}` {kinds}, wanted long, found long")


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _mixed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For 1 to ``WINDOW`` letters: hashes of as many from each place on."""
    mixed = np.zeros(len(codes), np.uint64)
    for k in range(min(WINDOW, len(codes))):
        n = len(codes) - k
        mixed = mixed[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[k:]
        yield k + 1, mixed * np.uint64(0xBF58476D1CE4E5B9)


#: An odd number has an inverse, so a stretch's hash comes from sums over what stands before its ends.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the letters before each place, and the factor that makes a stretch's hash independent of its place."""
    powers = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), base, np.uint64)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(_BASE)[:-1])]), powers(_INVERSE)


def _stretches(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the letters from ``at`` on, ``length`` of them."""
    whole = (sums[0][at + length] - sums[0][at]) * sums[1][at] + length.astype(np.uint64)
    return (whole ^ (whole >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class _Marks:
    """Places of hashes: which of ``marks`` are like others, found at once for many."""

    def __init__(self, marks: np.ndarray) -> None:
        self.order = np.argsort(marks, kind="stable")
        self.mark, self.start, self.count = np.unique(marks[self.order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.mark >> np.uint64(44)] = True

    def met(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``marks`` and in the own ones that are equal."""
        at = np.flatnonzero(self.sieve[marks >> np.uint64(44)])
        head = np.minimum(np.searchsorted(self.mark, marks[at]), len(self.mark) - 1)
        same = self.mark[head] == marks[at]
        places, which = _spread(head[same], self.start, self.count)
        return at[same][which], self.order[places]


class _Wordings:
    """Wordings by their hash; those of over ``WINDOW`` letters are looked for where their first ``WINDOW`` stand, once for each length that begins so."""

    def __init__(self, wordings: list[str]) -> None:
        self.wordings, self.length = wordings, np.array([len(w) for w in wordings], np.int64)
        self.heads = {}
        for size in range(1, WINDOW + 1):
            own = np.flatnonzero(np.minimum(self.length, WINDOW) == size)
            if len(own):
                marks = dict(_mixed(_codes([wordings[n][:size] for n in own])))[size][::size]
                if size == WINDOW:
                    _, first = np.unique(np.stack([marks, self.length[own].astype(np.uint64)]), axis=1, return_index=True)
                    self.lengths, self.long, hashes = self.length[own[first]], own, []
                    for n in range(0, len(own), 10_000):
                        some = own[n : n + 10_000]
                        length = self.length[some]
                        hashes.append(_stretches(_sums(_codes([wordings[w] for w in some])), np.cumsum(length) - length, length))
                    self.whole, marks, own = _Marks(np.concatenate(hashes)), marks[first], None
                self.heads[size] = own, _Marks(marks)

    def within(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of wordings and of the texts that hold them, each pair once."""
        ends = np.cumsum([len(t) for t in texts])
        codes, found = _codes(texts), [np.empty(0, np.int64)]
        for size, marks in _mixed(codes):
            if size not in self.heads:
                continue
            own, heads = self.heads[size]
            at, w = heads.met(marks)
            if size == WINDOW:
                length = self.lengths[w]
                fits = at + length <= ends[np.searchsorted(ends, at, side="right")]
                at, length = at[fits], length[fits]
                n, w = self.whole.met(_stretches(_sums(codes), at, length))
                at, own = at[n], self.long
            w = own[w]
            t = np.searchsorted(ends, at, side="right")
            fits = at + self.length[w] <= ends[t]
            pairs = w[fits] * len(texts) + t[fits]
            found.append(np.unique(pairs))
        pairs = np.concatenate(found)
        w, t = np.divmod(pairs, len(texts))
        held = np.fromiter((self.wordings[a] in texts[b] for a, b in zip(w.tolist(), t.tolist())), bool, len(w))
        return w[held], t[held]


def near_quote(quote: str, text: str) -> tuple[float, str]:
    """How alike the best window of a text is to a quote, and that window.

    Windows of about the quote's length start at every tenth of it.
    """
    if not quote or not text:
        return 0.0, ""
    size, best = len(quote), (0.0, "")
    matcher = SequenceMatcher(None, autojunk=False)
    matcher.set_seq2(quote)
    for length in sorted({max(1, size * 9 // 10), size, size * 23 // 20 + 4}):
        for start in [*range(0, max(1, len(text) - length + 1), max(1, size // 10)), max(0, len(text) - length)]:
            window = text[start : start + length]
            matcher.set_seq1(window)
            if matcher.real_quick_ratio() > best[0] and matcher.quick_ratio() > best[0]:
                best = max(best, (matcher.ratio(), window))
    return best


def near(pairs: DataFrame, quote: str, text: str) -> DataFrame:
    """``pairs`` with ``ratio``, ``matched`` and ``reason``: exact, near, missing_fact, polarity, or unlike.

    A near quote must hold every fact of the quote and deny what it denies.
    """
    shape = pairs.withColumn("ratio", F.lit(0.0)).withColumn("_window", F.lit("")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [near_quote(q or "", t or "") for q, t in zip(frame[quote], frame[text])]
            yield frame.assign(ratio=[round(m[0], 6) for m in made], _window=[m[1] for m in made])

    found = pairs.mapInPandas(run, shape)
    lacking = F.size(F.array_except(facts.typed_facts(F.col(quote)), facts.typed_facts(F.col("_window")))) > 0
    reason = (
        F.when(F.contains(text, F.col(quote)), "exact").when(F.col("ratio") < NEAR, "unlike").when(lacking, "missing_fact")
        .when(facts.denies(F.col(quote)) != facts.denies(F.col("_window")), "polarity").otherwise("near")
    )
    return found.withColumn("reason", reason).withColumn("matched", F.col("reason").isin("exact", "near")).drop("_window")


def cells(tables: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, row_no, column_no, header, anchor, value)`` of each cell of tables in text form, with its column's head and its row's first cell."""
    rows = tables.select(key, facts.table_matrix(F.col(text)).alias("_m"))
    lines = rows.select(key, F.get("_m", 0).alias("_head"), F.posexplode("_m").alias("row_no", "_row"))
    each = lines.select(key, "row_no", "_head", F.get("_row", 0).alias("anchor"), F.posexplode("_row").alias("column_no", "value"))
    return each.select(key, "row_no", "column_no", F.get("_head", F.col("column_no")).alias("header"), "anchor", "value")


def relation_holds(asked: DataFrame, tables: DataFrame, key: str, text: str) -> DataFrame:
    """``asked`` (key, header, anchor, value) with ``holds``: whether the table has the value in that column and row."""
    found = cells(tables, key, text).where("row_no > 0").select(key, "header", "anchor", "value").distinct().withColumn("_holds", F.lit(True))
    return asked.join(found, [key, "header", "anchor", "value"], "left").withColumn("holds", F.coalesce("_holds", F.lit(False))).drop("_holds")


def evidence_recall(ranked: DataFrame, wanted: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """``(query, wanted, found, recall, any_found, all_found)`` within the first ``k`` results of each query of ``wanted``.

    ``wanted`` may say ``required``; other rows do not count. A query without required evidence has recall 0 and not all.
    """
    required = F.coalesce(F.col("required"), F.lit(True)) if "required" in wanted.columns else F.lit(True)
    own = wanted.select(query, F.when(required, F.col(key)).alias(key)).distinct()
    returned = ranked.where(F.col("rank") <= k).select(query, key).distinct().withColumn("_there", F.lit(True))
    met = own.join(returned, [query, key], "left").groupBy(query).agg(F.count(key).alias("wanted"), F.count_if(F.col("_there") & F.col(key).isNotNull()).alias("found"))
    recall = F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(0.0)
    return met.select(query, "wanted", "found", F.round(recall, 6).alias("recall"), (F.col("found") > 0).alias("any_found"), ((F.col("wanted") > 0) & (F.col("found") == F.col("wanted"))).alias("all_found"))


def claim_recall(ranked: DataFrame, options: DataFrame, query: str, claim: str, key: str, k: int) -> DataFrame:
    """``(query, claims, found, recall)``: a claim is found if any of its options is within the first ``k`` results."""
    returned = ranked.where(F.col("rank") <= k).select(query, key).distinct().withColumn("_there", F.lit(True))
    each = options.join(returned, [query, key], "left").groupBy(query, claim).agg(F.coalesce(F.bool_or("_there"), F.lit(False)).alias("_found"))
    met = each.groupBy(query).agg(F.count("*").alias("claims"), F.count_if("_found").alias("found"))
    return met.withColumn("recall", F.round(F.col("found") / F.col("claims"), 6))


def folded(ranked: DataFrame, query: str, document: Column) -> DataFrame:
    """The first result of each document, ranked anew as ``document_rank``: documents instead of their pieces."""
    rows = ranked.withColumn("_document", document)
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(query, "_document").orderBy("rank"))).where("_n = 1").drop("_n", "_document")
    return first.withColumn("document_rank", F.row_number().over(W.partitionBy(query).orderBy("rank")).cast("long"))


def title_hits(documents: DataFrame, expected: DataFrame, query: str, k: int) -> DataFrame:
    """``(query, hit_rank, same_host)``: the first of ``k`` documents whose title holds ``wanted_title``; the host is told, not asked."""
    rows = documents.where(F.col("document_rank") <= k).join(expected, query)
    fits = (F.col("wanted_title") != "") & F.contains("title_form", F.col("wanted_title"))
    best = F.min_by(F.struct(F.col("document_rank").alias("hit_rank"), (F.col("wanted_host").isNull() | (F.col("wanted_host") == F.col("host"))).alias("same_host")), "document_rank")
    met = rows.where(fits).groupBy(query).agg(best.alias("b")).select(query, "b.*")
    return expected.select(query).distinct().join(met, query, "left")
