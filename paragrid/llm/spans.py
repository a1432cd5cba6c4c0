"""Long passages that stand word for word in more than one document.

Windows are hashed only at anchors: positions whose residue modulo ``PERIOD`` lies in a
perfect difference cover. Two equal passages of ``PERIOD + WINDOW - 1`` characters have,
for every offset between them, an anchor at the same place, so every passage of
``LENGTH`` characters is met. An anchor stays if its window, with the 45 characters
before or after it, stands in another document too. Around these few anchors all windows
of ``LENGTH`` characters are hashed: equal ones are the shared passages.

The anchors are shuffled as packed arrays, a row for each batch and bucket. Anchors that
a batch already holds in two documents are kept at once and only one of them is sent, so
a passage of a third of all documents arrives once for each batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.llm.expand import spread_join
from paragrid.session import materialize

LENGTH = 150
# A perfect difference cover modulo 91 (every residue is one difference of two members).
PERIOD, COVER = 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
WINDOW = LENGTH + 1 - PERIOD
BESIDE = (LENGTH - WINDOW) // 2
SEGMENT = 1_000_000
BROADCAST_POSITIONS = 4_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit pseudo-random value for each code point."""
    x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hashes:
    """Polynomial hashes of any window of the joined texts, all at once."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes) * _powers(_BASE, len(codes))[:-1], out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 2**64), len(codes))

    def at(self, begin: np.ndarray, size: int) -> np.ndarray:
        x = (self.sums[begin + size] - self.sums[begin]) * self.back[begin]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _pieces(texts: Iterable[tuple[int, str]], before: int, after: int) -> Iterator[list[tuple[int, int, int, int, str]]]:
    """Groups of about a segment's characters: (document, first own position, own length, lead, text)."""
    group, size = [], 0
    for number, text in texts:
        for at in range(0, len(text), SEGMENT):
            lead = min(before, at)
            piece = text[at - lead : at + SEGMENT + after]
            group.append((number, at, min(SEGMENT, len(text) - at), lead, piece))
            size += len(piece)
            if size >= SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


def _anchors(group: list[tuple[int, int, int, int, str]]) -> tuple[np.ndarray, ...]:
    """Document, position, hash, and the marks of the windows longer to the left and to the right (0: none)."""
    hashes = Hashes([g[4] for g in group])
    number, first, own, lead = (np.array([g[i] for g in group], np.int64) for i in range(4))
    size = np.array([len(g[4]) for g in group], np.int64)
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    position = place + np.repeat(first - lead, size)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    left = np.repeat(size, size) - place
    owned = (place >= np.repeat(lead, size)) & (place < np.repeat(lead + own, size))
    at = np.flatnonzero(cover[position % PERIOD] & (left >= WINDOW) & owned)
    marks = []
    for valid, start in ((place[at] >= BESIDE, at - BESIDE), (left[at] >= WINDOW + BESIDE, at)):
        found = hashes.at(np.where(valid, start, 0), WINDOW + BESIDE) if len(at) and len(hashes.sums) > WINDOW + BESIDE else np.zeros(len(at), np.uint64)
        marks.append(np.where(valid, np.maximum((found >> np.uint64(48)).astype(np.uint16), 1), 0).astype(np.uint16))
    return np.repeat(number, size)[at], position[at], hashes.at(at, WINDOW), *marks


def _shared(key: np.ndarray, document: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a key stands in another document too; where a key comes first."""
    shared, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    at = np.flatnonzero(valid)
    if len(at):
        order = at[np.argsort(key[at], kind="stable")]
        k, d = key[order], document[order]
        head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        many = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        shared[order] = np.repeat(many, np.diff(np.r_[head, len(k)]))
        first[order[head]] = True
    return shared, first


def _keys(low: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = low.astype(np.uint64) << np.uint64(16)
    return wide | left, wide | right


_PACKED = "bucket int, documents binary, index binary, position binary, low binary, before binary, after binary"


def _partition_keys(spark: SparkSession, partitions: int) -> list[int]:
    """A number for each partition that hash partitioning puts there, so that no partition gets two buckets."""
    tried = spark.range(40 * partitions + 100).select(F.col("id").cast("int").alias("k"))
    placed = tried.groupBy(F.expr(f"pmod(hash(k), {partitions})").alias("p")).agg(F.min("k").alias("k"))
    found = {r["p"]: r["k"] for r in placed.collect()}  # a row for each partition
    return [found.get(p, p) for p in range(partitions)]


def _send(keys: list[int]):
    buckets = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for n, group in enumerate(_pieces(enumerate(batch.column(1).to_pylist()), BESIDE, WINDOW + BESIDE)):
                number, position, hashed, before, after = _anchors(group)
                bucket = ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                low = hashed.astype(np.uint32)
                unique, document = np.unique(ids[number], return_inverse=True)
                whole = hashed - (hashed & np.uint64(0xFFFF))
                left, left_first = _shared(whole | before, document, before > 0)
                right, right_first = _shared(whole | after, document, after > 0)
                kept = left | right
                sent = ~kept | left_first | right_first
                rows = [(int(unique[0]) % buckets, kept, True)] if kept.any() else []
                rows += [(b, sent & (bucket == b), False) for b in range(buckets)] if buckets <= 64 else []
                if buckets > 64:
                    order = np.flatnonzero(sent)[np.argsort(bucket[sent], kind="stable")]
                    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
                    rows += [(int(bucket[part[0]]), part, False) for part in np.split(order, cut[1:]) if len(part)]
                out = []
                for b, which, done in rows:
                    own, index = np.unique(document[which], return_inverse=True)
                    if not len(own):
                        continue
                    if done:
                        parts = [np.empty(0, t) for t in (np.uint32, np.uint16, np.uint16)]
                    else:
                        parts = [low[which], before[which], after[which]]
                    # Differences of neighbours are small numbers, which the shuffle's codec shrinks.
                    steps = [np.diff(index, prepend=0).astype(np.int32), np.diff(position[which], prepend=0).astype(np.int32)]
                    out.append((keys[b], *(a.tobytes() for a in (unique[own], *steps, *parts))))
                if out:
                    columns = [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out))]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PACKED.split(", ")])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a partition's buckets that stand in two documents, and those kept before."""
    parts: list[tuple[np.ndarray, ...]] = []
    names = ["document", "position"]
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(row[1], np.int64)
            document = ids[np.cumsum(np.frombuffer(row[2], np.int32))]
            position = np.cumsum(np.frombuffer(row[3], np.int32))
            low, before, after = (np.frombuffer(b, t) for b, t in zip(row[4:], (np.uint32, np.uint16, np.uint16)))
            if not len(low):
                yield pa.RecordBatch.from_arrays([pa.array(document), pa.array(position.astype(np.int32))], names)
            else:
                parts.append((document, position.astype(np.int32), low, before, after, np.full(len(low), row[0], np.uint64)))
    if parts:
        document, position, low, before, after, bucket = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        stays = np.zeros(len(low), bool)
        for mark in (before, after):
            key = (bucket % np.uint64(2**16)) << np.uint64(48) | low.astype(np.uint64) << np.uint64(16) | mark
            stays |= _shared(key, document, mark > 0)[0]
        yield pa.RecordBatch.from_arrays([pa.array(document[stays]), pa.array(position[stays])], names)


def _around(positions: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Merged ranges (first, last) of the starts of windows that hold one of the positions' windows."""
    first = np.maximum(positions - (LENGTH - WINDOW), 0)
    last = np.minimum(positions, size - LENGTH)
    ranges: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if a > b:
            continue
        if ranges and a <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return ranges


def _long_windows(every_start: bool):
    names = ["window", "document", "start"]

    def hashed(ids: list[int], group: list[tuple[int, int, str]]) -> pa.RecordBatch:
        hashes = Hashes([g[2] for g in group])
        size = np.array([len(g[2]) for g in group], np.int64)
        begin = np.cumsum(size) - size
        counts = size - LENGTH + 1
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        window = hashes.at(place + np.repeat(begin, counts), LENGTH).view(np.int64)
        document = np.repeat(np.array([ids[g[0]] for g in group], np.int64), counts)
        start = place + np.repeat(np.array([g[1] for g in group], np.int64), counts)
        if not every_start and len(window):
            order = np.lexsort((document, window))
            w, d = window[order], document[order]
            one = order[np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])]]
            window, document, start = window[one], document[one], start[one]
        return pa.RecordBatch.from_arrays([pa.array(window), pa.array(document), pa.array(start.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, size = batch.column(0).to_pylist(), [], 0
            for n, (text, positions) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for first, last in _around(np.unique(positions), len(text)):
                    for a in range(first, last + 1, SEGMENT):
                        piece = text[a : min(a + SEGMENT - 1, last) + LENGTH]
                        group.append((n, a, piece))
                        size += len(piece)
                if size >= SEGMENT:
                    yield hashed(ids, group)
                    group, size = [], 0
            if group:
                yield hashed(ids, group)

    return run


def _candidates(texts: DataFrame) -> DataFrame:
    """``(document, text, positions)`` of documents with anchors that stand elsewhere too."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_send(_partition_keys(spark, buckets)), _PACKED).repartition(buckets, "bucket")
    anchors = materialize(sent.mapInArrow(_meet, "document long, position int"))
    places = anchors.groupBy("document").agg(F.collect_set("position").alias("positions"))  # at most a text's length
    if anchors.count() <= BROADCAST_POSITIONS:  # 16 MB of positions
        places = F.broadcast(places)
    return texts.join(places, "document").select("document", "text", "positions")


def shared_windows(df: DataFrame, document: str = "doc_id", text: str = "text", every_start: bool = False) -> DataFrame:
    """``(window, document, start)`` of windows around anchors; equal windows are equal passages of ``LENGTH``.

    With ``every_start`` all starts, else one for each document and window. Null ids,
    null texts and texts under ``LENGTH`` characters are in no row.
    """
    texts = df.select(F.col(document).cast("long").alias("document"), F.col(text).alias("text")).where(
        F.col("document").isNotNull() & (F.length("text") >= LENGTH)
    )
    return _candidates(texts).mapInArrow(_long_windows(every_start), "window long, document long, start int")


def sharing_pairs(df: DataFrame, document: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``(doc_id_a, doc_id_b)`` of documents that share a passage of ``LENGTH`` characters.

    Windows that stand in the same set of documents say the same, so one of them is kept
    and each set's members are paired once. Repeated rows count once; documents with one
    id are one document; an empty table gives no pairs.
    """
    rows = materialize(shared_windows(df, document, text).select("window", "document"))
    sets = rows.groupBy("window").agg(
        F.min("document").alias("low"), F.max("document").alias("high"),
        F.sum(F.xxhash64("document").cast("decimal(20,0)")).alias("members"), F.count("*").alias("n"),
    ).where("low < high")
    one = materialize(sets.groupBy("low", "high", "members", "n").agg(F.min("window").alias("window")))
    if one.count() <= BROADCAST_POSITIONS // 4:
        chosen = F.broadcast(one.select("window"))
    else:
        chosen = one.select("window")
    members = materialize(rows.join(chosen, "window").distinct())
    other = members.withColumnRenamed("document", "doc_id_b")
    pairs = spread_join(members.withColumnRenamed("document", "doc_id_a"), other, ["window"], "doc_id_b").where("doc_id_a < doc_id_b")
    return pairs.select("doc_id_a", "doc_id_b").distinct()


def shared_share(df: DataFrame, document: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share)``: how much of each document stands in another one too.

    A null or an empty text has no characters and the share 0. Repeated rows count once.
    """
    from pyspark.sql import Window as W

    rows = materialize(shared_windows(df, document, text, every_start=True).distinct())
    elsewhere = rows.groupBy("window").agg(F.min("document").alias("low"), F.max("document").alias("high")).where("low < high")
    starts = rows.join(elsewhere.select("window"), "window", "left_semi").select("document", "start")
    order = W.partitionBy("document").orderBy("start")  # at most a text's windows
    step = F.lead("start").over(order) - F.col("start")
    covered = starts.select("document", F.least(F.coalesce(step, F.lit(LENGTH)), F.lit(LENGTH)).alias("own"))
    found = covered.groupBy("document").agg(F.sum("own").alias("shared_chars"))
    sizes = df.groupBy(F.col(document).cast("long").alias("document")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    joined = sizes.where("document is not null").join(found, "document", "left")
    shared = F.coalesce(F.col("shared_chars"), F.lit(0)).cast("long")
    share = F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0)
    return joined.select(F.col("document").alias("doc_id"), "n_chars", shared.alias("shared_chars"), share.alias("share"))
