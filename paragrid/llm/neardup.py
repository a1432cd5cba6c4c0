"""Near-duplicate documents: groups of texts alike beyond a threshold.

Likeness is the Jaccard measure of the sets of five-character sequences. Each document
gets six one-permutation minhashes of sixty bins; a band takes one bin of each, so two
documents alike at 0.7 miss all sixty bands in 0.06 % of cases, at 0.8 in none that can
be seen. A band's bucket is a shard: its fingerprints (one bit of 128 bins) stand in a
BK-tree, children keyed by their integer Hamming distance to the parent, and only edges
within the radius are followed. Pairs within the radius are then measured exactly.
Documents of the same sequences, each as often, are a class with one representative; a
bucket over ``SHARD`` members is cut into blocks that meet pairwise, so no task holds more
than two blocks. A document of over ``LARGE_BLOCKS`` blocks or ``LARGE_CHARS`` characters is
never assembled: its blocks are sorted over all tasks, sketched in parts whose minima are
merged, and measured by a join of its sequences. Every document takes part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.llm.expand import spread_join
from paragrid.session import materialize

THRESHOLD = 0.7
WIDTH = 5
FUNCTIONS, BANDS, BITS = 6, 60, 128
RADIUS = 40
SHARD = 2_000
GROUP_CHARS = 400_000
BROADCAST_ROWS = 300_000
LARGE_BLOCKS, LARGE_CHARS = 5_000, 4_000_000
_RUN = re.compile(r"\s+")


def shingles(text: str) -> np.ndarray:
    """A 64-bit hash of each five-character sequence, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) + codes[k : k + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


_NONE = np.uint64(2**64 - 1)


def _minima(parts: list[np.ndarray]) -> np.ndarray:
    """Bin minima of each part's sequences, ``FUNCTIONS`` x ``BANDS`` for each; an empty bin is all ones."""
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out = np.empty((len(parts), FUNCTIONS, BANDS), np.uint64)
    for f in range(FUNCTIONS):
        x = values * np.uint64(0xD6E8FEB86659FD93 + 2 * f * 0x632BE59BD9B4E019 & 2**64 - 1 | 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        low = np.full(len(parts) * BANDS, _NONE)
        np.minimum.at(low, row * BANDS + (x % np.uint64(BANDS)).astype(np.int64), x)
        out[:, f] = low.reshape(len(parts), BANDS)
    return out


def _filled(minima: np.ndarray) -> np.ndarray:
    """The signatures: an empty bin borrows from the next full one."""
    out = minima.copy()
    for i, f in zip(*np.nonzero((out == _NONE).any(axis=2))):
        low = out[i, f]
        full = np.flatnonzero(low != _NONE)
        if len(full):
            at = np.arange(BANDS)
            nearest = full[np.searchsorted(full, at) % len(full)]
            out[i, f] = low[nearest] + np.uint64(0x9E3779B97F4A7C15) * ((nearest - at) % BANDS).astype(np.uint64)
    return out


def _weight(values: np.ndarray) -> int:
    """The sum of a text's sequences, for its class: it adds up over parts."""
    return int(values.sum(dtype=np.uint64))


def _class(weight: int, count: int) -> int:
    return xxhash.xxh3_64_intdigest((weight % 2**64).to_bytes(8) + count.to_bytes(8)) - 2**63


def _keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each text."""
    key = np.zeros(signature[:, 0].shape, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for f in range(FUNCTIONS):
        key = (key ^ signature[:, f]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _fingerprints(signature: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each text, as bytes: one bit of each of the first bins."""
    flat = signature.reshape(len(signature), -1)[:, :BITS]
    return np.packbits(((flat >> np.uint64(40)) & np.uint64(1)).astype(np.uint8), axis=1)


def _own(blocks: DataFrame) -> DataFrame:
    """The blocks whose text counts, with their place in the document."""
    own = blocks.where("block_type is distinct from 'table_cell' and text is not null and document_id is not null")
    return own.select("document_id", F.coalesce("reading_order", F.lit(-1)).alias("reading_order"), F.coalesce("block_id", F.lit("")).alias("block_id"), "text")


def large_documents(blocks: DataFrame) -> DataFrame:
    """The document_id of each document over ``LARGE_BLOCKS`` or ``LARGE_CHARS``."""
    sizes = _own(blocks).groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return sizes.where((F.col("n") > LARGE_BLOCKS) | (F.col("chars") > LARGE_CHARS)).select("document_id")


def document_texts(blocks: DataFrame, large: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(document_id, text)`` of all documents but the large ones: blocks other than table cells, in reading order, joined by line feeds.

    A block counts once.
    """
    own = _own(blocks).join(large, "document_id", "left_anti")
    if only is not None:
        own = own.join(only, "document_id", "left_semi")
    pieces = F.array_sort(F.collect_set(F.struct("reading_order", "block_id", "text")))  # within the bounds of a large one
    return own.groupBy("document_id").agg(F.array_join(F.transform(pieces, lambda b: b["text"]), "\n").alias("text"))


_SKETCH = "document_id string, class long, keys array<long>, print binary"


def _rows(ids: list[str], marks: list[int], minima: np.ndarray) -> pa.RecordBatch:
    signature = _filled(minima)
    keys, prints = _keys(signature), _fingerprints(signature)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, np.int32)), pa.array(keys.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(marks, pa.int64()), lists, pa.array([p.tobytes() for p in prints], pa.binary())],
        ["document_id", "class", "keys", "print"],
    )


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(ids: list[str], parts: list[np.ndarray]) -> pa.RecordBatch:
        return _rows(ids, [_class(_weight(p), len(p)) for p in parts], _minima(parts))

    for batch in batches:
        ids, parts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = shingles(_RUN.sub(" ", text))
            if not len(found):
                continue
            ids.append(key)
            parts.append(found)
            size += len(found)
            if size >= GROUP_CHARS:
                yield done(ids, parts)
                ids, parts, size = [], [], 0
        if ids:
            yield done(ids, parts)


def _sorted_blocks(blocks: DataFrame, large: DataFrame) -> DataFrame:
    """The large documents' distinct blocks, sorted over all tasks."""
    order = "document_id", "reading_order", "block_id", "text"
    return _own(blocks).join(large, "document_id", "left_semi").distinct().repartitionByRange(*order).sortWithinPartitions(*order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, str]]:
    """``(place, document, text)`` of runs of one document's sorted blocks, of about ``GROUP_CHARS`` characters."""
    first, head, texts, size = None, None, [], 0
    for batch in batches:
        for key, place, block, text in zip(*(c.to_pylist() for c in batch.columns)):
            if texts and (key != head or size >= GROUP_CHARS):
                yield first, head, _RUN.sub(" ", "\n".join(texts))
                texts, size = [], 0
            if not texts:
                first, head = (place, block), key
            texts.append(text)
            size += len(text)
    if texts:
        yield first, head, _RUN.sub(" ", "\n".join(texts))


_PARTS = "document_id string, place int, block string, lead boolean, trail boolean, head string, tail string, values array<long>"


def _parts(keep_values: bool):
    """Parts of large documents: their ends, and their sequences or (else) minima, weight and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place, block), key, text in _runs(batches):
            core = text.strip(" ")
            found = shingles(core)
            if keep_values:
                values = np.unique(found)
            else:
                values = np.concatenate([_minima([found]).ravel(), np.array([_weight(found), len(found)], np.uint64)])
            row = [key], [place], [block], [text[:1] == " "], [text[-1:] == " "], [core[: WIDTH - 1]], [core[1 - WIDTH :]], [values.view(np.int64)]
            yield pa.RecordBatch.from_pydict(dict(zip((c.split()[0] for c in _PARTS.split(", ")), row)), pa.schema([
                ("document_id", pa.string()), ("place", pa.int32()), ("block", pa.string()), ("lead", pa.bool_()), ("trail", pa.bool_()),
                ("head", pa.string()), ("tail", pa.string()), ("values", pa.list_(pa.int64())),
            ]))

    return run


def _bridges(frame: pd.DataFrame) -> np.ndarray:
    """The sequences that reach over the ends of a large document's parts."""
    found, last, space = [], "", False
    for lead, trail, head, tail in frame[["lead", "trail", "head", "tail"]].itertuples(index=False):
        gap = " " if last or lead or space else ""
        if not head:  # white space only
            space = True
            continue
        if gap:
            found.append(shingles(last + " " + head))
        last, space = (last + gap + tail if len(tail) < WIDTH - 1 else tail)[1 - WIDTH :], trail
    if space:
        found.append(shingles(last + " "))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One large document's sketch from its parts; a document has as many parts as ``GROUP_CHARS`` fit its text."""
    frame = frame.sort_values(["place", "block"], kind="stable")
    values = np.stack(frame["values"].to_list()).view(np.uint64)
    bridges = _bridges(frame)
    parts = values[:, :-2].reshape(-1, FUNCTIONS, BANDS)
    minima = np.concatenate([parts, _minima([bridges])]).min(axis=0, keepdims=True)
    weight = (int(values[:, -2].sum(dtype=np.uint64)) + _weight(bridges)) % 2**64
    count = int(values[:, -1].sum()) + len(bridges)
    if not count:
        return pd.DataFrame([], columns=["document_id", "class", "keys", "print"])
    made = _rows([frame["document_id"].iloc[0]], [_class(weight, count)], minima)
    return made.to_pandas()


def _sketches(blocks: DataFrame, large: DataFrame, some: bool) -> DataFrame:
    small = document_texts(blocks, large).mapInArrow(_sketch, _SKETCH)
    if not some:
        return small
    parts = _sorted_blocks(blocks, large).mapInArrow(_parts(False), _PARTS)
    return small.unionByName(parts.groupBy("document_id").applyInPandas(_merged, _SKETCH))


def _sequences(blocks: DataFrame, large: DataFrame) -> DataFrame:
    """``(class, value)``: the distinct sequences of large documents, for ``large`` with its ``class``."""
    parts = materialize(_sorted_blocks(blocks, large.select("document_id")).mapInArrow(_parts(True), _PARTS))

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        found = _bridges(frame.sort_values(["place", "block"], kind="stable"))
        return pd.DataFrame({"document_id": frame["document_id"].iloc[0], "value": np.unique(found).view(np.int64)})

    inside = parts.select("document_id", F.explode("values").alias("value"))
    across = parts.drop("values").groupBy("document_id").applyInPandas(ends, "document_id string, value long")
    return inside.unionByName(across).distinct().join(large, "document_id").select("class", "value")


class BKTree:
    """Fingerprints as integers; children keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, list[int], dict[int, int]]] = []

    def add(self, value: int, item: int) -> None:
        if not self.nodes:
            self.nodes.append((value, [item], {}))
            return
        at = 0
        while True:
            own, items, children = self.nodes[at]
            distance = (own ^ value).bit_count()
            if distance == 0:
                items.append(item)
                return
            if distance not in children:
                children[distance] = len(self.nodes)
                self.nodes.append((value, [item], {}))
                return
            at = children[distance]

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.nodes else []
        while stack:
            own, items, children = self.nodes[stack.pop()]
            distance = (own ^ value).bit_count()
            if distance <= radius:
                yield from items
            stack += [child for edge, child in children.items() if distance - radius <= edge <= distance + radius]


def _bucket_pairs(rows: list[tuple[int, int, int, bytes]], one: int, other: int) -> set[tuple[int, int]]:
    """Pairs of classes within the radius, of one bucket's block pair."""
    tree, found = BKTree(), set()
    for _, mark, block, raw in rows:
        if block == one:
            tree.add(int.from_bytes(raw), mark)
    for _, mark, block, raw in rows:
        if block == other:
            found.update((min(mark, near), max(mark, near)) for near in tree.within(int.from_bytes(raw), RADIUS) if near != mark)
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each run of rows of one bucket and block pair; a run may reach over batches."""

    def out(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*sorted(pairs)) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    run, head, found = [], None, set()
    for batch in batches:
        for key, one, other, mark, block, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if head != (key, one, other):
                if head is not None and len(run) > 1:
                    found |= _bucket_pairs(run, head[1], head[2])
                run, head = [], (key, one, other)
            run.append((key, mark, block, raw))
        yield out(found)
        found = set()
    if len(run) > 1:
        found |= _bucket_pairs(run, head[1], head[2])
    yield out(found)


@lru_cache(maxsize=256)
def _set_of(text: str) -> np.ndarray:
    return np.unique(shingles(_RUN.sub(" ", text)))


def likeness(one: str, other: str) -> float:
    """The Jaccard measure of two texts' five-character sequences; 0 if there are none."""
    a, b = _set_of(one), _set_of(other)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 0.0


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        alike = [likeness(x, y) for x, y in zip(frame["text_a"], frame["text_b"])]
        yield frame[["a", "b"]].assign(likeness=np.array(alike, np.float64))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a broadcast side if it was counted to be small, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _measured_large(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``(a, b, likeness)`` of pairs of classes by a join of their sequences ``(class, value)``."""
    sizes = values.groupBy("class").agg(F.count("*").alias("n"))
    left = pairs.join(values.withColumnRenamed("class", "a"), "a")
    both = left.join(values.withColumnRenamed("class", "b"), ["b", "value"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    full = both.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("class").alias("b"), F.col("n").alias("n_b")), "b")
    return full.select("a", "b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("likeness"))


def links(blocks: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members ``(document_id, class)`` and links ``(a, b, likeness)`` between classes of different texts."""
    large = materialize(large_documents(blocks))
    n_large = large.count()
    large = _bounded(large, n_large)
    sketched = materialize(_sketches(blocks, large, n_large > 0))
    members = sketched.select("document_id", "class")
    classes = sketched.groupBy("class").agg(F.min("document_id").alias("document_id"))
    leaders = sketched.join(classes, ["class", "document_id"], "left_semi")
    rows = leaders.select("class", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / SHARD).cast("int"))
    placed = met.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    spread = placed.select(
        "key", "class", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    ).select("key", "class", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"))
    prints = leaders.select("class", "print")
    ready = spread.join(prints, "class")
    runs = ready.select("key", "one", "other", "class", "block", "print").repartition("key", "one", "other")
    found = materialize(runs.sortWithinPartitions("key", "one", "other").mapInArrow(_search, "a long, b long").distinct())
    ends = found.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class")
    ends = materialize(ends)
    some = ends.count()
    texts = document_texts(blocks, large, _bounded(ends.select("document_id"), some)).join(_bounded(ends, some), "document_id")
    texts = materialize(texts.select("class", "text"))
    pairs = (
        found.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
        .sortWithinPartitions("a")
    )
    measured = pairs.mapInPandas(_measure, "a long, b long, likeness double")
    if n_large:
        # A pair with a large document is measured without assembling either of the two.
        heavy = ends.join(large, "document_id", "left_semi").select("class")
        wide = found.join(heavy.withColumnRenamed("class", "a"), "a", "left_semi").union(found.join(heavy.withColumnRenamed("class", "b"), "b", "left_semi").select("a", "b")).distinct()
        wide = materialize(wide)
        concerned = wide.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(ends, "class")
        measured = measured.unionByName(_measured_large(wide, materialize(_sequences(blocks, concerned))))
    return members, materialize(measured.where(F.col("likeness") >= threshold))


def alike_pairs(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(document_id_a, document_id_b)`` of documents at least ``threshold`` alike.

    Texts under five characters and documents without text are alike to none; a block
    that stands twice counts once; an empty table gives no pairs.
    """
    members, linked = links(blocks, threshold)
    x, y = members.select(F.col("document_id").alias("x"), F.col("class").alias("a")), members.select(F.col("document_id").alias("y"), F.col("class").alias("b"))
    copies = spread_join(x, y.withColumnRenamed("b", "a"), ["a"], "y").where("x < y").select("x", "y")
    across = spread_join(spread_join(linked.select("a", "b"), x, ["a"], "x"), y, ["b"], "y").select("x", "y")
    pairs = copies.unionByName(across)
    return pairs.select(F.least("x", "y").alias("document_id_a"), F.greatest("x", "y").alias("document_id_b")).distinct()


def groups(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(document_id, group_id, copies, links)``, a row for each document of ``blocks``.

    A document without text, or with under five characters, is a group of its own. ``group_id`` is the smallest document_id that links lead to, ``copies`` the number of
    documents of the same text, ``links`` the number of different texts it is alike to.
    Groups grow by alternating steps of large and small stars, each materialised.
    """
    members, linked = links(blocks, threshold)
    sizes = members.groupBy("class").agg(F.min("document_id").alias("leader"), F.count("*").alias("copies"))
    names = sizes.select("class", "leader")
    both = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "class")
    named = linked.join(names.select(F.col("class").alias("a"), F.col("leader").alias("u")), "a").join(
        names.select(F.col("class").alias("b"), F.col("leader").alias("v")), "b"
    )
    edges, before = materialize(named.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        edges = materialize(
            small.select(F.col("m").alias("u"), "v").unionByName(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        )
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    top = edges.groupBy(F.col("v").alias("leader")).agg(F.min("u").alias("group_id"))
    full = members.join(sizes, "class").join(top, "leader", "left").join(degree, "class", "left")
    everyone = blocks.where("document_id is not null").select("document_id").distinct()
    return everyone.join(full, "document_id", "left").select(
        "document_id", F.coalesce("group_id", "leader", "document_id").alias("group_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
