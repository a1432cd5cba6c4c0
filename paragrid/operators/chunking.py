"""Chunks from blocks and from plain texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1_800, 250
_SHAPE = "document_id string, run long, chunk_index int, char_count int, page_start int, page_end int, section string, block_ids array<string>, text string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in _SHAPE.split(", "))])


def stride_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, trimmed; the last one reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda n: F.trim(F.substring(text, n * step + 1, F.lit(size))))


def _strided(text: str, size: int, overlap: int) -> list[str]:
    out, at = [], 0
    while True:
        if piece := text[at : at + size].strip():
            out.append(piece)
        if at + size >= len(text):
            return out
        at += size - overlap


def _table_parts(text: str, size: int) -> list[str]:
    """Rows packed up to ``size``, each part headed by the first row; a row over it is cut into windows."""
    header, *rows = text.split("\n")
    parts, own = [], [header]
    for row in rows:
        if sum(map(len, own)) + len(own) + len(row) > size and len(own) > 1:
            parts.append("\n".join(own))
            own = [header]
        own.append(row)
    parts.append("\n".join(own))
    return [p for part in parts for p in ([part] if len(part) <= size else _strided(part, size, 0))]


def pack_run(rows: list[tuple], size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple]:
    """Chunks ``(char_count, page_start, page_end, block_ids, text)`` of one section's blocks in order.

    ``rows`` are ``(block_id, block_type, text, page)``. Greedy packing; tables alone;
    oversized text in windows. Table cells and blank texts are left out.
    """
    chunks: list[tuple] = []
    own: list[tuple] = []

    def add(text: str, ids: list[str], pages: list) -> None:
        numbers = [p for p in pages if p is not None]
        chunks.append((len(text), min(numbers, default=None), max(numbers, default=None), ids, text))

    def flush() -> None:
        if own:
            add("\n\n".join(o[1] for o in own), [o[0] for o in own], [o[2] for o in own])
            own.clear()

    for block, kind, text, page in rows:
        if kind == "table_cell" or text is None or not text.strip():
            continue
        if kind == "table" or len(text) > size:
            flush()
            for part in _table_parts(text, size) if kind == "table" else _strided(text, size, overlap):
                add(part, [block], [page])
        else:
            if sum(len(o[1]) + 2 for o in own) + len(text) > size:
                flush()
            own.append((block, text, page))
    flush()
    return chunks


def pack_blocks(blocks: DataFrame, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every document, in the columns of ``_SHAPE``; a block that stands twice counts once.

    Packing starts anew at a section, so a run of blocks of one section is the unit of
    work; runs are numbered by a window that carries ids and places only. Sorted runs
    pass through one Python iterator, so a document of a third of all blocks spreads
    over its sections and small sections cost no call of their own.
    """
    rows = blocks.select(
        "document_id", "block_id", "block_type", "text", "reading_order", "page", F.array_join("section_path", " > ").alias("section")
    ).dropDuplicates(["document_id", "block_id"])
    order = W.partitionBy("document_id").orderBy("reading_order", "block_id")
    heads = rows.select("document_id", "block_id", "section", "reading_order")
    changed = F.when(F.lag("section", 1, "\0").over(order).eqNullSafe(F.col("section")), 0).otherwise(1)
    runs = heads.withColumn("_c", changed).withColumn("run", F.sum("_c").over(order)).select("document_id", "block_id", "run")
    grouped = rows.join(runs, ["document_id", "block_id"]).repartition("document_id", "run")
    sorted_runs = grouped.sortWithinPartitions("document_id", "run", "reading_order", "block_id").select(
        "document_id", "run", "section", "block_id", "block_type", "text", "page"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple]) -> pd.DataFrame:
            made = [
                (head[0], head[1], n, count, first, last, head[2], ids, text)
                for head, held in done
                for n, (count, first, last, ids, text) in enumerate(pack_run(held, size, overlap))
            ]
            frame = pd.DataFrame(made, columns=[c.split()[0] for c in _SHAPE.split(", ")])
            return frame.astype({"page_start": "Int32", "page_end": "Int32"})

        head, held = None, []
        for batch in batches:
            done = []
            for document, run, section, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if head is not None and head[:2] != (document, run):
                    done.append((head, held))
                    held = []
                head = (document, run, section)
                held.append(tuple(row))
            yield pa.RecordBatch.from_pandas(out(done), schema=_ARROW, preserve_index=False)
        yield pa.RecordBatch.from_pandas(out([(head, held)] if head else []), schema=_ARROW, preserve_index=False)

    number = F.row_number().over(W.partitionBy("document_id").orderBy("run", "chunk_index")) - 1
    return sorted_runs.mapInArrow(pack, _SHAPE).withColumn("chunk_index", number.cast("int")).drop("run")
