"""Oversized items cut into pieces at natural boundaries, with an overlap.

A text's atoms are its paragraphs, lines and sentences; a sentence over the room goes
into words, a word over it into characters. Adjacent atoms lie in a heap by the
strength of the boundary between them: the weakest boundaries merge first, the smaller
result first among equals, while the merged size and the overlap fit the limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1_800
OVERLAP = 250
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_ENDS = (
    (PARAGRAPH, re.compile(r"\n[ \t]*\n\s*")),
    (LINE, re.compile(r"\n+")),
    (SENTENCE, re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+")),
    (WORD, re.compile(r"\s+")),
)


def _atoms(text: str, begin: int, end: int, room: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """``(end, strength of the boundary there)`` of the atoms in ``text[begin:end]``."""
    if level == len(_ENDS):
        for at in range(begin + room, end, room):
            yield at, CHARACTER
        return
    strength, pattern = _ENDS[level]
    if strength == WORD and end - begin <= room:
        return
    last = begin
    for match in pattern.finditer(text, begin, end):
        if last < match.end() < end:
            yield from _atoms(text, last, match.end(), room, level + 1)
            yield match.end(), strength
            last = match.end()
    yield from _atoms(text, last, end, room, level + 1)


def cores(text: str, room: int) -> list[tuple[int, int]]:
    """Spans of at most ``room`` characters that make up the text."""
    marks = [*_atoms(text, 0, len(text), room), (len(text), PARAGRAPH + 1)]
    ends = [at for at, _ in marks]
    begins = [0, *ends[:-1]]
    strength = [s for _, s in marks]
    following, previous = list(range(1, len(ends) + 1)), list(range(-1, len(ends) - 1))
    alive = [True] * len(ends)
    heap = []

    def offer(i: int) -> None:
        j = following[i]
        if j < len(ends) and (size := ends[j] - begins[i]) <= room:
            heapq.heappush(heap, (strength[i], size, i, j))

    for i in range(len(ends)):
        offer(i)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not alive[i] or following[i] != j or j >= len(ends) or ends[j] - begins[i] != size:
            continue
        alive[j] = False
        ends[i], strength[i], following[i] = ends[j], strength[j], following[j]
        if following[i] < len(ends):
            previous[following[i]] = i
        offer(i)
        if previous[i] >= 0:
            offer(previous[i])
    return [(begins[i], ends[i]) for i in range(len(ends)) if alive[i]]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans ``(begin, end)`` of the pieces; each begins about ``overlap`` characters inside the one before."""
    if len(text) <= limit:
        return [(0, len(text))]
    found: list[tuple[int, int]] = []
    for begin, end in cores(text, limit - overlap):
        if found:
            start = max(begin - overlap, found[-1][0] + 1, end - limit, 0)
            word = re.compile(r"\s\S").search(text, start, min(start + overlap // 5, begin))
            begin = start if start == 0 or text[start - 1].isspace() or not word else word.start() + 1
        found.append((begin, end))
    return found


def split_items(df: DataFrame, item: str, text: str, section_path: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces ``(item_id, piece_no, begin, char_count, section_path, text)`` of each item over the limit.

    ``section_path`` (a list, an empty list or null) is repeated on each piece as it is.
    Items of at most ``limit`` characters and null texts have no rows; rows that appear
    twice count once; other columns are not read.
    """
    if overlap * 2 >= limit:
        raise ValueError("the overlap must be under half the limit")
    large = df.where(F.length(text) > limit).select(
        F.col(item).cast("string").alias("item_id"), F.col(section_path).alias("section_path"), F.col(text).alias("text")
    ).dropDuplicates(["item_id", "text"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (key, n, begin, end - begin, path, whole[begin:end])
                for key, path, whole in zip(frame["item_id"], frame["section_path"], frame["text"])
                for n, (begin, end) in enumerate(cut(whole, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["item_id", "piece_no", "begin", "char_count", "section_path", "text"])

    return large.mapInPandas(
        run, "item_id string, piece_no int, begin int, char_count int, section_path array<string>, text string"
    )


def items(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(item_id, section_path, text)`` of blocks other than table cells, and of chunks."""
    own = blocks.where("block_type is distinct from 'table_cell'").select(F.col("block_id").alias("item_id"), "section_path", "text")
    path = F.from_json("section_path_json", "array<string>")
    return own.unionByName(chunks.select(F.col("chunk_id").alias("item_id"), path.alias("section_path"), "text"))
