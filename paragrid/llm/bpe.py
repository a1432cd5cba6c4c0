"""Byte-level BPE in batched numpy merge rounds.

The vocabulary is a public tokenizer's JSON file; its path is a parameter. A text is cut
into units at single spaces, units into pre-tokens by the tokenizer's pattern, and only
pre-tokens that were not met before go through the merge rounds: the symbols of many
words lie in one flat array, each round finds every word's lowest-rank pair by binary
search over the sorted pair keys and merges it. Words over ``LONG_WORD`` bytes take a
heap instead (same result, without a round for each merge). Caches are bounded and
cleared when full, so memory does not follow the corpus.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LONG_WORD = 200
CACHE = 200_000
ROWS = 2_000

# The pre-tokenizer's pattern, white space written out (regex and the tokenizer differ on \x1c-\x1f).
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_characters() -> dict[str, int]:
    """The vocabulary's printable stand-in of each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Pool:
    """Integer sequences end to end, found by number."""

    def __init__(self) -> None:
        self.data = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.empty(1 << 12, np.int64)
        self.size = np.empty(1 << 12, np.int64)
        self.count = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        first, n = self.count, len(sizes)
        if self.used + len(flat) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.used + len(flat)))
        if first + n > len(self.start):
            self.start, self.size = (np.resize(a, 2 * (first + n)) for a in (self.start, self.size))
        self.data[self.used : self.used + len(flat)] = flat
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += n
        return first

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``numbers`` end to end, and their sizes."""
        sizes = self.size[numbers]
        shift = self.start[numbers] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes


class Encoder:
    """Encodes texts by the tokenizer of a JSON vocabulary file, without special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, letters = model["vocab"], _byte_characters()
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self._clear()

    def _clear(self) -> None:
        self.spaced: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.units, self.tokens = _Pool(), _Pool()

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys)).astype(np.int32)

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end, and how many each has."""
        none = len(self.keys)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), none, np.int32)
            inside = word[:-1] == word[1:]
            rank[:-1][inside] = self._pair_ranks(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            each = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            over = each == none
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, each = (a[~over] for a in (symbols, word, rank, each))
                if not len(symbols):
                    break
            hit = rank == each
            run = np.flatnonzero(hit)
            # Of pairs that overlap, every second one merges, from the left.
            fresh = np.r_[True, np.diff(run) != 1]
            begin = np.maximum.accumulate(np.where(fresh, run, 0))
            run = run[(run - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[run] = self.merged[each[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word = np.concatenate([w for w, _ in done])
        order = np.argsort(word, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(word, minlength=len(words))

    def _heap(self, word: bytes) -> np.ndarray:
        symbols = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        get, merged = self.rank_of.get, self.merged
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(merged[r]), -1
            after[i] = k = after[j]
            if k < len(symbols):
                before[k] = i
                if (r := get(symbols[i] << 20 | symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := get(symbols[h] << 20 | symbols[i])) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def _learn_words(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        short = [i for i, w in enumerate(coded) if len(w) <= LONG_WORD]
        if short:
            at = self.tokens.extend(*self._rounds([coded[i] for i in short]))
            self.words.update((words[i], at + n) for n, i in enumerate(short))
        for i, w in enumerate(coded):
            if len(w) > LONG_WORD:
                ids = self._heap(w)
                self.words[words[i]] = self.tokens.extend(ids, np.array([len(ids)]))

    def _learn_units(self, units: list[str], spaced: bool) -> None:
        parts = [_PATTERN.findall(" " + u if spaced else u) for u in units]
        flat = [p for each in parts for p in each]
        self._learn_words(list(set(flat).difference(self.words)))
        numbers = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        ids, sizes = self.tokens.gather(numbers)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(counts)
        total = np.r_[0, np.cumsum(sizes)]
        at = self.units.extend(ids, total[ends] - total[ends - counts])
        (self.spaced if spaced else self.plain).update(zip(units, range(at, at + len(units))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; none for an empty text or None."""
        if len(self.spaced) + len(self.plain) + len(self.words) > CACHE or self.units.used > 20 * CACHE:
            self._clear()
        heads, tails, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            beside = text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text
            if beside or _OTHER_SPACE.search(text):
                units = _CUT.split(text)
                units = units[:1] + [u[1:] for u in units[1:]]
            else:
                units = text.split(" ")
            heads.append(units[0])
            tails += units[1:]
            counts[i] = len(units)
        for units, known, spaced in ((heads, self.plain, False), (tails, self.spaced, True)):
            if fresh := list(set(units).difference(known)):
                self._learn_units(fresh, spaced)
        numbers = np.empty(counts.sum(), np.int64)
        first = (np.cumsum(counts) - counts)[counts > 0]
        head = np.zeros(len(numbers), bool)
        head[first] = True
        numbers[head] = np.fromiter(map(self.plain.__getitem__, heads), np.int64, len(heads))
        numbers[~head] = np.fromiter(map(self.spaced.__getitem__, tails), np.int64, len(tails))
        ids, sizes = self.units.gather(numbers)
        total, ends = np.r_[0, np.cumsum(sizes)], np.cumsum(counts)
        return ids, total[ends] - total[ends - counts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The process's encoder of this vocabulary file."""
    return Encoder(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without its text column, with the text's token ids as a list of integers in ``out``.

    A null or an empty text has an empty list. Other columns, repeated rows and their
    order within a partition stay; a column that is already named ``out`` is replaced.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    shape = df.select(*(F.col(f"`{c}`") for c in keep)).withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for part in _slices(batches):
            ids, sizes = coder.encode(part.column(len(keep)).to_pylist())
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, out])

    return df.select(*(F.col(f"`{c}`") for c in [*keep, text])).mapInArrow(run, shape)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without its text column, with the number of tokens (0 for null and empty texts) in ``out``."""
    keep = [c for c in df.columns if c not in (text, out)]
    shape = df.select(*(F.col(f"`{c}`") for c in keep)).withColumn(out, F.lit(0).cast("int")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for part in _slices(batches):
            _, sizes = coder.encode(part.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(sizes, pa.int32())], [*keep, out])

    return df.select(*(F.col(f"`{c}`") for c in [*keep, text])).mapInArrow(run, shape)
