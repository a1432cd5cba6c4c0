"""Texts that were read with the wrong encoding, found and restored.

A damaged span becomes a byte lattice under each pair of wrong and right encoding: a
character gives its bytes in the wrong one, a replacement character a byte that may be
anything (or the two that a UTF-8 reader skips at once). Viterbi search over the lattice
finds the reading that the corpus makes most likely: syllable pairs inside, with every
syllable of the corpus as a state, and at the beginning whole words, found by their known
bytes with wildcards for the lost ones. Pair frequencies are counted over all words of
the corpus, the table of words is its ``VOCABULARY`` most frequent ones. Text that was
encoded wrongly several times is read again until nothing changes.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.session import materialize

VOCABULARY = 50_000
UNSEEN = -9.0
LOST = "\ufffd"
FAR = -14.0
MOST_LOST = {"utf-8": 0.75, "cp949": 0.6}
SURE = -4.5
# Fixed values: (wrong, right) encodings of the noisy channel.
CHANNELS = (("cp949", "utf-8"), ("gbk", "utf-8"), ("cp932", "cp949"), ("utf-8", "cp949"), ("cp932", "utf-8"), ("gbk", "cp949"), ("big5", "utf-8"), ("western", "utf-8"), ("western", "cp949"))


def _one_byte() -> dict[str, int]:
    """Characters that single bytes over 0x7f show as in the western one-byte encodings."""
    table = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            table[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return table


ONE_BYTE = _one_byte()
_HIGH = re.compile("[" + "".join(map(re.escape, ONE_BYTE)) + "]{2,}")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_FOREIGN = re.compile(r"[\u3400-\u9fff\ue000-\ufaff\uff61-\uff9f\ufffd]")
_RUN = re.compile(r"[^\x00-\x7f\s]+")
_LOST_RUN = re.compile("[" + "".join(map(re.escape, ONE_BYTE)) + "\ufffd]+")
#: Question marks that follow no word stand for lost syllables.
_ASKED = re.compile(r"(?<![\w\]\[)?!.,”’\"'])\?{2,}")
#: What a text must hold to be looked at: a character outside those of sound Korean and English text.
SUSPECT = r"[\x{80}-\x{b6}\x{b8}-\x{24f}\x{370}-\x{52f}\x{590}-\x{10ff}\x{20ac}\x{2122}\x{3400}-\x{9fff}\x{e000}-\x{faff}\x{ff61}-\x{ff9f}\x{fffd}]|[?]{2}"


class Language:
    """Log-probabilities of syllable pairs and words from their counts."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int] | None = None) -> None:
        if pairs is None:
            pairs = Counter()
            for word, n in counts.items():
                for a, b in zip("^" + word, word + "$"):
                    pairs[a, b] += n
        single: Counter[str] = Counter()
        for (a, _), n in pairs.items():
            single[a] += n
        size = len(single) + 1
        self.syllables = sorted(s for s in single if s != "^")
        self.id = {s: n for n, s in enumerate(self.syllables)} | {"^": len(self.syllables)}
        #: The state of whatever is no syllable of the corpus; nothing is known to follow it.
        self.other = len(self.syllables) + 1
        self.states = self.other + 1
        log = lambda a, n: math.log((n + 0.01) / (single[a] + 0.01 * size))
        known = {(self.id[a], self.id[b]): log(a, n) for (a, b), n in pairs.items() if b != "$"}
        self.pair = {a * self.states + b: p for (a, b), p in known.items()}
        self.end = np.full(self.states, FAR)
        for (a, b), n in pairs.items():
            if b == "$":
                self.end[self.id[a]] = log(a, n)
        # The pairs again, by their second syllable, for steps to many syllables at once.
        entries = sorted((b, a, p) for (a, b), p in known.items())
        self.before = np.array([e[1] for e in entries], np.int64)
        self.weight = np.array([e[2] for e in entries])
        self.first = np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(len(self.syllables) + 1))
        total = sum(counts.values()) or 1
        self.words = sorted((w for w in counts if all(c in self.id for c in w)), key=lambda w: (len(w), w))
        self.word = {w: math.log(counts[w] / total) + 18.0 for w in self.words}
        self._bytes: dict[str, np.ndarray] = {}
        self.by: dict[str, dict[tuple, np.ndarray]] = {}
        self.spelled: dict[str, dict[int, tuple[np.ndarray, ...]]] = {}
        for code, width in (("utf-8", 3), ("cp949", 2)):
            table: dict[tuple, list[int]] = defaultdict(list)
            for n, s in enumerate(self.syllables):
                raw = s.encode(code, "ignore")
                for mask in range(1, 1 << len(raw)):  # bit set: that byte is lost
                    table[tuple(None if mask >> i & 1 else b for i, b in enumerate(raw))].append(n)
            self.by[code] = {k: np.array(v) for k, v in table.items() if len(k) == width}
            lengths: dict[int, list[int]] = defaultdict(list)
            for n, w in enumerate(self.words):
                lengths[len(w)].append(n)
            self.spelled[code] = {}
            for size_of, numbers in lengths.items():
                texts = [self.words[n] for n in numbers]
                kept = [(n, t, r) for n, t in zip(numbers, texts) if len(r := t.encode(code, "ignore")) == width * size_of]
                if kept:
                    self.spelled[code][size_of] = (
                        np.array([k[0] for k in kept]), np.frombuffer(b"".join(k[2] for k in kept), np.uint8).reshape(len(kept), -1),
                        np.array([self.id[k[1][-1]] for k in kept]), np.array([self.likelihood(k[1]) * len(k[1]) for k in kept]), np.array([self.word[k[1]] for k in kept]),
                    )

    def by_byte(self, code: str) -> np.ndarray:
        """The bytes of each syllable; zeros where the encoding has none."""
        if code not in self._bytes:
            width = 3 if code == "utf-8" else 2
            self._bytes[code] = np.frombuffer(b"".join(s.encode(code, "ignore").ljust(width, b"\0")[:width] for s in self.syllables), np.uint8).reshape(-1, width)
        return self._bytes[code]

    def step(self, before: str, after: str) -> float:
        b = self.id.get(after)
        if b is None:
            return FAR
        return self.pair.get(self.id.get(before, self.other) * self.states + b, UNSEEN)

    def likelihood(self, text: str) -> float:
        """Mean log-probability of a syllable; ``FAR`` for what the corpus never holds."""
        return sum(map(self.step, "^" + text[:-1], text)) / max(1, len(text))

    def score(self, text: str) -> float:
        """What :func:`viterbi` gives a text without lost bytes."""
        total = sum(self.step(a, b) if "가" <= b <= "힣" else _foreign_cost(b) for a, b in zip("^" + text[:-1], text))
        beginning = max((self.word.get(text[:n], 0.0) * n for n in range(1, len(text) + 1)), default=0.0) / max(1, len(text))
        return total + 0.5 * float(self.end[self.id.get(text[-1:], self.other)]) + beginning

    def steps(self, ids: np.ndarray, scores: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best score of a step from any of the states ``ids`` to each of ``targets``, and the state it comes from."""
        at = int(np.argmax(scores))
        if len(ids) * len(targets) <= 48:
            best, source = [], []
            for b in targets.tolist():
                found = max(((s + self.pair.get(a * self.states + b, UNSEEN), a) for a, s in zip(ids.tolist(), scores.tolist())))
                best.append(found[0])
                source.append(found[1])
            return np.array(best), np.array(source)
        dense = np.full(self.states, -np.inf)
        dense[ids] = scores
        begin, count = self.first[targets], self.first[targets + 1] - self.first[targets]
        offset = np.cumsum(count) - count
        flat = np.arange(count.sum()) - np.repeat(offset, count) + np.repeat(begin, count)
        values = dense[self.before[flat]] + self.weight[flat]
        top = np.maximum.reduceat(values, offset)
        hits = np.flatnonzero(values == np.repeat(top, count))
        _, one = np.unique(np.searchsorted(offset, hits, "right"), return_index=True)
        source = self.before[flat[hits[one]]]
        plain = scores[at] + UNSEEN
        return np.maximum(top, plain), np.where(top >= plain, source, ids[at])


def _foreign_cost(char: str) -> float:
    return -9.0 if char < "\x80" else -5.0 if "\u4e00" <= char <= "\u9fff" else -7.0


def lattice(span: str, wrong: str) -> list[int | None] | None:
    """The span's bytes in the wrong encoding, None for a lost one; None if it can't be written in it."""
    out: list[int | None] = []
    for char in span:
        if char == LOST:
            out.append(None)
        elif wrong == "western":
            if char not in ONE_BYTE:
                return None
            out.append(ONE_BYTE[char])
        else:
            try:
                out += char.encode(wrong)
            except UnicodeEncodeError:
                return None
    return out


def _edges(raw: list[int | None], doubled: bool) -> dict[int, list[tuple[int, int | None, int]]]:
    """Steps ``(next node, byte, class)`` of the lattice; place i is node 2i. A lost character is one byte of any
    class (0) or, if ``doubled``, a UTF-8 lead (1) and a following byte (2) over the odd node between."""
    edges: dict[int, list[tuple[int, int | None, int]]] = {}
    for at, byte in enumerate(raw):
        edges[2 * at] = [(2 * at + 2, byte, 0)]
        if byte is None and doubled:
            edges[2 * at].append((2 * at + 1, None, 1))
            edges[2 * at + 1] = [(2 * at + 2, None, 2)]
    return edges


_CLASSES = {1: (0xE0, 0xF4), 2: (0x80, 0xBF)}


def viterbi(raw: list[int | None], right: str, language: Language, doubled: bool = False) -> tuple[float, str]:
    """The best reading of the lattice and its score; bytes that nothing fits stay lost.

    Each node holds the best score of every state that reaches it: the last syllable, or
    that there is none. Nothing is pruned.
    """
    width, last = 3 if right == "utf-8" else 2, 2 * len(raw)
    edges = _edges(raw, doubled)
    length = max(1, -(-len(raw) // width))
    arrived: dict[int, list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]] = defaultdict(list)
    pieces: list[str] = []
    start, none = language.id["^"], np.array([-1])

    def arrive(node: int, ids: np.ndarray, scores: np.ndarray, source: int, before: np.ndarray, mark: np.ndarray) -> None:
        arrived[node].append((ids, scores, source, before, mark))

    arrive(0, np.array([start]), np.zeros(1), -1, none, none)
    for size, (numbers, spelled, final, inner, weight) in language.spelled[right].items():  # words at the beginning
        if size * width <= len(raw):
            known = [i for i in range(size * width) if raw[i] is not None]
            rows = np.flatnonzero((spelled[:, known] == np.array([raw[i] for i in known], np.uint8)).all(axis=1))
            if len(rows):
                arrive(2 * size * width, final[rows], inner[rows] + weight[rows] * size / length, -1, np.full(len(rows), start), -2 - numbers[rows])

    held: dict[int, tuple[np.ndarray, ...]] = {}

    def paths(node: int, steps: int) -> Iterator[tuple[int, tuple[int | None, ...], tuple[int, ...]]]:
        if steps == 0:
            yield node, (), ()
            return
        for following, byte, kind in edges.get(node, ()):
            for end, more, kinds in paths(following, steps - 1):
                yield end, (byte, *more), (kind, *kinds)

    for node in range(last + 1):
        if node not in arrived:
            continue
        parts = arrived.pop(node)
        ids = np.concatenate([p[0] for p in parts])
        scores = np.concatenate([p[1] for p in parts])
        sources = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
        before, marks = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        if len(ids) > 1:
            order = np.lexsort((-scores, ids))
            order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
            ids, scores, sources, before, marks = ids[order], scores[order], sources[order], before[order], marks[order]
        held[node] = (ids, scores, sources, before, marks)
        if node == last:
            break
        at = int(np.argmax(scores))
        plain, origin = scores[at], np.array([ids[at]])

        def other(end: int, cost: float, char: str) -> None:
            pieces.append(char)
            arrive(end, np.array([language.other]), np.array([plain + cost]), node, origin, np.array([len(pieces) - 1]))

        if node % 2 == 0:
            other(node + 2, FAR + (2.0 if raw[node // 2] is None else 0.0), LOST)
        for size in range(1, width + 1):
            for end, part, kinds in paths(node, size):
                if None not in part:
                    try:
                        char = bytes(part).decode(right)
                    except UnicodeDecodeError:
                        continue
                    if len(char) != 1 or (size == 1 and part[0] >= 0x80):
                        continue
                    if "가" <= char <= "힣" and char in language.id:
                        targets = np.array([language.id[char]])
                    else:
                        other(end, FAR if "가" <= char <= "힣" else _foreign_cost(char), char)
                        continue
                elif size == width and part in language.by[right]:
                    targets = language.by[right][part]
                    for place, kind in enumerate(kinds):
                        if kind:
                            low, high = _CLASSES[kind]
                            spelled_bytes = language.by_byte(right)[targets, place]
                            targets = targets[(spelled_bytes >= low) & (spelled_bytes <= high)]
                    if not len(targets):
                        continue
                else:
                    continue
                best, source = language.steps(ids, scores, targets)
                arrive(end, targets, best, node, source, np.full(len(targets), -1))
    if last not in held:
        return FAR * max(1, len(raw)), ""
    ids, scores = held[last][0], held[last][1]
    ends = scores + 0.5 * language.end[ids]
    at = int(np.argmax(ends))
    out, node, state = [], last, int(ids[at])
    while node > 0:
        own, _, sources, before, marks = held[node]
        row = int(np.searchsorted(own, state)) if len(own) > 1 else 0
        mark = int(marks[row])
        if mark <= -2:
            out.append(language.words[-2 - mark])
            break
        out.append(language.syllables[state] if mark == -1 else pieces[mark])
        node, state = int(sources[row]), int(before[row])
    return float(ends[at]), "".join(reversed(out))


def _western(text: str, language: Language) -> str:
    """Runs of one-byte characters read again: as UTF-8 where the bytes are its sequences, else as Korean."""
    runs = [(m.start(), bytes(ONE_BYTE[c] for c in m[0])) for m in _HIGH.finditer(text)]
    if not runs:
        return text
    as_utf8 = sum(len(m[0]) for _, raw in runs for m in _SEQUENCE.finditer(raw))
    korean: dict[int, str] = {}
    for at, raw in runs:
        try:
            read = raw.decode("euc_kr")
        except UnicodeDecodeError:
            continue
        if sum("가" <= c <= "힣" or "\u4e00" <= c <= "\u9fff" for c in read) * 2 > len(read):
            korean[at] = read
    as_korean = sum(2 * len(k) for k in korean.values())
    out, last = [], 0
    take_korean = as_korean > as_utf8 and as_korean >= 4 and language.likelihood("".join(korean.values())) > -7.5
    for at, raw in runs:
        if take_korean:
            if at not in korean:
                continue
            read = korean[at]
        else:
            pieces, done = [], 0
            for m in _SEQUENCE.finditer(raw):
                try:
                    char = m[0].decode()
                except UnicodeDecodeError:
                    continue
                pieces += [text[at + done : at + m.start()], char]
                done = m.end()
            if not pieces:
                continue
            read = "".join(pieces) + text[at + done : at + len(raw)]
        out += [text[last:at], read]
        last = at + len(raw)
    return "".join(out) + text[last:]


@lru_cache(maxsize=50_000)
def _span(span: str, language: Language) -> tuple[str, str] | None:
    """``(reading, channel)`` of a span of non-ASCII characters, or None if it is better left."""
    best: tuple[float, str, str] | None = None
    for wrong, right in CHANNELS:
        raw = lattice(span, wrong)
        if raw is None or raw.count(None) > MOST_LOST[right] * len(raw):
            continue
        try:
            read = None if None in raw else bytes(raw).decode(right)
        except UnicodeDecodeError:
            read = None
        if read:
            score = language.score(read)
        else:
            score, read = viterbi(raw, right, language, doubled=wrong == "utf-8")
        if read and (best is None or score / len(read) > best[0]):
            best = (score / len(read), read, f"{wrong}>{right}")
    if best is None or best[1] == span:
        return None
    lost = best[1].count(LOST)
    if lost * 2 > len(best[1]) or lost >= span.count(LOST) > 0:
        return None
    sure = len(best[1]) > 1 and all("가" <= c <= "힣" for c in best[1]) and language.likelihood(best[1]) > SURE
    if LOST not in span and not sure:
        return None
    return best[1], best[2]


def _with_lost(text: str, language: Language) -> str:
    """Runs of one-byte characters with lost bytes among them, read again through the lattice."""

    def read(match: re.Match) -> str:
        span = match[0]
        if LOST not in span or span.count(LOST) == len(span):
            return span
        found = _span(span, language)
        return span if found is None else found[0]

    return _LOST_RUN.sub(read, text)


def _foreign(text: str, language: Language) -> str:
    def read(match: re.Match) -> str:
        found = _span(match[0], language) if _FOREIGN.search(match[0]) else None
        return match[0] if found is None else found[0]

    return _RUN.sub(read, text)


def restore(text: str, language: Language) -> tuple[str, bool]:
    """The text with its damaged spans restored as far as possible, and whether it was damaged.

    Runs of question marks that follow no word are lost syllables: they are damage and stay.
    """
    damaged = LOST in text or _ASKED.search(text) is not None
    before, seen = text, {text}
    while True:
        read = _foreign(_western(_with_lost(before, language), language), language)
        if read in seen:
            break
        seen.add(read)
        before = read
    return before, damaged or before != text


def word_counts(blocks: DataFrame, words: int = VOCABULARY) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """The corpus' most frequent words of Hangul with their counts over all blocks, and the counts of all its syllable pairs.

    "^" and "$" stand for a word's two ends; the pairs are at most the square of the syllables in use.
    """
    each = blocks.select(F.explode(F.split("text", "[^가-힣]+", -1)).alias("word")).where("word <> ''")
    counted = materialize(each.groupBy("word").count())
    top = counted.where("count > 1").orderBy(F.desc("count"), "word").limit(words)
    ended = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    two = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda n: F.substring(ended, n, F.lit(2)))
    pairs = counted.select("count", F.explode(two).alias("pair")).groupBy("pair").agg(F.sum("count").alias("n"))
    return {r["word"]: r["count"] for r in top.collect()}, {(r["pair"][0], r["pair"][1]): r["n"] for r in pairs.collect()}  # bounded tables


def restored_blocks(blocks: DataFrame, counts: dict[str, int], pairs: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """``(block_id, restored, complete)`` of each block whose text was damaged, in part or as a whole.

    ``complete`` tells that no lost character is left. Null and empty texts and sound
    blocks are in no row; rows that appear twice count once; other columns are not read.
    """
    own = blocks.where(F.col("text").rlike(SUSPECT)).select("block_id", "text").dropDuplicates()
    shared = blocks.sparkSession.sparkContext.broadcast((counts, pairs))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language = Language(*shared.value)
        for frame in frames:
            rows = []
            for key, text in zip(frame["block_id"], frame["text"]):
                restored, damaged = restore(text, language)
                if damaged:
                    rows.append((key, restored, LOST not in restored and _ASKED.search(restored) is None))
            yield pd.DataFrame(rows, columns=["block_id", "restored", "complete"])

    return own.mapInPandas(run, "block_id string, restored string, complete boolean")
