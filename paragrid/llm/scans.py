"""Noise in text from scanned pages, found and repaired.

Every block is judged by itself: a page number, a hyphen cut and a sure cut are noise in
any document; misread words and numbers count outside scans only beside one of these, as
sound words and codes look like them too often. A document counts as scanned if its parser says
so or its blocks show the marks of a scan; there, cuts need less to be sure and running
headers are looked for too. In detail

* lines are page numbers by their form, and running headers by standing in several
  blocks of the document (digits aside) or by ending like such lines do elsewhere;
* a boosted classifier of line pairs, trained on sound text cut at random places, tells
  words cut at a line end from wrapped lines;
* letters inside numbers are read as the digits they look like;
* words meet more frequent words through inverted joins of gapped q-grams: the word with
  one or two syllables left out, and what two of the three letters of each of these are; a
  boosted ranker, trained on where such words stand, chooses the replacement.

Word counts cover the whole corpus; the ``VOCABULARY`` most frequent words of its sound
part go to all tasks, the counts of all others come with the blocks that ask for them.
"""

from __future__ import annotations

import math
import os
import re
from collections import ChainMap
from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paragrid.llm.boosting import Boosted
from paragrid.llm.unify import IGNORABLE
from paragrid.session import materialize

VOCABULARY = 60_000
TRAINING_BLOCKS = 4_000
TRAINING_PAIRS = 60_000
SURE = 0.5
#: What a cut must reach in a document that shows no scan: ``SURE`` under a prior of 1 to 49.
SURE_ALONE = 0.98
# Digits and the letters that scans show for them.
DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1", "Z": "2", "S": "5", "b": "6", "B": "8"}
# Extensions of image files.
IMAGES = (".tif", ".tiff", ".png", ".jpg", ".jpeg", ".bmp")
# Forms of a page number that is a line of its own.
PAGE_FORMS = r"-\s*\d{1,4}(\s*-)?|[—–]\s*\d{1,4}\s*[—–]|[pP]\.\s*\d{1,4}|\d{1,4}\s*쪽|\[\d{1,4}\]|\d{1,4}"
# What is counted or numbered, right after a number.
COUNTERS = "[명건회점일시학월년개쪽호주조항만원차%]"
_PAGE = re.compile(PAGE_FORMS)
_LETTERS = "".join(DIGIT_LIKE)
_NUMBER = re.compile(rf"(?<![A-Za-z0-9{IGNORABLE}])[0-9{_LETTERS}]+(?![A-Za-z0-9{IGNORABLE}])")
_HANGUL = re.compile("[가-힣]+")
#: Runs of letters; Latin ones beside a digit are parts of codes and no words.
WORD = "[가-힣]+|(?<![0-9A-Za-z])[A-Za-z]+(?![0-9A-Za-z])"
_WORD = re.compile(WORD)
# Letters of Latin print that scans show for others.
LATIN_LIKE = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("c", "e"), ("i", "l"), ("tt", "it"), ("q", "g"))
_ITEM = re.compile(r"\s*([•·○□※\-–*▪■◦]|\(?[0-9가-힣]{1,2}[.)]|[①-⑳]|제\d+[장조])\s")
_NUMBER_MARK = rf"(?<![A-Za-z0-9])[0-9]*[{_LETTERS}][0-9{_LETTERS}]*(?=[가-힣%])"
_MARKS = (r"[가-힣]-\n[가-힣]|[A-Za-z]-\n[a-z]", rf"(?m)^\s*(?:{PAGE_FORMS})\s*$", rf"(?=[0-9{_LETTERS}]*[0-9]){_NUMBER_MARK}")
# A page number that interrupts a sentence: one of these is enough for a document.
_INSIDE = rf"[가-힣A-Za-z0-9,]\s*\n\s*(?:{PAGE_FORMS})\s*\n\s*[가-힣a-z]"
# Without one of these a block outside scans holds no noise.
_JUDGED = "|".join((r"[가-힣A-Za-z]-?\n[가-힣a-z]", _MARKS[1]))


def line_shape(line: Column) -> Column:
    """A line without digits, bars and outer white space; empty if nothing of it is left."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9|]", ""), r"\s+", " "))


def scanned(blocks: DataFrame) -> DataFrame:
    """The document_id of each scanned document: by its parser, or by two marks of a scan in its blocks or a page number inside a sentence."""
    text = F.col("text")
    # Cheap necessary signs stand before the patterns: a line end, few characters, a letter beside a digit.
    cut = F.contains(text, F.lit("\n"))
    signs = cut, cut | (F.length(text) < 16), text.rlike(f"[0-9][{_LETTERS}]|[{_LETTERS}][0-9]")
    mark = sum((F.when(sign, text.rlike(p)).otherwise(False).cast("int") for sign, p in zip(signs, _MARKS)), F.lit(0))
    named = F.lower("parser").contains("ocr").cast("int")
    rows = blocks.where("block_type is distinct from 'table_cell'").groupBy("document_id")
    inside = F.when(cut, text.rlike(_INSIDE)).otherwise(False)
    seen = rows.agg(F.sum(F.coalesce(mark, F.lit(0))).alias("marks"), F.max(named).alias("named"), F.max(inside).alias("inside"), F.count("*").alias("n"))
    return seen.where((F.col("named") == 1) | F.col("inside") | ((F.col("marks") >= 2) & (F.col("marks") * 200 >= F.col("n")))).select("document_id")


def word_list(text: Column) -> Column:
    """The runs of Hangul and of Latin letters of a text, without the parts of codes."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def words(blocks: DataFrame) -> DataFrame:
    """``(word, sound, noisy, edge)``: how often each word stands in blocks of other parsers, and of scans.

    Words at a line end may be parts of words, so they do not count; ``edge`` is how often a scan has the word there.
    """
    own = blocks.where("block_type is distinct from 'table_cell'").select(F.coalesce(F.lower("parser").contains("ocr"), F.lit(False)).alias("scan"), "text")
    # From the start of a word or the last match's end only: a start inside a word finds nothing else. Texts of one line are not searched.
    ends = r"(?:\G|(?<![가-힣A-Za-z]))[가-힣A-Za-z]*+-?\s*\n\s*[가-힣A-Za-z]*"
    inner = F.when(F.contains("text", F.lit("\n")), F.regexp_replace("text", ends, "\n")).otherwise(F.col("text"))
    within = own.select("scan", F.lit(False).alias("end"), F.explode(word_list(inner)).alias("word"))
    cut = own.where(F.col("scan") & F.contains("text", F.lit("\n")))
    beside = cut.select("scan", F.lit(True).alias("end"), F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(ends), F.lit(0)), word_list))).alias("word"))
    count = lambda test: F.count_if(test)
    every = within.unionByName(beside).groupBy("word")
    return every.agg(count(~F.col("scan")).alias("sound"), count(F.col("scan") & ~F.col("end")).alias("noisy"), count(F.col("end")).alias("edge"))


def grams(word: str) -> list[str]:
    """The gapped q-grams that a word shares with all words in which one letter of one or of two syllables is another.

    A syllable left out is marked by two of its three letters and their place. A Latin
    word has the form in which letters that print alike are one.
    """
    if word[:1] < "가":
        shown = word.lower()
        for print_form, meant in LATIN_LIKE:
            shown = shown.replace(print_form, meant)
        return ["#" + shown]
    gaps = []
    for syllable in word:
        a, b, c = _jamo(syllable)
        gaps.append((f"({a}.{b}.)", f"({a}..{c})", f"(.{b}.{c})"))
    found = [word[:i] + g + word[i + 1 :] for i in range(len(word)) for g in gaps[i]]
    if len(word) > 2:
        found += [word[:i] + g + word[i + 1 : j] + h + word[j + 1 :] for i in range(len(word)) for j in range(i + 1, len(word)) for g in gaps[i] for h in gaps[j]]
    return found


def _grammed(counted: DataFrame, *columns: str) -> DataFrame:
    """``counted`` with a row for each 64-bit hash of a word's grams."""
    kinds = dict(counted.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 128):  # a word of n syllables has up to 9 n(n-1)/2 + 3 n grams
                frame = whole.iloc[start : start + 128]
                made = [[xxhash.xxh3_64_intdigest(g) - 2**63 for g in grams(w)] for w in frame[columns[0]]]
                yield frame.iloc[np.repeat(np.arange(len(frame)), [len(m) for m in made])].assign(gram=np.fromiter((h for m in made for h in m), np.int64))

    return counted.select(*columns).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", gram long")


def _jamo(syllable: str) -> tuple[int, int, int]:
    code = ord(syllable) - 0xAC00
    return code // 588, code // 28 % 21, code % 28


def _difference(word: str, other: str) -> tuple[str, int, int, int]:
    """The exchanged syllables, and how many first, middle and last letters of them differ."""
    if word[0] < "가":
        same = len(os.path.commonprefix([word, other])), len(os.path.commonprefix([word[::-1], other[::-1]]))
        tail = min(same[1], len(word) - same[0], len(other) - same[0])
        return word[same[0] : len(word) - tail] + ">" + other[same[0] : len(other) - tail], 0, 1, 0
    changed = [(a, b) for a, b in zip(word, other) if a != b]
    parts = [[x != y for x, y in zip(_jamo(a), _jamo(b))] for a, b in changed]
    return "".join(a + b for a, b in changed), *(sum(p[i] for p in parts) for i in range(3))


def replacements(counted: DataFrame) -> DataFrame:
    """``(word, fix)``: words of scans that are misread, with the frequent word they stand for.

    ``counted`` as of :func:`words`. A pair is a candidate if only one letter of each
    exchanged syllable differs and sound text has the fix more often. How many different words
    show the same exchange and how much of it stands in scans, how frequent both words
    are, also against each other, and which letters differ are the ranker's features; its
    labels say whether a word stands in scans more than the corpus' share of them.
    """
    total = counted.agg(F.sum("sound").alias("sound"), F.sum("noisy").alias("noisy")).first()
    several = counted.where(F.length("word") > 1)
    own = _grammed(several.where("noisy + edge > 0"), "word", "sound", "noisy", "edge")  # only words of scans are to be replaced
    right = _grammed(several.where("sound > 1"), "word", "sound").select(F.col("word").alias("fix"), F.col("sound").alias("fix_sound"), "gram")
    met = own.join(right, "gram").where("lower(word) <> lower(fix) and fix_sound > sound").select("word", "fix", "sound", "noisy", "edge", "fix_sound").distinct()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_difference(a, b) for a, b in zip(frame["word"], frame["fix"])]
            keep = [">" in d[0] and d[0].lower() != d[0][::-1].lower() or ">" not in d[0] and d[1] + d[2] + d[3] <= len(d[0]) // 2 for d in made]
            frame = frame.assign(
                change=[d[0] for d in made], first=[d[1] for d in made], middle=[d[2] for d in made], last=[d[3] for d in made]
            )
            yield frame[np.array(keep, bool)]

    shape = "word string, fix string, sound long, noisy long, edge long, fix_sound long, change string, first int, middle int, last int"
    pairs = materialize(met.mapInPandas(compare, shape))
    support = pairs.groupBy("change").agg(
        F.count("*").alias("support"), F.sum("noisy").alias("change_noisy"), F.sum("sound").alias("change_sound")
    )
    all_sound, all_noisy = F.lit(total["sound"] or 0).alias("all_sound"), F.lit(total["noisy"] or 0).alias("all_noisy")
    full = pairs.join(support, "change").select("*", all_sound, all_noisy)

    def features(frame: pd.DataFrame) -> np.ndarray:
        share = frame["all_noisy"] / (frame["all_sound"] + frame["all_noisy"]).clip(lower=1)
        lift = (frame["change_noisy"] + 0.5) / (frame["change_noisy"] + frame["change_sound"] + 1) / share.clip(lower=1e-6)
        return np.stack([
            np.log1p(frame["support"]), np.log(lift), np.log1p(frame["fix_sound"]), np.log1p(frame["sound"] + frame["noisy"]),
            frame["first"], frame["middle"], frame["last"], frame["word"].str.len(), np.log(frame["fix_sound"] / (frame["sound"] + frame["noisy"]).clip(lower=1)),
        ], 1).astype(float)

    columns = [*full.columns]
    sample = full.where("sound + noisy > 0").orderBy(F.xxhash64("word", "fix")).limit(TRAINING_PAIRS).toPandas()  # the bounded training sample
    if not len(sample) or not sample["noisy"].sum():
        return full.select("word", "fix").where("false")
    share = sample["all_noisy"] / (sample["all_sound"] + sample["all_noisy"])
    rate = sample["noisy"] / (sample["sound"] + sample["noisy"])
    label = (rate > np.maximum(0.5, np.minimum(0.9, 4 * share))).to_numpy(float)
    model = Boosted(rounds=40).fit(features(sample), label)

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            changes = frame["first"] + frame["middle"] + frame["last"]
            yield frame[["word", "fix", "noisy", "sound", "edge", "fix_sound", "change_noisy", "change_sound"]].assign(changes=changes, score=model.predict(features(frame[columns])))

    judged = full.mapInPandas(rank, "word string, fix string, noisy long, sound long, edge long, fix_sound long, change_noisy long, change_sound long, changes int, score double")
    # A word that only stands at line ends may be part of one: its exchange must be seen within lines, in scans above all.
    part = (F.col("edge") > 0) & (F.col("sound") == 0) & (F.col("change_noisy") > F.col("change_sound"))
    # A word's candidates: of those about as likely the one with fewer letters changed.
    best = W.partitionBy("word").orderBy(F.desc(F.round("score", 1)), "changes", F.desc("score"), F.desc("fix_sound"), "fix")
    chosen = judged.where((F.col("score") > SURE) & ((F.col("noisy") > 0) | part)).withColumn("r", F.row_number().over(best))
    return chosen.where("r = 1").select("word", "fix")


def pair_features(left: str, right: str, counts: dict[str, int]) -> list[float]:
    """What tells a cut word from a wrap: frequencies of the joined word and of its parts, and their lengths."""
    a, b = re.search("[가-힣]*$", left)[0], re.match("[가-힣]*", right)[0]
    count = lambda w: math.log1p(counts.get(w, 0))
    both, one, other = count(a + b), count(a), count(b)
    tail = max((count(a[-k:] + b) for k in range(1, min(len(a), 4))), default=0.0)
    return [both, one, other, both - one, both - other, min(one, other), tail, len(a), len(b), float(b == right.strip())]


class _Asked:
    """Counts and a classifier that know nothing and note which words' counts are asked for, but those of ``known``."""

    def __init__(self, known: dict[str, int]) -> None:
        self.known, self.words = known, set()

    def get(self, word: str, default: int) -> int:
        if word and word not in self.known:
            self.words.add(word)
        return default

    def predict(self, features: np.ndarray) -> np.ndarray:
        return np.zeros(len(features))


def training_rows(texts: list[str], counts: dict[str, int]) -> tuple[list[list[float]], list[float]]:
    """Features and labels of sound texts cut at every few characters, inside words and at spaces."""
    rows, labels = [], []
    for n, text in enumerate(texts):
        text = re.sub(r"\s+", " ", text)
        for at in range(7 + n % 11, len(text) - 8, 13):
            before, after = text[:at], text[at:]
            if _HANGUL.match(before[-1]) and _HANGUL.match(after[0]):
                rows.append(pair_features(before[-20:], after[:20].split(" ")[0], counts))
                labels.append(1.0)
            space = text.find(" ", at)
            if 0 < space < len(text) - 1 and _HANGUL.match(text[space - 1]) and _HANGUL.match(text[space + 1]):
                rows.append(pair_features(text[max(0, space - 20) : space], text[space + 1 : space + 21].split(" ")[0], counts))
                labels.append(0.0)
    return rows, labels


def train_pairs(texts: list[str], counts: dict[str, int]) -> Boosted | None:
    """The line-pair classifier, from :func:`training_rows`."""
    rows, labels = training_rows(texts, counts)
    if len(set(labels)) < 2:
        return None
    return Boosted().fit(np.array(rows), np.array(labels))


def misread_numbers(text: str) -> str:
    """The text with letters inside numbers read as digits."""

    def digits(match: re.Match) -> str:
        found = match[0]
        if found.isdigit() or not any(c in DIGIT_LIKE for c in found):
            return found
        beside = text[match.end() : match.end() + 1], text[max(0, match.start() - 1) : match.start()]
        numeric = any(c.isdigit() for c in found)
        around = bool(re.match("[가-힣]" if numeric else COUNTERS, beside[0] or " ")) or (beside[0] in ".,:%-/" and text[match.end() + 1 : match.end() + 2].isdigit())
        around = around or (beside[1] in ".,:-/" and text[max(0, match.start() - 2) : match.start() - 1].isdigit()) or beside[1] in "제표"
        if (numeric and len(found) < 5) or around:
            return "".join(DIGIT_LIKE.get(c, c) for c in found)
        return found

    return _NUMBER.sub(digits, text)


def _is_header(shape: str, headers: set[str], title: str) -> bool:
    return bool(shape) and (shape in headers or len(shape) > 7 and (title.startswith(shape) or len(title) > 7 and shape.startswith(title)))


def _repairing(text: str, headers: set[str], title: str, fixes: dict[str, str], counts: dict[str, int], asks: bool, table: bool, scan: bool) -> Generator[list[list[float]], np.ndarray, tuple[str, bool]]:
    """What :func:`repair` returns; if it ``asks``, it yields the features of a block's line pairs and takes their probabilities, where there are any."""
    noisy, lines = False, []
    if table and not scan:
        return text, False
    if table:
        read = misread_numbers(text)
        read = _WORD.sub(lambda m: fixes.get(m[0], m[0]), read)
        return read, read != text
    for line in text.split("\n"):
        shape = re.sub(r"\s+", " ", re.sub(r"[0-9|]", "", line)).strip(" ")
        if _PAGE.fullmatch(line.strip()) or _is_header(shape, headers, title):
            noisy = True
        else:
            lines.append(line)
    breaks: list[str] = []
    asked: list[tuple[int, list[float]]] = []
    for n, (a, b) in enumerate(zip(lines, lines[1:])):
        if not a.strip() or not b.strip() or _ITEM.match(b) or "\t" in a + b or " │ " in a + b:
            breaks.append("\n")
        elif a.endswith("-") and (_HANGUL.match(a[-2:-1] or " ") and _HANGUL.match(b[0]) or re.search("[A-Za-z]-$", a) and re.match("[a-z]", b)):
            breaks.append("-")
            noisy = True
        else:
            breaks.append(" " if not re.search(r"[.!?。:]\s*$", a) else "\n" if len(a) < 25 else " ")
            if asks and _HANGUL.match(a[-1]) and _HANGUL.match(b[0]):
                asked.append((n, pair_features(a[-20:], b[:20].split(" ")[0], counts)))
    if asked:
        for (n, _), p in zip(asked, (yield [f for _, f in asked])):
            if p > (SURE if scan else SURE_ALONE):
                breaks[n] = ""
                noisy = True
    if not (noisy or scan):
        return text, False
    out = lines[0] if lines else ""
    for mark, line in zip(breaks, lines[1:]):
        out = (out[:-1] + line) if mark == "-" else out + mark + line
    read = misread_numbers(out)
    if fixes:
        read = _WORD.sub(lambda m: fixes.get(m[0], m[0]), read)
    return read, noisy or read != out


def repair(text: str, headers: set[str], title: str, fixes: dict[str, str], counts: dict[str, int], model: Boosted | None, table: bool = False, scan: bool = True) -> tuple[str, bool]:
    """The block's text as continuous paragraphs, and whether it held any noise of a scan."""
    return repair_all([(text, headers, title, fixes, counts, table, scan)], model)[0]


def repair_all(blocks: list[tuple], model: Boosted | None) -> list[tuple[str, bool]]:
    """:func:`repair` of many blocks (its arguments without the model): the line pairs of all are judged at once."""
    found: list[tuple[str, bool]] = [("", False)] * len(blocks)
    waiting, asked = [], []

    def go(number: int, steps: Generator, probabilities: np.ndarray | None) -> list[list[float]]:
        try:
            return steps.send(probabilities)
        except StopIteration as done:
            found[number] = done.value
            return []

    for number, (text, headers, title, fixes, counts, table, scan) in enumerate(blocks):
        features = go(number, steps := _repairing(text, headers, title, fixes, counts, model is not None, table, scan), None)
        if features:
            waiting.append((number, steps, len(asked), len(asked) + len(features)))
            asked += features
    judged = model.predict(np.array(asked)) if asked else np.empty(0)
    for number, steps, first, last in waiting:
        go(number, steps, judged[first:last])
    return found


def repaired_blocks(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """``(document_id, block_id, text)`` of each block with noise from scanning, repaired.

    ``titles`` has the document_id and source_title of documents (a title may be a
    running header), and their file_extension if known: an image file is a scan. A block that is only a running header or page number has an empty text. Table cells,
    null texts and blocks without noise are in no row; rows that appear twice count once;
    other columns are not read.
    """
    spark = blocks.sparkSession
    counted = materialize(words(blocks))
    ids = scanned(blocks)
    if "file_extension" in titles.columns:
        ids = ids.unionByName(titles.where(F.lower("file_extension").isin(*IMAGES)).select("document_id")).distinct()
    ids = materialize(ids)
    own = blocks.where("block_type is distinct from 'table_cell' and text is not null")
    columns = "document_id", "block_id", "block_type", "text"
    inside = own.join(ids, "document_id", "left_semi").select(*columns, F.lit(True).alias("scan"))
    outside = own.where(F.col("text").rlike(_JUDGED)).join(ids, "document_id", "left_anti").select(*columns, F.lit(False).alias("scan"))
    pages = materialize(inside.unionByName(outside).dropDuplicates(["block_id", "text"]))
    prose = pages.where("scan and (block_type is null or block_type not in ('table', 'caption'))")
    lines = prose.select("document_id", "block_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    shaped = lines.select("document_id", "block_id", line_shape(F.col("line")).alias("shape")).where(
        F.col("line").rlike("[가-힣A-Za-z]") & (F.length("shape").between(3, 60)) & ~F.col("line").rlike(r"\t|│|[.다:]\s*$")
        & ~F.col("line").rlike(r"^\s*([•·○□※]|\(?[0-9가-힣]{1,2}[.)]|제\d+[장조])\s")
    )
    counts_of = shaped.groupBy("document_id", "shape").agg(F.countDistinct("block_id").alias("n"))
    ending = F.element_at(F.split("shape", " "), -1)
    repeats = F.sum((F.col("n") > 1).cast("int"))
    endings = counts_of.groupBy(ending.alias("ending")).agg(repeats.alias("repeats"), F.count("*").alias("all"))
    alike = counts_of.join(endings.where("repeats > 3 and repeats >= 0.4 * all"), ending == F.col("ending"), "left")
    headers = alike.where("n > 1 or (ending is not null and length(shape) < 30)").groupBy("document_id").agg(F.collect_set("shape").alias("headers"))
    top = counted.where("sound > 1").orderBy(F.desc("sound"), "word").limit(VOCABULARY)
    counts = {r["word"]: r["sound"] for r in top.collect()}  # at most ``VOCABULARY`` rows
    sound = own.where(~F.lower("parser").contains("ocr") & (F.col("block_type") == "paragraph") & F.length("text").between(80, 2_000))
    texts = [r["text"] for r in sound.join(ids, "document_id", "left_anti").orderBy(F.xxhash64("block_id")).limit(TRAINING_BLOCKS).select("text").collect()]
    whole = len(counts) < VOCABULARY
    rare = counted.where("sound > 1").select("word", "sound")
    own_counts = counts
    if not whole:  # the training texts' other words
        training_rows(texts, noted := _Asked(counts))
        wanted = spark.createDataFrame([(w,) for w in noted.words], "word string")
        own_counts = counts | {r["word"]: r["sound"] for r in rare.join(wanted, "word").collect()}
    model = train_pairs(texts, own_counts)
    each = pages.select("block_id", F.explode(F.array_distinct(word_list(F.col("text")))).alias("word"))
    fixes = each.join(replacements(counted), "word").groupBy("block_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("fixes"))
    named = titles.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.max(line_shape(F.col("source_title"))).alias("title"))
    known = pages.join(headers, "document_id", "left").join(named, "document_id", "left")
    shared = spark.sparkContext.broadcast((counts, model))

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for block, kind, text, scan, headers, title in frame.itertuples(index=False):
                noted = _Asked(shared.value[0])
                title = title if title is not None and kind == "paragraph" else ""
                repair(text, set(headers) if headers is not None else set(), title, {}, noted, noted, kind in ("table", "caption"), scan)
                rows += [(block, word) for word in noted.words]
            yield pd.DataFrame(rows, columns=["block_id", "word"])

    ready = known.join(fixes, "block_id", "left")
    if whole:
        ready = ready.withColumn("rare", F.lit(None).cast("map<string,long>"))
    else:  # words that are not in the model's table come with the blocks that ask for them
        sought = known.select("block_id", "block_type", "text", "scan", "headers", "title").mapInPandas(asked, "block_id string, word string")
        others = sought.join(rare, "word").groupBy("block_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "sound"))).alias("rare"))
        ready = ready.join(others, "block_id", "left")
    ready = ready.select("document_id", "block_id", "block_type", "text", "scan", "headers", "title", "fixes", "rare")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, classifier = shared.value
        for frame in frames:
            blocks = []
            for _, _, kind, text, scan, known, title, fix, others in frame.itertuples(index=False):
                fix = dict(fix) if fix is not None else {}
                title = title if title is not None and kind == "paragraph" else ""
                blocks.append((text, set(known) if known is not None else set(), title, fix, ChainMap(dict(others), table) if others is not None else table, kind in ("table", "caption"), scan))
            read = repair_all(blocks, classifier)
            rows = [(document, block, r) for document, block, (r, noisy) in zip(frame["document_id"], frame["block_id"], read) if noisy]
            yield pd.DataFrame(rows, columns=["document_id", "block_id", "text"])

    return ready.mapInPandas(run, "document_id string, block_id string, text string")
