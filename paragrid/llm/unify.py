"""One consistent form of text: what looks the same becomes the same.

``consistent`` is the comparison form: compatibility normalisation composed, full case
folding, white space mapped, default-ignorable characters removed, look-alike letters,
hyphens and dots unified. It is the same for a letter's two cases, so a small letter goes
with what its capital looks like, but for those in ``OWN_LOOK``. ``appearance`` is stricter: it unifies only what a reader
cannot tell apart (case, superscripts, circled digits and widths of space stay), so it
decides whether two texts of one consistent form are really the same on the page.
Both are computed once for each distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.llm.expand import spread_join
from paragrid.session import materialize

# Letters of other scripts in the order of the Latin letters they look like.
LOOK_ALIKES = {
    "Cyrillic": ("АВСЕНІЈКМОРЅТХУԚԜҮѴасеіјорѕхуһԛԝԁӏѵ", "ABCEHIJKMOPSTXYQWYVaceijopsxyhqwdlv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"),
    "Armenian": ("ՍՏՕԼսօոհցզյ", "USOLuonhgqj"),
    "Latin": ("ɑɡı", "agi"),
}
# Small letters that keep their own look though their capitals look like Latin ones: Greek mu stands for
# micro, and nu and palochka look like v and l where their capitals look like N and I.
OWN_LOOK = "μνӏ"
# Hyphens and middle dots that look like "-" and "·".
HYPHENS = "‐‑﹣－⁃˗−"
DOTS = "·‧∙⋅・･ㆍᐧ⸱ꞏ"
# White space besides the separators that is one space in the comparison form; a line feed stays.
CONTROL_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85"
# Ranges of default-ignorable characters.
IGNORABLE = (
    "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f"
    "\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff0-\\ufff8\\U0001bca0-\\U0001bca3\\U0001d173-\\U0001d17a\\U000e0000-\\U000e0fff"
)
_IGNORABLE = re.compile(f"[{IGNORABLE}]")
_PLAIN = re.compile(r"[^\n\t\x20-\x7e가-힣]")


def _look_alikes() -> dict[int, str]:
    found = {ord(a): b for others, latin in LOOK_ALIKES.values() for a, b in zip(others, latin, strict=True)}
    found |= {ord(c): "-" for c in HYPHENS} | {ord(c): "·" for c in DOTS}
    return found


@lru_cache(maxsize=1)
def _appearance_table() -> dict[int, str | None]:
    """Every character of the basic plane whose look has another, preferred code."""
    table: dict[int, str | None] = {}
    for code in range(0x80, 0x10000):
        char = chr(code)
        if _IGNORABLE.match(char):
            table[code] = None
        elif unicodedata.category(char) == "Zs":
            table[code] = " "
        else:
            kind, _, codes = unicodedata.decomposition(char).partition(" ")
            if kind in ("<wide>", "<narrow>", "<noBreak>"):
                table[code] = chr(int(codes, 16))
            elif kind == "<compat>" and 0x2E80 <= code <= 0x2FDF:  # radicals
                table[code] = chr(int(codes, 16))
    table |= {code: None for code in range(0xE0000, 0xE1000)}
    alike = _look_alikes()
    for code in range(0x370, 0x530):  # letters with marks go by their base letter
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and ord(base) in alike:
            table[code] = unicodedata.normalize("NFC", alike[ord(base)] + "".join(marks))
    return table | alike


def appearance(text: str) -> str:
    """The text as a reader sees it: two texts look the same exactly if this is equal."""
    if not _PLAIN.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_appearance_table()))


@lru_cache(maxsize=1)
def _space_table() -> dict[int, str | None]:
    letters = range(0x370, 0x530)
    spaces = {ord(c): " " for c in CONTROL_SPACE}
    return {c: t for c, t in _appearance_table().items() if t is None or t == " " or c in letters} | _look_alikes() | spaces


@lru_cache(maxsize=1)
def _small_table() -> dict[int, str]:
    """What small letters are in the comparison form: their own look, else their capital's in small, marks kept."""
    alike = _look_alikes()
    table = {code: char for code, char in alike.items() if char.islower()}
    for code in (*range(0x370, 0x590), *alike):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        capital = base.upper()
        if base.islower() and base not in OWN_LOOK and ord(base) not in alike and len(capital) == 1 and ord(capital) in alike:
            table[code] = unicodedata.normalize("NFC", alike[ord(capital)].lower() + "".join(marks))
    return table | {c: m for c, m in alike.items() if m in "-·"}


def consistent(text: str) -> str:
    """The comparison form, made from the appearance, so that what looks the same has one form; idempotent."""
    if not _PLAIN.search(text):
        return text.casefold().replace("\t", " ")
    text = appearance(text)  # first: NFKC would turn a look-alike such as U+318D or U+03F2 into another letter
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_space_table()))
    small = unicodedata.normalize("NFKC", text.casefold()).translate(_small_table())
    return unicodedata.normalize("NFC", small)


def _on_distinct(function: Callable[[str], object], kind: pa.DataType, column: pa.Array) -> pa.Array:
    coded = column.dictionary_encode() if not isinstance(column, pa.DictionaryArray) else column
    values = pa.array([function(v) for v in coded.dictionary.to_pylist()], kind)
    return pc.take(values, coded.indices)


def unify(df: DataFrame, text: str = "text", out: str = "unified") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out`` (null for null, empty for empty).

    All rows and other columns stay; a column already named ``out`` is replaced.
    """
    keep = [c for c in df.columns if c != out]
    source = df.select(*(F.col(f"`{c}`") for c in keep))
    shape = source.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _on_distinct(consistent, pa.string(), batch.column(keep.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*keep, out])

    return source.mapInArrow(run, shape)


def _marks(text: str) -> dict[str, int]:
    look = xxhash.xxh3_128_intdigest(appearance(text).encode())
    half = lambda x: (x & (2**64 - 1)) - 2**63
    return {
        "form": half(xxhash.xxh3_64_intdigest(consistent(text).encode())),
        "look": half(look >> 64),
        "look_low": half(look),
        "exact": half(xxhash.xxh3_64_intdigest(text.encode())),
    }


_MARKS = pa.struct([(n, pa.int64()) for n in ("form", "look", "look_low", "exact")])


def look_alike_pairs(df: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Pairs ``(key_a, key_b)`` of texts that look the same but are different strings.

    Texts meet by their consistent form; equal appearance decides. Copies of one string
    are a class: classes are paired first and members expanded only in the result, so a
    text that fills a third of all rows costs no pairs of its copies. Null texts and
    keys are in no pair; repeated rows count once; empty input gives no rows.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _on_distinct(_marks, _MARKS, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *marks.flatten()], ["key", *(f.name for f in _MARKS)])

    same = ["form", "look", "look_low"]
    marked = materialize(rows.mapInArrow(run, "key string, form long, look long, look_low long, exact long"))
    varied = marked.groupBy(*same).agg(F.min("exact").alias("low"), F.max("exact").alias("high")).where("low < high")
    members = materialize(marked.join(varied.select(*same), same, "left_semi").distinct())
    classes = members.select(*same, "exact").distinct()
    pairs = classes.withColumnRenamed("exact", "one").join(classes.withColumnRenamed("exact", "other"), same).where("one < other")
    left = members.select(*same, F.col("exact").alias("one"), F.col("key").alias("k1"))
    right = members.select(*same, F.col("exact").alias("other"), F.col("key").alias("k2"))
    met = spread_join(spread_join(pairs, left, [*same, "one"], "k1"), right, [*same, "other"], "k2").where("k1 <> k2")
    return met.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


def texts_of(blocks: DataFrame, cases: DataFrame) -> DataFrame:
    """``(key, text)`` of every block, claim and source text."""
    claims = cases.select(F.concat("id", F.lit("#claim")).alias("key"), F.col("claim").alias("text"))
    sources = cases.select("id", F.posexplode("sources").alias("n", "source")).select(
        F.concat("id", F.lit("#s"), F.col("n").cast("string")).alias("key"), F.col("source.text").alias("text")
    )
    return blocks.select(F.col("block_id").alias("key"), "text").unionByName(claims).unionByName(sources)
