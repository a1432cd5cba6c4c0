"""Text functions on columns; everything stays in the JVM but the Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of Unicode, written out so that every regex engine means the same.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Runs of one class; single letters are no terms.
TERM = "[가-힣]{2,}|[a-z]{2,}|[0-9]+"
#: Particles that end a word, the longest first.
PARTICLES = "으로부터|에서는|에게서|으로는|까지는|에서|에게|으로|부터|까지|에는|과의|와의|은|는|이|가|을|를|의|에|로|와|과|도|만"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composed form; null for null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility composed form with full case folding; null for null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def fold_space(text: Column) -> Column:
    """Every run of white space made one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def rank_form(text: Column) -> Column:
    """Lower case with folded white space."""
    return F.lower(fold_space(text))


def clean(text: Column, keep_tabs: bool = False) -> Column:
    """Line ends as line feeds, control characters as spaces, runs of blanks folded in each line, at most two empty lines, trimmed."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    control = F.regexp_replace(unix, r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}]", " ")
    blanks = F.regexp_replace(control, "[ \\x{a0}\\x{3000}]+" if keep_tabs else "[ \t\\x{a0}\\x{3000}]+", " ")
    lines = F.regexp_replace(blanks, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{4,}", "\n\n\n"), f"^{SPACE}+|{SPACE}+$", "")


def title_key(title: Column) -> Column:
    """A title's fingerprint: without extension, years and sizes, letters and digits only, in lower case."""
    bare = F.regexp_replace(F.lower(title), r"[.](pdf|hwpx?|docx?|xlsx?|html?|zip)$", "")
    bare = F.regexp_replace(bare, r"(19|20)[0-9]{2}(학년도|년도|년)?|[0-9.]+ ?[kmg]b", "")
    return F.regexp_replace(bare, "[^0-9a-z가-힣]+", "")


def terms(text: Column) -> Column:
    """Runs of Hangul, Latin letters or digits in lower case; single letters are dropped, single digits stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_bag(text: Column) -> Column:
    """The terms of :func:`search_terms` in another order: one pass of a regular expression each for terms and pairs."""
    return F.concat(terms(text), F.regexp_extract_all(text, F.lit("(?=([가-힣]{2}))"), F.lit(1)))


def search_terms(text: Column) -> Column:
    """Terms, each of Hangul followed by its pairs of syllables."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda n: F.substring(t, n, F.lit(2)))
    grown = F.transform(terms(text), lambda t: F.when(t.rlike("^[가-힣]"), F.concat(F.array(t), pairs(t))).otherwise(F.array(t)))
    return F.flatten(grown)


def stems(text: Column) -> Column:
    """Distinct terms without their last particle, if at least two syllables are left."""
    return F.array_distinct(F.transform(terms(text), lambda t: F.regexp_replace(t, f"^(..+?)({PARTICLES})$", "$1")))


def numbers(text: Column) -> Column:
    """Numbers of a text without the commas in them, in order."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:[.][0-9]+)?"), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))


def critical_values(text: Column) -> Column:
    """Typed facts ``kind:value`` of a text: years, terms, dates, times, amounts, shares, quantities and numbers of files."""
    rules = (
        ("date", r"[0-9]{4}(?:-[0-9]{1,2}-[0-9]{1,2}|년 [0-9]{1,2}월 [0-9]{1,2}일|[.] [0-9]{1,2}[.] [0-9]{1,2}[.])"),
        ("term", r"[0-9]{4}학년도(?: [0-9]학기)?(?: [0-9]{1,2}주차)?"),
        ("day", r"[0-9]{1,2}월 [0-9]{1,2}일"),
        ("time", r"[0-9]{1,2}:[0-9]{2}"),
        ("amount", r"[0-9][0-9,]*(?:만)? ?원"),
        ("percent", r"[0-9]+(?:[.][0-9]+)?%"),
        ("quantity", r"[0-9]+(?:명|건|회|점|일|시간|학점|개 반)"),
        ("article", r"제[0-9]+조(?:제[0-9]+항)?"),
        ("file", r"[A-Z]{2}-[0-9]{4}-[0-9]{4}"),
        ("extension", r"내선 [0-9]{4}"),
    )
    folded = fold_space(text)
    bare = lambda v: F.replace(F.replace(v, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))

    def facts(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(folded, F.lit(pattern), F.lit(0)), lambda v: F.concat(F.lit(f"{kind}:"), bare(v)))

    found = [facts(kind, pattern) for kind, pattern in rules]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after a full stop of a word that ends in a letter or bracket, and at line ends; dates stay whole."""
    marked = F.regexp_replace(text, r"([가-힣A-Za-z)\]’\"][.!?])[ \t]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+", -1), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
