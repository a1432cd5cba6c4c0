"""Normal forms of texts, paths and keys, each for one kind of comparison."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paragrid.functions.text import SPACE

#: Texts of these characters are their own normal forms.
PLAIN = r"^[\t\n\r\x20-\x7e가-힣]*$"


def _on_distinct(text: pd.Series, form: Callable[[str], str]) -> pd.Series:
    made = {t: form(t) for t in text.dropna().unique()}
    return pd.Series([made.get(t) for t in text], dtype=object)


@F.pandas_udf(StringType())
def _nfkc_fold(text: pd.Series) -> pd.Series:
    return _on_distinct(text, lambda t: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return _on_distinct(text, lambda t: unicodedata.normalize("NFC", t))


def folded(text: Column) -> Column:
    """Compatibility form with full case folding; only texts with unusual characters leave the JVM."""
    return F.when(text.rlike(PLAIN), F.lower(text)).otherwise(_nfkc_fold(F.when(~text.rlike(PLAIN), text)))


def composed(text: Column) -> Column:
    """Canonical composed form; only texts with unusual characters leave the JVM."""
    return F.when(text.rlike(PLAIN), text).otherwise(_nfc(F.when(~text.rlike(PLAIN), text)))


def evidence_text(text: Column) -> Column:
    """For quotes: folded, every run of punctuation, symbols and white space made one space, none at the ends."""
    return F.trim(F.regexp_replace(folded(text), r"[\p{P}\p{S}\p{Z}\p{C}\s]+", " "))


def anchor_key(text: Column) -> Column:
    """For anchors: folded, letters and digits only."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "")


def spaceless(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def relative_path(path: Column) -> Column:
    """Forward slashes, composed, without empty and "." parts; null for an absolute path, one that climbs out, or none."""
    slashed = F.regexp_replace(composed(path), r"\\", "/")
    parts = F.filter(F.split(slashed, "/", -1), lambda p: (p != "") & (p != "."))
    bad = slashed.rlike(r"^/|^[A-Za-z]:|\x{0}") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def inside(root: Column, path: Column) -> Column:
    """Whether a relative path lies below the folder ``root``; null paths do not."""
    return F.coalesce(F.startswith(relative_path(path), F.concat(relative_path(root), F.lit("/"))), F.lit(False))


def stable_id(value: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of a text."""
    return F.substring(F.sha1(value), 1, 16)


def body_and_sections(text: Column, sections: Column) -> Column:
    """A text and the titles of its sections, a line each."""
    return F.concat_ws("\n", text, F.array_join(F.coalesce(sections, F.array().cast("array<string>")), "\n"))


def first_filled(*values: Column) -> Column:
    """The first value that is not null and not blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))
