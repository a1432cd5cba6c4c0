"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(relative_path: Column, sha256: Column) -> Column:
    """``doc_`` and 24 hexadecimal digits of the hash of path and content hash, a zero byte between them."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(relative_path, F.lit("\0"), sha256), 256), 1, 24))


def block_id(document: Column, reading_order: Column) -> Column:
    """The document's id with the block's place, six digits wide."""
    return F.concat(document, F.lit(":b"), F.lpad(reading_order.cast("string"), 6, "0"))


def table_id(document: Column, number: Column) -> Column:
    """The document's id with the table's number, four digits wide."""
    return F.concat(document, F.lit(":t"), F.lpad(number.cast("string"), 4, "0"))


def seeded_order(seed: str, key: Column) -> Column:
    """A key to shuffle by, the same for the same seed anywhere."""
    return F.sha2(F.concat(F.lit(seed + "\0"), key), 256)
