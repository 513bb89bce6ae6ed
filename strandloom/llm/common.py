"""What the text operators share: settled tables, column picking, word bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.settling import settle, unsettle

__all__ = ["SPACE", "settle", "squeeze", "text_or_empty", "unsettle", "words_of"]

#: Regular expression of the white space that separates words, and of words.
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def squeeze(text: Column) -> Column:
    """Each run of white space replaced by one space."""
    return F.regexp_replace(text, SPACE, " ")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8 bytes; bytes.split() cuts at x20 and x09-x0D alone."""
    return text.encode().lower().split() if text else []
