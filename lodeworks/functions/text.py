"""Text normalisation. The Python forms serve Arrow batches, the Column forms stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = regex.compile(r"\p{M}+")
_GAPS = regex.compile(r"[^\p{L}\p{N}]+")
_ASCII_GAPS = re.compile(r"[^a-z0-9]+")

#: Token class: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"


def fold(text: str) -> str:
    """Lower case without diacritics: canonical decomposition, combining marks dropped."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


def normalised(text: str | None) -> str:
    """fold(), each run of other characters than letters and digits one space, trimmed. Null gives ''."""
    if not text:
        return ""
    text = fold(text)
    return (_ASCII_GAPS if text.isascii() else _GAPS).sub(" ", text).strip()


def trimmed(column: Column) -> Column:
    """Without white space (line ends and tabs too) at both ends."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def longer_than(column: Column, n: int) -> Column:
    """Whether the column has more than n characters once trimmed() (n of 1 or more), without writing the trimmed text; null is false."""
    return F.coalesce(column.rlike(rf"(?s)\S.{{{n - 1},}}?\S"), F.lit(False))


def tokens(column: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null gives null."""
    return F.regexp_extract_all(F.lower(column), F.lit(f"({WORD})"), 1)


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")
