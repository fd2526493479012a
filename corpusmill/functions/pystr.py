"""Python's string semantics as column expressions.

White space, case and word characters differ between Java's defaults and Python; these helpers are
right for all characters below U+0870 and differ above only where Unicode versions do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class, without brackets: Python's white space, its word characters, its digits.
WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"


def newlines(c: Column) -> Column:
    """Universal newlines: every line end as ``\\n``."""
    return F.regexp_replace(c, "\r\n?", "\n")


def words(c: Column) -> Column:
    """``str.split()``; null gives null."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda x: x != "")


def strip(c: Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def squeeze(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.array_join(words(c), " ")


def isupper(c: Column) -> Column:
    """``str.isupper()``."""
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def isdigit(c: Column) -> Column:
    """``str.isdigit()``."""
    return c.rlike(f"^[{DIGITS}]+$")


def lines(c: Column) -> Column:
    """Lines of a text after universal newlines, empty ones included; null gives null."""
    return F.split(newlines(c), "\n", -1)


def word_count(c: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(words(F.coalesce(c, F.lit("")))), F.lit(0)).cast("bigint")


def line_count(c: Column) -> Column:
    """Number of lines; 0 for null, 1 for an empty text."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(lines(c))).cast("bigint")
