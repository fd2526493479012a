"""Cleaning of transcribed books: header and footer, sections, positional removal rules, catalog filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import pystr

# How a trailing part of a book begins, the words that mark a modern insertion, and the frames of tables.
END_KEYWORDS = (
    "APPENDICES", "APPENDIX", "FINIS", "FOOTNOTE", "FOOTNOTES", "GLOSSARY", "ILLUSTRATIONS", "INDEX", "NOTES", "REFERENCES", "THE END",
    "Transcriber’s Note", "TRANSCRIBER’S NOTE",
)
MODERN_WORDS = ("Project Gutenberg", "http", "HTML", "E-Text")
START_MARK = r"(?md)^\*{3} START OF THE PROJECT GUTENBERG(?: EBOOK)? .+? \*{3}$"
END_MARK = r"(?md)^\*{3} END OF THE PROJECT GUTENBERG(?: EBOOK)? .+? \*{3}$"
ROMAN = r"^(?=[MDCLXVI])M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\.?$"
EMAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"


def strip_marks(text: Column) -> Column:
    """The body between the start and the end mark; a missing mark cuts nothing."""
    body = F.element_at(F.split(pystr.newlines(text), START_MARK, 2), -1)
    return pystr.strip(F.element_at(F.split(body, END_MARK, 2), 1))


def sections(text: Column, separator: str = "\n\n") -> Column:
    """Non-empty parts between blank lines."""
    return F.filter(F.split(text, separator), lambda s: s != "")


def clean_section(section: Column) -> Column:
    """A section without italics marks, note numbers and doubled blanks; null if nothing worth keeping is left."""
    s = pystr.strip(F.regexp_replace(section, "_", ""))
    dashed = F.regexp_replace(s, r"[\t-\r\x1c-\x1f\x85\p{Z}]?(?<!-)--(?!-)[\t-\r\x1c-\x1f\x85\p{Z}]?", " -- ")
    out = pystr.squeeze(F.regexp_replace(dashed, r"\[[0-9]+\]", ""))
    gone = (s.startswith("[") & s.endswith("]")) | ~dashed.rlike("[0-9A-Za-z]") | dashed.startswith("End of Project Gutenberg")
    return F.when(~gone, out)


def is_toc_line(s: Column) -> Column:
    return s.contains(". . . . .") | s.contains("........")


def is_chapter_line(s: Column) -> Column:
    return pystr.strip(F.lower(s)).rlike(r"^(?:chapter|chap\.|chapt\.)")


def ends_with_number(s: Column) -> Column:
    return F.coalesce(pystr.isdigit(F.try_element_at(pystr.words(s), F.lit(-1))), F.lit(False))


def has_email(s: Column) -> Column:
    return s.rlike(EMAIL)


def starts_with_roman(s: Column) -> Column:
    first = F.get(pystr.words(s), 0)
    return F.coalesce(first.rlike(ROMAN) & ~pystr.strip(s).startswith("I "), F.lit(False))


def _counts(s: Column, piece: str) -> Column:
    return F.size(F.split(s, piece, -1)) - 1


def with_removals(df: DataFrame, column: str = "sections") -> DataFrame:
    """Adds ``kept`` and ``rejected``: the sections by the positional rules, in order.

    Removed are: short sections among the first 16; contents lines, chapter lines, page references,
    e-mail addresses and numerals near the start; capitals; table frames; modern insertions; bracketed
    remarks, also the first half of one over two sections; and everything from the first trailing part on.
    """
    c = F.col(column)
    n = F.size(c)

    def judge(s: Column, i: Column) -> Column:
        following = F.coalesce(F.get(c, i + 1), F.lit(""))
        early = (i < 16) & (F.size(pystr.words(s)) < 8)
        front = (i < F.greatest(F.lit(200), F.floor(n / 8))) & (
            is_toc_line(s) | is_chapter_line(s) | ends_with_number(s) | has_email(s) | starts_with_roman(s)
        )
        frame = s.contains("+----") | s.contains("┌") | (_counts(s, r"\|") > 2) | (_counts(s, "│") > 1)
        modern = F.lit(False)
        for w in MODERN_WORDS:
            modern = modern | s.contains(w)
        half = s.startswith("[") & ~following.contains("[") & following.endswith("]") & (i + 1 < n)
        bracket = (s.startswith("[") & s.endswith("]")) | half
        at_once = early | front | pystr.isupper(s) | frame
        end = F.lit(False)
        for k in END_KEYWORDS:
            end = end | s.startswith(k)
        return F.struct(s.alias("s"), i.alias("i"), (at_once | modern | bracket).alias("out"), (~at_once & (i >= F.floor(n / 3)) & end).alias("end"))

    judged = df.withColumn("_judged", F.transform(c, judge))
    cut = F.coalesce(F.array_min(F.transform(F.filter("_judged", lambda x: x["end"]), lambda x: x["i"])), n)
    judged = judged.withColumn("_cut", cut)

    def pick(keep: bool):
        def test(x: Column) -> Column:
            good = ~x["out"] & (x["i"] < F.col("_cut"))
            return good if keep else ~good

        return F.transform(F.filter("_judged", test), lambda x: x["s"])

    return judged.withColumns({"kept": pick(True), "rejected": pick(False)}).drop("_judged", "_cut")


def clean_books(df: DataFrame, text: str = "text", separator: str = "\n\n", min_lines: int = 50, min_words: int = 2000) -> DataFrame:
    """Books cleaned section by section; adds ``sections``, ``kept``, ``rejected``, ``clean`` and ``big_enough``.

    Null texts have no sections and are not big enough. Rows, order and all other columns stay.
    """
    body = F.coalesce(strip_marks(F.col(text)), F.lit(""))
    parts = df.withColumn("_raw", F.transform(sections(body, separator), lambda s: F.regexp_replace(s, "\n", " ")))
    parts = parts.withColumn("sections", F.filter(F.transform("_raw", clean_section), lambda s: s.isNotNull())).drop("_raw")
    out = with_removals(parts).withColumn("clean", F.array_join("kept", "\n"))
    return out.withColumn("big_enough", (F.size("kept") >= min_lines) & (pystr.word_count(F.col("clean")) >= min_words))


def early_author(authors: Column, before: int = 1875) -> Column:
    """Whether any author with two years was born before ``before``; false for null."""
    births = F.regexp_extract_all(authors, F.lit(r"\b(\d{4})-\d{4}\b"), F.lit(1))
    return F.coalesce(F.exists(births, lambda y: y.cast("int") < before), F.lit(False))


def target_books(catalog: DataFrame, before: int = 1875) -> DataFrame:
    """Catalog rows that are texts in exactly English by an early author."""
    return catalog.where((F.col("Type") == "Text") & (F.col("Language") == "en") & early_author(F.col("Authors"), before))


def books_in_catalog(books: DataFrame, catalog: DataFrame, before: int = 1875) -> DataFrame:
    """Books whose ``book_id`` the filtered catalog has. Spark broadcasts the ids if they are few."""
    ids = target_books(catalog, before).select(F.col("Text#").alias("book_id")).distinct()
    return books.join(ids, "book_id", "left_semi")


def catalog_totals(books: DataFrame, catalog: DataFrame, before: int = 1875) -> DataFrame:
    """One row: ``n_catalog``, ``n_target``, ``n_found``, ``n_matching``."""
    target = target_books(catalog, before)
    return (
        catalog.agg(F.count(F.lit(1)).alias("n_catalog"))
        .crossJoin(target.agg(F.count(F.lit(1)).alias("n_target")))
        .crossJoin(books.agg(F.count(F.lit(1)).alias("n_found")))
        .crossJoin(books_in_catalog(books, catalog, before).agg(F.count(F.lit(1)).alias("n_matching")))
    )
