"""Cleaning of scanned books, newspaper segments and corrected articles, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import pystr


def _occurrences(s: Column, piece: str) -> Column:
    return F.regexp_count(s, F.lit(piece))


# ---------------------------------------------------------------- scanned books


def scan_line(line: Column) -> Column:
    """A line of a scanned book by the line rules; null if it is to go."""
    # Runs of marks that leaders and rules are made of.
    letters = F.regexp_replace(line, f"[^{pystr.WORD}]", "")
    gone = pystr.isupper(letters) | (_occurrences(line, "- - -") > 1) | (_occurrences(line, r"\. \. \. \.") > 2)
    halves = F.split(line, r"(?U)\b\d{1,3}\b", 2)
    right = F.get(halves, 1)
    body = F.when(F.length(right) > F.length(F.get(halves, 0)), right).otherwise(line)
    w = pystr.words(body)
    first = F.get(F.filter(F.transform(w, lambda x, i: F.when(~pystr.isupper(x), i)), lambda i: i.isNotNull()), 0)
    rest = F.slice(w, F.coalesce(first, F.size(w)) + 1, F.size(w) + 1)
    plain = F.transform(F.filter(rest, lambda x: ~x.contains("^")), lambda x: F.regexp_replace(x, "[»•«■]", ""))
    out = pystr.squeeze(F.array_join(plain, " "))
    return F.when(~gone & (out != ""), out)


def without_catchwords(lines: Column) -> Column:
    """Lines without a last word that the next line begins with; a line may become empty."""

    def edit(s: Column, i: Column) -> Column:
        w = F.filter(F.split(s, " "), lambda x: x != "")
        nxt = F.get(F.filter(F.split(F.coalesce(F.get(lines, i + 1), F.lit("")), " "), lambda x: x != ""), 0)
        same = F.try_element_at(w, F.lit(-1)) == nxt
        return F.when(F.coalesce(same, F.lit(False)), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ")).otherwise(s)

    return F.transform(lines, edit)


def clean_scans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines``, the clean lines of each page or book; null texts have none."""
    parts = F.coalesce(pystr.lines(F.col(text)), F.array().cast("array<string>"))
    df = df.withColumn("_lines", F.filter(F.transform(parts, scan_line), lambda s: s.isNotNull()))
    return df.withColumn("lines", without_catchwords(F.col("_lines"))).drop("_lines")


def truthy_languages(languages: Column) -> Column:
    """Values of the language map that are set."""
    return F.map_values(F.map_filter(languages, lambda k, v: v.isNotNull() & (v != "")))


def assemble_scans(records: DataFrame, language: str | None = "English", min_pages: int = 100) -> DataFrame:
    """``file_name``, ``n_pages``, ``text`` and the metadata of a file's first record: ``record_id``, ``author_name``, ``title``, ``publisher``, ``physical_description``, ``languages``.

    The language is that of a file's first record alone, and a file in several languages is left out. Pages
    without text don't count. Records delivered again count once, the last delivery. ``None`` takes all languages.
    """
    meta = [c for c in ("record_id", "author_name", "title", "publisher", "physical_description") if c in records.columns]
    last = records.where("file_name is not null").groupBy("file_name", "rec_idx").agg(
        F.max_by(F.struct(*meta, "language_map", "multi_language", "text"), F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")), "rec_id")).alias("r")
    )
    page = F.when(F.col("r.text") != "", F.struct("rec_idx", F.col("r.text").alias("text")))
    names = F.coalesce(truthy_languages(F.col("r.language_map")), F.array().cast("array<string>"))
    first = F.struct(*[F.col(f"r.{c}") for c in meta], names.alias("languages"), F.coalesce("r.multi_language", F.lit(False)).alias("multi"))
    books = last.groupBy("file_name").agg(F.min_by(first, "rec_idx").alias("first"), F.sort_array(F.collect_list(page)).alias("pages"))
    out = books.select(
        "file_name", *[f"first.{c}" for c in (*meta, "languages")], F.col("first.multi").alias("multi"), F.size("pages").cast("bigint").alias("n_pages"),
        F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"),
    ).where(F.col("n_pages") >= min_pages)
    if language is not None:
        out = out.where(F.array_contains("languages", language) & ~F.col("multi"))
    return out.drop("multi")


# ---------------------------------------------------------------- newspapers


def keeps_sentence(s: Column, before: Column) -> Column:
    """Whether a newspaper sentence stays; ``before`` is the raw sentence before it, kept or not."""
    w = pystr.words(s)
    n = F.size(w)
    start = F.array_join(F.slice(w, F.lit(1), F.lit(5)), " ")
    old = F.array_join(F.slice(pystr.words(F.coalesce(before, F.lit(""))), F.lit(1), F.lit(5)), " ")
    unique = F.array_distinct(w)
    mode = F.array_max(F.transform(unique, lambda x: F.size(w) - F.size(F.array_remove(w, x))))
    # Runs of marks that leaders and rules are made of.
    leaders = s.contains(".......") | s.contains("- - - - - - - - - - - ") | (_occurrences(s, r"\.\.\.") > 2)
    repeated = ((n > 5) & (mode > F.floor(n / 2))) | ((n > 20) & (F.size(unique) < F.floor(n / 5)))
    return ~(leaders | (n < 8) | (start == old) | F.coalesce(repeated, F.lit(False)) | pystr.isupper(s) | ~s.rlike("[A-Za-z]"))


def clean_segments(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``sentences``, the lines of a segment that stay; null and empty contents have none."""
    df = df.withColumn("_raw", F.coalesce(pystr.lines(F.col(content)), F.array().cast("array<string>")))
    kept = F.filter("_raw", lambda s, i: keeps_sentence(s, F.when(i > 0, F.get(F.col("_raw"), i - 1))))
    return df.withColumn("sentences", kept).drop("_raw")


def issue_lines(segments: DataFrame) -> DataFrame:
    """``issue_id``, ``place``, ``sentences``: the clean lines of each segment of titles and texts, with its place in reading order.

    Segments delivered again count once, the last delivery. Rows stay segments, so an issue that holds most of the
    table is spread like any other.
    """
    last = segments.where("issue_id is not null and seg_id is not null").groupBy("seg_id").agg(
        F.max_by(F.struct("issue_id", "page_number", "block_no", "col_no", "reading_order", "seg_class", "content"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))).alias("r")
    ).select("seg_id", "r.*")
    own = clean_segments(last.where(F.col("seg_class").isin("title", "text")))
    return own.select("issue_id", F.struct("page_number", "block_no", "col_no", "reading_order", "seg_id").alias("place"), "sentences")


def issue_sizes(lines: DataFrame, min_lines: int = 10, min_words: int = 2000) -> DataFrame:
    """``issue_id``, ``n_lines``, ``n_words`` of issues with at least ``min_lines`` lines and more than ``min_words`` words; partial sums before the shuffle."""
    n_words = F.aggregate("sentences", F.lit(0).cast("bigint"), lambda n, s: n + pystr.word_count(s))
    sized = lines.groupBy("issue_id").agg(F.sum(F.size("sentences")).cast("bigint").alias("n_lines"), F.sum(n_words).cast("bigint").alias("n_words"))
    return sized.where((F.col("n_lines") >= min_lines) & (F.col("n_words") > min_words))


def assemble_issues(lines: DataFrame, sizes: DataFrame, most_lines: int) -> DataFrame:
    """``issue_id``, ``n_lines``, ``n_words``, ``text``: issues of at most ``most_lines`` lines as one text each, in reading order.

    An issue's text is one row, so it is built in one task; how large that may be is for the caller to say. Larger
    issues have no text here: their lines are the rows of :func:`issue_lines`.
    """
    wanted = lines.join(sizes.where(F.col("n_lines") <= most_lines), "issue_id")
    issues = wanted.groupBy("issue_id", "n_lines", "n_words").agg(F.sort_array(F.collect_list(F.struct("place", "sentences"))).alias("parts"))
    text = F.array_join(F.flatten(F.transform("parts", lambda p: p["sentences"])), "\n")
    return issues.select("issue_id", "n_lines", "n_words", text.alias("text"))


def issue_name(file: Column, issue: Column) -> Column:
    """``file_article-issue``: the name of an issue's text."""
    return F.concat(file, F.lit("_article-"), issue.cast("string"))


# ---------------------------------------------------------------- corrected articles


def clean_articles(df: DataFrame, text: str = "text", line_words: int = 8, min_lines: int = 10, min_words: int = 500) -> DataFrame:
    """Adds ``lines`` and ``big_enough``: lines of more than ``line_words`` words, no capitals, each once, in order."""
    parts = F.transform(F.coalesce(pystr.lines(F.col(text)), F.array().cast("array<string>")), pystr.strip)
    kept = F.filter(parts, lambda s: (s != "") & ~pystr.isupper(s) & (F.size(pystr.words(s)) > line_words))
    df = df.withColumn("lines", F.array_distinct(kept))
    return df.withColumn("big_enough", (F.size("lines") >= min_lines) & (pystr.word_count(F.array_join("lines", "\n")) > min_words))


def article_name(source: str, index: Column) -> Column:
    """``source-000012``; longer numbers stay whole."""
    return F.format_string(f"{source}-%06d", index)
