"""Queries on texts for training, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import encoding, leak, mojibake, quality, records, repetition, scans
from corpusmill.plans.tables import table
from corpusmill.scratch import Scratch

#: Where a segment comes from: the paper, which begins the issue's name, and the kind of segment.
_NEWS_GROUP = ["paper", "kind"]


def _news_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "news_segments").withColumns(
        {"paper": F.substring_index("issue_id", "-", 1), "kind": F.lower("seg_class")}
    )
    shares = repetition.repeated_share(news.where("seg_id is not null"), "content", ["seg_id", "paper", "kind", "loaded_at"])
    last = shares.groupBy("seg_id").agg(F.max(F.struct("loaded_at", "share", "n_words", "n_repeated", "paper", "kind")).alias("m"))
    return last.select("seg_id", "m.paper", "m.kind", "m.n_words", "m.n_repeated", "m.share")


def _over(shares: DataFrame, group: list[str], scratch: Scratch, **how) -> DataFrame:
    """The rows over their group's threshold. Shares are kept in a table, so that texts are read once."""
    shares = scratch.save(shares)
    limits = repetition.adaptive_thresholds(repetition.share_sketches(shares, group), group, **how)
    return repetition.over_threshold(shares, limits, group)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of books and segments of papers but titles; the group of a segment is its paper."""
    books = table(spark, sf_dir, "scan_records").select(F.lit("scan_records").alias("tab"), "rec_id", F.col("file_name").alias("grp"), "title", "text")
    news = table(spark, sf_dir, "news_segments").where(~F.lower(F.coalesce("seg_class", F.lit(""))).eqNullSafe("title"))
    papers = news.select(F.lit("news_segments").alias("tab"), F.col("seg_id").alias("rec_id"), F.substring_index("issue_id", "-", 1).alias("grp"), F.lit(None).cast("string").alias("title"), F.col("content").alias("text"))
    return books.union(papers).where("rec_id is not null")


#: Tables with texts of mixed quality: key and text.
_MIXED = {"documents": ("doc_id", "text"), "news_segments": ("seg_id", "content")}


def _records(spark: SparkSession, sf_dir: str, *tabs: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).alias("rec_id"), F.col(c).alias("text")).where("rec_id is not null") for t, (k, c) in _MIXED.items() if t in tabs]
    return reduce(DataFrame.union, parts)


def _quality(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """The one model of text quality, of both tables."""
    return quality.train(_records(spark, sf_dir, *_MIXED), table(spark, sf_dir, "quality_labels"), quality.common_words(table(spark, sf_dir, "documents")))


def _cases(probability: DataFrame) -> DataFrame:
    return probability.where("n_tokens >= 12 and probability >= 0.5").select("tab", "rec_id").distinct()


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.text_statistics(docs, ["doc_id"], "text", quality.common_words(docs))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that need no list of words."""
    return quality.text_statistics(table(spark, sf_dir, "documents"), ["doc_id"], "text", frozenset()).select("doc_id", "n_tokens", "mean_word_length", "symbol_ratio", "comma_ratio", "end_stop_lines", "tokens_per_line")


def p5_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(quality.common_words(table(spark, sf_dir, "documents")))], "word string")


def p5_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.structure_probability(_records(spark, sf_dir, *_MIXED), _quality(spark, sf_dir))


def p5_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: records that trained and calibrated the model, and how many of those held out agree with their label."""
    m = _quality(spark, sf_dir)
    return spark.createDataFrame([(m.n_trained, m.n_calibrated, m.n_held_out, m.n_agree)], "n_trained bigint, n_calibrated bigint, n_held_out bigint, n_agree bigint")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(p5_probability(spark, sf_dir))


def _noise(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, scans.Editor, DataFrame]:
    """Pages, what was read on them, their furniture, the editor, and the misreadings of words it doesn't know."""
    scratch = Scratch(spark, "scans")
    pages = _pages(spark, sf_dir)
    counts = scratch.save(scans.word_counts(pages))
    editor = scans.train_editor(counts)
    lexicon = scratch.save(scans.rare_misreadings(counts, editor))
    read = scratch.save(scans.read_pages(pages, editor))
    rows = scratch.save(scans.furniture_rows(read))
    return pages, read, scans.classify_lines(rows, scans.train_furniture(rows)), editor, lexicon


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, read, furniture, _, lexicon = _noise(spark, sf_dir)
    structure = _cases(quality.structure_probability(_records(spark, sf_dir, "news_segments"), _quality(spark, sf_dir)))
    return scans.noise_kinds(read, furniture, scans.rare_hits(read, lexicon)).join(structure, ["tab", "rec_id"], "left_anti")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _, furniture, editor, lexicon = _noise(spark, sf_dir)
    return scans.repair_pages(pages, furniture, editor, scans.rare_hits(scans.rare_words(pages, editor), lexicon))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _news_shares(spark, sf_dir).select("seg_id", "n_words", "n_repeated")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds are kept at 0.3 at most, as a case is defined by that share; on what they let through it is checked itself."""
    over = _over(_news_shares(spark, sf_dir), _NEWS_GROUP, Scratch(spark, "repetition"), most=0.3)
    return over.where("n_repeated * 10 >= n_words * 3 and n_words > 0").select("seg_id")


def p2_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over the threshold of their own language and source, wherever that lies."""
    docs = table(spark, sf_dir, "documents").withColumns({"language": F.lower(F.coalesce("lang", F.lit("und"))), "origin": F.coalesce("source", F.lit("none"))})
    shares = repetition.repeated_share(docs, "text", ["doc_id", "language", "origin"])
    return _over(shares, ["language", "origin"], Scratch(spark, "repetition")).select("doc_id", "language", "origin", "n_words", "n_repeated", "threshold")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents that were edited and encoded around the edits, and those whose ids aren't those of the whole text."""
    return encoding.edit_check(table(spark, sf_dir, "documents")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("same")).alias("n_different"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twenty words of an item in sequence, none of them changed: a part of p9_found."""
    got = leak.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), error=21)
    return got.select("doc_id", "item_id").distinct()


def p9_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_encoding(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = records.QUERIES | {f.__name__: f for f in (p1_found, p1_repaired, p5_found, p5_probability, p5_statistics, p5_counts, p5_common_words, p5_held_out, p2_found, p2_shares, p2_adaptive, p8_ids, p8_edited, p9_found, p9_spans, p9_exact, p9_removed, p10_found, p10_restored)}

def _shares(last: str, key: str) -> str:
    return f"""
WITH last AS ({last}),
w AS (SELECT {key}, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM last WHERE k = 1),
g AS (SELECT {key}, i, row_number() OVER (PARTITION BY {key}, array_to_string(w[i:i + 3], ' ') ORDER BY i) AS nth
FROM (SELECT {key}, w, unnest(range(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT {key}, count(DISTINCT p) AS n FROM (SELECT {key}, unnest(range(i, i + 4)) AS p FROM g WHERE nth > 1) GROUP BY {key}),
shares AS (SELECT w.{key}, len(w.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_repeated FROM w LEFT JOIN r USING ({key}))"""


_SHARES = _shares("SELECT seg_id, content, row_number() OVER (PARTITION BY seg_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM news_segments WHERE seg_id IS NOT NULL", "seg_id")
_ADAPTIVE = f"""{_shares("SELECT doc_id, text AS content, 1 AS k FROM documents", "doc_id")},
grouped AS (SELECT s.*, lower(coalesce(lang, 'und')) AS language, coalesce(source, 'none') AS origin, n_repeated / greatest(n_words, 1)::DOUBLE AS share FROM shares s JOIN documents USING (doc_id)),
sketch AS (SELECT language, origin, floor(share * 1000)::INTEGER AS bin, count(*) AS n FROM grouped GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY language, origin ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY language, origin) AS whole FROM sketch),
limits AS (SELECT language, origin, greatest(0.05::DOUBLE, least(1.0::DOUBLE, min(bin) / 1000.0::DOUBLE)) AS threshold FROM run WHERE cum >= whole * 0.9::DOUBLE GROUP BY language, origin)"""
_WS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
_TOKENS = f"list_filter(regexp_split_to_array({{0}}, '[{_WS}]+'), lambda w: w <> '')".replace("{85}", "{{85}}").replace("{Z}", "{{Z}}")
_WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '{1}', '\1\2', 'g'), '{1}', '\1\2', 'g')), '[\p{{L}}\p{{N}}]+')"
_DIVIDED = r"([\p{L}\p{N}])[-¬\x{AD}‐‑=][\t-\r\x1c-\x1f\x{85}\p{Z}]*\n[\t-\r\x1c-\x1f\x{85}\p{Z}]*([\p{L}\p{Nl}\p{No}])"
SQL = records.SQL | {
    "p2_shares": f"{_SHARES} SELECT seg_id, n_words, n_repeated FROM shares",
    "p5_counts": rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, t, {_TOKENS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: len({_TOKENS.format("x")}) > 0) AS ls FROM t),
c AS (SELECT doc_id, t, len(w)::DOUBLE AS n, len(ls)::DOUBLE AS n_lines, greatest(1, length(t) - (length(t) - length(replace(replace(t, ' ', ''), chr(10), ''))))::DOUBLE AS chars,
len(list_filter(ls, lambda x: regexp_matches(x, '[.!?,;:”"''’)-][{_WS}]*$')))::DOUBLE AS stops, length(t) - length(regexp_replace(t, '[|*■•^~<>{{}}\[\]\\=_+/&%#@$]', '', 'g')) AS symbols, length(t) - length(replace(t, ',', '')) AS commas FROM l)
SELECT doc_id, n AS n_tokens, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE chars / greatest(n, 1) END AS mean_word_length, symbols / chars AS symbol_ratio, commas / greatest(n, 1) AS comma_ratio, stops / greatest(n_lines, 1) AS end_stop_lines, greatest(n, 1) / greatest(n_lines, 1) AS tokens_per_line FROM c""",
    "p5_common_words": r"""WITH d AS (SELECT doc_id, lower(trim(lang)) AS lang, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
n AS (SELECT lang, count(*) AS docs, sum(count(*)) OVER () AS whole FROM d GROUP BY lang),
c AS (SELECT lang, w, count(*) AS k FROM (SELECT lang, unnest(w) AS w FROM d) GROUP BY lang, w)
SELECT DISTINCT w AS word FROM c JOIN n USING (lang) WHERE k >= docs * 0.4::DOUBLE AND docs >= 0.01::DOUBLE * whole""".replace("\\\\", "\\"),
    "p2_adaptive": f"{_ADAPTIVE} SELECT doc_id, g.language, g.origin, n_words, n_repeated, threshold FROM grouped g JOIN limits l ON l.language = g.language AND l.origin = g.origin WHERE share >= threshold",
    "p8_edited": "SELECT count(*) AS n_docs, 0::BIGINT AS n_different FROM documents",
    "p9_exact": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text", _DIVIDED)} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("text", _DIVIDED)} AS w FROM eval_items),
runs AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 19], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, array_to_string(w[k:k + 19], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d)) JOIN runs USING (r)""",
    "p2_found": f"{_SHARES} SELECT seg_id FROM shares WHERE n_words > 0 AND n_repeated * 10 >= n_words * 3",
}
