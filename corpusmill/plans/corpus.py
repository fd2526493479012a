"""Queries of cleaning, duplicate search, split and packing on the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import pystr
from corpusmill.operators import books, fingerprint, neardup, pages, training
from corpusmill.plans.tables import table
from corpusmill.scratch import Scratch

CONTEXT = 4096


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(_docs(spark, sf_dir))


def _saved(spark: SparkSession, sf_dir: str) -> tuple[Scratch, DataFrame]:
    scratch = Scratch(spark, "neardup")
    return scratch, scratch.save(_prints(spark, sf_dir))


def _saved_representatives(spark: SparkSession, sf_dir: str) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch, prints = _saved(spark, sf_dir)
    return scratch, prints, scratch.save(neardup.representatives(prints))


def _links(spark: SparkSession, sf_dir: str) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch, prints = _saved(spark, sf_dir)
    return scratch, prints, scratch.save(neardup.accepted_pairs(prints, _docs(spark, sf_dir), scratch))


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fingerprint.normalize(F.col("text")).alias("norm"))


def min_length_filter(spark, sf_dir):
    norm = normalize_text(spark, sf_dir)
    return norm.where(F.length("norm") >= 200).select("doc_id", F.length("norm").cast("bigint").alias("chars"))


def word_and_line_counts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", pystr.word_count(t).alias("n_words"), pystr.line_count(t).alias("n_lines"))


def exact_dup_groups(spark, sf_dir):
    return neardup.exact_groups(fingerprint.content_hashes(_docs(spark, sf_dir))).where("n_docs > 1")


def fingerprint_status(spark, sf_dir):
    return fingerprint.status_counts(_docs(spark, sf_dir))


def simhash_fingerprint(spark, sf_dir):
    return _prints(spark, sf_dir).select("doc_id", F.col("chars").cast("bigint").alias("chars"), "simhash", "sha1", fingerprint.to_hex(F.col("simhash")).alias("hex"))


def lsh_bands(spark, sf_dir):
    return neardup.bands(_prints(spark, sf_dir)).select("doc_id", "band", "band_value")


def bucket_histogram(spark, sf_dir):
    return neardup.bucket_histogram(neardup.bands(_prints(spark, sf_dir)))


def bucket_report(spark, sf_dir):
    return neardup.bucket_report(neardup.bands(_prints(spark, sf_dir)))


def top_buckets(spark, sf_dir):
    return neardup.bucket_sizes(neardup.bands(_prints(spark, sf_dir))).orderBy(F.desc("k"), "band", "band_value").limit(20)


def dedup_manifest(spark, sf_dir):
    from corpusmill.sources.writers import manifest

    _, prints = _saved(spark, sf_dir)
    return manifest(prints, neardup.bucket_sizes(neardup.bands(prints)))


def near_dup_matches(spark, sf_dir):
    return neardup.candidate_pairs(_saved_representatives(spark, sf_dir)[2])


def match_statistics(spark, sf_dir):
    degrees = neardup.pair_degrees(_saved_representatives(spark, sf_dir)[2])
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pairs", "n_near")]
    return degrees.agg(*total, F.min("least").alias("least"), F.count(F.lit(1)).alias("n_docs"))


def shingle_counts(spark, sf_dir):
    return neardup.shingles(_docs(spark, sf_dir)).select("doc_id", F.size("s").cast("bigint").alias("n_shingles"))


def accepted_matches(spark, sf_dir):
    links = _links(spark, sf_dir)[2]
    return links.select("a", "b", "distance", "simhash_similarity", F.round("word_shingle_jaccard", 6).alias("jaccard"), F.round("word_shingle_containment", 6).alias("containment"), "len_shingles_a", "len_shingles_b")


def match_rows(spark, sf_dir):
    _, prints, links = _links(spark, sf_dir)
    docs = _docs(spark, sf_dir).select("doc_id", "path", "source")
    out = neardup.match_rows(neardup.match_rows(links, prints, ("chars", "simhash", "sha1")), docs, ("path", "source"))
    return out.select("a", "b", *[f"{c}_{s}" for c in ("path", "source", "chars", "simhash", "sha1") for s in "ab"], "simhash_similarity", F.round("word_shingle_jaccard", 6).alias("word_shingle_jaccard"))


def removal_rule(spark, sf_dir):
    """Accepted pairs that the removal rule takes, and those that a stricter containment would leave."""
    links = _links(spark, sf_dir)[2]
    return neardup.to_remove(links).select("a", "b", (F.col("word_shingle_containment") >= 0.99).alias("nearly_whole"))


def near_dup_classes(spark, sf_dir):
    """Classes of texts whose sets of five words have a Jaccard similarity of 0.8."""
    return neardup.near_duplicate_classes(_docs(spark, sf_dir), Scratch(spark, "classes"))


def accepted_counts(spark, sf_dir):
    """How many pairs each acceptance mode takes."""
    scratch, prints = _saved(spark, sf_dir)
    return neardup.acceptance_counts(prints, _docs(spark, sf_dir), scratch)


def dup_components(spark, sf_dir):
    scratch, prints, links = _links(spark, sf_dir)
    return neardup.duplicate_groups(prints, links, scratch).select("doc_id", "component", F.col("chars").cast("bigint").alias("chars"), "keep")


def keep_longest(spark, sf_dir):
    return dup_components(spark, sf_dir).where("keep").select("component", "doc_id", "chars")


def dedup_corpus(spark, sf_dir):
    return neardup.deduplicated(_docs(spark, sf_dir), Scratch(spark, "dedup")).select("doc_id", "source")


def section_flags(spark, sf_dir):
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(books.sections(F.coalesce(pystr.newlines(F.col("text")), F.lit("")), "\n")).alias("pos", "s"))
    s = F.col("s")
    return parts.select(
        "doc_id", "pos", books.is_toc_line(s).alias("toc"), books.is_chapter_line(s).alias("chapter"), books.ends_with_number(s).alias("page_number"),
        books.has_email(s).alias("email"), books.starts_with_roman(s).alias("roman"), pystr.isupper(s).alias("upper"),
    )


def _books(spark, sf_dir):
    return books.clean_books(_docs(spark, sf_dir).select("doc_id", "text"), separator="\n", min_lines=5, min_words=200)


def book_sections(spark, sf_dir):
    return _books(spark, sf_dir).select("doc_id", F.posexplode("sections").alias("pos", "section"))


def book_kept(spark, sf_dir):
    return _books(spark, sf_dir).select("doc_id", F.array_join("kept", "\n").alias("kept"), "big_enough")


def book_rejected(spark, sf_dir):
    return _books(spark, sf_dir).select("doc_id", F.size("rejected").cast("bigint").alias("n_rejected"), F.array_join("rejected", "\n").alias("rejected"))


def scan_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "scan_records").select("rec_id", "text").distinct()
    return pages.clean_scans(rows).select("rec_id", F.array_join("lines", "\n").alias("clean"))


def books_by_default(spark, sf_dir):
    """The book rules with their own limits: sections between blank lines, 50 of them and 2,000 words."""
    out = books.clean_books(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("kept").cast("bigint").alias("n_kept"), F.md5("clean").alias("digest"), F.size("rejected").cast("bigint").alias("n_rejected"), "big_enough")


def excluded_works(spark, sf_dir):
    """Documents without those of two excluded works, the smallest names of the table."""
    docs = _docs(spark, sf_dir).select("doc_id", "work_id")
    return neardup.without_excluded(docs, docs.where("work_id is not null").select("work_id").distinct().orderBy("work_id").limit(2), "work_id").select("doc_id")


def tokenizer_lines(spark, sf_dir):
    """Texts as a tokenizer reads them, line ends replaced by blanks."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(training.without_newlines(F.coalesce("text", F.lit("")))).alias("digest"))


def scan_books(spark, sf_dir):
    out = pages.assemble_scans(table(spark, sf_dir, "scan_records"), min_pages=20)
    return out.select("file_name", "record_id", "author_name", "publisher", "physical_description", "title", "n_pages", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def news_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "news_segments").select("seg_id", "content").distinct()
    return pages.clean_segments(rows).select("seg_id", F.array_join("sentences", "\n").alias("clean"))


def news_issues(spark, sf_dir):
    """Issues as texts; a million lines is the most that one row may hold."""
    lines = Scratch(spark, "issues").save(pages.issue_lines(table(spark, sf_dir, "news_segments")))
    out = pages.assemble_issues(lines, pages.issue_sizes(lines), 1_000_000)
    return out.select("issue_id", pages.issue_name(F.lit("news"), F.col("issue_id")).alias("name"), "n_lines", "n_words", F.md5("text").alias("digest"))


def news_issue_sizes(spark, sf_dir):
    return pages.issue_sizes(pages.issue_lines(table(spark, sf_dir, "news_segments")))


def ocr_clean(spark, sf_dir):
    return pages.clean_articles(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.array_join("lines", "\n").alias("clean"), "big_enough")


def val_split(spark, sf_dir):
    return training.stratified_split(_docs(spark, sf_dir).select("doc_id", "source")).select("doc_id", "source", "split")


def split_counts(spark, sf_dir):
    return training.split_counts(val_split(spark, sf_dir))


def sampled_documents(spark, sf_dir):
    return training.sampled(_docs(spark, sf_dir).select("doc_id"), 100, 123)


def _seqs(spark, sf_dir):
    return table(spark, sf_dir, "token_files")


def packed_blocks(spark, sf_dir):
    return training.pack_blocks(_seqs(spark, sf_dir), CONTEXT).select("block", F.md5(F.array_join("input_ids", ",")).alias("digest"), F.array_join("file_names", "|").alias("names"))


def packed_shuffled(spark, sf_dir):
    """Blocks of the sequences in keyed order, as for training."""
    out = training.pack_blocks(training.in_keyed_order(_seqs(spark, sf_dir), 123), CONTEXT)
    return out.select("block", F.md5(F.array_join("input_ids", ",")).alias("digest"))


def pack_totals(spark, sf_dir):
    return training.pack_totals(_seqs(spark, sf_dir), CONTEXT)


def validate_packed(spark, sf_dir):
    return training.validate_rows(training.pack_blocks(_seqs(spark, sf_dir), CONTEXT), CONTEXT)


def shifted_rows(spark, sf_dir):
    out = training.shifted(training.pack_blocks(_seqs(spark, sf_dir), CONTEXT), CONTEXT)
    h = lambda c: F.md5(F.array_join(c, ","))
    return out.select("block", h("inputs").alias("inputs"), h("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask"))


def repeated_rows(spark, sf_dir):
    rows = Scratch(spark, "packed").save(training.pack_blocks(_seqs(spark, sf_dir), CONTEXT).select("block", F.element_at("input_ids", 1).cast("bigint").alias("first")))
    return training.repeated_rows(rows, 500)


def training_plan(spark, sf_dir):
    n = F.col("n_blocks")
    return pack_totals(spark, sf_dir).select(
        "n_blocks", training.steps_per_epoch(n, 4, 16).alias("steps"), F.lit(4 * 16 * CONTEXT).cast("bigint").alias("tokens_per_step"),
        training.enough_tokens(n, CONTEXT, 2, 4, 16).alias("enough"), F.round(training.perplexity(n / 100.0), 6).alias("perplexity"),
    )


def chat_render(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items")
    turns = items.select(F.col("item_id").alias("conv_id"), F.posexplode(F.array(F.struct(F.lit("user").alias("role"), "text"), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("turn", "m")).select("conv_id", "turn", "m.*")
    return training.render_chat(turns, generation_prompt=True)


def tokenizer_round_trip(spark, sf_dir):
    """One row: texts, and those that a public tokenizer doesn't give back."""
    out = training.round_trip(_docs(spark, sf_dir), f"{training.TOKENIZERS}/byte_bpe_50k.json")
    return out.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("same")).alias("n_changed"))


def encoded_ends(spark, sf_dir):
    """The last id of every text with the end of text appended."""
    file = f"{training.TOKENIZERS}/byte_bpe_50k.json"
    ids = training.encode(_docs(spark, sf_dir), file, end=training.special_ids(file)[training.END_OF_TEXT])
    return ids.select("doc_id", F.element_at("ids", -1).cast("bigint").alias("last_id"))


def data_stages(spark, sf_dir):
    """Two stages of training: rows of the first tenth of the steps, and the rest."""
    rows = training.pack_blocks(_seqs(spark, sf_dir), CONTEXT).select("block")
    return training.staged(rows, [0.1, 0.9])


def pretoken_counts(spark, sf_dir):
    return training.pretoken_counts(_docs(spark, sf_dir))


def bpe_pair_counts(spark, sf_dir):
    return training.pair_counts(pretoken_counts(spark, sf_dir))


_LOCAL = [
    fingerprint_status, match_rows, removal_rule, near_dup_classes, books_by_default, excluded_works, tokenizer_lines, news_issue_sizes, packed_shuffled, data_stages, tokenizer_round_trip, encoded_ends,
    normalize_text, min_length_filter, word_and_line_counts, exact_dup_groups, simhash_fingerprint, lsh_bands, bucket_histogram, bucket_report, top_buckets, dedup_manifest, near_dup_matches, match_statistics,
    shingle_counts, accepted_matches, accepted_counts, dup_components, keep_longest, dedup_corpus, section_flags, book_sections, book_kept, book_rejected, scan_clean, scan_books, news_clean, news_issues,
    ocr_clean, val_split, split_counts, sampled_documents, packed_blocks, pack_totals, validate_packed, shifted_rows, repeated_rows, training_plan, chat_render, pretoken_counts, bpe_pair_counts,
]
QUERIES = {f.__name__: f for f in _LOCAL}

# ---------------------------------------------------------------- SQL

WS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda w: w <> '')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def _lines(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '\r\n?', chr(10), 'g'), chr(10))"


def _upper(c: str) -> str:
    return rf"(regexp_matches({c}, '\p{{Lu}}') AND NOT regexp_matches({c}, '[\p{{Ll}}\p{{Lt}}ªº]'))"


def _count(c: str, piece: str) -> str:
    return f"((length({c}) - length(replace({c}, '{piece}', ''))) // {len(piece)})"


_NORM = f"""norm AS (SELECT doc_id, array_to_string({_words(rf"lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_,.?!\-&{WS}]', '', 'g'))")}, ' ') AS norm FROM documents)"""
_PRINTS = f"""{_NORM},
long AS (SELECT doc_id, norm, length(norm) AS chars, sha1(norm) AS sha1 FROM norm WHERE length(norm) >= 200),
tok AS (SELECT doc_id, md5(w) AS m FROM (SELECT doc_id, unnest(string_split(norm, ' ')) AS w FROM long)),
half AS (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT AS hi, ('0x' || substr(m, 9, 8))::BIGINT AS lo FROM tok),
bits AS (SELECT doc_id, i, sum(CASE WHEN (hi >> i) & 1 = 1 THEN 1 ELSE -1 END) AS hi, sum(CASE WHEN (lo >> i) & 1 = 1 THEN 1 ELSE -1 END) AS lo FROM half, range(32) r(i) GROUP BY doc_id, i),
packed AS (SELECT doc_id, sum(CASE WHEN hi >= 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN lo >= 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS lo FROM bits GROUP BY doc_id),
prints AS (SELECT doc_id, chars, sha1, (hi - CASE WHEN hi >= 2147483648 THEN 4294967296 ELSE 0 END) * 4294967296 + lo AS simhash, hi, lo, norm FROM long JOIN packed USING (doc_id))"""
_BANDS = f"""{_PRINTS},
banded AS (SELECT doc_id, b::INTEGER AS band, CASE b WHEN 0 THEN lo & 65535 WHEN 1 THEN lo >> 16 WHEN 2 THEN hi & 65535 ELSE hi >> 16 END AS band_value, hi, lo FROM prints, range(4) r(b)),
buckets AS (SELECT band, band_value, count(*) AS k FROM banded GROUP BY band, band_value)"""
_PAIRS = f"""{_BANDS},
rep AS (SELECT min(doc_id) AS doc_id FROM prints GROUP BY sha1),
rb AS (SELECT * FROM banded JOIN rep USING (doc_id)),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::BIGINT AS distance
FROM rb x JOIN rb y ON x.band = y.band AND x.band_value = y.band_value AND x.doc_id < y.doc_id WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 9)"""
_SHINGLES = "sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 5)) AS i FROM (SELECT doc_id, string_split(norm, ' ') AS w FROM {0})))"
_SCORES = f"""{_PAIRS},
{_SHINGLES.format("long")},
ns AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id HAVING count(*) >= 10),
common AS (SELECT a, b, count(*) AS i FROM pairs JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s WHERE distance <= 6 GROUP BY a, b),
scored AS (SELECT p.a, p.b, distance, 1.0::DOUBLE - distance / 64.0::DOUBLE AS simhash_similarity, coalesce(i, 0) / (x.n + y.n - coalesce(i, 0))::DOUBLE AS jaccard, coalesce(i, 0) / least(x.n, y.n)::DOUBLE AS containment, x.n AS na, y.n AS nb
FROM pairs p JOIN ns x ON x.doc_id = p.a JOIN ns y ON y.doc_id = p.b LEFT JOIN common c ON c.a = p.a AND c.b = p.b WHERE distance <= 6),
links AS (SELECT * FROM scored WHERE jaccard >= 0.9 OR containment >= 0.95)"""
_COMPONENTS = f"""{_SCORES},
edges AS (SELECT a AS x, b AS y FROM links UNION SELECT r, doc_id FROM prints JOIN (SELECT sha1, min(doc_id) AS r FROM prints GROUP BY sha1) USING (sha1) WHERE r <> doc_id),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x AS id, y AS to_id FROM both_ways UNION SELECT r.id, e.y FROM reach r JOIN both_ways e ON e.x = r.to_id),
comp AS (SELECT id AS doc_id, least(id, min(to_id)) AS component FROM reach GROUP BY id),
sized AS (SELECT doc_id, component, chars, row_number() OVER (PARTITION BY component ORDER BY chars DESC, doc_id) = 1 AS keep FROM comp JOIN prints USING (doc_id))"""

_START = books.START_MARK.replace("(?md)", "(?m)")
_END = books.END_MARK.replace("(?md)", "(?m)")
_BODY = _strip(f"regexp_split_to_array(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '{_START}')[-1], '{_END}')[1]")
_LONG = "regexp_replace(regexp_replace(replace({0}, '---', repeat(chr(57344), 3)), chr(57344) || '-', chr(57344) || chr(57344), 'g'), chr(57344) || '-', chr(57344) || chr(57344), 'g')"
_DASHED = f"replace(regexp_replace({_LONG.format('s')}, '[{WS}]?--[{WS}]?', ' -- ', 'g'), chr(57344), '-')"
def _sections(separator: str) -> str:
    return f"""raw AS (SELECT doc_id, i, {_strip("replace(replace(s, chr(10), ' '), '_', '')")} AS s FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_filter(string_split(coalesce({_BODY}, ''), {separator}), lambda s: s <> '') AS p FROM documents))),
dashed AS (SELECT doc_id, i, s, {_DASHED} AS d FROM raw),
parts AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, array_to_string({_words("regexp_replace(d, '\\[[0-9]+\\]', '', 'g')")}, ' ') AS s
FROM dashed WHERE NOT (starts_with(s, '[') AND ends_with(s, ']')) AND regexp_matches(d, '[0-9A-Za-z]') AND NOT starts_with(d, 'End of Project Gutenberg'))"""


_SECTIONS = _sections("chr(10)")
# RE2 has no look-ahead; a numeral is not empty and no lone dot.
_ROMAN = books.ROMAN.replace("(?=[MDCLXVI])", "")
_DIGIT = pystr.DIGITS


def _flags(s: str) -> dict[str, str]:
    first = f"coalesce({_words(s)}[1], '')"
    return {
        "toc": f"(contains({s}, '. . . . .') OR contains({s}, '........'))",
        "chapter": rf"regexp_matches({_strip(f'lower({s})')}, '^(?:chapter|chap\.|chapt\.)')",
        "page_number": f"coalesce(regexp_matches({_words(s)}[-1], '^[{_DIGIT}]+$'), false)",
        "email": r"regexp_matches({0}, '\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}\b')".format(s),
        "roman": f"(regexp_matches({first}, '^[MDCLXVI]') AND regexp_matches({first}, '{_ROMAN}') AND NOT starts_with({_strip(s)}, 'I '))",
        "upper": _upper(s),
    }


_F = _flags("s")
_MODERN = " OR ".join(f"contains(s, '{w}')" for w in books.MODERN_WORDS)
_ENDS = " OR ".join(f"starts_with(s, '{w}')" for w in books.END_KEYWORDS)
def _books_sql(separator: str) -> str:
    return f"""WITH {_sections(separator)},
around AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY pos), '') AS nxt FROM parts),
judged AS (SELECT *, ((pos < 16 AND len({_words("s")}) < 8) OR (pos < greatest(200, n // 8) AND ({" OR ".join(_F[k] for k in ("toc", "chapter", "page_number", "email", "roman"))})) OR {_F["upper"]}
OR contains(s, '+----') OR contains(s, '┌') OR {_count("s", "|")} > 2 OR {_count("s", "│")} > 1) AS at_once,
({_MODERN} OR (starts_with(s, '[') AND ends_with(s, ']')) OR (starts_with(s, '[') AND NOT contains(nxt, '[') AND ends_with(nxt, ']'))) AS later, pos >= n // 3 AND ({_ENDS}) AS last_part FROM around),
cut AS (SELECT doc_id, min(pos) FILTER (last_part AND NOT at_once) AS c FROM judged GROUP BY doc_id),
final AS (SELECT doc_id, pos, s, NOT at_once AND NOT later AND pos < coalesce(c, n) AS keep FROM judged JOIN cut USING (doc_id)),
texts AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER (keep), '') AS kept, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT keep) AS n_rejected, coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER (NOT keep), '') AS rejected FROM final GROUP BY doc_id)"""


_BOOKS = _books_sql("chr(10)")

_SCAN_LINE = f"""SELECT rec_id, i, CASE WHEN length(r) > length(l) THEN r ELSE s END AS s FROM (SELECT *, regexp_extract(s, '^(.*?)\\b\\d{{1,3}}\\b(.*)$', 1) AS l, CASE WHEN regexp_matches(s, '\\b\\d{{1,3}}\\b') THEN regexp_extract(s, '^(.*?)\\b\\d{{1,3}}\\b(.*)$', 2) END AS r FROM lines
WHERE NOT ({_upper(r"regexp_replace(s, '[^\p{L}\p{N}_]', '', 'g')")} OR {_count("s", "- - -")} > 1 OR {_count("s", ". . . .")} > 2))"""
_SCANS = f"""WITH rows AS (SELECT DISTINCT rec_id, text FROM scan_records),
lines AS (SELECT rec_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT rec_id, {_lines("text")} AS p FROM rows)),
halves AS ({_SCAN_LINE}),
cut AS (SELECT rec_id, i, {_words("s")} AS w FROM halves),
rest AS (SELECT rec_id, i, w[coalesce(list_position(list_transform(w, lambda x: NOT {_upper("x")}), true), len(w) + 1):] AS w FROM cut),
clean AS (SELECT rec_id, i, array_to_string({_words("array_to_string(list_transform(list_filter(w, lambda x: NOT contains(x, '^')), lambda x: regexp_replace(x, '[»•«■]', '', 'g')), ' ')")}, ' ') AS s FROM rest),
around AS (SELECT rec_id, i, s, string_split(s, ' ') AS w, string_split(lead(s) OVER (PARTITION BY rec_id ORDER BY i), ' ')[1] AS nxt FROM clean WHERE s <> ''),
done AS (SELECT rec_id, i, CASE WHEN w[-1] = nxt THEN array_to_string(w[:len(w) - 1], ' ') ELSE s END AS s FROM around),
texts AS (SELECT rec_id, string_agg(s, chr(10) ORDER BY i) AS clean FROM done GROUP BY rec_id)"""

_NEWS_RULES = f"""NOT (contains(s, '.......') OR contains(s, '- - - - - - - - - - - ') OR {_count("s", "...")} > 2 OR len(w) < 8 OR array_to_string(w[:5], ' ') = coalesce(array_to_string(prev[:5], ' '), '')
OR (len(w) > 5 AND list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) > len(w) // 2) OR (len(w) > 20 AND len(list_distinct(w)) < len(w) // 5) OR {_upper("s")} OR NOT regexp_matches(s, '[A-Za-z]'))"""


def _news(source: str) -> str:
    return f"""{source},
lines AS (SELECT seg_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT seg_id, {_lines("content")} AS p FROM rows)),
split AS (SELECT seg_id, i, s, {_words("s")} AS w FROM lines),
around AS (SELECT *, lag(w) OVER (PARTITION BY seg_id ORDER BY i) AS prev FROM split),
good AS (SELECT seg_id, i, s, w FROM around WHERE {_NEWS_RULES})"""


_SPLIT = """ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('123:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
split AS (SELECT doc_id, source, CASE WHEN k <= greatest(1, floor(n * 1.0 / 100)) THEN 'val' ELSE 'train' END AS split FROM ranked)"""
_PACK = f"""seqs AS (SELECT seq_id, max(input_ids) AS ids, min(file_name) AS name FROM token_files WHERE len(input_ids) > 0 GROUP BY seq_id),
ids AS (SELECT seq_id, name, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM seqs),
numbered AS (SELECT *, row_number() OVER (ORDER BY seq_id, i) - 1 AS p FROM ids),
blocks AS (SELECT p // {CONTEXT + 1} AS block, list(id ORDER BY p) AS ids FROM numbered GROUP BY 1 HAVING count(*) = {CONTEXT + 1}),
named AS (SELECT block, string_agg(name, '|' ORDER BY p) AS names FROM (SELECT p // {CONTEXT + 1} AS block, name, min(p) AS p FROM numbered GROUP BY 1, 2) GROUP BY block)"""
_TOTALS = f"totals AS (SELECT coalesce(sum(n), 0)::BIGINT AS n_tokens, coalesce(sum(n), 0)::BIGINT // {CONTEXT + 1} AS n_blocks FROM (SELECT seq_id, max(len(input_ids)) AS n FROM token_files GROUP BY seq_id))"
_COUNTS = f"counts AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS w FROM documents) GROUP BY w)"
_OCR_LINES = f"""lines AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_transform({_lines("text")}, lambda l: {_strip("l")}) AS p FROM documents)),
good AS (SELECT doc_id, s, min(i) AS i FROM lines WHERE s <> '' AND NOT {_upper("s")} AND len({_words("s")}) > 8 GROUP BY doc_id, s),
texts AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS clean, count(*) AS n FROM good GROUP BY doc_id)"""

_NEWS_ROWS = _news("WITH last AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM news_segments WHERE issue_id IS NOT NULL), rows AS (SELECT * FROM last WHERE k = 1 AND seg_class IN ('title', 'text'))")
_CLASSES = f"""norm AS (SELECT doc_id, array_to_string({_words(rf"lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_,.?!\-&{WS}]', '', 'g'))")}, ' ') AS norm FROM documents),
copies AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY coalesce(norm, 'null ' || doc_id)) AS rep FROM norm),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, string_split(norm, ' ') AS w FROM copies WHERE rep = doc_id))),
ns AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN ns x ON x.doc_id = a JOIN ns y ON y.doc_id = b WHERE i >= 0.8::DOUBLE * (x.n + y.n - i) - 1e-9),
both_ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach AS (SELECT x AS id, y AS to_id FROM both_ways UNION SELECT r.id, e.y FROM reach r JOIN both_ways e ON e.x = r.to_id),
comp AS (SELECT id, least(id, min(to_id)) AS class_id FROM reach GROUP BY id),
deg AS (SELECT x AS id, count(*) AS n_links FROM both_ways GROUP BY x)"""

SQL = {
    "near_dup_classes": f"WITH RECURSIVE {_CLASSES} SELECT doc_id, coalesce(class_id, rep) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM copies LEFT JOIN comp c ON c.id = rep LEFT JOIN deg d ON d.id = rep",
    "fingerprint_status": f"WITH {_NORM} SELECT CASE WHEN norm IS NULL THEN 'unreadable' WHEN length(norm) < 200 THEN 'too_short' ELSE 'ok' END AS status, count(*) AS n FROM norm GROUP BY 1",
    "match_rows": f"WITH {_SCORES} SELECT l.a, l.b, {', '.join(f'{t}{s}.{c} AS {c}_{s}' for c, t in (('path', 'd'), ('source', 'd'), ('chars', 'p'), ('simhash', 'p'), ('sha1', 'p')) for s in 'ab')}, simhash_similarity, round(jaccard, 6) AS word_shingle_jaccard FROM links l JOIN documents da ON da.doc_id = l.a JOIN documents db ON db.doc_id = l.b JOIN prints pa ON pa.doc_id = l.a JOIN prints pb ON pb.doc_id = l.b",
    "removal_rule": f"WITH {_SCORES} SELECT a, b, containment >= 0.99 AS nearly_whole FROM links WHERE jaccard >= 0.9 OR containment >= 0.9",
    "books_by_default": f"{_books_sql('chr(10) || chr(10)')} SELECT d.doc_id, coalesce(n_kept, 0) AS n_kept, md5(coalesce(kept, '')) AS digest, coalesce(n_rejected, 0) AS n_rejected, coalesce(n_kept >= 50 AND len({_words('kept')}) >= 2000, false) AS big_enough FROM documents d LEFT JOIN texts t USING (doc_id)",
    "excluded_works": "SELECT doc_id FROM documents WHERE work_id IS NULL OR work_id NOT IN (SELECT work_id FROM (SELECT DISTINCT work_id FROM documents WHERE work_id IS NOT NULL) ORDER BY work_id LIMIT 2)",
    "tokenizer_lines": r"SELECT doc_id, md5(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10), ' ')) AS digest FROM documents",
    "news_issue_sizes": f"{_NEWS_ROWS} SELECT issue_id, count(*) AS n_lines, sum(len(w))::BIGINT AS n_words FROM good g JOIN rows USING (seg_id) GROUP BY issue_id HAVING count(*) >= 10 AND sum(len(w)) > 2000",
    "packed_shuffled": f"""WITH seqs AS (SELECT seq_id, max(input_ids) AS ids FROM token_files WHERE len(input_ids) > 0 GROUP BY seq_id),
ids AS (SELECT seq_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM seqs),
numbered AS (SELECT id, row_number() OVER (ORDER BY md5('123:' || seq_id), seq_id, i) - 1 AS p FROM ids)
SELECT p // {CONTEXT + 1} AS block, md5(array_to_string(list(id ORDER BY p), ',')) AS digest FROM numbered GROUP BY 1 HAVING count(*) = {CONTEXT + 1}""",
    "tokenizer_round_trip": "SELECT count(*) AS n_docs, 0::BIGINT AS n_changed FROM documents",
    "encoded_ends": "SELECT doc_id, 50256::BIGINT AS last_id FROM documents",
    "data_stages": f"WITH {_TOTALS}, b AS (SELECT unnest(range(n_blocks)) AS block, n_blocks FROM totals) SELECT block, CASE WHEN block < floor(n_blocks * 0.1::DOUBLE) THEN 0 ELSE 1 END AS stage FROM b",
    "normalize_text": f"WITH {_NORM} SELECT doc_id, norm FROM norm",
    "min_length_filter": f"WITH {_NORM} SELECT doc_id, length(norm) AS chars FROM norm WHERE length(norm) >= 200",
    "word_and_line_counts": f"SELECT doc_id, coalesce(len({_words('text')}), 0)::BIGINT AS n_words, coalesce(len({_lines('text')}), 0)::BIGINT AS n_lines FROM documents",
    "exact_dup_groups": f"WITH {_NORM} SELECT sha1(norm) AS sha1, min(doc_id) AS rep, count(*) AS n_docs FROM norm WHERE length(norm) >= 200 GROUP BY 1 HAVING count(*) > 1",
    "simhash_fingerprint": f"WITH {_PRINTS} SELECT doc_id, chars, simhash, sha1, lower(printf('%08x%08x', hi, lo)) AS hex FROM prints",
    "lsh_bands": f"WITH {_BANDS} SELECT doc_id, band, band_value FROM banded",
    "bucket_histogram": f"WITH {_BANDS} SELECT k, count(*) AS n_buckets, count(*) * (k * (k - 1) // 2) AS pairs FROM buckets GROUP BY k",
    "bucket_report": f"WITH {_BANDS} SELECT count(*) AS n_buckets, max(k) AS largest, count(*) FILTER (k >= 100) AS at_least_100, count(*) FILTER (k >= 1000) AS at_least_1000, count(*) FILTER (k >= 10000) AS at_least_10000, (sum(k * (k - 1) // 2) FILTER (k <= 2500))::BIGINT AS pairs_up_to_most, sum(k * (k - 1) // 2)::BIGINT AS pairs FROM buckets",
    "top_buckets": f"WITH {_BANDS} SELECT band, band_value, k FROM buckets ORDER BY k DESC, band, band_value LIMIT 20",
    "dedup_manifest": f"WITH {_BANDS} SELECT (SELECT count(*) FROM prints) AS num_docs, (SELECT count(DISTINCT sha1) FROM prints) AS num_exact_groups_total, (SELECT count(*) FROM (SELECT sha1 FROM prints GROUP BY sha1 HAVING count(*) > 1)) AS num_exact_duplicate_groups, (SELECT count(*) FROM buckets) AS num_buckets",
    "near_dup_matches": f"WITH {_PAIRS} SELECT a, b, distance FROM pairs",
    "match_statistics": f"WITH {_PAIRS} SELECT count(*) AS n_pairs, count(*) FILTER (distance <= 6) AS n_near, min(distance) AS least, (SELECT count(*) FROM (SELECT a FROM pairs UNION SELECT b FROM pairs)) AS n_docs FROM pairs",
    "shingle_counts": f"WITH {_NORM}, {_SHINGLES.format('norm')} SELECT n.doc_id, count(s.s) AS n_shingles FROM norm n LEFT JOIN sh s USING (doc_id) GROUP BY n.doc_id",
    "accepted_matches": f"WITH {_SCORES} SELECT a, b, distance, simhash_similarity, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment, na AS len_shingles_a, nb AS len_shingles_b FROM links",
    "accepted_counts": f"WITH {_SCORES} SELECT count(*) AS n_scored, count(*) FILTER (jaccard >= 0.9) AS n_jaccard, count(*) FILTER (containment >= 0.95) AS n_containment, count(*) FILTER (jaccard >= 0.9 AND containment >= 0.95) AS n_both, count(*) FILTER (jaccard >= 0.9 OR containment >= 0.95) AS n_either FROM scored",
    "dup_components": f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, component, chars, keep FROM sized",
    "keep_longest": f"WITH RECURSIVE {_COMPONENTS} SELECT component, doc_id, chars FROM sized WHERE keep",
    "dedup_corpus": f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sized WHERE NOT keep)",
    "section_flags": f"""WITH parts AS (SELECT doc_id, unnest(p) AS s, (generate_subscripts(p, 1) - 1)::INTEGER AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda s: s <> '') AS p FROM documents))
SELECT doc_id, pos, {", ".join(f"{v} AS {k}" for k, v in _F.items())} FROM parts""",
    "book_sections": f"WITH {_SECTIONS} SELECT doc_id, pos, s AS section FROM parts",
    "book_kept": f"{_BOOKS} SELECT d.doc_id, coalesce(kept, '') AS kept, coalesce(n_kept >= 5 AND len({_words('kept')}) >= 200, false) AS big_enough FROM documents d LEFT JOIN texts t USING (doc_id)",
    "book_rejected": f"{_BOOKS} SELECT d.doc_id, coalesce(n_rejected, 0) AS n_rejected, coalesce(rejected, '') AS rejected FROM documents d LEFT JOIN texts t USING (doc_id)",
    "scan_clean": f"{_SCANS} SELECT r.rec_id, coalesce(clean, '') AS clean FROM rows r LEFT JOIN texts t USING (rec_id)",
    "scan_books": """WITH last AS (SELECT *, row_number() OVER (PARTITION BY file_name, rec_idx ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS k FROM scan_records WHERE file_name IS NOT NULL),
one AS (SELECT * FROM last WHERE k = 1),
firsts AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY rec_idx) AS f FROM one),
good AS (SELECT file_name, record_id, author_name, publisher, physical_description, title FROM firsts WHERE f = 1 AND list_contains(map_values(language_map), 'English') AND NOT coalesce(multi_language, false)),
texts AS (SELECT file_name, count(*) AS n_pages, string_agg(text, chr(10) ORDER BY rec_idx) AS t FROM one WHERE text <> '' GROUP BY file_name)
SELECT file_name, record_id, author_name, publisher, physical_description, title, n_pages, length(t) AS n_chars, md5(t) AS digest FROM good JOIN texts USING (file_name) WHERE n_pages >= 20""",
    "news_clean": f"{_news('WITH rows AS (SELECT DISTINCT seg_id, content FROM news_segments)')}, texts AS (SELECT seg_id, string_agg(s, chr(10) ORDER BY i) AS clean FROM good GROUP BY seg_id) SELECT r.seg_id, coalesce(clean, '') AS clean FROM rows r LEFT JOIN texts t USING (seg_id)",
    "news_issues": f"""{_news("WITH last AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM news_segments WHERE issue_id IS NOT NULL), rows AS (SELECT * FROM last WHERE k = 1 AND seg_class IN ('title', 'text'))")},
texts AS (SELECT issue_id, count(*) AS n_lines, sum(len(w))::BIGINT AS n_words, string_agg(g.s, chr(10) ORDER BY page_number NULLS FIRST, block_no NULLS FIRST, col_no NULLS FIRST, reading_order NULLS FIRST, seg_id, i) AS t FROM good g JOIN rows USING (seg_id) GROUP BY issue_id)
SELECT issue_id, 'news_article-' || issue_id AS name, n_lines, n_words, md5(t) AS digest FROM texts WHERE n_lines >= 10 AND n_words > 2000""",
    "ocr_clean": f"WITH {_OCR_LINES} SELECT d.doc_id, coalesce(clean, '') AS clean, coalesce(n >= 10 AND len({_words('clean')}) > 500, false) AS big_enough FROM documents d LEFT JOIN texts USING (doc_id)",
    "val_split": f"WITH {_SPLIT} SELECT doc_id, source, split FROM split",
    "split_counts": f"WITH {_SPLIT} SELECT source, split, count(*) AS n_docs FROM split GROUP BY source, split",
    "sampled_documents": "SELECT doc_id FROM documents ORDER BY md5('123:' || doc_id), doc_id LIMIT 100",
    "packed_blocks": f"WITH {_PACK} SELECT b.block, md5(array_to_string(ids, ',')) AS digest, names FROM blocks b JOIN named n USING (block)",
    "pack_totals": f"WITH {_TOTALS} SELECT n_tokens, n_blocks FROM totals",
    "validate_packed": f"WITH {_PACK} SELECT count(*) AS n_rows, count(*) FILTER (len(ids) <> {CONTEXT + 1}) AS wrong_length, min(list_min(ids))::BIGINT AS least_id, max(list_max(ids))::BIGINT AS largest_id, coalesce(count(*) > 0 AND min(list_min(ids)) >= 0 AND max(list_max(ids)) < 50257, false) AS valid FROM blocks",
    "shifted_rows": f"WITH {_PACK} SELECT block, md5(array_to_string(ids[:{CONTEXT}], ',')) AS inputs, md5(array_to_string(ids[2:], ',')) AS labels, {CONTEXT}::BIGINT AS mask FROM blocks",
    "repeated_rows": f"WITH {_PACK} SELECT r.i, block, ids[1]::BIGINT AS first FROM range(500) r(i) JOIN blocks ON block = r.i % (SELECT count(*) FROM blocks)",
    "training_plan": f"WITH {_TOTALS} SELECT n_blocks, ceil(n_blocks / 64.0)::BIGINT AS steps, {64 * CONTEXT}::BIGINT AS tokens_per_step, {2 * 64 * CONTEXT} <= n_blocks * {CONTEXT} AS enough, CASE WHEN n_blocks / 100.0 < 100 THEN round(exp((n_blocks / 100.0)::DOUBLE), 6) END AS perplexity FROM totals",
    "chat_render": "SELECT item_id AS conv_id, '<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || coalesce(answer, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS rendered FROM eval_items",
    "pretoken_counts": f"WITH {_COUNTS} SELECT word, n FROM counts",
    "bpe_pair_counts": f'WITH {_COUNTS} SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", sum(n)::BIGINT AS n FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM counts) GROUP BY 1, 2',
}
