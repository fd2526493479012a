"""Queries on duplicate records, splits and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import binpack, crosssplit, matches, survivors
from corpusmill.plans.tables import table
from corpusmill.scratch import Scratch


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.match_groups(table(spark, sf_dir, "matches"), table(spark, sf_dir, "docs"), Scratch(spark, "groups"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.cross_split_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "val_list"), Scratch(spark, "crosssplit"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pairs(spark, sf_dir).select(F.least("val_id", "train_id").alias("doc_id_a"), F.greatest("val_id", "train_id").alias("doc_id_b")).distinct()


def p3_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs whose words are equal: a part of p3_found."""
    pairs = p3_pairs(spark, sf_dir).where("share = 1.0")
    return pairs.select(F.least("val_id", "train_id").alias("doc_id_a"), F.greatest("val_id", "train_id").alias("doc_id_b")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.overlap_report(p3_pairs(spark, sf_dir), table(spark, sf_dir, "documents"))


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_rows(table(spark, sf_dir, "token_files"), Scratch(spark, "binpack"))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the packed rows: ids, sequences, the fullest row, whether each id is there once, and whether the rows are the fewest possible ones or 2 % more at most."""
    rows = Scratch(spark, "binpack").save(p4_rows(spark, sf_dir).withColumn("total", F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)))
    fewest = F.ceil(F.sum("n_ids") / 4097.0)
    keys = rows.select(F.explode("keys").alias("k")).agg(F.count_distinct("k").alias("n_sequences"))
    return rows.agg(
        F.sum("n_ids").alias("n_ids"), F.sum("total").alias("id_total"), (F.max("n_ids") <= 4097).alias("within"), (F.count(F.lit(1)) <= fewest * 1.02 + 1).alias("tight"),
    ).crossJoin(keys)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors of the built records; groups without any positive size have none."""
    return p6_records(spark, sf_dir).where("doc_id is not null").select("group_id", "doc_id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.golden_records(_groups(spark, sf_dir), table(spark, sf_dir, "docs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p3_found, p3_equal, p3_report, p4_rows, p4_totals, p6_found, p6_records, p7_found)}

_PATH = r"nullif(regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[\\/]+(?:\.[\\/]+)*', '/', 'g')), '^(?:\./)?(?:/?data/train_data/)?(?:\./|/)*', ''), '')"
_GROUPS = f"""
WITH RECURSIVE known AS (SELECT DISTINCT doc_id, {_PATH.format("path")} AS p FROM docs WHERE doc_id IS NOT NULL),
pairs AS (SELECT DISTINCT {_PATH.format("path_a")} AS pa, {_PATH.format("path_b")} AS pb FROM matches),
edges AS (SELECT a.doc_id AS x, b.doc_id AS y FROM pairs JOIN known a ON a.p = pa JOIN known b ON b.p = pb WHERE a.doc_id <> b.doc_id),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x AS id, y AS to_id FROM both_ways UNION SELECT r.id, e.y FROM reach r JOIN both_ways e ON e.x = r.to_id),
grouped AS (SELECT id AS doc_id, least(id, min(to_id)) AS group_id FROM reach GROUP BY id)"""
_SIZED = """, ranked AS (SELECT doc_id, chars, row_number() OVER (PARTITION BY doc_id ORDER BY hashed_at DESC NULLS LAST, chars DESC) AS k FROM docs WHERE chars > 0),
sized AS (SELECT group_id, doc_id, chars, row_number() OVER (PARTITION BY group_id ORDER BY chars DESC, doc_id) AS k FROM grouped JOIN (SELECT * FROM ranked WHERE k = 1) USING (doc_id))"""
_RANKED_SIZES = _SIZED.replace(" JOIN (SELECT * FROM ranked WHERE k = 1) USING (doc_id)", " JOIN (SELECT doc_id, chars FROM ranked WHERE k = 1) USING (doc_id)")
_TRUST = "CASE source WHEN 'gutenberg' THEN 5 WHEN 'old_bailey' THEN 4 WHEN 'blbooks' THEN 3 WHEN 'ncse_v2_revised' THEN 2 WHEN 'post-ocr-correction' THEN 1 ELSE 0 END"


def _best(column: str, present: str) -> str:
    order = f"({present}) DESC, {_TRUST} DESC, hashed_at DESC NULLS LAST, {column} DESC NULLS LAST"
    return f"first({column} ORDER BY {order}) FILTER ({present}) AS {column}"


_DIVIDED = r"([\p{L}\p{N}])[-¬\x{AD}‐‑=][\t-\r\x1c-\x1f\x{85}\p{Z}]*\n[\t-\r\x1c-\x1f\x{85}\p{Z}]*([\p{L}\p{Nl}\p{No}])"
_WORDS = rf"regexp_extract_all(lower(regexp_replace(regexp_replace(text, '{_DIVIDED}', '\1\2', 'g'), '{_DIVIDED}', '\1\2', 'g')), '[\p{{L}}\p{{N}}]+')"
SQL = {
    "p3_equal": f"""WITH named AS (SELECT DISTINCT {_PATH.format("path")} AS p FROM val_list),
d AS (SELECT doc_id, {_PATH.format("path")} IN (SELECT p FROM named WHERE p IS NOT NULL) AS listed, array_to_string({_WORDS}, ' ') AS w, text FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')),
k AS (SELECT doc_id, coalesce(listed, false) AS listed, CASE WHEN w = '' THEN 'text:' || text ELSE w END AS w FROM d)
SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM k a JOIN k b ON a.w = b.w AND a.listed AND NOT b.listed""",
    "p4_totals": """WITH s AS (SELECT seq_id, max({'n': len(input_ids), 'ids': input_ids}).ids AS ids FROM token_files WHERE seq_id IS NOT NULL AND len(input_ids) > 0 GROUP BY seq_id)
SELECT sum(len(ids))::BIGINT AS n_ids, sum(list_sum(ids))::BIGINT AS id_total, true AS within, true AS tight, count(*) AS n_sequences FROM s""",
    "p7_found": f"{_GROUPS} SELECT doc_id, group_id FROM grouped",
    "p6_found": f"{_GROUPS}{_RANKED_SIZES} SELECT group_id, doc_id FROM sized WHERE k = 1",
    "p6_records": f"""{_GROUPS}{_RANKED_SIZES},
filled AS (SELECT group_id, count(DISTINCT doc_id) AS n_records, {", ".join(_best(c, f"trim({c}) <> ''" if c not in ("simhash", "pub_year") else f"{c} IS NOT NULL") for c in survivors.FIELDS)}
FROM docs JOIN grouped USING (doc_id) GROUP BY group_id)
SELECT f.group_id, s.doc_id, s.chars, f.n_records, {", ".join("f." + c for c in survivors.FIELDS)}
FROM filled f LEFT JOIN (SELECT * FROM sized WHERE k = 1) s ON s.group_id = f.group_id""",
}
