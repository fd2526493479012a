"""The best representative of each duplicate group, field by field, in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust in a field's value by the source it comes from; sources that are not named count as 0.
SOURCE_PRIORITY = {"gutenberg": 5, "old_bailey": 4, "blbooks": 3, "ncse_v2_revised": 2, "post-ocr-correction": 1}
FIELDS = ("path", "source", "sha1", "simhash", "title", "author_name", "pub_year")


def _present(value: Column, kind: str) -> Column:
    return (F.trim(value) != "") if kind == "string" else value.isNotNull()


def golden_records(
    groups: DataFrame,
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    priority: Mapping[str, int] = SOURCE_PRIORITY,
) -> DataFrame:
    """One built record for each group: the survivor's id and size, and for each field the best value.

    The survivor is the record with most characters: a record's size is that of its latest row with a positive one
    (equal times: the larger), equal sizes go to the smaller id. A record's rows are added up where they meet its
    group, without a shuffle of their own, and one aggregation of maxima follows.
    A field takes the maximum of (present, source priority, time, value) over all rows of the group,
    so a null or blank value never beats a present one and equal claims are settled by the value
    itself. Partial maxima are taken before the shuffle, so a group of any size costs one row for each task.
    Columns of ``docs`` that are not named are left out. A group without a positive size has no survivor and a null
    ``doc_id``; its fields are still filled.
    """
    pairs = [F.lit(x) for kv in sorted(priority.items()) for x in kv]
    trust = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0)) if pairs else F.lit(0)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.join(groups, "doc_id").withColumn("_trust", trust)
    claims = [
        F.max(F.struct(F.coalesce(_present(F.col(c), kinds[c]), F.lit(False)).alias("ok"), F.col("_trust"), F.col("hashed_at"), F.col(c).alias("v"))).alias(f"_{c}")
        for c in fields
    ]
    sizes = F.max(F.when(F.col("chars") > 0, F.struct(F.col("hashed_at").isNotNull().alias("dated"), "hashed_at", "chars"))).alias("_s")
    one = rows.groupBy("group_id", "doc_id").agg(sizes, *claims)
    best = F.max(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s.chars").alias("chars"), (-F.col("doc_id")).alias("neg")))).alias("_b")
    out = one.groupBy("group_id").agg(best, F.count(F.lit(1)).alias("n_records"), *[F.max(f"_{c}").alias(f"_{c}") for c in fields])
    return out.select(
        "group_id", (-F.col("_b.neg")).alias("doc_id"), F.col("_b.chars").alias("chars"), "n_records",
        *[F.when(F.col(f"_{c}.ok"), F.col(f"_{c}.v")).alias(c) for c in fields],
    )
