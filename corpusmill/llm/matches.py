"""Pairwise matches of records, given by paths, to groups of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.paths import DATA_ROOT, same_file
from corpusmill.operators.components import connected_groups
from corpusmill.scratch import Scratch


def match_edges(matches: DataFrame, docs: DataFrame, data_root: str = DATA_ROOT) -> DataFrame:
    """Pairs of paths as pairs of record ids: ``a``, ``b``.

    Spellings of a path count as one. A null path, or one that no record of ``docs`` has, gives no
    edge; a path of several records links them all, the match's other side included.
    """
    known = docs.select(F.col("doc_id").alias("id"), same_file(F.col("path"), data_root).alias("p")).where(
        "p is not null and id is not null"
    ).distinct()
    pairs = matches.select(
        same_file(F.col("path_a"), data_root).alias("pa"), same_file(F.col("path_b"), data_root).alias("pb")
    ).where("pa is not null and pb is not null").distinct()
    a = known.select(F.col("id").alias("a"), F.col("p").alias("pa"))
    b = known.select(F.col("id").alias("b"), F.col("p").alias("pb"))
    return pairs.join(a, "pa").join(b, "pb").select("a", "b")


def match_groups(matches: DataFrame, docs: DataFrame, scratch: Scratch, data_root: str = DATA_ROOT) -> DataFrame:
    """``doc_id``, ``group_id`` of every record linked, directly or not, to another record."""
    out = connected_groups(match_edges(matches, docs, data_root), scratch)
    return out.select(F.col("id").alias("doc_id"), "group_id")
