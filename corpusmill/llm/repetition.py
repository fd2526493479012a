"""Repetition inside a document, with thresholds taken from the data.

A word counts as repeated if it stands in a run of four words that already occurred earlier in the
same text; the share of a text is repeated words over all words. The thresholds come from quantile
sketches of the share for each language and source. A sketch is a count for each of ``BINS`` + 1
equal steps of the share, so sketches merge by addition and a quantile is right to one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.functions.words import batch_hashes, text_of_window, windows

BINS = 1000


def batch_shares(texts: list[str | None] | pa.Array, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and of repeated words for each text."""
    h, ends = batch_hashes(texts, join_divided=False)
    count = np.diff(ends)
    w = windows(h, n)
    if not len(w):
        return count, np.zeros(len(texts), np.int64)
    at, inside = text_of_window(ends, n)
    pos = np.flatnonzero(inside)
    key = w[pos] ^ (at[pos].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(pos), bool)
    same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (at[pos[order[1:]]] == at[pos[order[:-1]]])
    delta = np.zeros(len(h) + 1, np.int64)
    hits = pos[same]
    np.add.at(delta, hits, 1)
    np.add.at(delta, hits + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
    return count, covered[ends[1:]] - covered[ends[:-1]]


def repeated_share(df: DataFrame, text: str, keep: list[str], n: int = 4) -> DataFrame:
    """``keep`` with ``n_words``, ``n_repeated``, ``share``.

    Null, empty and wordless texts have no words and the share 0. Whole texts are read.
    """
    kept = df.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            n_words, n_rep = batch_shares(b.column("_text"), n)
            share = n_rep / np.maximum(n_words, 1)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(n_words, pa.int64()), pa.array(n_rep, pa.int64()), pa.array(share, pa.float64())],
                [*keep, "n_words", "n_repeated", "share"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return arrow_map(kept, run, f"{kinds}, n_words bigint, n_repeated bigint, share double")


def share_sketches(shares: DataFrame, group: list[str]) -> DataFrame:
    """``group``, ``bin``, ``n``: the mergeable sketch of each group; merging is adding ``n``."""
    return shares.groupBy(*group, F.floor(F.col("share") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_thresholds(
    sketches: DataFrame, group: list[str], quantile: float = 0.9, least: float = 0.05, most: float = 1.0
) -> DataFrame:
    """``group``, ``threshold``: the quantile of the share, within [``least``, ``most``].

    ``least`` keeps a clean source from flagging its own ordinary phrases; with ``most`` a source
    that is mostly spam can be kept from passing for normal. The rows are one for each group and bin, so the
    window is over at most ``BINS`` + 1 rows for each group.
    """
    w = Window.partitionBy(*group).orderBy("bin")
    run = sketches.withColumn("cum", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    at = run.where(F.col("cum") >= F.col("all") * quantile).groupBy(*group).agg(F.min("bin").alias("bin"))
    return at.select(*group, F.greatest(F.lit(least), F.least(F.lit(most), F.col("bin") / float(BINS))).alias("threshold"))


def over_threshold(shares: DataFrame, thresholds: DataFrame, group: list[str]) -> DataFrame:
    """Rows whose share reaches their own group's threshold; null group values are a group of their own.

    Shares and thresholds are both quotients rounded once, so a share of exactly the threshold reaches it.
    """
    on: Column = F.lit(True)
    t = thresholds.select(*[F.col(g).alias(f"_t_{g}") for g in group], "threshold")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
    return shares.join(F.broadcast(t) if len(group) == 0 else t, on).where(F.col("share") >= F.col("threshold")).drop(*[f"_t_{g}" for g in group])
