"""Pairwise matches to groups by low-diameter decomposition.

Every round each vertex draws a shift from an exponential distribution, cut off at ``radius``, and
starts its own cluster that much earlier; a vertex joins the cluster that reaches it first. A vertex
is reached within ``radius`` steps or starts itself before, so after as many relaxations that
assignment is final. Clusters become vertices, edges between clusters stay, and the next round works
on these until no edge is left; the assignments are composed in the end. An edge stays with a
probability of less than one half, whatever the diameter of a group, so a chain of n records takes
O(log n) rounds and not n. The time at which a vertex is reached over paths of at most k edges is the
least of its own start and its neighbours' times over k - 1 edges plus one; so a relaxation is one
aggregation of the edges, which are partitioned by their source once for a round.

What is left after two rounds or more is finished in one task as soon as it is small: at most
``one_task`` edges, which are counted before. Which rounds there were doesn't show in the result, as a
group is named by its smallest id. All state is in tables; nothing comes to the driver but the number
of edges left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.scratch import Scratch


def _start(vertex: Column, draw: Column, beta: float, radius: int) -> Column:
    """When a vertex starts its own cluster: ``radius`` less its shift."""
    u = (F.shiftrightunsigned(F.xxhash64(vertex, draw), 11).cast("double") + 1.0) / float(2**53 + 1)
    return F.lit(float(radius)) - F.least(-F.log(u) / beta, F.lit(float(radius)))


def connected_groups(
    edges: DataFrame, scratch: Scratch, beta: float = 0.35, radius: int = 4, max_rounds: int = 200, one_task: int = 500_000
) -> DataFrame:
    """Groups of an undirected graph.

    :param edges: BIGINT columns ``a`` and ``b``. Nulls, loops, repeated and reversed edges are harmless.
    :param one_task: most edges that are finished in one task, after two rounds; 0 leaves all to rounds.
    :returns: ``id``, ``group_id`` for each vertex with an edge to another one; ``group_id`` is the
        smallest id of the group. An empty table gives an empty one.
    """
    plain = edges.select("a", "b").where("a <> b")
    both = plain.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(plain.select("b", "a"))
    live = scratch.save(both.distinct())  # either direction of an edge is a row
    maps: list[DataFrame] = []
    for draw in range(max_rounds):
        left = live.count()
        if not left:
            break
        if draw >= 2 and left <= 2 * one_task:
            maps.append(scratch.save(_finished(live)))
            break
        step, nxt = _round(live, scratch, draw, beta, radius)
        maps.append(step)
        scratch.drop(live)
        live = nxt
    else:
        raise RuntimeError("edges are left after max_rounds")
    if not maps:
        return live.select(F.col("src").alias("id"), F.col("dst").alias("group_id"))
    # From the last round to the first; tables shrink from round to round, so each step costs what its round did.
    whole = maps[-1]
    for step in reversed(maps[:-1]):
        upper = whole.select(F.col("id").alias("u"), F.col("c").alias("uc"))
        whole = step.join(upper, step.c == upper.u, "left").select("id", F.coalesce("uc", "c").alias("c"))
    if len(maps) > 1:
        whole = scratch.save(whole)
    least = whole.groupBy("c").agg(F.min("id").alias("group_id"))
    return whole.join(least, "c").select("id", "group_id")


def _round(live: DataFrame, scratch: Scratch, draw: int, beta: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """``id``, ``c``: each vertex's cluster; and the edges between clusters, in both directions."""

    def own(vertex: Column) -> Column:
        # The round's number is no literal, so that all rounds have the same code, which is compiled once.
        return F.struct(_start(vertex, F.col("draw"), beta, radius).alias("t"), vertex.alias("c"))

    live = live.withColumn("draw", F.lit(draw))
    # Every vertex is the target of some edge.
    sent = live.select(F.col("dst").alias("id"), "draw", F.struct((_start(F.col("src"), F.col("draw"), beta, radius) + 1.0).alias("t"), F.col("src").alias("c")).alias("r"))
    reach = sent.groupBy("id").agg(F.max("draw").alias("draw"), F.min("r").alias("r")).select("id", "draw", F.least("r", own(F.col("id"))).alias("r"))
    for _ in range(radius - 1):
        sent = live.join(reach.select("id", "r"), live.src == reach.id).select(F.col("dst").alias("id"), "draw", F.struct((F.col("r.t") + 1.0).alias("t"), F.col("r.c").alias("c")).alias("r"))
        reach = sent.groupBy("id").agg(F.max("draw").alias("draw"), F.min("r").alias("r")).select("id", "draw", F.least("r", own(F.col("id"))).alias("r"))
    step = scratch.save(reach.select("id", F.col("r.c").alias("c")))
    at = step.select("id", F.col("c").alias("cs")), step.select("id", F.col("c").alias("cd"))
    between = live.join(at[0], live.src == at[0].id).select("cs", "dst").join(at[1], F.col("dst") == at[1].id).where("cs <> cd")
    return step, scratch.save(between.select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct())


def _finished(live: DataFrame) -> DataFrame:
    """``id``, ``c`` of the few edges left, by union and find in one task."""

    def run(batches):
        parts = [(np.asarray(b.column("src")), np.asarray(b.column("dst"))) for b in batches]
        if not parts:
            return
        src, dst = (np.concatenate(x) for x in zip(*parts))
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, j in zip(at[: len(src)].tolist(), at[len(src) :].tolist()):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[root(i) for i in range(len(ids))]])], ["id", "c"])

    return arrow_map(live.where("src < dst").coalesce(1), run, "id bigint, c bigint")
