"""Sequences into rows of fixed capacity by minimum bin slack.

Which lengths share a row depends on the histogram of lengths alone, and that has at most
``capacity`` entries however many sequences there are. The driver plans on the histogram: the
longest length left opens a row, a subset-sum over the lengths left (one bit a sum, in one big
integer) finds the fullest feasible filling, and the row found is repeated as often as the counts
allow, which uses up one length at least. So the plan has no more patterns than there are lengths,
at any scale. Executors then number the sequences within each length and look up their row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.scratch import Scratch

#: Pieces of one length that are numbered in one task, about; one length may hold a third of all rows.
PART_ROWS = 50_000


def fullest(counts: Mapping[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is the largest that is not over ``room``, long lengths first."""
    usable = sorted((n for n, k in counts.items() if k > 0 and 0 < n <= room), reverse=True)
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for n in usable:
        left, block = min(counts[n], room // n), 1
        while left:
            k = min(block, left)
            steps.append((n, k, sums))
            sums |= (sums << (n * k)) & mask
            left -= k
            block *= 2
        if sums >> room & 1:
            break
    best = sums.bit_length() - 1
    taken: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            best -= n * k
            taken[n] = taken.get(n, 0) + k
    return sorted(taken.items(), reverse=True)


def plan_rows(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (times, {length: number in a row}); together they use each length up exactly."""
    left = {n: k for n, k in histogram.items() if k > 0}
    plan = []
    while left:
        first = max(left)
        left[first] -= 1
        row = dict(fullest(left, capacity - first))
        left[first] += 1
        row[first] = row.get(first, 0) + 1
        times = min(left[n] // k for n, k in row.items())
        for n, k in row.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((times, row))
    return plan


class _Lookup:
    """From (length, rank within the length) to the row."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        self.spans: dict[int, tuple[list[int], list[int], list[int]]] = {}
        used: dict[int, int] = {}
        row0 = 0
        for times, row in plan:
            for n, k in row.items():
                starts, per, rows = self.spans.setdefault(n, ([], [], []))
                starts.append(used.get(n, 0))
                per.append(k)
                rows.append(row0)
                used[n] = used.get(n, 0) + k * times
            row0 += times
        self.n_rows = row0

    def row(self, n: int, rank: int) -> int:
        starts, per, rows = self.spans[n]
        i = bisect_right(starts, rank) - 1
        return rows[i] + (rank - starts[i]) // per[i]


def pieces(seqs: DataFrame, capacity: int, key: str, ids: str) -> DataFrame:
    """``key``, ``piece``, ``n``: every sequence once; one longer than a row as full rows and a rest."""
    sized = seqs.select(key, F.size(ids).alias("_n")).where(f"{key} is not null and _n > 0").distinct()
    one = sized.groupBy(key).agg(F.max("_n").alias("_n"))
    return one.select(key, F.posexplode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {capacity}"))).alias("piece", "_i"), "_n").select(
        key, "piece", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).alias("n")
    )


def assign_rows(seqs: DataFrame, scratch: Scratch, capacity: int = 4097, key: str = "seq_id", ids: str = "input_ids", part_rows: int = PART_ROWS) -> DataFrame:
    """``row_id``, ``key``, ``piece``, ``n`` for every piece of every sequence; a table of its own.

    Null and empty sequences take no room and get no row; rows with a null key are left out, as
    they name no sequence. Rows repeated with one key count once; if lengths differ, the longest
    counts. An empty table gives an empty one. Other columns are ignored.

    :param part_rows: pieces of one length are numbered in parts of about so many, as many parts as their count needs.
    """
    all_pieces = scratch.save(pieces(seqs, capacity, key, ids))
    histogram = {r[0]: r[1] for r in all_pieces.groupBy("n").count().collect()}  # at most ``capacity`` rows
    lookup = _Lookup(plan_rows(histogram, capacity))
    n_parts = {n: -(-k // part_rows) for n, k in histogram.items()}
    split = {n: k for n, k in n_parts.items() if k > 1}
    parts = F.lit(1)
    if split:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(split.items()) for x in kv]), F.col("n")), F.lit(1))
    placed = all_pieces.withColumn("part", F.pmod(F.xxhash64(key, "piece"), parts).cast("int"))
    base: dict[int, dict[int, int]] = {n: {0: 0} for n in histogram}
    if split:
        # One row for ``part_rows`` pieces.
        sizes: dict[int, dict[int, int]] = {}
        for n, part, k in placed.where(F.col("n").isin(list(split))).groupBy("n", "part").count().collect():
            sizes.setdefault(n, {})[part] = k
        for n, x in sizes.items():
            base[n] = dict(zip(sorted(x), np.cumsum([0] + [x[p] for p in sorted(x)]).tolist()))
    shared = seqs.sparkSession.sparkContext.broadcast((lookup, base))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("n", "part").orderBy(key, "piece")))

    def rows(batches):
        look, offset = shared.value
        for b in batches:
            n, part, rank = (b.column(c).to_pylist() for c in ("n", "part", "rank"))
            row = [look.row(x, offset[x][p] + r - 1) for x, p, r in zip(n, part, rank)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), b.column(key), b.column("piece"), b.column("n")], ["row_id", key, "piece", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return scratch.save(arrow_map(ranked, rows, f"row_id bigint, {key} {kinds[key]}, piece int, n int"))


def pack_rows(seqs: DataFrame, scratch: Scratch, capacity: int = 4097, key: str = "seq_id", ids: str = "input_ids", part_rows: int = PART_ROWS) -> DataFrame:
    """``row_id``, ``n_ids``, ``keys`` and ``input_ids``: the filled rows, pieces in order of key and piece.

    The rules of :func:`assign_rows` hold. Where a key comes with several arrays of the same
    greatest length, the largest array in order of its elements counts.
    """
    where = assign_rows(seqs, scratch, capacity, key, ids, part_rows)
    cut = F.slice(ids, F.col("piece") * capacity + 1, F.col("n"))
    longest = where.groupBy(key).agg(F.sum("n").cast("int").alias("_n"))
    held = where.join(longest, key)
    placed = held.join(seqs.select(key, ids), key).where(F.size(ids) == F.col("_n")).select("row_id", key, "piece", cut.alias("ids"))
    one = placed.groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct(key, "piece", "ids"))).alias("p"))
    # Differing arrays of one length and key stand next to each other; the last of them stays.
    p = F.col("p")
    kept = F.filter(p, lambda x, i: ~F.coalesce((F.get(p, i + 1)[key] == x[key]) & (F.get(p, i + 1)["piece"] == x["piece"]), F.lit(False)))
    out = one.select("row_id", kept.alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["ids"]))
    return out.select("row_id", F.size(flat).cast("bigint").alias("n_ids"), F.transform("p", lambda x: x[key]).alias("keys"), flat.alias("input_ids"))
