"""Near duplicates: banded candidates, exact shingle joins, scores, groups, and the corpus without losers.

Copies with one normal form are collapsed first, so that a text that fills a third of the corpus is
one class; pairs are between representatives and classes come back with the membership.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.functions.words import text_of_window, windows, word_hash
from corpusmill.operators.components import connected_groups
from corpusmill.operators.fingerprint import band_values, band_widths, fingerprint, hamming, max_distance, normalize, similarity
from corpusmill.scratch import Scratch

#: Pairs of fingerprints that a task compares, that are compared at once (a processor's cache holds them), and that leave in one batch.
COMPARED_BY_A_TASK, COMPARED_AT_ONCE, PAIRS_IN_A_BATCH = 20_000_000, 1 << 16, 1 << 18


def exact_groups(prints: DataFrame) -> DataFrame:
    """``sha1``, ``rep`` (smallest id), ``n_docs`` of every content."""
    return prints.groupBy("sha1").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n_docs"))


def representatives(prints: DataFrame) -> DataFrame:
    """One row for each content: that of the smallest id."""
    return prints.groupBy("sha1").agg(F.min(F.struct("doc_id", "chars", "simhash")).alias("r")).select("r.doc_id", "r.chars", "r.simhash", "sha1")


def bands(prints: DataFrame, n: int = 4) -> DataFrame:
    """``band``, ``band_value``, ``doc_id``, ``simhash``."""
    return prints.select("doc_id", "simhash", F.posexplode(band_values(F.col("simhash"), n)).alias("band", "band_value"))


def bucket_sizes(banded: DataFrame) -> DataFrame:
    return banded.groupBy("band", "band_value").agg(F.count(F.lit(1)).alias("k"))


def bucket_histogram(banded: DataFrame) -> DataFrame:
    """``k``, ``n_buckets``, ``pairs``: how many buckets of each size and the pairs in them."""
    return bucket_sizes(banded).groupBy("k").agg(F.count(F.lit(1)).alias("n_buckets")).withColumn("pairs", F.expr("n_buckets * (k * (k - 1) div 2)"))


def bucket_report(banded: DataFrame, most: int = 2500) -> DataFrame:
    """One row: buckets, the largest, those of at least 100, 1,000, 10,000, and candidate pairs up to ``most`` and in all."""
    pairs = F.expr("k * (k - 1) div 2")
    return bucket_sizes(banded).agg(
        F.count(F.lit(1)).alias("n_buckets"), F.max("k").alias("largest"), *[F.count_if(F.col("k") >= t).alias(f"at_least_{t}") for t in (100, 1000, 10000)],
        F.sum(F.when(F.col("k") <= most, pairs)).alias("pairs_up_to_most"), F.sum(pairs).alias("pairs"),
    )


def _cells(prints: DataFrame, n_bands: int, max_bucket: int) -> DataFrame:
    """``band``, ``band_value``, ``x``, ``y``, ``own``, ``doc_id``, ``simhash``: every bucket in cells, one after another.

    Buckets over ``max_bucket`` are cut into blocks of about that size. Cell (x, y) has the members of both blocks,
    so each two members meet in one cell and no task holds a bucket as a whole.
    """
    banded = bands(prints, n_bands)
    sizes = bucket_sizes(banded).where("k > 1")
    compared = sizes.agg(F.sum(F.expr("k * (k - 1D) / 2"))).first()[0] or 0
    # As many partitions as the pairs to compare need; more than 50,000 are too many for a driver to keep track of.
    n = max(prints.sparkSession.sparkContext.defaultParallelism, min(int(compared // COMPARED_BY_A_TASK), 50_000))
    blocks = F.ceil(F.col("k") / F.lit(max_bucket)).cast("bigint")
    owned = banded.join(sizes, ["band", "band_value"]).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), blocks))
    rows = owned.withColumn("facing", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.select(F.col("band").cast("bigint").alias("band"), "band_value", F.least("own", "facing").alias("x"), F.greatest("own", "facing").alias("y"), "own", "doc_id", "simhash")
    cell = ["band", "band_value", "x", "y"]
    return rows.repartition(n, *cell).sortWithinPartitions(*cell, "own", "doc_id")


def _read_cells(batches):
    """The rows of each cell as a matrix of the columns of :func:`_cells`."""
    rest = np.empty((7, 0), np.int64)
    for b in batches:
        t = np.concatenate([rest, np.stack([c.to_numpy() for c in b.columns])], 1)
        at = [0, *(np.flatnonzero((np.diff(t[:4]) != 0).any(0)) + 1)]
        for i, j in zip(at, at[1:]):
            yield t[:, i:j]
        rest = t[:, at[-1] :]
    yield rest


def _compare(cell: np.ndarray, masks: list[np.uint64], most: int):
    """Pairs of a cell, some rows at a time: ids on the left and on the right, distances, and which are pairs.

    A pair counts in the first band that it shares alone, so no other cell has it again.
    """
    band, _, x, y = cell[:4, 0] if cell.size else (0, 0, 0, 0)
    ids, h = cell[5], cell[6].view(np.uint64)
    end = len(ids) if x == y else int(np.searchsorted(cell[4], y))
    i = 0
    while i < end:
        start = i if x == y else end
        j = min(end, i + max(1, COMPARED_AT_ONCE // max(1, len(ids) - start)))
        differ = h[i:j, None] ^ h[None, start:]
        distance = np.bitwise_count(differ)
        pair = distance <= most
        for mask in masks[:band]:
            pair &= (differ & mask) != 0
        if x == y:
            k = np.arange(j - i)
            pair[:, : j - i] &= k[:, None] < k
        yield ids[i:j], ids[start:], distance, pair
        i = j


def _pairs_of(prints: DataFrame, threshold: float, n_bands: int, max_bucket: int, fold, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """What ``fold`` makes of the pairs of all cells, and as rows the pairs of ids that have several fingerprints, if there are any."""
    most = max_distance(threshold)
    prints = prints.select("doc_id", "simhash").where("doc_id is not null and simhash is not null").distinct()
    masks = [np.uint64(((1 << w) - 1) << at) for at, w in band_widths(n_bands)]
    several = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rest = None
    if not several.isEmpty():
        on = ["band", "band_value"]
        one = bands(prints.join(several, "doc_id", "left_semi"), n_bands).select(*on, F.col("doc_id").alias("i"), F.col("simhash").alias("hi"))
        d = hamming(F.col("hi"), F.col("simhash"))
        met = one.join(bands(prints, n_bands), on).where((F.col("i") != F.col("doc_id")) & (d <= most))
        rest = met.select(F.least("i", "doc_id").alias("a"), F.greatest("i", "doc_id").alias("b"), d.cast("bigint").alias("distance")).distinct()
        prints = prints.join(several, "doc_id", "left_anti")

    def run(batches):
        yield from fold(_compare(cell, masks, most) for cell in _read_cells(batches))

    return arrow_map(_cells(prints, n_bands, max_bucket), run, schema), rest


def candidate_pairs(prints: DataFrame, threshold: float = 0.85, n_bands: int = 4, max_bucket: int = 2500) -> DataFrame:
    """``a``, ``b``, ``distance`` of representatives that share a band and are within the distance, each pair once.

    Buckets are compared in blocks of ``max_bucket`` and pairs come out of the first band that they share, so they are
    neither shuffled nor made unique. The pairs grow as the square of the buckets;
    to count them there is :func:`pair_degrees`.
    """

    def fold(cells):
        kept, n = [], 0
        for cell in cells:
            for left, right, distance, pair in cell:
                per = np.count_nonzero(pair, axis=1)
                if not (k := int(per.sum())):
                    continue
                i, j = np.repeat(left, per), np.broadcast_to(right, pair.shape)[pair]
                kept.append((np.minimum(i, j), np.maximum(i, j), distance[pair].view(np.int8)))
                if (n := n + k) >= PAIRS_IN_A_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], ["a", "b", "distance"])
                    kept, n = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], ["a", "b", "distance"])

    pairs, rest = _pairs_of(prints, threshold, n_bands, max_bucket, fold, "a bigint, b bigint, distance tinyint")
    pairs = pairs.withColumn("distance", F.col("distance").cast("bigint"))
    return pairs if rest is None else pairs.union(rest)


def pair_degrees(prints: DataFrame, threshold: float = 0.85, n_bands: int = 4, max_bucket: int = 2500, near: int = 6) -> DataFrame:
    """``doc_id``, ``n_pairs``, ``n_near``, ``least`` of every document that :func:`candidate_pairs` has a pair of, without its rows.

    Each pair counts at one of its documents alone, so the sums over all documents are the pairs and those within the
    distance ``near``; ``least`` is the least distance of the pairs counted there, null where there are none.
    """

    def fold(cells):
        for cell in cells:
            for left, right, distance, pair in cell:
                per, met = np.count_nonzero(pair, axis=1), pair.any(0)
                if not met.any():
                    continue
                close = np.count_nonzero(pair & (distance <= near), axis=1)
                least = np.where(pair, distance, np.uint8(255)).min(1)
                own = per > 0
                none = np.zeros(int(met.sum()), np.int64)
                ids, n, k = np.concatenate([left[own], right[met]]), np.concatenate([per[own], none]), np.concatenate([close[own], none])
                low = np.concatenate([least[own].astype(np.int64), none])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(k), pa.array(low, mask=n == 0)], ["doc_id", "n_pairs", "n_near", "least"])

    found, rest = _pairs_of(prints, threshold, n_bands, max_bucket, fold, "doc_id bigint, n_pairs bigint, n_near bigint, least bigint")
    if rest is not None:
        d = F.col("distance")
        found = found.union(rest.select("a", F.lit(1).cast("bigint"), (d <= near).cast("bigint"), d))
        found = found.union(rest.select("b", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))
    return found.groupBy("doc_id").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_near").alias("n_near"), F.min("least").alias("least"))


def shingles(docs: DataFrame, n: int = 7) -> DataFrame:
    """``doc_id``, ``s``: hashes of the distinct runs of ``n`` words of the normal form; empty if there are fewer words, or none."""
    norm = docs.select("doc_id", normalize(F.col("text")).alias("_norm"))

    def run(batches):
        for b in batches:
            words = [t.split(" ") if t else [] for t in b.column("_norm").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
            w = windows(np.fromiter(map(word_hash, chain.from_iterable(words)), np.uint64, int(at[-1])), n)
            text, inside = text_of_window(at, n)
            text, w = text[inside], w[inside].view(np.int64)
            order = np.lexsort((w, text))
            text, w = text[order], w[order]
            new = np.ones(len(w), bool)
            new[1:] = (np.diff(text) != 0) | (w[1:] != w[:-1])
            starts = np.searchsorted(text[new], np.arange(len(at)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(w[new]))], ["doc_id", "s"])

    return arrow_map(norm, run, "doc_id bigint, s array<bigint>")


def ranked_shingles(own: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``n``, ``t``, ``rank`` of the shingles that more than one document has, the rarest first.

    Shingles of one document alone rank before all others; there is no need to keep or join them, only their number
    counts. ``own`` has one row for each document, so ranks are taken within one text. ``t`` is a shingle's low 40 bits,
    so that one shuffle of all shingles, where they are counted, takes little disk; two that agree in them count as one
    frequent shingle, which makes more candidates and loses none.
    """
    flat = own.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("t")).withColumn("t", F.col("t").bitwiseAND(F.lit((1 << 40) - 1)))
    common = flat.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("t"))).where("df > 1")
    w = Window.partitionBy("doc_id")
    rank = F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("df", "t"))
    return scratch.save(common.select("doc_id", "n", "t", rank.alias("rank")))


def similar_pairs(own: DataFrame, scratch: Scratch, jaccard: float | None = None, containment: float | None = None, extra: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """``a``, ``b``, ``i``, ``na``, ``nb``: all pairs whose shingle sets reach a Jaccard similarity or a containment, with the size of their intersection.

    A prefix filter: if two sets share so much, one of the rarest shingles of one of them, as many as may be missing
    and one more, is in the other's prefix too (Jaccard), or anywhere in the larger one (containment of the smaller).
    So no pair is missed, and frequent phrases are no join keys but for texts of nothing else.

    :param extra: ``doc_id`` and columns, and a :param condition: on them as ``l.`` and ``r.``, that pairs must meet before they are scored.
    """
    rows = ranked_shingles(own, scratch)
    share = jaccard if jaccard is not None else containment
    n = F.col("n")
    prefix = F.col("rank") <= n - F.ceil(n * F.lit(share) - F.lit(1e-9)) + 1
    left = rows.where(prefix)
    right = left if jaccard is not None else rows
    if jaccard is not None:
        fits = (F.col("l.doc_id") < F.col("r.doc_id")) & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * F.lit(jaccard) - F.lit(1e-9))
    else:
        fits = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.doc_id") < F.col("r.doc_id")))
    met = left.alias("l").join(right.alias("r"), (F.col("l.t") == F.col("r.t")) & fits)
    pairs = met.select(F.least("l.doc_id", "r.doc_id").alias("a"), F.greatest("l.doc_id", "r.doc_id").alias("b")).distinct()
    if extra is not None and condition is not None:
        l, r = extra.alias("l"), extra.alias("r")  # noqa: E741
        pairs = pairs.join(l, F.col("a") == F.col("l.doc_id")).join(r, F.col("b") == F.col("r.doc_id")).where(condition).select("a", "b")
    sets = own.select("doc_id", "s")
    wide = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    sized = wide.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    if jaccard is not None:
        return sized.where(F.col("i") >= (F.col("na") + F.col("nb") - F.col("i")) * F.lit(jaccard) - F.lit(1e-9))
    return sized.where(F.col("i") >= F.least("na", "nb") * F.lit(containment) - F.lit(1e-9))


def near_duplicate_classes(docs: DataFrame, scratch: Scratch, n: int = 5, jaccard: float = 0.8) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` for every document.

    Texts are linked if their sets of runs of ``n`` words of the normal form have a Jaccard similarity of ``jaccard``;
    a class is what is linked directly or through others, named by its smallest id. Texts with one normal form are in
    one class whatever their length; ``n_links`` counts the other normal forms that a document's text is linked with.
    Null texts are alone; empty ones are copies of each other. Ids are unique; repeated rows count once.
    """
    norm = docs.select("doc_id", normalize(F.col("text")).alias("text")).where("doc_id is not null").dropDuplicates(["doc_id"])
    copies = scratch.save(norm.select("doc_id", F.coalesce(F.sha1("text"), F.concat(F.lit("null "), F.col("doc_id").cast("string"))).alias("sha1")))
    reps = scratch.save(copies.groupBy("sha1").agg(F.min("doc_id").alias("rep")))
    own = scratch.save(shingles(norm.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), n).where(F.size("s") > 0))
    links = scratch.save(similar_pairs(own, scratch, jaccard=jaccard).select("a", "b"))
    groups = connected_groups(links, scratch)
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    named = reps.join(groups.select(F.col("id").alias("rep"), "group_id"), "rep", "left").join(degree, "rep", "left")
    return copies.join(named, "sha1").select("doc_id", F.coalesce("group_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _shingled(prints: DataFrame, docs: DataFrame, scratch: Scratch, n: int, min_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The representatives, and the shingles of those that have enough of them."""
    reps = scratch.save(representatives(prints))
    own = shingles(docs.select("doc_id", "text").join(reps.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), n)
    return reps, scratch.save(own.where(F.size("s") >= min_shingles))


def accepted_pairs(
    prints: DataFrame, docs: DataFrame, scratch: Scratch, min_similarity: float = 0.9, n: int = 7, min_shingles: int = 10, jaccard: float = 0.9, containment: float = 0.95, n_bands: int = 4
) -> DataFrame:
    """The pairs that :func:`score_pairs` accepts in mode ``either``, without scoring all candidates.

    Either rule means that a part of the smaller text's shingles is in the other one, so an exact shingle join finds
    the pairs; fingerprints within the distance and with a band in common are a condition of the join.
    """
    reps, own = _shingled(prints, docs, scratch, n, min_shingles)
    return _accepted_pairs(reps, own, scratch, min_similarity, jaccard, containment, n_bands)


def acceptance_counts(
    prints: DataFrame, docs: DataFrame, scratch: Scratch, min_similarity: float = 0.9, n: int = 7, min_shingles: int = 10, jaccard: float = 0.9, containment: float = 0.95, n_bands: int = 4
) -> DataFrame:
    """One row: the pairs that :func:`score_pairs` scores, and those that each mode accepts.

    Scored are all candidates that are similar enough and have enough shingles, which need no listing to be counted;
    what a mode accepts is among the :func:`accepted_pairs`.
    """
    reps, own = _shingled(prints, docs, scratch, n, min_shingles)
    scored = pair_degrees(reps.join(own.select("doc_id"), "doc_id", "left_semi"), min_similarity, n_bands)
    taken = _accepted_pairs(reps, own, scratch, min_similarity, jaccard, containment, n_bands)
    modes = [F.count_if(accepted(m, jaccard, containment)).alias(f"n_{m}") for m in ("jaccard", "containment", "both", "either")]
    return scored.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_scored")).crossJoin(taken.agg(*modes))


def _accepted_pairs(reps: DataFrame, own: DataFrame, scratch: Scratch, min_similarity: float, jaccard: float, containment: float, n_bands: int) -> DataFrame:
    d = hamming(F.col("l.simhash"), F.col("r.simhash"))
    x = F.col("l.simhash").bitwiseXOR(F.col("r.simhash"))
    shared = [F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)) == 0 for at, w in band_widths(n_bands)]
    near = (similarity(d) >= min_similarity) & reduce(lambda p, q: p | q, shared)
    got = similar_pairs(own, scratch, containment=min(jaccard, containment), extra=reps.select("doc_id", "simhash"), condition=near)
    both = got.join(reps.select(F.col("doc_id").alias("a"), F.col("simhash").alias("ha")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("simhash").alias("hb")), "b")
    both = both.withColumn("distance", hamming(F.col("ha"), F.col("hb")).cast("bigint"))
    scored = both.select(
        "a", "b", "distance", similarity(F.col("distance")).alias("simhash_similarity"), (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("word_shingle_jaccard"),
        (F.col("i") / F.least("na", "nb")).alias("word_shingle_containment"), F.col("na").cast("bigint").alias("len_shingles_a"), F.col("nb").cast("bigint").alias("len_shingles_b"),
    )
    return scored.where(accepted("either", jaccard, containment))


def match_rows(links: DataFrame, docs: DataFrame, fields: tuple[str, ...] = ("path", "source", "chars", "simhash", "sha1")) -> DataFrame:
    """The links with the ``fields`` of both documents, as ``*_a`` and ``*_b``."""
    own = docs.select("doc_id", *fields)
    for side in "ab":
        links = links.join(own.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in fields]), side, "left")
    return links


def to_remove(links: DataFrame, jaccard: float = 0.9, containment: float = 0.9) -> DataFrame:
    """Links that the removal rule takes: either score reaches its limit. A containment is never below the Jaccard similarity."""
    return links.where(accepted("either", jaccard, containment))


def accepted(mode: str, jaccard: float, containment: float) -> Column:
    """The acceptance rule: ``jaccard``, ``containment``, ``both`` or ``either``."""
    j, c = F.col("word_shingle_jaccard") >= jaccard, F.col("word_shingle_containment") >= containment
    return {"jaccard": j, "containment": c, "both": j & c, "either": j | c}[mode]


def score_pairs(
    pairs: DataFrame,
    docs: DataFrame,
    min_similarity: float = 0.9,
    n: int = 7,
    min_shingles: int = 10,
    mode: str = "either",
    jaccard: float = 0.9,
    containment: float = 0.95,
) -> DataFrame:
    """Accepted pairs with their scores. Only texts of pairs that are similar enough get shingles."""
    near = pairs.where(similarity(F.col("distance")) >= min_similarity)
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    own = shingles(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), n).where(F.size("s") >= min_shingles)
    wide = near.join(own.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = wide.withColumn("_i", F.size(F.array_intersect("sa", "sb"))).withColumns({"len_shingles_a": F.size("sa").cast("bigint"), "len_shingles_b": F.size("sb").cast("bigint")})
    scored = both.select(
        "a", "b", "distance", similarity(F.col("distance")).alias("simhash_similarity"),
        (F.col("_i") / (F.col("len_shingles_a") + F.col("len_shingles_b") - F.col("_i"))).alias("word_shingle_jaccard"),
        (F.col("_i") / F.least("len_shingles_a", "len_shingles_b")).alias("word_shingle_containment"), "len_shingles_a", "len_shingles_b",
    )
    return scored.where(accepted(mode, jaccard, containment))


def duplicate_groups(prints: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``component``, ``chars``, ``keep`` for every document with a duplicate; the longest is kept, then the smallest id."""
    member = prints.join(exact_groups(prints), "sha1").where(F.col("rep") != F.col("doc_id")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    groups = connected_groups(links.select("a", "b").union(member), scratch)
    sized = groups.join(prints.select(F.col("doc_id").alias("id"), "chars"), "id")
    best = sized.groupBy("group_id").agg(F.max(F.struct("chars", (-F.col("id")).alias("neg"))).alias("m"))
    return sized.join(best, "group_id").select(F.col("id").alias("doc_id"), F.col("group_id").alias("component"), "chars", (F.col("m.neg") == -F.col("id")).alias("keep"))


def deduplicated(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The documents without the losers of their groups."""
    prints = scratch.save(fingerprint(docs))
    links = scratch.save(accepted_pairs(prints, docs, scratch, **how))
    groups = duplicate_groups(prints, links, scratch)
    return docs.join(groups.where("not keep").select("doc_id"), "doc_id", "left_anti")


def without_excluded(docs: DataFrame, excluded: DataFrame, key: str = "path") -> DataFrame:
    """Documents that a table of manual exclusions doesn't name; a null key is never excluded."""
    return docs.join(excluded.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
