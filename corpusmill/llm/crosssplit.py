"""Equal and almost equal documents across splits, by an edit-distance segment join on words.

Two texts count as almost equal if at least ``agree`` of the words of the longer one agree in order. How
candidates are found and verified is in :mod:`corpusmill.llm.segments`; no pair that agrees is missed.

Texts are cut into words once; the hashes of the words are kept in a table. Copies with the same words
are collapsed first: pairs are found between classes and expanded with the membership in the end.
Lengths of a pair differ by a factor of 1 / agree at most, so texts of one length class meet evaluation
texts of three. Either side of a class is cut into blocks of bounded size, as many as its counted words
need, and each pair of blocks is one group: a class that holds most of the corpus is spread like any
other, and no task holds more than two blocks. All counting and verifying of a pair happens within its
group, so neither hits nor candidates are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map, ship
from corpusmill.functions.paths import DATA_ROOT, same_file
from corpusmill.functions.words import batch_hashes
from corpusmill.llm.segments import SegmentIndex
from corpusmill.scratch import Scratch

#: Words of evaluation texts and of other texts that meet in one group.
BLOCK_WORDS = (1_000_000, 2_000_000)
#: Rows of ids and groups that are broadcast at most, some 30 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def listed(docs: DataFrame, val_list: DataFrame, data_root: str = DATA_ROOT) -> DataFrame:
    """``doc_id``, ``split`` of documents in the evaluation files; a path in both splits gives ``both``, a null split ``none``."""
    files = val_list.select(same_file(F.col("path"), data_root).alias("p"), F.coalesce("split", F.lit("none")).alias("split")).where("p is not null")
    one = files.groupBy("p").agg(F.when(F.min("split") == F.max("split"), F.min("split")).otherwise("both").alias("split"))
    return docs.select("doc_id", same_file(F.col("path"), data_root).alias("p")).join(one, "p").select("doc_id", "split").distinct()


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, ``n``, ``w``: hash of a text's words, their number, and 32 bits of each word's hash.

    A text without words has the hash of the text; null ids, null and blank texts have no row.
    """

    def run(batches):
        import xxhash

        for b in batches:
            texts = b.column("text")
            h, ends = batch_hashes(texts)
            short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ids, key, n, keep = [], [], [], []
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                k = int(ends[i + 1] - ends[i])
                t = None if k else texts[i].as_py()
                if d is None or (not k and (not t or t.isspace())):
                    continue
                data = h[ends[i] : ends[i + 1]].tobytes() if k else t.encode("utf-8", "surrogatepass")
                keep.append(i), ids.append(d), n.append(k), key.append(xxhash.xxh3_64_intdigest(data, seed=0 if k else 1) - (1 << 63))
            w = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(short)).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), w], ["doc_id", "h", "n", "w"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, h bigint, n bigint, w array<int>")


def _groups(texts: DataFrame, reps: DataFrame, agree: float, block_words: tuple[int, int]) -> DataFrame:
    """``grp``, ``other``, ``doc_id``, ``w``: the texts of each pair of blocks."""
    # With this step lengths of a pair are in the same class or in neighbouring ones.
    length = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1 / agree)))).cast("int")
    sized = reps.where("n > 0").withColumn("len", length)
    # One row for each length class: some dozens at any scale.
    totals = [f(F.when(F.col(c).isNotNull(), F.col("n"))) for c in ("rv", "rt") for f in (F.sum, F.count)]
    words = {r[0]: [x or 0 for x in r[1:]] for r in sized.groupBy("len").agg(*totals).collect()}
    parts, n_rows, n_words = {}, 0, 0
    for c, (_, _, b, n_b) in words.items():
        a, n_a = (sum(words.get(c + k, [0] * 4)[i] for k in (-1, 0, 1)) for i in (0, 1))
        if a and b:
            parts[c] = (-(-a // block_words[0]), -(-b // block_words[1]))
            n_rows += n_a * parts[c][1] + n_b * parts[c][0]
            n_words += a * parts[c][1] + b * parts[c][0]
    flat = [F.lit(x) for c in sorted(parts) for x in (c, parts[c][0])], [F.lit(x) for c in sorted(parts) for x in (c, parts[c][1])]
    n_a, n_b = (F.create_map(*f) if f else F.create_map().cast("map<int,int>") for f in flat)

    def side(column: str, other: bool, classes) -> DataFrame:
        rows = sized.where(F.col(column).isNotNull()).select(F.col(column).alias("doc_id"), F.explode(classes).alias("c"))
        rows = rows.select("doc_id", "c", F.try_element_at(n_a, F.col("c")).alias("na"), F.try_element_at(n_b, F.col("c")).alias("nb")).where("na is not null")
        own, facing = ("nb", "na") if other else ("na", "nb")
        block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col(own)).cast("bigint")
        rows = rows.select("doc_id", "c", block.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(facing).cast("bigint") - 1)).alias("facing"))
        a, b = ("facing", "own") if other else ("own", "facing")
        grp = F.shiftleft(F.col("c").cast("bigint"), 48) + F.shiftleft(F.col(a), 24) + F.col(b)
        return rows.select("doc_id", F.lit(other).alias("other"), grp.alias("grp"))

    near = F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1)
    roles = side("rv", False, near).union(side("rt", True, F.array("len")))
    if n_rows <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    # As many partitions as the words need, so that none grows with the data.
    n = max(texts.sparkSession.sparkContext.defaultParallelism, n_words // block_words[0])
    return texts.select("doc_id", "w").join(roles, "doc_id").select("grp", "other", "doc_id", "w").repartition(int(n), "grp")


def _joined(groups: DataFrame, agree: float) -> DataFrame:
    def block(t: pa.Table):
        ids, at = np.unique(t.column("doc_id").to_numpy(), return_index=True)
        w = t.column("w").combine_chunks().take(pa.array(at))
        return ids, w.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False), np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)

    def run(t: pa.Table) -> pa.Table:
        other = t.column("other")
        (a, wa, ea), (b, wb, eb) = (block(t.filter(m)) for m in (pc.invert(other), other))
        got = list(SegmentIndex(wa, ea, agree).pairs(wb, eb)) if len(a) and len(b) else []
        return pa.table({
            "a": pa.array([int(a[x]) for x, _, _ in got], pa.int64()), "b": pa.array([int(b[y]) for _, y, _ in got], pa.int64()), "share": pa.array([s for *_, s in got], pa.float64()),
        })

    ship(groups.sparkSession)
    return groups.groupBy("grp").applyInArrow(run, "a bigint, b bigint, share double")


def cross_split_pairs(
    docs: DataFrame, val_list: DataFrame, scratch: Scratch, agree: float = 0.8, block_words: tuple[int, int] = BLOCK_WORDS, data_root: str = DATA_ROOT
) -> DataFrame:
    """``val_id``, ``split``, ``train_id``, ``share`` of every pair of a listed and an unlisted document that is equal or almost equal.

    Case, punctuation, line breaks and divisions of words at line ends are aside. Null, empty and blank texts pair
    with nothing; texts without any word pair if they are equal. Rows repeated with one id count once;
    null ids are left out. Empty tables give no pairs. Extra columns are ignored.

    :param block_words: words of evaluation texts and of other texts in a group; what a task holds is bounded by them.
    """
    docs = docs.select("doc_id", "path", "text")
    val = scratch.save(listed(docs, val_list, data_root).where("doc_id is not null"))
    texts = scratch.save(_texts(docs))
    # One class for each sequence of words; its smallest ids stand for it on either side.
    member = scratch.save(texts.select("doc_id", "h", "n").distinct().join(val, "doc_id", "left"))
    listed_id, other_id = F.when(F.col("split").isNotNull(), F.col("doc_id")), F.when(F.col("split").isNull(), F.col("doc_id"))
    reps = scratch.save(member.groupBy("h", "n").agg(F.min(listed_id).alias("rv"), F.min(other_id).alias("rt")))
    equal = reps.where("rv is not null and rt is not null").select(F.col("rv").alias("a"), F.col("rt").alias("b"), F.lit(1.0).alias("share"))
    almost = _joined(_groups(texts, reps, agree, block_words), agree)
    links = scratch.save(equal.union(almost.where("share < 1.0")))
    scratch.drop(texts)
    v = member.where("split is not null").join(reps.select("h", "n", F.col("rv").alias("a")), ["h", "n"]).select(F.col("doc_id").alias("val_id"), "split", "a")
    t = member.where("split is null").join(reps.select("h", "n", F.col("rt").alias("b")), ["h", "n"]).select(F.col("doc_id").alias("train_id"), "b")
    return links.join(v, "a").join(t, "b").select("val_id", "split", "train_id", "share")


def overlap_report(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``split``, ``source`` (of the listed document), ``n_pairs``, ``n_val_docs``, ``n_train_docs``, ``n_equal``."""
    src = docs.select(F.col("doc_id").alias("val_id"), "source").dropDuplicates(["val_id"])
    return pairs.join(src, "val_id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("val_id").alias("n_val_docs"),
        F.count_distinct("train_id").alias("n_train_docs"), F.count_if(F.col("share") == 1.0).alias("n_equal"),
    )
