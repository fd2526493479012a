"""Split, sequential packing, checks of packed rows, chat rendering and token statistics."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import pystr
from corpusmill.functions.arrow import arrow_map


def keyed_order(key: Column, seed: int) -> Column:
    """A repeatable shuffle: rows in order of this hash."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def in_keyed_order(seqs: DataFrame, seed: int, key: str = "seq_id") -> DataFrame:
    """The sequences with ``key`` replaced by a text that sorts in keyed order; the old key is its end."""
    return seqs.withColumn(key, F.concat(keyed_order(F.col(key), seed), F.lit(":"), F.lpad(F.col(key).cast("string"), 20, "0")))


def without_newlines(text: Column) -> Column:
    """Every line end as one blank, for a tokenizer that is to see no lines."""
    return F.regexp_replace(text, "\r\n?|\n", " ")


def staged(rows: DataFrame, shares: list[float], key: str = "block") -> DataFrame:
    """Adds ``stage``: rows in order of ``key`` (0 to n - 1) given to stages by shares of all rows; the last stage takes the rest."""
    n = rows.count()
    stage, done = F.lit(len(shares) - 1), 0.0
    for i, share in reversed(list(enumerate(shares[:-1]))):
        stage = F.when(F.col(key) < int(n * sum(shares[: i + 1])), i).otherwise(stage)
    return rows.withColumn("stage", stage)


def stratified_split(docs: DataFrame, percent: float = 1, seed: int = 123, key: str = "doc_id", stratum: str = "source", digits: int = 4) -> DataFrame:
    """Adds ``split``: ``val`` for ``max(1, n * percent / 100)`` rows of each stratum by keyed hash, else ``train``.

    A stratum may hold a third of all rows, so it isn't sorted as a whole: counts of the hashes' first ``digits`` tell
    where the last row of the share lies, and only the rows there are ranked, by hash and key alone. All other columns
    meet one row for each stratum. A null stratum is one of its own, a null key is never ``val``; a repeated key counts twice.
    """
    h = keyed_order(F.col(key), seed)
    rows = docs.select(F.col(stratum).alias("_s"), F.col(key).alias("_k"), h.alias("_h"), F.substring(h, 1, digits).alias("_b")).where("_h is not null")
    sizes = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_s")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(w)})
    sizes = sizes.withColumn("_want", F.greatest(F.lit(1), F.floor(F.col("_all") * percent / 100)))
    border = sizes.where("_before < _want and _before + _n >= _want").select(F.col("_s").alias("_bs"), F.col("_b").alias("_bb"), "_before", "_want")
    near = rows.join(border, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_b") == F.col("_bb")))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", "_k"))
    last = near.withColumn("_rank", rank).where("_before + _rank = _want").select("_s", F.struct("_h", "_k").alias("_last"))
    joined = docs.withColumn("_h", h).join(last, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    own = F.struct("_h", F.col(key).alias("_k"))
    return joined.withColumn("split", F.when(F.col("_h").isNotNull() & (own <= F.col("_last")), "val").otherwise("train")).drop("_h", "_s", "_last")


def split_counts(split: DataFrame, stratum: str = "source") -> DataFrame:
    return split.groupBy(stratum, "split").agg(F.count(F.lit(1)).alias("n_docs"))


def sampled(docs: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows by keyed hash: the sampling operator for a tokenizer's statistics."""
    return docs.orderBy(keyed_order(F.col(key), seed), key).limit(n)


def offsets(seqs: DataFrame, key: str = "seq_id", ids: str = "input_ids", ranges: int = 200) -> DataFrame:
    """``key``, ``ids``, ``n``, ``off``: each sequence with the number of ids before it, in order of ``key``.

    Prefix sums on two levels: totals of key ranges are summed first, so no window is over the whole table.
    Null and empty sequences are left out. Rows repeated with one key count once.
    """
    rows = seqs.where(F.col(key).isNotNull() & (F.size(ids) > 0)).groupBy(key).agg(F.max(ids).alias(ids)).withColumn("n", F.size(ids).cast("bigint"))
    if isinstance(seqs.schema[key].dataType, StringType):
        # Texts in keyed order: their first digits are ranges of equal size.
        rows = rows.withColumn("_r", F.conv(F.substring(key, 1, 3), 16, 10).cast("bigint"))
    else:
        span = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("k")).first()
        lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
        step = (hi - lo) // max(ranges, span["k"] // 100_000) + 1
        rows = rows.withColumn("_r", F.floor((F.col(key) - lo) / step))
    total = rows.groupBy("_r").agg(F.sum("n").alias("_t"))  # one row for each range
    before = total.withColumn("_o", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_o")
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(before, "_r").select(key, ids, "n", (F.col("_own") + F.col("_o")).alias("off"))


def pack_blocks(seqs: DataFrame, max_context: int = 4096, key: str = "seq_id", ids: str = "input_ids", name: str = "file_name") -> DataFrame:
    """``block``, ``input_ids``, ``file_names``: all ids in order, cut into blocks of ``max_context`` + 1, the rest dropped.

    ``file_names`` are the distinct names of the sequences in the block, in order.
    """
    size = max_context + 1
    names = seqs.groupBy(key).agg(F.min(name).alias("_name"))
    spans = offsets(seqs, key, ids).join(names, key)
    parts = spans.withColumn("block", F.explode(F.sequence(F.expr(f"off div {size}"), F.expr(f"(off + n - 1) div {size}"))))
    start = F.greatest(F.lit(0), F.col("block") * size - F.col("off"))
    stop = F.least(F.col("n"), (F.col("block") + 1) * size - F.col("off"))
    cut = F.slice(ids, (start + 1).cast("int"), (stop - start).cast("int"))
    rows = parts.select("block", F.struct("off", cut.alias("ids"), F.col("_name").alias("name")).alias("p"))
    out = rows.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["ids"]))
    return out.select("block", flat.alias("input_ids"), F.array_distinct(F.transform("p", lambda x: x["name"])).alias("file_names")).where(F.size("input_ids") == size)


def pack_totals(seqs: DataFrame, max_context: int = 4096, key: str = "seq_id", ids: str = "input_ids") -> DataFrame:
    """One row: ``n_tokens``, ``n_blocks``."""
    one = seqs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.size(ids), F.lit(0))).alias("n"))
    return one.agg(F.coalesce(F.sum(F.greatest(F.col("n"), F.lit(0))), F.lit(0)).cast("bigint").alias("n_tokens")).withColumn("n_blocks", F.expr(f"n_tokens div {max_context + 1}"))


def validate_rows(rows: DataFrame, max_context: int = 4096, vocab: int = 50257, ids: str = "input_ids") -> DataFrame:
    """One row over the whole table: ``n_rows``, ``wrong_length``, ``least_id``, ``largest_id``, ``valid``. An empty table isn't valid."""
    out = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(F.size(ids) != max_context + 1, F.lit(True))).alias("wrong_length"),
        F.min(F.array_min(ids)).cast("bigint").alias("least_id"), F.max(F.array_max(ids)).cast("bigint").alias("largest_id"),
    )
    ok = (F.col("n_rows") > 0) & (F.col("wrong_length") == 0) & (F.col("least_id") >= 0) & (F.col("largest_id") < vocab)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def shifted(rows: DataFrame, max_context: int = 4096, ids: str = "input_ids") -> DataFrame:
    """Adds ``inputs``, ``labels`` and ``attention_mask``; a row of wrong length is an error."""
    size = max_context + 1
    good = F.when(F.size(ids) == size, F.col(ids)).otherwise(F.raise_error(F.concat(F.lit(f"row length is not {size}: "), F.size(ids).cast("string"))).cast("array<int>"))
    return rows.withColumns({"inputs": F.slice(good, 1, max_context), "labels": F.slice(good, 2, max_context), "attention_mask": F.array_repeat(F.lit(1), max_context)})


def repeated_rows(rows: DataFrame, total: int, key: str = "block") -> DataFrame:
    """``i`` from 0 to ``total`` - 1 with row ``i mod n`` in order of ``key``; an empty table is an error. Keys are 0 to n - 1."""
    n = rows.count()
    if n == 0:
        raise ValueError("no rows to repeat")
    want = rows.sparkSession.range(total).withColumn("_k", F.pmod("id", F.lit(n)))
    return want.join(rows, want["_k"] == rows[key]).withColumnRenamed("id", "i").drop("_k")


def steps_per_epoch(n_rows: Column, batch: int, accumulation: int) -> Column:
    return F.ceil(n_rows / float(batch * accumulation))


def enough_tokens(n_rows: Column, max_context: int, steps: int, batch: int, accumulation: int) -> Column:
    """Whether there are the tokens that the steps need."""
    return F.lit(steps * batch * accumulation * max_context) <= n_rows * max_context


def perplexity(loss: Column) -> Column:
    """exp(loss) where loss is under 100, else null."""
    return F.when(loss < 100, F.exp(loss))


# Tokens that begin and end a message, and the end of a text.
MESSAGE_START, MESSAGE_END, END_OF_TEXT, UNKNOWN = "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>"


def render_chat(turns: DataFrame, conv: str = "conv_id", generation_prompt: bool = False) -> DataFrame:
    """``conv``, ``rendered``: the messages of a conversation in order of ``turn``; null parts count as empty."""
    message = F.concat(F.lit(MESSAGE_START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(MESSAGE_END + "\n"))
    out = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["m"]), "")
    return out.select(conv, F.concat(body, F.lit(f"{MESSAGE_START}assistant\n" if generation_prompt else "")).alias("rendered"))


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n``: how often each word between blanks stands in the corpus."""
    return docs.select(F.explode(pystr.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """``left``, ``right``, ``n``: how often two characters stand side by side in the words; what a merge is chosen by."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring(F.col("word"), i, F.lit(1)).alias("left"), F.substring(F.col("word"), i + 1, F.lit(1)).alias("right")))
    return counts.where(F.length("word") > 1).select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


#: Where the files of public tokenizers lie.
TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")


def special_ids(tokenizer_json: str, tokens: tuple[str, ...] = (END_OF_TEXT, UNKNOWN, MESSAGE_START, MESSAGE_END)) -> dict[str, int]:
    """Ids of special tokens by a tokenizer's file; those that it doesn't have follow behind its vocabulary in the order given."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_json)
    nxt, out = tok.get_vocab_size(), {}
    for t in tokens:
        out[t] = tok.token_to_id(t)
        if out[t] is None:
            out[t], nxt = nxt, nxt + 1
    return out


def check_vocabulary(tokenizer_json: str, size: int) -> int:
    """The size of the vocabulary; an error if a model's ``size`` doesn't agree with it."""
    from tokenizers import Tokenizer

    n = Tokenizer.from_file(tokenizer_json).get_vocab_size()
    if n != size:
        raise ValueError(f"the tokenizer has {n} tokens, the model {size}")
    return n


def round_trip(docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_ids``, ``same``: whether decoding the ids of a text gives the text again, but for blanks at its ends. Null texts have no ids."""
    with open(tokenizer_json, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data.value)
        tok.encode_special_tokens = True
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
            same = [x.strip() == t.strip() for x, t in zip(tok.decode_batch(ids, skip_special_tokens=False), texts)]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())], [key, "n_ids", "same"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), run, f"`{key}` {kind}, n_ids bigint, same boolean")


def encode(docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", end: int | None = None) -> DataFrame:
    """``key``, ``ids`` by a public tokenizer's file; ``end`` is appended to every text. Null texts have no ids but ``end``.

    The file is read on the driver and broadcast, as its size is fixed; no truncation, no padding.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data.value)
        tok.encode_special_tokens = True
        tail = [] if end is None else [end]
        for b in batches:
            got = tok.encode_batch([t or "" for t in b.column("_text").to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array([e.ids + tail for e in got], pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), run, f"`{key}` {kind}, ids array<int>")
