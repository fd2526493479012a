"""Statistics of a text's make-up, and trees that tell prose from lists, tables and junk.

Statistics are taken for each line and summed up for the record, as a record may hold both. The trees
learn from weak labels: records in which nearly all or nearly no words stand in lines that look
structural. Their probabilities are calibrated on one half of the readers' labelled records and checked on
the other half; neither is used for training. Common words are not listed but learned: those that most
documents of a language hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.llm.trees import BoostedTrees
from corpusmill.scratch import Scratch

_SHORT = frozenset("mr mrs dr st esq vs nth th nd rd lb cwt hm hms pp mme mlle vol vols no nos".split())
_EDGE = ".,;:!?\"“”‘’„()«»'[]*_"
_NUMBER = re.compile(r"[£$]?\d[\d/%.,-]*(?:s|d|st|nd|rd|th|mo|to|vo)?")
_VOWEL = re.compile("[aeiouyàáâãäæèéêëìíîïòóôõöøœùúûüýα-ω]")
_SYMBOL = re.compile(r"[|*■•^~<>{}\[\]\\=_+/&%#@$]")
_TORN = re.compile(r"[^\W\d][.,;:!?]+[^\W\d]|[!?;:,~^|]{2}")
_JOINED = re.compile("[—–’'-]+")
_KINDS = 5  # common word, other word, number, junk, single letter or dash


def _kind_of(token: str, common: frozenset[str]) -> int:
    low = token.lower()
    t = low.strip(_EDGE)
    if not t:
        return 4 if len(low) == 1 and low not in "[]*_" else 3
    if t in common:
        return 0
    if _NUMBER.fullmatch(t):
        return 2
    parts = [x for x in _JOINED.split(t) if x]
    if not parts or (len(t) == 1 and t.isalpha()):
        return 4
    if _SYMBOL.search(t) or _TORN.search(t) or max(map(len, parts)) > 22:
        return 3
    if any(x in common for x in parts):
        return 0
    if _VOWEL.search(t):
        # Misread and garbled words stay words: a single digit for a letter, or characters that no plain text has.
        digits = sum(map(str.isdigit, t))
        return 1 if digits == 0 or (digits == 1 and len(t) > 2) or (not t.isascii() and digits < 2) else 3
    return 1 if t in _SHORT or not t.isascii() else 3


class _Memo(dict):
    """What a function says of a token; emptied when it is large."""

    def __init__(self, fn):
        self.fn = fn

    def __missing__(self, t: str) -> int:
        if len(self) > 400_000:
            self.clear()
        k = self[t] = self.fn(t)
        return k


def kinds_by(common: frozenset[str]):
    """What kind a token is, given the common words."""
    return _Memo(lambda t: _kind_of(t, common)).__getitem__


_bullet = _Memo(lambda t: int(t in ("*", "•", "—", "–", "-", "Lot") or bool(re.fullmatch(r"\d+[.)]|[A-Z][a-z]{1,2}\.", t)))).__getitem__
_STOP = frozenset(".!?,;:”\"'-’)")
_DOTS = re.compile(r"(?:\. ?){4,}")
FEATURES = (
    "n_tokens", "mean_word_length", "symbol_ratio", "comma_ratio", "common_share", "word_share", "number_share", "junk_share", "letter_share",
    "tokens_per_line", "end_stop_lines", "end_digit_lines", "bullet_lines", "leader_lines", "column_marks", "few_common_1", "few_common_2",
    "number_lines", "junk_lines", "structural", "best_line_common",
)


def _line_totals(text: str, kind) -> tuple[list[int], list[int], int, int, int]:
    """Kinds of all tokens, number of tokens of each line, and lines that end with a mark, end with a number, begin as an entry."""
    kinds: list[int] = []
    lens: list[int] = []
    stops = digits = entries = 0
    for line in text.split("\n"):
        toks = line.split()
        if toks:
            kinds.extend(map(kind, toks))
            lens.append(len(toks))
            last = toks[-1]
            stops += last[-1] in _STOP
            digits += kinds[-1] == 2
            entries += _bullet(toks[0])
    return kinds, lens, stops, digits, entries


def batch_statistics(texts: list[str | None], kind) -> np.ndarray:
    """One row of ``FEATURES`` for each text; zeros for null and empty ones. Long lines count by their tokens."""
    kinds: list[int] = []
    lens: list[int] = []
    line_ends = [0]
    plain = np.zeros((len(texts), 9))
    for i, t in enumerate(texts):
        if t:
            if "\r" in t:
                t = t.replace("\r\n", "\n").replace("\r", "\n")
            k, n, stops, digits, entries = _line_totals(t, kind)
            kinds.extend(k)
            lens.extend(n)
            lines, tokens = max(1, len(n)), len(k)
            chars = max(1, len(t) - t.count(" ") - t.count("\n"))
            plain[i] = (
                tokens, chars, len(_SYMBOL.findall(t)) / chars, t.count(",") / max(1, tokens), stops / lines, digits / lines, entries / lines,
                len(_DOTS.findall(t)) / lines if ". . ." in t or "...." in t else 0.0,
                (t.count("   ") + t.count("\t") + t.count("|") + t.count("│")) / lines,
            )
        line_ends.append(len(lens))
    size, n_lines = np.array(lens, np.int64), len(lens)
    line = np.repeat(np.arange(n_lines), size)
    per = np.bincount(line * _KINDS + np.array(kinds, np.int64), minlength=n_lines * _KINDS).reshape(n_lines, _KINDS).astype(float)
    ends = np.array(line_ends)
    rec = np.repeat(np.arange(len(texts)), np.diff(ends))
    # A short line is judged with its neighbours in the record: the last words of a paragraph say little.
    cum = np.vstack([np.zeros(_KINDS), per.cumsum(0)])
    lo, hi = np.maximum(np.arange(n_lines) - 1, ends[:-1][rec]), np.minimum(np.arange(n_lines) + 2, ends[1:][rec])
    short = size < 5
    near = np.where(short[:, None], cum[hi] - cum[lo], per)
    share = near / np.maximum(near.sum(1, keepdims=True), 1)
    w = size.astype(float)

    def by_record(x):
        return np.bincount(rec, x, len(texts))

    total = np.maximum(by_record(w), 1)
    few = share[:, 0] < 0.2
    number, junk = share[:, 2] > 0.3, share[:, 3] > 0.35
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = plain[:, 0]
    out[:, 1] = plain[:, 1] / np.maximum(plain[:, 0], 1)
    out[:, 2:4] = plain[:, 2:4]
    out[:, 4:9] = np.stack([by_record(per[:, k]) / total for k in range(_KINDS)], 1)
    out[:, 9] = total / np.maximum(np.diff(ends), 1)
    out[:, 10:15] = plain[:, 4:9]
    out[:, 15] = by_record(w * few) / total
    out[:, 16] = by_record(w * (share[:, 0] < 0.3)) / total
    out[:, 17] = by_record(w * number) / total
    out[:, 18] = by_record(w * junk) / total
    out[:, 19] = by_record(w * (few | number | junk)) / total
    if n_lines:
        out[np.unique(rec), 20] = np.maximum.reduceat(share[:, 0], ends[:-1][np.diff(ends) > 0])
    return out


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = 0.4, least: float = 0.01) -> frozenset[str]:
    """Words that at least ``share`` of a language's documents hold, of every language with ``least`` of all documents.

    All texts are counted; null languages and texts are left out. As a document holds only so many different words,
    few can be in so many documents, so what comes to the driver doesn't grow with the corpus.
    """
    import pyarrow.compute as pc

    def run(batches):
        n: dict[tuple[str, str], int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])
            n.clear()
            return out

        for b in batches:
            for name in pc.unique(b.column("lang")).to_pylist():
                texts = b.column("text").filter(pc.equal(b.column("lang"), name))
                n[name, ""] = n.get((name, ""), 0) + len(texts)
                parts = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\pL\pN]+")
                coded = parts.flatten().dictionary_encode()
                doc = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
                code = coded.indices.to_numpy(zero_copy_only=False)
                k = np.bincount(np.unique(doc * max(1, len(coded.dictionary)) + code) % max(1, len(coded.dictionary)), minlength=len(coded.dictionary))
                for w, c in zip(coded.dictionary.to_pylist(), k.tolist()):
                    if w:
                        n[name, w] = n.get((name, w), 0) + c
            if len(n) > 500_000:
                yield rows()
        yield rows()

    known = docs.select(F.lower(F.trim(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = arrow_map(known, run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "words").save(counts)
    # The number of a language's documents is counted as that of the empty word. Few languages have a share.
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    large = counts.where((F.col("word") == "") & (F.col("n") >= least * total)).collect() if total else []
    held = F.lit(False)
    for r in large:
        held = held | ((F.col("lang") == r["lang"]) & (F.col("n") >= r["n"] * share))
    return frozenset(r["word"] for r in counts.where(held & (F.col("word") != "")).select("word").distinct().collect())


def text_statistics(df: DataFrame, keep: list[str], text: str, common: frozenset[str]) -> DataFrame:
    """``keep`` and one DOUBLE column for each of ``FEATURES``. Whole texts are read; null and empty ones give zeros."""
    rows = df.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        kind = kinds_by(common)
        for b in batches:
            x = batch_statistics(b.column("_text").to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(x[:, i]) for i in range(x.shape[1])]], [*keep, *FEATURES])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return arrow_map(rows, run, f"{kinds}, " + ", ".join(f"{c} double" for c in FEATURES))


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 for structure, 0 for prose, -1 where the rules don't agree."""
    f = {c: x[:, i] for i, c in enumerate(FEATURES)}
    structure = (f["structural"] > 0.75) & ((f["common_share"] < 0.2) | (f["junk_share"] > 0.3) | (f["number_share"] > 0.3))
    prose = (f["structural"] < 0.3) & (f["common_share"] > 0.27)
    return np.where(structure, 1, np.where(prose, 0, -1))


@dataclass
class QualityModel:
    """Trees, the common words of their statistics, and how far they agree with labels that were held out."""

    trees: BoostedTrees
    common: frozenset[str]
    n_trained: int = 0
    n_calibrated: int = 0
    n_held_out: int = 0
    n_agree: int = 0


def train(
    records: DataFrame, labels: DataFrame, common: frozenset[str], least_tokens: int = 12, max_records: int = 40_000, max_labels: int = 10_000
) -> QualityModel:
    """Trees from weak labels, calibrated on readers' labels.

    :param records: ``tab``, ``rec_id``, ``text``.
    :param labels: ``tab``, ``rec_id``, ``kind_label``; a record counts as structure if more than half of its labels are not ``prose``.
    :param max_records: bound of the sample of records without labels, chosen by hash on the executors.
    :param max_labels: bound of the labelled records, chosen alike; one half calibrates, the other is held out.
    """
    by = F.xxhash64("tab", "rec_id", F.lit(5))

    def below(share: float) -> Column:
        return F.pmod(by, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

    votes = labels.where("tab is not null and rec_id is not null and kind_label is not null").groupBy("tab", "rec_id").agg(
        F.avg(F.when(F.col("kind_label") == "prose", 0.0).otherwise(1.0)).alias("v")
    ).where("v <> 0.5")
    votes = votes.where(below(max_labels / max(1, votes.count())))
    share = max_records / max(1, records.select("rec_id").count())
    # The labelled records are at most ``max_labels`` by their count.
    chosen = records.join(F.broadcast(votes), ["tab", "rec_id"], "left").where(F.col("v").isNotNull() | below(share))
    got = text_statistics(chosen.withColumn("half", F.pmod(F.xxhash64("tab", "rec_id", F.lit(9)), F.lit(2))), ["tab", "rec_id", "v", "half"], "text", common).where(F.col("n_tokens") >= least_tokens)
    t = got.toArrow().sort_by([("tab", "ascending"), ("rec_id", "ascending"), *[(c, "ascending") for c in FEATURES]])
    x = np.stack([t.column(c).to_numpy() for c in FEATURES], 1).reshape(-1, len(FEATURES))
    v, half = t.column("v").to_numpy(zero_copy_only=False).astype(float), t.column("half").to_numpy()
    weak = weak_labels(x)
    own = np.isnan(v) & (weak >= 0)
    model = QualityModel(BoostedTrees().fit(x[own], weak[own].astype(float)), common, int(own.sum()))
    seen, out = ~np.isnan(v) & (half == 0), ~np.isnan(v) & (half == 1)
    if seen.any():
        model.trees.calibrate(x[seen], (v[seen] > 0.5).astype(float))
    model.n_calibrated, model.n_held_out = int(seen.sum()), int(out.sum())
    if out.any():
        model.n_agree = int(((model.trees.probability(x[out]) >= 0.5) == (v[out] > 0.5)).sum())
    return model


def structure_probability(records: DataFrame, model: QualityModel) -> DataFrame:
    """``tab``, ``rec_id``, ``n_tokens``, ``probability`` of being mostly a list, a table or junk; texts are read once, in one narrow pass."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        kind = kinds_by(m.common)
        for b in batches:
            x = batch_statistics(b.column("text").to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("rec_id"), pa.array(x[:, 0]), pa.array(m.trees.probability(x))], ["tab", "rec_id", "n_tokens", "probability"])

    return arrow_map(records.select("tab", "rec_id", "text"), run, "tab string, rec_id bigint, n_tokens double, probability double")
