"""Texts decoded with a wrong character encoding.

Garbled characters come in runs that are not ASCII. For each run every chain of one or two wrong
decodings is undone, and character n-gram models trained on the clean records of the same corpus
score the word with the run as it stands and with each candidate. The likeliest candidate is taken
if it is better by a margin that was validated on clean words and on the same words garbled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.scratch import Scratch

#: Encodings that texts in UTF-8 are taken for by mistake.
CODECS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
RUN = re.compile(r"[^\x00-\x7f]+")
_CONTEXT = 2
LOST = "�"


def _encode(text: str, codec: str) -> bytes | None:
    """Bytes of ``text``; control characters stand for their own byte where the codec leaves that byte free."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(codec)
            except UnicodeEncodeError:
                if 0x80 <= ord(ch) <= 0x9F:
                    out.append(ord(ch))
                else:
                    return None
        return bytes(out)


def garble(text: str, codec: str) -> str:
    """The inverse of a repair: UTF-8 read as ``codec``, bytes without a character as control characters."""
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _partial(data: bytes) -> str | None:
    """``data`` as UTF-8 where only the end of the last character is missing, which reads as a lost one."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and len(data) - e.start >= 2:
            return data[: e.start].decode("utf-8") + LOST
        return None


@lru_cache(maxsize=200_000)
def repairs(run: str) -> tuple[str, ...]:
    """What a run may have been before one or two wrong decodings, likeliest chains first."""
    found: dict[str, None] = {}
    level = [run]
    for _ in range(2):
        following = []
        for text in level:
            for codec in CODECS:
                data = _encode(text, codec)
                if data is None:
                    continue
                got = _partial(data)
                if got is not None and got != text and got not in found:
                    found[got] = None
                    following.append(got)
        level = [x for x in following if LOST not in x]
    if any("\x80" <= ch <= "\x9f" for ch in run):
        # Single bytes of a Windows encoding taken for Latin-1.
        found.setdefault("".join(ch.encode("latin-1").decode("cp1252", "replace") if "\x80" <= ch <= "\x9f" else ch for ch in run))
    return tuple(found)


def _options(run: str, right: str) -> tuple[str, ...]:
    """What a run may have been, by what follows it."""
    if right[:1] in (" ", "\n") and run[-1] in "ÃÐГ├√Ă":
        # The second byte was a no-break blank and has become a plain one, or a line end.
        return repairs(run) + tuple(x for x in repairs(run + "\xa0") if LOST not in x)
    return repairs(run)


class _Unseen(dict):
    """For ``str.translate``: characters that clean records have, and one for all others. No clean record has LOST."""

    def __missing__(self, code):
        return LOST


class Forms:
    """Runs and repairs as the model sees them: it tells no character from another that no clean record has."""

    def __init__(self, alphabet):
        self.alphabet = alphabet
        self._names = _Unseen({ord(c): c for c in alphabet})
        self._known: dict[tuple[str, bool], tuple[str, dict[str, str], str]] = {}

    def of(self, text: str) -> str:
        return text.translate(self._names)

    def options(self, run: str, right: str) -> tuple[str, dict[str, str], str]:
        """The run's form; the last repair, in order, of each form; the last repair that lost a character, or the empty text."""
        place = (run, right[:1] in (" ", "\n"))
        got = self._known.get(place)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            options = sorted(_options(run, right))
            got = self._known[place] = (self.of(run), {self.of(x): x for x in options if LOST not in x}, max((x for x in options if LOST in x), default=""))
        return got

    def wanted(self, places) -> set[str]:
        """Trigrams that the scores of (left, run, right) need, but those that end in a character never seen."""
        out, done = set(), set()
        for left, run, right in places:
            here, options, lost = self.options(run, right)
            left, right = self.of(left), self.of(right)
            for x in (here, *options) if options or lost else ():
                s = left + x + right
                if s in done:
                    continue
                if len(done) > 100_000:
                    done.clear()
                done.add(s)
                out.update(s[i - 2 : i + 1] for i in range(2, len(s)) if s[i] in self.alphabet)
        return out


class Scorer:
    """Interpolated character trigrams with additive smoothing, for the texts of one block.

    :param alphabet: for each character of the clean records how often it ends a trigram, and how often it is the middle one.
    :param seen: of each trigram that the block wants its count, that of its first two characters and that of its last two;
        those whose last two characters never stand together may be left out.
    """

    def __init__(self, alphabet: dict[str, tuple[int, int]], seen: dict[str, tuple[int, int, int]], margin: float = 0.0):
        self.alphabet = alphabet
        self.seen = seen
        self.forms = Forms(alphabet)
        self.total = sum(n for n, _ in alphabet.values()) + 1
        self.margin = margin
        self._logs: dict[str, float] = {}
        self._scores: dict[str, float] = {}
        self._known: dict[tuple[str, str, str], tuple[str | None, float]] = {}

    def _log(self, gram: str) -> float:
        n3, head2, n2 = self.seen.get(gram, (0, 0, 0))
        p3 = n3 / (head2 + 1)
        p2 = n2 / (self.alphabet.get(gram[1], (0, 0))[1] + 1)
        p1 = (self.alphabet.get(gram[2], (0, 0))[0] + 0.01) / (self.total + 10_000)
        return math.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1)

    def score(self, text: str) -> float:
        """Log probability of all characters of a form but the first two."""
        total = self._scores.get(text)
        if total is not None:
            return total
        total = 0.0
        for i in range(2, len(text)):
            gram = text[i - 2 : i + 1]
            got = self._logs.get(gram)
            if got is None:
                got = self._logs[gram] = self._log(gram)
            total += got
        if len(self._scores) > 100_000:
            self._scores.clear()
        self._scores[text] = total
        return total

    def best(self, left: str, run: str, right: str) -> tuple[str | None, float]:
        """The likeliest repair of ``run`` between its neighbours, and by how much it is likelier."""
        place = (left, run, right)
        got = self._known.get(place)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            got = self._known[place] = self._best(*place)
        return got

    def _best(self, left: str, run: str, right: str) -> tuple[str | None, float]:
        form, options, lost = self.forms.options(run, right)
        if not options and not lost:
            return None, 0.0
        left, right = self.forms.of(left), self.forms.of(right)
        here = self.score(left + form + right)
        scored = [(self.score(left + f + right), x) for f, x in options.items()]
        best = max([*scored, (here + 1e-9, lost)] if lost else scored)
        return best[1], best[0] - here


@dataclass
class CharModel:
    """All trigrams of the clean records; only its characters, which Unicode bounds, are on the driver.

    :param three: ``gram``, ``n3``, ``head2``: each trigram, its count and that of its first two characters.
    :param two: ``pair``, ``n2``: counts of the last two characters.
    :param alphabet: as of ``Scorer``, for all characters of the trigrams.
    """

    three: DataFrame
    two: DataFrame
    alphabet: dict[str, tuple[int, int]]
    margin: float = 0.0


def _by_block(rows: DataFrame, model: CharModel, places: Callable, apply: Callable, schema: str) -> DataFrame:
    """``apply(table, scorer)`` of each block of ``rows``, with the counts of the trigrams that this block needs.

    :param rows: a saved table with a column ``block``; a block fits a worker's memory.
    :param places: (left, run, right) of all runs of a table's rows, given the forms.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.alphabet)
    margin = model.margin

    def wanted(batches):
        forms = Forms(shared.value)
        for b in batches:
            blocks = np.asarray(b.column("block"))
            for k in np.unique(blocks).tolist():
                got = sorted(forms.wanted(places(b.filter(pa.array(blocks == k)), forms)))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(got), pa.int64()), pa.array(got, pa.string())], ["block", "gram"])

    def run(left, right):
        cols = (right.column(c).to_pylist() for c in ("n3", "head2", "n2"))
        return apply(left, Scorer(shared.value, dict(zip(right.column("gram").to_pylist(), zip(*cols))), margin))

    need = arrow_map(rows, wanted, "block bigint, gram string").distinct().withColumn("pair", F.substring("gram", 2, 2))
    seen = need.join(model.two, "pair").join(model.three, "gram", "left").select("block", "gram", F.coalesce("n3", F.lit(0)).alias("n3"), F.coalesce("head2", F.lit(0)).alias("head2"), "n2")
    return rows.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(run, schema)


_FOLDED = dict.fromkeys(map(ord, "\t\n\v\f\r"), " ") | dict.fromkeys(map(ord, "0123456789"), "0")


def _fold(text: str) -> str:
    """White space as one blank and digits as one digit, so that the model is about characters."""
    return text.translate(_FOLDED)


def _places(text: str):
    """(start, end, left, right) of each run, with the characters beside it."""
    for m in RUN.finditer(text):
        a, b = m.span()
        left, right = text[max(0, a - _CONTEXT) : a], text[b : b + _CONTEXT]
        yield a, b, _fold(left).rjust(_CONTEXT), _fold(right).ljust(_CONTEXT)


def _runs(text: str):
    """(left, run, right) of each run."""
    for a, b, left, right in _places(text):
        yield left, text[a:b], right


#: Characters of Western texts: what a repair must consist of to make its record unfit for training.
USUAL = re.compile("[\u00a0-\u017f\u2010-\u206f€™�]+")


@lru_cache(maxsize=200_000)
def _doubtful(run: str) -> bool:
    return any(ch == LOST or "\x80" <= ch <= "\x9f" for ch in run) or any(USUAL.fullmatch(x) for x in repairs(run))


def suspicious(text: str) -> bool:
    """Whether any run could well be the result of a wrong decoding, or a character is lost."""
    return any(map(_doubtful, RUN.findall(text)))


def count_clean_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram``, ``n``: trigrams around the runs of all records that are clean; partial counts before the shuffle."""

    def run(batches):
        grams: Counter[str] = Counter()
        for b in batches:
            for t in b.column("_text").to_pylist():
                if t and not t.isascii() and not suspicious(t):
                    for a, e, left, right in _places(t):
                        s = left + t[a:e] + right
                        grams.update(s[i : i + 3] for i in range(len(s) - 2))
            if len(grams) > 500_000:
                yield pa.RecordBatch.from_pydict({"gram": list(grams), "n": list(grams.values())})
                grams.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    parts = arrow_map(docs.select(F.col(text).alias("_text")), run, "gram string, n bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=10_000)
def garblings(ch: str) -> tuple[str, ...]:
    """A character garbled by every encoding and by every chain of two."""
    once = [garble(ch, c) for c in CODECS]
    return tuple(sorted({*once, *(garble(x, d) for x in once for d in CODECS)} - {ch}))


def train(docs: DataFrame, text: str = "text", errors: float = 0.001) -> CharModel:
    """The model of all clean records of ``docs``, with its margin.

    :param errors: the margin is the least one at which this share of the clean characters would be taken for
        garbled, each weighted by how often it stands in its context; but no larger than what all but one in a hundred
        of the same characters gain, garbled by every encoding and by every chain of two. Where these
        don't agree, it lies in the middle. All contexts of all characters count.
    """
    scratch = Scratch(docs.sparkSession, "grams")
    counts = scratch.save(count_clean_grams(docs, text))
    heads = counts.groupBy(F.substring("gram", 1, 2).alias("head")).agg(F.sum("n").alias("head2"))
    three = scratch.save(counts.withColumn("head", F.substring("gram", 1, 2)).join(heads, "head").select("gram", F.col("n").alias("n3"), "head2"))
    two = scratch.save(counts.groupBy(F.substring("gram", 2, 2).alias("pair")).agg(F.sum("n").alias("n2")))
    ends, middles = (dict(map(tuple, two.groupBy(F.substring("pair", k, 1)).agg(F.sum("n2")).collect())) for k in (2, 1))
    starts = [r[0] for r in three.select(F.substring("gram", 1, 1)).distinct().collect()]
    model = CharModel(three, two, {ch: (ends.get(ch, 0), middles.get(ch, 0)) for ch in {*starts, *ends, *middles}})
    model.margin = _margin(scratch, counts, model, errors)
    return model


def _contexts(table, forms: Forms):
    """(place of the middle, [(place of the same character garbled, number of like ones)]) of each trigram of a table."""
    known: dict[tuple[str, bool], list[tuple[str, int]]] = {}
    for g in table.column("gram").to_pylist():
        left, right = f" {g[0]}", f"{g[2]} "
        kinds = known.get((g[1], g[2] == " "))
        if kinds is None:
            like: dict[tuple, list[str]] = {}
            for x in garblings(g[1]):
                form, options, lost = forms.options(x, right)
                like.setdefault((form, frozenset(options), lost != ""), []).append(x)
            kinds = known[g[1], g[2] == " "] = [(xs[0], len(xs)) for xs in like.values()]
        yield (left, g[1], right), [((left, x, right), k) for x, k in kinds]


def _margin(scratch: Scratch, counts: DataFrame, model: CharModel, errors: float, per_block: int = 4_000) -> float:
    """The margin of ``train``; gains are counted where they arise, once for garbled characters that score the same."""
    contexts = counts.where(F.substring("gram", 2, 1) > "\x7f")
    size = contexts.count()
    if not size:
        return 0.0
    # Neighbouring blocks have the same characters, so that each needs the trigrams of few garbled ones.
    ranged = contexts.repartitionByRange(-(-size // per_block), F.substring("gram", 2, 1), "gram")
    rows = scratch.save(ranged.withColumn("block", F.spark_partition_id().cast("bigint")))

    def places(batch, forms):
        for clean, wrong in _contexts(batch, forms):
            yield clean
            yield from (place for place, _ in wrong)

    def gains(table, scorer):
        bad: Counter[float] = Counter()
        good: Counter[float] = Counter()
        for n, (clean, wrong) in zip(table.column("n").to_pylist(), _contexts(table, scorer.forms)):
            bad[scorer.best(*clean)[1]] += n
            for place, k in wrong:
                good[scorer.best(*place)[1]] += n * k
        return pa.table({"clean": [True] * len(bad) + [False] * len(good), "gain": [*bad, *good], "n": [*bad.values(), *good.values()]})

    found = _by_block(rows, model, places, gains, "clean boolean, gain double, n bigint").groupBy("clean", "gain").agg(F.sum("n").alias("n"))
    found = scratch.save(found.repartitionByRange("clean", "gain").withColumn("part", F.spark_partition_id()))
    high, low = max(_quantile(found.where("clean"), 1 - errors), 0.0), _quantile(found.where("not clean"), 0.01)
    return max(0.0, min(high + 1e-6, low) if low > high else (high + low) / 2)


def _quantile(gains: DataFrame, q: float) -> float:
    """The least gain up to which a share ``q`` of the weight lies; each ``part`` of the saved ``gains`` is a range of them."""
    parts = gains.groupBy("part").agg(F.sum("n").alias("n"), F.min("gain").alias("least")).orderBy("least").collect()
    want, seen = q * sum(p.n for p in parts), 0
    for p in parts:
        if seen + p.n >= want:
            break
        seen += p.n
    run = F.sum("n").over(Window.partitionBy("part").orderBy("gain"))
    return gains.where(F.col("part") == p.part).withColumn("run", run + seen).where(F.col("run") >= want).agg(F.min("gain")).first()[0]


def repair_text(text: str, model: Scorer) -> tuple[str, int, int]:
    """(text with the accepted repairs, runs found garbled, runs among them that can't be restored)."""
    out, last, found, lost = [], 0, 0, 0
    for a, e, left, right in _places(text):
        run = text[a:e]
        if LOST in run:
            found += 1
            lost += 1
            continue
        got, gain = model.best(left, run, right)
        if got is None:
            continue
        if LOST in got:
            found += 1
            lost += 1
        elif gain > model.margin:
            found += 1
            out += [text[last:a], got]
            last = e
    return "".join(out) + text[last:], found, lost


def repair_encoding(docs: DataFrame, key: str = "doc_id", text: str = "text", model: CharModel | None = None, per_block: int = 400_000) -> DataFrame:
    """``key``, ``n_garbled``, ``n_lost``, ``restored`` of each row with a garbled character.

    Null, empty and plain ASCII texts are never garbled. ``restored`` has every run repaired that can be;
    ``n_lost`` counts runs of which a character is gone for good. Repeated rows give repeated rows.

    :param per_block: rows are scored in blocks of about as many characters of texts and possible repairs.
    """
    model = model or train(docs, text)
    kind = docs.schema[key].dataType.simpleString()

    def candidates(batches):
        for b in batches:
            at, sizes = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                if t and not t.isascii() and (runs := [p for p in _runs(t) if LOST in p[1] or _options(p[1], p[2])]):
                    at.append(i)
                    sizes.append(len(t) + sum(len(x) + 2 * _CONTEXT for _, run, right in runs for x in _options(run, right)))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(sizes, pa.int64())], ["_key", "_text", "_size"])

    def places(batch, _):
        for t in batch.column("_text").to_pylist():
            yield from (p for p in _runs(t) if LOST not in p[1])

    def restored(table, scorer):
        ids, found, lost, fixed = [], [], [], []
        for k, t in zip(table.column("_key").to_pylist(), table.column("_text").to_pylist()):
            new, n, gone = repair_text(t, scorer)
            if n:
                ids.append(k), found.append(n), lost.append(gone), fixed.append(new)
        return pa.table([pa.array(ids, table.column("_key").type), pa.array(found, pa.int64()), pa.array(lost, pa.int64()), pa.array(fixed, pa.string())], [key, "n_garbled", "n_lost", "restored"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = arrow_map(rows, candidates, f"_key {kind}, _text string, _size bigint").withColumn("_row", F.monotonically_increasing_id())
    rows = Scratch(docs.sparkSession, "garbled").save(rows)
    blocks = -(-(rows.agg(F.sum("_size")).first()[0] or 1) // per_block)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    return _by_block(rows.select("_key", "_text", "block"), model, places, restored, f"`{key}` {kind}, n_garbled bigint, n_lost bigint, restored string")
