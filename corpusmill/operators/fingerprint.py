"""Normal form, content hash, 64-bit similarity fingerprint and its bands."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import pystr
from corpusmill.functions.arrow import arrow_map


def normalize(text: Column) -> Column:
    """Lower case; only word characters, ``, . ? ! - &`` and single blanks; null stays null."""
    kept = F.regexp_replace(text, rf"[^{pystr.WORD},.?!\-&{pystr.WS}]", "")
    return pystr.squeeze(F.lower(kept))


def content_hash(norm: Column) -> Column:
    return F.sha1(norm)


class _TokenHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:16], 16)
        return h


def simhash64(words: list[list[str]]) -> np.ndarray:
    """Fingerprints of lists of words: bit set where set token bits are at least half; equal lists give equal bits.

    Bits are added up eight to a machine word, a byte each, over runs of at most 255 words of a text.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(_TokenHash().__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(words), np.uint64)
    weight = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for a in range(0, len(words), 256):
        b = min(a + 256, len(words))
        ones = np.zeros((b - a, 64), np.int64)
        if ends[a] < ends[b]:
            bits = np.unpackbits(flat[ends[a] : ends[b]].astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
            runs = -(-n[a:b] // 255)
            first = np.concatenate([[0], np.cumsum(runs)])
            begin = np.repeat(ends[a:b] - ends[a] - first[:-1] * 255, runs) + np.arange(first[-1]) * 255
            sums = np.add.reduceat(bits, begin, axis=0).view(np.uint8).reshape(-1, 64)
            ones[runs > 0] = np.add.reduceat(sums, first[:-1][runs > 0], axis=0, dtype=np.int64)
        out[a:b] = ((2 * ones >= n[a:b, None]) * weight).sum(1, dtype=np.uint64)
    return out.view(np.int64)


def content_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 200) -> DataFrame:
    """``key``, ``chars``, ``sha1`` as of :func:`fingerprint`, in one native pass: exact copies need no fingerprint."""
    norm = docs.select(key, normalize(F.col(text)).alias("_norm")).where(F.length("_norm") >= min_chars)
    return norm.select(key, F.length("_norm").alias("chars"), content_hash(F.col("_norm")).alias("sha1"))


def status_counts(docs: DataFrame, text: str = "text", min_chars: int = 200) -> DataFrame:
    """``status``, ``n``: texts that get a fingerprint (``ok``), are ``too_short`` after normalization, or are ``unreadable``, that is null."""
    norm = normalize(F.col(text))
    status = F.when(F.col(text).isNull(), "unreadable").when(F.length(norm) < min_chars, "too_short").otherwise("ok")
    return docs.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 200) -> DataFrame:
    """``key``, ``chars``, ``simhash`` (BIGINT bit pattern), ``sha1`` of texts of at least ``min_chars`` normal characters.

    Row-local: no shuffle. Null, empty and short texts have no row; repeated rows stay repeated.
    """
    norm = docs.select(F.col(key).alias("_key"), normalize(F.col(text)).alias("_norm")).where(F.length("_norm") >= min_chars)
    ready = norm.select("_key", "_norm", F.length("_norm").alias("chars"), content_hash(F.col("_norm")).alias("sha1"))

    def run(batches):
        for b in batches:
            h = simhash64([t.split(" ") for t in b.column("_norm").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("chars"), pa.array(h), b.column("sha1")], [key, "chars", "simhash", "sha1"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(ready, run, f"`{key}` {kind}, chars int, simhash bigint, sha1 string")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return 1.0 - distance / 64.0


def max_distance(threshold: float) -> int:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    return int((1 - threshold) * 64)


def band_widths(bands: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of each band of the low ``bits``, from the low ones; the first bands take what is left over."""
    if not 1 <= bands <= bits:
        raise ValueError(f"1 to {bits} bands")
    out, at = [], 0
    for i in range(bands):
        w = bits // bands + (i < bits % bands)
        out.append((at, w))
        at += w
    return out


def band_values(simhash: Column, bands: int = 4, bits: int = 64) -> Column:
    """Array of the bands' values."""
    return F.array(*[
        F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)) for at, w in band_widths(bands, bits)
    ])


def to_hex(simhash: Column) -> Column:
    return F.lower(F.lpad(F.hex(simhash), 16, "0"))


def from_hex(text: Column) -> Column:
    """BIGINT bit pattern of 16 hexadecimal digits."""
    high, low = (F.conv(F.substring(text, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)
