"""Words of texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A word is a run of letters or digits.
WORD = re.compile(r"[^\W_]+")
#: A word divided over two lines: a mark at the line's end, then the rest of the word.
DIVIDED = re.compile("(?<=[^\\W_])[-¬­‐‑=][^\\S\n]*\r?\n\\s*(?=[^\\W\\d_])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """word -> hash; emptied when it holds too many words, so that memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


word_hash = _Hashes().__getitem__


def words(text: str, join_divided: bool = True) -> list[str]:
    """The words of a text in lower case, those divided at line ends made whole."""
    if join_divided and "\n" in text:
        text = DIVIDED.sub("", text)
    return WORD.findall(text.lower())


#: The same rules for Arrow's regular expressions.
_BLANK = "\\t\\v\\f\\r\\x{1c}-\\x{1f}\\x{85}\\pZ"
_ARROW_DIVIDED, _ARROW_GAP = f"([\\pL\\pN])[-¬­‐‑=][{_BLANK}]*\n[\n{_BLANK}]*([\\pL\\p{{Nl}}\\p{{No}}])", "[^\\pL\\pN]+"
_CHARS_AT_ONCE = 1 << 28


def batch_hashes(texts: list[str | None] | pa.Array, join_divided: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes one after another, and where each text's begin (one more entry than texts).

    Texts are cut by Arrow, and each distinct word of a batch is hashed once. Null texts have no words.
    """
    col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    if len(col) > 1 and col.nbytes > _CHARS_AT_ONCE:
        half = len(col) // 2
        (h1, e1), (h2, e2) = batch_hashes(col[:half], join_divided), batch_hashes(col[half:], join_divided)
        return np.concatenate([h1, h2]), np.concatenate([e1, e1[-1] + e2[1:]])
    if not len(col):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if join_divided:
        for _ in range(2):  # a word of one letter may be divided on both sides
            col = pc.replace_substring_regex(col, _ARROW_DIVIDED, "\\1\\2")
    parts = pc.split_pattern_regex(pc.utf8_lower(col), _ARROW_GAP)
    coded = parts.flatten().dictionary_encode()
    own = np.array([word_hash(w) for w in coded.dictionary.to_pylist()], np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = at != blank
    ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])]
    return (own[at[real]] if len(own) else np.empty(0, np.uint64)), ends.astype(np.int64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; run i begins at word i. Runs over two texts are in it too."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += h[k : k + m]
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def text_of_window(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of :func:`windows`, its text, and whether it lies inside that text."""
    total = int(ends[-1])
    at = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    m = max(0, total - n + 1)
    return at[:m], (np.arange(m) + n <= ends[1:][at[:m]])
