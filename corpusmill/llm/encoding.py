"""Token ids of texts by prefix dynamic programming.

For a byte-level BPE every prefix of a piece has one valid last token: the last token of the
prefix's own encoding. The table of these tokens is filled from left to right; a token that is a
suffix of the prefix is the valid one if the pair of it and the token before it would not be merged
differently. An append therefore only extends the table; after an edit it is filled again from the
edited byte until so many entries as the longest token has bytes are the old ones. A text is cut into
pieces by the tokenizer's own pattern, and as the ids of a piece don't depend on its surroundings, each
distinct piece is encoded once for a worker, and an edited text is cut anew around the edit only.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusmill.functions.arrow import arrow_map

TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")
# How the public tokenizer cuts texts into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixEncoder:
    """Byte-level BPE with a table of each prefix's valid last token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.longest = max(map(len, ranks))
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.cache: dict[str, list[int]] = {}
        self.loose = regex.compile(r"\s (?:\s|\Z)").search

    @classmethod
    def load(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``: its encoding by the merges of lower rank."""
        if token not in self.parts:
            if len(token) == 1:
                self.parts[token] = None
            else:
                got = self._merge(token, self.ranks[token])
                self.parts[token] = (got[0], got[1]) if len(got) == 2 else None
        return self.parts[token]

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        got = [data[i : i + 1] for i in range(len(data))]
        while len(got) > 1:
            rank, i = min((self.ranks.get(got[i] + got[i + 1], below), i) for i in range(len(got) - 1))
            if rank >= below:
                break
            got[i : i + 2] = [got[i] + got[i + 1]]
        return got

    def _stands(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens would stay side by side: undo merges, latest first, and see that none crosses."""
        ranks, limit = self.ranks, 1 << 60
        while True:
            if ranks.get(left + right, limit) < limit:
                return False
            l, r = ranks[left], ranks[right]
            if l > r:
                limit, halves = l, self._halves(left)
                if halves is None:
                    limit, halves = r + 1, self._halves(right)
                    if halves is None:
                        return True
                    right = halves[0]
                else:
                    left = halves[1]
            else:
                limit, halves = r + 1, self._halves(right)
                if halves is None:
                    limit, halves = l, self._halves(left)
                    if halves is None:
                        return True
                    left = halves[1]
                else:
                    right = halves[0]

    def extend(self, data: bytes, last: list[bytes]) -> list[bytes]:
        """Fill the table ``last`` (entry i: last token of the first i + 1 bytes) up to the end of ``data``."""
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if token in self.ranks and self._whole(token) and (start == 0 or self._stands(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
        return last

    def _whole(self, token: bytes) -> bool:
        return len(token) == 1 or self._halves(token) is not None

    def table_ids(self, last: list[bytes]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(self.ranks[token])
            end -= len(token)
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.table_ids(self.extend(data, []))

    def edited(self, old: bytes, last: list[bytes], at: int, new: bytes, removed: int | None = None) -> tuple[bytes, list[bytes]]:
        """The piece with ``removed`` bytes at ``at`` (all that follow, if not said) replaced by ``new``, and its table.

        What lies before is kept. Behind the edit an entry depends on as many bytes and entries before it as the longest
        token has, so once these are the old ones, all that follow are.
        """
        rest = b"" if removed is None else old[at + removed :]
        data, table, same = old[:at] + new + rest, last[:at], 0
        shift = len(old) - len(data)
        for end in range(at + 1, len(data) + 1):
            self.extend(data[:end], table)
            behind = end > at + len(new) + self.longest
            same = same + 1 if behind and table[-1] == last[end - 1 + shift] else 0
            if same > self.longest:
                return data, table + last[end + shift :]
        return data, table

    def text_table(self, text: str, begin: int = 0, stop: set[int] | None = None) -> list[tuple[int, list[int]]]:
        """(place, ids) of each piece of a text from ``begin`` on, up to the end or to a place in ``stop``."""
        out = []
        for m in self.pattern.finditer(text, begin):
            if stop and m.start() in stop:
                break
            out.append((m.start(), self._unit_piece(m[0])))
        return out

    def edited_text(self, text: str, table: list[tuple[int, list[int]]], start: int, end: int, new: str) -> tuple[str, list[tuple[int, list[int]]]]:
        """The text with ``start`` to ``end`` replaced, and its table; only pieces around the edit are cut and encoded anew.

        Cutting goes from left to right and looks ahead over white space and one character more. So pieces before the
        one that the edit touches stand, and from the first old place behind the edit on all old pieces stand again.
        """
        k = max(0, bisect_left(table, start, key=lambda x: x[0]) - 1)
        while k and text[table[k][0] : start].isspace() | (table[k][0] >= start):
            k -= 1
        begin = table[k][0] if table else 0
        fresh, shift = text[:start] + new + text[end:], len(new) - (end - start)
        later = bisect_left(table, end, key=lambda x: x[0])
        places = {p + shift: i for i, (p, _) in enumerate(table[later:], later)}
        middle = self.text_table(fresh, begin, {p for p in places if p >= start + len(new)})
        at = middle[-1][0] + len(self.pattern.match(fresh, middle[-1][0])[0]) if middle else begin
        rest = places.get(at, len(table)) if at < len(fresh) else len(table)
        return fresh, table[:k] + middle + [(p + shift, ids) for p, ids in table[rest:]]

    def _unit(self, text: str) -> list[int]:
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = [i for p in self.split(text) for i in self.piece(p.encode("utf-8", "surrogatepass"))]
            if len(text) < 64:
                self.cache[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; none for a null or empty text.

        A blank before a visible character always begins a piece, so a text without blanks inside
        longer white space is cut there first and the parts are looked up.
        """
        if not text:
            return []
        if self.loose(text):
            return [i for p in self.split(text) for i in self._unit_piece(p)]
        first, *rest = text.split(" ")
        out = list(self._unit(first)) if first else []
        cache, unit, add = self.cache, self._unit, out.extend
        for w in rest:
            w = " " + w
            add(cache.get(w) or unit(w))
        return out

    def _unit_piece(self, piece: str) -> list[int]:
        key = "\0" + piece  # a piece of the pattern, not a part that has yet to be cut
        got = self.cache.get(key)
        if got is None:
            got = self.piece(piece.encode("utf-8", "surrogatepass"))
            if len(piece) < 64:
                self.cache[key] = got
        return got


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key``, ``ids`` of every row, in one pass without a shuffle.

    Null and empty texts have the empty list. Special tokens' strings are ordinary text. Whole texts
    are encoded; repeated rows stay repeated.

    :param tokenizer: the ranks file; it is read on the driver and broadcast, as its size is fixed.
    """
    with open(tokenizer, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def run(batches):
        enc = PrefixEncoder(data.value)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column("_text").to_pylist():
                flat.extend(enc.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(key), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.selectExpr(f"`{key}`", f"`{text}` as _text"), run, f"`{key}` {kind}, ids array<int>")


def edit_check(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key``, ``n_kept``, ``n_pieces``, ``same``: each text with words put into its middle and behind its end, encoded around the edits, against encoding it whole.

    ``n_kept`` of ``n_pieces`` pieces are those of the old text. Null texts count as empty.
    """
    with open(tokenizer, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def run(batches):
        enc = PrefixEncoder(data.value)
        for b in batches:
            kept, pieces, same = [], [], []
            for t in b.column("_text").to_pylist():
                old = enc.text_table(t or "")
                half = len(t or "") // 2
                one, table = enc.edited_text(t or "", old, half, min(half + 3, len(t or "")), "xy  edited'")
                two, table = enc.edited_text(one, table, len(one), len(one), " and more")
                known = {id(ids) for _, ids in old}
                kept.append(sum(id(ids) in known for _, ids in table)), pieces.append(len(table))
                same.append([i for _, ids in table for i in ids] == enc.encode(two))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(kept, pa.int64()), pa.array(pieces, pa.int64()), pa.array(same, pa.bool_())], [key, "n_kept", "n_pieces", "same"])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.selectExpr(f"`{key}`", f"`{text}` as _text"), run, f"`{key}` {kind}, n_kept bigint, n_pieces bigint, same boolean")
