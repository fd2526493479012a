"""Passages of evaluation items in training documents.

The items are a fixed, small table: its word n-grams are broadcast, behind a check of their number.
Documents are scanned once. A window of ``span`` words that agrees with an item but for one word in
``error`` must share at least ``span - n + 1 - n * floor(span / error)`` n-grams with it, so windows
with fewer hits can't match; the others are verified by dynamic programming on their words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.functions.words import batch_hashes, text_of_window, windows

_BITS = 24


class LeakIndex:
    """N-grams of the items, held by every executor.

    :param max_words: more words than this in all items is an error, as the index is broadcast; split
        the items and scan once for each part instead.
    """

    def __init__(self, items: list[tuple[int, str | None]], n: int = 5, span: int = 20, error: int = 8, max_words: int = 4_000_000):
        self.n, self.span, self.error = n, span, error
        items = sorted(i for i in items if i[0] is not None and i[1])
        self.ids = np.array([i for i, _ in items], np.int64)
        self.h, self.ends = batch_hashes([t for _, t in items])
        if len(self.h) > max_words:
            raise ValueError(f"the items have {len(self.h)} words; at most {max_words} are broadcast")
        self.need = span - span // error
        self.min_hits = max(1, span - n + 1 - n * (span // error))
        w = windows(self.h, n)
        at, inside = text_of_window(self.ends, n)
        pos = np.flatnonzero(inside)
        order = np.argsort(w[pos], kind="stable")
        self.key, self.pos, self.item = w[pos][order], pos[order], at[pos][order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.key & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, position in it, item, position in it) of each n-gram in common."""
        w = windows(h, self.n)
        if not len(w) or not len(self.key):
            return (np.empty(0, np.int64),) * 4
        at, inside = text_of_window(ends, self.n)
        p = np.flatnonzero(self.bitmap[w & np.uint64((1 << _BITS) - 1)] & inside)
        lo, hi = np.searchsorted(self.key, w[p], "left"), np.searchsorted(self.key, w[p], "right")
        k = hi - lo
        which = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        p = np.repeat(p, k)
        item = self.item[which]
        return at[p], p - ends[:-1][at[p]], item, self.pos[which] - self.ends[:-1][item]

    def batch(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, last word + 1) for each run of a text that matches an item; the words are the text's."""
        h, ends = batch_hashes(texts)
        t, p, item, q = self.hits(h, ends)
        if not len(t):
            return []
        pair = t * len(self.ids) + item
        order = np.lexsort((p, q, pair))
        pair, p, q = pair[order], p[order], q[order]
        # Only pairs with ``min_hits`` places of the item hit within one span can hold a match.
        fresh = np.r_[True, (pair[1:] != pair[:-1]) | (q[1:] != q[:-1])]
        up, uq, m = pair[fresh], q[fresh], self.min_hits - 1
        dense = up[: len(up) - m][(up[m:] == up[: len(up) - m]) & (uq[m:] - uq[: len(uq) - m] <= self.span - self.n)]
        keep = np.isin(pair, np.unique(dense))
        pair, p, q = pair[keep], p[keep], q[keep]
        if not len(pair):
            return []
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        out = []
        for a, b in zip(first, np.r_[first[1:], len(pair)]):
            text, it = divmod(int(pair[a]), len(self.ids))
            for x, y in self._runs(h[ends[text] : ends[text + 1]], self.h[self.ends[it] : self.ends[it + 1]], p[a:b], q[a:b]):
                out.append((text, it, x, y))
        return out

    def _runs(self, doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of the text's words that matching windows cover, in order; between two of them are more words than may be misread in a window."""
        span, slack = self.span, 2 * self.span
        if len(item) < span:
            return []
        found: list[tuple[int, int]] = []
        groups: dict[int, list[int]] = defaultdict(list)
        once = len(np.unique(q)) == len(q)
        for x, y in zip(p.tolist(), q.tolist()):
            d = (x - y) // slack
            groups[d].append(y)
            groups[d + 1].append(y)  # neighbouring bands overlap, so a window is whole in one of them
        for d, ys in sorted(groups.items()):
            ys = sorted(set(ys))
            if len(ys) < self.min_hits:
                continue
            # Windows that the dense hits allow and of whose words enough occur near their place in the text.
            starts: set[int] = set()
            for i in range(len(ys) - self.min_hits + 1):
                end = ys[i + self.min_hits - 1] + self.n
                if end - ys[i] <= span:
                    starts.update(range(max(0, end - span), min(ys[i], len(item) - span) + 1))
            if not starts:
                continue
            near = doc[max(0, min(starts) + (d - 1) * slack) : max(starts) + (d + 1) * slack + span]
            seen = np.r_[0, np.cumsum(np.isin(item, near))]
            ok = sorted(s for s in starts if seen[s + span] - seen[s] >= self.need)
            known: dict[int, list[tuple[int, int]]] = {}

            def places(s: int, d: int = d, known: dict = known) -> list[tuple[int, int]]:
                if s not in known:
                    a = max(0, s + (d - 1) * slack)
                    known[s] = [(a + x, a + y) for x, y in _fits(item[s : s + span].tolist(), doc[a : s + (d + 1) * slack + span].tolist(), self.need)]
                return known[s]

            i = 0
            while i < len(ok):
                got = places(ok[i])
                found += got
                # The windows between two that match and touch cover nothing more, so the farthest one is next,
                # unless the text quotes the item again.
                j = bisect_right(ok, ok[i] + self.need) - 1 if got and once else i
                while j > i and not places(ok[j]):
                    j -= 1
                i = max(j, i + 1)
        runs: list[tuple[int, int]] = []
        for x, y in sorted(found):
            if runs and x <= runs[-1][1] + span - self.need:
                runs[-1] = (runs[-1][0], max(y, runs[-1][1]))
            else:
                runs.append((x, y))
        return runs


def _fits(window: list[int], text: list[int], need: int) -> list[tuple[int, int]]:
    """Where in ``text`` at least ``need`` words of ``window`` stand in order within one window's length and slack, one place after another."""
    n = 2 * len(window) - need
    here = set(window)
    flag = [x in here for x in text]
    if sum(flag) < need:
        return []
    full = (1 << len(window)) - 1
    masks: dict[int, int] = defaultdict(int)
    for i, x in enumerate(window):
        masks[x] |= 1 << i
    out = []
    count, free = sum(flag[:n]), 0
    for a in range(len(text) - need + 1):
        if a:
            count += (flag[a + n - 1] if a + n - 1 < len(text) else 0) - flag[a - 1]
        if a < free or count < need or not flag[a]:
            continue
        v, end, had = full, 0, 0
        for k, x in enumerate(text[a : a + n]):
            u = v & masks.get(x, 0)
            v = ((v + u) | (v - u)) & full
            got = len(window) - v.bit_count()
            if end and got == had:
                break  # the words right behind the needed ones go along while they match, too
            had = got
            if got >= need:
                end = a + k + 1
        if end:
            out.append((a, end))
            free = end
    return out


def _index(items: DataFrame, max_words: int = 4_000_000, **how) -> LeakIndex:
    """The index of all items; their words are counted by Spark before any text comes to the driver."""
    n = items.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    if n > max_words + 2 * items.count():
        raise ValueError(f"the items have {n} words; at most {max_words} are broadcast")
    return LeakIndex([(r[0], r[1]) for r in items.select("item_id", "text").collect()], max_words=max_words, **how)


def leaked_items(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``end_word``: which items each document leaks, and where.

    One row for each maximal run of words that matching windows cover, so an item quoted twice has two rows.
    Null and empty texts leak nothing, items of less than ``span`` words can't be leaked; items with
    a null id are left out. ``docs`` with repeated rows give repeated rows.
    """
    index = docs.sparkSession.sparkContext.broadcast(_index(items, **how))

    def run(batches):
        ix = index.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            got = ix.batch(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[t] for t, *_ in got], pa.int64()), pa.array([int(ix.ids[i]) for _, i, *_ in got], pa.int64()), pa.array([a for *_, a, _ in got], pa.int64()), pa.array([e for *_, e in got], pa.int64())],
                ["doc_id", "item_id", "first_word", "end_word"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, item_id bigint, first_word bigint, end_word bigint")


def remove_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``doc_id``, ``text``, ``n_removed``: texts without the leaked words, the rest unchanged.

    Null texts stay null. The words of every run of :func:`leaked_items` go, what stands between two runs stays.
    """
    from corpusmill.functions.words import DIVIDED, WORD

    index = docs.sparkSession.sparkContext.broadcast(_index(items, **how))

    def run(batches):
        ix = index.value
        for b in batches:
            texts = b.column("text").to_pylist()
            cuts: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, _, a, e in ix.batch(texts):
                cuts[t].append((a, e))
            removed = [0] * len(texts)
            for t, spans in cuts.items():
                whole = DIVIDED.sub("", texts[t])
                at = [m.span() for m in WORD.finditer(whole)]
                gone = sorted({k for a, e in spans for k in range(a, min(e, len(at)))})
                removed[t] = len(gone)
                out, last = [], 0
                i = 0
                while i < len(gone):
                    j = i
                    while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
                        j += 1
                    out.append(whole[last : at[gone[i]][0]])
                    last = at[gone[j]][1]
                    i = j + 1
                texts[t] = "".join(out) + whole[last:]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_removed"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, text string, n_removed bigint")
