"""The edit-distance segment join of one block of texts with another, as arrays.

Two texts of n and m words agree if L >= agree * max(n, m) words stand in both in the same order. Words
lost from the first and words that come in are then n + m - 2L <= 2 * (1 - agree) * n together. The
first text is cut into segments of ``W`` words. A word lost falls into one segment, a word that comes in
into one segment at most. So if T edits within a segment are allowed, more than a (T + 1)th of that sum
of segments can't have more than T each, and the others keep W - T of their words in the second text,
in order, with at most T strange words between them. All (W - T)-subsets of a segment are keys, and the
second text is searched for keys by the few layouts that these can have in it (``LAYOUTS``); that holds
wherever the edits are. Pairs with enough segments at positions that the bound allows are verified by
banded dynamic programming, a row of the band as one big integer.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from functools import lru_cache

import numpy as np

#: (W, T) of the families of segments, the preferred first. The last one is for texts of a few words:
#: a single word can't be broken by words that come in, so only words lost count.
FAMILIES = ((6, 2), (4, 1), (1, 0))
#: Segments that a pair must share, where the text has so many more than edits can break.
ENOUGH = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_CHUNK = 100_000
_PAIRS_AT_ONCE = 4_000_000


def layouts(width: int, edits: int) -> list[tuple[int, ...]]:
    """Offsets of keys in the second text: one of these is in every way in which a segment can survive."""
    size = width - edits
    wanted = []
    for lost in range(edits + 1):
        left = width - lost
        for gaps in itertools.product(range(edits - lost + 1), repeat=left - 1):
            if sum(gaps) <= edits - lost:
                at = np.concatenate([[0], np.cumsum(np.array(gaps, int) + 1)]).tolist()
                wanted.append({tuple(x - c[0] for x in c) for c in itertools.combinations(at, size)})
    chosen: list[tuple[int, ...]] = []
    while wanted:
        votes: dict[tuple[int, ...], int] = defaultdict(int)
        for w in wanted:
            for c in w:
                votes[c] += 1
        best = min(votes, key=lambda c: (-votes[c], c))
        chosen.append(best)
        wanted = [w for w in wanted if best not in w]
    return chosen


LAYOUTS = {f: layouts(*f) for f in FAMILIES}


@lru_cache(maxsize=100_000)
def plan(n: int, agree: float) -> tuple[int, int, int]:
    """(family, segments to keep, segments that a pair must share) for a text of ``n`` words."""
    for i, (width, edits) in enumerate(FAMILIES):
        own = n // width
        broken = int(np.floor((2 if width > 1 else 1) * (1 - agree) * n + 1e-9)) // (edits + 1)
        if own > broken:
            need = min(ENOUGH, own - broken)
            return i, broken + need, need
    return len(FAMILIES) - 1, n, 1


@lru_cache(maxsize=8)
def longest_of_family(family: int, agree: float) -> int:
    """The longest text that uses a family; without end if ``agree`` is so low that long texts do."""
    if family == 0 or any(plan(n, agree)[0] == family for n in range(2000, 2100)):
        return 1 << 60
    return max((n for n in range(1, 2000) if plan(n, agree)[0] == family), default=0)


def _keys(words: np.ndarray, offsets: tuple[int, ...], at: np.ndarray | slice, count: int, family: int) -> np.ndarray:
    out = np.full(count, family + 1, np.uint64)
    for o, f in zip(offsets, _FACTORS):
        out += (words[at + o] if isinstance(at, np.ndarray) else words[at.start + o : at.start + o + count]) * f
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out


class SegmentIndex:
    """Keys of a block of first texts: their words one after another, and where each text's begin."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, agree: float):
        self.agree, self.ends, self.n = agree, ends, np.diff(ends)
        self.lists, self.masks = words, {}
        plans = [plan(int(n), agree) if n else (0, 0, 1) for n in self.n]
        self.need = np.array([p[2] for p in plans], np.int64)
        keep = np.array([p[1] for p in plans], np.int64)
        family = np.array([p[0] for p in plans], np.int64)
        w = words.view(np.uint32).astype(np.uint64)
        parts = []
        for i, (width, edits) in enumerate(FAMILIES):
            docs = np.flatnonzero((family == i) & (self.n > 0))
            own = self.n[docs] // width
            text = np.repeat(docs, own)
            seg = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
            start = ends[text] + seg * width
            subsets = list(itertools.combinations(range(width), width - edits))
            if len(text):
                keys = np.stack([_keys(w, s, start, len(start), i) for s in subsets], 1)
                # The segments whose keys are rarest in this block; which ones are taken doesn't matter to what is found.
                _, back, times = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
                heavy = times[back].reshape(keys.shape).sum(1)
                order = np.lexsort((seg, heavy, text))
                rank = np.empty(len(text), np.int64)
                rank[order] = np.arange(len(text)) - np.searchsorted(text, text[order])
                take = rank < keep[text]
                k = len(subsets)
                parts.append((keys[take].ravel(), np.repeat(text[take], k), np.repeat(seg[take], k), (np.repeat(seg[take] * width, k) + np.tile([s[0] for s in subsets], take.sum()))))
        key, text, seg, pos = (np.concatenate(x) if parts else np.empty(0, np.int64) for x in (zip(*parts) if parts else ((),) * 4))
        key = key.astype(np.uint64)
        bits = min(24, max(10, int(len(key)).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        order = np.argsort(key, kind="stable")
        self.key, self.text, self.seg, self.pos = key[order], text[order].astype(np.int32), seg[order].astype(np.int32), pos[order].astype(np.int32)
        self.first = np.searchsorted(self.key >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.families = [i for i in range(len(FAMILIES)) if ((family == i) & (self.n > 0)).any()]

    def pairs(self, words: np.ndarray, ends: np.ndarray):
        """(first text, second text, share) of all pairs with the texts of a block that agree."""
        a = 0
        while a < len(ends) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _CHUNK, "right")) - 1)
            base = ends[a]
            for x, y in self._candidates(words[base : ends[b]], ends[a : b + 1] - base):
                got = self._verify(x, words[ends[a + y] : ends[a + y + 1]])
                if got:
                    yield x, a + y, got
            a = b

    def _candidates(self, words: np.ndarray, ends: np.ndarray):
        n = np.diff(ends)
        w = words.view(np.uint32).astype(np.uint64)
        at = np.repeat(np.arange(len(n)), n)
        hits = []
        for i in self.families:
            most = longest_of_family(i, self.agree) / self.agree
            if not (n <= most).any():
                continue
            for offsets in LAYOUTS[FAMILIES[i]]:
                count = len(w) - offsets[-1]
                if count <= 0:
                    continue
                key = _keys(w, offsets, slice(0, None), count, i)
                slot = (key >> self.shift).astype(np.int64)
                k = self.first[slot + 1] - self.first[slot]
                p = np.flatnonzero((k > 0) & (at[:count] == at[offsets[-1] :]))
                if len(p):
                    hits.append((p, key[p], self.first[slot[p]], k[p]))
        if not hits:
            return []
        p, key, lo, k = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(p, kind="stable")  # by text
        p, key, lo, k = p[order], key[order], lo[order], k[order]
        text = at[p]
        # Whole texts at a time, so that a pair's segments are counted together.
        total = np.cumsum(k)
        edges = np.searchsorted(text, np.arange(len(n) + 1))
        out, a = [], 0
        while a < len(n):
            done = total[edges[a] - 1] if edges[a] else 0
            b = a + 1
            while b < len(n) and (total[edges[b + 1] - 1] if edges[b + 1] else 0) - done <= _PAIRS_AT_ONCE:
                b += 1
            s = slice(edges[a], edges[b])
            out.append(self._count(p[s], key[s], lo[s], k[s], text[s], ends, n))
            a = b
        return [tuple(r) for part in out for r in part.tolist()]

    def _count(self, p, key, lo, k, text, ends, n) -> np.ndarray:
        which = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        src = np.repeat(np.arange(len(p)), k)
        ok = self.key[which] == key[src]
        which, src = which[ok], src[ok]
        x, y = self.text[which].astype(np.int64), text[src]
        longest = np.maximum(self.n[x], n[y])
        loss = longest - np.ceil(longest * self.agree - 1e-9)
        ok = (np.minimum(self.n[x], n[y]) >= longest - loss) & (np.abs(self.pos[which] - (p[src] - ends[y])) <= loss)
        # One entry for each segment of a pair.
        both = (y[ok] * len(self.n) + x[ok]) << 24
        one = np.unique(both + (self.seg[which[ok]] & 0xFFFFFF)) >> 24
        pair, times = np.unique(one, return_counts=True)
        pair = pair[times >= self.need[pair % len(self.n)]]
        return np.stack([pair % len(self.n), pair // len(self.n)], 1) if len(pair) else np.empty((0, 2), np.int64)

    def _verify(self, x: int, words: np.ndarray) -> float:
        masks = self.masks.get(x)
        if masks is None:
            if len(self.masks) > 2000:
                self.masks.clear()
            masks = self.masks[x] = positions(self.lists[self.ends[x] : self.ends[x + 1]].tolist())
        n, other = int(self.n[x]), words.tolist()
        longest = max(n, len(other))
        need = int(np.ceil(self.agree * longest - 1e-9))
        if sum(map(masks.__contains__, other)) < need:
            return 0.0
        return lcs_at_least(n, masks, other, need) / longest


def positions(a: list[int]) -> dict[int, int]:
    """Of each word the places where it stands, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def lcs_at_least(n: int, masks: dict[int, int], b: list[int], need: int) -> int:
    """Longest common subsequence of a text of ``n`` words and ``b`` if it is at least ``need``, else 0.

    Only cells within the band that can lead to it are filled, and it ends when ``b`` has lost too many words.
    """
    up, down = n - need, len(b) - need  # words of either text without a partner
    if up < 0 or down < 0:
        return 0
    full = (1 << n) - 1
    band = (1 << (up + down + 1)) - 1
    v = full
    for j, x in enumerate(b):
        m = masks.get(x)
        if m:
            lo = j - down
            u = v & m & (band << lo if lo >= 0 else band >> -lo)
            if u:
                v = ((v + u) | (v - u)) & full
        if not j & 63 and n - v.bit_count() + len(b) - j - 1 < need:
            return 0
    got = n - v.bit_count()
    return got if got >= need else 0
