"""Noise in text from scanned pages: divided words, misread characters, running heads and page numbers.

Averaged perceptrons do the work. The character editor chooses for each place of a word whether to
keep it, replace, delete or insert characters, and at a line's end whether to join. It is trained on the
corpus itself: rare words that one common misreading turns into a frequent word, and frequent words from
which a letter is left out, against frequent words as they are. The joiner is trained on frequent words
cut in two, on words with a hyphen, and on pairs of words. The furniture classifier chooses for each line that stands apart
whether it is text, a running head, a page number or both, from its form, its place on the page and how
often its like stands on other pages of the same file or paper.

A word's edit doesn't depend on its neighbours, so each distinct word is edited once for a worker.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from sys import intern

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import arrow_map
from corpusmill.llm.perceptron import AveragedPerceptron

MARKS = "-¬­‐‑="
_DIVIDED = re.compile(rf"(?:(?<=[^\W\d_])[{MARKS}][^\S\n]*\n\s*(?=[a-zà-ÿ])|(?<=[A-ZÀ-Þ][A-ZÀ-Þ])[{MARKS}][^\S\n]*\n\s*(?=[A-ZÀ-Þ]))")
#: A mark that begins an entry or a note.
_ENTRY = re.compile(r"(?m)^[^\S\n]*[*•†‡][^\S\n]+")
#: The words on both sides of a mark at a line's end.
_HALVES = re.compile(rf"([^\W\d_]+)[{MARKS}][^\S\n]*\n\s*([^\W\d_]+)")
_EDGE = ".,;:!?\"“”'‘’„()[]—–-"
# Names of the months.
MONTHS = frozenset("january february march april may june july august september october november december".split())


def _clean(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def bare(token: str) -> str:
    return token.strip(_EDGE).lower()


# ---------------------------------------------------------------- words of the corpus


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over all of the column ``text``; each task adds up its own words before the shuffle."""

    def run(batches):
        raw: Counter[str] = Counter()

        def flush():
            words: Counter[str] = Counter()
            for t, n in raw.items():
                for w in t.replace("--", "—").split("—"):
                    w = bare(w)
                    if w:
                        words[w] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    raw.update(_DIVIDED.sub("", _clean(t)).split())
            if len(raw) > 500_000:
                yield flush()
        yield flush()

    return arrow_map(texts.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: Amounts, ordinals, and what is too far from any word.
_NO_WORD = re.compile(r"^\W*\d+[a-z]{0,2}$|\d.*\d.*\d|[bcdfghjklmnpqrstvwxz]{7}")


#: What a mark at a line's end is: a dash between words, the division of a word, or a hyphen that the word has anyway.
APART, JOINED, HYPHENATED = 0, 1, 2


class Editor:
    """The character editor. Operations are (what is read, what it stands for): equal for keeping, nothing read for inserting.

    ``places`` says where in a word letters are inserted (``start``, ``inside``, ``end``), each with the least length of a word.
    """

    def __init__(self, known: dict[str, int], ops: dict[str, list[str]], model: AveragedPerceptron, joiner: AveragedPerceptron, places: dict[str, int] | None = None):
        self.known, self.ops, self.model, self.joiner, self.places = known, ops, model, joiner, places or {}
        self._made: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _index(self) -> tuple[dict[str, list[tuple[str, int]]], int, float, list[str]]:
        """Known words without one letter; the longest word that edits can reach; words as frequent as no other; known words in order."""
        if self._made is None:
            without: dict[str, list[tuple[str, int]]] = defaultdict(list)
            letters = set(self.ops.get("", ()))
            for v in self.known:
                for i, ch in enumerate(v):
                    place = "start" if i == 0 else "end" if i == len(v) - 1 else "inside"
                    if ch in letters and len(v) > self.places.get(place, 1 << 30):
                        without[v[:i] + v[i + 1 :]].append((v, i))
            self._made = without, max(map(len, self.known), default=0) + 4, sum(self.known.values()) / 200, sorted(self.known)
        return self._made

    def _options(self, word: str) -> list[tuple[str, str, str, int]]:
        """(edited word, read, meant, place) of every single operation that gives a known word."""
        out = [(v, "", v[i], i) for v, i in self._index()[0].get(word, ())] if word not in self.known else []
        for i in range(len(word)):
            for size in (1, 2):
                read = word[i : i + size]
                if len(read) == size:
                    for meant in self.ops.get(read, ()):
                        got = word[:i] + meant + word[i + size :]
                        if got in self.known:
                            out.append((got, read, meant, i))
        return out

    @staticmethod
    def _features(word: str, got: str, read: str, meant: str, at: int, known: dict[str, int]) -> list:
        rate = known.get(got, 0) / (known.get(word, 0) + 1)
        band = 0 if rate < 3 else 1 if rate < 15 else 2 if rate < 100 else 3
        kind = "replace" if read and meant else "delete" if read else "insert"
        return [
            ("kind", kind, band), ("op", read, meant), ("left", read, meant, word[at - 1 : at]), ("right", read, meant, word[at + len(read) : at + len(read) + 1]),
            ("length", min(len(word), 6), band), ("rate", band), ("was known", word in known, band),
        ]

    def _keep(self, word: str, options: int) -> list:
        return [("keep", word in self.known), ("keep", "length", min(len(word), 6)), ("keep", "options", min(options, 3))]

    def edit(self, word: str) -> str:
        """The word as it was meant; the word itself where keeping it is best. Two operations are tried if one is not enough."""
        if len(word) > self._index()[1] or _NO_WORD.search(word):
            return word  # so long a word is no known one after two operations
        options = self._options(word)
        if not options and len(word) >= 6 and word not in self.known:
            for i in range(len(word)):
                for size in (1, 2):
                    read = word[i : i + size]
                    if len(read) == size:
                        for meant in self.ops.get(read, ()):
                            half = word[:i] + meant + word[i + size :]
                            options += [(got, *rest) for got, *rest in self._options(half)]
        if not options:
            return word
        feats = [self._keep(word, len(options))] + [self._features(word, *o, self.known) for o in options]
        k = self.model.best(feats)
        return options[k - 1][0] if k else word

    def cut_off(self, word: str) -> bool:
        """Whether a word that isn't known begins a known one: what a text's end leaves of it."""
        if not word or word in self.known:
            return False
        order = self._index()[3]
        i = bisect_left(order, word)
        return i < len(order) and order[i].startswith(word)

    def _frequency(self, word: str) -> int:
        n = self.known.get(word, 0)
        return 2 if n and n >= self._index()[2] else 1 if n else 0

    def join_features(self, left: str, right: str) -> list[list]:
        whole, hyphen = self.known.get(left + right, 0), self.known.get(f"{left}-{right}", 0)
        state = (whole > 0, hyphen > whole, self._frequency(left), self._frequency(right))
        return [[(c, *state), (c, whole > 0, hyphen > whole)] for c in (APART, JOINED, HYPHENATED)]

    def division(self, left: str, right: str) -> int:
        """What a mark between two parts at a line's end is."""
        return self.joiner.best(self.join_features(left, right))

    def joins(self, left: str, right: str) -> bool:
        """Whether a word divided at a line's end is written without its mark."""
        return self.division(left, right) == JOINED


def train_editor(counts: DataFrame, finest: int = 1 << 16, max_rare: int = 20_000, ratio: int = 15, support: int = 4) -> Editor:
    """The editor of a corpus.

    :param counts: ``word``, ``n`` over the whole corpus.
    :param finest: words that are at least one in ``finest`` are known. So no more than ``finest`` come to the driver.
    :param max_rare: bound of the sample of rarer words that it is trained on, the most frequent ones first.
    :param ratio: how much more frequent than a rare word its likely original must be.
    :param support: in how many words of the sample a misreading must occur to become an operation.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(total / finest, 2)
    known = {r[0]: r[1] for r in counts.where(F.col("n") >= least).collect()}
    letters = r"^[\p{L}0-9$£\[\]|!]*\p{L}[\p{L}0-9$£\[\]|!]*$"
    band = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    by = F.pmod(F.xxhash64("word", F.lit(3)), F.lit(1 << 30))
    rare = counts.where((F.col("n") < least) & F.col("word").rlike(letters)).select("word", "n", band.alias("band"), by.alias("h"))
    # Bands of frequency, some hundreds at most, say which words are the most frequent ones; of the last band a share is taken by hash.
    left, chosen = max_rare, F.lit(False)
    for b, k in sorted(map(tuple, rare.groupBy("band").count().collect()), reverse=True):
        chosen = chosen | ((F.col("band") == b) & (F.col("h") < int(min(1.0, left / k) * (1 << 30))))
        left -= k
        if left <= 0:
            break
    return fit_editor(known, sorted((r[0], r[1]) for r in rare.where(chosen).select("word", "n").collect()), ratio, support)


def fit_editor(known: dict[str, int], rare: list[tuple[str, int]], ratio: int = 15, support: int = 4, max_known: int = 20_000) -> Editor:
    """The editor from known words and a sample of rare ones, each with its frequency.

    :param max_known: bound of the known words, most frequent first, that it learns from what to keep, and of which it leaves out letters.
    """
    rare = sorted(rare, key=lambda x: (-x[1], x[0]))
    plain = [w for w in known if w.isalpha() or w.replace("-", "").isalpha()]
    holes: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for v in plain:
        for i in range(len(v) + 1):
            for size in (0, 1, 2):
                if i + size <= len(v) and len(v) - size >= 1:
                    holes[(v[:i], v[i + size :])].append((v, v[i : i + size]))
    # Known words may be frequent misreadings of still more frequent ones.
    sample = rare + sorted((w, n) for w, n in known.items() if n < max(known.values(), default=0) / ratio)
    pairs, seen, dropped = [], Counter(), Counter()
    for u, n in sample:
        if len(u) < 2 or not any(ch.isalpha() for ch in u):
            continue
        best: tuple[int, str, str, str, int] | None = None
        for sizes in ((1, 2), (0,)):  # a letter left out is no explanation where another one does
            for i in range(len(u) + 1) if best is None and (sizes != (0,) or len(u) > 3) else ():
                for size in sizes:
                    if i + size > len(u) or len(u) - size < 1:
                        continue
                    for v, meant in holes.get((u[:i], u[i + size :]), ()):
                        read = u[i : i + size]
                        # Whole spans only, so no shared first or last character. Letters are not just left out: words have endings of themselves.
                        if v == u or (not meant and read.isalpha()) or (read and meant and (read[0] == meant[0] or read[-1] == meant[-1])) or (not read and len(meant) > 1):
                            continue
                        if known[v] >= ratio * n and (best is None or known[v] > best[0]):
                            best = (known[v], v, read, meant, i)
        if best:
            pairs.append((u, n, *best[1:]))
            if u not in known and not best[2]:
                dropped["start" if best[4] == 0 else "end" if best[4] == len(u) else "inside"] += 1
            elif u not in known and len(u) > 4:
                seen[(best[2], best[3])] += 1
    ops: dict[str, list[str]] = defaultdict(list)
    least = max(support, sum(seen.values()) / 1000)
    for (read, meant), k in sorted(seen.items()):
        if k >= least:
            ops[read].append(meant)
    # Letters inside a word are inserted in longer words at least; elsewhere only where the corpus shows that they get lost.
    top = sorted(plain, key=lambda x: (-known[x], x))[:max_known]
    ops[""] = sorted({ch for w in top for ch in w if ch.isalpha()})
    places = {"inside": 5} | {place: 3 for place, k in dropped.items() if k >= least}
    shell = Editor(known, dict(ops), AveragedPerceptron(), AveragedPerceptron(), places)

    def example(u: str, v: str, read: str, meant: str) -> None:
        options = shell._options(u)
        right = next((k + 1 for k, o in enumerate(options) if o[0] == v and o[1] == read and o[2] == meant), None)
        if right is not None and u not in known:
            examples.append(([shell._keep(u, len(options))] + [shell._features(u, *o, known) for o in options], right))

    examples: list = []
    for u, _, v, read, meant, _ in pairs:
        example(u, v, read, meant)
    for k, w in enumerate(top):
        options = shell._options(w)
        if options and all(known[o[0]] < ratio * 4 * known[w] for o in options):
            examples.append(([shell._keep(w, len(options))] + [shell._features(w, *o, known) for o in options], 0))
        if len(w) > 5 and w.isalpha():
            i = 1 + k % (len(w) - 2)
            example(w[:i] + w[i + 1 :], w, "", w[i])
    joins = []
    common = [w for w in top if shell._frequency(w) == 2]
    for k, w in enumerate(top):
        if "-" in w:
            left, _, right = w.partition("-")
            joins += [(shell.join_features(left, right), HYPHENATED)] * 2
        elif len(w) > 3:
            joins += [(shell.join_features(w[:i], w[i:]), JOINED) for i in (len(w) // 2, 2)]
            joins += [(shell.join_features(w[: len(w) // 2] + "ÿ", w[len(w) // 2 :]), JOINED), (shell.join_features(w, w + "ÿ"), JOINED), (shell.join_features(w[:-1] + "ÿ", w[-1:]), JOINED)]
        for left, right in ((w, common[(k + 1) % len(common)]), (common[(k + 7) % len(common)], w)) if k < 200 and common else ():
            if left != right and left + right not in known and f"{left}-{right}" not in known:
                joins += [(shell.join_features(left, right), APART)] * 3
    return Editor(known, dict(ops), AveragedPerceptron().train(examples), AveragedPerceptron().train(joins), places)


# ---------------------------------------------------------------- characters


KEEP, MISREAD, STRAY, SINGLE, RARE = 0, 1, 2, 3, 4
_STRAY = re.compile(r"[\^»«|*\\■•¦~<>{}_=+]+|,,|\*;|[;:,]+['|]?")
_INNER = re.compile(r"[\^»«|\\■•¦~<>{}]")


def running_text(body: str) -> list[str]:
    """The tokens of a text with divided words whole, without the marks of entries and notes and without halves of words at its ends."""
    if "\n" in body:
        body = _DIVIDED.sub("", body)
    if "*" in body or "•" in body or "†" in body or "‡" in body:
        body = _ENTRY.sub("", body)
    tokens = body.split()
    if tokens and tokens[0][0].islower():
        del tokens[0]
    if tokens and len(tokens[-1]) > 1 and tokens[-1][-1] in MARKS:
        del tokens[-1]
    return tokens


class Reader:
    """What each token is: kept, misread, stray, a single letter, or rare; known for each token once.

    A rare token is kept, but holds words (``rare``) that are not known, so the editor can't tell what they are.
    """

    def __init__(self, editor: Editor):
        self.editor = editor
        self.memo: dict[str, int] = {}
        self.fixed: dict[str, str] = {}
        self.rare: dict[str, list[str]] = {}
        self.divided: dict[tuple[str, str], bool] = {}

    def divides(self, body: str) -> bool:
        """Whether any mark at a line's end divides a word, by the editor's joiner."""
        for m in _DIVIDED.finditer(body):
            around = _HALVES.match(body, self._word_start(body, m.start()))
            if around is None:
                return True  # a part without letters is no word of its own
            pair = around[1].lower(), around[2].lower()
            got = self.divided.get(pair)
            if got is None:
                if len(self.divided) > 400_000:
                    self.divided.clear()
                got = self.divided[pair] = self.editor.division(*pair) != APART
            if got:
                return True
        return False

    @staticmethod
    def _word_start(body: str, at: int) -> int:
        while at and body[at - 1].isalpha():
            at -= 1
        return at

    def code(self, token: str) -> int:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
                self.fixed.clear()
                self.rare.clear()
            got = self.memo[token] = self._code(token)
        return got

    def _code(self, token: str) -> int:
        if len(token) == 1 and token.isalpha():
            return SINGLE
        if _STRAY.fullmatch(token):
            return STRAY
        inner = _INNER.search(token)
        if inner:
            rest = _INNER.sub("", token)
            low = bare(rest)
            if low in self.editor.known or (low and self.editor.edit(low) in self.editor.known):
                self.fixed[token] = rest
                return MISREAD
            return self._rare(token)
        codes = [self._part(p) for p in token.replace("--", "—").split("—")]
        return MISREAD if any(codes) else self._rare(token)

    def _rare(self, token: str) -> int:
        low = [w for w in map(bare, token.replace("--", "—").split("—")) if w not in self.editor.known and may_be_misread(w)]
        if not low:
            return KEEP
        self.rare[token] = low
        return RARE

    def rare_words(self, tokens: list[str], codes: bytes) -> list[str]:
        """The distinct rare words of tokens; empty if nothing is rare."""
        if RARE not in codes:
            return []
        return list({w for t, c in zip(tokens, codes) if c == RARE for w in (self.rare.get(t) or self._again(t))})

    def _again(self, token: str) -> list[str]:
        self._rare(token)
        return self.rare[token]

    def _part(self, part: str) -> bool:
        low = bare(part)
        if len(low) < 2 or not any(ch.isalpha() for ch in low):
            return False
        edited = self.editor.edit(low)
        if edited == low:
            return False
        at = part.lower().find(low)
        shown = edited.upper() if part[at : at + len(low)].isupper() else edited.capitalize() if part[at : at + 1].isupper() else edited
        self.fixed[part] = part[:at] + shown + part[at + len(low) :]
        return True

    def codes(self, tokens: list[str]) -> bytes:
        memo = self.memo
        try:
            return bytes([memo[t] for t in tokens])
        except KeyError:
            return bytes(map(self.code, tokens))

    @staticmethod
    def noisy(codes: bytes) -> bool:
        return 1 in codes or 2 in codes or b"\3\3\3" in codes


# ---------------------------------------------------------------- words that are not frequent enough to be known


#: The marks of ``_INNER``.
_MARKED = "^»«|\\■•¦~<>{}"


def may_be_misread(word: str) -> bool:
    return len(word) >= 2 and any(ch.isalpha() for ch in word) and not _NO_WORD.search(word)


def misreadings(word: str, ops: dict[str, list[str]]) -> set[tuple[str, str, str, int]]:
    """(misread word, read, meant, place) of every single operation, and of every mark within the word."""
    out = {(word[:i] + m + word[i:], m, "", i) for i in range(len(word) + 1) for m in _MARKED}
    for read, all_meant in ops.items():
        for meant in all_meant if read else ():
            for i in range(len(word) - len(meant) + 1):
                if word.startswith(meant, i):
                    out.add((word[:i] + read + word[i + len(meant) :], read, meant, i))
    return out


def rare_misreadings(counts: DataFrame, editor: Editor, ratio: int = 15) -> DataFrame:
    """``word``, ``meant``: misreadings of the words that are not frequent enough for the editor to know.

    Every word that occurs ``ratio`` times is turned into its misreadings, which are joined with all counted
    words; those that are ``ratio`` times rarer are judged by the editor's model. So nothing is collected.
    An original that is itself misread is edited in turn.
    """
    shared = counts.sparkSession.sparkContext.broadcast(editor)

    def spell(batches):
        e = shared.value
        for b in batches:
            rows = [(u, v, n, *op) for v, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) if v not in e.known for u, *op in misreadings(v, e.ops)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "original", "originals", "read", "meant", "at"])

    originals = counts.where((F.col("n") >= ratio) & F.col("word").rlike(r"^\p{L}[\p{L}'’-]*\p{L}$"))
    spelled = arrow_map(originals, spell, "word string, original string, originals bigint, read string, meant string, at int")
    met = spelled.join(counts, "word").where((F.col("originals") >= F.col("n") * ratio))
    options = met.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("original", "originals", "read", "meant", "at"))).alias("options"))

    def judge(batches):
        e = shared.value
        for b in batches:
            words, meant = [], []
            for u, options in zip(b.column("word").to_pylist(), b.column("options").to_pylist()):
                if u in e.known or not may_be_misread(u):
                    continue
                marked = [o for o in options if o["read"] in _MARKED]
                if marked:
                    k = max(range(len(marked)), key=lambda i: marked[i]["originals"]) + 1
                    options = marked
                else:
                    counted = {o["original"]: o["originals"] for o in options}
                    k = e.model.best([e._keep(u, len(options))] + [e._features(u, o["original"], o["read"], o["meant"], o["at"], counted) for o in options])
                if k:
                    words.append(u), meant.append(e.edit(options[k - 1]["original"]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(meant, pa.string())], ["word", "meant"])

    return arrow_map(options, judge, "word string, meant string")


def rare_hits(rare: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``tab``, ``rec_id``, ``word``, ``meant`` of records with misread words, from their ``rare`` words."""
    return rare.select("tab", "rec_id", F.explode("rare").alias("word")).join(lexicon, "word")


# ---------------------------------------------------------------- lines that stand apart


_FOLD = str.maketrans("ecoaq0ijltfs15hbnurg8B|!", "oooogoiiiiiiiinnnnngnnii")
_NUMBER_LINE = re.compile(r"[(\[—–*-]*\s*(?:(?:[Pp]age|[Pp]p?\.)\s*)?(?:(?:[0-9lIOSoB] ?){1,4}|[ivxlcIVXLC]{1,7})\s*[)\]—–*.-]*(?:\s*[\^»«|*\\■•¦~,]+)?")
_NEAR = "noon"  # near, folded
_SMALL = frozenset("the of and a an at in on its from with to by".split())
_NUMBER_EDGE = re.compile(r"^[\[(]?(?=[lIO]*\d)[\dlIO]{1,3}[\])]?\s+(?=[^\W\d]{2})|(?<=\D)\s+[\[(]?\d{1,3}[\])]?\*?\.?$")


def fold(text: str) -> str:
    """Letters that are misread for each other as one, and no blanks: what noise leaves of a line."""
    low = text.lower().replace("rn", "m").replace("li", "h").replace("cl", "d").replace("vv", "w")
    return re.sub(r"[^a-zà-ÿ]", "", low.translate(_FOLD))


def _stands_apart(line: str) -> str | None:
    """``n`` for a number alone, ``h`` for a line in capitals or in title case, else nothing."""
    if len(line) <= 16 and any(ch.isalnum() for ch in line) and _NUMBER_LINE.fullmatch(line):
        return "n"
    if line.isupper():
        return "h" if sum(map(str.isalpha, line)) >= 4 else None
    if line[:1].islower():
        return None
    big = 0
    for w in line.split():
        if w[0].islower():
            if w.strip(_EDGE) not in _SMALL:
                return None
        elif w[0].isupper() or w.lstrip("([“\"'*")[:1].isupper():
            big += 1
    return "h" if big and sum(map(str.isalpha, line)) >= 4 else None


#: A line that may be furniture: its number, kind, folded letters, features.
LINE = "struct<at:int,kind:string,key:string,head:string,form:array<string>>"


def page_lines(lines: list[str]) -> list[tuple[int, str, str, str, list[str]]]:
    """The lines of a page that stand apart, with the features of their form and their place."""
    full = [i for i, s in enumerate(lines) if s and not s.isspace()]
    if not full:
        return []
    kinds = {i: k for i in full if (k := _stands_apart(lines[i].strip()))}
    if not kinds:
        return []
    first, last = full[0], full[-1]
    order = {i: k for k, i in enumerate(full)}
    capitals = sum(1 for k in kinds.values() if k == "h") / len(full)
    out = []
    many = capitals > 0.5 and len(full) > 8  # a page in capitals, a list or a table: only its edges stand apart
    for i, kind in kinds.items():
        if many and kind == "h" and 2 <= order[i] < len(full) - 2:
            continue
        s = lines[i].strip()
        k = order[i]
        before = lines[full[k - 1]].strip() if k else ""
        after = lines[full[k + 1]].strip() if k + 1 < len(full) else ""
        body = _NUMBER_EDGE.sub("", s)
        words = [w for w in re.findall(r"[^\W_]+", body) if not w.isdigit()]
        place = "only" if first == last else "first" if i == first else "last" if i == last else "second" if k == 1 else "last but one" if k == len(full) - 2 else "inside"
        f = [
            f"kind={kind}", f"place={place}", f"{kind}{place}", f"capitals={s.upper() == s}", f"blank before={i > 0 and not lines[i - 1].strip()}",
            f"blank after={i + 1 < len(lines) and not lines[i + 1].strip()}", f"words={min(len(words), 9)}",
            f"sentence ended={before[-1:] in '.!?”\"' if before else True}", f"goes on={after[:1].islower()}", f"divided before={bool(before) and before[-1] in MARKS}",
            f"number beside={kinds.get(full[k - 1]) == 'n' if k else False or (k + 1 < len(full) and kinds.get(full[k + 1]) == 'n')}",
            f"many capitals={capitals > 0.5 and len(full) > 3}", f"colon={':' in s}", f"stop={s[-1:] == '.'}", f"long={len(s) > 75}",
        ]
        low = fold(s)
        chapter = low.startswith(fold("chapter")) or fold(before).startswith(fold("chapter")) and "n" not in kinds.get(full[k - 1], "") and len(before) < 24
        f.append(f"chapter={chapter}")
        f.append(f"near={bool(re.search('N ?E ?A ?R ', s)) or any(len(w) == 4 and fold(w) == _NEAR for w in words[2:])}")
        f.append(f"mixed={any(w.isupper() and len(w) > 2 for w in words) and any(c.islower() for c in body)}")
        f.append(f"ordinal={bool(re.match('[0-9]+(?:st|d|nd|rd|th)', s))}")
        f.append(f"comma={',' in s and kind == 'h'}")
        f.append(f"note={s[:1] in '*†‡'}")
        f.append(f"number at edge={body != s}")
        months = [w for w in re.findall(r"[a-z]+", s.lower()) if w in MONTHS]
        f.append(f"date={bool(months) and bool(re.search('1[0-9lIOS]{3}', s))}")
        if kind == "n":
            dressed = bool(re.match(r"[(\[—–-]|[Pp]", s)) or "*" in s
            digits = re.sub(r"\W", "", s)
            f += [f"dressed={dressed}", f"digits={min(len(digits), 4)}", f"figures={digits.isdigit()}", f"year={bool(re.fullmatch('1[5-9][0-9]{2}', digits))}", f"plain stop={not dressed and s.endswith('.')}&{before[-1:] in '.!?”'}"]
        key = "" if kind == "n" else fold(" ".join(w for w in words if w.lower() not in MONTHS))
        out.append((i, kind, key, fold(" ".join(words[:3])) if len(words) >= 3 else key, f))
    return out


CLASSES = ("text", "header", "page_no", "both")


def title_likeness(key: str, title: str | None) -> int:
    """0 to 3: how far the folded line is the folded title, whole or cut short."""
    t = fold(title or "")
    if not t or len(key) < 6:
        return 0
    grams = {t[i : i + 3] for i in range(len(t) - 2)}
    own = [key[i : i + 3] for i in range(len(key) - 2)]
    share = sum(g in grams for g in own) / max(1, len(own))
    return 3 if share > 0.85 else 2 if share > 0.65 else 1 if share > 0.45 else 0


def line_features(kind: str, form: list[str], likeness: int, pages: int, heads: int) -> list[list]:
    """Features of each class: form, place, likeness to the title, and on how many pages the like stands."""
    n, m = min(pages, 4), min(heads, 4)
    feats = [*form, f"like={likeness}", f"pages={n}", f"heads={m}", f"{kind}&{likeness}&{n}&{m}"]
    marked = {x.partition("=")[0]: x for x in form}
    feats += [f"{marked['chapter']}&{n}&{likeness}", f"{marked['near']}&{n}&{likeness}", f"{marked['capitals']}&{n}&{m}&{likeness}", f"{marked['date']}&{n}", f"{marked['mixed']}&{marked['ordinal']}&{marked['words']}", f"{marked['number at edge']}&{n}&{likeness}&{m}"]
    if kind == "n":
        feats += [f"n&{marked['dressed']}&{marked['year']}", f"n&{marked['plain stop']}&{marked['goes on']}&{marked['place']}"]
    return [[(c, x) for x in feats] for c in CLASSES]


def weak_class(kind: str, form: list[str], likeness: int, pages: int, heads: int) -> int | None:
    """A first guess at a line's class from the clearest signs; nothing where they don't agree."""
    f = {k: v for k, _, v in (x.partition("=") for x in form)}
    if f["long"] == "True":
        return None  # a whole line of names or capitals has no clear signs
    if kind == "n":
        if f["dressed"] == "True":
            return 2
        if f["year"] == "True" or f["plain stop"] == "True&False" and f["goes on"] == "False":
            return 0
        return 2 if f["figures"] == "True" else None
    if f["note"] == "True" or f["chapter"] == "True" and likeness < 3 and f["number at edge"] == "False" or f["many capitals"] == "True" or f["near"] == "True":
        return 0
    if f["ordinal"] == "True" or f["mixed"] == "True" or (f["capitals"] == "False" and int(f["words"]) <= 1 and likeness < 3):
        return 0
    edge = 3 if f["number at edge"] == "True" else 1
    if likeness == 3 or f["date"] == "True" and pages > 3 or max(pages, heads) > 2 and int(f["words"]) >= 2 and f["capitals"] == "True":
        return edge
    if likeness == 0 and pages <= 1 and heads <= 1 and f["capitals"] == "False":
        return 0
    return None


# ---------------------------------------------------------------- whole records


def read_pages(pages: DataFrame, editor: Editor) -> DataFrame:
    """``tab``, ``rec_id``, ``grp``, ``title``, ``hyphen``, ``char``, ``lines``, ``rare``: all that is found in one pass over the texts.

    ``rare`` are the words for ``rare_hits``, empty where ``char`` is true without them. Null and empty texts give no row. Misread characters are looked for outside the lines that stand apart.
    """
    shared = pages.sparkSession.sparkContext.broadcast(editor)

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            keep, hyphen, char, found, rare = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                if not t or t.isspace():
                    continue
                t = _clean(t)
                lines = t.split("\n")
                apart = page_lines(lines)
                gone = {x[0] for x in apart}
                body = "\n".join([s for k, s in enumerate(lines) if k not in gone and s.strip()]) if gone or "\n\n" in t else t
                keep.append(i)
                hyphen.append(reader.divides(body))
                tokens = running_text(body)
                if tokens and tokens[-1].isalpha() and reader.editor.cut_off(tokens[-1].lower()):
                    del tokens[-1]
                codes = reader.codes(tokens)
                char.append(Reader.noisy(codes))
                rare.append([] if char[-1] else reader.rare_words(tokens, codes))
                found.append([dict(zip(("at", "kind", "key", "head", "form"), x)) for x in apart])
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("tab"), kept.column("rec_id"), kept.column("grp"), kept.column("title"), pa.array(hyphen, pa.bool_()), pa.array(char, pa.bool_()), pa.array(found, _LINES), pa.array(rare, pa.list_(pa.string()))],
                ["tab", "rec_id", "grp", "title", "hyphen", "char", "lines", "rare"],
            )

    return arrow_map(pages.select("tab", "rec_id", "grp", "title", "text"), run, f"tab string, rec_id bigint, grp string, title string, hyphen boolean, char boolean, lines array<{LINE}>, rare array<string>")


def rare_words(pages: DataFrame, editor: Editor) -> DataFrame:
    """``tab``, ``rec_id``, ``rare``: the rare words of whole texts, lines that stand apart included."""
    shared = pages.sparkSession.sparkContext.broadcast(editor)

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            rare = []
            for t in b.column("text").to_pylist():
                tokens = _DIVIDED.sub("", _clean(t or "")).split()
                rare.append(reader.rare_words(tokens, reader.codes(tokens)))
            yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("rec_id"), pa.array(rare, pa.list_(pa.string()))], ["tab", "rec_id", "rare"])

    return arrow_map(pages.select("tab", "rec_id", "text"), run, "tab string, rec_id bigint, rare array<string>")


_LINES = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("head", pa.string()), ("form", pa.list_(pa.string()))]))


def furniture_rows(read: DataFrame) -> DataFrame:
    """One row for each line that stands apart, with the number of pages of its group that have its like.

    Counts are over the whole group, taken apart from the lines, so a group of any size is never in one task.
    """
    rows = read.select("tab", "rec_id", "grp", "title", F.explode("lines").alias("x")).select("tab", "rec_id", "grp", "title", "x.*")
    pages = rows.where("key <> ''").groupBy("tab", "grp", "key").agg(F.count_distinct("rec_id").alias("pages"))
    heads = rows.where("head <> ''").groupBy("tab", "grp", "head").agg(F.count_distinct("rec_id").alias("heads"))
    out = rows.join(pages, ["tab", "grp", "key"], "left").join(heads, ["tab", "grp", "head"], "left")
    return out.select("tab", "rec_id", "title", "at", "kind", "key", "form", F.coalesce("pages", F.lit(0)).cast("int").alias("pages"), F.coalesce("heads", F.lit(0)).cast("int").alias("heads"))


def train_furniture(rows: DataFrame, max_rows: int = 15_000) -> AveragedPerceptron:
    """The classifier of lines, from weak labels.

    :param max_rows: bound of the sample of lines it is trained on, chosen by hash on the executors.
    """
    share = min(1.0, max_rows / max(1, rows.count()))
    own = rows.select("tab", "rec_id", "at", "title", "kind", "key", "form", "pages", "heads")
    sample = own.where(F.pmod(F.xxhash64("tab", "rec_id", "at"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    sample.sort(key=lambda r: (r["tab"], r["rec_id"], r["at"]))
    examples = []
    for r in sample:
        like = title_likeness(r["key"], r["title"])
        c = weak_class(r["kind"], r["form"], like, r["pages"], r["heads"])
        if c is not None:
            examples.append(((r["kind"], [intern(x) for x in r["form"]], like, r["pages"], r["heads"]), c))
    del sample
    return AveragedPerceptron().train(examples, rounds=4, features=lambda x: line_features(*x))


def classify_lines(rows: DataFrame, model: AveragedPerceptron) -> DataFrame:
    """``tab``, ``rec_id``, ``at``, ``class`` of the lines that are furniture."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            keep, names = [], []
            for i, r in enumerate(b.to_pylist()):
                c = m.best(line_features(r["kind"], r["form"], title_likeness(r["key"], r["title"]), r["pages"], r["heads"]))
                # A line in letters is no bare number, and a bare number no head.
                if c and (r["kind"] == "n") == (c == 2):
                    keep.append(i), names.append(CLASSES[c])
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("tab"), kept.column("rec_id"), kept.column("at"), pa.array(names, pa.string())], ["tab", "rec_id", "at", "class"])

    return arrow_map(rows, run, "tab string, rec_id bigint, at int, class string")


def noise_kinds(read: DataFrame, furniture: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """``tab``, ``rec_id``, ``kind``: one row for each kind of noise in a record."""
    own = read.select("tab", "rec_id", F.explode(F.filter(F.array(F.when(F.col("hyphen"), F.lit("hyphen")), F.when(F.col("char"), F.lit("char"))), lambda x: x.isNotNull())).alias("kind"))
    kinds = F.when(F.col("class") == "both", F.array(F.lit("header"), F.lit("page_no"))).otherwise(F.array("class"))
    if hits is not None:
        own = own.union(hits.select("tab", "rec_id", F.lit("char")))
    return own.union(furniture.select("tab", "rec_id", F.explode(kinds))).distinct()


def repair_page(text: str, furniture: set[int], reader: Reader, meant: dict[str, str] | None = None) -> str:
    """The page as continuous paragraphs: furniture left out, divided words joined, characters put right, lines of a paragraph as one."""
    lines = _clean(text).split("\n")
    paragraphs: list[list[str]] = [[]]
    for i, s in enumerate(lines):
        if i in furniture:
            continue
        if s.strip():
            paragraphs[-1].append(s.strip())
        elif paragraphs[-1] and not (i and i - 1 in furniture and paragraphs[-1][-1][-1] not in ".!?”\"'"):
            paragraphs.append([])
    out = []
    for p in paragraphs:
        whole = ""
        for s in p:
            m = re.search(rf"([^\W\d_]+)[{MARKS}]$", whole)
            rest = re.match(r"[a-zà-ÿ]+", s)
            if m and rest:
                what = reader.editor.division(m[1].lower(), rest[0])
                whole = whole[: m.end(1)] + {APART: "—", JOINED: "", HYPHENATED: "-"}[what] + s
            else:
                whole = f"{whole} {s}" if whole else s
        if whole:
            out.append(_edited(whole, reader, meant or {}))
    return "\n\n".join(out)


def _respelled(token: str, meant: dict[str, str]) -> str:
    """The token with the words that have a meaning in ``meant`` put right, in their own case."""
    parts = re.split("(—|--)", token)
    for k, part in enumerate(parts):
        low = bare(part)
        if low in meant:
            at = part.lower().find(low)
            old, new = part[at : at + len(low)], meant[low]
            parts[k] = part[:at] + (new.upper() if old.isupper() else new.capitalize() if old[:1].isupper() else new) + part[at + len(low) :]
    return "".join(parts)


def _edited(text: str, reader: Reader, meant: dict[str, str]) -> str:
    tokens = text.split()
    codes = [reader.code(t) for t in tokens]
    out, i = [], 0
    while i < len(tokens):
        if codes[i] == SINGLE:
            j = i
            while j < len(tokens) and codes[j] == SINGLE:
                j += 1
            if j - i >= 3:
                out.append("".join(tokens[i:j]))
                i = j
                continue
        if codes[i] == MISREAD:
            parts = re.split("(—|--)", tokens[i])
            out.append(reader.fixed.get(tokens[i]) or "".join(reader.fixed.get(p, p) for p in parts))
        elif codes[i] != STRAY:
            out.append(_respelled(tokens[i], meant) if codes[i] == RARE and meant else tokens[i])
        i += 1
    return " ".join(out)


def repair_pages(pages: DataFrame, furniture: DataFrame, editor: Editor, hits: DataFrame | None = None) -> DataFrame:
    """``tab``, ``rec_id``, ``repaired`` of each row; null texts stay null, repeated rows repeated. ``hits`` as of ``rare_hits``."""
    shared = pages.sparkSession.sparkContext.broadcast(editor)
    gone = furniture.groupBy("tab", "rec_id").agg(F.collect_set("at").alias("gone"))

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("text", "gone", "meant"))
            fixed = [t if t is None else repair_page(t, set(g or ()), reader, {x["word"]: x["meant"] for x in m or ()}) for t, g, m in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("rec_id"), pa.array(fixed, pa.string())], ["tab", "rec_id", "repaired"])

    wide = pages.select("tab", "rec_id", "text").join(gone, ["tab", "rec_id"], "left")
    if hits is None:
        wide = wide.withColumn("meant", F.lit(None).cast("array<struct<word:string,meant:string>>"))
    else:
        wide = wide.join(hits.groupBy("tab", "rec_id").agg(F.collect_set(F.struct("word", "meant")).alias("meant")), ["tab", "rec_id"], "left")
    return arrow_map(wide, run, "tab string, rec_id bigint, repaired string")
