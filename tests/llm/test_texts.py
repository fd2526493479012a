"""Text operators against brute force, round trips and held-out accuracy, with odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")

from corpusmill.functions.words import words  # noqa: E402
from corpusmill.llm import encoding, leak, mojibake, quality, repetition, scans  # noqa: E402
from corpusmill.llm.perceptron import AveragedPerceptron  # noqa: E402
from corpusmill.llm.trees import BoostedTrees  # noqa: E402
from corpusmill.scratch import Scratch  # noqa: E402

RANKS = f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def enc():
    return encoding.PrefixEncoder.load(RANKS)


def test_ids_equal_the_public_tokenizer(enc):
    tok = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "can't we'll\n\n x", "日本 ñé £5 1234", "a" * 500, "<|endoftext|>"]
    texts += ["".join(rng.choice(" \n\tab'sé—12 the Q") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    assert all(enc.encode(t) == tok.encode_ordinary(t) for t in texts)
    assert enc.encode(None) == []


def test_appends_and_edits_extend_the_table(enc):
    rng = random.Random(2)
    for _ in range(100):
        data = bytes(rng.choice(b"theorydisc ") for _ in range(rng.randint(2, 25)))
        table = enc.extend(data[:1], [])
        enc.extend(data, table)
        assert enc.table_ids(table) == enc.table_ids(enc.extend(data, []))
        at = rng.randrange(len(data))
        new, edited = enc.edited(data, table, at, b"thing")
        assert edited == enc.extend(new, [])


def test_edits_are_encoded_around_them_only(enc):
    rng = random.Random(12)
    for _ in range(60):
        data = bytes(rng.choice(b"theorydisc-") for _ in range(rng.randint(20, 700)))
        table = enc.extend(data, [])
        at, gone = rng.randrange(len(data)), rng.randint(0, 9)
        new, got = enc.edited(data, table, at, b"-th-" * rng.randint(0, 3), gone)
        assert new == data[:at] + new[at : len(new) - len(data[at + gone :])] + data[at + gone :] and got == enc.extend(new, [])
    for _ in range(1500):
        text = "".join(rng.choice(" \n\tab's\u00e912.T") for _ in range(rng.randint(0, 40)))
        table = enc.text_table(text)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 6))
            text, table = enc.edited_text(text, table, a, b, "".join(rng.choice(" \nab'1.") for _ in range(rng.randint(0, 5))))
            assert table == enc.text_table(text) and [i for _, ids in table for i in ids] == enc.encode(text)


def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (1, "a b", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encoding.encode_corpus(df).collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])]


def _share(text):
    w = words(text, False)
    seen, hit = set(), set()
    for i in range(len(w) - 3):
        g = tuple(w[i : i + 4])
        if g in seen:
            hit.update(range(i, i + 4))
        seen.add(g)
    return len(w), len(hit)


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "a a a a a", "A, b! c\nd a B c D"]
    n, r = repetition.batch_shares(texts)
    assert [tuple(x) for x in zip(n, r)] == [_share(t or "") for t in texts]


def test_adaptive_thresholds(spark):
    rows = [(i, "x" if i < 100 else None, i / 200) for i in range(120)]
    shares = spark.createDataFrame(rows, "id bigint, source string, share double")
    sk = repetition.share_sketches(shares, ["source"])
    merged = sk.union(sk).groupBy("source", "bin").sum("n").withColumnRenamed("sum(n)", "n")
    one, two = (sorted(map(str, repetition.adaptive_thresholds(s, ["source"], 0.5, most=1.0).collect())) for s in (sk, merged))
    assert one == two and "threshold=0.245" in str(one)
    t = repetition.adaptive_thresholds(sk, ["source"])
    assert {r.source for r in repetition.over_threshold(shares, t, ["source"]).collect()} == {"x", None}


def test_only_shares_that_reach_the_threshold_are_kept(spark):
    rows = [(1, "x", 2, 10), (2, "x", 3, 10), (3, "x", 299, 1000), (4, "x", 90, 300), (5, None, 1, 20), (6, None, 49, 1000), (7, "y", 9, 10), (8, "x", 0, 0)]
    shares = spark.createDataFrame([(*r, r[2] / max(r[3], 1)) for r in rows], "id bigint, source string, n_repeated bigint, n_words bigint, share double")
    limits = spark.createDataFrame([("x", 0.3), (None, 0.05)], "source string, threshold double")
    kept = repetition.over_threshold(shares, limits, ["source"])
    assert sorted(r.id for r in kept.collect()) == [2, 4, 5] and kept.columns == [*shares.columns, "threshold"]


def test_each_group_has_its_own_threshold(spark):
    rows = [("clean", i, 0.01 * (i % 10)) for i in range(100)] + [("spam", i, 0.5 + 0.004 * i) for i in range(100)]
    shares = spark.createDataFrame(rows, "source string, id bigint, share double")
    limits = repetition.adaptive_thresholds(repetition.share_sketches(shares, ["source"]), ["source"])
    t = {r.source: r.threshold for r in limits.collect()}
    assert t["clean"] < 0.3 < t["spam"]
    kept = repetition.over_threshold(shares, limits, ["source"])
    n = {r.source: r["count"] for r in kept.groupBy("source").count().collect()}
    assert 10 <= n["clean"] <= 20 and 10 <= n["spam"] <= 11


def test_leaks_with_misread_words(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    item = rng.choices(vocab, k=40)
    part = item[5:30]
    bad = list(part)
    bad[4] = bad[12] = "zzz"
    worse = [x if i % 4 else "zzz" for i, x in enumerate(part)]
    noise = lambda: rng.choices(vocab, k=50)
    docs = [(1, noise() + part + noise()), (2, noise() + bad + noise()), (3, noise() + worse + noise()), (4, noise() + item[:15] + noise()), (5, noise())]
    rows = [(d, "; ".join(w).upper()) for d, w in docs] + [(6, None), (7, "")]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "short item"), (3, None), (None, "x")], "item_id bigint, text string")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in leak.leaked_items(df, items).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[(1, 1)] == (50, 75)
    gone = {r.doc_id: r for r in leak.remove_leaks(df, items).collect()}
    assert gone[1].n_removed == 25 and words(gone[1].text) == words("; ".join(docs[0][1][:50] + docs[0][1][75:])) and gone[6].text is None and gone[5].n_removed == 0
    with pytest.raises(ValueError):
        leak.LeakIndex([(1, "a b c")], max_words=2)


def test_two_passages_of_an_item_are_two_runs(spark):
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(3000)]
    item = rng.choices(vocab, k=120)
    between = rng.choices(vocab, k=3000)
    whole = ["a", *item[:50], *between, *item[70:120], "b"]
    twice = [*rng.choices(vocab, k=5), *item[10:60], "x", "y", "z", *item[10:35], *rng.choices(vocab, k=30)]
    df = spark.createDataFrame([(1, " ".join(whole)), (2, " ".join(twice)), (3, " ".join(item))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = sorted((r.doc_id, r.first_word, r.end_word) for r in leak.leaked_items(df, items).collect())
    assert got[0][:2] == (1, 1) and abs(got[0][2] - 51) <= 2 and abs(got[1][1] - 3051) <= 2 and got[1][2] == 3101 and len([g for g in got if g[0] == 1]) == 2
    at_end = spark.createDataFrame([(1, " ".join([*between[:90], *item[30:50]])), (2, " ".join([*item[30:50], *between[:90]])), (3, " ".join([*between[:90], *item[30:47]]))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.first_word, r.end_word) for r in leak.leaked_items(at_end, items).collect()) == [(1, 90, 110), (2, 0, 20)]
    gone = {r.doc_id: r for r in leak.remove_leaks(df, items).collect()}
    assert 96 <= gone[1].n_removed <= 104 and set(between[2:-2]) <= set(words(gone[1].text)) and gone[3].text == ""
    assert gone[2].n_removed >= 74 and not set(words(gone[2].text)) & set(item[12:58])


def test_runs_are_what_matching_windows_cover():
    rng = random.Random(15)
    ix = leak.LeakIndex([(1, " ".join(f"i{k}" for k in range(60)))])
    item = ix.h.tolist()
    for _ in range(40):
        text = []
        for _ in range(3):
            a = rng.randrange(40)
            text += [f"n{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))] + [f"i{k}" if rng.random() > 0.06 else "zz" for k in range(a, min(60, a + rng.randint(10, 45)))]
        doc = leak.batch_hashes([" ".join(text)])[0].tolist()
        cover = set()
        for s in range(41):
            for a, e in leak._fits(item[s : s + 20], doc, 18):
                cover.update(range(a, e))
        got = {w for _, _, a, e in ix.batch([" ".join(text)]) for w in range(a, e)}
        assert len(got - cover) <= 6 and len(cover - got) <= 6 and (not cover or got)


def test_wrong_decoding_round_trip(spark):
    clean = ["Le café était fermé à l’été “très” tôt, £5 — naïve garçon", "Die Straße über Köln, „schön“", "não há irmã, IRMÃ NÃO é ação"] * 20
    rng = random.Random(5)
    rows = [(i, t, 0) for i, t in enumerate(clean)]
    for k, codec in enumerate(("cp1252", "latin-1", "cp1250", "mac_roman")):
        rows.append((1000 + k, mojibake.garble(rng.choice(clean[:2]), codec), 0))
    rows += [(2000, None, 0), (2001, "", 0), (2002, "plain ascii", 0), (2003, "lost � here", 0), (2004, "No. № 5 † ½ Æneid", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored int")
    got = {r.doc_id: r for r in mojibake.repair_encoding(df).collect()}
    assert set(got) == {1000, 1001, 1002, 1003, 2003} and got[2003].n_lost == 1
    assert all(got[i].restored in clean for i in range(1000, 1004))


def test_rare_characters_of_a_large_table_are_known(spark):
    # 840,000 trigrams; those of "И…" stand three times, and read as UTF-8 these two are one character.
    rows = [(i, "é " * 28_000) for i in range(10)] + [(100 + i, "b И… b") for i in range(3)] + [(200, "b Ã© b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in mojibake.repair_encoding(df).collect()}
    assert got == {200: "b é b"}


def _plain_margin(texts, errors=0.001):
    """The margin by one dictionary of all trigrams."""
    three = Counter(s[i : i + 3] for t in texts for a, b, left, right in mojibake._places(t) for s in [left + t[a:b] + right] for i in range(len(s) - 2))
    parts = {k: Counter() for k in ("head2", "two", "head1", "one")}
    for g, n in three.items():
        for k, x in (("head2", g[:2]), ("two", g[1:]), ("head1", g[1]), ("one", g[2])):
            parts[k][x] += n
    total = sum(three.values()) + 1

    def score(t):
        p = lambda a, b, c: 0.7 * three[a + b + c] / (parts["head2"][a + b] + 1) + 0.25 * parts["two"][b + c] / (parts["head1"][b] + 1) + 0.05 * (parts["one"][c] + 0.01) / (total + 10_000)
        return sum(math.log(p(*t[i - 2 : i + 1])) for i in range(2, len(t)))

    def gain(left, run, right):
        found = mojibake.repairs(run) + (tuple(x for x in mojibake.repairs(run + "\xa0") if "\ufffd" not in x) if right[0] in " \n" and run[-1] in "ÃÐГ├√Ă" else ())
        return max((score(left + x + right) if "\ufffd" not in x else score(left + run + right) + 1e-9 for x in found), default=None)

    gains = {True: [], False: []}
    for g, n in three.items():
        if not g[1].isascii():
            once = [mojibake.garble(g[1], c) for c in mojibake.CODECS]
            for x in {g[1], *once, *(mojibake.garble(y, c) for y in once for c in mojibake.CODECS)}:
                best = gain(f" {g[0]}", x, f"{g[2]} ")
                gains[x == g[1]].append((0.0 if best is None else best - score(f" {g[0]}{x}{g[2]} "), n))

    def quantile(k, q):
        want, seen = q * sum(n for _, n in gains[k]), 0
        return next(x for x, n in sorted(gains[k]) if (seen := seen + n) >= want)

    high, low = max(quantile(True, 1 - errors), 0.0), quantile(False, 0.01)
    return max(0.0, min(high + 1e-6, low) if low > high else (high + low) / 2)


def test_margin_of_all_contexts_and_chains(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    often = [f"{a}Ã{b} " * 3 for a in letters[:16] for b in letters[:16]]
    texts = [*often, *(f"{a}Ã " for a in letters), *(f"{a}à " * 30 for a in letters)]
    for kept in (texts, texts[:-26], ["x “é” y ½ № Œ", "Œ"], ["plain"]):
        df = spark.createDataFrame([(t,) for t in kept], "text string")
        want = _plain_margin(kept) if kept != ["plain"] else 0.0
        assert mojibake.train(df).margin == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert _plain_margin(texts) > 0.1


def test_repairs_are_the_same_in_blocks_of_any_size(spark):
    clean = ["Le café était fermé à l’été “très” tôt, £5 — naïve garçon", "Die Straße über Köln, „schön“"] * 20
    rows = [*enumerate(clean), *((100 + i, mojibake.garble(t, mojibake.CODECS[i % 7])) for i, t in enumerate(clean)), (None, mojibake.garble(clean[0], "cp437")), (None, "lost � and Ã"), (7, "lost � and Ã"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = mojibake.train(df)
    one, many = (sorted(map(str, mojibake.repair_encoding(df, model=model, per_block=k).collect())) for k in (10**9, 50))
    assert one == many and len(one) == len(clean) + 3
    margins = [mojibake._margin(Scratch(spark, "margin"), model.three.withColumnRenamed("n3", "n"), model, 0.001, k) for k in (3, 10**6)]
    assert margins == [model.margin] * 2
    none = df.where("text = ''")
    assert mojibake.repair_encoding(none).collect() == [] and mojibake.repair_encoding(none).dtypes[0] == ("doc_id", "bigint")


def test_boosted_trees_and_calibration():
    rng = np.random.RandomState(6)
    x = rng.rand(3000, 4)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    assert ((m.probability(x[2500:]) >= 0.5) == y[2500:]).mean() > 0.97
    assert (BoostedTrees().fit(x[:5], np.zeros(5)).probability(x) < 0.5).all()


def test_structure_is_told_from_prose(spark):
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "it", "was", "house", "garden", "seen", "he", "walked", "to"]) for _ in range(60)) + "."
    make = [prose, lambda: "\n".join(f"| Row | {rng.random():.2f} | {rng.randint(1, 99)} |" for _ in range(12)), lambda: "\n".join(f"* golden item {rng.randint(1, 99)}" for _ in range(12)), lambda: " ".join(f"{rng.getrandbits(32):08x}" for _ in range(30))]
    rows = [(i, make[i % 4]() if i % 8 < 6 else prose(), i % 4 if i % 8 < 6 else 0) for i in range(400)] + [(900, None, 0), (901, "", 0)]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, k int").selectExpr("'documents' as tab", "rec_id", "text", "k")
    labels = spark.createDataFrame([("documents", i, "prose" if k == 0 else "table") for i, _, k in rows[:100]], "tab string, rec_id bigint, kind_label string")
    common = frozenset("the of and it was he to".split())
    model = quality.train(df, labels, common)
    got = {r.rec_id: r.probability for r in quality.structure_probability(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (k > 0) for i, _, k in rows[100:400]]) > 0.97 and 900 in got
    assert 20 < model.n_held_out < 80 and model.n_agree >= 0.95 * model.n_held_out
    assert quality.train(df.where("false"), labels, common).trees.trees == []


def test_the_training_sample_is_bounded(spark):
    text = "the house of the garden was seen and it was to be of the garden. " * 3
    df = spark.createDataFrame([("documents", i, text) for i in range(3000)], "tab string, rec_id bigint, text string")
    labels = spark.createDataFrame([("documents", i, "prose") for i in range(1000)], "tab string, rec_id bigint, kind_label string")
    m = quality.train(df, labels, frozenset(["the", "of", "was", "and"]), max_records=300, max_labels=100)
    assert 150 < m.n_trained < 400 and 60 < m.n_calibrated + m.n_held_out < 150


def test_common_words_of_each_language(spark):
    rows = [("en", f"The house, THE x{i} of y{i}") for i in range(50)] + [(" EN", "the zebra of it")] + [("fr", f"le la z{i}") for i in range(10)] + [("xx", "rare")] * 0 + [(None, "the the"), ("en", None), ("en", "")]
    got = quality.common_words(spark.createDataFrame(rows, "lang string, text string"))
    assert got == {"the", "house", "of", "le", "la"}
    assert quality.common_words(spark.createDataFrame([], "lang string, text string")) == frozenset()


KNOWN = {w: 3000 for w in "the of house garden before remarked orchard colony mountain morning second hand weather window".split()} | {"to-morrow": 500}
RARE = [(w, 3) for w in "thc housc gardcn bcfore rcmarked sccond wcather colonv tlie anv".split()] + [("gardcns", 2), ("windowf", 2)]


def _editor():
    return scans.fit_editor(dict(KNOWN), RARE, support=1)


def test_editor_repairs_misread_words_only():
    ed = _editor()
    assert [ed.edit(w) for w in ("bcfore", "colonv", "orchard", "xyzzy", "12d")] == ["before", "colony", "orchard", "xyzzy", "12d"]
    assert ed.joins("moun", "tain") and not ed.joins("to", "morrow")


def test_editor_inserts_lost_letters():
    lost = [(w, 2) for w in "hous gardn befre orchrd colny mountin mornng secnd weathr windw handd".split()]
    ed = scans.fit_editor(dict(KNOWN), lost, support=1)
    assert ed.ops[""] and {"inside", "end"} <= set(ed.places)
    assert [ed.edit(w) for w in "hous gardn befre orchrd mornng".split()] == "house garden before orchard morning".split()
    assert [ed.edit(w) for w in ("house", "xyzzy", "of", "the")] == ["house", "xyzzy", "of", "the"]
    # Without any sign of lost letters only those inside longer words are looked for.
    assert [_editor().edit(w) for w in ("hous", "mountin", "wether")] == ["hous", "mountain", "weather"]


def test_long_words_are_edited_and_cut_off_words_left():
    long = "incomprehensibilityandsomuchmore"
    ed = scans.fit_editor(dict(KNOWN) | {long: 900}, RARE, support=1)
    assert ed.edit(long.replace("o", "c", 1)) in (long, long.replace("o", "c", 1)) and ed.edit(long[:9] + long[10:]) == long
    assert ed.cut_off("moun") and not ed.cut_off("house") and not ed.cut_off("zzz")


def test_joiner_tells_divisions_from_dashes():
    known = dict(KNOWN) | {"the": 90000, "of": 80000}
    ed = scans.fit_editor(known, RARE, support=1)
    assert ed.division("moun", "tain") == scans.JOINED and ed.division("to", "morrow") == scans.HYPHENATED and ed.division("of", "the") == scans.APART
    assert ed.division("thorv", "astle") == scans.JOINED
    r = scans.Reader(ed)
    assert r.divides("the moun-\ntain") and not r.divides("house of-\nthe garden") and not r.divides("the house")


def test_page_repair_and_codes():
    r = scans.Reader(_editor())
    text = "THE HEAD 12\nbcfore the moun-\n43\ntain ^ of the g a r d e n\n\nto-\nmorrow the house."
    assert scans.repair_page(text, {0, 2}, r) == "before the mountain of the garden\n\nto-morrow the house."
    assert scans.Reader.noisy(r.codes(["the", "w", "h", "a"])) and not scans.Reader.noisy(r.codes(["the", "house", "a"]))


def test_noise_of_a_small_table(spark):
    title = "The History of Dunhythe"
    rows = [("scan_records", i, "f", title, (f"{title.upper()}\n" if i % 2 else "") + "the house of the gar-\nden before the orchard.\nthe colony remarked.\n" + (f"— {i} —" if i % 3 == 0 else "the hand."), 0) for i in range(40)]
    rows += [("scan_records", 90, "f", None, None, 0), ("scan_records", 91, None, title, "", 0), ("scan_records", 92, "f", title, "\n \n", 0)]
    pages = spark.createDataFrame(rows, "tab string, rec_id bigint, grp string, title string, text string, kind int")
    read = scans.read_pages(pages, _editor())
    lines = scans.furniture_rows(read)
    found = {(r.rec_id, r.kind) for r in scans.noise_kinds(read, scans.classify_lines(lines, scans.train_furniture(lines))).collect()}
    assert found == {(i, "hyphen") for i in range(40)} | {(i, "header") for i in range(1, 40, 2)} | {(i, "page_no") for i in range(0, 40, 3)}
    assert {r.rec_id: r.repaired for r in scans.repair_pages(pages, scans.classify_lines(lines, scans.train_furniture(lines)), _editor()).collect()}[90] is None


def test_misreadings_of_words_that_are_not_frequent(spark):
    counted = [*KNOWN.items(), *RARE, ("castles", 60), ("castlcs", 2), ("horses", 40), ("hor|ses", 1), ("bridges", 20), ("bridgcs", 2), ("xyzzy", 15), (None, 3)]
    counts = spark.createDataFrame(counted, "word string, n bigint")
    lexicon = scans.rare_misreadings(counts, _editor())
    assert sorted(map(tuple, lexicon.collect())) == [("castlcs", "castles"), ("hor|ses", "horses")]
    texts = ["The house of the Castlcs, before the garden.", "The house—CASTLCS of it.", "The hor|ses of it.", "The castles of the bridgcs.", None]
    rows = [("scan_records", i, "f", None, t) for i, t in enumerate(texts)] + [("scan_records", 0, "f", None, texts[0])]
    pages = spark.createDataFrame(rows, "tab string, rec_id bigint, grp string, title string, text string")
    read = scans.read_pages(pages, _editor())
    none = spark.createDataFrame([], "tab string, rec_id bigint, at int, class string")
    found = scans.noise_kinds(read, none, scans.rare_hits(read, lexicon)).collect()
    assert sorted((r.rec_id, r.kind) for r in found) == [(0, "char"), (1, "char"), (2, "char")]
    fixed = scans.repair_pages(pages, none, _editor(), scans.rare_hits(scans.rare_words(pages, _editor()), lexicon)).collect()
    want = ["The house of the Castles, before the garden.", "The house—CASTLES of it.", "The horses of it.", texts[3], None]
    assert sorted((r.rec_id, r.repaired or "") for r in fixed) == sorted((i, t or "") for i, t in [*enumerate(want), (0, want[0])])


def test_perceptron_learns_and_repeats():
    ex = [([["keep"], ["go", ("odd", i % 2)]], i % 2) for i in range(200)]
    a, b = (AveragedPerceptron().train(ex) for _ in range(2))
    assert a.weights == b.weights and all(a.best(o) == y for o, y in ex)
    assert AveragedPerceptron().train([]).weights == {}


def test_number_and_head_lines():
    assert [scans._stands_apart(s) for s in ("43", "— 12 —", "p. x.", "THE HEAD", "The House and its Garden", "the house was", "In the morning he went")] == ["n", "n", "n", "h", "h", None, None]
    assert scans.title_likeness(scans.fold("THE ANNAL5 OF MOSKMINSTER"), "The Annals of Moskminster") >= 2
