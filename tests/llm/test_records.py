"""Groups, survivors, bin packing and cross-split overlaps against brute force, with odd rows."""

import datetime as dt
import itertools
import random

import pytest

from corpusmill.llm import binpack, crosssplit, matches, segments, survivors
from corpusmill.scratch import Scratch

DOCS = "doc_id bigint, path string, source string, chars bigint, simhash bigint, sha1 string, title string, author_name string, pub_year int, hashed_at timestamp"
T = [dt.datetime(2025, 1, d) for d in range(1, 9)]


def test_matches_with_null_and_unknown_paths(spark):
    docs = spark.createDataFrame([(2, "s/b.txt"), (1, "./s/A.txt"), (3, None)], "doc_id bigint, path string")
    m = spark.createDataFrame([("s/a.txt", "S//b.txt"), (None, "s/b.txt"), ("s/none.txt", "s/a.txt"), ("s/a.txt", "s/a.txt")], "path_a string, path_b string")
    assert sorted(map(tuple, matches.match_groups(m, docs, Scratch(spark, "t")).collect())) == [(1, 1), (2, 1)]


def test_survivor_takes_latest_positive_size_and_best_fields(spark):
    rows = [
        (1, "s/1", "blbooks", 10, 1, "x", None, "A", None, T[0]), (1, "s/1", "blbooks", -1, 1, "x", " ", "A", 1800, T[3]),
        (2, "s/2", "gutenberg", 10, 2, "y", "Title", None, None, T[1]), (2, "s/2", "gutenberg", 10, 2, "y", "Title", None, None, T[1]),
        (3, "s/3", None, 0, 3, "z", None, None, None, T[2]), (4, "s/4", None, None, 3, "z", None, None, None, None),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", group_name int")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "doc_id bigint, group_id bigint")
    gold = {r.group_id: r for r in survivors.golden_records(groups, docs).collect()}
    assert (gold[1].doc_id, gold[1].chars, gold[1].title, gold[1].author_name, gold[1].pub_year, gold[1].path) == (1, 10, "Title", "A", 1800, "s/2")
    assert (gold[3].doc_id, gold[3].n_records, gold[3].title) == (None, 2, None)
    assert survivors.golden_records(groups.where("false"), docs).collect() == []


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 7))]
        room = rng.randint(0, 30)
        counts = {n: items.count(n) for n in items}
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = binpack.fullest(counts, room)
        assert sum(n * k for n, k in got) == best and all(k <= counts[n] for n, k in got)


def test_packing_keeps_every_id_once(spark):
    rows = [(i, [i] * n, "n") for i, n in enumerate([3, 10, 7, 25, 1, 1, 6, 10, 4], 1)] + [(20, None, "n"), (21, [], "n"), (None, [1], "n"), (2, [2] * 10, "n")]
    df = spark.createDataFrame(rows, "seq_id bigint, input_ids array<int>, piece string")
    for part_rows in (1, 50_000):
        _check_rows(binpack.pack_rows(df, Scratch(spark, "t"), 10, part_rows=part_rows).collect())
    assert binpack.pack_rows(df.where("false"), Scratch(spark, "t"), 10).collect() == []


def _check_rows(out):
    assert all(r.n_ids == len(r.input_ids) <= 10 for r in out)
    flat = sorted(x for r in out for x in r.input_ids)
    assert flat == sorted(x for i, n in enumerate([3, 10, 7, 25, 1, 1, 6, 10, 4], 1) for x in [i] * n)
    whole = {k: [r.row_id for r in out if k in r["keys"]] for k in range(1, 10)}
    assert all(len(v) == 1 for k, v in whole.items() if k != 4) and len(whole[4]) == 3
    assert len(out) == 7


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_table_equals_the_full_one():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, 5) for _ in range(rng.randint(1, 30))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randint(0, 5) for _ in range(rng.randint(0, 3))]
        need = rng.randint(1, 30)
        full = _lcs(a, b)
        assert segments.lcs_at_least(len(a), segments.positions(a), b, need) == (full if full >= need else 0)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([8, 25, 60, 120, 300]))) for _ in range(30)]
    rows, val = [], []
    for i, t in enumerate(texts):
        rows.append((i, f"s/{i}.txt", t))
        val.append((f"./S/{i}.txt", "val" if i % 2 else "test"))
        w = t.split()
        for k, rate in enumerate((0.0, 0.05, 0.12, 0.3)):
            v = [rng.choice(vocab) if rng.random() < rate else x for x in w]
            half = "th-\nird " if k == 1 and i == 0 else ""
            rows.append((100 + 10 * i + k, f"s/t{i}-{k}.txt", half + "; ".join(v).upper()))
    rows += [(900, None, None), (901, "s/e.txt", ""), (902, "s/b.txt", "  \n"), (903, "s/x.txt", "***"), (904, "s/y.txt", "***"), (None, "s/n.txt", "a b"), (0, "s/0.txt", texts[0])]
    val += [("s/x.txt", "val"), ("s/x.txt", "test"), ("s/b.txt", "val"), (None, "val"), ("s/none.txt", "val")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, path string, text string, split string")
    got = crosssplit.cross_split_pairs(docs, spark.createDataFrame(val, "path string, split string"), Scratch(spark, "t")).collect()
    from corpusmill.functions.words import words

    want = set()
    for i, t in enumerate(texts):
        a = words(t)
        for d, _, u in rows:
            if d is not None and 100 <= d < 900 and u:
                b = words(u)
                if _lcs(a, b) >= 0.8 * max(len(a), len(b)):
                    want.add((i, d))
    want.add((903, 904))
    assert {(r.val_id, r.train_id) for r in got} == want and len(got) == len(want)
    assert {r.split for r in got if r.val_id == 903} == {"both"}


def test_overlaps_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, path string, text string")
    val = spark.createDataFrame([], "path string, split string")
    assert crosssplit.cross_split_pairs(docs, val, Scratch(spark, "t")).collect() == []


def _edited(rng, a, lost, come, spread, fresh):
    """``a`` without ``lost`` words and with ``come`` new ones, at even distances or anywhere."""
    n = len(a)
    place = (lambda k, s: [int((i + s) * n / k) for i in range(k)]) if spread else (lambda k, s: rng.sample(range(n), k))
    gone, new = set(place(lost, 0.25)) if lost else set(), sorted(place(come, 0.75)) if come else []
    out = []
    for i, x in enumerate(a):
        if i not in gone:
            out.append(x)
        out += [next(fresh) for p in new if p == i]
    return out


def test_no_agreeing_pair_is_missed_wherever_the_edits_are():
    import numpy as np

    rng, fresh = random.Random(8), itertools.count(10**6)
    for spread in (True, False):
        first, second, want = [], [], set()
        for n in [*range(1, 60), 75, 100, 101, 150, 220, 400]:
            for k in range(6):
                a = [rng.randrange(300) for _ in range(n)]
                lost = rng.randint(0, int(0.2 * n)) if k < 3 else int(0.2 * n)
                come = rng.randint(0, int(0.25 * n)) if k < 3 else int(0.2 * n)
                first.append(a), second.append(_edited(rng, a, lost, come, spread, fresh))
                if k == 5:
                    first[-1], second[-1] = second[-1], first[-1]
        for i, (a, b) in enumerate(zip(first, second)):
            if _lcs(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9:
                want.add((i, i))
        cut = lambda ts: (np.array([x for t in ts for x in t], np.int64).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
        got = {(x, y) for x, y, _ in segments.SegmentIndex(*cut(first), 0.8).pairs(*cut(second))}
        assert want <= got and len(want) > 250
        assert all(_lcs(first[x], second[y]) >= 0.8 * max(len(first[x]), len(second[y])) - 1e-9 for x, y in got)


def test_layouts_have_every_way_in_which_a_segment_survives():
    for width, edits in segments.FAMILIES:
        have = set(segments.LAYOUTS[(width, edits)])
        for lost in range(edits + 1):
            for come in range(edits - lost + 1):
                for places in itertools.product(range(max(1, width - lost - 1)), repeat=come):
                    at, p = [], 0
                    for i in range(width - lost):
                        at.append(p)
                        p += 1 + places.count(i)
                    subsets = {tuple(x - c[0] for x in c) for c in itertools.combinations(at, width - edits)}
                    assert subsets & have


@pytest.mark.parametrize("blocks", [(200, 300), (10**6, 10**6)])
def test_blocks_of_any_size_give_the_same_pairs(spark, blocks):
    rng, fresh = random.Random(9), (f"n{i}" for i in itertools.count())
    vocab = [f"w{i}" for i in range(200)]
    rows, want = [], set()
    for i in range(30):
        a = rng.choices(vocab, k=rng.choice([9, 40, 100]))
        b = _edited(rng, a, int(0.13 * len(a)), int(0.13 * len(a)), True, fresh)
        rows += [(i, f"s/{i}.txt", " ".join(a)), (100 + i, f"s/t{i}.txt", " ".join(b)), (200 + i, f"s/u{i}.txt", " ".join(b))]
        want |= {(i, 100 + i), (i, 200 + i)} if _lcs(a, b) >= 0.8 * max(len(a), len(b)) else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    val = spark.createDataFrame([(f"s/{i}.txt", "val") for i in range(30)], "path string, split string")
    got = [(r.val_id, r.train_id) for r in crosssplit.cross_split_pairs(docs, val, Scratch(spark, "t"), block_words=blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 50
