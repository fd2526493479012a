"""Spellings of paths, and groups against brute force, with odd rows."""

import random

import pytest

from corpusmill.functions.paths import same_file
from corpusmill.operators import components
from corpusmill.scratch import Scratch


def test_path_spellings(spark):
    same = ["./s/A.txt", "s/a.txt", "/data/train_data/s/a.txt", ".\\s\\a.txt", "s//a.txt", " ./s/a.txt ", "./s/./a.txt"]
    df = spark.createDataFrame([(p,) for p in [*same, None, "  "]], "path string")
    assert {r[0] for r in df.select(same_file(df.path)).collect()} == {"s/a.txt", None}


def test_groups_of_a_long_chain_and_odd_edges(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (3, 5), (7, 7), (9, None), (None, 2), (4, 5)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for one_task in (0, 10, 500_000):
        got = {r.id: r.group_id for r in components.connected_groups(df, Scratch(spark, "t"), one_task=one_task).collect()}
        assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 4: 3, 5: 3}
    assert components.connected_groups(df.where("false"), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_groups_of_random_graphs(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = components.connected_groups(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"), one_task=one_task).collect()
    assert {r.id: r.group_id for r in got} == want and len(got) == len(want)
