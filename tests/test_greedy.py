import random

import pytest

from skylattice.operators import greedy as module
from skylattice.operators.greedy import connected, greedy


def by_hand(rows):
    taken, lefts, rights = set(), set(), set()
    for d, a, b in sorted(rows):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            taken.add((a, b, d))
    return taken


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_same_pairs_as_one_by_one(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "GROUP_PAIRS", limit)
    r = random.Random(9)
    rows = [(float(r.randrange(6)), r.randrange(120), r.randrange(400 if i % 2 else 90)) for i in range(350)]
    df = spark.createDataFrame([(a, b, d, "x") for d, a, b in rows] + [(None, 1, 0.0, "x"), (1, None, 0.0, "x")], "a long, b long, d double, note string")
    got = greedy(df, "a", "b", ["d"]).collect()
    assert {(x["a"], x["b"], x["d"]) for x in got} == by_hand(rows) and len(got) == len(by_hand(rows))
    assert greedy(df.limit(0), "a", "b", ["d"]).count() == 0


def test_a_chain_of_a_thousand_in_few_rounds(spark, monkeypatch):
    # each pair is free only when the one before it has been settled: rounds of first pairs would need 500
    rows = [(float(i), (i + 1) // 2, i // 2) for i in range(1000)]
    df = spark.createDataFrame([(a, b, d) for d, a, b in rows], "a long, b long, d double")
    cuts = []
    one = module.cut
    monkeypatch.setattr(module, "cut", lambda t: cuts.append(1) or one(t))
    got = {(x["a"], x["b"], x["d"]) for x in greedy(df, "a", "b", ["d"]).collect()}
    assert got == by_hand(rows) and len(cuts) < 25


def test_a_large_group_of_equal_wishes_in_few_rounds(spark, monkeypatch):
    # every left side wants the same right sides in the same order: rounds of first pairs would need 40
    rows = [(float(b), a, b) for a in range(40) for b in range(40)]
    df = spark.createDataFrame([(a, b, d) for d, a, b in rows], "a long, b long, d double")
    cuts = []
    one = module.cut
    monkeypatch.setattr(module, "GROUP_PAIRS", 1100)
    monkeypatch.setattr(module, "cut", lambda t: cuts.append(1) or one(t))
    got = {(x["a"], x["b"], x["d"]) for x in greedy(df, "a", "b", ["d"]).collect()}
    assert got == by_hand(rows) and len(cuts) < 45


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_same_pairs_by_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "PASS_PAIRS", 0)
    test_same_pairs_as_one_by_one(spark, monkeypatch, limit)


def test_a_group_that_is_too_large_takes_few_rounds(spark, monkeypatch):
    # the lists of near wishes make one group; beyond GROUP_PAIRS it went on in rounds of one proposal each, whose plans and
    # tasks the driver keeps
    rows = [(float(b), a, b) for a in range(40) for b in range(40)]
    df = spark.createDataFrame([(a, b, d) for d, a, b in rows], "a long, b long, d double")
    cuts = []
    one = module.cut
    monkeypatch.setattr(module, "GROUP_PAIRS", 500)
    monkeypatch.setattr(module, "cut", lambda t: cuts.append(1) or one(t))
    got = {(x["a"], x["b"], x["d"]) for x in greedy(df, "a", "b", ["d"]).collect()}
    assert got == by_hand(rows) and len(cuts) < 20
