import hashlib
import math
import random

import numpy as np
import pytest

from skylattice.llm import vector_codes
from skylattice.llm.vector_codes import Codebooks, compress, decode, encode, nearest, train, usable

SCHEMA = "vec_id long, embedding array<float>, label int, error string, _key string"


def table(spark, n=230, dims=64, seed=5):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.gauss(0, 1), float(round(r.gauss(0, 1))), 0.25]) for _ in range(dims)], r.choice([1, 1, 2, None]), "clash", "clash") for i in range(n)]
    rows += [(n, None, 1, None, None), (n + 1, [None] * dims, 1, None, None), (n + 2, [math.nan] * dims, 1, None, None), (n + 3, [math.inf] * dims, 1, None, None)]
    rows += [rows[3], rows[3], (n + 4, rows[7][1], None, None, None), (None, [0.5] * dims, 2, None, None), (n + 5, [0.5] * 7, 2, None, None), (n + 6, [], 2, None, None), (n + 7, [1.0] * 32, 2, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(rows, dims=64, parts=16, entries=64, rounds=2):
    kept = [(r["vec_id"], [math.floor(256 * float(np.float32(x))) for x in r["embedding"]], r["label"]) for r in rows if r["embedding"] and len(r["embedding"]) == dims and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    k = dims // parts
    books = [[list(x[1][p * k : p * k + k]) for x in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def best(p, v):
        return min((square(v, e), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in kept:
                got[best(p, v[p * k : p * k + k])[1]].append(v[p * k : p * k + k])
            books[p] = [[sum(c) // len(c) for c in zip(*g, strict=True)] if g else e for g, e in zip(got, books[p], strict=True)]
    out, sums = [], {}
    for key, v, label in kept:
        found = [best(p, v[p * k : p * k + k]) for p in range(parts)]
        out.append((key, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((key, code, error, sums[label], digest) for key, code, error, label in out), key=str)


def test_codes_are_those_of_all_distances(spark):
    df = table(spark)
    got = compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(df.collect())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_few_rows_and_many_labels(spark, monkeypatch, limit):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", limit)
    df = table(spark, n=20)
    assert sorted(map(tuple, compress(df).collect()), key=str) == by_hand(df.collect())
    assert compress(df.limit(0)).count() == 0


def test_search_is_exact_with_ties():
    r = np.random.default_rng(2)
    for k in (1, 4, 24):
        entries = r.integers(-3, 4, (64, k))
        entries[40:] = entries[:24]
        x = r.integers(-4, 5, (500, k))
        index, d = nearest(x, entries)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    high = np.full((1, 4), vector_codes.largest(64, 16))
    assert nearest(high, -high)[1][0] == 4 * (2 * vector_codes.largest(64, 16)) ** 2


def test_huge_components_and_round_trip(spark):
    df = spark.createDataFrame([(i, [3e38 if i == 1 else float(i) / 256] * 16, 0) for i in range(5)], "vec_id long, embedding array<float>, label int")
    kept = usable(df)
    books = train(kept, 16)
    assert isinstance(books, Codebooks) and books.entries.shape == (16, 5, 1)
    back = decode(encode(kept, books, 16), books).orderBy("vec_id").collect()
    assert [r["embedding"][0] for r in back] == [0.0, vector_codes.largest(16, 16) / 256, 2 / 256, 3 / 256, 4 / 256]
