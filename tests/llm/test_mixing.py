import random

from skylattice.llm.mixing import apportion, mix_sources, mixed_documents, source_targets
from pyspark.sql import functions as F

from .samples import documents, empty


def level(sizes, weights, most):
    """Targets by repeating: share what is left by weight, hold what is above its limit."""
    held, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in held]
        left, w = total - sum(held.values()), sum(weights[s] for s in rest)
        above = [s for s in rest if left * weights[s] / w > most * sizes[s] + 1e-9]
        if not above:
            return held | {s: left * weights[s] / w for s in rest}
        held |= {s: most * sizes[s] for s in above}


def test_targets(spark):
    r = random.Random(1)
    for _ in range(6):
        sizes = {f"s{i}": r.choice([0, 5, 100, 3000, 20000]) + r.randint(0, 9) for i in range(9)}
        sizes[None] = 77
        names = sorted(s for s in sizes if s is not None) + [None]
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        got = {x["source"]: x["target"] for x in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = level({s: n for s, n in sizes.items() if n}, weights, 3)
        for s in sizes:
            assert abs(got[s] - want.get(s, 0)) < 1e-6 * max(1, want.get(s, 0))


def test_highest_quotients(spark):
    r = random.Random(4)
    rows = [(g, i, r.choice([0, 1, 3, 10, 500, 7]), seats) for g, seats in ((0, 0), (1, 1), (2, 7), (3, 400), (4, 5)) for i in range(11)]
    got = {(x["g"], x["i"]): x["q"] for x in apportion(spark.createDataFrame(rows, "g int, i int, w long, seats long"), ["g"], [F.col("i")], "w", "seats", "q").collect()}
    for g, seats in ((0, 0), (1, 1), (2, 7), (3, 400), (4, 5)):
        own = [x for x in rows if x[0] == g]
        quotients = sorted(((-w / (2 * s + 1), i) for _, i, w, _ in own if w for s in range(seats)))[:seats]
        for _, i, _, _ in own:
            assert got[g, i] == sum(1 for _, j in quotients if j == i)


def test_mix(spark):
    docs = documents(spark)
    for shard_words in (1 << 22, 2000):
        got = mix_sources(docs, shard_words=shard_words).collect()
        again = mix_sources(docs.repartition(7), shard_words=shard_words).collect()
        key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
        assert sorted(map(key, got)) == sorted(map(key, again))
        want = sorted((str(r["doc_id"]), len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")])) for r in docs.collect())
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == want
        sums = {}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            s = sums.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            s[0] += r["taken"]
            s[1] += r["size"]
        for taken, size, target, source_size in sums.values():
            assert size == source_size and abs(taken - target) <= 0.02 * target + 1
        total = sum(s[1] for s in sums.values())
        assert abs(sum(s[2] for s in sums.values()) - total) < 1e-3
    assert mix_sources(empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = documents(spark)
    words = lambda t: __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")
    want, got, original = {}, {}, {}
    for r in mix_sources(docs).collect():
        want[str(r["doc_id"])] = want.get(str(r["doc_id"]), 0) + r["taken"]
    for r in docs.collect():
        original[str(r["doc_id"])] = words(r["text"])
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        own = words(r["text"])
        assert own and r["n_chars"] == len(r["text"])
        rest = iter(original[str(r["doc_id"])])
        assert all(w in rest for w in own)
        got[str(r["doc_id"])] = got.get(str(r["doc_id"]), 0) + len(own)
    assert got == {k: n for k, n in want.items() if n}
    assert mixed_documents(empty(spark)).count() == 0
