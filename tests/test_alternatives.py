import random

from skylattice.operators import matching


def by_hand(rows, reach):
    out = {}
    for k, g, v in rows:
        for other, h, w in rows:
            if None not in (k, g, v, other, h, w) and g == h and k != other and abs(v - w) <= reach:
                out.setdefault(k, []).append(other)
    return {k: ",".join(map(str, sorted(x))) for k, x in out.items()}


def test_lists_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "SLICE", 7)
    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.uniform(-50, 50)) for i in range(150)] + [(1000 + i, "c", 10.0 * i) for i in range(8)]
    rows += [(3, "a", 1.0), (3, "b", 2.0), (5, "c", 71.0), (None, "a", 1.0), (200, None, 1.0), (201, "a", None), (202, "a", float("nan")), (203, "a", float("inf")), (204, "d", 1.0), (205, "c", 1e7), (-9, "a", 0.0)]
    items = spark.createDataFrame(rows, "id long, kind string, price double")
    for reach in (10.0, 300.0):
        got = [(x["id"], x["others"]) for x in matching.alternatives(items, "id", ["kind"], "price", reach, "others").collect()]
        assert len(got) == len(dict(got)) and dict(got) == by_hand(rows, reach)
    assert matching.alternatives(items.where("id < -100"), "id", ["kind"], "price", 10.0, "others").count() == 0


def test_pairs_are_never_rows(spark):
    """They were joined, dealt by key and gathered again before."""
    items = spark.createDataFrame([(i, "a", float(i % 7)) for i in range(300)], "id long, kind string, price double")
    out = matching.alternatives(items, "id", ["kind"], "price", 10.0, "others")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(len(x["others"].split(",")) for x in out.collect()) == [299] * 300
