import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import expr
from skylattice.operators import archive, catalogues, comparison, neighbours, spatial
from skylattice.operators.neighbours import nearest_alike, nearest_in_value, within_value
from skylattice.operators.spatial import nearest_on_sky, one_to_one, plane_pairs, sky_pairs

SCHEMA = "id long, g string, v double, a double"


def stars(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["x", "x", "x", "y", None]), r.choice([None, float("nan"), 5.0, 5.0, 5.0, round(r.gauss(5, 2), 1), r.random() * 10]), r.choice([0.1 * r.randrange(20), None])) for i in range(n)]
    rows += [(n, "alone", 1.0, 0.0), (n + 1, "x", 900.0, 0.5), (n + 2, "x", -700.0, 99.0)]
    return spark.createDataFrame(rows, SCHEMA)


def known(rows, alike=False):
    return [r for r in rows if r["g"] is not None and r["v"] is not None and r["v"] == r["v"] and (not alike or r["a"] is not None)]


@pytest.mark.parametrize(("n", "block"), [(1, 4096), (5, 4), (10, 7), (500, 64)])
def test_nearest_in_value(spark, monkeypatch, n, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    df = stars(spark)
    rows = known(df.collect())
    want = set()
    for r in rows:
        best = sorted((abs(r["v"] - o["v"]), o["id"]) for o in rows if o["g"] == r["g"] and o["id"] != r["id"])[:n]
        want |= {(r["id"], i, gap, k) for k, (gap, i) in enumerate(best, 1)}
    got = nearest_in_value(df, "id", "g", "v", n).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert nearest_in_value(df.limit(0), "id", "g", "v", n).count() == 0


def test_plan_has_no_join_of_a_group_with_itself(spark):
    plan = nearest_in_value(stars(spark), "id", "g", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and all("_v#" in line or "_range#" in line for line in joins)  # by value or by range of rows, never by group


@pytest.mark.parametrize("width", [0.05, 3.0, 5000.0])
def test_nearest_alike(spark, width):
    df = stars(spark)
    rows = known(df.collect(), alike=True)
    want = set()
    for r in rows:
        best = sorted((abs(r["v"] - o["v"]), o["id"]) for o in rows if o["g"] == r["g"] and o["id"] != r["id"] and abs(o["a"] - r["a"]) < 0.4)[:6]
        want |= {(r["id"], i, gap) for gap, i in best}
    got = nearest_alike(df, "id", "g", "v", 6, "a", 0.4, width=width).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert nearest_alike(df.limit(0), "id", "g", "v", 6, "a", 0.4, width=width).count() == 0


def test_within_value(spark):
    df = stars(spark)
    rows = known(df.collect())
    got = within_value(df, "id", "g", "v", 0.3).collect()
    assert {(r["id"], r["other"]) for r in got} == {(a["id"], b["id"]) for a in rows for b in rows if a["g"] == b["g"] and a["id"] != b["id"] and abs(a["v"] - b["v"]) <= 0.3}


def test_offers_hold_all_nearest_and_few_more(spark):
    r = random.Random(5)
    own = sorted({round(r.choice((r.uniform(-3, 3), r.randrange(-6, 7) / 2)), 3) for _ in range(900)}) + [0.1 + 0.2, 1e9]
    asks = [(i % 2, r.choice((r.uniform(-4, 4), r.randrange(-8, 9) / 2, 0.3))) for i in range(400)] + [(1, None), (1, float("nan"))]
    offered = spark.createDataFrame([(g, v, f"{g}:{v!r}") for g in (0, 1) for v in own] + [(0, None, "none")], "g long, v double, name string")
    got = neighbours.nearest_offers(spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "id long, g long, v double"), offered, ["g"], "v", "name", 0.5).collect()
    assert sorted(x["id"] for x in got) == list(range(400))
    for x in got:
        assert len(x["_offers"]) <= 6
        best = min(abs(v - x["v"]) for v in own)
        if best <= 0.5:
            assert {o["name"] for o in x["_offers"] if abs(o["v"] - x["v"]) == best} == {f"{x['g']}:{v!r}" for v in own if abs(v - x["v"]) == best}


def test_nearest_on_sky_with_crowds_and_copies(spark):
    r = random.Random(3)
    place = [(r.gauss(0.0, 4.0) % 360, r.gauss(80.0, 4.0)) for _ in range(120)] + [(10 + r.gauss(0, 0.001), 5 + r.gauss(0, 0.001)) for _ in range(120)]
    place = [(a, min(d, 90.0)) for a, d in place] + [(200.0, -10.0)] * 40 + [(10.0, 5.0)] * 3
    stars = spark.createDataFrame([(i, *p) for i, p in enumerate(place)] + [(999, None, 1.0), (998, float("nan"), 1.0)], "id long, ra_deg double, dec_deg double")
    every = sky_pairs(stars, stars, 2.0).collect()
    got = {(x["ra_deg"], x["dec_deg"]): x for x in nearest_on_sky(stars, "id", 5, 2.0).collect()}
    assert got.keys() == set(place)
    for p, x in got.items():
        own = [i for i, q in enumerate(place) if q == p]
        assert x["ids"] == own[:5]
        assert [(n["distance"], n["id"]) for n in x["near"]] == sorted((e["distance"], e["r_id"]) for e in every if e["l_id"] == own[0])[:5]


def crowd(spark, n=300, seed=4):
    r = random.Random(seed)
    rows = [(i, 359.9 + 0.2 * r.random() if i % 3 else 10.0 * r.random(), r.gauss(0, 0.1), round(r.gauss(12, 0.4), 1)) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(20)]  # copies
    return spark.createDataFrame([(k, ra % 360, dec, mag) for k, ra, dec, mag in rows], "id long, ra_deg double, dec_deg double, mag double")


def counting(monkeypatch, name):
    made, own = [], getattr(spatial, name)

    def pairs(*a, **b):
        out = own(*a, **b)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, name, pairs)
    return made


def test_colours_come_from_the_nearest_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW_PAIRS", 4)
    t = crowd(spark)
    cat = t.where("id % 2 = 1").select(F.col("id").alias("source_id"), "ra_deg", "dec_deg", F.col("mag").alias("g_mag"), F.when(F.col("id") % 4 > 1, F.col("id") / 100).alias("bp_rp"))
    every = sky_pairs(t, cat, 0.9).cache()
    inside = every.where("abs(pmod(r_ra_deg - l_ra_deg + 540, 360) - 180) <= 0.6 and abs(r_dec_deg - l_dec_deg) <= 0.6 and abs(r_g_mag - l_mag) < 0.5").collect()
    best = {}
    for p in inside:
        best[p["l_id"]] = min(best.get(p["l_id"], (9.0, 0, None)), (p["distance"], p["r_source_id"], p["r_bp_rp"]), key=lambda x: x[:2])
    made = counting(monkeypatch, "sky_pairs")
    got = {r["id"]: r["bp_rp"] for r in catalogues.with_colours(t.withColumn("bp_rp", F.lit(None).cast("double")), cat, "id", radius_deg=0.6, max_dmag=0.5).collect()}
    assert got == {r["id"]: best.get(r["id"], (0, 0, None))[2] for r in t.collect()}
    assert made and sum(made) < every.count() / 2


def test_fields_are_found_without_all_pairs(spark, monkeypatch):
    t = crowd(spark)
    registry = t.where("id % 5 > 0").select("id", "ra_deg", "dec_deg", F.lit("old").alias("object_name"), F.lit(1).cast("long").alias("first_observation"), F.lit(1).cast("long").alias("last_observation"), F.lit(1).cast("long").alias("n_observations"))
    seen = t.where("id % 5 = 0").select(F.col("id").alias("observation_id"), "ra_deg", "dec_deg", F.lit(None).cast("string").alias("object_name"))
    every = sky_pairs(seen, registry, 0.5).where("distance < 0.5").cache()
    near = {r["l_observation_id"]: r["n"]["r_id"] for r in every.groupBy("l_observation_id").agg(F.min(F.struct("distance", "r_id")).alias("n")).collect()}
    monkeypatch.setattr(spatial, "FEW_PAIRS", 4)
    made = counting(monkeypatch, "sky_pairs")
    _, field = archive.register_fields(registry, seen, radius_deg=0.5)
    got = {r["observation_id"]: r["field_id"] for r in field.collect()}
    assert len(got) == seen.count() and {k: v for k, v in got.items() if k in near} == near
    assert made and sum(made) < every.count() / 2


def test_one_to_one_in_rounds_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW_PAIRS", 2)
    r = random.Random(8)
    rows = [(i, float(r.randrange(60)) if i % 4 else 500 + 100 * r.random(), float(r.randrange(60)) if i < 280 else None) for i in range(300)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    left, right = a.where("id % 3 = 0"), a.where("id % 3 > 0")
    every = plane_pairs(left, right, 30.0).select(F.col("l_id").alias("_l"), F.col("r_id").alias("_r"), "distance").cache()
    want = sorted(tuple(x) for x in one_to_one(every, "_l", "_r").collect())
    made = counting(monkeypatch, "plane_pairs")
    assert sorted(tuple(x) for x in spatial.one_to_one_within(left, right, "id", "id", 30.0).collect()) == want and want
    assert made and sum(made) < every.count()
    assert spatial.one_to_one_within(left.limit(0), right, "id", "id", 30.0).count() == 0


def test_full_tiers_equal_those_of_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["x", "x", "y", None]), r.choice([None, float("nan"), 0.25 * r.randrange(40), 10 * r.random()]), r.choice([None, 0.15 * r.randrange(8)])) for i in range(150)]
    t = spark.createDataFrame([*rows, (150, "z", 1.0, 0.1), (151, "z", 1.0, 0.1), (152, "x", 90.0, 0.1)], "id long, g string, mag double, bp_rp double")
    a, b = (t.select("g", F.col("id").alias(k), F.col("mag").alias(f"m_{k}"), F.col("bp_rp").alias(f"b_{k}")) for k in ("target_id", "comp_id"))
    every = a.join(b, "g").where("target_id <> comp_id and abs(m_target_id - m_comp_id) <= 2.0")
    tier = F.substring(expr.tier(F.abs(F.col("m_target_id") - F.col("m_comp_id")), F.abs(F.col("b_target_id") - F.col("b_comp_id"))), 5, 1).cast("int")
    want = comparison.first_full_tier(every.select("target_id", "comp_id", tier.alias("tier")), n_min=3)
    got = comparison.stars_of_full_tier(t, "id", "g", n_min=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert {x["chosen_tier"] for x in got.collect()} >= {1, 2, 3, 4}
