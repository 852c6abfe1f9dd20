"""Operators that SQL doesn't express, and awkward rows, against plain recomputation."""

import json
import math
import random
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from skylattice.functions import expr, robust
from skylattice.operators import archive, matching, photometry, reports, selection, shared, store
from skylattice.plans.config import read_settings, variability_config
from skylattice.sources import files
from skylattice.streaming import ingest


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return math.degrees(2 * math.asin(min(1, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))))


def test_field_registry_one_by_one(spark):
    r = random.Random(1)
    place = lambda: ((358 + 4 * r.random()) % 360, 2 * r.random() - 1)
    old = [(i + 1, *place(), f"old{i}", 1, 1, 1) for i in range(3)]
    seen = [(100 + i, *place(), r.choice([None, f"n{i}"])) for i in range(60)]
    registry = spark.createDataFrame(old, "id long, ra_deg double, dec_deg double, object_name string, first_observation long, last_observation long, n_observations long")
    observations = spark.createDataFrame(seen, "observation_id long, ra_deg double, dec_deg double, object_name string")
    after, field = archive.register_fields(registry, observations, radius_deg=0.5)
    fields, own = [list(x) for x in old], {}
    for k, ra, dec, name in seen:
        near = sorted((haversine(ra, dec, f[1], f[2]), f[0]) for f in fields)
        if near and near[0][0] < 0.5:
            f = next(f for f in fields if f[0] == near[0][1])
        else:
            f = [len(fields) + 1, ra, dec, None, k, k, 0]
            fields.append(f)
        own[k] = f[0]
        f[3], f[5], f[6] = name or f[3], k, f[6] + 1
    assert {r["observation_id"]: r["field_id"] for r in field.collect()} == own
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, fields))


def greedy(pairs, order):
    used, out = set(), set()
    for left in order:
        for d, right in sorted((d, b) for a, b, d in pairs if a == left):
            if right not in used:
                used.add(right)
                out.add((left, right))
                break
    return out


def test_priority_matching(spark):
    r = random.Random(2)
    pairs = [(a, b, round(r.random(), 3)) for a in range(25) for b in range(20) if r.random() < 0.3]
    rank = {a: r.randint(0, 9) for a in range(25)}
    df = spark.createDataFrame([(a, b, d, rank[a]) for a, b, d in pairs], "a int, b int, distance double, p int")
    got = {(x["a"], x["b"]) for x in matching.by_priority(df, "a", "b", ["p"]).collect()}
    assert got == greedy(pairs, sorted(range(25), key=lambda a: (rank[a], a)))


def test_lookup_by_id_else_place(spark):
    rows = spark.createDataFrame([("11", 0.0, 0.0, 5.0, -9.0), ("12", 10.0, 0.0, 5.0, -9.0), ("13", 11.0, 0.0, 5.0, -7.0), ("14", 100.0, 0.0, -1.0, None)], "catalog_id string, x double, y double, flux double, mag double")
    targets = spark.createDataFrame([(1, "s", "11.0", 50.0, 50.0), (2, "s", None, 9.0, 1.0), (3, "s", "99", 12.0, 0.0), (4, "s", None, 100.0, 0.0), (5, "123456789012", "12", 200.0, 0.0)], "id int, name string, catalog_id string, x double, y double")
    got = {r["id"]: (r["found"], r["how"], r["mag"]) for r in matching.id_else_place(targets, rows).collect()}
    assert got == {1: ("11", "id", -9.0), 2: ("12", "place", -9.0), 3: ("13", "place", None)}


def test_rematch_radius():
    assert matching.period_grid(span=10.0)[0] == pytest.approx(1 / 50) and matching.period_grid(span=10.0)[-1] == pytest.approx(20)


def test_rematch_uses_each_star_once(spark):
    found = spark.createDataFrame([(i, float(100 * i), 0.0, 10.0 + 0.0005 * i, 0.0) for i in range(6)], "id int, x double, y double, ra_deg double, dec_deg double")
    catalogue = spark.createDataFrame([(50 + i, float(100 * i) + 1, 0.0, 10.0 + 0.0005 * i + 0.0002, 0.0) for i in range(5)], "source_id int, x double, y double, ra_deg double, dec_deg double")
    got = matching.rematch(found, catalogue, centre=(0.0, 0.0), farthest=600.0).collect()
    assert len({r["id"] for r in got}) == len(got) == len({r["source_id"] for r in got})
    assert {(r["id"], r["source_id"]) for r in got} >= {(i, 50 + i) for i in range(5)}


def test_triangles_and_votes(spark):
    r = random.Random(3)
    stars = [(i, 10 + r.random(), 5 + r.random()) for i in range(12)]
    df = spark.createDataFrame(stars, "id int, ra_deg double, dec_deg double")
    index = matching.triangle_index(df, neighbours=5, radius_deg=3.0).collect()
    vector = lambda ra, dec: (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    want = set()
    for i, ra, dec in stars:
        near = [j for _, j in sorted((haversine(ra, dec, a, b), j) for j, a, b in stars)][:5]
        for t in combinations(sorted(near), 3):
            sides = sorted(math.dist(vector(*stars[a][1:]), vector(*stars[b][1:])) for a, b in combinations(t, 2))
            if t[0] == i and sides[0] / sides[2] >= 0.15:
                want.add(t)
    assert {(x["id0"], x["id1"], x["id2"]) for x in index} == want
    table = spark.createDataFrame(index)
    queries = spark.createDataFrame([(k, x["r1"] + 0.001, x["r2"], x["log_size"]) for k, x in enumerate(index)], "q int, r1 double, r2 double, log_size double")
    got = matching.shape_votes(queries, table, radius=0.05, k=3, low=2.0, high=5.0).collect()
    by_query = {}
    for x in got:
        by_query.setdefault(x["q"], []).append(x["distance"])
    for k, x in enumerate(index):
        all_ = sorted(math.dist((x["r1"] + 0.001, x["r2"], x["log_size"] / 3), (y["r1"], y["r2"], y["log_size"] / 3)) for y in index)
        assert sorted(by_query[k]) == pytest.approx([d for d in all_ if d < 0.05][:3])


def test_vote_cluster(spark):
    r = random.Random(4)
    votes = [(100 + 0.3 * r.random(), 20 + 0.3 * r.random()) for _ in range(30)] + [(360 * r.random(), 80 * r.random()) for _ in range(40)]
    row = matching.vote_cluster(spark.createDataFrame(votes, "ra_deg double, dec_deg double")).first()
    flat = lambda a, b: math.hypot((b[0] - a[0]) * math.cos(math.radians(a[1])), b[1] - a[1])
    counts = [sum(flat(a, b) < 1 for b in votes) for a in votes]
    assert row["votes"] == max(counts) and row["significance"] == pytest.approx(max(counts) / (len(votes) * math.pi / 41253))
    best = min(a for a, n in zip(votes, counts, strict=True) if n == max(counts))
    assert row["ra_deg"] == pytest.approx(median(b[0] for b in votes if flat(best, b) < 1))
    assert matching.vote_cluster(spark.createDataFrame(votes[-3:], "ra_deg double, dec_deg double"), least_votes=4).count() == 0


def test_clip_goes_on_to_the_end(spark):
    r = random.Random(5)
    values = [abs(r.gauss(0, 1)) ** 3 for _ in range(60)]
    kept = sorted(values)
    for _ in range(10):
        m = median(kept)
        mad = median(abs(v - m) for v in kept)
        stay = [v for v in kept if v <= m + 1.0 * mad / 0.6745]
        if mad == 0 or len(stay) < 5 or len(stay) == len(kept):
            break
        kept = stay
    got = robust.iterative_clip(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "v", ["k"], n_min=5, k=1.0)
    assert sorted(x["v"] for x in got.collect()) == kept


def test_period_is_found(spark):
    rows = [(s, 0.37 * i, math.sin(2 * math.pi * 0.37 * i / p)) for s, p in (("a", 3.1), ("b", 7.3)) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, t double, v double")
    grid = matching.period_grid(bands=(2.0, 5.0, 10.0), span=44.0)
    got = {r["s"]: r["period"] for r in photometry.best_period(photometry.lomb_scargle(df, "s", "t", "v", grid), "s").collect()}
    assert got["a"] == pytest.approx(3.1, rel=0.02) and got["b"] == pytest.approx(7.3, rel=0.03)


def test_numbering_and_quantiles(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), float(r.randint(0, 20))) for _ in range(200)] + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = shared.numbered(df.where("v is not null"), "n", ["v"], ["k"]).collect()
    for k in "abc":
        own = sorted((x["v"], x["n"]) for x in got if x["k"] == k)
        assert sorted(n for _, n in own) == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: x[1])
    q = {x["k"]: x for x in shared.group_quantiles(df, "v", ["k"], {"low": 0.1, "high": 0.77}).collect()}
    for k in "abc":
        own = sorted(v for g, v in rows if g == k and v is not None)
        for name, share in (("low", 0.1), ("high", 0.77)):
            at = (len(own) - 1) * share
            i = int(at)
            assert q[k][name] == pytest.approx(own[i] + (at - i) * (own[min(i + 1, len(own) - 1)] - own[i]))


def test_editor_and_purge(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id int, name string, active int")
    after = spark.createDataFrame([(1, "z", 1), (4, "d", 1)], "id int, name string, active int")
    used = spark.createDataFrame([(2,), (2,)], "ref int")
    saved, refused = store.editor_save(before, after, "id", {"t": (used, "ref")}, active="active")
    assert sorted(map(tuple, saved.collect())) == [(1, "z", 1), (2, "b", 0), (4, "d", 1)]
    assert [tuple(r) for r in refused.collect()] == [(2, "t", 2)]
    tables = {"a": before.select("id"), "b": spark.createDataFrame([(1, 10), (2, 20)], "a int, id int"), "c": spark.createDataFrame([(10, 1), (20, 1)], "b int, x int"), "snap": spark.createDataFrame([(1,)], "a int")}
    out = store.cascade_purge(tables, before.where("id = 1"), "id", {"a": [("b", "a", "id"), ("snap", "a", "id")], "b": [("c", "b", "id")]}, "a", keep=("snap",))
    assert {k: v.count() for k, v in out.items()} == {"a": 2, "b": 1, "c": 1, "snap": 1}


def test_writes_take_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "k int, v int, note string")
    new = spark.createDataFrame([(1, 7, 1), (1, None, 2), (3, 8, 1)], "k int, v int, n int")
    got = store.upsert(old, new, ["k"], order=["n"])
    assert sorted(map(tuple, got.collect())) == [(1, None, "x"), (2, 6, "y"), (3, 8, None)]
    assert sorted(map(tuple, store.insert_or_replace(old.drop("note"), new, ["k"], order=["n"]).collect()), key=str) == sorted([(1, None), (2, 6), (3, 8)], key=str)
    assert sorted(map(tuple, store.update_where(old, new, "k", order=["n"]).collect()), key=str) == sorted([(1, None, "x"), (2, 6, "y")], key=str)


def test_frames_by_their_own_header(spark, tmp_path):
    (tmp_path / "proc_1.csv").write_text("catalog_id,dao_flux,zone\n1.0,10,linear\n")
    (tmp_path / "proc_2.csv").write_text("zone,extra,dao_flux,catalog_id\r\nnoisy1,9,20,2\r\n\r\n")
    (tmp_path / "proc_3.csv").write_text("")
    got = files.frames(spark, f"file://{tmp_path}", ["catalog_id", "dao_flux", "zone", "airmass"]).collect()
    assert sorted((r["frame_id"], r["catalog_id"], r["dao_flux"], r["zone"], r["airmass"]) for r in got) == [("proc_1", "1", 10.0, "linear", None), ("proc_2", "2", 20.0, "noisy1", None)]
    listed = files.listing(spark, f"file://{tmp_path}")
    assert listed.count() == 2  # empty files are not listed
    names = spark.createDataFrame([(f"/a/{n}", n) for n in ("x.csv", "x.fits", "y.csv", "z_catalog.csv", "comparison_stars.csv", "masterstars_1.csv")], "path string, name string")
    assert sorted(r["name"] for r in files.measurement_tables(names).collect()) == ["x.csv", "z_catalog.csv"]
    assert files.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}"]) == f"file://{tmp_path}"
    cache = listed.select("path", "size", "modified", F.lit("h").alias("header"))
    assert files.fresh(listed, cache).count() == 2 and files.fresh(listed, cache.withColumn("size", F.col("size") + 1)).count() == 0
    assert files.schema_reason(None, []) == "no_table" and files.schema_reason(names, ["oid"]) == "missing_columns:oid"


def test_curves_phases_and_appends(spark, tmp_path):
    curve = spark.createDataFrame([("7", 2460000.5, 1.23456789, 12.3456785, 2.34567, "normal")], "catalog_id string, bjd double, mag_inst double, mag_calib double, aperture_r_px double, flag string")
    row = files.curve_rows(curve).first()
    assert list(row.asDict())[1:] == list(files.CURVE_COLUMNS) and row["mag_inst"] == 1.234568 and row["mag_calib_ct"] == row["mag_calib"] and row["aperture_r_px"] == 2.346 and row["ct_n_comp"] == -1 and row["ct_ok"] is False
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    files.write_phases(f"file://{tmp_path}/p", active=one, comparisons=one, suspects=one, summary=one)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/p/photometry_summary").count() == 1
    for rows in ([(1, "a")], [(1, "b"), (2, "c"), (2, "c")]):
        files.append_rows(spark.createDataFrame(rows, "k int, v string"), f"file://{tmp_path}/q", ["k"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"file://{tmp_path}/q").collect())) == [("1", "a"), ("2", "c")]
    files.write_sidecars(spark.createDataFrame([(1, float("nan"))], "k int, v double"), f"file://{tmp_path}/s")
    assert json.loads(spark.read.text(f"file://{tmp_path}/s").first()[0]) == {"k": 1, "v": None}


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"variability_sigma_clip": 99, "variability_min_frames": "x", "variability_p85_filter": 90, "variability_mag_limit": None}))
    cfg = variability_config(read_settings(spark, f"file://{tmp_path}/c.json"))
    assert (cfg.sigma_clip, cfg.min_frames, cfg.percentile, cfg.mag_limit) == (20.0, 30, 0.9, 14.5)
    (tmp_path / "d.json").write_text("{no")
    assert read_settings(spark, f"file://{tmp_path}/d.json") == {}


def test_stream_drops_copies_within_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/e")
    got = []
    events = spark.readStream.schema("k string, ts timestamp").parquet(f"file://{tmp_path}/e")
    once = ingest.once_within(events, "ts", ["k"])
    once.writeStream.foreachBatch(lambda b, _: got.extend(r["k"] for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(got) == ["a", "b"]


def test_missing_values_in_scores_and_tiers(spark):
    nan = float("nan")
    rows = [(None, None), (nan, 0.0), (0.2, None), (0.2, 0.2), (1.5, 9.0), (2.5, 0.0)]
    got = [r["t"] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, m double, b double").orderBy("i").select(expr.tier(F.col("m"), F.col("b")).alias("t")).collect()]
    assert got == ["TIER4", "TIER4", "TIER1", "TIER2", "TIER4", "TIER4"]
    one = spark.range(1).select(expr.comparison_score(F.lit(None).cast("double"), F.lit(1455.0), F.lit(None).cast("double"), F.lit(nan), F.lit(0.0)).alias("x"), expr.comparison_score(F.lit(0.02), F.lit(1455.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("y")).first()
    assert one["x"] == pytest.approx(0.5) and one["y"] == pytest.approx(0.01)


def test_selection_flags(spark):
    df = spark.createDataFrame([("False", "True"), ("", ""), (None, None), ("no", "y")], "a string, b string")
    assert [(r[0], r[1]) for r in df.select(selection.explicit_false(F.col("a")), selection.explicit_true(F.col("b"))).collect()] == [(True, True), (False, False), (False, False), (True, True)]
    why = spark.createDataFrame([(1.0, 1.0, 5.0), (50.0, 50.0, 99.0), (50.0, 50.0, 5.0), (None, 1.0, 1.0)], "x double, y double, p double").select(selection.fit_failure(F.col("x"), F.col("y"), 100.0, 100.0, 10, F.col("p"), F.lit(100.0), 0.9))
    assert [r[0] for r in why.collect()] == ["edge", "near saturation", "blend or mismatch", "no position"]
    rows = spark.createDataFrame([("catalog_id", 1.0, 5, "a"), ("7", 1.0, 5, "linear"), ("8", 501.0, 5, "a"), ("9", 1.0, 0, "a"), ("10", 1.0, 5, "a;b")], "catalog_id string, rms double, n_frames int, zone string")
    assert [r["catalog_id"] for r in selection.plausible_suspects(rows).collect()] == ["7"]
    lights = spark.createDataFrame([("a", "Light", None), ("b", "LIGHT", 1), ("c", None, 0), ("d", "light", 0)], "path string, imagetyp string, is_rejected int")
    assert archive.lights_to_use(lights, lights.limit(0)).count() == 2 and archive.lights_to_use(lights, lights.where("path = 'd'")).count() == 1
    assert [r[0] for r in spark.createDataFrame([("Dark frame",), ("SkyFlat",), ("object",), (None,)], "t string").select(archive.frame_kind(F.col("t"))).collect()] == ["dark", "flat", "light", "unknown"]
    same = spark.createDataFrame([("/a/b.fits",), ("/a/./B.fits",), ("/a/x/../b.fits",), ("/a//c.fits",)], "path string")
    assert archive.resolved_files(same).count() == 2


def test_frame_scores_with_missing_parts(spark):
    f = spark.createDataFrame([(1, 2.0, 10.0), (2, 4.0, None), (3, None, 30.0)], "frame_id int, fwhm double, stars double")
    got = {r["frame_id"]: (round(r["score"], 6), r["auto_limit"]) for r in reports.frame_scores(f, {"fwhm": (0.6, False), "stars": (0.4, True)}).collect()}
    assert got == {1: (0.6, None), 2: (0.0, None), 3: (0.4, None)}


def test_best_masters_are_those_of_all_pairs(spark):
    r = random.Random(12)
    pick = lambda *x: r.choice(x)
    lights = [(i, pick("dark", "flat"), pick(1, 2, 3), pick(1.0, 5.0), pick(None, 0, 1), pick("V", "R"), pick(None, r.randrange(40) / 10), pick(None, 1, 2), pick(None, 1)) for i in range(150)]
    library = [(f"m{i}", k, pick(1, 2), pick(1.0, 5.0), pick(None, 1), pick("V", "R") if k == "flat" else None, pick(None, r.randrange(40) / 10), pick(None, 1, 2), pick(None, 1), pick(None, "2024-01-02 00:00:00", "2024-05-20 00:00:00", "2024-05-21 00:00:00")) for i in range(250) for k in [pick("dark", "flat")]]
    names = "kind string, xbinning long, exptime double, gain long, filter_name string, ccd_temp double, id_equipments long, id_telescope long"
    a, b = spark.createDataFrame(lights, f"light_id long, {names}"), spark.createDataFrame(library, f"path string, {names}, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    found = archive.best_masters(a, b, now=F.lit("2024-06-01").cast("date"), validity_days=60)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "abs(" in x]  # no pairs within the tolerance are made
    got = {x["light_id"]: (x["master"], x["dt"], x["expired"]) for x in found.collect()}
    assert len(got) == len(lights)
    for i, kind, bins, exp, gain, flt, temp, eq, tel in lights:
        met = []
        for path, k, n, e, g, f, t, q, s, m in library:
            near = t is None or (temp is not None and abs(t - temp) <= 0.5)
            scope = eq is None or tel is None or (q is None and s is None) or (q, s) == (eq, tel)
            plain = bins > 1 and n == 1
            if (k, e, g or 0, f or "") == (kind, exp, gain or 0, flt if kind == "flat" else "") and near and scope and (n == bins or plain):
                dt, old = None if t is None else abs(t - temp), m is None or m < "2024-04"
                met.append((old, not plain, 1e9 if dt is None else dt, m is not None, "" if m is None else "".join(chr(255 - ord(c)) for c in m), path, dt))
        best = min(met) if met else None
        assert got[i] == ((best[5], best[6], best[0]) if best else (None, None, None)), i


def test_lowest_id_near_enough_is_that_of_all_pairs(spark):
    r = random.Random(9)
    value = lambda: r.choice((None, round(r.uniform(-9, 9), 1), r.randrange(-9, 10) / 2))
    old = [(i, r.choice((None, 1, 2)), value()) for i in range(60)]
    new = sorted({(r.choice((None, 1, 2)), value()) for _ in range(120)}, key=str)
    a, b = spark.createDataFrame(old, "id long, g long, v double"), spark.createDataFrame(new, "g long, v double")
    for tolerance in (0.0, 0.5, 0.3):
        found = store.find_or_create(a, b, "id", ["g"], "v", tolerance)
        assert "Join LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(x["g"], x["v"]): (x["id"], x["created"]) for x in found.collect()}
        assert got.keys() == set(new)
        for g, v in new:
            best = min((i for i, h, w in old if h == g and v is not None and w is not None and abs(v - w) <= tolerance), default=None)
            assert got[g, v][1] == (best is None) and (best is None or got[g, v][0] == best)
