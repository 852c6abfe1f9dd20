"""Hand-made fixtures and recomputation for the photometry operators."""

import math
import random
from statistics import median, pstdev

import pytest
from pyspark.sql import functions as F

from skylattice.functions import expr, robust
from skylattice.operators import comparison, photometry, spatial, store, variability
from skylattice.operators.variability import VariabilityConfig
from skylattice.sources import files


def curves(spark, frames=40, seed=1):
    r = random.Random(seed)
    rows = []
    for s in range(30):
        for f in range(frames):
            base = 1000.0 * (s + 1)
            if s == 0:
                value = base * (1 + 0.3 * math.sin(f / 5))
            elif s == 1:
                value = base * (1.5 if f >= frames // 2 else 1.0)
            else:
                value = base * (1 + r.gauss(0, 0.01))
            rows.append((f"s{s:02d}", f"f{f:03d}", value))
    return spark.createDataFrame(rows, "catalog_id string, frame_id string, flux double")


def test_planted_variables_stand_out(spark):
    cfg = VariabilityConfig(mag_limit=99.0, min_field=10)
    cells = variability.covered(variability.normalise_frames(variability.flux_cells(curves(spark))), 0.5)
    rms = variability.rms_variability(cells, cfg).withColumn("mag", F.lit(12.0) + F.substring("catalog_id", 2, 2).cast("double") / 10).withColumn("field", F.lit(True))
    got = {r["catalog_id"]: r["is_candidate"] for r in variability.candidates(variability.envelope(rms, cfg), cfg).collect()}
    assert got.pop("s00") and got.pop("s01") and not any(got.values())
    turns = {r["catalog_id"]: r["vdi"] for r in variability.sign_changes(cells, cfg).collect()}
    assert turns["s01"] < turns["s05"]


def test_scale_and_order_change_nothing(spark):
    cfg = VariabilityConfig()
    one = curves(spark)
    two = one.withColumn("flux", F.col("flux") * 7.0).orderBy(F.rand(3))
    a, b = (sorted((r["catalog_id"], round(r["rms_pct"], 9)) for r in variability.rms_variability(variability.normalise_frames(variability.flux_cells(t)), cfg).collect()) for t in (one, two))
    assert a == b


def test_rms_matches_recomputation(spark):
    rows = curves(spark)
    got = {r["catalog_id"]: r for r in variability.rms_variability(rows, VariabilityConfig()).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r["catalog_id"], []).append(r["flux"])
    for k, v in values.items():
        m = median(v)
        s = median(abs(x - m) for x in v) / 0.6745
        inside = [x for x in v if abs(x - m) < 5 * s]
        assert got[k]["n_clean"] == len(inside)
        assert got[k]["rms_pct"] == pytest.approx(100 * pstdev(inside) / (sum(inside) / len(inside)))


def test_identifiers(spark):
    given = ["1498486880958321200", "1.4984868809583212e18", "123.0", "nan", " ", None, "DET_7", " 42 "]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string")
    got = [r["id"] for r in rows.select("i", expr.exact_id(F.col("t")).alias("id")).orderBy("i").collect()]
    assert got == ["1498486880958321200", "1498486880958321200", "123", None, None, None, "DET_7", "42"]


def test_sky_pairs_are_all_pairs(spark):
    r = random.Random(4)
    points = [(i, r.choice([r.uniform(0, 360), r.uniform(-1, 1) % 360]), r.choice([r.uniform(-90, 90), r.uniform(88.5, 90), r.uniform(-90, -88.5), 0.0])) for i in range(400)]
    df = spark.createDataFrame(points, "id int, ra_deg double, dec_deg double")

    def separation(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * math.degrees(math.asin(math.sqrt(min(1, h))))

    for radius in (0.3, 1.0, 7.0):
        got = {(x["l_id"], x["r_id"]) for x in spatial.sky_pairs(df, df, radius).collect()}
        assert got == {(a[0], b[0]) for a in points for b in points if separation(a, b) <= radius}


def test_greedy_matching(spark):
    r = random.Random(6)
    pairs = [(a, b, round(r.random(), 6)) for a in range(30) for b in range(30) if r.random() < 0.2]
    got = sorted((x["a"], x["b"]) for x in spatial.one_to_one(spark.createDataFrame(pairs, "a int, b int, distance double"), "a", "b").collect())
    left, right, want = set(), set(), []
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.append((a, b))
    assert got == sorted(want)


def test_quadratic_trend_and_clip(spark):
    rows = [("a", i, (1 + 0.5 * i / 19 + 0.2 * (i / 19) ** 2)) for i in range(20)] + [("b", i, float(i + 1)) for i in range(4)]
    flat = robust.quadratic_trend(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], "i").collect()
    assert all(abs(r["detrended"] - 1) < 1e-9 for r in flat if r["k"] == "a") and sorted(r["detrended"] for r in flat if r["k"] == "b") == [1, 2, 3, 4]
    values = [1.0, 1.1, 0.9, 1.05, 0.95, 1.02, 9.0, 30.0]
    kept = robust.iterative_clip(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "v", ["k"], n_min=3)
    assert max(r["v"] for r in kept.collect()) == 1.1


def test_selection_keeps_slots(spark):
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 9.0, 1.2, 9.0, 1.3, 1.4, 1.45, 1.49])], "g string, i int, v double")
    got = [r["i"] for r in comparison.conditional_head(rows, "g", [F.col("i")], "v").orderBy("rank").collect()]
    assert got == [0, 1, 2, 4, 6, 7, 8]


def test_airmass_slope_is_physical(spark):
    rows = [(t, i, 10 + b * (1 + i / 10), 1 + i / 10, "normal") for t, b in ((1, 0.2), (2, -0.1), (3, 2.0)) for i in range(12)]
    out = photometry.airmass_detrended(spark.createDataFrame(rows, "t int, i int, mag double, airmass double, flag string"), ["t"]).collect()
    slopes = {r["t"]: r["am_slope"] for r in out}
    assert slopes[1] == pytest.approx(0.2) and slopes[2] is None and slopes[3] is None
    assert pstdev([r["detrended"] for r in out if r["t"] == 1]) < 1e-9


def test_pooled_merge_is_stable(spark):
    schema = "k int, rms double, n_frames int, n_obs int, median_mag double, suspect boolean"
    old = spark.createDataFrame([(1, 0.3, 10, 1, 12.0, False), (2, None, 0, 1, None, True)], schema)
    new = spark.createDataFrame([(1, 0.1, 30, 1, 13.0, False), (3, 0.2, 5, 1, 11.0, False)], schema)
    got = {r["k"]: r for r in store.merge_pooled(old, new, "k").collect()}
    assert got[1]["rms"] == pytest.approx(math.sqrt((10 * 0.09 + 30 * 0.01) / 40)) and got[1]["median_mag"] == 12.5 and got[1]["n_obs"] == 2
    assert got[2]["suspect"] and got[3]["n_obs"] == 1


def test_frame_files(spark, tmp_path):
    (tmp_path / "night").mkdir()
    (tmp_path / "night/proc_001.csv").write_text("catalog_id,dao_flux,photometry_ok,zone\n123.0,10.5,True,linear\nDET_1,nan,1,noisy9\n")
    (tmp_path / "night/skip.csv").write_text("catalog_id\n9\n")
    df = files.frames(spark, f"file://{tmp_path}", ["catalog_id", "dao_flux", "photometry_ok", "zone"])
    assert sorted((r["frame_id"], r["catalog_id"], r["dao_flux"]) for r in df.collect()) == [("proc_001", "123", 10.5), ("proc_001", "DET_1", None)]
    assert [r["catalog_id"] for r in files.quality(df).collect()] == ["123"]
    assert files.normalised(df).where("mag_inst is not null").count() == 1 and files.missing_columns(df, ["x", "zone"]) == ["x"]
    curve = spark.createDataFrame([("a", 1.23456789, 2.0)], "catalog_id string, mag_calib double, aperture_r_px double")
    files.write_curves(curve, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").first()["mag_calib"] == "1.234568"


def test_boxes_of_a_clustered_table(spark, tmp_path):
    r = random.Random(12)
    positions = [(r.random() * 360, r.uniform(-90, 90)) for _ in range(3000)] + [(0.0, 90.0), (360.0, -90.0), (359.9999, 3.0), (7.5, 0.0), (-1.0, 2.0), (365.0, 2.0), (None, 1.0), (2.0, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(positions)], "id int, ra_deg double, dec_deg double")
    path = f"file://{tmp_path}/sky"
    steps = {"ra_step": 40.0, "dec_step": 30.0}
    spatial.write_clustered(df, path, **steps)
    for box in ((350.0, 370.0, -5.0, 5.0), (10.0, 20.0, 40.0, 60.0), (0.0, 360.0, 89.0, 90.0), (-15.0, 0.0, -90.0, 90.0), (355.0, 360.0, 0.0, 4.0), (7.5, 7.5, 0.0, 0.0), (5.0, 6.0, 3.0, 1.0)):
        low, high = box[0] % 360, box[1] % 360
        inside = lambda ra: box[1] - box[0] >= 360 or (low <= ra % 360 <= high if low <= high else ra % 360 >= low or ra % 360 <= high)  # noqa: B023, E731
        want = {i for i, (ra, dec) in enumerate(positions) if ra is not None and dec is not None and box[2] <= dec <= box[3] and inside(ra)}
        found = spatial.read_box(spark, path, "id int, ra_deg double, dec_deg double", *box, **steps)
        assert {x["id"] for x in found.collect()} == want and {x["id"] for x in spatial.boxes(df, *box).collect()} == want
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for low, high, pushed in ((10.0, 20.0, ["GreaterThanOrEqual(ra_deg,10.0)", "LessThanOrEqual(ra_deg,20.0)"]), (350.0, 370.0, ["Or(And(GreaterThanOrEqual(ra_deg,0.0),LessThanOrEqual(ra_deg,10.0)),And(GreaterThanOrEqual(ra_deg,350.0)"])):
        plan = spatial.read_box(spark, path, "id int, ra_deg double, dec_deg double", low, high, -5.0, 5.0, **steps)._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.split("\n") if "FileScan" in line)
        assert "PartitionFilters: [sky_cell" in scan and all(x in scan.split("PushedFilters")[1] for x in pushed)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(spatial.box_strips(350.0, 370.0, -5.0, 5.0)) < 20


def test_candidates_come_in_the_order_of_their_scores(spark):
    cfg = VariabilityConfig(min_frames=10, min_points=5, min_field=5, mag_limit=20.0)
    cells = variability.normalise_frames(variability.flux_cells(curves(spark)))
    catalogue = spark.createDataFrame([(r["catalog_id"], 10 + i / 10, True) for i, r in enumerate(cells.select("catalog_id").distinct().orderBy("catalog_id").collect())], f"catalog_id {dict(cells.dtypes)['catalog_id']}, mag double, field boolean")
    stars = variability.rms_variability(cells, cfg).join(catalogue, "catalog_id", "left")
    scores = [r["score"] for r in variability.candidates(variability.envelope(stars, cfg), cfg).collect()]
    known = [x for x in scores if x is not None]
    assert len(known) > 5 and known == sorted(known, reverse=True) and scores[: len(known)] == known


def test_stress_sample_takes_the_frames_of_lowest_hash(spark):
    rows = [(f"s{s}", f"f{f}", 100.0 + 7 * s + (s * f) % 11) for f in range(20) for s in range(1 if f == 3 else 6)]
    df = spark.createDataFrame(rows, "catalog_id string, frame_id string, flux double")
    hashes = {r["frame_id"]: r["h"] for r in df.select("frame_id", F.xxhash64("frame_id", F.lit(5)).alias("h")).distinct().collect()}
    full = sorted((h, f) for f, h in hashes.items() if f != "f3")
    chosen = {f for _, f in full[: max(1, math.ceil(0.3 * len(full)))]}
    flux = {(s, f): x for s, f, x in rows if f in chosen}
    middle = {f: median(x for (_, g), x in flux.items() if g == f) for f in chosen}
    want = {s: math.sqrt(sum((flux[s, f] / middle[f] - 1) ** 2 for f in chosen) / len(chosen)) for s in {s for s, _ in flux}}
    got = {r["catalog_id"]: r["comp_rms"] for r in comparison.stress_sample(df, frac=0.3, seed=5).collect()}
    assert got == pytest.approx(want)


def test_colours_of_stars_that_have_none(spark):
    from skylattice.operators import catalogues

    stars = spark.createDataFrame([(1, 0.0002, 0.0, 12.0, None), (2, 50.0, 0.0, 12.0, 0.7), (3, 60.0, 0.0, None, None), (4, 70.0, 0.0, 12.0, float("nan")), (5, 80.0, 0.0, 12.0, None), (6, None, 0.0, 12.0, None)], "k int, ra_deg double, dec_deg double, mag double, bp_rp double")
    catalogue = spark.createDataFrame([(10, 359.9998, 0.0, 12.5, 1.1), (11, 0.0009, 0.0, 12.0, 2.0), (12, 70.0, 0.0, 13.0, 1.0), (13, 70.0005, 0.0005, 12.5, 0.4), (14, 80.0, 0.0001, 12.0, None), (15, 80.0, 0.0003, 12.0, 0.9)], "source_id int, ra_deg double, dec_deg double, g_mag double, bp_rp double")
    got = {r["k"]: (r["bp_rp"], r["colour_source"]) for r in catalogues.with_colours(stars, catalogue, "k").collect()}
    # across 0 degrees; own colour; no magnitude; a star at the limit of magnitude doesn't count; the nearest has no colour; no place
    assert got == {1: (1.1, "catalogue"), 2: (0.7, "own"), 3: (None, None), 4: (0.4, "catalogue"), 5: (None, None), 6: (None, None)}


def test_photometry_settings_stay_within_limits():
    from skylattice.plans.config import DEFAULTS, photometry_settings, variability_config

    assert photometry_settings({}) == {k: rule[0] for k, rule in DEFAULTS.items()}
    got = photometry_settings({"qc_min_stars": -5, "annulus_inner_fwhm": 12, "phase01_comparison_n_comp_min": "11", "phase01_comparison_n_comp_max": 4, "phase01_comparison_max_bv_diff": "x", "catalog_query_max_rows": 10**9, "phase01_comparison_max_mag_diff": float("nan")})
    assert (got["qc_min_stars"], got["annulus_outer_fwhm"], got["phase01_comparison_n_comp_max"], got["phase01_comparison_max_bv_diff"], got["catalog_query_max_rows"], got["phase01_comparison_max_mag_diff"]) == (0, 13.0, 11, 0.15, 500_000, 0.25)
    assert isinstance(got["phase01_comparison_n_comp_max"], int)
    assert variability_config({"variability_min_points_rms": 2, "variability_clip_ratio_min": 3}).min_points == 5
