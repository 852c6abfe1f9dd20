import math
import random

import numpy as np
import pytest

from skylattice.operators import periods
from skylattice.operators.periods import BANDS, band_peaks, find_period, spectrum


def direct(t, y, f):
    """The classical periodogram by its definition."""
    w, y = 2 * np.pi * f, y - y.mean()
    tau = math.atan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / (2 * w)
    c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
    return ((y * c).sum() ** 2 / (c * c).sum() + (y * s).sum() ** 2 / (s * s).sum()) / 2


def points(spark, planted, n=150, span=27.3, seed=8):
    r = random.Random(seed)
    rows = [(k, r.random() * span + 2_460_000, None) for k in planted for _ in range(n)]
    rows = [(k, t, 3 + math.sin(2 * math.pi * t / planted[k]) + 0.1 * r.gauss(0, 1)) for k, t, _ in rows]
    rows += [("one", 5.0, 1.0), ("same", 5.0, 1.0), ("same", 5.0, 2.0), ("same", 5.0, 4.0), (None, 1.0, 1.0), ("a", None, 1.0), ("a", 2_460_001.0, float("nan"))]
    return spark.createDataFrame(rows, "star string, t double, v double")


def test_powers_are_those_of_direct_sums(spark):
    df = points(spark, {"a": 0.731, "b": 7.3}, n=60)
    series = {k: tuple(np.array(x) for x in zip(*[(r["t"], r["v"]) for r in df.collect() if r["star"] == k and r["t"] is not None and r["v"] == r["v"]], strict=True)) for k in "ab"}
    got = spectrum(df, "star", "t", "v", bands=(0.4, 1.0, 30.0), oversample=6).collect()
    assert {r["star"] for r in got} == {"a", "b"}
    top = max(r["power"] for r in got)
    for k, (t, y) in series.items():
        span = t.max() - t.min()
        for band, (short, long) in enumerate(((0.4, 1.0), (1.0, 30.0))):
            own = sorted((r["frequency"], r["power"]) for r in got if r["star"] == k and r["band"] == band)
            grid = np.arange(1 / long, 1 / short, 1 / (6 * span))
            assert len(own) == len(grid) and np.allclose([f for f, _ in own], grid, rtol=1e-12)
            assert max(abs(p - direct(t - t.min(), y, f)) for f, p in own) < 2e-5 * top


def test_planted_periods_over_the_whole_grid(spark):
    planted = {"a": 0.0731, "b": 0.31, "c": 1.7, "d": 3.9, "e": 12.0}
    df = points(spark, planted)
    got = {r["star"]: r for r in find_period(df, "star", "t", "v", hints=spark.createDataFrame([("b", 9.0), ("c", -1.0), ("d", float("nan"))], "star string, period double")).collect()}
    assert got["b"]["period"] == 9.0 and got["b"]["power"] is None and set(got) == set(planted)
    for k in "acde":
        assert got[k]["period"] == pytest.approx(planted[k], rel=0.01)
        assert BANDS[got[k]["band"]] <= got[k]["period"] <= BANDS[got[k]["band"] + 1]


def test_plan_does_not_grow_with_the_grid(spark):
    df = points(spark, {"a": 0.7}, n=20)
    size = [len(band_peaks(df, "star", "t", "v", oversample=o)._jdf.queryExecution().optimizedPlan().toString()) for o in (2, 500)]
    assert abs(size[0] - size[1]) < 200


def test_peaks_are_the_strongest_of_the_spectrum(spark, monkeypatch):
    monkeypatch.setattr(periods, "BLOCKS", 2)
    df = points(spark, {"a": 0.4, "b": 2.2}, n=40)
    whole = spectrum(df, "star", "t", "v", bands=(0.3, 0.5, 4.0), oversample=3).toPandas()
    peaks = band_peaks(df, "star", "t", "v", bands=(0.3, 0.5, 4.0), oversample=3).collect()
    assert len(peaks) == 4
    for r in peaks:
        own = whole[(whole["star"] == r["star"]) & (whole["band"] == r["band"])]
        best = own.loc[own["power"].idxmax()]
        assert r["power"] == pytest.approx(best["power"]) and 1 / r["period"] == pytest.approx(best["frequency"])
    assert band_peaks(df.limit(0), "star", "t", "v").count() == 0


def test_keys_of_many_points_give_the_same(spark, monkeypatch):
    df = points(spark, {"a": 0.4, "b": 2.2, "c": 0.0731}, n=40)
    own = {(r["star"], r["band"], round(r["frequency"], 9)): r["power"] for r in spectrum(df, "star", "t", "v", bands=(0.06, 0.5, 4.0), oversample=40).collect()}
    monkeypatch.setattr(periods, "MOST_POINTS", 10)
    other = {(r["star"], r["band"], round(r["frequency"], 9)): r["power"] for r in spectrum(df, "star", "t", "v", bands=(0.06, 0.5, 4.0), oversample=40).collect()}
    assert own.keys() == other.keys() and len(own) > 1000
    top = max(own.values())
    assert max(abs(own[k] - other[k]) for k in own) < 2e-5 * top


def test_points_are_shuffled_and_not_blocks_of_frequencies(spark):
    df = points(spark, {"a": 0.7}, n=20)
    plan = band_peaks(df, "star", "t", "v", oversample=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "yc7" not in plan  # no sums of moments by block for keys of few points
