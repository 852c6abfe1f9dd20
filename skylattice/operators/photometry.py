"""Calibrated light curves: ensembles, zero points, colour and airmass terms, outliers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import at_least
from skylattice.functions.robust import sigma_floor
from skylattice.operators.shared import numbered

TARGET_FRAME = ["target_id", "frame_id"]


def ensemble_magnitude(comps: DataFrame) -> DataFrame:
    """target_id, frame_id, n_comp, ensemble_mag, scatter: the magnitude of the comparison stars' light together.

    comps: target_id, frame_id, mag (one row for each comparison star measured).
    """
    return comps.where(F.col("mag").isNotNull()).groupBy(*TARGET_FRAME).agg(F.count("*").alias("n_comp"), (-2.5 * F.log10(F.sum(F.pow(F.lit(10.0), -0.4 * F.col("mag"))))).alias("ensemble_mag"), F.stddev_pop("mag").alias("scatter"))


def zero_points(comps: DataFrame, rms: str = "comp_rms") -> DataFrame:
    """target_id, frame_id, zero_point: catalogue minus instrumental, weighted by 1 / rms² over stars with a usable rms;
    the median where there is none."""
    z = F.col("catalog_mag") - F.col("mag")
    w = F.when((F.col(rms) > 1e-6) & z.isNotNull(), 1 / (F.col(rms) * F.col(rms)))
    return comps.groupBy(*TARGET_FRAME).agg(F.coalesce(F.sum(w * z) / F.sum(w), F.median(z)).alias("zero_point"))


def differential(targets: DataFrame, comps: DataFrame) -> DataFrame:
    """targets (target_id, frame_id, mag, err) with n_comp, zp, calibrated, calibrated_err from comps (… catalog_mag, mag, err).

    Zero points are weighted by 1 / err²; an error that isn't positive weighs 1. One comparison star gives its own
    difference and no error.
    """
    z = F.col("catalog_mag") - F.col("mag")
    w = F.when(F.col("err") > 0, 1 / (F.col("err") * F.col("err"))).otherwise(1.0)
    used = comps.where(z.isNotNull()).withColumn("_z", z).withColumn("_w", w)
    s = used.groupBy(*TARGET_FRAME).agg(F.count("*").alias("n_comp"), F.sum(F.col("_w") * F.col("_z")).alias("_wz"), F.sum("_w").alias("_sw"), F.avg("_z").alias("_avg"), F.sum(F.pow(F.col("_w") * F.coalesce("err", F.lit(0.0)), 2)).alias("_we"))
    t = targets.join(s, TARGET_FRAME)
    zp = F.when(F.col("n_comp") == 1, F.col("_avg")).otherwise(F.col("_wz") / F.col("_sw"))
    zp_err2 = F.when(F.col("n_comp") == 1, 0.0).otherwise(F.col("_we") / (F.col("_sw") * F.col("_sw")))
    return t.select(*targets.columns, "n_comp", zp.alias("zp"), (F.col("mag") + zp).alias("calibrated"), F.sqrt(F.pow("err", 2) + zp_err2).alias("calibrated_err"))


def colour_term(comps: DataFrame, group: list[str], *, least_points: int = 5, least_stars: int = 5, k: float = 3.0) -> DataFrame:
    """group, n, c1, c1_err, colour_mid: slope of median (catalogue - instrumental) over colour, after one clip at k."""
    star = comps.withColumn("_y", F.col("catalog_mag") - F.col("mag")).groupBy(*group, "catalog_id").agg(F.count("_y").alias("_k"), F.median("_y").alias("y"), F.first("bp_rp").alias("bp_rp")).where((F.col("_k") >= least_points) & F.col("bp_rp").isNotNull())
    w = Window.partitionBy(*group)
    t = star.withColumn("colour_mid", F.median("bp_rp").over(w)).withColumn("x", F.col("bp_rp") - F.col("colour_mid"))
    t = t.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least_stars)
    t = t.withColumn("_r", F.col("y") - F.regr_intercept("y", "x").over(w) - F.regr_slope("y", "x").over(w) * F.col("x"))
    t = t.withColumn("_m", F.median("_r").over(w)).withColumn("_sd", F.stddev_pop("_r").over(w))
    t = t.withColumn("_s", sigma_floor(F.median(F.abs(F.col("_r") - F.col("_m"))).over(w), F.col("_sd"))).where(F.abs("_r") <= k * F.col("_s"))
    fit = t.groupBy(*group).agg(F.count("*").alias("n"), F.first("colour_mid").alias("colour_mid"), F.regr_slope("y", "x").alias("c1"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.regr_sxy("y", "x").alias("_sxy"))
    sse = at_least(F.col("_syy") - F.col("c1") * F.col("_sxy"), 0.0)
    return fit.select(*group, "n", "c1", F.when((F.col("n") > 2) & (F.col("_sxx") > 0), F.sqrt(sse / (F.col("n") - 2) / F.col("_sxx"))).alias("c1_err"), "colour_mid")


def colour_gate(n: Column, c1: Column, c1_err: Column, filter_name: Column, *, least: int = 10) -> Column:
    """Whether a colour term is applied: a broad-band filter, enough stars, a slope that is there and well known."""
    name = F.lower(F.trim(F.coalesce(filter_name, F.lit(""))))
    return F.coalesce(name.isin("b", "v", "r", "i", "g", "u", "z", "bp", "rp") & (n >= least) & (F.abs(c1) > 1e-6) & (c1_err / F.abs(c1) <= 0.5), F.lit(False))


def airmass_detrended(curve: DataFrame, keys: list[str], *, least: int = 10, low: float = 0.0, high: float = 1.5) -> DataFrame:
    """curve (…, mag, airmass, flag) with am_slope, detrended by keys: a line over normal points, used if its slope is
    physical; mag - slope (X - median X)."""
    normal = (F.col("flag") == "normal") & F.col("mag").isNotNull() & F.col("airmass").isNotNull()
    x, y = F.when(normal, F.col("airmass")), F.when(normal, F.col("mag"))
    fit = curve.groupBy(*keys).agg(F.count(F.when(normal, 1)).alias("_n"), F.regr_slope(y, x).alias("_b"), F.median(x).alias("_x"))
    ok = (F.col("_n") >= least) & F.col("_b").between(low, high)
    t = curve.join(fit, keys)
    return t.select(*curve.columns, F.when(ok, F.col("_b")).alias("am_slope"), F.when(ok, F.col("mag") - F.col("_b") * (F.col("airmass") - F.col("_x"))).otherwise(F.col("mag")).alias("detrended"))


def outlier_flags(curve: DataFrame, key: str, value: str, saturated: Column, *, k: float = 3.0) -> DataFrame:
    """curve with flag: saturated, outlier_hi (bright), outlier_lo, normal, no_data; fewer than 3 values are all no_data."""
    w = Window.partitionBy(key)
    t = curve.withColumn("_sat", F.coalesce(saturated, F.lit(False))).withColumn("_v", F.when(~F.col("_sat"), F.col(value)))
    t = t.withColumn("_n", F.count("_v").over(w)).withColumn("_m", F.median("_v").over(w)).withColumn("_sd", F.stddev_pop("_v").over(w))
    t = t.withColumn("_s", sigma_floor(F.median(F.abs(F.col("_v") - F.col("_m"))).over(w), F.col("_sd")))
    flag = F.when(F.col("_n") < 3, "no_data").when(F.col("_sat"), "saturated").when(F.col(value).isNull(), "no_data").when(F.col(value) < F.col("_m") - k * F.col("_s"), "outlier_hi").when(F.col(value) > F.col("_m") + k * F.col("_s"), "outlier_lo").otherwise("normal")
    return t.select(*curve.columns, flag.alias("flag"))


def summary(curve: DataFrame, key: str = "target_id") -> DataFrame:
    """Counts by flag, scatter and median magnitude of each light curve (key, frame_id, mag, flag)."""
    normal = F.when(F.col("flag") == "normal", F.col("mag"))
    return curve.groupBy(key).agg(
        F.count("*").alias("n_frames"), F.count(F.when(F.col("flag").isin("outlier_hi", "outlier_lo"), 1)).alias("n_outliers"), F.count(F.when(F.col("flag") == "saturated", 1)).alias("n_saturated"),
        F.stddev_pop(normal).alias("lc_rms"), F.median(normal).alias("lc_median_mag"),
    )


def frame_order(rows: DataFrame) -> DataFrame:
    """rows with frame_seq: the place of the frame in the order of frame names."""
    return rows.join(numbered(rows.select("frame_id").distinct(), "frame_seq", ["frame_id"]), "frame_id")


def star_frame_grid(rows: DataFrame) -> DataFrame:
    """A row for every star and frame, measured or not: the matrix of one night, whose frames must fit in one task. Use it
    to export; the statistics here work on the rows there are."""
    frames = rows.agg(F.array_sort(F.collect_set("frame_id")).alias("_frames"))
    grid = rows.select("catalog_id").distinct().crossJoin(frames).select("catalog_id", F.explode("_frames").alias("frame_id"))
    return grid.join(rows, ["catalog_id", "frame_id"], "left")


def lomb_scargle(points: DataFrame, key: str, time: str, value: str, frequencies: list[float]) -> DataFrame:
    """key, frequency, power: the classical periodogram from sums over points, all frequencies at once."""
    import math

    w = Window.partitionBy(key)
    t = points.where(F.col(value).isNotNull()).withColumn("_y", F.col(value) - F.avg(value).over(w))
    t = t.withColumn("frequency", F.explode(F.array(*[F.lit(float(f)) for f in frequencies])))
    omega = 2 * math.pi * F.col("frequency")
    by = Window.partitionBy(key, "frequency")
    tau = F.atan2(F.sum(F.sin(2 * omega * F.col(time))).over(by), F.sum(F.cos(2 * omega * F.col(time))).over(by)) / (2 * omega)
    t = t.withColumn("_a", omega * (F.col(time) - tau))
    c, s = F.cos("_a"), F.sin("_a")
    power = (F.pow(F.sum(F.col("_y") * c), 2) / F.nullif(F.sum(c * c), F.lit(0.0)) + F.pow(F.sum(F.col("_y") * s), 2) / F.nullif(F.sum(s * s), F.lit(0.0))) / 2
    return t.groupBy(key, "frequency").agg(power.alias("power"))


def best_period(power: DataFrame, key: str) -> DataFrame:
    """key and period: of the strongest frequency of a periodogram (key, frequency, power), the lowest of equals."""
    best = power.where(F.col("power").isNotNull()).groupBy(key).agg(F.max_by("frequency", F.struct("power", -F.col("frequency"))).alias("_f"))
    return best.select(key, (1 / F.col("_f")).alias("period"))
