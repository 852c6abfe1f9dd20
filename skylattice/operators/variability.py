"""Which stars vary: frame normalisation, robust scatter, sign changes, and the envelope of quiet stars.

All inputs are long tables: catalog_id, frame_id, flux and flags. Heavy statistics are windows by star or by frame, so a
night of any size needs one shuffle by each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import at_least
from skylattice.functions.robust import K, sigma_strict, weighted_line
from skylattice.operators.shared import cut, exact_quantiles, known


@dataclass(frozen=True)
class VariabilityConfig:
    min_frames: int = 30
    min_frames_frac: float = 0.50
    sigma_clip: float = 5.0
    percentile: float = 0.85
    slope_floor: float = 0.02
    sigma_threshold: float = 3.0
    smoothness_max: float = 0.80
    mag_limit: float = 14.5
    min_rms_pct: float = 1.5
    min_amplitude_mag: float = 0.01
    clip_ratio_min: float = 0.80
    vdi_z_threshold: float = 3.0
    min_points: int = 20
    min_field: int = 20


def flux_cells(measurements: DataFrame) -> DataFrame:
    """One flux for each star and frame, the median of duplicates: catalog_id, frame_id, flux."""
    return measurements.groupBy("catalog_id", "frame_id").agg(F.median("flux").alias("flux"))


def normalise_frames(cells: DataFrame, usable: str | None = None) -> DataFrame:
    """flux over the median of usable stars in its frame, where that is positive."""
    own = F.when(F.col(usable), F.col("flux")) if usable else F.col("flux")
    med = F.median(own).over(Window.partitionBy("frame_id"))
    return cells.withColumn("_m", med).withColumn("flux", F.when(F.col("_m") > 0, F.col("flux") / F.col("_m")).otherwise(F.col("flux"))).drop("_m")


def covered(cells: DataFrame, frac: float) -> DataFrame:
    """Stars measured in at least max(1, ceil(frac * frames)) frames."""
    frames = cells.select(F.count_distinct("frame_id").alias("_f"))
    own = cells.withColumn("n_frames", F.count("flux").over(Window.partitionBy("catalog_id")))
    return own.crossJoin(F.broadcast(frames)).where(F.col("n_frames") >= F.greatest(F.lit(1), F.ceil(F.lit(frac) * F.col("_f")))).drop("_f")


def first_metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each star the first value of each column, by frame, that isn't NULL."""
    return rows.groupBy("catalog_id").agg(*[F.expr(f"min_by({c}, frame_id) filter (where {c} is not null)").alias(c) for c in columns])


def rms_variability(cells: DataFrame, cfg: VariabilityConfig) -> DataFrame:
    """catalog_id, n_frames, n_clean, clip_ratio, mean_norm, rms_pct, amplitude_mag, smoothness of normalised cells.

    Values within sigma_clip robust deviations of the median count; without a deviation all do. Stars with too few points
    before or after have NULL statistics.
    """
    w = Window.partitionBy("catalog_id")
    t = cells.where(F.col("flux").isNotNull()).withColumn("_n", F.count("flux").over(w)).withColumn("_med", F.median("flux").over(w))
    t = t.withColumn("_s", sigma_strict(F.median(F.abs(F.col("flux") - F.col("_med"))).over(w), F.col("_n")))
    t = t.withColumn("_in", F.coalesce(F.abs(F.col("flux") - F.col("_med")) < cfg.sigma_clip * F.col("_s"), F.lit(True)))
    inside = t.where("_in").withColumn("_step", F.col("flux") - F.lag("flux").over(w.orderBy("frame_id"))).withColumn("_mag", F.when(F.col("flux") > 0, -2.5 * F.log10("flux")))
    out = inside.groupBy("catalog_id").agg(
        F.max("_n").alias("n_frames"), F.count("flux").alias("n_clean"), F.avg("flux").alias("mean_norm"), F.stddev_pop("flux").alias("_std"), F.stddev_pop("_step").alias("_steps"),
        F.count("_mag").alias("_mags"), F.percentile("_mag", 0.95).alias("_high"), F.percentile("_mag", 0.05).alias("_low"),
    )
    enough = (F.col("n_frames") >= cfg.min_points) & (F.col("n_clean") >= cfg.min_points)
    return out.select(
        "catalog_id", "n_frames", "n_clean", (F.col("n_clean") / F.col("n_frames")).alias("clip_ratio"), "mean_norm",
        F.when(enough & (F.col("mean_norm") != 0), 100 * F.col("_std") / F.col("mean_norm")).alias("rms_pct"),
        F.when(F.col("_mags") >= 10, F.col("_high") - F.col("_low")).alias("amplitude_mag"),
        F.when(F.col("_std") > 0, F.col("_steps") / F.sqrt(F.lit(2.0)) / F.col("_std")).alias("smoothness"),
    )


def envelope(stars: DataFrame, cfg: VariabilityConfig, weight: str | None = None) -> DataFrame:
    """stars (catalog_id, mag, rms_pct, field) with expected_log, sigma, score and envelope.

    Field stars with a magnitude and a positive rms_pct are the pool; where there are min_field of them, those below the
    given percentile stay. With min_field left, they give a line log10(rms) = a + b mag, slope floored, and sigma comes from
    their distances; with fewer, the expectation is their median rms and sigma the spread of their logs. `weight` names a
    column of weights that multiply distances. The stars are kept once, at once; medians are exact, by refined histograms.
    """
    mag = F.when(~F.isnan("mag"), F.col("mag"))
    t = cut(stars.withColumn("_pool", F.coalesce(F.col("field"), F.lit(False)) & mag.isNotNull() & F.coalesce(F.col("rms_pct") > 0, F.lit(False))).withColumn("_log", F.when(F.col("rms_pct") > 0, F.log10(F.greatest(F.col("rms_pct"), F.lit(1e-6))))))
    middle = lambda x: exact_quantiles(t, {"x": (x, 0.5)})["x"]
    many = t.where("_pool").count() >= cfg.min_field
    quiet = F.col("_pool") & (F.col("rms_pct") < known(exact_quantiles(t, {"p": (F.when(F.col("_pool"), F.col("rms_pct")), cfg.percentile)})["p"])) if many else F.col("_pool")
    x, y = F.when(quiet, mag), F.when(quiet, F.col("_log"))
    w = F.coalesce(F.pow(F.col(weight), 2), F.lit(1.0)) if weight else F.lit(1.0)  # a weight multiplies distances
    a, b = weighted_line(x, y, F.when(quiet, w))
    line = t.agg(F.count(y).alias("n"), a.alias("a"), b.alias("b")).first()  # one row
    if line["n"] >= cfg.min_field and line["a"] is not None:
        expected = known(line["a"]) + known(max(line["b"], cfg.slope_floor)) * mag
        residual = F.when(quiet, F.col("_log") - expected)
    else:
        expected, residual = F.log10(at_least(known(middle(F.when(quiet, F.col("rms_pct")))), 1e-6)), y
    sigma = sigma_strict(known(middle(F.abs(residual - known(middle(residual))))), F.lit(line["n"]))
    t = t.withColumn("expected_log", expected).withColumn("sigma", sigma)
    return t.select(*stars.columns, "expected_log", "sigma", F.when(F.col("sigma") > 0, (F.col("_log") - F.col("expected_log")) / F.col("sigma")).alias("score"), F.pow(F.lit(10.0), F.col("expected_log") + cfg.sigma_threshold * F.coalesce("sigma", F.lit(0.0))).alias("envelope"))


def candidates(stars: DataFrame, cfg: VariabilityConfig) -> DataFrame:
    """stars with is_candidate: the conjunction of all limits, NULL counting as false; highest score first."""
    ok = (
        (F.col("rms_pct") > at_least(F.col("envelope"), cfg.min_rms_pct)) & (F.col("clip_ratio") >= cfg.clip_ratio_min) & (F.col("mean_norm") > 0.001) & (F.col("smoothness") < cfg.smoothness_max)
        & (F.col("amplitude_mag") >= cfg.min_amplitude_mag) & (F.col("mag") <= cfg.mag_limit) & (F.col("n_frames") >= cfg.min_frames)
    )
    return stars.withColumn("is_candidate", F.coalesce(ok, F.lit(False))).orderBy(F.desc_nulls_last("score"))


def sign_changes(cells: DataFrame, cfg: VariabilityConfig) -> DataFrame:
    """catalog_id, n_used, vdi, vdi_z, vdi_candidate: sign changes around the median over sqrt(n), against the field."""
    w = Window.partitionBy("catalog_id")
    t = cells.where(F.col("flux").isNotNull()).withColumn("_n", F.count("flux").over(w)).withColumn("_s", F.signum(F.col("flux") - F.median("flux").over(w)))
    t = t.where(F.col("_n") >= cfg.min_frames)
    steps = t.where("_s <> 0").withColumn("_turn", (F.col("_s") != F.lag("_s").over(w.orderBy("frame_id"))).cast("int"))
    one = t.groupBy("catalog_id").agg(F.max("_n").alias("n_used")).join(steps.groupBy("catalog_id").agg(F.sum("_turn").alias("_turns"), F.count("*").alias("_signs")), "catalog_id", "left")
    one = cut(one.select("catalog_id", "n_used", F.when(F.col("_signs") >= 2, F.col("_turns") / F.sqrt("n_used")).otherwise(0.0).alias("vdi")))
    med = exact_quantiles(one, {"m": (F.col("vdi"), 0.5)})["m"]
    dev = exact_quantiles(one, {"d": (F.abs(F.col("vdi") - known(med)), 0.5)})["d"]
    z = F.when(known(dev) > 0, (F.col("vdi") - known(med)) / (known(dev) / K))
    return one.select("catalog_id", "n_used", "vdi", z.alias("vdi_z"), F.coalesce(z < -cfg.vdi_z_threshold, F.lit(False)).alias("vdi_candidate"))


def combined(rms: DataFrame, vdi: DataFrame) -> DataFrame:
    """Both methods side by side: rms rows, the flags of each, either, and which method found a star."""
    both = rms.join(vdi.select("catalog_id", "vdi", "vdi_z", "vdi_candidate"), "catalog_id", "left").withColumn("vdi_candidate", F.coalesce("vdi_candidate", F.lit(False)))
    method = F.when(F.col("is_candidate") & F.col("vdi_candidate"), "both").when(F.col("is_candidate"), "rms").when(F.col("vdi_candidate"), "vdi").otherwise("none")
    return both.withColumn("combined", F.col("is_candidate") | F.col("vdi_candidate")).withColumn("method", method)
