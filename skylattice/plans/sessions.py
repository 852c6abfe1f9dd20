"""Whole sessions: operators put together as an observer runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators import comparison, photometry, variability
from skylattice.operators.shared import cut
from skylattice.operators.variability import VariabilityConfig


def variability_session(measurements: DataFrame, catalogue: DataFrame, cfg: VariabilityConfig = VariabilityConfig()) -> DataFrame:  # noqa: B008
    """From raw measurements and a catalogue (catalog_id, mag, field, known_variable) to stars with all flags.

    Cells, frame normalisation and coverage; robust scatter against the envelope of quiet stars; sign changes; both
    methods together, known variables taken out of what is new.
    """
    cells = cut(variability.covered(variability.normalise_frames(variability.flux_cells(measurements)), cfg.min_frames_frac))
    rms = variability.rms_variability(cells, cfg).join(catalogue, "catalog_id", "left")
    found = variability.candidates(variability.envelope(rms, cfg), cfg)
    out = variability.combined(found, variability.sign_changes(cells, cfg))
    return out.withColumn("is_new", F.col("combined") & ~F.coalesce("known_variable", F.lit(False))).orderBy(F.desc_nulls_last("score"), "catalog_id")


def photometry_session(cells: DataFrame, catalogue: DataFrame, pairs: DataFrame) -> DataFrame:
    """Light curves of targets: differential magnitudes, airmass term, outlier flags, and a summary for each target.

    cells: catalog_id, frame_id, mag, err, airmass; catalogue: catalog_id, mag; pairs: target_id, comp_id.
    """
    cells, pairs = cut(cells), cut(pairs)
    comps = pairs.join(cells.withColumnRenamed("catalog_id", "comp_id"), "comp_id").join(catalogue.select(F.col("catalog_id").alias("comp_id"), F.col("mag").alias("catalog_mag")), "comp_id")
    targets = cells.join(pairs.select(F.col("target_id").alias("catalog_id")).distinct(), "catalog_id", "left_semi").withColumnRenamed("catalog_id", "target_id").select("target_id", "frame_id", "mag", "err", "airmass")
    curve = photometry.differential(targets.drop("airmass"), comps.select("target_id", "frame_id", "mag", "err", "catalog_mag")).join(targets.select("target_id", "frame_id", "airmass"), ["target_id", "frame_id"])
    curve = cut(curve.select("target_id", "frame_id", F.col("calibrated").alias("mag"), "airmass"))
    flagged = photometry.outlier_flags(curve, "target_id", "mag", F.lit(False))
    flat = photometry.airmass_detrended(flagged, ["target_id"]).select("target_id", "frame_id", F.col("detrended").alias("mag"), "am_slope")
    again = photometry.outlier_flags(flat, "target_id", "mag", F.lit(False))
    slopes = again.groupBy("target_id").agg(F.first("am_slope", ignorenulls=True).alias("am_slope"))
    return photometry.summary(again).join(slopes, "target_id")


def suspected_session(cells: DataFrame, catalogue: DataFrame, active: DataFrame) -> DataFrame:
    """Stars outside the active set whose scatter, after normalising by brightness and detrending, stands out."""
    from skylattice.functions.robust import quadratic_trend

    rows = cells.join(active, "catalog_id", "left_anti").join(catalogue.select("catalog_id", F.col("mag").alias("_mag")), "catalog_id").select("catalog_id", "frame_id", "flux", F.col("_mag").alias("mag"))
    flat = quadratic_trend(comparison.bin_normalised(rows), "rel", ["catalog_id"], "frame_id")
    return comparison.suspects(comparison.relative_rms(flat, "detrended"))
