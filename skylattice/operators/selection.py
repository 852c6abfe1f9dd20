"""Which stars and rows count: masks for comparison candidates, chip edges, votes over frames, tri-state flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.expr import clean, flag
from skylattice.operators.spatial import blended


def explicit_true(x: Column) -> Column:
    """Says yes; NULL, empty and anything else don't."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def explicit_false(x: Column) -> Column:
    """Says no; NULL, empty and anything else don't."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("false", "0", "no"), F.lit(False))


def _flag(df: DataFrame, name: str, missing: bool) -> Column:
    return flag(F.col(name)) if name in df.columns else F.lit(missing)


def comparison_candidates(stars: DataFrame, *, max_distance_deg: float, min_distance_arcsec: float = 0.0, target: Column | None = None, no_doubles: bool = True, no_extended: bool = True) -> DataFrame:
    """Stars (catalog_id, distance_deg, flags) that may be compared with a target.

    Near enough, usable, not saturated (nor likely so), noisy or known as variable, not the target itself, not nearer than
    the minimum; no double stars and no quasars or galaxies where the catalogue says so. A flag that the table lacks
    excludes nothing.
    """
    keep = (F.col("distance_deg") <= max_distance_deg) & _flag(stars, "is_usable", True)
    for name in ("is_saturated", "is_noisy", "vsx_known_variable", "likely_saturated"):
        keep = keep & ~_flag(stars, name, False)
    if target is not None:
        keep = keep & (F.col("catalog_id") != target)
    if math.isfinite(min_distance_arcsec) and min_distance_arcsec > 0:
        keep = keep & (F.col("distance_deg") >= min_distance_arcsec / 3600.0)
    for name, wanted in (("gaia_nss", no_doubles), ("gaia_qso", no_extended), ("gaia_gal", no_extended)):
        if wanted:
            keep = keep & ~_flag(stars, name, False)
    return stars.where(F.coalesce(keep, F.lit(False)))


def detections_rescued(stars: DataFrame, *, max_distance_deg: float) -> Column:
    """Whether a star without a catalogue entry may be compared all the same: bright enough, unsaturated, not variable."""
    own = F.col("catalog_id").startswith("DET") & (F.col("distance_deg") <= max_distance_deg) & _flag(stars, "snr50_ok", False)
    for name in ("is_saturated", "likely_saturated", "vsx_known_variable"):
        own = own & ~_flag(stars, name, False)
    return F.coalesce(own, F.lit(False))


def chip_interior(x: Column, y: Column, width: Column, height: Column, margin: float) -> Column:
    return F.coalesce(x.between(F.lit(margin), width - margin) & y.between(F.lit(margin), height - margin), F.lit(False))


def field_of_view(x: Column, y: Column, width: Column, height: Column, margins: tuple[float, float, float, float] = (-500.0, 500.0, -400.0, 400.0)) -> Column:
    """Within the chip widened by margins: left, right, bottom, top."""
    left, right, bottom, top = margins
    return F.coalesce(x.between(F.lit(left), width + right) & y.between(F.lit(bottom), height + top), F.lit(False))


def effective_frame(tables: list[DataFrame], *, width: int, height: int, margin: int) -> DataFrame:
    """One row (width, height): the nominal chip, or as much more as the largest x and y of the tables need."""
    tops = None
    for t in tables:
        own = t.select(F.max(clean(F.col("x").cast("double"))).alias("x"), F.max(clean(F.col("y").cast("double"))).alias("y"))
        tops = own if tops is None else tops.unionByName(own)
    need = lambda c, least: F.greatest(F.lit(least), F.coalesce(F.ceil(F.max(c)) + margin + 2, F.lit(least))).cast("int")
    known = F.max("x").isNotNull() & F.max("y").isNotNull()
    return tops.agg(F.when(known, need("x", width)).otherwise(width).alias("width"), F.when(known, need("y", height)).otherwise(height).alias("height"))


def annulus_on_chip(x: Column, y: Column, radius: Column, width: Column, height: Column, default: float = 30.0) -> Column:
    """Whether a sky annulus lies on the chip; NULL without a position. An unknown or useless radius is the default."""
    r = F.when(clean(radius) > 0, radius).otherwise(default)
    return (x - r >= 0) & (x + r <= width) & (y - r >= 0) & (y + r <= height)


def without_edge_rows(rows: DataFrame, *, width: float, height: float) -> DataFrame:
    """rows (x, y, sky_annulus_r_out_px, mag_inst, flag): off-chip annuli lose their magnitude and are flagged edge_fail."""
    off = F.coalesce(~annulus_on_chip(F.col("x"), F.col("y"), F.col("sky_annulus_r_out_px"), F.lit(width), F.lit(height)), F.lit(False))
    return rows.withColumn("edge_fail", off).withColumn("mag_inst", F.when(~off, F.col("mag_inst"))).withColumn("flag", F.when(off, "edge_fail").otherwise(F.col("flag")))


def edge_vote(rows: DataFrame, *, width: float, height: float, least: int = 10, share: float = 0.10) -> DataFrame:
    """Stars whose annulus is off the chip in more than `share` of their frames, of at least `least`."""
    off = F.coalesce(~annulus_on_chip(F.col("x"), F.col("y"), F.col("sky_annulus_r_out_px"), F.lit(width), F.lit(height)), F.lit(False))
    t = rows.groupBy("catalog_id").agg(F.count("*").alias("n_frames"), F.count_if(off).alias("n_edge"))
    return t.where((F.col("n_frames") >= least) & (F.col("n_edge") / F.col("n_frames") > share))


def edge_safe(x: Column, y: Column, width: float | None, height: float | None, fwhm: float | None, *, interior: float = 100.0, annulus_fwhm: float = 9.0) -> Column:
    """Far enough from the edge: the interior margin, or the annulus in units of the frame's width where that is more."""
    margin = max(interior, annulus_fwhm * fwhm + 5.0) if fwhm is not None and math.isfinite(fwhm) else interior
    placed = clean(x).isNotNull() & clean(y).isNotNull()
    if not width or not height:
        return placed
    return placed & chip_interior(x, y, F.lit(float(width)), F.lit(float(height)), margin)


def profile_stars(stars: DataFrame) -> DataFrame:
    """Stars fit to model the point spread: known not to vary or saturate, measured well, and not excluded otherwise."""
    keep = explicit_false(F.col("catalog_known_variable")) & explicit_false(F.col("likely_saturated")) & explicit_true(F.col("photometry_ok"))
    for name, wanted in (("is_saturated", False), ("is_noisy", False), ("is_usable", True)):
        if name in stars.columns:
            keep = keep & (flag(F.col(name)) if wanted else ~flag(F.col(name)))
    return stars.where(keep & F.col("catalog_id").isNotNull() & (F.trim(F.col("catalog_id").cast("string")) != ""))


def safe_comparisons(sources: DataFrame, allowed: DataFrame) -> DataFrame:
    """Stored sources that are safe to compare, not excluded, placed, and among the allowed ids."""
    t = sources.where((F.coalesce("is_safe_comp", F.lit(0)) == 1) & (F.trim(F.coalesce("exclusion_reason", F.lit(""))) == "") & F.col("x").isNotNull() & F.col("y").isNotNull())
    return t.join(allowed.select("catalog_id").distinct(), "catalog_id", "left_semi")


def profile_comparisons(comps: DataFrame, variables: DataFrame, *, max_peak: float = 40_000.0, separation: float = 9.6) -> DataFrame:
    """Comparison stars for profile photometry: usable, no target themselves, not too bright, none nearer than separation."""
    t = comps.where(flag(F.col("is_usable"))) if "is_usable" in comps.columns else comps
    t = t.join(variables.select("catalog_id").distinct(), "catalog_id", "left_anti").where(clean(F.col("peak")).isNull() | (F.col("peak") < max_peak))
    return blended(t, "catalog_id", separation).where("not is_blended").drop("is_blended")


def reportable_fit(role: Column, converged: Column, flux: Column, chi2: Column, *, variable_cap: float = 1000.0, comparison_cap: float = 20.0) -> Column:
    """A profile fit that a report counts: converged, with flux, and chi square below the cap of the star's role."""
    cap = F.when(F.upper(F.trim(role)) == "VAR", variable_cap).otherwise(comparison_cap)
    return F.coalesce(flag(converged) & (clean(flux) > 0) & (clean(chi2) < cap), F.lit(False))


def fit_failure(x: Column, y: Column, width: float, height: float, half: int, peak: Column, limit: Column, share: float) -> Column:
    """Why a fit failed: no position, at the edge, near saturation, both, or something else."""
    edge = (F.bround(x) < half) | (F.bround(y) < half) | (F.bround(x) >= width - half) | (F.bround(y) >= height - half)
    bright = (clean(limit) > 0) & (clean(peak) > share * limit)
    text = F.concat_ws(", ", F.when(edge, "edge"), F.when(bright, "near saturation"))
    return F.when(clean(x).isNull() | clean(y).isNull(), "no position").when(text == "", "blend or mismatch").otherwise(text)


def zone_flag(zone: Column, saturated: Column) -> Column:
    """A star's zone; without one, saturated where the flag says so, else unknown."""
    z = F.lower(F.trim(F.coalesce(zone, F.lit(""))))
    return F.when(z.isin("linear", "noisy1", "noisy2", "noisy3", "saturated"), z).when(flag(saturated), "saturated").when(z == "", "unknown").otherwise(z)


def plausible_suspects(rows: DataFrame, zones: str = r"^[A-Za-z0-9_ -]*$") -> DataFrame:
    """Rows of a suspects table that can be real: an id that isn't the header, rms and counts in range, a plain zone."""
    t = F.trim("catalog_id")
    keep = (t != "") & ~F.lower(t).isin("catalog_id", "nan", "none") & (F.col("rms") > 0) & (F.col("rms") < 500) & F.col("n_frames").between(1, 500_000) & F.coalesce(F.col("zone"), F.lit("")).rlike(zones)
    return rows.where(F.coalesce(keep, F.lit(False)))


def nonlinear_stars(rows: DataFrame, *, top_percent: float = 20.0, ratio: float = 1.25, bad_columns: Column | None = None) -> DataFrame:
    """rows (frame_id, x, peak_max_adu, fwhm, photometry_ok) with likely_nonlinear, on_bad_column and photometry_ok anew.

    A star is likely beyond the linear range when its peak is among the frame's highest and its width is over `ratio` times
    the frame's median. Bad columns (array) take the stars whose place rounds to one of them.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("frame_id")
    limit = F.percentile(clean(F.col("peak_max_adu")), 1 - top_percent / 100).over(w)
    middle = F.median(clean(F.col("fwhm"))).over(w)
    wide = (clean(F.col("peak_max_adu")) >= limit) & (middle > 0) & (clean(F.col("fwhm")) > ratio * middle)
    bad = F.array_contains(bad_columns, F.bround(clean(F.col("x"))).cast("int")) if bad_columns is not None else F.lit(False)
    t = rows.withColumn("likely_nonlinear", F.coalesce(wide, F.lit(False))).withColumn("on_bad_column", F.coalesce(bad, F.lit(False)))
    return t.withColumn("photometry_ok", F.coalesce(F.col("photometry_ok"), F.lit(True)) & ~F.col("likely_nonlinear") & ~F.col("on_bad_column"))
