"""Settings from a JSON file: defaults where it says nothing or nonsense, limits where it goes too far."""

from __future__ import annotations

import json
import math
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession

from skylattice.operators.variability import VariabilityConfig

# The setting of each field, its lowest and highest value.
LIMITS = {
    "min_frames": ("variability_min_frames", 1, math.inf),
    "min_frames_frac": ("variability_min_frames_frac", 0.05, 0.99),
    "sigma_clip": ("variability_sigma_clip", 1.0, 20.0),
    "percentile": ("variability_p85_filter", 50, 99),
    "slope_floor": ("variability_slope_floor", 0.0, 1.0),
    "sigma_threshold": ("variability_sigma_threshold", 0.5, 20.0),
    "smoothness_max": ("variability_smoothness_max", 0.05, 1.0),
    "mag_limit": ("variability_mag_limit", 0.0, 30.0),
    "min_rms_pct": ("variability_min_rms_pct", 0.0, 100.0),
    "min_amplitude_mag": ("variability_min_amplitude_mag", 0.0, 10.0),
    "clip_ratio_min": ("variability_clip_ratio_min", 0.0, 1.0),
    "vdi_z_threshold": ("variability_vdi_z_threshold", 0.0, 50.0),
    "min_points": ("variability_min_points_rms", 5, 10_000),
}
WHOLE = ("min_frames", "min_points")

# Other settings, what each is where nothing sensible is given, and its lowest and highest value.
DEFAULTS = {
    "masterdark_validity_days": (60, -math.inf, math.inf),
    "masterflat_validity_days": (200, -math.inf, math.inf),
    "calibration_library_native_binning": (1, 1, 16),
    "vsx_variable_targets_mag_limit": (13.0, -math.inf, math.inf),
    "catalog_query_max_rows": (15_000, 1000, 500_000),
    "qc_max_hfr": (5.0, -math.inf, math.inf),
    "qc_min_stars": (10, 0, math.inf),
    "aperture_fwhm_factor": (2.75, 0.5, 6.0),
    "annulus_inner_fwhm": (5.5, -math.inf, math.inf),
    "annulus_outer_fwhm": (10.5, -math.inf, math.inf),
    "nonlinearity_peak_percentile": (20.0, 0.0, 50.0),
    "nonlinearity_fwhm_ratio": (1.25, 1.01, 3.0),
    "phase01_comparison_max_dist_deg": (1.0, 0.05, 10.0),
    "phase01_comparison_max_mag_diff": (0.25, 0.05, 5.0),
    "phase01_comparison_mag_bright_threshold": (12.0, 6.0, 18.0),
    "phase01_comparison_max_mag_diff_bright_floor": (1.25, 0.0, 4.0),
    "phase01_comparison_max_bv_diff": (0.15, 0.02, 3.0),
    "phase01_comparison_n_comp_min": (3, 2, 12),
    "phase01_comparison_n_comp_max": (7, 3, 20),
    "phase01_comparison_max_comp_rms": (0.05, 0.01, 0.5),
    "phase01_comparison_min_dist_arcsec": (60.0, 0.0, 600.0),
    "phase01_comparison_min_frames_frac": (0.3, 0.05, 0.95),
    "phase01_chip_interior_margin_px": (100, 0, 2000),
}


def read_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """The JSON object in a file, through Spark's readers; {} where it isn't one."""
    text = spark.read.text(path, wholetext=True).first()
    try:
        found = json.loads(text[0]) if text else {}
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def number(value: Any, default: float, low: float, high: float) -> float:
    """value within low and high, the default where it is no finite number; whole where the default is."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    if not math.isfinite(x):
        return default
    x = max(low, min(high, x))
    return int(x) if isinstance(default, int) else x


def photometry_settings(settings: dict[str, Any]) -> dict[str, float]:
    """All settings of DEFAULTS as given, within their limits. An outer annulus that doesn't lie beyond the inner one begins
    one width further out; there are never fewer comparison stars at most than at least."""
    out = {key: number(settings.get(key), *rule) for key, rule in DEFAULTS.items()}
    if out["annulus_outer_fwhm"] <= out["annulus_inner_fwhm"]:
        out["annulus_outer_fwhm"] = out["annulus_inner_fwhm"] + 1.0
    out["phase01_comparison_n_comp_max"] = max(out["phase01_comparison_n_comp_max"], out["phase01_comparison_n_comp_min"])
    return out


def variability_config(settings: dict[str, Any]) -> VariabilityConfig:
    """The configuration that settings give. A percentile is given in hundredths."""
    cfg, found = VariabilityConfig(), {}
    for field, (key, low, high) in LIMITS.items():
        try:
            value = float(settings[key])
        except (KeyError, TypeError, ValueError):
            continue
        if math.isfinite(value):
            value = max(low, min(high, value))
            found[field] = int(value) if field in WHOLE else value / 100 if field == "percentile" else value
    return replace(cfg, **found)
