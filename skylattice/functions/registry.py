"""The Column functions under names that SQL can call, and a table function for grids of sky strips.

They stay expressions: a temporary SQL function is registered for each, so Catalyst inlines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.operators.spatial import strips

# Formulas under their SQL names and arguments.
FUNCTIONS = {
    "sky_magnitude": ("flux double", "double", "case when flux > 0 then -2.5 * log10(flux) end"),
    "sky_flux": ("mag double", "double", "pow(10.0D, -0.4D * mag)"),
    "sky_colour_bv": ("bp_rp double", "double", "case when bp_rp between 0.1 and 2.5 then 0.0850D + 0.9447D * bp_rp - 0.1019D * bp_rp * bp_rp end"),
    "sky_plate_scale": ("pixel_um double, focal_mm double", "double", "case when focal_mm > 0 then 206.265D * pixel_um / focal_mm end"),
    "sky_separation": (
        "ra1 double, dec1 double, ra2 double, dec2 double", "double",
        "case when ra1 + dec1 + ra2 + dec2 is not null then 2 * degrees(asin(sqrt(least(1.0D, pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2))))) end",
    ),
    "sky_phase": ("jd double, epoch double, period double", "double", "case when period > 0 then pmod((jd - epoch) / period, 1.0D) end"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL in this session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {body}")
    return sorted(FUNCTIONS)


def strip_grid(spark: SparkSession, ra_step: float, dec_step: float, dec_min: float = -90.0, dec_max: float = 90.0) -> DataFrame:
    return spark.sql(strips(ra_step, dec_step, dec_min, dec_max))
