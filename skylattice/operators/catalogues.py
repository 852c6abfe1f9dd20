"""What a star catalogue adds to stars: rows by id, colours of stars that have none, and whose photometry is steadier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import clean, colour_bv, exact_id, ra_delta
from skylattice.operators.spatial import nearest_of


def colour_of(bp_rp: Column, bp_mag: Column, rp_mag: Column) -> Column:
    """A catalogue's own colour, else the difference of its two magnitudes."""
    return F.coalesce(clean(bp_rp), clean(bp_mag) - clean(rp_mag))


def rows_by_id(ids: DataFrame, catalogue: DataFrame, key: str = "source_id") -> DataFrame:
    """source_id (as exact digits), bp_rp and g_mag of the catalogue rows that ids names, each once.

    ids: a column `key` of texts or numbers as they come from files; what isn't a whole number names nothing. The names
    filter the catalogue as a semi-join, so neither side is collected.
    """
    named = ids.select(exact_id(F.col(key).cast("string")).try_cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    found = catalogue.join(named, key, "left_semi")
    return found.select(F.col(key).cast("string").alias(key), colour_of(F.col("bp_rp"), F.col("bp_mag"), F.col("rp_mag")).alias("bp_rp"), clean(F.col("g_mag")).alias("g_mag"))


def with_colours(stars: DataFrame, catalogue: DataFrame, key: str, *, radius_deg: float = 0.001, max_dmag: float = 1.0) -> DataFrame:
    """stars with bp_rp, b_v and colour_source: where a star has no colour, that of the nearest catalogue star in a box of
    radius_deg around it (in both coordinates, across 0 degrees) whose magnitude differs by less than max_dmag.

    stars: key, ra_deg, dec_deg, mag, bp_rp; catalogue: source_id, ra_deg, dec_deg, g_mag, bp_rp. A star without position or
    magnitude stays as it is; so does one whose nearest star has no colour itself. Of equally near ones the lower source_id
    counts. Runs at once.
    """
    lacking = stars.where(clean(F.col("bp_rp")).isNull() & clean(F.col("ra_deg")).isNotNull() & clean(F.col("dec_deg")).isNotNull() & clean(F.col("mag")).isNotNull()).select(key, "ra_deg", "dec_deg", "mag")
    offered = catalogue.where(clean(F.col("g_mag")).isNotNull() & clean(F.col("ra_deg")).isNotNull() & clean(F.col("dec_deg")).isNotNull()).select("source_id", "ra_deg", "dec_deg", "g_mag", clean(F.col("bp_rp")).alias("bp_rp"))
    # bands of magnitude as wide as the limit: a star's own, and of the catalogue the two beside it as well
    band = lambda c: F.floor(F.col(c) / (max_dmag * (1 + 1e-6)))
    lacking = lacking.withColumn("_band", band("mag"))
    offered = offered.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band("g_mag") + i)))
    inside = (F.abs(ra_delta(F.col("r_ra_deg"), F.col("l_ra_deg"))) <= radius_deg) & (F.abs(F.col("r_dec_deg") - F.col("l_dec_deg")) <= radius_deg)
    inside &= F.abs(F.col("r_g_mag") - F.col("l_mag")) < max_dmag
    near = nearest_of(lacking, offered, key, "source_id", 1.5 * radius_deg, by=("g_mag",), carry=("bp_rp",), also=("_band",), inside=inside)
    best = near.select(F.col(key).alias("_k"), F.col("bp_rp").alias("_c"))
    colour = F.coalesce(clean(F.col("bp_rp")), F.col("_c"))
    source = F.when(clean(F.col("bp_rp")).isNotNull(), "own").when(F.col("_c").isNotNull(), "catalogue")
    kept = [c for c in stars.columns if c not in ("bp_rp", "b_v", "colour_source")]
    return stars.join(best, F.col(key) == F.col("_k"), "left").select(*kept, colour.alias("bp_rp"), colour_bv(colour).alias("b_v"), source.alias("colour_source"))


def steadier(rows: DataFrame, first: str, second: str, good: Column, *, least: int = 2) -> DataFrame:
    """catalog_id, n, the scatter of both fluxes in per cent of their means, better (whether that of `second` is smaller) and
    share_better of all stars, over rows that are good and have both fluxes above 0; stars with `least` rows."""
    used = rows.where(good & (clean(F.col(first)) > 0) & (clean(F.col(second)) > 0))
    share = lambda c: 100 * F.stddev_samp(c) / F.avg(c)
    t = used.groupBy("catalog_id").agg(F.count("*").alias("n"), share(first).alias(f"{first}_pct"), share(second).alias(f"{second}_pct")).where(F.col("n") >= least)
    t = t.withColumn("better", F.col(f"{second}_pct") < F.col(f"{first}_pct"))
    return t.crossJoin(F.broadcast(t.agg(F.avg(F.col("better").cast("int")).alias("share_better"))))


def approved(library: DataFrame, fields: DataFrame, key: str, *, only_approved: bool = True) -> DataFrame:
    """The library's comparison stars of each wanted field (fields: key), brightest first within it as `place`; safe ones with
    an approved verdict only, if so wanted."""
    t = library.join(fields.select(key).distinct(), key, "left_semi")
    t = t.where(F.coalesce(F.col("is_safe") & (F.col("verdict") == "Approved"), F.lit(False))) if only_approved else t
    return t.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("g_mag").asc_nulls_last(), "catalog_id")))
