"""Grouped reports: scatter by group, frame metrics and scores, zero points of frames, diagnostics, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import at_most, clean, magnitude
from skylattice.operators.shared import cut, exact_quantiles, group_quantiles, known, numbered


def scatter_by_group(rows: DataFrame, keys: list[str], value: str, good: Column, *, least: int = 5, least_median: float = 100.0) -> DataFrame:
    """keys, n_frames, med_flux of good rows, rms_flux, rms_pct: groups with enough rows and a median above the limit."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.median(F.when(good, F.col(value))).alias("med_flux"), F.stddev_samp(value).alias("rms_flux"), (100 * F.stddev_samp(value) / F.avg(value)).alias("rms_pct"))
    return g.where((F.col("n_frames") >= least) & (F.col("med_flux") > least_median))


def scatter_verdicts(rows: DataFrame, key: str, value: str, *, least: int = 2, high: float = 1.05, low: float = 0.95) -> DataFrame:
    """key, n, rms, ratio to the median of all, verdict."""
    s = cut(rows.groupBy(key).agg(F.stddev_pop(value).alias("rms"), F.count("*").alias("n")).where(F.col("n") >= least))
    typical = known(exact_quantiles(s, {"x": (F.col("rms"), 0.5)})["x"])
    verdict = F.when(F.col("rms") > high * typical, "variable").when(F.col("rms") < low * typical, "quiet").otherwise("typical")
    return s.select(key, "n", "rms", (F.col("rms") / typical).alias("ratio"), verdict.alias("verdict"))


def heat_map(rows: DataFrame, x: Column, y: Column, x_steps: int = 2, y_steps: int = 4) -> DataFrame:
    """Counts by x and y, rounded half to even to 1 / steps."""
    return rows.groupBy((F.bround(x * x_steps, 0) / x_steps).alias("x_bin"), (F.bround(y * y_steps, 0) / y_steps).alias("y_bin")).agg(F.count("*").alias("n"))


def frame_metrics(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """frame_id, n, one count for each flag (name -> column), n_stars, med."""
    return rows.groupBy("frame_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()], F.count_distinct("catalog_id").alias("n_stars"), F.median("flux").alias("med"))


def histogram(rows: DataFrame, value: str, keys: list[str], width: float, top: int, shares: dict[str, float]) -> DataFrame:
    """keys, bin, n and exact quantiles of each bin: bins of `width` up to the one numbered top, which has the rest."""
    t = rows.withColumn("bin", at_most(F.floor(F.col(value) / width), top).cast("long"))
    return group_quantiles(t.select(*keys, "bin", value), value, [*keys, "bin"], shares)


def frame_scores(frames: DataFrame, parts: dict[str, tuple[float, bool]]) -> DataFrame:
    """frames with score and auto_limit: each part's value between its lowest and highest, by weight; (weight, more is better).

    A missing value counts as the worst; a part with fewer than two values, or all the same, gives its whole weight. The
    limit is 1.05 times the median of the first part, to two places, where there are five values.
    """
    first, frames = next(iter(parts)), cut(frames)
    limit = F.bround(known(exact_quantiles(frames, {"x": (F.col(first), 0.5)})["x"]) * 1.05, 2)
    ranges = frames.agg(*[g(c).alias(f"_{n}_{c}") for c in parts for n, g in (("low", F.min), ("high", F.max), ("n", F.count))])
    t = frames.crossJoin(F.broadcast(ranges))
    total = F.lit(0.0)
    for c, (weight, more) in parts.items():
        span = F.col(f"_high_{c}") - F.col(f"_low_{c}")
        share = F.coalesce((F.col(c) - F.col(f"_low_{c}")) / span, F.lit(0.0 if more else 1.0))
        usable = (F.col(f"_n_{c}") >= 2) & (span > 0)
        total = total + weight * F.when(usable, share if more else 1 - share).otherwise(1.0)
    return t.select(*frames.columns, total.alias("score"), F.when(F.col(f"_n_{first}") >= 5, limit).alias("auto_limit"))


def representatives(rows: DataFrame, keys: list[str], item: str, listed: str) -> DataFrame:
    """keys, the smallest item, the number of rows, and the distinct values of `listed` in order."""
    return rows.groupBy(*keys).agg(F.min(item).alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_set(listed)).alias("listed"))


def reference_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """kind and number of rows of each table, as one bag."""
    out = None
    for name, t in tables.items():
        own = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def smallest_per_key(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias(name))


def frame_zero_points(rows: DataFrame, comps: DataFrame, medians: DataFrame, *, least: int = 2, offset: float = 25.0) -> DataFrame:
    """Targets' rows (frame_id, catalog_id, role, flux) calibrated by frame: n_comp, zero_point, flux_cal, mag_cal.

    The zero point is the median over the comparison stars of a frame of flux over their own median (medians: catalog_id,
    med_flux), positive ones only; frames with fewer than `least` give none.
    """
    own = comps.select("catalog_id").distinct().join(medians.where(clean(F.col("med_flux")) > 0), "catalog_id")
    used = rows.where(clean(F.col("flux")) > 0).join(own, "catalog_id").groupBy("frame_id", "catalog_id").agg(F.first(F.col("flux") / F.col("med_flux")).alias("_q"))
    zero = used.groupBy("frame_id").agg(F.count("*").alias("n_comp"), F.median("_q").alias("zero_point")).where((F.col("n_comp") >= least) & (F.col("zero_point") > 0))
    t = rows.where(F.upper(F.trim("role")) == "VAR").join(zero, "frame_id")
    cal = F.col("flux") / F.col("zero_point")
    return t.select("frame_id", "catalog_id", "n_comp", "zero_point", cal.alias("flux_cal"), (magnitude(cal) + offset).alias("mag_cal"))


def median_positive(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the median of the positive values."""
    return rows.where(clean(F.col(value)) > 0).groupBy(*keys).agg(F.median(value).alias(name))


def consensus_period(sectors: DataFrame, key: str) -> DataFrame:
    """key, n_ok, period, double_period from sectors (key, error, period): the median of positive periods without error."""
    good = F.when(F.col("error").isNull() & (clean(F.col("period")) > 0), F.col("period"))
    return sectors.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.median(good).alias("period")).withColumn("double_period", 2 * F.col("period"))


def airmass_slopes(frames: DataFrame, key: str) -> DataFrame:
    """key, n and the slopes over airmass of target, ensemble and their difference; rows with all four only, 4 at least."""
    whole = frames.where(clean(F.col("mag")).isNotNull() & clean(F.col("ensemble_mag")).isNotNull() & clean(F.col("airmass")).isNotNull()).withColumn("delta", F.col("mag") - F.col("ensemble_mag"))
    slopes = [F.regr_slope(c, "airmass").alias(f"slope_{n}") for c, n in (("mag", "target"), ("ensemble_mag", "ensemble"), ("delta", "delta"))]
    return whole.groupBy(key).agg(F.count("*").alias("n"), *slopes).where("n > 3")


def mean_flux_ensemble(rows: DataFrame) -> DataFrame:
    """target_id, frame_id, ensemble_mag: the magnitude of the mean of the comparison stars' positive fluxes."""
    return rows.where(clean(F.col("flux")) > 0).groupBy("target_id", "frame_id").agg(magnitude(F.avg("flux")).alias("ensemble_mag"))


# ---------------------------------------------------------------- positions in a series


def relative_days(rows: DataFrame, jd: str, *, full: float = 2_000_000.0) -> DataFrame:
    """rows with jd_rel and jd_offset: days from the whole day of the first; values that aren't full Julian days stay."""
    s = rows.agg(F.floor(F.min(clean(F.col(jd)))).alias("_low"), F.max(clean(F.col(jd))).alias("_high"))
    t = rows.crossJoin(F.broadcast(s))
    offset = F.when(F.col("_high") >= full, F.col("_low"))
    return t.select(*rows.columns, (F.col(jd) - F.coalesce(offset, F.lit(0))).alias("jd_rel"), offset.alias("jd_offset"))


def running_index(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """rows with their place in the order, from 1."""
    return numbered(rows, name, order)


def trimmed(rows: DataFrame, key: str, order: str, *, start: int = 40, end: int = 40, middle: int = 160) -> DataFrame:
    """rows without the first, the last and the middle ones of each series."""
    w = Window.partitionBy(key)
    t = rows.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    half = F.floor(F.col("_n") / 2)
    inside = (F.col("_k") > half - middle // 2) & (F.col("_k") <= half + middle // 2)
    return t.where((F.col("_k") > start) & (F.col("_k") <= F.col("_n") - end) & ~inside).drop("_k", "_n")


def half_means(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, n, means of the first and second half, and where the smallest value stands."""
    t = rows.withColumn("_half", F.ntile(2).over(Window.partitionBy(key).orderBy(order)))
    return t.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("_half") == k, F.col(value))).alias(name) for k, name in ((1, "first_half"), (2, "second_half"))], F.min_by(order, F.struct(value, order)).alias("brightest"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


# ---------------------------------------------------------------- orders


def quality_order(quality: Column) -> Column:
    """good, suspect, excluded, anything else."""
    return F.when(quality == "good", 0).when(quality == "suspect", 1).when(quality == "excluded", 2).otherwise(3)


def detection_order(catalog_id: Column) -> Column:
    """Catalogued stars before detections."""
    return F.coalesce(catalog_id.startswith("DET"), F.lit(False)).cast("int")


def role_order(role: Column) -> Column:
    """Variables before comparison stars."""
    return F.when(F.upper(F.trim(role)) == "VAR", 0).otherwise(1)


def master_source_order() -> list[Column]:
    """Safe ones first, then quiet, then bright, then by id; what is missing comes last."""
    return [F.coalesce("is_safe_comp", F.lit(0)).desc(), F.coalesce("stress_rms", F.lit(1e9)), F.coalesce("g_mag", F.lit(99.0)), F.col("id")]


def with_roles(**roles: DataFrame) -> DataFrame:
    """All rows with the role they come by, variables first in the given order."""
    out = None
    for role, t in roles.items():
        own = t.withColumn("role", F.lit(role.upper()))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
