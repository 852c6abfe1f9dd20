"""Comparison stars: per-frame normalisation by brightness, stability, votes, tiers and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import expr
from skylattice.functions.robust import sigma_floor
from skylattice.operators.shared import cut, exact_quantiles, known, numbered


def magnitude_bin(mag: Column, width: float = 0.5) -> Column:
    """The bin of a magnitude, cut towards zero; -1 where it is missing."""
    return F.coalesce((mag / width).cast("int"), F.lit(-1))


def bin_normalised(rows: DataFrame, width: float = 0.5, least: int = 3) -> DataFrame:
    """rows (catalog_id, frame_id, flux, mag) with `rel`: flux over the median of its bin in its frame.

    A bin with fewer than `least` stars borrows the nearest bin that has enough, the lower of two; a frame without any
    gives its own median.
    """
    t = rows.withColumn("_bin", magnitude_bin(F.col("mag"), width))
    bins = t.groupBy("frame_id", "_bin").agg(F.median("flux").alias("_m"), F.count("flux").alias("_n"))
    full = bins.where((F.col("_n") >= least) & (F.col("_m") > 0)).select(F.col("frame_id").alias("_f"), F.col("_bin").alias("_b"), "_m")
    every = bins.select("frame_id", "_bin").join(full, F.col("frame_id") == F.col("_f"), "left")
    best = every.groupBy("frame_id", "_bin").agg(F.min_by("_m", F.struct(F.abs(F.col("_b") - F.col("_bin")), "_b")).alias("_ref"))
    frame = rows.groupBy("frame_id").agg(F.median("flux").alias("_whole"))
    out = t.join(best, ["frame_id", "_bin"]).join(frame, "frame_id").withColumn("_ref", F.coalesce("_ref", "_whole"))
    return out.select(*rows.columns, F.when(F.col("_ref") > 0, F.col("flux") / F.col("_ref")).alias("rel"))


def relative_rms(rel: DataFrame, value: str = "rel") -> DataFrame:
    """catalog_id, n, comp_rms: root of the mean squared distance from 1."""
    return rel.groupBy("catalog_id").agg(F.count(value).alias("n"), F.sqrt(F.avg(F.pow(F.col(value) - 1, 2))).alias("comp_rms"))


def stable(rms: DataFrame, *, n_frames: int, frac: float, cut: float, fallback: float, last: float, n_min: int) -> DataFrame:
    """Stars under the cut; where fewer than n_min are, under the fallback, then under the last one."""
    t = rms.where((F.col("n") >= max(3, int(n_frames * frac))) & ~((F.col("comp_rms") < 1e-4) & (F.col("n") >= 50)))
    one = Window.partitionBy()
    t = t.withColumns({f"_{i}": F.count(F.when(F.col("comp_rms") <= c, 1)).over(one) for i, c in enumerate((cut, fallback))})
    limit = F.when(F.col("_0") >= n_min, cut).when(F.col("_1") >= n_min, fallback).otherwise(last)
    return t.where(F.col("comp_rms") <= limit).select(*rms.columns, limit.alias("cut_used"))


def share_vote(rows: DataFrame, bad: Column, *, least: int = 10, share: float = 0.10) -> DataFrame:
    """Stars of at least `least` frames with more than `share` of them bad: catalog_id, n_frames, n_bad."""
    return rows.groupBy("catalog_id").agg(F.count("*").alias("n_frames"), F.count(F.when(bad, 1)).alias("n_bad")).where((F.col("n_frames") >= least) & (F.col("n_bad") / F.col("n_frames") > share))


def faint_vote(rows: DataFrame, snr: str, *, least: int = 5, limit: float = 5.0) -> DataFrame:
    """Stars whose median signal to noise is below the limit, over `least` values or more."""
    return rows.groupBy("catalog_id").agg(F.count(snr).alias("n"), F.median(snr).alias("median_snr")).where((F.col("n") >= least) & (F.col("median_snr") < limit))


def blend_vote(rows: DataFrame, chi2: str, fwhm: str, *, least: int = 3, chi2_max: float = 3.0, fwhm_max: float = 1.5) -> DataFrame:
    """Stars with a median fit error above its limit, or a width above its limit of the frames' median widths' median."""
    frames = cut(rows.groupBy("frame_id").agg(F.median(fwhm).alias("_f")))
    typical = exact_quantiles(frames, {"x": (F.col("_f"), 0.5)})["x"]
    own = rows.groupBy("catalog_id").agg(F.count(chi2).alias("n"), F.median(chi2).alias("median_chi2"), F.median(fwhm).alias("median_fwhm"))
    t = own.withColumn("width_ratio", F.col("median_fwhm") / known(typical))
    return t.where(((F.col("n") >= least) & (F.col("median_chi2") > chi2_max)) | (F.col("width_ratio") > fwhm_max))


def stability(curves: DataFrame, comp_rms: DataFrame, *, n_min: int = 3, k: float = 3.0, cap: float = 0.10) -> DataFrame:
    """catalog_id, n, lc_rms, p2p_rms, threshold, quality of comparison light curves (catalog_id, frame_id, mag).

    The threshold is median + k robust deviations of the point-to-point scatter, at most `cap`. Above it a star is
    excluded, or suspect when fewer than n_min would be good; a catalogued rms below 1e-6 is suspect too.
    """
    w = Window.partitionBy("catalog_id").orderBy("frame_id")
    t = curves.where(F.col("mag").isNotNull()).withColumn("_d", F.col("mag") - F.lag("mag").over(w))
    s = t.groupBy("catalog_id").agg(F.count("mag").alias("n"), F.stddev_pop("mag").alias("_rms"), F.count("_d").alias("_nd"), F.stddev_pop("_d").alias("_p2p"))
    s = s.select("catalog_id", "n", F.when(F.col("n") >= 3, F.col("_rms")).alias("lc_rms"), F.when(F.col("_nd") >= 2, F.col("_p2p") / F.sqrt(F.lit(2.0))).alias("p2p_rms"))
    s = cut(s)
    of = s.agg(F.count("p2p_rms").alias("n"), F.stddev_pop("p2p_rms").alias("sd")).first()  # one row
    med = exact_quantiles(s, {"m": (F.col("p2p_rms"), 0.5)})["m"]
    mad = exact_quantiles(s, {"d": (F.abs(F.col("p2p_rms") - known(med)), 0.5)})["d"]
    s = s.withColumn("threshold", F.least(known(med) + k * sigma_floor(known(mad), known(of["sd"])), F.lit(cap)) if of["n"] >= 2 else F.lit(cap))
    s = s.join(comp_rms.select("catalog_id", "comp_rms"), "catalog_id", "left")
    good = F.col("p2p_rms").isNotNull() & (F.col("p2p_rms") <= F.col("threshold")) & ~F.coalesce(F.col("comp_rms") < 1e-6, F.lit(False))
    s = s.withColumn("_good", F.count(F.when(good, 1)).over(Window.partitionBy()))
    quality = F.when(good, "good").when(F.coalesce(F.col("p2p_rms") > F.col("threshold"), F.lit(False)) & (F.col("_good") >= n_min), "excluded").otherwise("suspect")
    return s.select("catalog_id", "n", "lc_rms", "p2p_rms", "threshold", quality.alias("quality"))


def first_full_tier(pairs: DataFrame, *, n_min: int) -> DataFrame:
    """pairs (target_id, comp_id, tier from 1) of the strictest tier that has n_min members, stricter tiers included.

    Targets for which no tier has enough take the widest.
    """
    tiers = pairs.groupBy("target_id", "tier").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("target_id").orderBy("tier")))
    chosen = tiers.groupBy("target_id").agg(F.coalesce(F.min(F.when(F.col("_upto") >= n_min, F.col("tier"))), F.max("tier")).alias("chosen_tier"))
    return pairs.join(chosen, "target_id").where(F.col("tier") <= F.col("chosen_tier"))


def stars_of_full_tier(stars: DataFrame, key: str, group: str, *, n_min: int, tiers: tuple[tuple[float, float], ...] = expr.TIERS) -> DataFrame:
    """target_id, comp_id, tier, chosen_tier: what first_full_tier() gives of all pairs of stars (key, group, mag, bp_rp) of a
    group that the widest tier's limit of magnitude holds.

    Tier by tier: pairs of the strictest one first, then of wider ones for targets that don't have n_min yet. So pairs that
    aren't wanted are made of few targets only. Stars without group or magnitude have no pairs. Runs at once.
    """
    every = cut(stars.select(F.col(key).alias("_id"), F.col(group).alias("_g"), "mag", "bp_rp").where("_g is not null and mag is not null"))

    def pairs(targets: DataFrame, k: int) -> DataFrame:
        limit = tiers[k - 1][0]
        cell = F.floor(F.col("mag") / (limit * (1 + 1e-6)))
        a = targets.select(F.col("_id").alias("target_id"), "_g", F.col("mag").alias("_tm"), F.col("bp_rp").alias("_tb"), cell.alias("_c"))
        b = every.select(F.col("_id").alias("comp_id"), "_g", F.col("mag").alias("_cm"), F.col("bp_rp").alias("_cb"), F.explode(F.array(*[cell + i for i in (-1, 0, 1)])).alias("_c"))
        dm, db = F.abs(F.col("_tm") - F.col("_cm")), F.abs(F.col("_tb") - F.col("_cb"))
        met = a.join(b, ["_g", "_c"]).where((F.col("target_id") != F.col("comp_id")) & (dm <= limit))
        return met.select("target_id", "comp_id", F.substring(expr.tier(dm, db, tiers), 5, 1).cast("int").alias("tier")).where(F.col("tier") <= k)

    open_, kept = every, None
    for k in range(1, len(tiers)):
        full = cut(pairs(open_, k).groupBy(F.col("target_id").alias("_id")).agg(F.count("*").alias("_n")).where(F.col("_n") >= n_min).select("_id"))
        new = pairs(open_.join(full, "_id", "left_semi"), k).withColumn("chosen_tier", F.lit(k))
        kept = new if kept is None else kept.unionByName(new)
        open_ = cut(open_.join(full, "_id", "left_anti"))
        if open_.isEmpty():
            return kept
    rest = first_full_tier(pairs(open_, len(tiers)), n_min=n_min).select("target_id", "comp_id", "tier", "chosen_tier")
    return rest if kept is None else kept.unionByName(rest)


def conditional_head(rows: DataFrame, group: str, order: list[Column], value: str, *, first: int = 3, most: int = 7, factor: float = 1.5) -> DataFrame:
    """The first rows of each group always, and more, up to `most`, while value stays under factor times their median."""
    w = Window.partitionBy(group)
    t = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)))
    t = t.withColumn("_m", F.median(F.when(F.col("_r") <= first, F.col(value))).over(w))
    t = t.where((F.col("_r") <= first) | (F.col(value) <= factor * F.col("_m"))).withColumn("rank", F.row_number().over(w.orderBy("_r"))).where(F.col("rank") <= most)
    return t.drop("_r", "_m")


def ensemble_head(rows: DataFrame, group: str, order: list[Column], value: str, *, first: int = 3, most: int = 10, limit: str = "threshold") -> DataFrame:
    """The first rows of each group always, then those with value below the limit (all if it is unknown), `most` in all."""
    w = Window.partitionBy(group)
    t = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)))
    t = t.where((F.col("_r") <= first) | F.coalesce(F.col(value) < F.col(limit), F.lit(True))).withColumn("rank", F.row_number().over(w.orderBy("_r")))
    return t.where(F.col("rank") <= most).drop("_r")


def stress_sample(rows: DataFrame, *, frac: float, seed: int, least_stars: int = 3, least_points: int = 3) -> DataFrame:
    """Relative rms over a seeded sample of frames: the share frac of lowest hash, of frames with enough stars."""
    frames = rows.groupBy("frame_id").agg(F.count("flux").alias("_s")).where(F.col("_s") >= least_stars)
    frames = numbered(frames.withColumn("_h", F.xxhash64("frame_id", F.lit(seed))), "_k", ["_h", "frame_id"])
    size = frames.agg(F.greatest(F.lit(1), F.ceil(F.lit(frac) * F.count("*"))).alias("_most"))
    frames = frames.crossJoin(F.broadcast(size)).where(F.col("_k") <= F.col("_most")).select("frame_id")
    t = rows.join(frames, "frame_id", "left_semi").withColumn("rel", F.col("flux") / F.median("flux").over(Window.partitionBy("frame_id")))
    return relative_rms(t).where(F.col("n") >= least_points)


def suspects(rms: DataFrame, *, k: float = 3.0) -> DataFrame:
    """Stars whose comp_rms lies above median + k robust deviations (standard deviation where the MAD is 0)."""
    t = cut(rms)
    sd = t.agg(F.stddev_pop("comp_rms").alias("sd")).first()["sd"]
    med = exact_quantiles(t, {"m": (F.col("comp_rms"), 0.5)})["m"]
    mad = exact_quantiles(t, {"d": (F.abs(F.col("comp_rms") - known(med)), 0.5)})["d"]
    return t.withColumn("limit", known(med) + k * sigma_floor(known(mad), known(sd))).where(F.col("comp_rms") > F.col("limit")).select(*rms.columns, "limit")
