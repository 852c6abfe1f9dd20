"""Robust statistics as window or group expressions: medians, spreads, clipping, fits from sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 0.6745


def spread(df: DataFrame, value: str, keys: list[str], *, median: str = "med", mad: str = "mad") -> DataFrame:
    """df with the median of value by keys and the median distance from it, on every row."""
    w = Window.partitionBy(*keys)
    return df.withColumn(median, F.median(value).over(w)).withColumn(mad, F.median(F.abs(F.col(value) - F.col(median))).over(w))


def sigma_strict(mad: Column, n: Column) -> Column:
    """MAD / 0.6745; NULL for fewer than 3 values or a MAD that isn't positive."""
    return F.when((n >= 3) & (mad > 0), mad / K)


def sigma_floor(mad: Column, std: Column) -> Column:
    """MAD / 0.6745; where the MAD isn't positive, std / 0.6745, and 1e-9 where that is 0 too."""
    return F.when(mad > 0, mad / K).otherwise(F.when(std > 0, std / K).otherwise(1e-9))


def sigma_normal(mad: Column) -> Column:
    return 1.4826 * mad


def point_to_point(df: DataFrame, value: str, keys: list[str], order: str, name: str = "step") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def quadratic_trend(df: DataFrame, value: str, keys: list[str], order: str, least: int = 6) -> DataFrame:
    """df with `detrended`: value over a quadratic in its rank, t = i / (n - 1), then over its median.

    The fit solves the 3 by 3 normal equations from power sums by key. A trend below 1e-9 counts as 1; keys with fewer
    than `least` values stay as they are.
    """
    w = Window.partitionBy(*keys)
    t = df.withColumn("_n", F.count(value).over(w)).withColumn("_t", (F.row_number().over(w.orderBy(order)) - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    p = [F.sum(F.pow(F.col("_t"), i)).over(w) for i in range(5)]
    q = [F.sum(F.pow(F.col("_t"), i) * F.col(value)).over(w) for i in range(3)]
    t = t.withColumns({f"_p{i}": x for i, x in enumerate(p)} | {f"_q{i}": x for i, x in enumerate(q)})
    s = [F.col(f"_p{i}") for i in range(5)]
    y = [F.col(f"_q{i}") for i in range(3)]

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    base = det(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4])
    c0 = det(y[0], s[1], s[2], y[1], s[2], s[3], y[2], s[3], s[4]) / base
    c1 = det(s[0], y[0], s[2], s[1], y[1], s[3], s[2], y[2], s[4]) / base
    c2 = det(s[0], s[1], y[0], s[1], s[2], y[1], s[2], s[3], y[2]) / base
    trend = c0 + c1 * F.col("_t") + c2 * F.col("_t") * F.col("_t")
    t = t.withColumn("_flat", F.when(F.col("_n") >= least, F.col(value) / F.when(F.abs(trend) > 1e-9, trend).otherwise(1.0)).otherwise(F.col(value)))
    t = t.withColumn("_m", F.median("_flat").over(w))
    kept = [c for c in df.columns if c != "detrended"]
    return t.select(*kept, F.when((F.col("_n") >= least) & (F.col("_m") > 0), F.col("_flat") / F.col("_m")).otherwise(F.col("_flat")).alias("detrended"))


def iterative_clip(df: DataFrame, value: str, keys: list[str], *, n_min: int, rounds: int = 10, k: float = 3.0) -> DataFrame:
    """Rows whose value stays at or below median + k MAD / 0.6745, again and again.

    A round that would leave fewer than n_min rows of a key, or meets a MAD of 0, ends that key's rounds. The rounds are
    unrolled over one partitioning by key: a dropped row is only marked, so no round shuffles again.
    """
    w = Window.partitionBy(*keys)
    out = df.withColumn("_in", F.lit(True)).withColumn("_open", F.lit(True))
    for _ in range(rounds):
        own = F.when(F.col("_in"), F.col(value))
        out = out.withColumn("_med", F.median(own).over(w))
        out = out.withColumn("_mad", F.median(F.abs(own - F.col("_med"))).over(w))
        out = out.withColumn("_stay", F.col("_in") & (F.col(value) <= F.col("_med") + k * F.col("_mad") / K))
        out = out.withColumn("_left", F.sum(F.col("_stay").cast("int")).over(w)).withColumn("_had", F.sum(F.col("_in").cast("int")).over(w))
        out = out.withColumn("_open", F.col("_open") & (F.col("_mad") > 0) & (F.col("_left") >= n_min) & (F.col("_left") < F.col("_had")))
        out = out.withColumn("_in", F.when(F.col("_open"), F.col("_stay")).otherwise(F.col("_in")))
    return out.where("_in").select(*df.columns)


def weighted_line(x: Column, y: Column, w: Column) -> tuple[Column, Column]:
    """Intercept and slope of a least-squares line with weights w, as group aggregates."""
    sw, sx, sy, sxx, sxy = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)
    slope = (sw * sxy - sx * sy) / F.nullif(sw * sxx - sx * sx, F.lit(0.0))
    return (sy - slope * sx) / sw, slope
