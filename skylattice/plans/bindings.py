"""The driver's tables seen as astronomical ones, once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.neighbours import nearest_in_value


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measurements: about 30 frames (days), duplicates by star and frame."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("catalog_id"), F.col("ts").cast("date").cast("string").alias("frame_id"), F.col("value").alias("flux"), (F.col("event_type") != "error").alias("usable"), "event_id")


SPARSE = "sparse as (select cast(user_id as varchar) as catalog_id, cast(cast(ts as date) as varchar) as frame_id, value as flux, event_type <> 'error' as usable, event_id from events)"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as measurements: stars are suppliers, frames are months."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("catalog_id"), F.date_format("l_shipdate", "yyyy-MM").alias("frame_id"), F.col("l_extendedprice").alias("flux"), (-2.5 * F.log10("l_extendedprice")).alias("mag"),
        F.col("l_tax").alias("err"), (1 + F.col("l_discount") * 10).alias("airmass"), F.col("l_returnflag").alias("segment"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("peak"),
    )


DENSE = (
    "dense as (select l_suppkey as catalog_id, strftime(l_shipdate, '%Y-%m') as frame_id, l_extendedprice as flux, -2.5 * log10(l_extendedprice) as mag, l_tax as err, "
    "1 + l_discount * 10 as airmass, l_returnflag as segment, l_orderkey, l_linenumber, l_quantity as peak from lineitem)"
)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as a star catalogue."""
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("catalog_id"), (10 + F.col("s_acctbal") / 2000).alias("mag"), ((1 + F.col("s_suppkey") % 24) / 10.0).alias("bp_rp"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7 == 0).alias("known_variable"))


STARS = "stars as (select s_suppkey as catalog_id, 10 + s_acctbal / 2000 as mag, (1 + s_suppkey % 24) / 10.0 as bp_rp, s_nationkey as nation, s_suppkey % 7 = 0 as known_variable from supplier)"


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as positions, on a chip and on the sky across 0 degrees."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (1000 * (F.col("embedding")[0].cast("double") + 0.5)).alias("x"), (1000 * (F.col("embedding")[1].cast("double") + 0.5)).alias("y"), F.pmod(F.col("embedding")[2].cast("double") * 20 + 360, F.lit(360.0)).alias("ra_deg"), (F.col("embedding")[3].cast("double") * 20).alias("dec_deg"), (12 + F.col("embedding")[4].cast("double") * 3).alias("mag"))


SKY = (
    "sky as (select vec_id, label, 1000 * (cast(embedding[1] as double) + 0.5) as x, 1000 * (cast(embedding[2] as double) + 0.5) as y, (cast(embedding[3] as double) * 20 + 360) % 360.0 as ra_deg, "
    "cast(embedding[4] as double) * 20 as dec_deg, 12 + cast(embedding[5] as double) * 3 as mag from embeddings)"
)


def placed_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stars with their brightness as it is in the table, and the region that they lie in."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("catalog_id"), F.col("s_acctbal").alias("brightness"), (10 + F.col("s_acctbal") / 2000).alias("mag"), ((1 + F.col("s_suppkey") % 24) / 10.0).alias("bp_rp"), F.col("n_regionkey").alias("region"))


REGION_PAIRS = (
    "region_pairs as (select a.s_suppkey as target_id, b.s_suppkey as comp_id, abs(a.s_acctbal - b.s_acctbal) as gap from supplier a join nation na on a.s_nationkey = na.n_nationkey join nation nb on na.n_regionkey = nb.n_regionkey "
    "join supplier b on b.s_nationkey = nb.n_nationkey where a.s_suppkey <> b.s_suppkey)"
)


def bridge(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Every star as a target, with the n others of its region that are most like it in brightness."""
    near = nearest_in_value(placed_stars(spark, sf_dir), "catalog_id", "region", "brightness", n)
    return near.select(F.col("catalog_id").alias("target_id"), F.col("other").alias("comp_id"))


BRIDGE = f"{REGION_PAIRS}, bridge as (select target_id, comp_id from region_pairs qualify row_number() over (partition by target_id order by gap, comp_id) <= 10)"
CELLS = "cells as (select catalog_id, frame_id, median(flux) as flux, median(mag) as mag, median(err) as err, median(airmass) as airmass from dense group by 1, 2)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense with one row for each star and frame."""
    return dense(spark, sf_dir).groupBy("catalog_id", "frame_id").agg(*[F.median(c).alias(c) for c in ("flux", "mag", "err", "airmass")])
