"""Registered queries of the photometry operators, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import expr, robust
from skylattice.operators import comparison, matching, neighbours, photometry, spatial, store, variability
from skylattice.operators.variability import VariabilityConfig
from skylattice.plans import sessions
from skylattice.plans.bindings import BRIDGE, CELLS, DENSE, REGION_PAIRS, SKY, SPARSE, STARS, bridge, cells, dense, placed_stars, read, sky, sparse, stars
from skylattice.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, as the SQL beside does."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SPARSE_CFG = VariabilityConfig(min_frames=15, min_points=10, min_frames_frac=0.5, mag_limit=99.0, min_field=20)
CFG = VariabilityConfig(mag_limit=99.0)

# ---------------------------------------------------------------- scalar functions


@query("x1_x8_magnitudes_and_colours", """
    select s_suppkey, round(cast(case when (1 + s_suppkey % 24) / 10.0 between 0.1 and 2.5 then 0.0850 + 0.9447 * ((1 + s_suppkey % 24) / 10.0) - 0.1019 * ((1 + s_suppkey % 24) / 10.0) * ((1 + s_suppkey % 24) / 10.0) end as double), 6) as bv,
      round(case when s_acctbal > 0 then -2.5 * log10(s_acctbal) end, 6) as mag, round(pow(10.0, -0.4 * (s_acctbal / 2000)), 6) as flux,
      round(case when s_acctbal > 0 then sqrt(s_acctbal / 1.0 + greatest(2.0, 0.0) * 50.0) / s_acctbal end, 6) as err, round(case when s_acctbal > 0 then s_acctbal / sqrt(s_acctbal + greatest(2.0, 0.0) * pi() * 4.0 * 4.0) end, 6) as snr,
      round(case when s_acctbal > 0 then 2.5 / ln(10) * 3.0 / s_acctbal end, 6) as mag_err,
      case when (1 + s_suppkey % 24) / 10.0 < 0.5 then 'blue' when (1 + s_suppkey % 24) / 10.0 <= 1.5 then 'neutral' else 'red' end as aperture from supplier""")
def _(spark, d):
    s, f, c = read(spark, d, "supplier"), F.col("s_acctbal"), (1 + F.col("s_suppkey") % 24) / 10.0
    return rounded(s.select("s_suppkey", expr.colour_bv(c).alias("bv"), expr.magnitude(f).alias("mag"), expr.flux_of(f / 2000).alias("flux"), expr.photometric_error(f, F.lit(2.0), F.lit(50.0)).alias("err"), expr.signal_to_noise(f, F.lit(2.0), F.lit(4.0)).alias("snr"), expr.magnitude_error(f, F.lit(3.0)).alias("mag_err"), expr.aperture_category(c).alias("aperture")))


@query("x9_x11_times", """
    select event_id, round(floor(epoch(ts) / 86400) + (epoch(ts) - 86400 * floor(epoch(ts) / 86400)) / 86400.0 + 2440587.5, 3) as jd, strftime(ts, '%Y%m%d') as day,
      round(abs((((value * 3 - 40 + 180) % 360.0) + 360.0) % 360.0 - 180), 6) as angle from events""")
def _(spark, d):
    e = read(spark, d, "events")
    jd = expr.julian_day(F.col("ts"))
    return e.select("event_id", F.round(jd, 3).alias("jd"), expr.day_of_julian(jd).alias("day"), F.round(expr.angle_difference(F.col("value") * 3, F.lit(40.0)), 6).alias("angle"))


@query("x15_x16_ids_and_flags", """
    with t as (select c_custkey, case c_custkey % 6 when 0 then '  ' || cast(c_custkey as varchar) || ' ' when 1 then 'DET_' || cast(c_custkey as varchar) when 2 then 'nan' when 3 then cast(c_custkey as varchar) || '.0' when 4 then '' else '1498486880958321200' end as raw,
      case c_custkey % 7 when 0 then 'True' when 1 then '1' when 2 then 'no' when 3 then ' Yes' when 4 then null when 5 then '0' else 'y' end as text from customer)
    select c_custkey, case when lower(trim(raw)) in ('', 'nan') then null when regexp_full_match(trim(raw), '-?[0-9]+') then trim(raw) when try_cast(trim(raw) as double) is not null then cast(try_cast(trim(raw) as decimal(38, 0)) as varchar) else trim(raw) end as id,
      coalesce(lower(trim(text)) in ('true', '1', '1.0', 'yes', 'y', 't'), false) as is_true, coalesce(lower(trim(text)) not in ('false', '0', '0.0', 'no', 'n', 'inactive'), true) as is_active from t""")
def _(spark, d):
    k = F.col("c_custkey")
    raw = F.expr("case c_custkey % 6 when 0 then '  ' || cast(c_custkey as string) || ' ' when 1 then 'DET_' || cast(c_custkey as string) when 2 then 'nan' when 3 then cast(c_custkey as string) || '.0' when 4 then '' else '1498486880958321200' end")
    text = F.expr("case c_custkey % 7 when 0 then 'True' when 1 then '1' when 2 then 'no' when 3 then ' Yes' when 4 then null when 5 then '0' else 'y' end")
    return read(spark, d, "customer").select(k, expr.exact_id(raw).alias("id"), expr.flag(text).alias("is_true"), expr.active(text).alias("is_active"))


@query("x17_x20_x21_scales_and_names", """
    select p_partkey, round(206.265 * p_size / 500.0, 6) as scale, round(sqrt(2082.0 * 2082.0 + 1397.0 * 1397.0) * (206.265 * p_size / 500.0) / 3600, 6) as diagonal,
      regexp_replace(regexp_replace(trim(p_type), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as name, '20240101_' || substr(md5(printf('%.8f', p_retailprice)), 1, 6) as hash from part""")
def _(spark, d):
    scale = expr.plate_scale(F.col("p_size"), F.lit(500.0))
    return read(spark, d, "part").select("p_partkey", F.round(scale, 6).alias("scale"), F.round(expr.field_diagonal(F.lit(2082.0), F.lit(1397.0), scale), 6).alias("diagonal"), expr.safe_name(F.col("p_type")).alias("name"), expr.observation_hash(F.lit("20240101"), F.col("p_retailprice")).alias("hash"))


@query("x23_x24_phases", """
    select event_id, round((((value - 3.0) / 2.75) % 1.0 + 1.0) % 1.0, 6) as phase, round(3.0 + ceil((value - 3.0) / 2.75) * 2.75, 6) as next_minimum from events""")
def _(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", F.round(expr.phase(v, F.lit(3.0), F.lit(2.75)), 6).alias("phase"), F.round(expr.next_minimum(v, F.lit(3.0), F.lit(2.75)), 6).alias("next_minimum"))


@query("x29_x30_shapes_and_vectors", f"""
    with {SKY} select vec_id, round(list_sort([abs(x) + 1, abs(y) + 1, abs(x + y) + 1])[1] / list_sort([abs(x) + 1, abs(y) + 1, abs(x + y) + 1])[3], 6) as r1, round(log10(list_sort([abs(x) + 1, abs(y) + 1, abs(x + y) + 1])[3]), 6) as long_side,
      round(cos(radians(dec_deg)) * cos(radians(ra_deg)), 6) as ux, round(cos(radians(dec_deg)) * sin(radians(ra_deg)), 6) as uy, round(sin(radians(dec_deg)), 6) as uz from sky""")
def _(spark, d):
    s = sky(spark, d)
    shape = expr.triangle_shape(F.abs("x") + 1, F.abs("y") + 1, F.abs(F.col("x") + F.col("y")) + 1)
    u = expr.unit_vector(F.col("ra_deg"), F.col("dec_deg"))
    return rounded(s.select("vec_id", shape[0].alias("r1"), shape[2].alias("long_side"), *[c.alias(n) for c, n in zip(u, ("ux", "uy", "uz"), strict=True)]))


@query("x31_comparison_score", """
    select s_suppkey, round(0.50 * greatest(coalesce(case when s_suppkey % 7 <> 0 then abs(s_acctbal) / 100000 end, 1.0), 1e-4) + 0.20 * coalesce(abs(case when s_suppkey % 13 <> 0 then s_suppkey * 10.0 end - 1455) / 1455, 1.0)
      + 0.15 * case when s_suppkey % 4 = 0 then 0 else least((s_suppkey % 5) / 2.0, 1) end + 0.10 * case when s_suppkey % 6 = 0 then 0 else least((s_suppkey % 3) * 1.0, 1) end + 0.05 * case when s_suppkey % 5 = 0 then 0 else 0.5 end, 6) as score from supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    known = lambda n, x: F.when(k % n != 0, x)  # noqa: E731  a part is missing in every nth row
    score = expr.comparison_score(known(7, F.abs("s_acctbal") / 100000), known(13, k * 10.0), known(4, (k % 5).cast("double")), known(6, (k % 3).cast("double")), known(5, F.lit(0.5)))
    return read(spark, d, "supplier").select(k, F.round(score, 6).alias("score"))


@query("x7_separations", f"""
    with {SKY}, p as (select vec_id, ra_deg as ra1, dec_deg as dec1, case when vec_id % 5 <> 0 then ra_deg * 0.9 + 1 end as ra2, case when vec_id % 7 <> 0 then dec_deg * 0.8 end as dec2 from sky)
    select vec_id, round(2 * degrees(asin(sqrt(case when ra2 is not null and dec2 is not null then least(1.0, pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2)) end))), 6) as separation,
      round(case when vec_id % 3 <> 0 then sqrt(100 / 1.0 + greatest(mag - 12, 0) * 50.0) / 100 end, 6) as error from p join sky using (vec_id)""")
def _(spark, d):
    k, ra, dec = F.col("vec_id"), F.col("ra_deg"), F.col("dec_deg")
    separation = expr.haversine(ra, dec, F.when(k % 5 != 0, ra * 0.9 + 1), F.when(k % 7 != 0, dec * 0.8))
    return rounded(sky(spark, d).select(k, separation.alias("separation"), expr.photometric_error(F.lit(100.0), F.when(k % 3 != 0, F.col("mag") - 12), F.lit(50.0)).alias("error")))


@query("json_properties", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- measurements and variability

SPARSE_CELLS = f"{SPARSE}, c0 as (select catalog_id, frame_id, median(flux) as flux from sparse group by 1, 2), norm as (select catalog_id, frame_id, flux / median(flux) over (partition by frame_id) as flux from c0)"
COVERED = f"{SPARSE_CELLS}, cov as (select * from norm qualify count(flux) over (partition by catalog_id) >= greatest(1, ceil(0.5 * (select count(distinct frame_id) from norm))))"


@query("f1_f2_f3_quality_filter", "select event_id, user_id, value from events where event_type in ('view', 'click') and value > 1 and value < 90 and user_id is not null")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "value", F.col("user_id").cast("string").alias("catalog_id"), (F.col("value") > 1).alias("photometry_ok"), F.when(F.col("value") >= 90, True).alias("is_saturated"), F.concat(F.lit(" "), "event_type").alias("zone"))
    return files.quality(e, ("view", "click")).select("event_id", "user_id", "value")


@query("w4_keep_first_by_priority", f"with {SPARSE} select catalog_id, frame_id, event_id, round(flux, 6) as flux from sparse qualify row_number() over (partition by catalog_id, frame_id order by usable desc, event_id) = 1")
def _(spark, d):
    return rounded(store.deduplicated(sparse(spark, d), ["catalog_id", "frame_id"], F.desc("usable"), F.col("event_id")).select("catalog_id", "frame_id", "event_id", "flux"))


@query("a1_frame_normalised_flux", f"with {SPARSE_CELLS} select catalog_id, frame_id, round(flux, 6) as flux from norm")
def _(spark, d):
    return rounded(variability.normalise_frames(variability.flux_cells(sparse(spark, d))))


@query("a2_first_metadata", f"with {SPARSE} select catalog_id, min_by(event_id, (frame_id, event_id)) as event_id from sparse group by 1")
def _(spark, d):
    rows = sparse(spark, d).select("catalog_id", F.struct("frame_id", "event_id").alias("frame_id"), "event_id")
    return variability.first_metadata(rows, ["event_id"])


@query("a3_coverage", f"with {COVERED} select catalog_id, count(*) as n from cov group by 1")
def _(spark, d):
    c = variability.covered(variability.normalise_frames(variability.flux_cells(sparse(spark, d))), 0.5)
    return c.groupBy("catalog_id").agg(F.count("*").alias("n"))


RMS = f"""{DENSE}, c0 as (select catalog_id, frame_id, median(flux) as flux from dense group by 1, 2), norm as (select catalog_id, frame_id, flux / median(flux) over (partition by frame_id) as flux from c0),
    cov as (select * from norm qualify count(flux) over (partition by catalog_id) >= greatest(1, ceil(0.5 * (select count(distinct frame_id) from norm)))),
    m as (select *, count(flux) over w as n, median(flux) over w as med from cov window w as (partition by catalog_id)),
    s as (select *, median(abs(flux - med)) over (partition by catalog_id) as mad from m),
    i as (select *, flux - lag(flux) over (partition by catalog_id order by frame_id) as step, case when flux > 0 then -2.5 * log10(flux) end as mg from s where n < 3 or mad <= 0 or abs(flux - med) < 5.0 * mad / 0.6745),
    rms as (select catalog_id, max(n) as n_frames, count(flux) as n_clean, count(flux) / max(n) as clip_ratio, avg(flux) as mean_norm, case when max(n) >= 20 and count(flux) >= 20 then 100 * stddev_pop(flux) / avg(flux) end as rms_pct,
      case when count(mg) >= 10 then quantile_cont(mg, 0.95) - quantile_cont(mg, 0.05) end as amplitude_mag, case when stddev_pop(flux) > 0 then stddev_pop(step) / sqrt(2.0) / stddev_pop(flux) end as smoothness from i group by 1)"""


def dense_covered(spark, d):
    return variability.covered(variability.normalise_frames(variability.flux_cells(dense(spark, d))), 0.5)


@query("a4_a6_rms_variability", f"with {RMS} select catalog_id, n_frames, n_clean, round(clip_ratio, 6) as clip_ratio, round(mean_norm, 6) as mean_norm, round(rms_pct, 6) as rms_pct, round(amplitude_mag, 6) as amplitude_mag, round(smoothness, 6) as smoothness from rms")
def _(spark, d):
    return rounded(variability.rms_variability(dense_covered(spark, d), CFG))


ENVELOPE = f"""{RMS}, {STARS}, r as (select rms.*, s.mag, not s.known_variable as field, s.known_variable from rms left join stars s using (catalog_id)),
    p as (select count(*) as n, quantile_cont(rms_pct, 0.85) as p from r where field and rms_pct > 0 and mag is not null),
    q as (select r.*, coalesce(field and rms_pct > 0 and mag is not null and (p.n < 20 or rms_pct < p.p), false) as quiet, case when rms_pct > 0 then log10(greatest(rms_pct, 1e-6)) end as lg from r cross join p),
    f as (select count(case when quiet then lg end) as k, regr_slope(case when quiet then lg end, case when quiet then mag end) as b, regr_intercept(case when quiet then lg end, case when quiet then mag end) as a, median(case when quiet then rms_pct end) as typical from q),
    g as (select q.*, (f.k >= 20 and f.b is not null) as has, f.a + greatest(f.b, 0.02) * mag as fitted, log10(f.typical) as flat from q cross join f), g2 as (select *, case when has then fitted else flat end as expected_log, case when quiet then lg - case when has then fitted else 0 end end as res from g),
    hm as (select median(res) as rm, count(res) as rn from g2), hd as (select case when max(rn) >= 3 and median(abs(res - rm)) > 0 then median(abs(res - rm)) / 0.6745 end as sigma from g2 cross join hm),
    e as (select g2.*, hd.sigma, case when sigma > 0 then (lg - expected_log) / sigma end as score, pow(10.0, expected_log + 3.0 * coalesce(sigma, 0)) as envelope from g2 cross join hd),
    cand as (select *, coalesce(rms_pct > greatest(envelope, 1.5) and clip_ratio >= 0.8 and mean_norm > 0.001 and smoothness < 0.8 and amplitude_mag >= 0.01 and mag <= 99 and n_frames >= 30, false) as is_candidate from e)"""


def catalogue(spark, d):
    return stars(spark, d).select("catalog_id", "mag", (~F.col("known_variable")).alias("field"), "known_variable")


@query("a7_a8_f21_envelope_candidates", f"with {ENVELOPE} select catalog_id, round(rms_pct, 6) as rms_pct, round(expected_log, 6) as expected_log, round(sigma, 6) as sigma, round(score, 5) as score, round(envelope, 5) as envelope, is_candidate from cand")
def _(spark, d):
    found = variability.candidates(variability.envelope(variability.rms_variability(dense_covered(spark, d), CFG).join(catalogue(spark, d), "catalog_id", "left"), CFG), CFG)
    return found.select("catalog_id", F.round("rms_pct", 6).alias("rms_pct"), F.round("expected_log", 6).alias("expected_log"), F.round("sigma", 6).alias("sigma"), F.round("score", 5).alias("score"), F.round("envelope", 5).alias("envelope"), "is_candidate")


VDI = """v0 as (select *, count(flux) over w as vn, sign(flux - median(flux) over w) as sg from cov window w as (partition by catalog_id)), v1 as (select * from v0 where vn >= 30),
    v2 as (select catalog_id, case when sg <> lag(sg) over (partition by catalog_id order by frame_id) then 1 else 0 end as turn from v1 where sg <> 0),
    v3 as (select catalog_id, max(vn) as n_used from v1 group by 1), v4 as (select catalog_id, sum(turn) as turns, count(*) as signs from v2 group by 1),
    v5 as (select v3.catalog_id, n_used, case when signs >= 2 then turns / sqrt(n_used) else 0 end as vdi from v3 left join v4 using (catalog_id)), vm as (select median(vdi) as m from v5), vd as (select median(abs(vdi - m)) as d from v5 cross join vm),
    vdi as (select catalog_id, n_used, vdi, case when d > 0 then (vdi - m) / (d / 0.6745) end as vdi_z, coalesce(case when d > 0 then (vdi - m) / (d / 0.6745) end < -3, false) as vdi_candidate from v5 cross join vm cross join vd)"""


@query("a9_sign_change_index", f"with {RMS}, {VDI} select catalog_id, n_used, round(vdi, 6) as vdi, round(vdi_z, 5) as vdi_z, vdi_candidate from vdi")
def _(spark, d):
    return variability.sign_changes(dense_covered(spark, d), CFG).select("catalog_id", "n_used", F.round("vdi", 6).alias("vdi"), F.round("vdi_z", 5).alias("vdi_z"), "vdi_candidate")


@query("j2_variability_session", f"""with {ENVELOPE}, {VDI} select catalog_id, n_frames, round(rms_pct, 6) as rms_pct, round(score, 5) as score, is_candidate, coalesce(vdi_candidate, false) as vdi_candidate,
    case when is_candidate and coalesce(vdi_candidate, false) then 'both' when is_candidate then 'rms' when coalesce(vdi_candidate, false) then 'vdi' else 'none' end as method, (is_candidate or coalesce(vdi_candidate, false)) and not coalesce(known_variable, false) as is_new from cand left join vdi using (catalog_id)""")
def variability_query(spark, d):
    out = sessions.variability_session(dense(spark, d), catalogue(spark, d), CFG)
    return out.select("catalog_id", "n_frames", F.round("rms_pct", 6).alias("rms_pct"), F.round("score", 5).alias("score"), "is_candidate", "vdi_candidate", "method", "is_new")


@query("w1_steps", f"with {SPARSE_CELLS} select catalog_id, frame_id, round(flux - lag(flux) over (partition by catalog_id order by frame_id), 6) as step from norm")
def _(spark, d):
    c = variability.normalise_frames(variability.flux_cells(sparse(spark, d)))
    return rounded(robust.point_to_point(c, "flux", ["catalog_id"], "frame_id").select("catalog_id", "frame_id", "step"))


@query("w2_group_spread", f"with {DENSE}, m as (select catalog_id, segment, flux, median(flux) over (partition by catalog_id, segment) as med from dense) select catalog_id, segment, round(max(med), 6) as med, round(median(abs(flux - med)), 6) as mad, round(1.4826 * median(abs(flux - med)), 6) as sigma from m group by 1, 2")
def _(spark, d):
    t = robust.spread(dense(spark, d), "flux", ["catalog_id", "segment"])
    return rounded(t.groupBy("catalog_id", "segment").agg(F.max("med").alias("med"), F.max("mad").alias("mad"), robust.sigma_normal(F.max("mad")).alias("sigma")))


@query("w15_frame_sequence", f"with {DENSE}, f as (select frame_id, row_number() over (order by frame_id) as frame_seq from (select distinct frame_id from dense)) select catalog_id, frame_seq, count(*) as n from dense join f using (frame_id) group by 1, 2")
def _(spark, d):
    return photometry.frame_order(dense(spark, d)).groupBy("catalog_id", "frame_seq").agg(F.count("*").alias("n"))


@query("star_frame_grid", f"with {DENSE}, {CELLS} select s.catalog_id, count(*) as n_rows, count(c.flux) as n_measured from (select distinct catalog_id from dense) s cross join (select distinct frame_id from dense) f left join cells c on c.catalog_id = s.catalog_id and c.frame_id = f.frame_id group by 1")
def _(spark, d):
    return photometry.star_frame_grid(cells(spark, d)).groupBy("catalog_id").agg(F.count("*").alias("n_rows"), F.count("flux").alias("n_measured"))


# ---------------------------------------------------------------- comparison stars

BINNED = f"""{DENSE}, {CELLS}, {STARS}, b0 as (select c.catalog_id, c.frame_id, c.flux, s.mag, cast(trunc(s.mag / 0.5) as int) as bin from cells c join stars s using (catalog_id)),
    bins as (select frame_id, bin, median(flux) as m, count(flux) as n from b0 group by 1, 2), best as (select a.frame_id, a.bin, min_by(b.m, (abs(b.bin - a.bin), b.bin)) as ref from bins a join bins b on a.frame_id = b.frame_id and b.n >= 3 and b.m > 0 group by 1, 2),
    whole as (select frame_id, median(flux) as w from b0 group by 1), rel as (select b0.catalog_id, b0.frame_id, b0.flux / coalesce(best.ref, whole.w) as rel from b0 left join best using (frame_id, bin) join whole using (frame_id))"""


def star_cells(spark, d):
    return cells(spark, d).select("catalog_id", "frame_id", "flux").join(stars(spark, d).select("catalog_id", "mag"), "catalog_id")


@query("a11_brightness_normalised", f"with {BINNED} select catalog_id, frame_id, round(rel, 6) as rel from rel")
def _(spark, d):
    return rounded(comparison.bin_normalised(star_cells(spark, d)).select("catalog_id", "frame_id", "rel"))


@query("a10_relative_rms", f"with {BINNED} select catalog_id, count(rel) as n, round(sqrt(avg(pow(rel - 1, 2))), 6) as comp_rms from rel group by 1")
def _(spark, d):
    return rounded(comparison.relative_rms(comparison.bin_normalised(star_cells(spark, d))))


TREND = """t0 as (select *, count(rel) over (partition by catalog_id) as n, (row_number() over (partition by catalog_id order by frame_id) - 1) / greatest(count(rel) over (partition by catalog_id) - 1, 1)::double as t from rel),
    t1 as (select catalog_id, count(*)::double as s0, sum(t) as s1, sum(t*t) as s2, sum(t*t*t) as s3, sum(t*t*t*t) as s4, sum(rel) as y0, sum(t*rel) as y1, sum(t*t*rel) as y2 from t0 group by 1),
    t2 as (select catalog_id, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) as det, y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2) as d0, s0*(y1*s4-s3*y2) - y0*(s1*s4-s3*s2) + s2*(s1*y2-y1*s2) as d1, s0*(s2*y2-y1*s3) - s1*(s1*y2-y1*s2) + y0*(s1*s3-s2*s2) as d2 from t1),
    t3 as (select t0.*, case when n >= 6 then rel / (case when abs((d0 + d1*t + d2*t*t) / det) > 1e-9 then (d0 + d1*t + d2*t*t) / det else 1 end) else rel end as flat from t0 join t2 using (catalog_id)),
    trend as (select catalog_id, frame_id, case when n >= 6 and median(flat) over (partition by catalog_id) > 0 then flat / median(flat) over (partition by catalog_id) else flat end as detrended from t3)"""


@query("a20_quadratic_trend", f"with {BINNED}, {TREND} select catalog_id, frame_id, round(detrended, 5) as detrended from trend")
def _(spark, d):
    t = robust.quadratic_trend(comparison.bin_normalised(star_cells(spark, d)), "rel", ["catalog_id"], "frame_id")
    return rounded(t.select("catalog_id", "frame_id", "detrended"), 5)


@query("a23_suspected_session", f"""with {BINNED.replace('b0 as (select c.catalog_id, c.frame_id, c.flux, s.mag', 'b0 as (select c.catalog_id, c.frame_id, c.flux, s.mag').replace('join stars s using (catalog_id))', 'join stars s using (catalog_id) where not s.known_variable)')}, {TREND},
    r as (select catalog_id, count(detrended) as n, sqrt(avg(pow(detrended - 1, 2))) as comp_rms from trend group by 1), m as (select median(comp_rms) as m, stddev_pop(comp_rms) as sd from r), dv as (select median(abs(comp_rms - m)) as mad from r cross join m)
    select catalog_id, n, round(comp_rms, 6) as comp_rms, round(m.m + 3 * case when mad > 0 then mad / 0.6745 when sd > 0 then sd / 0.6745 else 1e-9 end, 6) as "limit" from r cross join m cross join dv where comp_rms > m.m + 3 * case when mad > 0 then mad / 0.6745 when sd > 0 then sd / 0.6745 else 1e-9 end""")
def _(spark, d):
    active = stars(spark, d).where("known_variable").select("catalog_id")
    return rounded(sessions.suspected_session(cells(spark, d), stars(spark, d), active))


@query("a12_stress_sample")
def _(spark, d):
    return rounded(comparison.stress_sample(cells(spark, d), frac=0.10, seed=7))


@query("a10_stable_comparison_stars", f"""with {BINNED}, r as (select catalog_id, count(rel) as n, sqrt(avg(pow(rel - 1, 2))) as comp_rms from rel group by 1), e as (select * from r where n >= 24 and not (comp_rms < 1e-4 and n >= 50)),
    k as (select case when count(case when comp_rms <= 0.3 then 1 end) >= 3 then 0.3 when count(case when comp_rms <= 0.5 then 1 end) >= 3 then 0.5 else 1.0 end as cut_used from e) select catalog_id, n, round(comp_rms, 6) as comp_rms, cut_used from e cross join k where comp_rms <= cut_used""")
def _(spark, d):
    r = comparison.relative_rms(comparison.bin_normalised(star_cells(spark, d)))
    return rounded(comparison.stable(r, n_frames=80, frac=0.3, cut=0.3, fallback=0.5, last=1.0, n_min=3))


@query("a13_comparison_stability", f"""with {DENSE}, {CELLS}, m as (select * from cells), t as (select catalog_id, mag, mag - lag(mag) over (partition by catalog_id order by frame_id) as st from m),
    s as (select catalog_id, count(mag) as n, case when count(mag) >= 3 then stddev_pop(mag) end as lc_rms, case when count(st) >= 2 then stddev_pop(st) / sqrt(2.0) end as p2p from t group by 1), md as (select median(p2p) as m, count(p2p) as v, stddev_pop(p2p) as sd from s),
    dv as (select median(abs(p2p - m)) as mad from s cross join md), th as (select case when v >= 2 then least(m + 3 * case when mad > 0 then mad / 0.6745 when sd > 0 then sd / 0.6745 else 1e-9 end, 1.0) else 1.0 end as th from md cross join dv),
    q as (select s.*, th, coalesce(p2p <= th, false) and not s.catalog_id % 11 = 0 as good from s cross join th)
    select catalog_id, n, round(lc_rms, 6) as lc_rms, round(p2p, 6) as p2p_rms, round(th, 6) as threshold, case when good then 'good' when p2p > th and (select count(*) from q where good) >= 3 then 'excluded' else 'suspect' end as quality from q""")
def _(spark, d):
    c = cells(spark, d)
    rms = c.select("catalog_id").distinct().withColumn("comp_rms", F.when(F.col("catalog_id") % 11 == 0, 0.0).otherwise(0.02))
    return rounded(comparison.stability(c, rms, cap=1.0))


@query("f14_f16_votes", f"""with {DENSE} select catalog_id, count(*) as n_frames, count(case when peak > 42 then 1 end) as n_bad, count(case when peak > 42 then 1 end) / count(*) > 0.10 as saturated, median(flux / (err * 40000 + 3000)) < 5.0 as faint from dense group by 1 having count(*) >= 10 and count(case when peak > 42 then 1 end) / count(*) > 0.10""")
def _(spark, d):
    rows = dense(spark, d).withColumn("snr", F.col("flux") / (F.col("err") * 40000 + 3000))
    over = comparison.share_vote(rows, F.col("peak") > 42)
    faint = comparison.faint_vote(rows, "snr").select("catalog_id", F.lit(True).alias("faint"))
    return over.join(faint, "catalog_id", "left").select("catalog_id", "n_frames", "n_bad", F.lit(True).alias("saturated"), F.coalesce("faint", F.lit(False)).alias("faint"))


@query("f17_blend_vote", f"""with {DENSE}, f as (select median(x) as typical from (select frame_id, median(err) as x from dense group by 1)), s as (select catalog_id, count(airmass) as n, median(airmass) as median_chi2, median(err) as median_fwhm from dense group by 1)
    select catalog_id, n, round(median_chi2, 6) as median_chi2, round(median_fwhm, 6) as median_fwhm, round(median_fwhm / typical, 6) as width_ratio from s cross join f where (n >= 3 and median_chi2 > 1.49) or median_fwhm / typical > 1.02""")
def _(spark, d):
    return rounded(comparison.blend_vote(dense(spark, d), "airmass", "err", chi2_max=1.49, fwhm_max=1.02))


PAIRS = f"{REGION_PAIRS}, {STARS}, pairs as (select b.target_id, b.comp_id, abs(t.mag - c.mag) as dm, abs(t.bp_rp - c.bp_rp) as db, case when abs(t.mag - c.mag) <= 0.25 and abs(t.bp_rp - c.bp_rp) <= 0.15 then 1 when abs(t.mag - c.mag) <= 0.5 and abs(t.bp_rp - c.bp_rp) <= 0.3 then 2 when abs(t.mag - c.mag) <= 1.0 and abs(t.bp_rp - c.bp_rp) <= 0.5 then 3 else 4 end as tier from region_pairs b join stars t on t.catalog_id = b.target_id join stars c on c.catalog_id = b.comp_id)"


def star_pairs(spark, d, pairs):
    """pairs (catalog_id, other) of stars with the differences of their magnitudes and colours."""
    s = stars(spark, d)
    t, c = s.select("catalog_id", F.col("mag").alias("_tm"), F.col("bp_rp").alias("_tb")), s.select(F.col("catalog_id").alias("other"), F.col("mag").alias("_cm"), F.col("bp_rp").alias("_cb"))
    p = pairs.select("catalog_id", "other").join(t, "catalog_id").join(c, "other").withColumn("dm", F.abs(F.col("_tm") - F.col("_cm"))).withColumn("db", F.abs(F.col("_tb") - F.col("_cb")))
    return p.select(F.col("catalog_id").alias("target_id"), F.col("other").alias("comp_id"), "dm", "db", F.substring(expr.tier(F.col("dm"), F.col("db")), 5, 1).cast("int").alias("tier"))


@query("w8_w9_first_full_tier", f"""with {PAIRS}, p as (select * from pairs where dm <= 2.0), n as (select target_id, tier, sum(count(*)) over (partition by target_id order by tier) as upto from p group by 1, 2), c as (select target_id, coalesce(min(case when upto >= 3 then tier end), max(tier)) as chosen_tier from n group by 1)
    select p.target_id, p.comp_id, p.tier, c.chosen_tier from p join c using (target_id) where p.tier <= c.chosen_tier""")
def _(spark, d):
    return comparison.stars_of_full_tier(placed_stars(spark, d), "catalog_id", "region", n_min=3)


@query("w6_conditional_selection", f"""with {PAIRS}, r as (select *, row_number() over (partition by target_id order by dm, comp_id) as k from pairs), m as (select *, median(case when k <= 3 then dm end) over (partition by target_id) as md from r), s as (select *, row_number() over (partition by target_id order by k) as rank from m where k <= 3 or dm <= 1.5 * md)
    select target_id, comp_id, round(dm, 6) as dm, rank from s where rank <= 7""")
def _(spark, d):
    near = neighbours.nearest_in_value(placed_stars(spark, d), "catalog_id", "region", "mag", 7)  # no more than 7 are chosen, in this order
    p = near.select(F.col("catalog_id").alias("target_id"), F.col("other").alias("comp_id"), F.col("gap").alias("dm"))
    return rounded(comparison.conditional_head(p, "target_id", [F.col("dm"), F.col("comp_id")], "dm"))


@query("w7_ensemble_selection", f"""with {PAIRS}, r as (select *, row_number() over (partition by target_id order by dm, comp_id) as k from pairs), s as (select *, row_number() over (partition by target_id order by k) as rank from r where k <= 3 or db < 0.4)
    select target_id, comp_id, round(db, 6) as db, rank from s where rank <= 10""")
def _(spark, d):
    s = placed_stars(spark, d)  # 10 are chosen at most: the first 3, and of those of like colour the first 10
    near = neighbours.nearest_in_value(s, "catalog_id", "region", "mag", 3).select("catalog_id", "other")
    near = near.unionByName(neighbours.nearest_alike(s, "catalog_id", "region", "mag", 10, "bp_rp", 0.4, width=0.25).select("catalog_id", "other")).distinct()
    p = star_pairs(spark, d, near).withColumn("threshold", F.lit(0.4)).select("target_id", "comp_id", "dm", "db", "threshold")
    return rounded(comparison.ensemble_head(p, "target_id", [F.col("dm"), F.col("comp_id")], "db").select("target_id", "comp_id", "db", "rank"))


# ---------------------------------------------------------------- light curves

COMPS = f"{DENSE}, {CELLS}, {STARS}, {BRIDGE}, comps as (select b.target_id, b.comp_id, c.frame_id, c.mag, c.err, s.mag as catalog_mag, s.bp_rp from bridge b join cells c on c.catalog_id = b.comp_id join stars s on s.catalog_id = b.comp_id)"


def comp_rows(spark, d):
    s = stars(spark, d).select(F.col("catalog_id").alias("comp_id"), F.col("mag").alias("catalog_mag"), "bp_rp")
    return bridge(spark, d).join(cells(spark, d).select(F.col("catalog_id").alias("comp_id"), "frame_id", "mag", "err"), "comp_id").join(s, "comp_id")


@query("j29_a14_ensemble_magnitude", f"with {COMPS} select target_id, frame_id, count(*) as n_comp, round(-2.5 * log10(sum(pow(10.0, -0.4 * mag))), 6) as ensemble_mag, round(stddev_pop(mag), 6) as scatter from comps group by 1, 2")
def _(spark, d):
    return rounded(photometry.ensemble_magnitude(comp_rows(spark, d)))


@query("a15_weighted_zero_point", f"with {COMPS} select target_id, frame_id, round(coalesce(sum(case when err > 1e-6 then (catalog_mag - mag) / (err * err) end) / sum(case when err > 1e-6 then 1 / (err * err) end), median(catalog_mag - mag)), 6) as zero_point from comps group by 1, 2")
def _(spark, d):
    return rounded(photometry.zero_points(comp_rows(spark, d), "err"))


DIFFERENTIAL = f"""{COMPS}, w as (select *, catalog_mag - mag as z, case when err > 0 then 1 / (err * err) else 1.0 end as wt from comps), s as (select target_id, frame_id, count(*) as n_comp, sum(wt * z) as wz, sum(wt) as sw, avg(z) as av, sum(pow(wt * err, 2)) as we from w group by 1, 2),
    diff as (select c.catalog_id as target_id, c.frame_id, c.airmass, s.n_comp, case when n_comp = 1 then av else wz / sw end as zp, c.mag + case when n_comp = 1 then av else wz / sw end as calibrated, sqrt(c.err * c.err + case when n_comp = 1 then 0 else we / (sw * sw) end) as calibrated_err from cells c join s on s.target_id = c.catalog_id and s.frame_id = c.frame_id)"""


@query("a16_j13_differential_magnitudes", f"with {DIFFERENTIAL} select target_id, frame_id, n_comp, round(zp, 6) as zp, round(calibrated, 6) as calibrated, round(calibrated_err, 6) as calibrated_err from diff")
def _(spark, d):
    t = cells(spark, d).select(F.col("catalog_id").alias("target_id"), "frame_id", "mag", "err")
    return rounded(photometry.differential(t, comp_rows(spark, d)).select("target_id", "frame_id", "n_comp", "zp", "calibrated", "calibrated_err"))


@query("a17_colour_term", f"""with {COMPS}, st as (select target_id, comp_id, count(catalog_mag - mag) as k, median(catalog_mag - mag) as y, first(bp_rp) as c from comps group by 1, 2 having count(catalog_mag - mag) >= 5), x0 as (select *, c - median(c) over (partition by target_id) as x, median(c) over (partition by target_id) as mid, count(*) over (partition by target_id) as n from st),
    x1 as (select *, y - regr_intercept(y, x) over (partition by target_id) - regr_slope(y, x) over (partition by target_id) * x as r from x0 where n >= 5), x2 as (select *, median(r) over (partition by target_id) as rm, stddev_pop(r) over (partition by target_id) as sd from x1), x3 as (select *, median(abs(r - rm)) over (partition by target_id) as mad from x2),
    f as (select target_id, count(*) as n, max(mid) as mid, regr_slope(y, x) as c1, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy from x3 where abs(r) <= 3 * case when mad > 0 then mad / 0.6745 when sd > 0 then sd / 0.6745 else 1e-9 end group by 1)
    select target_id, n, round(c1, 5) as c1, round(case when n > 2 and sxx > 0 then sqrt(greatest(syy - c1 * sxy, 0) / (n - 2) / sxx) end, 5) as c1_err, round(cast(mid as double), 6) as colour_mid, coalesce(n >= 10 and abs(c1) > 1e-6 and sqrt(greatest(syy - c1 * sxy, 0) / (n - 2) / sxx) / abs(c1) <= 0.5, false) as applied from f""")
def _(spark, d):
    c = comp_rows(spark, d).withColumnRenamed("comp_id", "catalog_id")
    t = photometry.colour_term(c, ["target_id"])
    return t.select("target_id", "n", F.round("c1", 5).alias("c1"), F.round("c1_err", 5).alias("c1_err"), F.round("colour_mid", 6).alias("colour_mid"), photometry.colour_gate(F.col("n"), F.col("c1"), F.col("c1_err"), F.lit("V")).alias("applied"))


FLAGS = """o1 as (select *, count(mag) over w as n, median(mag) over w as md, stddev_pop(mag) over w as sd from o0 window w as (partition by target_id)), o2 as (select *, median(abs(mag - md)) over (partition by target_id) as mad from o1), o3 as (select *, case when mad > 0 then mad / 0.6745 when sd > 0 then sd / 0.6745 else 1e-9 end as sg from o2),
    flagged as (select target_id, frame_id, mag, airmass, case when n < 3 then 'no_data' when mag < md - 3 * sg then 'outlier_hi' when mag > md + 3 * sg then 'outlier_lo' else 'normal' end as flag from o3)"""


@query("a21_outlier_flags", f"with {DIFFERENTIAL}, o0 as (select target_id, frame_id, calibrated as mag, airmass from diff), {FLAGS} select target_id, frame_id, flag from flagged")
def _(spark, d):
    t = cells(spark, d).select(F.col("catalog_id").alias("target_id"), "frame_id", "mag", "err")
    c = photometry.differential(t, comp_rows(spark, d)).select("target_id", "frame_id", F.col("calibrated").alias("mag"))
    return photometry.outlier_flags(c, "target_id", "mag", F.lit(False)).select("target_id", "frame_id", "flag")


@query("a22_photometry_session", f"""with {DIFFERENTIAL}, o0 as (select target_id, frame_id, calibrated as mag, airmass from diff), {FLAGS}, fit as (select target_id, count(*) filter (where flag = 'normal') as n, regr_slope(mag, airmass) filter (where flag = 'normal') as b, median(airmass) filter (where flag = 'normal') as xm from flagged group by 1),
    p0 as (select f.target_id, f.frame_id, case when n >= 10 and b between 0 and 1.5 then mag - b * (airmass - xm) else mag end as mag, case when n >= 10 and b between 0 and 1.5 then b end as slope from flagged f join fit using (target_id)),
    p1 as (select *, count(mag) over w as n, median(mag) over w as md, stddev_pop(mag) over w as sd from p0 window w as (partition by target_id)), p2 as (select *, median(abs(mag - md)) over (partition by target_id) as mad from p1), p3 as (select *, case when mad > 0 then mad / 0.6745 when sd > 0 then sd / 0.6745 else 1e-9 end as sg from p2),
    p4 as (select *, case when n < 3 then 'no_data' when mag < md - 3 * sg then 'outlier_hi' when mag > md + 3 * sg then 'outlier_lo' else 'normal' end as flag from p3)
    select target_id, count(*) as n_frames, count(*) filter (where flag in ('outlier_hi', 'outlier_lo')) as n_outliers, count(*) filter (where flag = 'saturated') as n_saturated, round(stddev_pop(mag) filter (where flag = 'normal'), 6) as lc_rms, round(median(mag) filter (where flag = 'normal'), 6) as lc_median_mag, round(max(slope), 6) as am_slope from p4 group by 1""")
def _(spark, d):
    return rounded(sessions.photometry_session(cells(spark, d), stars(spark, d), bridge(spark, d)))


@query("a18_a19_airmass_by_segment", f"""with {DENSE}, f as (select catalog_id, segment, count(*) as n, regr_slope(mag, airmass) as b, median(airmass) as xm from dense where mag is not null group by 1, 2)
    select d.catalog_id, d.segment, l_orderkey, l_linenumber, round(case when n >= 10 and b between 0 and 1.5 then mag - b * (airmass - xm) else mag end, 6) as detrended from dense d join f using (catalog_id, segment)""")
def _(spark, d):
    t = photometry.airmass_detrended(dense(spark, d).withColumn("flag", F.lit("normal")), ["catalog_id", "segment"])
    return rounded(t.select("catalog_id", "segment", "l_orderkey", "l_linenumber", "detrended"))


@query("u3_u5_sets", "select l_partkey from (select distinct l_partkey from lineitem where l_returnflag = 'R' intersect select distinct l_partkey from lineitem where l_returnflag = 'A' except select p_partkey from part where p_size > 40)")
def _(spark, d):
    x = read(spark, d, "lineitem")
    a, r = (x.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AR")
    big = read(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return r.distinct().join(a, "l_partkey", "left_semi").join(big, "l_partkey", "left_anti")


# ---------------------------------------------------------------- positions

HAVERSINE = "2 * degrees(asin(sqrt(least(1.0, pow(sin(radians(b.dec_deg - a.dec_deg) / 2), 2) + cos(radians(a.dec_deg)) * cos(radians(b.dec_deg)) * pow(sin(radians(b.ra_deg - a.ra_deg) / 2), 2)))))"


@query("j3_nearest_on_sky", f"with {SKY}, p as (select a.vec_id as l_vec_id, b.vec_id as r_vec_id, {HAVERSINE} as distance from sky a join sky b on a.label = 0 and b.label <> 0) select l_vec_id, r_vec_id, round(distance, 6) as distance from p where distance <= 0.8 qualify row_number() over (partition by l_vec_id order by distance, r_vec_id) = 1")
def _(spark, d):
    s = sky(spark, d).select("vec_id", "label", "ra_deg", "dec_deg")
    pairs = spatial.sky_pairs(s.where("label = 0"), s.where("label <> 0"), 0.8)
    return rounded(spatial.nearest(pairs, "l_vec_id", "r_vec_id").select("l_vec_id", "r_vec_id", "distance"))


@query("j6_radius_and_brightness", f"with {SKY} select a.vec_id as l_vec_id, b.vec_id as r_vec_id, round({HAVERSINE}, 6) as distance from sky a join sky b on a.vec_id < b.vec_id where {HAVERSINE} <= 0.5 and abs(a.mag - b.mag) < 0.3")
def _(spark, d):
    s = sky(spark, d).select("vec_id", "ra_deg", "dec_deg", "mag")
    p = spatial.sky_pairs(s, s, 0.5).where("l_vec_id < r_vec_id and abs(l_mag - r_mag) < 0.3")
    return rounded(p.select("l_vec_id", "r_vec_id", "distance"))


@query("j7_blended", f"with {SKY} select vec_id, exists (select 1 from sky b where b.vec_id <> a.vec_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 9.6) as is_blended from sky a")
def _(spark, d):
    return spatial.blended(sky(spark, d).select("vec_id", "x", "y"), "vec_id", 9.6).select("vec_id", "is_blended")


@query("j8_contamination", f"with {SKY} select a.vec_id, round(least(coalesce(sum(case when b.vec_id is not null then pow(10.0, -0.4 * (b.mag - a.mag)) end), 0), 2.0), 6) as contamination from sky a left join sky b on b.vec_id <> a.vec_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 0.5 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 25 and b.mag - a.mag <= 3 group by 1")
def _(spark, d):
    return rounded(spatial.contamination(sky(spark, d).select("vec_id", "x", "y", "mag"), "vec_id").select("vec_id", "contamination"))


@query("j9_isolation_with_valve", f"with {SKY}, k as (select vec_id, label, not exists (select 1 from sky b where b.label = a.label and b.vec_id <> a.vec_id and abs(a.mag - b.mag) < 3 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 12.0) as alone from sky a) select vec_id, label from k qualify alone or sum(alone::int) over (partition by label) < 20")
def _(spark, d):
    return spatial.isolated(sky(spark, d).select("vec_id", "label", "x", "y", "mag"), "vec_id", "label", radius=12.0, max_dmag=3.0, n_min=20).select("vec_id", "label")


@query("j10_one_to_one")
def _(spark, d):
    s = sky(spark, d).select("vec_id", "label", "x", "y")
    t = spatial.one_to_one_within(s.where("label % 2 = 0"), s.where("label % 2 = 1"), "vec_id", "vec_id", 30.0)
    return rounded(t.select(F.col("_l").alias("l_vec_id"), F.col("_r").alias("r_vec_id"), "distance"))


@query("s9_j5_key_lookup", "select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def _(spark, d):
    return read(spark, d, "part").join(read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("s10_column_statistic", "select max(p_retailprice) as top, min(p_retailprice) as low, count(*) as n from part")
def _(spark, d):
    return read(spark, d, "part").agg(F.max("p_retailprice").alias("top"), F.min("p_retailprice").alias("low"), F.count("*").alias("n"))


@query("s15_strip_grid", "select cast(i * 48 + j as int) as strip, j * 7.5 as ra_min, least((j + 1) * 7.5, 360.0) as ra_max, -20.0 + i * 5.0 as dec_min, least(-20.0 + (i + 1) * 5.0, 90.0) as dec_max, j = 47 as ra_closed, i = 21 as dec_closed from range(0, 22) a(i) cross join range(0, 48) b(j)")
def _(spark, d):
    t = spark.sql(spatial.strips(7.5, 5.0, -20.0, 90.0))
    return t.select("strip", *[F.col(c).cast("double").alias(c) for c in ("ra_min", "ra_max", "dec_min", "dec_max")], "ra_closed", "dec_closed")


@query("s16_j26_cells_to_do", "select distinct cell from (select cast(l_orderkey // 7 as bigint) as cell from lineitem) where cell not in (select cast(o_orderkey // 7 as bigint) from orders where o_orderstatus = 'P')")
def _(spark, d):
    done = read(spark, d, "orders").where("o_orderstatus = 'P'").select(matching.sky_cell(F.col("o_orderkey"), 7).cast("long").alias("cell"))
    return matching.cells_to_do(read(spark, d, "lineitem").select(matching.sky_cell(F.col("l_orderkey"), 7).cast("long").alias("cell")), done)


# ---------------------------------------------------------------- metadata joins


@query("j15_j17_observation_metadata", "select o_orderkey, c_name, n_name, r_name, round(o_totalprice, 6) as o_totalprice from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def _(spark, d):
    t = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(F.broadcast(read(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rounded(t.select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice"))


@query("j23_j24_back_fill", "select c_custkey, coalesce(s.s_name, n.n_name, 'none') as label from customer left join supplier s on s.s_suppkey = c_custkey left join nation n on n.n_nationkey = c_nationkey")
def _(spark, d):
    t = read(spark, d, "customer").join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return t.select("c_custkey", F.coalesce("s_name", "n_name", F.lit("none")).alias("label"))


@query("j14_paired_frames", f"with {DENSE}, a as (select catalog_id, frame_id, median(flux) as f from dense where segment = 'A' group by 1, 2), r as (select catalog_id, frame_id, median(flux) as f from dense where segment = 'R' group by 1, 2) select catalog_id, count(*) as n, round(stddev_samp(a.f) / avg(a.f), 6) as one, round(stddev_samp(r.f) / avg(r.f), 6) as two from a join r using (catalog_id, frame_id) group by 1")
def _(spark, d):
    one, two = (dense(spark, d).where(F.col("segment") == s).groupBy("catalog_id", "frame_id").agg(F.median("flux").alias(n)) for s, n in (("A", "_a"), ("R", "_r")))
    return rounded(one.join(two, ["catalog_id", "frame_id"]).groupBy("catalog_id").agg(F.count("*").alias("n"), (F.stddev_samp("_a") / F.avg("_a")).alias("one"), (F.stddev_samp("_r") / F.avg("_r")).alias("two")))


# ---------------------------------------------------------------- writes


def halves(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return e.where("event_id % 2 = 0"), e


@query("k4_replace_by_key", "select event_id, user_id, value from (select event_id, user_id, value from events where event_id % 2 = 0 and user_id not in (select user_id from events where user_id < 5) union all select event_id, user_id, value + 1 from events where user_id < 5)")
def _(spark, d):
    old, every = halves(spark, d)
    columns = ["event_id", "user_id", "value"]
    return store.replace_by_key(old.select(*columns), every.where("user_id < 5").select("event_id", "user_id", (F.col("value") + 1).alias("value")), "user_id")


@query("k5_upsert", "select event_id, user_id, case when event_id % 3 = 0 then value * 2 else value end as value from events where event_id % 2 = 0 or event_id % 3 = 0")
def _(spark, d):
    old, every = halves(spark, d)
    return store.upsert(old.select("event_id", "user_id", "value"), every.where("event_id % 3 = 0").select("event_id", "user_id", (F.col("value") * 2).alias("value")), ["event_id"])


@query("k6_k14_insert_ignore", "select event_id, value from events where event_id % 2 = 0 or event_id % 3 = 0")
def _(spark, d):
    old, every = halves(spark, d)
    return store.insert_ignore(old.select("event_id", "value"), every.where("event_id % 3 = 0").select("event_id", "value"), ["event_id"])


@query("k6_insert_or_replace", "select event_id, case when event_id % 3 = 0 then -value else value end as value from events where event_id % 2 = 0 or event_id % 3 = 0")
def _(spark, d):
    old, every = halves(spark, d)
    return store.insert_or_replace(old.select("event_id", "value"), every.where("event_id % 3 = 0").select("event_id", (-F.col("value")).alias("value")), ["event_id"])


@query("k7_pooled_merge", """with o as (select user_id as k, stddev_pop(value) as rms, count(*) as nf, 2 as nob, median(value) as md from events where event_id % 2 = 0 and user_id % 3 <> 0 group by 1), n as (select user_id as k, stddev_pop(value) as rms, count(*) as nf, median(value) as md from events where event_id % 2 = 1 and user_id % 5 <> 0 group by 1)
    select coalesce(o.k, n.k) as user_id, round(coalesce(sqrt((greatest(1, o.nf) * o.rms * o.rms + greatest(1, n.nf) * n.rms * n.rms) / (greatest(1, o.nf) + greatest(1, n.nf))), o.rms, n.rms), 6) as rms, cast(coalesce(o.nf, 0) + coalesce(n.nf, 0) as bigint) as n_frames, cast(coalesce(o.nob, 0) + case when n.k is not null then 1 else 0 end as int) as n_obs,
      round(coalesce((o.md * o.nob + n.md) / (o.nob + 1), o.md, n.md), 6) as median_mag, coalesce(o.k % 4 = 0, false) or coalesce(n.k % 7 = 0, false) as suspect from o full join n on o.k = n.k""")
def _(spark, d):
    _, e = halves(spark, d)
    stat = lambda t: t.groupBy("user_id").agg(F.stddev_pop("value").alias("rms"), F.count("*").alias("n_frames"), F.median("value").alias("median_mag"))
    old = stat(e.where("event_id % 2 = 0 and user_id % 3 <> 0")).withColumn("n_obs", F.lit(2)).withColumn("suspect", F.col("user_id") % 4 == 0)
    new = stat(e.where("event_id % 2 = 1 and user_id % 5 <> 0")).withColumn("suspect", F.col("user_id") % 7 == 0)
    return rounded(store.merge_pooled(old, new, "user_id"))


@query("k8_k9_find_or_create", """with old as (select s_suppkey as id, s_nationkey as setup, s_acctbal as temp from supplier), new as (select distinct c_nationkey as setup, round(c_acctbal, 0) as temp from customer), t as (select new.setup, new.temp, min(old.id) as id from new left join old on old.setup = new.setup and abs(new.temp - old.temp) <= 500 group by 1, 2)
    select setup, temp, coalesce(id, (select max(id) from old) + row_number() over (partition by id is null order by setup, temp)) as id, id is null as created from t""")
def _(spark, d):
    old = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("setup"), F.col("s_acctbal").alias("temp"))
    new = read(spark, d, "customer").select(F.col("c_nationkey").alias("setup"), F.round("c_acctbal", 0).alias("temp")).distinct()
    return store.find_or_create(old, new, "id", ["setup"], "temp", 500.0)


@query("k10_k11_conditional_update", "select o_orderkey, case when o_orderkey % 4 = 0 and o_orderstatus <> 'F' then 'R' else o_orderstatus end as o_orderstatus from orders")
def _(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return store.update_where(o, o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus")), "o_orderkey", F.col("o_orderstatus") != "F")


@query("k12_editor_diff", "select s_suppkey, case when s_suppkey % 3 = 0 then 0.0 else s_acctbal end as s_acctbal, case when s_suppkey % 5 = 0 then 'delete' else 'update' end as change from supplier where (s_suppkey % 5 = 0 and s_suppkey % 3 <> 0) or (s_suppkey % 3 = 0 and s_suppkey % 5 <> 0) union all select s_suppkey, s_acctbal, 'delete' from supplier where s_suppkey % 15 = 0 union all select s_suppkey + 100000, s_acctbal, 'insert' from supplier where s_suppkey % 7 = 0")
def _(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    after = s.where("s_suppkey % 5 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.col("s_acctbal")))
    return store.edits(s, after.unionByName(s.where("s_suppkey % 7 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 100000)), "s_suppkey")


@query("k13_delete_by_subquery", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def _(spark, d):
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.delete_keys(read(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("k15_rekey_children", "select l_orderkey, l_linenumber, cast(case when l_suppkey < 5 then l_suppkey + 1000 else l_suppkey end as bigint) as l_suppkey from lineitem")
def _(spark, d):
    m = read(spark, d, "supplier").where("s_suppkey < 5").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") + 1000).alias("new_key"))
    return store.rekey(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), m, "l_suppkey")


# ---------------------------------------------------------------- streams (run over tables here)


@query("windows_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def _(spark, d):
    from skylattice.streaming.ingest import frame_counts

    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    t = frame_counts(e, "ts", "event_type")
    return rounded(t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean"))


@query("windows_sessions", """with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from l)
    select min(ts) as start, max(ts) + interval 30 minute as "end", user_id, count(*) as n from s group by user_id, k""")
def _(spark, d):
    from skylattice.streaming.ingest import sessions as by_gap

    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    t = by_gap(e, "ts", "user_id")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


