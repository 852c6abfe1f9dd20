"""Registered queries of reports, archives, selections, matching and streams, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import expr, robust
from skylattice.operators import archive, catalogues, matching, neighbours, periods, photometry, reports, selection, spatial, store, variability
from skylattice.operators.shared import cut, shared_dir
from skylattice.operators.variability import VariabilityConfig
from skylattice.plans.bindings import CELLS, DENSE, SKY, SPARSE, STARS, bridge, cells, dense, placed_stars, read, sky, sparse, stars
from skylattice.queries import COMPS, HAVERSINE, PAIRS, query, rounded
from skylattice.streaming import ingest
from skylattice.streaming.tables import KeyedTable

# ---------------------------------------------------------------- grouped reports


@query("a25_a45_scatter_by_group", f"with {DENSE} select catalog_id, segment, count(*) as n_frames, round(median(case when err > 0.02 then flux end), 6) as med_flux, round(stddev_samp(flux), 6) as rms_flux, round(100 * stddev_samp(flux) / avg(flux), 6) as rms_pct from dense group by 1, 2 having count(*) >= 5 and median(case when err > 0.02 then flux end) > 100")
def _(spark, d):
    return rounded(reports.scatter_by_group(dense(spark, d), ["catalog_id", "segment"], "flux", F.col("err") > 0.02))


@query("a27_a28_two_level_scatter", f"with {DENSE}, s as (select catalog_id, stddev_pop(mag) as rms, count(*) as n from dense group by 1 having count(*) >= 2), m as (select median(rms) as md from s) select catalog_id, n, round(rms, 6) as rms, round(rms / md, 6) as ratio, case when rms > 1.05 * md then 'variable' when rms < 0.95 * md then 'quiet' else 'typical' end as verdict from s cross join m")
def _(spark, d):
    return rounded(reports.scatter_verdicts(dense(spark, d), "catalog_id", "mag"))


@query("a29_heat_map", "select round_even(p_retailprice / 100 * 2, 0) / 2 as x_bin, round_even(p_size * 0.03 * 4, 0) / 4 as y_bin, count(*) as n from part group by 1, 2")
def _(spark, d):
    return reports.heat_map(read(spark, d, "part"), F.col("p_retailprice") / 100, F.col("p_size") * 0.03)


@query("a30_frame_metrics", f"with {SPARSE} select frame_id, count(*) as n, count(*) filter (where usable) as n_usable, count(distinct catalog_id) as n_stars, round(median(flux), 6) as med from sparse group by 1")
def _(spark, d):
    return rounded(reports.frame_metrics(sparse(spark, d), {"n_usable": "usable"}))


@query("a31_histogram_percentiles", f"with {DENSE} select segment, cast(least(floor(flux / 10000), 9) as bigint) as bin, count(*) as n, round(quantile_cont(flux, 0.05), 6) as p05, round(quantile_cont(flux, 0.5), 6) as p50, round(quantile_cont(flux, 0.95), 6) as p95 from dense group by 1, 2")
def _(spark, d):
    return rounded(reports.histogram(dense(spark, d), "flux", ["segment"], 10_000, 9, {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


@query("a32_a33_frame_score", f"""with {DENSE}, f as (select frame_id, median(err) as fwhm, median(airmass) as elong, count(*) as stars, median(peak) as sky from dense group by 1), r as (select *, min(fwhm) over () a0, max(fwhm) over () a1, min(elong) over () b0, max(elong) over () b1, min(stars) over () c0, max(stars) over () c1, min(sky) over () d0, max(sky) over () d1 from f)
    select frame_id, round(0.45 * case when a1 > a0 then 1 - (fwhm - a0) / (a1 - a0) else 1 end + 0.30 * case when b1 > b0 then 1 - (elong - b0) / (b1 - b0) else 1 end + 0.15 * case when c1 > c0 then (stars - c0) / (c1 - c0) else 1 end + 0.10 * case when d1 > d0 then 1 - (sky - d0) / (d1 - d0) else 1 end, 6) as score, (select round_even(median(fwhm) * 1.05, 2) from f) as auto_limit from r""")
def _(spark, d):
    f = dense(spark, d).groupBy("frame_id").agg(F.median("err").alias("fwhm"), F.median("airmass").alias("elong"), F.count("*").alias("stars"), F.median("peak").alias("sky"))
    t = reports.frame_scores(cut(f), {"fwhm": (0.45, False), "elong": (0.30, False), "stars": (0.15, True), "sky": (0.10, False)})
    return rounded(t.select("frame_id", "score", "auto_limit"))


@query("a34_a35_group_representative", "select l_shipmode_, l_returnflag, min(l_orderkey) as first_order, count(*) as n, list_aggregate(list_sort(list(distinct l_linenumber)), 'string_agg', ',') as lines from (select *, l_linestatus as l_shipmode_ from lineitem) group by 1, 2")
def _(spark, d):
    t = reports.representatives(read(spark, d, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode_"), ["l_shipmode_", "l_returnflag"], "l_orderkey", "l_linenumber")
    return t.select("l_shipmode_", "l_returnflag", F.col("first").alias("first_order"), "n", F.array_join(F.transform("listed", lambda v: v.cast("string")), ",").alias("lines"))


@query("a36_a38_u1_u2_reference_counts", "select kind, count(*) as n from (select 'customer' as kind, c_nationkey as k from customer union all select 'supplier', s_nationkey from supplier union all select 'nation', n_nationkey from nation) group by 1")
def _(spark, d):
    return reports.reference_counts({t: read(spark, d, t) for t in ("customer", "supplier", "nation")})


@query("a39_smallest_per_key", f"with {PAIRS} select comp_id, round(min(dm), 6) as best from pairs group by 1")
def _(spark, d):
    return rounded(reports.smallest_per_key(neighbours.nearest_in_value(placed_stars(spark, d), "catalog_id", "region", "mag", 1), "catalog_id", "gap", "best").withColumnRenamed("catalog_id", "comp_id"))


@query("w11_w14_halves_and_trim", f"""with {DENSE}, {CELLS}, r as (select *, row_number() over w as k, count(*) over (partition by catalog_id) as n, ntile(2) over w as half from cells window w as (partition by catalog_id order by frame_id)), s as (select * from r where k > 5 and k <= n - 5 and not (k > n / 2 - 3 and k <= n / 2 + 3))
    select catalog_id, count(*) as n, round(avg(case when half = 1 then mag end), 6) as first_half, round(avg(case when half = 2 then mag end), 6) as second_half, min_by(frame_id, (mag, frame_id)) as brightest from s group by 1""")
def _(spark, d):
    c = cells(spark, d)
    t = c.withColumn("half", F.ntile(2).over(Window.partitionBy("catalog_id").orderBy("frame_id")))
    t = reports.trimmed(t, "catalog_id", "frame_id", start=5, end=5, middle=6)
    return rounded(t.groupBy("catalog_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("half") == 1, F.col("mag"))).alias("first_half"), F.avg(F.when(F.col("half") == 2, F.col("mag"))).alias("second_half"), F.min_by("frame_id", F.struct("mag", "frame_id")).alias("brightest")))


@query("w5_top_three_per_group", "select p_brand, p_partkey, round(p_retailprice, 6) as p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 3")
def _(spark, d):
    return rounded(reports.top_per_group(read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3))


@query("top_orders", "select o_orderkey, round(o_totalprice, 6) as o_totalprice from orders order by coalesce(o_totalprice, -1) desc, o_orderkey limit 10")
def _(spark, d):
    return rounded(matching.worst(read(spark, d, "orders").select("o_orderkey", "o_totalprice").fillna(-1.0), "o_totalprice", 10, "o_orderkey"))


@query("state_filters", "select o_orderkey, o_orderpriority from orders where lower(coalesce(o_orderpriority, '')) in ('1-urgent', '2-high') and coalesce(o_orderstatus, 'O') <> 'F' and o_totalprice > 0 and o_totalprice < 400000 and regexp_matches(o_orderpriority, '^[0-9]-')")
def _(spark, d):
    o = read(spark, d, "orders")
    keep = F.lower(F.coalesce("o_orderpriority", F.lit(""))).isin("1-urgent", "2-high") & (F.coalesce("o_orderstatus", F.lit("O")) != "F") & (F.col("o_totalprice") > 0) & (F.col("o_totalprice") < 400000) & F.col("o_orderpriority").rlike("^[0-9]-")
    return o.where(keep).select("o_orderkey", "o_orderpriority")




@query("j12_lookup_with_fallback", f"""with {SKY}, t as (select vec_id as id, x + 1.0 as tx, y - 1.0 as ty, vec_id % 3 = 0 as lost from sky), e as (select t.id, s.vec_id as found, 'id' as how, 0.0 as distance from t join sky s on s.vec_id = t.id and not t.lost),
    x as (select t.id, s.vec_id as found, 'place' as how, sqrt(pow(tx - s.x, 2) + pow(ty - s.y, 2)) as distance from t join sky s on t.lost and sqrt(pow(tx - s.x, 2) + pow(ty - s.y, 2)) <= 18 qualify row_number() over (partition by t.id order by sqrt(pow(tx - s.x, 2) + pow(ty - s.y, 2)), s.vec_id) = 1)
    select id, found, how, round(distance, 6) as distance from e union all select id, found, how, round(distance, 6) from x""")
def _(spark, d):
    s = sky(spark, d).select("vec_id", "x", "y")
    t = s.select(F.col("vec_id").alias("id"), (F.col("x") + 1.0).alias("x"), (F.col("y") - 1.0).alias("y"), (F.col("vec_id") % 3 == 0).alias("lost"))
    known = s.select(F.col("vec_id").alias("found"))
    exact = t.where("not lost").join(known, F.col("id") == F.col("found")).select("id", "found", F.lit("id").alias("how"), F.lit(0.0).alias("distance"))
    near = spatial.nearest(spatial.plane_pairs(t.where("lost").select("id", "x", "y"), s, 18.0), "l_id", "r_vec_id")
    return rounded(exact.unionByName(near.select(F.col("l_id").alias("id"), F.col("r_vec_id").alias("found"), F.lit("place").alias("how"), "distance")))


@query("equal_size_alternatives", "select a.p_partkey as p_partkey, list_aggregate(list_sort(list(b.p_partkey)), 'string_agg', ',') as fallbacks from part a join part b on a.p_size = b.p_size and a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey and abs(a.p_retailprice - b.p_retailprice) <= 300 group by 1")
def _(spark, d):
    return matching.alternatives(read(spark, d, "part"), "p_partkey", ["p_size", "p_brand"], "p_retailprice", 300, "fallbacks")


@query("s7_clustered_box", f"with {SKY} select vec_id, round(ra_deg, 6) as ra_deg, round(dec_deg, 6) as dec_deg, round(mag, 6) as mag from sky where dec_deg between -2.5 and 1.5 and (ra_deg >= 356.5 or ra_deg <= 3.25)")
def _(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/sky-{uuid.uuid4().hex}"
    spatial.write_clustered(sky(spark, d).select("vec_id", "ra_deg", "dec_deg", "mag"), path)
    return rounded(spatial.read_box(spark, path, "vec_id long, ra_deg double, dec_deg double, mag double", -3.5, 3.25, -2.5, 1.5))


@query("k12_k16_bucketed_writes", """
    with new as (select o_custkey as k, max(o_totalprice) as top, count(*) as n from orders group by 1), kept as (select c_custkey as k, c_acctbal as balance, c_mktsegment as segment from customer where c_custkey % 10 <> 3)
    select coalesce(kept.k, new.k) as c_custkey, round(coalesce(new.top, kept.balance), 6) as balance, segment from kept full join (select * from new where n > 12) new using (k)""")
def _(spark, d):
    table = KeyedTable(spark, f"{shared_dir(spark).rstrip('/')}/customers-{uuid.uuid4().hex}", "c_custkey long, balance double, segment string", ["c_custkey"], buckets=16)
    c = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    tops = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"), F.count("*").alias("n")).where("n > 12").drop("n")
    table.apply(c, lambda old, new: store.insert_ignore(old, new, table.keys))
    table.apply(c.where("c_custkey % 10 = 3").select("c_custkey"), lambda old, gone: store.delete_keys(old, gone, table.keys))
    table.apply(tops, lambda old, new: store.upsert(old, new, table.keys))
    return rounded(table.read())


@query("s7_s8_sky_box", f"with {SKY} select vec_id, round(ra_deg, 6) as ra_deg, round(mag, 6) as mag from sky where dec_deg between -3 and 3 and (ra_deg >= 357 or ra_deg <= 4) and mag <= 13 order by mag, vec_id limit 100")
def _(spark, d):
    s = spatial.boxes(sky(spark, d), 357, 364, -3, 3).where("mag <= 13")
    return rounded(s.select("vec_id", "ra_deg", "mag").orderBy("mag", "vec_id").limit(100))


@query("lomb_scargle_sums", f"""with {DENSE}, {CELLS}, p as (select catalog_id, row_number() over (partition by catalog_id order by frame_id) * 1.0 as t, mag - avg(mag) over (partition by catalog_id) as y from cells), f as (select * from p cross join (select unnest([0.05, 0.1, 0.2, 0.31]) as frequency)),
    a as (select *, atan2(sum(sin(4 * pi() * frequency * t)) over w, sum(cos(4 * pi() * frequency * t)) over w) / (4 * pi() * frequency) as tau from f window w as (partition by catalog_id, frequency)), b as (select *, cos(2 * pi() * frequency * (t - tau)) as c, sin(2 * pi() * frequency * (t - tau)) as s from a)
    select catalog_id, cast(frequency as double) as frequency, round((pow(sum(y * c), 2) / sum(c * c) + pow(sum(y * s), 2) / sum(s * s)) / 2, 5) as power from b group by 1, 2""")
def _(spark, d):
    t = cells(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("catalog_id").orderBy("frame_id")) * 1.0)
    return rounded(photometry.lomb_scargle(t.select("catalog_id", F.col("t").cast("double").alias("t"), "mag"), "catalog_id", "t", "mag", [0.05, 0.1, 0.2, 0.31]), 5)


@query("clip_two_rounds", """with recursive r as (select 0 as k, l_suppkey as s, l_orderkey as o, l_linenumber as l, l_extendedprice as v from lineitem),
    m1 as (select *, median(v) over (partition by s) as md from r), a1 as (select *, median(abs(v - md)) over (partition by s) as mad from m1), x1 as (select *, v <= md + 1.0 * mad / 0.6745 as stay from a1), r1 as (select *, count(*) over (partition by s) as had, sum(stay::int) over (partition by s) as left_ from x1),
    k1 as (select s, o, l, v from r1 where case when mad > 0 and left_ >= 10 and left_ < had then stay else true end),
    m2 as (select *, median(v) over (partition by s) as md from k1), a2 as (select *, median(abs(v - md)) over (partition by s) as mad from m2), x2 as (select *, v <= md + 1.0 * mad / 0.6745 as stay from a2), r2 as (select *, count(*) over (partition by s) as had, sum(stay::int) over (partition by s) as left_ from x2),
    k2 as (select s, o, l, v from r2 where case when mad > 0 and left_ >= 10 and left_ < had then stay else true end) select s as catalog_id, count(*) as n, round(max(v), 6) as top from k2 group by 1""".replace("with recursive r", "with r"))
def _(spark, d):
    rows = dense(spark, d).select("catalog_id", "l_orderkey", "l_linenumber", "flux")
    kept = robust.iterative_clip(rows, "flux", ["catalog_id"], n_min=10, rounds=2, k=1.0)
    return rounded(kept.groupBy("catalog_id").agg(F.count("*").alias("n"), F.max("flux").alias("top")))


@query("f4_f5_f7_f24_candidate_mask", f"with {SKY} select vec_id, case when x < 505 then 'left' when x > 515 then 'right' else 'middle' end as zone_flag from sky where (x between 470 and 530 and y between 470 and 530 and mag < 12.5 and label <> 3) or (label = 5 and mag >= 12)")
def _(spark, d):
    inside = F.col("x").between(470, 530) & F.col("y").between(470, 530)
    rescue = (F.col("label") == 5) & (F.col("mag") >= 12)
    zone = F.when(F.col("x") < 505, "left").when(F.col("x") > 515, "right").otherwise("middle")
    return sky(spark, d).where((inside & (F.col("mag") < 12.5) & (F.col("label") != 3)) | rescue).select("vec_id", zone.alias("zone_flag"))


@query("triangles_of_twelve", f"with {SKY}, t as (select vec_id, x, y from sky order by mag, vec_id limit 12) select a.vec_id as i, b.vec_id as j, c.vec_id as k, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) + sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)) + sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)), 5) as round_trip from t a join t b on a.vec_id < b.vec_id join t c on b.vec_id < c.vec_id")
def _(spark, d):
    s = sky(spark, d).orderBy("mag", "vec_id").limit(12).select("vec_id", "x", "y")  # the brightest few: triples of n stars are n cubed
    a, b, c = (s.select(F.col("vec_id").alias(i), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in "ijk")
    side = lambda p, q: F.sqrt(F.pow(F.col(f"x{p}") - F.col(f"x{q}"), 2) + F.pow(F.col(f"y{p}") - F.col(f"y{q}"), 2))
    t = a.join(b, F.col("i") < F.col("j")).join(c, F.col("j") < F.col("k"))
    return t.select("i", "j", "k", F.round(side("i", "j") + side("j", "k") + side("i", "k"), 5).alias("round_trip"))


@query("neighbours_within_a_degree", f"with {SKY}, c as (select a.vec_id, count(*) as votes from sky a join sky b on {HAVERSINE} <= 1.0 group by 1) select vec_id, votes, round(votes / avg(votes) over (), 6) as over_mean from c qualify row_number() over (order by votes desc, vec_id) <= 20")
def _(spark, d):
    s = sky(spark, d).select("vec_id", "ra_deg", "dec_deg")
    c = spatial.sky_pairs(s, s, 1.0).groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.count("*").alias("votes"))
    t = c.crossJoin(F.broadcast(c.agg(F.avg("votes").alias("_m"))))
    return rounded(t.orderBy(F.desc("votes"), "vec_id").limit(20).select("vec_id", "votes", (F.col("votes") / F.col("_m")).alias("over_mean")))


@query("text_summaries_by_region", "select r_name, count(*) as n, string_agg(n_name, '; ' order by n_name) as names, 'https://example.org/?region=' || r_name || '&n=' || cast(count(*) as varchar) as link from nation join region on r_regionkey = n_regionkey group by r_name")
def _(spark, d):
    t = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"))
    return t.select("r_name", "n", "names", F.format_string("https://example.org/?region=%s&n=%d", "r_name", "n").alias("link"))


@query("nearest_master_by_price", """select o_orderkey, p_partkey, round(dt, 6) as dt from (select o_orderkey, p_partkey, abs(o_totalprice / 100 - p_retailprice) as dt, p_size from orders join part on p_size = 1 + o_custkey % 50 where abs(o_totalprice / 100 - p_retailprice) <= 200) qualify row_number() over (partition by o_orderkey order by dt, p_partkey desc) = 1""")
def _(spark, d):
    o, p = read(spark, d, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 50).alias("size"), (F.col("o_totalprice") / 100).alias("t")), read(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("t2"))
    parts = p.groupBy("size", F.col("t2").alias("t")).agg(F.max("p_partkey").alias("p_partkey"))
    near = neighbours.nearest_offers(o.select("size", "t").distinct(), parts, ["size"], "t", "p_partkey", 200.0)
    near = near.select("size", "t", F.explode("_offers").alias("_o")).select("size", "t", F.abs(F.col("t") - F.col("_o.t")).alias("dt"), F.col("_o.p_partkey").alias("p_partkey")).where("dt <= 200")
    c = o.join(near, ["size", "t"])
    return rounded(store.deduplicated(c, ["o_orderkey"], F.col("dt"), F.desc("p_partkey")).select("o_orderkey", "p_partkey", "dt"))


# ---------------------------------------------------------------- the whole operators


@query("a24_iterative_clip_to_the_end")
def _(spark, d):
    rows = dense(spark, d).select("catalog_id", "l_orderkey", "l_linenumber", "flux")
    kept = robust.iterative_clip(rows, "flux", ["catalog_id"], n_min=10, k=1.0)
    return rounded(kept.groupBy("catalog_id").agg(F.count("*").alias("n"), F.max("flux").alias("top")))


def event_curves(spark, d):
    """events as irregular light curves: days since the first of the year."""
    return read(spark, d, "events").select(F.col("user_id").alias("catalog_id"), (expr.julian_day(F.col("ts")) - 2460310.5).alias("t"), F.col("value").alias("mag"))


@query("period_search_best")
def _(spark, d):
    found = periods.find_period(event_curves(spark, d), "catalog_id", "t", "mag")
    return found.select("catalog_id", F.round("period", 8).alias("period"), F.round("power", 4).alias("power"), "band")


@query("period_band_peaks", """
    with p as (select user_id as catalog_id, epoch(ts) / 86400.0 - 19723 as t, value - avg(value) over (partition by user_id) as y, min(epoch(ts) / 86400.0 - 19723) over (partition by user_id) as t0, (max(epoch(ts)) over (partition by user_id) - min(epoch(ts)) over (partition by user_id)) / 86400.0 as span, count(*) over (partition by user_id) as n from events),
    bands as (select * from (values (0, 0.5, 1.1), (1, 1.1, 2.0), (2, 2.0, 5.0), (3, 5.0, 10.0), (4, 10.0, 50.0)) as b(band, short, long)), s as (select distinct catalog_id, span from p where n > 2 and span > 0),
    f as (select catalog_id, band, 1 / long::double + unnest(range(0, cast(ceil((1 / short::double - 1 / long::double) * 5 * span) as bigint))) / (5 * span) as f from s cross join bands), x as (select catalog_id, band, f, t - t0 as t, y from f join p using (catalog_id)),
    a as (select catalog_id, band, f, atan2(sum(sin(4 * pi() * f * t)), sum(cos(4 * pi() * f * t))) / 2 as a, sum(y * cos(2 * pi() * f * t)) as yc, sum(y * sin(2 * pi() * f * t)) as ys, sum(cos(4 * pi() * f * t)) as c2, sum(sin(4 * pi() * f * t)) as s2, count(*) as n from x group by 1, 2, 3),
    w as (select catalog_id, band, f, (pow(yc * cos(a) + ys * sin(a), 2) / ((n + sqrt(c2 * c2 + s2 * s2)) / 2) + pow(ys * cos(a) - yc * sin(a), 2) / nullif((n - sqrt(c2 * c2 + s2 * s2)) / 2, 0)) / 2 as power from a)
    select catalog_id, band, round(1 / max_by(f, power), 6) as period from w group by 1, 2""")
def _(spark, d):
    peaks = periods.band_peaks(event_curves(spark, d), "catalog_id", "t", "mag", bands=(0.5, 1.1, 2.0, 5.0, 10.0, 50.0), oversample=5)
    return peaks.select("catalog_id", "band", F.round("period", 6).alias("period"))


@query("a7_few_field_stars", f"""with {STARS}, r as (select catalog_id, case when catalog_id % 5 <> 0 then mag end as mag, 1 + abs(sin(catalog_id * 1.7)) as rms_pct, catalog_id <= 19 as field from stars),
    f as (select median(rms_pct) as typical, count(*) as n from r where field and mag is not null), l as (select median(log10(rms_pct)) as m from r where field and mag is not null), s as (select median(abs(log10(rms_pct) - m)) / 0.6745 as sigma from r cross join l where field and mag is not null)
    select catalog_id, round(log10(typical), 6) as expected_log, round(sigma, 6) as sigma, round((log10(rms_pct) - log10(typical)) / sigma, 5) as score from r cross join f cross join s""")
def _(spark, d):
    k = F.col("catalog_id")
    r = stars(spark, d).select(k, F.when(k % 5 != 0, F.col("mag")).alias("mag"), (1 + F.abs(F.sin(k * 1.7))).alias("rms_pct"), (k <= 19).alias("field"))
    t = variability.envelope(r, VariabilityConfig())
    return t.select("catalog_id", F.round("expected_log", 6).alias("expected_log"), F.round("sigma", 6).alias("sigma"), F.round("score", 5).alias("score"))


@query("w8_tier_limits", "select s_suppkey, case when dm is null then 'TIER4' when dm <= 0.25 and coalesce(db <= 0.15, true) then 'TIER1' when dm <= 0.5 and coalesce(db <= 0.3, true) then 'TIER2' when dm <= 1.0 and coalesce(db <= 0.5, true) then 'TIER3' else 'TIER4' end as tier from (select s_suppkey, case when s_suppkey % 5 <> 0 then abs(s_acctbal) / 4000 end as dm, case when s_suppkey % 3 <> 0 then (s_suppkey % 10) / 12.0 end as db from supplier)")
def _(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k, expr.tier(F.when(k % 5 != 0, F.abs("s_acctbal") / 4000), F.when(k % 3 != 0, (k % 10) / 12.0)).alias("tier"))


@query("a26_frame_zero_points", f"""with {DENSE}, r as (select catalog_id, frame_id, median(flux) as flux, catalog_id % 4 = 0 as var from dense group by 1, 2), md as (select catalog_id, median(flux) as med from r group by 1),
    z as (select frame_id, count(*) as n_comp, median(flux / med) as zp from r join md using (catalog_id) where not var group by 1 having count(*) >= 2)
    select r.frame_id, r.catalog_id, n_comp, round(zp, 6) as zero_point, round(flux / zp, 5) as flux_cal, round(-2.5 * log10(flux / zp) + 25.0, 6) as mag_cal from r join z using (frame_id) where var""")
def _(spark, d):
    r = cells(spark, d).select("catalog_id", "frame_id", "flux", F.when(F.col("catalog_id") % 4 == 0, " var").otherwise("COMP").alias("role"))
    med = r.groupBy("catalog_id").agg(F.median("flux").alias("med_flux"))
    t = reports.frame_zero_points(r, r.where("role = 'COMP'"), med)
    return t.select("frame_id", "catalog_id", "n_comp", F.round("zero_point", 6).alias("zero_point"), F.round("flux_cal", 5).alias("flux_cal"), F.round("mag_cal", 6).alias("mag_cal"))


@query("a35_first_by_filter", "select p_brand as filter_name, min_by(p_partkey, p_name || lpad(cast(p_partkey as varchar), 9, '0')) filter (where p_size > 25) as master from part group by 1")
def _(spark, d):
    key = F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return archive.masters_by_filter(read(spark, d, "part").select(key.alias("group_key"), F.col("p_brand").alias("filter_name"), F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("master")))


@query("a40_a41_medians_and_consensus", "with s as (select user_id, case when event_type = 'error' then 'bad' end as error, value - 20 as period from events) select user_id, count(*) filter (where error is null) as n_ok, round(median(period) filter (where error is null and period > 0), 6) as period, round(2 * median(period) filter (where error is null and period > 0), 6) as double_period, round(median(period) filter (where period > 0), 6) as fwhm from s group by 1")
def _(spark, d):
    s = read(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "bad").alias("error"), (F.col("value") - 20).alias("period"))
    both = reports.consensus_period(s, "user_id").join(reports.median_positive(s, ["user_id"], "period", "fwhm"), "user_id", "left")
    return rounded(both.select("user_id", "n_ok", "period", "double_period", "fwhm"))


@query("a43_empirical_scale", f"""with {SKY}, s as (select *, row_number() over (order by vec_id) as n from sky order by vec_id limit 42), p as (select {HAVERSINE} * 3600 as sky, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as px from s a join s b on a.n < b.n order by a.n, b.n)
    select count(*) as pairs, round(median(sky / px), 5) as scale from (select * from p where px >= 8.0 and sky >= 2.0 limit 450)""")
def _(spark, d):
    s = sky(spark, d).select(F.col("vec_id").alias("n"), "x", "y", "ra_deg", "dec_deg")
    return matching.empirical_scale(s).select("pairs", F.round("scale", 5).alias("scale"))


@query("a46_airmass_slopes", f"with {COMPS}, e as (select target_id, frame_id, -2.5 * log10(avg(pow(10.0, -0.4 * mag))) as em from comps group by 1, 2), w as (select e.*, c.mag, c.airmass from e join cells c on c.catalog_id = e.target_id and c.frame_id = e.frame_id) select target_id, count(*) as n, round(regr_slope(mag, airmass), 5) as slope_target, round(regr_slope(em, airmass), 5) as slope_ensemble, round(regr_slope(mag - em, airmass), 5) as slope_delta from w group by 1 having count(*) > 3")
def _(spark, d):
    c = cells(spark, d)
    comps = bridge(spark, d).join(c.select(F.col("catalog_id").alias("comp_id"), "frame_id", expr.flux_of(F.col("mag")).alias("flux")), "comp_id")
    t = c.select(F.col("catalog_id").alias("target_id"), "frame_id", "mag", "airmass").join(reports.mean_flux_ensemble(comps), ["target_id", "frame_id"])
    return rounded(reports.airmass_slopes(t, "target_id"), 5)


# ---------------------------------------------------------------- orders, series


@query("o3_o6_o11_custom_orders", """with t as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'good' when 1 then 'suspect' when 2 then 'excluded' end as q, case when s_suppkey % 3 = 0 then 'DET_' else 'G' end || cast(s_suppkey as varchar) as name, s_acctbal as rms, case when s_suppkey % 5 = 0 then 'var' else 'COMP' end as role from supplier)
    select id, row_number() over (order by case q when 'good' then 0 when 'suspect' then 1 when 'excluded' then 2 else 3 end, rms, id) as by_quality, row_number() over (order by case when name like 'DET%' then 1 else 0 end, rms, id) as by_detection, row_number() over (order by case when upper(role) = 'VAR' then 0 else 1 end, id) as by_role, row_number() over (order by case when q = 'good' then 1 else 0 end desc, rms, id) as by_safety from t""")
def _(spark, d):
    k = F.col("s_suppkey")
    q = F.when(k % 4 == 0, "good").when(k % 4 == 1, "suspect").when(k % 4 == 2, "excluded")
    t = read(spark, d, "supplier").select(k.alias("id"), q.alias("q"), F.concat(F.when(k % 3 == 0, "DET_").otherwise("G"), k.cast("string")).alias("name"), F.col("s_acctbal").alias("stress_rms"), F.when(k % 5 == 0, " var").otherwise("COMP").alias("role"), F.lit(None).cast("double").alias("g_mag"))
    t = t.withColumn("is_safe_comp", F.when(F.col("q") == "good", 1)).withColumn("_q", reports.quality_order(F.col("q"))).withColumn("_d", reports.detection_order(F.col("name"))).withColumn("_o", reports.role_order(F.col("role")))
    t = reports.running_index(t, ["_q", "stress_rms", "id"], "by_quality")
    t = reports.running_index(t, ["_d", "stress_rms", "id"], "by_detection")
    t = reports.running_index(t, ["_o", "id"], "by_role")
    t = t.withColumn("_safe", -F.coalesce("is_safe_comp", F.lit(0)))
    return reports.running_index(t, ["_safe", "stress_rms", "id"], "by_safety").select("id", "by_quality", "by_detection", "by_role", "by_safety")


@query("o3_safest_sources", "select s_suppkey as id from supplier order by case when s_suppkey % 4 = 0 then 1 else 0 end desc, coalesce(case when s_suppkey % 3 = 0 then s_acctbal end, 1e9), s_suppkey limit 20")
def _(spark, d):
    k = F.col("s_suppkey")
    t = read(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 == 0, 1).alias("is_safe_comp"), F.when(k % 3 == 0, F.col("s_acctbal")).alias("stress_rms"), F.lit(None).cast("double").alias("g_mag"))
    return t.orderBy(*reports.master_source_order()).limit(20).select("id")


@query("w11_relative_days", "select event_id, round(epoch(ts) / 86400.0 + 2440587.5 - floor(min(epoch(ts) / 86400.0 + 2440587.5) over ()), 5) as jd_rel, cast(floor(min(epoch(ts) / 86400.0 + 2440587.5) over ()) as bigint) as jd_offset from events")
def _(spark, d):
    t = reports.relative_days(read(spark, d, "events").select("event_id", expr.julian_day(F.col("ts")).alias("jd")), "jd")
    return t.select("event_id", F.round("jd_rel", 5).alias("jd_rel"), "jd_offset")


@query("w13_w14_trimmed_halves", f"with {DENSE}, r as (select *, row_number() over (partition by catalog_id order by l_orderkey, l_linenumber) as k, count(*) over (partition by catalog_id) as n from dense), s as (select * from r where k > 40 and k <= n - 40 and not (k > n // 2 - 80 and k <= n // 2 + 80)) select catalog_id, count(*) as n from s group by 1")
def _(spark, d):
    t = dense(spark, d).withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    return reports.trimmed(t, "catalog_id", "o").groupBy("catalog_id").agg(F.count("*").alias("n"))


@query("w14_half_means", f"with {DENSE}, {CELLS}, r as (select *, ntile(2) over (partition by catalog_id order by frame_id) as h from cells) select catalog_id, count(*) as n, round(avg(mag) filter (where h = 1), 6) as first_half, round(avg(mag) filter (where h = 2), 6) as second_half, min_by(frame_id, (mag, frame_id)) as brightest from r group by 1")
def _(spark, d):
    return rounded(reports.half_means(cells(spark, d), "catalog_id", "frame_id", "mag"))


@query("u7_roles", "select id, role from (select s_suppkey as id, 'VAR' as role from supplier where s_suppkey % 7 = 0 union all select s_suppkey, 'COMP' from supplier where s_suppkey % 7 <> 0)")
def _(spark, d):
    s = stars(spark, d).select(F.col("catalog_id").alias("id"), "known_variable")
    return reports.with_roles(var=s.where("known_variable").select("id"), comp=s.where("not known_variable").select("id"))


# ---------------------------------------------------------------- archives


MASTERS = """lights as (select o_orderkey as light_id, case when o_orderkey % 3 = 0 then 'dark' else 'flat' end as kind, 1 + o_orderkey % 2 as xbinning, 1.0 * (o_custkey % 5) as exptime, nullif(o_orderkey % 2, 0) as gain, 'F' || cast(o_custkey % 3 as varchar) as filter_name, (o_totalprice % 500) / 100 as ccd_temp, case when o_orderkey % 4 > 0 then o_custkey % 2 end as eq, case when o_orderkey % 4 > 0 then o_custkey % 3 end as tel from orders),
    lib as (select 'm' || lpad(cast(p_partkey as varchar), 9, '0') as path, case when p_partkey % 2 = 0 then 'dark' else 'flat' end as kind, 1 + p_size % 2 as xbinning, 1.0 * (p_size % 5) as exptime, p_partkey % 3 % 2 as gain, case when p_partkey % 2 = 1 then 'F' || cast(p_size % 3 as varchar) end as filter_name, case when p_partkey % 5 > 0 then (p_retailprice % 500) / 100 end as ccd_temp, case when p_partkey % 3 > 0 then p_size % 2 end as eq, case when p_partkey % 3 > 0 then p_partkey % 3 end as tel, p_partkey % 100 as age from part)"""


@query("j18_j19_calibration_masters", f"""with {MASTERS}, m as (select l.light_id, b.path, abs(b.ccd_temp - l.ccd_temp) as dt, b.age > 60 as expired, l.xbinning > 1 and b.xbinning = 1 as unbinned, b.age from lights l join lib b on b.kind = l.kind and b.exptime = l.exptime and b.gain = coalesce(l.gain, 0)
      and ((l.kind = 'dark' and b.filter_name is null) or (l.kind = 'flat' and b.filter_name = l.filter_name)) and (b.ccd_temp is null or abs(b.ccd_temp - l.ccd_temp) <= 0.5) and (b.xbinning = l.xbinning or (l.xbinning > 1 and b.xbinning = 1))
      and (l.eq is null or l.tel is null or (b.eq is null and b.tel is null) or coalesce(b.eq = l.eq and b.tel = l.tel, false))), r as (select * from m qualify row_number() over (partition by light_id order by expired, not unbinned, coalesce(dt, 1e9), age, path) = 1)
    select lights.light_id, r.path as master, round(r.dt, 6) as dt, r.expired from lights left join r using (light_id)""")
def _(spark, d):
    o, c, k = read(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    lights = o.select(k.alias("light_id"), F.when(k % 3 == 0, "dark").otherwise("flat").alias("kind"), (1 + k % 2).alias("xbinning"), (c % 5).cast("double").alias("exptime"), F.nullif(k % 2, F.lit(0)).alias("gain"), F.concat(F.lit("F"), (c % 3).cast("string")).alias("filter_name"), ((F.col("o_totalprice") % 500) / 100).alias("ccd_temp"), F.when(k % 4 > 0, c % 2).alias("id_equipments"), F.when(k % 4 > 0, c % 3).alias("id_telescope"))
    p, s, q = read(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    library = p.select(
        F.concat(F.lit("m"), F.lpad(q.cast("string"), 9, "0")).alias("path"), F.when(q % 2 == 0, "dark").otherwise("flat").alias("kind"), (1 + s % 2).alias("xbinning"), (s % 5).cast("double").alias("exptime"), (q % 3 % 2).alias("gain"), F.when(q % 2 == 1, F.concat(F.lit("F"), (s % 3).cast("string"))).alias("filter_name"),
        F.when(q % 5 > 0, (F.col("p_retailprice") % 500) / 100).alias("ccd_temp"), F.when(q % 3 > 0, s % 2).alias("id_equipments"), F.when(q % 3 > 0, q % 3).alias("id_telescope"), F.date_sub(F.lit("2024-06-01").cast("date"), (q % 100).cast("int")).cast("timestamp").alias("modified"),
    )
    found = archive.best_masters(lights, library, now=F.lit("2024-06-01").cast("date"), validity_days=60)
    return rounded(found.select("light_id", "master", "dt", "expired"))


@query("j16_library_tags", "select p_partkey as path, case when p_partkey % 3 = 0 then 'all' else concat_ws(' / ', n_name, r_name) end as tag from part left join nation on n_nationkey = case when p_partkey % 3 > 0 then p_size % 30 end left join region on r_regionkey = case when p_partkey % 3 > 0 then p_size % 7 end")
def _(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    library = read(spark, d, "part").select(p.alias("path"), F.when(p % 3 > 0, s % 30).alias("id_equipments"), F.when(p % 3 > 0, s % 7).alias("id_telescope"))
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return archive.library_tags(library, *names)


GROUPS = "f as (select 'p' || lpad(cast(p_partkey as varchar), 9, '0') as path, case when p_size % 9 = 0 then 'NoFilter' else p_brand end as filter_name, (p_size % 3) * 0.5 as exptime, case when p_size % 4 = 0 then 1 else p_size % 4 end as binning, p_retailprice as temp from part), g as (select filter_name || '|' || case exptime when 0 then '0' when 0.5 then '0.5' else '1' end || '|' || cast(binning as varchar) as group_key, filter_name, exptime, binning, min(path) as representative, count(*) as n, min_by(temp, path) as ccd_temp, min(path) as p from f group by 2, 3, 4)"


def groups(spark, d):
    s = F.col("p_size")
    f = read(spark, d, "part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"), F.when(s % 9 == 0, " unknown ").otherwise(F.col("p_brand")).alias("filter_name"), ((s % 3) * 0.5).alias("exptime"), F.nullif((s % 4).cast("int"), F.lit(0)).alias("binning"), F.lit(0).alias("gain"), F.col("p_retailprice").alias("ccd_temp"))
    return archive.observation_groups(f)


@query("a34_x21_observation_groups", f"with {GROUPS} select group_key, representative, n, round(ccd_temp, 6) as ccd_temp from g")
def _(spark, d):
    return rounded(groups(spark, d).select("group_key", "representative", F.size("paths").cast("long").alias("n"), "ccd_temp"))


@query("j20_flat_fallbacks", f"with {GROUPS}, h as (select *, case when n % 3 > 0 then representative end as master from g), m as (select * from h where master is null) select m.group_key, coalesce(string_agg(o.group_key, ';' order by o.group_key), '') as alternatives from m left join h o on o.master is not null and o.binning = m.binning and abs(o.exptime - m.exptime) <= 1e-6 and o.filter_name <> m.filter_name group by 1")
def _(spark, d):
    g = groups(spark, d).withColumn("master", F.when(F.size("paths") % 3 > 0, F.col("representative")))
    t = archive.flat_fallbacks(cut(g.select("group_key", "filter_name", "exptime", "binning", "master")))
    return t.select("group_key", F.array_join("alternatives", ";").alias("alternatives"))


@query("k9_j4_field_registry")
def _(spark, d):
    s = sky(spark, d)
    registry = s.where("label = 0").select(F.col("vec_id").cast("long").alias("id"), "ra_deg", "dec_deg", F.lit("old").alias("object_name"), F.lit(1).cast("long").alias("first_observation"), F.lit(2).cast("long").alias("last_observation"), F.lit(2).cast("long").alias("n_observations"))
    observations = s.where("label <> 0").select(F.col("vec_id").cast("long").alias("observation_id"), "ra_deg", "dec_deg", F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("name"), F.col("vec_id").cast("string"))).alias("object_name"))
    after, _ = archive.register_fields(registry, observations, radius_deg=0.5)
    return rounded(after)


@query("k12_editor_save", "with used as (select distinct s_nationkey as k from supplier), gone as (select n_nationkey as k from nation where n_nationkey % 2 = 0) select n_nationkey, case when n_nationkey % 3 = 0 and n_nationkey % 2 = 1 then 'renamed' else n_name end as n_name, n_nationkey % 2 = 1 as active from nation where n_nationkey % 2 = 1 or n_nationkey in (select k from used)")
def _(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name", F.lit(True).alias("active"))
    after = n.where("n_nationkey % 2 = 1").withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, "renamed").otherwise(F.col("n_name")))
    saved, _ = store.editor_save(n, after, "n_nationkey", {"supplier": (read(spark, d, "supplier"), "s_nationkey")}, active="active")
    return saved


@query("k13_cascade_purge", "with gone as (select o_orderkey from orders where o_orderstatus = 'P') select 'orders' as kind, count(*) as n from orders where o_orderkey not in (select * from gone) union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select * from gone) union all select 'customer', count(*) from customer")
def _(spark, d):
    tables = {t: read(spark, d, t) for t in ("orders", "lineitem", "customer")}
    gone = tables["orders"].where("o_orderstatus = 'P'")
    out = store.cascade_purge(tables, gone, "o_orderkey", {"orders": [("lineitem", "l_orderkey", "o_orderkey"), ("customer", "c_custkey", "o_custkey")]}, "orders", keep=("customer",))
    return reports.reference_counts(out)


@query("k16_append_absent", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(spark, d):
    return store.append_absent(read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("k5_upsert_nulls_and_repeats", "select event_id, user_id, case when event_id % 3 = 0 then case when event_id % 2 = 0 then null else value + 1 end else value end as value from events")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "value")
    new = e.where("event_id % 3 = 0")
    once = new.withColumn("value", F.col("value") - 5).withColumn("nth", F.lit(1))
    last = new.withColumn("value", F.when(F.col("event_id") % 2 == 1, F.col("value") + 1)).withColumn("nth", F.lit(2))
    return store.upsert(e, last.unionByName(once), ["event_id"], order=["nth"])


@query("s8_catalogue_box", f"with {SKY}, b as (select vec_id, label, ra_deg, dec_deg, case when label % 2 = 0 then label end as oid from sky where dec_deg between -3 and 3 and (ra_deg >= 357 or ra_deg <= 4)) select vec_id from b qualify row_number() over (partition by oid, case when oid is null then ra_deg end, case when oid is null then dec_deg end order by vec_id) = 1 order by vec_id limit 50")
def _(spark, d):
    s = sky(spark, d).withColumn("oid", F.when(F.col("label") % 2 == 0, F.col("label")))
    return spatial.catalogue_box(s, 357, 364, -3, 3, order=["vec_id"], limit=50).select("vec_id")


# ---------------------------------------------------------------- selections


FLAGGED = "t as (select *, 0.02 * (vec_id % 100) as distance_deg, case when vec_id % 4 = 0 then 'DET_' else 'G' end || cast(vec_id as varchar) as catalog_id, vec_id % 9 > 0 as usable, vec_id % 11 = 0 as sat, vec_id % 13 = 0 as nss, vec_id % 17 = 0 as gal from sky)"


@query("f4_f5_f6_comparison_mask", f"with {SKY}, {FLAGGED} select vec_id from t where (distance_deg <= 1.5 and distance_deg >= 60 / 3600.0 and usable and not sat and not nss and not gal and catalog_id <> 'G77') or (catalog_id like 'DET%' and distance_deg <= 1.5 and vec_id % 8 = 0 and not sat)")
def _(spark, d):
    v = F.col("vec_id")
    t = sky(spark, d).withColumns({"distance_deg": 0.02 * (v % 100), "catalog_id": F.concat(F.when(v % 4 == 0, "DET_").otherwise("G"), v.cast("string")), "is_usable": F.when(v % 9 > 0, "yes").otherwise("no"), "is_saturated": F.when(v % 11 == 0, "1"), "gaia_nss": v % 13 == 0, "gaia_gal": F.when(v % 17 == 0, "True"), "snr50_ok": v % 8 == 0})
    mask = selection.comparison_candidates(t, max_distance_deg=1.5, min_distance_arcsec=60.0, target=F.lit("G77")).select("vec_id")
    return mask.unionByName(t.where(selection.detections_rescued(t, max_distance_deg=1.5)).select("vec_id")).distinct()


@query("f7_f24_f22_chip_masks", f"with {SKY} select vec_id, x between 480 and 560 and y between 480 and 560 as inside, x between 495 and 505 and y between 496 and 504 as in_view, case when label = 1 then 'noisy2' when label = 2 then 'saturated' when label = 3 then 'odd' else 'unknown' end as zone from sky")
def _(spark, d):
    label = F.col("label")
    zone = F.when(label == 1, " Noisy2").when(label == 3, "odd").when(label == 4, "")
    return sky(spark, d).select("vec_id", selection.chip_interior(F.col("x"), F.col("y"), F.lit(1040.0), F.lit(1040.0), 480.0).alias("inside"), selection.field_of_view(F.col("x"), F.col("y"), F.lit(1000.0), F.lit(1000.0), (495.0, -495.0, 496.0, -496.0)).alias("in_view"), selection.zone_flag(zone, F.when(label == 2, "yes")).alias("zone"))


@query("f8_effective_frame", f"with {SKY} select greatest(500, cast(ceil(max(x)) as int) + 102) as width, greatest(5000, cast(ceil(max(y)) as int) + 102) as height from sky")
def _(spark, d):
    s = sky(spark, d)
    return selection.effective_frame([s.where("label = 0"), s.where("label <> 0")], width=500, height=5000, margin=100)


EDGE = "p as (select *, case when r is null or r <= 0 then 30.0 else r end as rr from (select catalog_id, frame_id, mag, peak * 20 as x, err * 5000 as y, case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1 then -1.0 else 60.0 end as r from dense)), q as (select *, not (x - rr >= 0 and x + rr <= 990 and y - rr >= 0 and y + rr <= 390) as off from p)"


def placed(spark, d):
    n = F.col("l_linenumber") % 3
    return dense(spark, d).select("catalog_id", "frame_id", "l_orderkey", "l_linenumber", F.col("mag").alias("mag_inst"), (F.col("peak") * 20).cast("double").alias("x"), (F.col("err") * 5000).alias("y"), F.when(n == 1, -1.0).when(n == 2, 60.0).alias("sky_annulus_r_out_px"), F.lit("normal").alias("flag"))


@query("f9_edge_rows", f"with {DENSE}, {EDGE} select catalog_id, frame_id, count(*) as n, count(*) filter (where off) as n_off, round(sum(case when not off then mag end), 4) as total from q group by 1, 2")
def _(spark, d):
    t = selection.without_edge_rows(placed(spark, d), width=990.0, height=390.0)
    return rounded(t.groupBy("catalog_id", "frame_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "edge_fail").alias("n_off"), F.sum("mag_inst").alias("total")), 4)


@query("f15_edge_vote", f"with {DENSE}, {EDGE} select catalog_id, count(*) as n_frames, count(*) filter (where off) as n_edge from q group by 1 having count(*) >= 10 and count(*) filter (where off) / count(*) > 0.25")
def _(spark, d):
    return selection.edge_vote(placed(spark, d), width=990.0, height=390.0, share=0.25)


@query("f10_edge_safe", f"with {SKY} select vec_id, x >= 455.0 and x <= 1000 - 455.0 and y >= 455.0 and y <= 1000 - 455.0 as safe from sky")
def _(spark, d):
    return sky(spark, d).select("vec_id", selection.edge_safe(F.col("x"), F.col("y"), 1000.0, 1000.0, 50.0).alias("safe"))


@query("f18_f19_j22_profile_stars", f"with {SKY}, s as (select * from sky where vec_id % 5 = 0 and vec_id % 3 = 1 and vec_id % 2 = 0) select vec_id as catalog_id from s where vec_id % 7 = 0 or vec_id % 7 = 1")
def _(spark, d):
    v = F.col("vec_id")
    t = sky(spark, d).select(v.alias("catalog_id"), F.when(v % 5 == 0, "False").when(v % 5 == 1, "").alias("catalog_known_variable"), F.when(v % 3 == 1, "no").when(v % 3 == 2, "yes").alias("likely_saturated"), F.when(v % 2 == 0, " TRUE").alias("photometry_ok"))
    sources = sky(spark, d).select(v.alias("catalog_id"), "x", "y", F.when(v % 7 <= 1, 1).alias("is_safe_comp"), F.lit(" ").alias("exclusion_reason"))
    return selection.safe_comparisons(sources, selection.profile_stars(t)).select("catalog_id")


@query("f19_profile_comparisons", f"with {SKY}, c as (select * from sky where label <> 0 and not (label = 5 and vec_id % 2 = 0)) select vec_id as catalog_id from c a where not exists (select 1 from c b where b.vec_id <> a.vec_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 4.0)")
def _(spark, d):
    s = sky(spark, d).select(F.col("vec_id").alias("catalog_id"), "label", "x", "y", F.when((F.col("label") == 5) & (F.col("vec_id") % 2 == 0), 50_000.0).when(F.col("label") == 6, 100.0).alias("peak"))
    return selection.profile_comparisons(s, s.where("label = 0"), separation=4.0).select("catalog_id")


@query("f20_a25_reportable_fits", f"with {DENSE}, r as (select *, segment = 'R' as var, peak * 3 as chi2, l_linenumber % 5 <> 0 as conv from dense), k as (select *, conv and chi2 < case when var then 1000 else 20 end as ok from r) select catalog_id, var, count(*) as n_frames, count(*) filter (where ok) as n_ok, round(median(flux) filter (where ok), 6) as med from k group by 1, 2")
def _(spark, d):
    r = dense(spark, d).withColumn("role", F.when(F.col("segment") == "R", " var").otherwise("COMP"))
    ok = selection.reportable_fit(F.col("role"), F.when(F.col("l_linenumber") % 5 != 0, "yes"), F.col("flux"), F.col("peak") * 3)
    return rounded(r.withColumn("ok", ok).groupBy("catalog_id", (F.col("segment") == "R").alias("var")).agg(F.count("*").alias("n_frames"), F.count_if("ok").alias("n_ok"), F.median(F.when(F.col("ok"), F.col("flux"))).alias("med")))


@query("x37_nonlinear_stars", f"with {DENSE}, r as (select *, quantile_cont(peak, 0.8) over (partition by frame_id) as lim, median(err) over (partition by frame_id) as mid from dense) select catalog_id, count(*) filter (where peak >= lim and mid > 0 and err > 1.25 * mid) as n_wide, count(*) filter (where peak in (7, 9)) as n_bad, count(*) filter (where not (peak >= lim and mid > 0 and err > 1.25 * mid) and peak not in (7, 9) and l_linenumber <> 2) as n_ok from r group by 1")
def _(spark, d):
    r = dense(spark, d).select("catalog_id", "frame_id", F.col("peak").cast("double").alias("x"), F.col("peak").cast("double").alias("peak_max_adu"), F.col("err").alias("fwhm"), F.when(F.col("l_linenumber") == 2, False).alias("photometry_ok"))
    bad = expr.binned_columns(F.array(F.lit(14), F.lit(15), F.lit(18)), F.lit(2), F.lit(1))
    t = selection.nonlinear_stars(r, bad_columns=bad)
    return t.groupBy("catalog_id").agg(F.count_if("likely_nonlinear").alias("n_wide"), F.count_if("on_bad_column").alias("n_bad"), F.count_if("photometry_ok").alias("n_ok"))


# ---------------------------------------------------------------- matching


@query("j11_priority_matching")
def _(spark, d):
    s = sky(spark, d)
    p = spatial.plane_pairs(s.where("label % 2 = 0").select("vec_id", "x", "y", "mag"), s.where("label % 2 = 1").select("vec_id", "x", "y"), 30.0)
    return rounded(matching.by_priority(p.select("l_vec_id", "r_vec_id", "distance", "l_mag"), "l_vec_id", "r_vec_id", ["l_mag"]).select("l_vec_id", "r_vec_id", "distance"))


@query("j12_id_else_place")
def _(spark, d):
    s = sky(spark, d)
    rows = s.select(F.col("vec_id").cast("string").alias("catalog_id"), "x", "y", (F.col("mag") - 13).alias("flux"), (F.col("mag") * -1 + 3).alias("mag"))
    targets = s.select(F.col("vec_id").alias("id"), F.lit("star").alias("name"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id").cast("string")).alias("catalog_id"), (F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y"))
    return rounded(matching.id_else_place(targets, rows))


@query("j21_o7_residuals", f"with {SKY}, m as (select vec_id as k, x + 0.1 * (vec_id % 7) as x, y - 0.1 * (vec_id % 5) as y from sky), r as (select 0.1 * (vec_id % 7) as dx0, m.x - s.x as dx, m.y - s.y as dy, sqrt(pow(m.x - s.x, 2) + pow(m.y - s.y, 2)) as dr from m join sky s on s.vec_id = m.k) select count(*) as n, round(median(dx), 5) as dx_median, round(median(dy), 5) as dy_median, round(sqrt(avg(dr * dr)), 5) as rms, round(quantile_cont(dr, 0.5), 5) as p50, round(quantile_cont(dr, 0.9), 5) as p90, round(quantile_cont(dr, 0.99), 5) as p99, round(max(dr), 5) as dr_max from r")
def _(spark, d):
    v = F.col("vec_id")
    s = sky(spark, d)
    m = s.select(F.lit("star").alias("name"), F.concat(F.lit(" "), v.cast("string")).alias("catalog_id"), (F.col("x") + 0.1 * (v % 7)).alias("x"), (F.col("y") - 0.1 * (v % 5)).alias("y"))
    found = matching.residual_statistics(matching.residuals(m, s.select(v.cast("string").alias("catalog_id"), "x", "y")))
    return rounded(found.drop("dx_spread", "dy_spread"), 5)


@query("j25_known_variables", "with l as (select user_id, max_by(event_type, event_id) as t, max_by(cast(event_id as varchar), event_id) as n from events where user_id % 3 > 0 group by 1) select c_custkey, l.user_id is not null as vsx_match, coalesce(n, '') as vsx_name, coalesce(t, '') as vsx_type from customer left join l on user_id = c_custkey")
def _(spark, d):
    targets = read(spark, d, "events").where("user_id % 3 > 0").select(F.col("user_id").cast("string").alias("catalog_id"), F.col("event_id").cast("string").alias("vsx_name"), F.col("event_type").alias("vsx_type"), "event_id")
    own = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("catalog_id"))
    return matching.known_variables(own, targets, "event_id").drop("catalog_id")


@query("j27_flips", "with r as (select strftime(o_orderdate, '%Y-%m-%d') as stem, max((o_orderkey % 50 = 0)::int) = 1 as flip from orders group by 1), f as (select distinct cast(l_shipdate as varchar)[1:10] as frame_id from lineitem) select frame_id, coalesce(flip, false) as is_flipped from f left join r on stem = frame_id")
def _(spark, d):
    report = read(spark, d, "orders").select(F.concat(F.lit("/data/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".fits ")).alias("file"), F.when(F.col("o_orderkey") % 50 == 0, True).alias("is_flipped"))
    return matching.with_flips(read(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("frame_id")).distinct(), report)


def detections(spark, d):
    s, v = sky(spark, d), F.col("vec_id")
    shifted = s.where("label % 2 = 0").select(v.alias("id"), "x", "y", (F.col("ra_deg") + (v % 5) * 0.0006).alias("ra_deg"), (F.col("dec_deg") - (v % 3) * 0.0006).alias("dec_deg"))
    return shifted, s.select(v.alias("source_id"), "x", "y", "ra_deg", "dec_deg")


@query("j28_adaptive_rematch")
def _(spark, d):
    found, catalogue = detections(spark, d)
    return rounded(matching.rematch(found, catalogue, centre=(500.0, 500.0), farthest=120.0), 4)


def index(spark, d):
    return matching.triangle_index(sky(spark, d).select(F.col("vec_id").alias("id"), "ra_deg", "dec_deg"), radius_deg=2.0)


@query("s22_j31_triangle_index", f"""with {SKY}, u as (select *, cos(radians(dec_deg)) * cos(radians(ra_deg)) as ux, cos(radians(dec_deg)) * sin(radians(ra_deg)) as uy, sin(radians(dec_deg)) as uz from sky), n as (select a.vec_id as id, b.vec_id as o from sky a join sky b on {HAVERSINE} <= 2.0 qualify row_number() over (partition by a.vec_id order by {HAVERSINE}, b.vec_id) <= 8),
    t as (select p.id as a, q.o as b, r.o as c from n p join n q on q.id = p.id and q.o > p.id join n r on r.id = p.id and r.o > q.o where p.o = p.id), s as (select t.*, list_sort([sqrt(pow(x.ux - y.ux, 2) + pow(x.uy - y.uy, 2) + pow(x.uz - y.uz, 2)), sqrt(pow(y.ux - z.ux, 2) + pow(y.uy - z.uy, 2) + pow(y.uz - z.uz, 2)), sqrt(pow(x.ux - z.ux, 2) + pow(x.uy - z.uy, 2) + pow(x.uz - z.uz, 2))]) as l from t join u x on x.vec_id = a join u y on y.vec_id = b join u z on z.vec_id = c)
    select a as id0, b as id1, c as id2, round(l[1] / l[3], 5) as r1, round(l[2] / l[3], 5) as r2, round(log10(l[3]) + log10(180 / pi() * 3600), 5) as log_size from s where l[3] > 0 and l[1] / l[3] >= 0.15""")
def _(spark, d):
    return rounded(index(spark, d).select("id0", "id1", "id2", "r1", "r2", "log_size"), 5)


def votes(spark, d):
    own = cut(index(spark, d))
    queries = own.select(F.concat_ws("-", "id0", "id1", "id2").alias("q"), "r1", "r2", "log_size").where("id0 < 60")
    return matching.shape_votes(queries, own, low=2.0, high=4.5)


@query("j30_shape_votes")
def _(spark, d):
    return rounded(votes(spark, d), 5)


@query("a42_vote_position")
def _(spark, d):
    return rounded(matching.vote_cluster(votes(spark, d)), 5)


@query("j31_flat_triangles", f"with {SKY}, t as (select vec_id, x, y from sky order by mag, vec_id limit 30), s as (select a.vec_id as i, b.vec_id as j, c.vec_id as k, list_sort([sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)), sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2))]) as l from t a join t b on a.vec_id < b.vec_id join t c on b.vec_id < c.vec_id) select i, j, k, round(l[1] / l[3], 5) as r1, round(l[2] / l[3], 5) as r2, round(log10(l[3]) + log10(9.7), 5) as log_size from s where l[3] >= 2.0 and l[1] / l[3] >= 0.15")
def _(spark, d):
    s = sky(spark, d).select(F.col("vec_id").alias("id"), "x", "y", "mag")
    return rounded(matching.flat_triangles(s, scale_arcsec=9.7), 5)


# ---------------------------------------------------------------- scalar functions


@query("x10_x11_x33_times", "select event_id, strftime(ts, '%H:%M') as hm, round(epoch(ts) / 86400.0 + 2440587.5 + coalesce(case when event_id % 3 > 0 then value end, 0) / 2 / 86400.0, 3) as mid, case when event_id % 11 = 0 then 'Missing' when event_id % 70 > greatest(1.0, 50.0) then 'Expired' when event_id % 70 >= 0.8 * 50 then 'Warning' else 'OK' end as status from (select event_id, value, date_trunc('second', ts) as ts from events)")
def _(spark, d):
    ts, k = F.date_trunc("second", "ts"), F.col("event_id")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    mid = expr.mid_exposure_of(F.when(k % 2 == 0, text).otherwise(F.substring(text, 1, 10)), F.substring(text, 12, 8), F.when(k % 3 > 0, F.col("value")))
    then = F.when(k % 11 != 0, F.lit("2024-06-01").cast("timestamp"))
    age = expr.age_days(F.date_add(F.lit("2024-06-01").cast("date"), (k % 70).cast("int")), then)
    return read(spark, d, "events").select("event_id", expr.hours_minutes(expr.julian_day(ts)).alias("hm"), F.round(mid, 3).alias("mid"), expr.validity(age, 50.0).alias("status"))


@query("x13_x14_pointings", "with t as (select s_suppkey as k, s_suppkey % 24 as h, s_suppkey % 60 as m, (s_suppkey * 7 % 600) / 10.0 as s from supplier) select k, round(case when k % 4 = 0 then h + 0.5 else (h + m / 60.0 + s / 3600.0) * 15 end, 6) as ra, round(case when k % 2 = 0 then -1 else 1 end * (h + m / 60.0 + s / 3600.0), 6) as dec, case when k % 3 = 0 then 'header' else 'target' end as origin from t")
def _(spark, d):
    k = F.col("s_suppkey")
    parts = (F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.format_string("%04.1f", (k * 7 % 600) / 10.0))
    gap = F.when(k % 4 == 2, ":").otherwise(" ")
    ra = F.when(k % 4 == 0, ((k % 24) + 0.5).cast("string")).when(k % 4 == 1, F.concat(parts[0], F.lit("h"), parts[1], F.lit("m"), parts[2], F.lit("s"))).otherwise(F.concat(parts[0], gap, parts[1], gap, parts[2]))
    dec = F.concat(F.when(k % 2 == 0, "-").otherwise("+"), parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2])
    t = read(spark, d, "supplier").select(k.alias("k"), expr.sexagesimal(ra, hours=True).alias("ra"), expr.sexagesimal(dec, hours=False).alias("dec"))
    best = expr.first_pair((F.when(F.col("k") % 3 != 0, F.col("ra")), F.col("dec")), (F.col("ra") + 360, F.col("dec")))
    t = t.withColumn("p", best)
    return rounded(t.select("k", "ra", "dec", F.when(F.col("p.ra_deg") > F.col("ra"), "header").otherwise("target").alias("origin")))


@query("x17_x18_x40_optics", """with t as (select p_partkey as k, p_size / 5.0 as um, p_retailprice * 1.5 as mm from part), s as (select *, case when mm between 1750 and 2250 then mm / 10 else mm end as f from t), c as (select *, 206.265 * um / f as sc from s)
    select k, round(f, 5) as focal, round(greatest(3.0, sc * 2.5), 5) as tolerance, round(greatest(0.03, sc * 8.0 / 9.55), 5) as low, round(greatest(0.08, 0.5 * sqrt(pow(2082 * sc / 3600, 2) + pow(1397 * sc / 3600, 2)) * 1.3, greatest(0.08, least(3.5, 600.0 / mm))), 5) as cone, round(abs((sc + sc * 1.2) / 2 - sc) / sc * 100, 4) as err, true as ok from c""")
def _(spark, d):
    um, mm = F.col("p_size") / 5.0, F.col("p_retailprice") * 1.5
    sc = expr.plate_scale(um, expr.focal_length(mm))
    q = expr.matrix_quality(-sc / 3600, sc * 1.2 / 3600, sc)
    t = read(spark, d, "part").select(F.col("p_partkey").alias("k"), expr.focal_length(mm).alias("focal"), expr.match_tolerance(sc).alias("tolerance"), expr.scale_bounds(sc)["low"].alias("low"), expr.optics_cone_radius(F.lit(2082.0), F.lit(1397.0), um, mm).alias("cone"), F.round(q["scale_err_pct"], 4).alias("err"), q["ok"].alias("ok"))
    return rounded(t, 5)


@query("x22_x34_lookups", "select p_partkey, case when p_size % 7 = 0 then '4,4,2,2,10' when m < 8 then '7,7,7,7,20' when m < 10 then '8,8,5,5,20' when m < 13 then '6,6,3,3,14' when m < 15.5 then '4,4,2,2,10' else '5,5,1,1,10' end as sizes, cast(p_size // greatest(1, p_size % 4) as varchar) as bad from (select p_partkey, p_size, 5 + p_size / 4.0 as m from part)")
def _(spark, d):
    s = F.col("p_size")
    sizes = expr.aperture_parameters(F.when(s % 7 != 0, 5 + s / 4.0))
    bad = expr.binned_columns(F.array(s, s), s % 4, F.lit(1))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return read(spark, d, "part").select("p_partkey", text(sizes).alias("sizes"), text(bad).alias("bad"))


@query("x25_best_period", "with m as (select user_id, event_type as c, event_id as position, case when event_id % 4 > 0 then value - 10 end as period from events) select user_id, round(min_by(period, (case c when 'purchase' then 1 when 'view' then 2 else 4 end, case when c in ('purchase', 'view') then '' else c end, position)), 6) as period from m where period > 0 group by 1")
def _(spark, d):
    m = read(spark, d, "events").select("user_id", F.col("event_type").alias("catalog"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 4 > 0, F.col("value") - 10).alias("period"))
    return rounded(matching.best_catalogue_period(m, "user_id", ("purchase", "view", "none")))


@query("x26_x28_summaries", """select s_suppkey, case when k = 0 then s_name when k = 1 then 'EA · dr=' || printf('%.2f', d) || '"' when k = 2 then 'P=' || regexp_replace(printf('%.4f', p), '0+$', '') || 'd' else 'amp=0.25' end as summary, 'https://example.org/?c=' || printf('%.6f', s_suppkey / 7.0) || '%20' || printf('%.6f', -s_suppkey / 3.0) || '&-c.rs=2' as link from (select *, s_suppkey % 4 as k, s_suppkey % 100 / 8.0 as d, 1 + (s_suppkey % 8) / 8.0 as p from supplier)""")
def _(spark, d):
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey")
    text = expr.match_summary(F.col("s_name"), F.when(k == 1, "EA"), F.when(k == 2, 1 + (n % 8) / 8.0), F.when(k == 3, 0.25), F.when(k == 1, n % 100 / 8.0))
    return read(spark, d, "supplier").select("s_suppkey", text.alias("summary"), expr.catalogue_link(n / 7.0, -n / 3.0, "https://example.org/?c=").alias("link"))


@query("x27_flag_labels", "select s_suppkey, concat_ws(', ', case when s_suppkey % 2 = 1 then 'pulsating' end, case when s_suppkey % 3 = 0 then 'eclipsing' end, case when s_acctbal > 0 then 'rotating' end) as labels from supplier")
def _(spark, d):
    n = F.col("s_suppkey")
    flags = {"pulsating": n % 2 == 1, "eclipsing": F.when(n % 3 == 0, "Y").otherwise(" -- "), "rotating": F.col("s_acctbal")}
    return read(spark, d, "supplier").select("s_suppkey", expr.labels(flags).alias("labels"))


@query("x32_x21_names", "select p_partkey, case p_partkey % 3 when 0 then p_partkey when 1 then p_partkey % 1000 end as draft, replace(replace(p_type, ' ', ''), '/', '-') as token, replace(p_brand, '#', '_') || '_1_2' as folder from part")
def _(spark, d):
    p = F.col("p_partkey")
    text = F.when(p % 3 == 0, F.concat(F.lit("'"), p.cast("string"), F.lit("'"))).when(p % 3 == 1, F.concat(F.lit("/x/Draft_"), F.lpad((p % 1000).cast("string"), 6, "0"), F.lit("/y"))).otherwise("none")
    return read(spark, d, "part").select("p_partkey", expr.draft_id(text).alias("draft"), expr.token(F.col("p_type")).alias("token"), expr.folder_name(expr.group_key(F.col("p_brand"), F.lit(1.0), F.lit(2))).alias("folder"))


@query("x35_x36_polynomials", f"with {SKY}, n as (select vec_id, (x - 500) / 20 as u, (y - 500) / 30 as v from sky) select vec_id, round(1 + 2 * u + 3 * v + 4 * (u*u + v*v) + 5 * u * v + 6 * u * (u*u + v*v) + 7 * v * (u*u + v*v) + 8 * pow(u*u + v*v, 2), 4) as shift, round(u * u + u * v + v * v + u*u*u + u*u*v + u*v*v + v*v*v, 5) as total from n")
def _(spark, d):
    u, v = (F.col("x") - 500) / 20, (F.col("y") - 500) / 30
    terms = expr.distortion_terms(u, v, 3)
    total = F.aggregate(F.map_values(terms), F.lit(0.0), lambda a, x: a + x)
    return sky(spark, d).select("vec_id", F.round(expr.displacement(F.col("x"), F.col("y"), (500.0, 500.0, 20.0, 30.0), [1, 2, 3, 4, 5, 6, 7, 8]), 4).alias("shift"), F.round(total, 5).alias("total"))


@query("x38_maps_and_headers", "select event_id, case when event_id % 3 = 0 then value when event_id % 3 = 1 and user_id > 5 then cast(user_id as double) else 1.0 end as gain, case when event_id % 3 = 0 then 'DB' when event_id % 3 = 1 and user_id > 5 then 'FITS EGAIN' else 'fallback' end as source, case when value > 50 then round(value, 6) end as fwhm from events where value > 0")
def _(spark, d):
    k = F.col("event_id")
    header = F.map_from_entries(F.array(F.struct(F.lit("EGAIN"), F.when(k % 3 == 1, F.when(F.col("user_id") > 5, F.col("user_id").cast("string")).otherwise("x"))), F.struct(F.lit("VY_FWHM"), F.when(F.col("value") > 50, F.col("value")).otherwise(-1.0).cast("string"))))
    e = read(spark, d, "events").where("value > 0").withColumn("h", header)
    g = expr.gain_of(F.col("h"), F.when(k % 3 == 0, F.col("value")))
    return e.select("event_id", g["gain"].alias("gain"), g["source"].alias("source"), F.round(expr.positive_of(F.col("h"), "VY_FWHM"), 6).alias("fwhm"))


@query("json_round_trip", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, '{\"k\":' || cast(json_extract(props, '$.k') as varchar) || '}' as again from events")
def _(spark, d):
    t = read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return t.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


@query("x8_x23_offsets_and_model", f"with {SKY}, o as (select vec_id, (((ra_deg - 359.0 + 540) % 360.0) - 180) as dra, dec_deg, (x / 100) % 1.0 as ph from sky) select vec_id, round(sqrt(pow(dra * cos(radians(1.0)), 2) + pow(dec_deg - 1.0, 2)), 6) as away, round(12 + 0.5 * exp(1 - cosh((ph - round(ph)) / 0.1)) + 0.02 * cos(2 * pi() * ph), 6) as model from o")
def _(spark, d):
    ph = (F.col("x") / 100) % 1.0
    t = sky(spark, d).select("vec_id", expr.planar_offset(F.col("ra_deg"), F.col("dec_deg"), F.lit(359.0), F.lit(1.0)).alias("away"), expr.eclipse_model(ph, F.lit(12.0), F.lit(0.5), F.lit(0.1), (0.02, 0.0, 0.0)).alias("model"))
    return rounded(t)


@query("sql_functions", "select s_suppkey, round(case when s_acctbal > 0 then -2.5 * log10(s_acctbal) end, 6) as mag, round(206.265 * 9.0 / (s_suppkey + 100), 6) as scale from supplier")
def _(spark, d):
    from skylattice.functions.registry import register

    register(spark)
    return rounded(read(spark, d, "supplier").selectExpr("s_suppkey", "sky_magnitude(s_acctbal) as mag", "sky_plate_scale(9.0D, cast(s_suppkey + 100 as double)) as scale"))


# ---------------------------------------------------------------- streams


@query("stream_once_within", "select event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("t"))
    return ingest.once_within(e, "t", ["user_id", "event_type"]).select("event_id")


# ---------------------------------------------------------------- catalogues


CATALOGUE = "cat as (select p_partkey as source_id, case when p_partkey % 3 > 0 then p_size / 20.0 end as bp_rp, case when p_partkey % 5 > 0 then p_retailprice / 100 end as bp_mag, p_size / 10.0 as rp_mag, p_retailprice / 90 as g_mag from part)"


@query("s9_j5_rows_by_id", f"""with {CATALOGUE}, ids as (select distinct l_partkey as k from lineitem where l_quantity > 49 and l_linenumber <> 2)
    select cast(source_id as varchar) as source_id, round(cast(coalesce(bp_rp, bp_mag - rp_mag) as double), 6) as bp_rp, round(g_mag, 6) as g_mag from cat where source_id in (select k from ids)""")
def _(spark, d):
    k = F.col("p_partkey")
    cat = read(spark, d, "part").select(k.alias("source_id"), F.when(k % 3 > 0, F.col("p_size") / 20.0).alias("bp_rp"), F.when(k % 5 > 0, F.col("p_retailprice") / 100).alias("bp_mag"), (F.col("p_size") / 10.0).alias("rp_mag"), (F.col("p_retailprice") / 90).alias("g_mag"))
    n, text = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    ids = read(spark, d, "lineitem").where("l_quantity > 49").select(F.when(n == 2, F.concat(F.lit("DET_"), text)).when(n % 2 == 1, F.concat(text, F.lit(".0"))).otherwise(F.concat(F.lit(" "), text)).alias("source_id"))
    return rounded(catalogues.rows_by_id(ids, cat))


@query("j6_colour_fallback", f"""with {SKY}, s as (select vec_id, ra_deg, dec_deg, mag, case when vec_id % 3 = 0 then label / 5.0 end as own from sky), c as (select vec_id as source_id, ra_deg, dec_deg, mag as g_mag, case when vec_id % 4 > 0 then 0.1 + label / 8.0 end as bp_rp from sky where vec_id % 2 = 1),
    n as (select a.vec_id, b.bp_rp from s a join c b on a.own is null and abs(((b.ra_deg - a.ra_deg + 540) % 360.0) - 180) <= 0.6 and abs(b.dec_deg - a.dec_deg) <= 0.6 and abs(b.g_mag - a.mag) < 0.5
      qualify row_number() over (partition by a.vec_id order by {HAVERSINE}, b.source_id) = 1), r as (select s.vec_id, coalesce(own, n.bp_rp) as colour, own, n.bp_rp as found from s left join n using (vec_id))
    select vec_id, round(cast(colour as double), 6) as bp_rp, round(cast(case when colour between 0.1 and 2.5 then 0.0850 + 0.9447 * colour - 0.1019 * colour * colour end as double), 6) as b_v, case when own is not null then 'own' when found is not null then 'catalogue' end as colour_source from r""")
def _(spark, d):
    s, k = sky(spark, d), F.col("vec_id")
    own = s.select("vec_id", "ra_deg", "dec_deg", "mag", F.when(k % 3 == 0, F.col("label") / 5.0).alias("bp_rp"))
    cat = s.where("vec_id % 2 = 1").select(k.alias("source_id"), "ra_deg", "dec_deg", F.col("mag").alias("g_mag"), F.when(k % 4 > 0, 0.1 + F.col("label") / 8.0).alias("bp_rp"))
    return rounded(catalogues.with_colours(own, cat, "vec_id", radius_deg=0.6, max_dmag=0.5).select("vec_id", "bp_rp", "b_v", "colour_source"))


@query("a45_psf_against_aperture", f"""with {DENSE}, u as (select catalog_id, flux as aperture, flux * (1 + err * cast(l_linenumber % 3 as int)) - 900 as psf from dense where segment <> 'R' and catalog_id % 3 > 0 and flux > 0 and flux * (1 + err * cast(l_linenumber % 3 as int)) - 900 > 0),
    t as (select catalog_id, count(*) as n, 100 * stddev_samp(aperture) / avg(aperture) as a, 100 * stddev_samp(psf) / avg(psf) as p from u group by 1 having count(*) >= 2)
    select catalog_id, n, round(a, 6) as aperture_pct, round(p, 6) as psf_pct, p < a as better, round((select avg(case when p < a then 1.0 else 0.0 end) from t), 6) as share_better from t""")
def _(spark, d):
    x = dense(spark, d).select("catalog_id", "segment", F.col("flux").alias("aperture"), (F.col("flux") * (1 + F.col("err") * (F.col("l_linenumber") % 3)) - 900).alias("psf"))
    return rounded(catalogues.steadier(x, "aperture", "psf", (F.col("segment") != "R") & (F.col("catalog_id") % 3 > 0)))


@query("j17_inner_metadata", "select o_orderkey, c_name, n_name, round(o_totalprice, 6) as o_totalprice from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_custkey % 3 > 0")
def _(spark, d):
    named = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).where("c_custkey % 3 > 0")
    return rounded(read(spark, d, "orders").join(named, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice"))


@query("j5_approved_comparisons", f"""with {STARS}, l as (select nation, catalog_id, mag as g_mag, case when catalog_id % 5 > 0 then catalog_id % 2 = 0 end as is_safe, case when catalog_id % 3 > 0 then 'Approved' else 'Rejected' end as verdict from stars)
    select nation, catalog_id, round(g_mag, 6) as g_mag, row_number() over (partition by nation order by g_mag, catalog_id) as place from l where is_safe and verdict = 'Approved' and nation in (select n_nationkey from nation where n_regionkey <> 2)""")
def _(spark, d):
    k = F.col("catalog_id")
    library = stars(spark, d).select("nation", "catalog_id", F.col("mag").alias("g_mag"), F.when(k % 5 > 0, k % 2 == 0).alias("is_safe"), F.when(k % 3 > 0, "Approved").otherwise("Rejected").alias("verdict"))
    fields = read(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("nation"))
    return rounded(catalogues.approved(library, fields, "nation").select("nation", "catalog_id", "g_mag", "place"))
