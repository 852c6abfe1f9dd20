"""Matching of detections with catalogues: by priority, by growing radius, by triangle shapes and votes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import at_most, clean, exact_id, haversine, preferred_id, triangle_shape, unit_vector
from skylattice.operators.greedy import greedy
from skylattice.operators.shared import cut, group_quantiles
from skylattice.operators.spatial import nearest, nearest_on_sky, plane_pairs, sky_pairs


def by_priority(pairs: DataFrame, left: str, right: str, priority: list[str]) -> DataFrame:
    """One-to-one pairs as if each left row, in the order of its priority (columns, first wins, then its id), took its nearest
    free right row. pairs: left, right, distance, priority columns; see greedy()."""
    return greedy(pairs, left, right, [*priority, left, "distance", right])


def id_else_place(targets: DataFrame, rows: DataFrame, *, radius: float = 18.0, brightest: float = -8.0) -> DataFrame:
    """The measured row of each target (id, name, catalog_id, x, y): by the id its name or catalog_id gives; those without
    such a row by the nearest one with flux within radius. id, found, how, distance, mag.

    A row found by place whose instrumental magnitude isn't above `brightest` in number loses its magnitude: such a match
    is no star of the field.
    """
    own = rows.select(exact_id(F.col("catalog_id")).alias("found"), "x", "y", "flux", "mag")
    asked = targets.withColumn("_key", preferred_id(F.col("name"), F.col("catalog_id")))
    exact = asked.join(own.select("found", F.col("mag").alias("_mag")), F.col("_key") == F.col("found")).select("id", "found", F.lit("id").alias("how"), F.lit(0.0).alias("distance"), F.col("_mag").alias("mag"))
    lost = asked.join(own.select("found"), F.col("_key") == F.col("found"), "left_anti").select("id", "x", "y")
    pairs = plane_pairs(lost, own.where(F.col("flux") > 0), radius)
    near = nearest(pairs, "l_id", "r_found").select(F.col("l_id").alias("id"), F.col("r_found").alias("found"), F.lit("place").alias("how"), "distance", F.when(F.col("r_mag") <= brightest, F.col("r_mag")).alias("mag"))
    return exact.unionByName(near)


def residuals(matched: DataFrame, catalogue: DataFrame) -> DataFrame:
    """catalog_id, dx, dy, dr between matched stars (name, catalog_id, x, y) and a catalogue (catalog_id, x, y) by id."""
    own = matched.withColumn("_k", preferred_id(F.col("name"), F.col("catalog_id"))).where("_k is not null")
    other = catalogue.select(exact_id(F.col("catalog_id")).alias("_k"), F.col("x").alias("_x"), F.col("y").alias("_y")).where("_k is not null")
    other = other.groupBy("_k").agg(F.min(F.struct("_x", "_y")).alias("_p")).select("_k", "_p.*")
    t = own.join(other, "_k")
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    return t.select(F.col("_k").alias("catalog_id"), dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("dr"))


def residual_statistics(found: DataFrame) -> DataFrame:
    """One row of residuals (dx, dy, dr): n, medians, spreads, rms and quantiles."""
    t = cut(found.where(clean(F.col("dr")).isNotNull()))
    middle = t.agg(F.median("dx").alias("dx_median"), F.median("dy").alias("dy_median"))
    m = t.crossJoin(F.broadcast(middle))
    spread = m.agg(F.count("*").alias("n"), F.max("dx_median").alias("dx_median"), F.max("dy_median").alias("dy_median"), (1.4826 * F.median(F.abs(F.col("dx") - F.col("dx_median")))).alias("dx_spread"), (1.4826 * F.median(F.abs(F.col("dy") - F.col("dy_median")))).alias("dy_spread"), F.sqrt(F.avg(F.col("dr") * F.col("dr"))).alias("rms"), F.max("dr").alias("dr_max"))
    return spread.crossJoin(group_quantiles(t, "dr", [], {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("n"))


def worst(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(n)


def known_variables(stars: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """stars with vsx_match, vsx_name and vsx_type of the last target row of their id; unmatched ones have empty texts."""
    last = targets.withColumn("_id", exact_id(F.col("catalog_id"))).where("_id is not null").groupBy("_id").agg(F.max_by(F.struct(F.coalesce("vsx_name", F.lit("")).alias("n"), F.coalesce("vsx_type", F.lit("")).alias("t")), order).alias("_v"))
    t = stars.join(last, F.col("catalog_id") == F.col("_id"), "left")
    return t.select(*stars.columns, F.col("_id").isNotNull().alias("vsx_match"), F.coalesce("_v.n", F.lit("")).alias("vsx_name"), F.coalesce("_v.t", F.lit("")).alias("vsx_type"))


def with_flips(frames: DataFrame, report: DataFrame) -> DataFrame:
    """frames (frame_id, …) with is_flipped of the report's row (file) whose file name begins with the frame; else false."""
    stem = F.regexp_extract(F.element_at(F.split(F.trim("file"), r"[/\\]"), -1), r"^(.*?)(\.[^.]*)?$", 1)
    own = report.where(F.trim("file") != "").groupBy(stem.alias("_stem")).agg(F.max(F.coalesce("is_flipped", F.lit(False))).alias("_flip"))
    return frames.join(own, F.col("frame_id") == F.col("_stem"), "left").select(*frames.columns, F.coalesce("_flip", F.lit(False)).alias("is_flipped"))


# Fixed values, in pixels and arc seconds: without edges the radius grows by r / max(300, farthest / 5), 2.5 at most; with
# edges by r / max(120, farthest / 8.5), and it is not below 10 rising to 15 beyond 800 pixels, nor below 10 in the outer tenth.
TIGHT_GROWTH, TIGHT_MOST, EDGE_GROWTH = (300.0, 5.0), 2.5, (120.0, 8.5)
EDGE_FROM, EDGE_LEAST, EDGE_RISE, OUTER = 800.0, 10.0, 5.0, 0.9


def growing_radius(r: Column, base: float, farthest: float, *, edges: bool) -> Column:
    """Match radius in arc seconds at r pixels from the centre: tight, or growing to the corners."""
    least, share = EDGE_GROWTH if edges else TIGHT_GROWTH
    grown = r / max(least, farthest / share)
    if not edges:
        return max(0.5, base) + at_most(grown, TIGHT_MOST)
    risen = EDGE_LEAST + EDGE_RISE * F.least((r - EDGE_FROM) / max(1.0, farthest - EDGE_FROM), F.lit(1.0))
    # a lower bound that doesn't hold at r is NULL, and greatest() passes over it
    return F.greatest(max(0.5, base) + grown, F.when(r > EDGE_FROM, risen), F.when(r >= OUTER * farthest, EDGE_LEAST))


def rematch(detections: DataFrame, catalogue: DataFrame, *, centre: tuple[float, float], farthest: float, rounds: int = 5, base: float = 6.0) -> DataFrame:
    """id, source_id, sep_arcsec, pass: detections (id, x, y, ra_deg, dec_deg) matched with free catalogue stars
    (source_id, x, y, ra_deg, dec_deg) in shrinking rounds, first tightly, then with a radius that grows to the corners.

    In a pass detections come in the order of their ids and take the star nearest in pixels among those within their
    radius on the sky. Two passes that add nothing in two rounds end the work.
    """
    r = F.sqrt(F.pow(F.col("x") - centre[0], 2) + F.pow(F.col("y") - centre[1], 2))
    widest = 15.0 + base + farthest / max(120.0, farthest / 8.5)
    pairs = sky_pairs(detections.withColumn("r", r), catalogue, widest / 3600.0)
    pixels = F.sqrt(F.pow(F.col("l_x") - F.col("r_x"), 2) + F.pow(F.col("l_y") - F.col("r_y"), 2))
    pairs = cut(pairs.select(F.col("l_id").alias("id"), F.col("r_source_id").alias("source_id"), F.col("l_r").alias("r"), (F.col("distance") * 3600.0).alias("sep_arcsec"), pixels.alias("distance")))
    done, idle = None, 0
    for k in range(rounds):
        added = 0
        for edges in (False, True):
            open_ = pairs if done is None else pairs.join(done.select("id"), "id", "left_anti").join(done.select("source_id"), "source_id", "left_anti")
            near = open_.where(F.col("sep_arcsec") <= growing_radius(F.col("r"), base - k, farthest, edges=edges))
            new = cut(by_priority(near.withColumn("_order", F.col("id")), "id", "source_id", ["_order"]).select("id", "source_id", "sep_arcsec", F.lit(2 * k + int(edges)).alias("pass")))
            n = new.count()
            added += n
            if n:
                done = new if done is None else done.unionByName(new)
        idle = idle + 1 if not added else 0
        if idle == 2:
            break
    return done if done is not None else pairs.limit(0).select("id", "source_id", "sep_arcsec", F.lit(0).alias("pass"))


# ---------------------------------------------------------------- triangles and votes


def flat_triangles(stars: DataFrame, *, n_top: int = 30, scale_arcsec: float, least_ratio: float = 0.15) -> DataFrame:
    """i, j, k, r1, r2, log_size of the triangles of the n_top brightest stars (id, x, y, mag): two side ratios and the log
    of the longest side in arc seconds. At most n_top choose 3 rows, whatever the table's size."""
    s = stars.orderBy("mag", "id").limit(n_top).select("id", "x", "y")
    a, b, c = (s.select(F.col("id").alias(i), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in "ijk")
    side = lambda p, q: F.sqrt(F.pow(F.col(f"x{p}") - F.col(f"x{q}"), 2) + F.pow(F.col(f"y{p}") - F.col(f"y{q}"), 2))
    t = F.broadcast(a).join(b, F.col("i") < F.col("j")).join(c, F.col("j") < F.col("k"))
    shape = triangle_shape(side("i", "j"), side("j", "k"), side("i", "k"))
    t = t.select("i", "j", "k", shape[0].alias("r1"), shape[1].alias("r2"), shape[2].alias("_log"))
    t = t.where((F.pow(F.lit(10.0), "_log") >= 2.0) & (F.col("r1") >= least_ratio))
    return t.select("i", "j", "k", "r1", "r2", (F.col("_log") + math.log10(scale_arcsec)).alias("log_size"))


def triangle_index(stars: DataFrame, *, neighbours: int = 8, radius_deg: float = 1.0, least_ratio: float = 0.15) -> DataFrame:
    """Triangles of each star (id, ra_deg, dec_deg) with its nearest neighbours: ids, r1, r2, log_size, ra_deg, dec_deg of
    the middle. A triangle is kept by its lowest id, once. Neighbours lie within radius_deg; `neighbours` counts the star
    itself. Write it as a table; that is the index."""
    # a star is the lowest of its own triangles, so it is one of the lowest at its position
    near = nearest_on_sky(stars, "id", neighbours, radius_deg).withColumn("id", F.explode("ids"))
    members = near.select("id", F.array_sort(F.transform("near", lambda x: F.struct(x["id"].alias("id"), x["ra"].alias("ra"), x["dec"].alias("dec")))).alias("m"))
    # triples of at most `neighbours` members: the star is the lowest of its own triangles
    t = members.withColumn("_own", F.expr("filter(m, x -> x.id >= id)")).withColumn("_n", F.size("_own")).where("_n >= 3 and _own[0].id = id")
    t = t.withColumn("b", F.explode(F.expr("sequence(1, _n - 2)"))).withColumn("c", F.explode(F.expr("sequence(b + 1, _n - 1)")))
    p = [F.col("_own")[0], F.expr("_own[b]"), F.expr("_own[c]")]
    t = t.select(*[x["id"].alias(f"id{i}") for i, x in enumerate(p)], *[x["ra"].alias(f"ra{i}") for i, x in enumerate(p)], *[x["dec"].alias(f"dec{i}") for i, x in enumerate(p)])
    u = [unit_vector(F.col(f"ra{i}"), F.col(f"dec{i}")) for i in range(3)]
    side = lambda a, b: F.sqrt(sum(((x - y) * (x - y) for x, y in zip(u[a], u[b], strict=True)), F.lit(0.0)))
    shape = triangle_shape(side(0, 1), side(1, 2), side(0, 2))
    middle = [(F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3 for c in ("ra", "dec")]
    out = t.select("id0", "id1", "id2", shape[0].alias("r1"), shape[1].alias("r2"), (shape[2] + math.log10(180 / math.pi * 3600)).alias("log_size"), middle[0].alias("ra_deg"), middle[1].alias("dec_deg"))
    return out.where((F.col("r1") >= least_ratio) & (F.col("log_size") >= math.log10(0.1)))


def shape_votes(queries: DataFrame, index: DataFrame, *, radius: float = 0.02, k: int = 8, low: float, high: float) -> DataFrame:
    """q, ra_deg, dec_deg, distance: for each query triangle (q, r1, r2, log_size) the k nearest of the index in shape and
    size, nearer than radius; sizes count from 0 to 1 between the logs low and high, and queries outside give no vote.

    Cells as wide as the radius in three dimensions; an index triangle meets the 27 cells around its own.
    """
    scaled = (F.col("log_size") - low) / (high - low)
    cells = lambda t: t.withColumn("s", scaled).withColumns({f"c{i}": F.floor(F.col(c) / radius) for i, c in enumerate(("r1", "r2", "s"))})
    q = cells(queries.where(scaled.between(0, 1))).select("q", F.col("r1").alias("q1"), F.col("r2").alias("q2"), F.col("s").alias("qs"), "c0", "c1", "c2")
    own = cells(index).select("r1", "r2", "s", "ra_deg", "dec_deg", "c0", "c1", "c2")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for i in range(3):
        q = q.withColumn("_d", F.explode(step)).withColumn(f"c{i}", F.col(f"c{i}") + F.col("_d")).drop("_d")
    distance = F.sqrt(F.pow(F.col("q1") - F.col("r1"), 2) + F.pow(F.col("q2") - F.col("r2"), 2) + F.pow(F.col("qs") - F.col("s"), 2))
    met = q.join(own, ["c0", "c1", "c2"]).withColumn("distance", distance).where(F.col("distance") < radius)
    w = Window.partitionBy("q").orderBy("distance", "ra_deg", "dec_deg")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("q", "ra_deg", "dec_deg", "distance")


def vote_cluster(votes: DataFrame, *, radius_deg: float = 1.0, least_votes: int = 2, least_significance: float = 5.0) -> DataFrame:
    """One row or none: the median position of the votes (ra_deg, dec_deg) around the vote with most others near it, how
    many, and how far above chance; only if both limits are met.

    Distances are flat around each vote, without the wrap at 0 degrees. Ties go to the lowest position.
    """
    v = cut(votes.select(clean(F.col("ra_deg")).alias("ra_deg"), clean(F.col("dec_deg")).alias("dec_deg")).where("ra_deg is not null and dec_deg is not null").withColumn("id", F.monotonically_increasing_id()))
    n = v.count()
    if n < 2:
        return v.limit(0).select("ra_deg", "dec_deg", F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("significance"))
    flat = F.sqrt(F.pow((F.col("r_ra_deg") - F.col("l_ra_deg")) * F.cos(F.radians("l_dec_deg")), 2) + F.pow(F.col("r_dec_deg") - F.col("l_dec_deg"), 2))
    # on the sky the same distance can be a little more than on the plane
    pairs = sky_pairs(v, v, radius_deg * 1.1).where(flat < radius_deg)
    counts = cut(pairs.groupBy("l_id", "l_ra_deg", "l_dec_deg").agg(F.count("*").alias("votes")))
    best = counts.orderBy(F.desc("votes"), "l_ra_deg", "l_dec_deg").limit(1)
    chance = max(n * math.pi * radius_deg**2 / 41253.0, 1e-9)
    own = pairs.join(F.broadcast(best.select("l_id", F.col("votes").alias("_votes"))), "l_id").groupBy("l_id", "_votes").agg(F.median("r_ra_deg").alias("ra_deg"), F.median("r_dec_deg").alias("dec_deg"))
    return own.select("ra_deg", "dec_deg", F.col("_votes").alias("votes"), (F.col("_votes") / chance).alias("significance")).where((F.col("votes") >= least_votes) & (F.col("significance") >= least_significance))


def empirical_scale(matched: DataFrame, *, most_stars: int = 42, most_pairs: int = 450, least_stars: int = 8, least_pairs: int = 18) -> DataFrame:
    """One row: pairs and the median of sky over pixel distance among the first stars (n, x, y, ra_deg, dec_deg), NULL with
    too few. Pairs nearer than 8 pixels or 2 arc seconds don't count; the first `most_pairs` in order do."""
    s = matched.orderBy("n").limit(most_stars)
    a, b = s.select(*[F.col(c).alias(f"a_{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns])
    t = F.broadcast(a).join(b, F.col("a_n") < F.col("b_n"))
    sky = haversine(F.col("a_ra_deg"), F.col("a_dec_deg"), F.col("b_ra_deg"), F.col("b_dec_deg")) * 3600
    px = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2))
    t = t.select("a_n", "b_n", sky.alias("sky"), px.alias("px")).where("px >= 8.0 and sky >= 2.0").orderBy("a_n", "b_n").limit(most_pairs)
    size = s.agg(F.count("*").alias("_s"))
    found = t.agg(F.count("*").alias("pairs"), F.median(F.col("sky") / F.col("px")).alias("_m")).crossJoin(size)
    return found.select("pairs", F.when((F.col("_s") >= least_stars) & (F.col("pairs") >= least_pairs), F.col("_m")).alias("scale"))


# ---------------------------------------------------------------- cells and periods

#: Source ids count cells of the sky's finest level; this many finer cells lie in one of level 6.
CELL_IDS = 34_359_738_368


def sky_cell(source_id: Column, per_cell: int = CELL_IDS) -> Column:
    """The cell of a source id: its whole part by the number of ids of a cell. Partition tables by it."""
    return (source_id - F.pmod(source_id, F.lit(per_cell))) / F.lit(per_cell)


def cells_to_do(cells: DataFrame, done: DataFrame, key: str = "cell") -> DataFrame:
    """Cells without those done, once each: what a resumed download still has to fetch."""
    return cells.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def best_catalogue_period(matches: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """key and period: the first positive period by the catalogues' order of trust, others after them, then by position."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("catalog")), F.lit(0)), F.lit(len(order) + 1))
    good = matches.where(clean(F.col("period")) > 0)
    return good.groupBy(key).agg(F.min_by("period", F.struct(rank.alias("r"), F.when(rank > len(order), F.col("catalog")).alias("c"), F.col("position"))).alias("period"))


def period_grid(bands: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.1, 2.0, 5.0, 10.0, 50.0), *, span: float, oversample: float = 5.0) -> list[float]:
    """Frequencies between the bands' periods in steps of 1 / (oversample * span)."""
    low, high = 1 / bands[-1], 1 / bands[0]
    n = max(2, math.ceil((high - low) * oversample * span) + 1)
    return [low + i * (high - low) / (n - 1) for i in range(n)]


# ---------------------------------------------------------------- alternatives of a group

#: Items of a cell whose lists one row makes, about, and the bytes of lists in a batch.
SLICE, LIST_BYTES = 1024, 8 << 20


def alternatives(items: DataFrame, key: str, group: list[str], value: str, reach: float, name: str) -> DataFrame:
    """(key, name): for each item the keys of all others of its group whose value is within reach, ascending, parted by commas.

    Pairs are never rows: items of a group lie in cells as wide as the reach, and each slice of a cell meets the keys of
    that cell and the two beside it once. Those of one cell are all within reach, so no more is held than about three lists
    that are returned. Items without another, and those without a key, value or group, have no row. A key that comes more
    than once is listed as often, but not among its own, and the lists of its rows are put together.
    """
    kind = dict(items.dtypes)[key]
    told = items.select(F.col(key).alias("k"), *group, F.col(value).cast("double").alias("v")).where(F.col("k").isNotNull() & (F.abs("v") < float("inf")))
    for c in group:
        told = told.where(F.col(c).isNotNull())
    told = told.withColumn("again", F.count("*").over(Window.partitionBy("k")) > 1)
    # a little wider than the reach, so that rounding can't put two within reach further apart
    told = told.withColumn("cell", F.floor(F.col("v") / (reach * 1.001)))
    cells = told.groupBy(*group, "cell").agg(F.collect_list(F.struct("k", "v", "again")).alias("own"))
    near = cells.select(*group, F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("to"), "cell", "own")
    near = near.groupBy(*group, "to").agg(F.flatten(F.collect_list("own")).alias("all"), F.flatten(F.collect_list(F.when(F.col("cell") == F.col("to"), F.col("own")))).alias("own")).where(F.size("own") > 0)
    parts = F.ceil(F.size("own") / F.lit(SLICE)).cast("int")
    dealt = near.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.filter("own", lambda x, i: F.pmod(i, F.col("parts")) == F.col("part"))
    dealt = dealt.select(*group, "to", "part", own.alias("own"), F.col("all.k").alias("keys"), F.col("all.v").alias("values")).repartition(*group, "to", "part")

    def lists(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, values = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("keys", "values"))
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                pieces = [b"%d," % x for x in keys.tolist()]
                raw, at = memoryview(b"".join(pieces)), [0, *accumulate(map(len, pieces))]
                ids, texts, size = [], [], 0
                for k, v in zip(batch.column("k")[row].values.to_pylist(), batch.column("v")[row].values.to_pylist(), strict=True):
                    fits = np.zeros(len(keys) + 2, np.int8)
                    fits[1:-1] = (np.abs(v - values) <= reach) & (keys != k)
                    edges = np.flatnonzero(fits[1:] != fits[:-1]).tolist()
                    if edges:
                        text = b"".join([raw[at[i] : at[j]] for i, j in zip(edges[::2], edges[1::2], strict=True)])[:-1]
                        ids.append(k)
                        texts.append(text)
                        size += len(text)
                    if size > LIST_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["k", "list"])
                        ids, texts, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["k", "list"])

    def made(again: bool) -> DataFrame:
        some = dealt.withColumn("own", F.filter("own", lambda x: x["again"] == F.lit(again))).where(F.size("own") > 0)
        some = some.select(F.transform("own.k", lambda x: x.cast("long")).alias("k"), F.col("own.v").alias("v"), F.transform("keys", lambda x: x.cast("long")).alias("keys"), "values")
        return some.mapInArrow(lists, "k long, list string")

    numbers = F.flatten(F.collect_list(F.transform(F.split("list", ","), lambda x: x.cast("long"))))
    both = made(again=True).groupBy("k").agg(F.array_join(F.transform(F.array_sort(numbers), lambda x: x.cast("string")), ",").alias("list"))
    return made(again=False).unionByName(both).select(F.col("k").cast(kind).alias(key), F.col("list").alias(name))
