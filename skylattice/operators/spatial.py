"""Joins by distance, on the plane and on the sky, through grid cells instead of comparing everything with everything.

A point on one side is copied to the cells around its own; an equi-join on the cell and an exact distance test follow.
Cells are as wide as the radius, so each pair meets once. On the sky rows of cells follow declination, and the width in
right ascension grows towards the poles; beyond the last row a cell spans the whole circle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import clean, haversine
from skylattice.operators.greedy import greedy
from skylattice.operators.shared import cut

FULL = 360.0


def plane_pairs(left: DataFrame, right: DataFrame, radius: float, *, prefix: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs of rows (columns prefixed) whose x, y lie within radius, with their distance."""
    a = left.select(*[F.col(c).alias(prefix[0] + c) for c in left.columns])
    b = right.select(*[F.col(c).alias(prefix[1] + c) for c in right.columns])
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = a.withColumn("_cx", cell(f"{prefix[0]}x")).withColumn("_cy", cell(f"{prefix[0]}y"))
    b = b.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_cx", cell(f"{prefix[1]}x") + F.col("_dx")).withColumn("_cy", cell(f"{prefix[1]}y") + F.col("_dy")).drop("_dx", "_dy")
    d = F.sqrt(F.pow(F.col(f"{prefix[0]}x") - F.col(f"{prefix[1]}x"), 2) + F.pow(F.col(f"{prefix[0]}y") - F.col(f"{prefix[1]}y"), 2))
    return a.join(b, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_cx", "_cy")


def _zone(dec: Column, radius: float) -> Column:
    return F.floor((dec + 90) / radius)


def _ra_cells(zone: Column, radius: float) -> Column:
    """How many cells of right ascension a zone has: each at least as wide as radius at the zone's edge nearest a pole."""
    edge = F.greatest(F.abs(zone * radius - 90), F.abs((zone + 1) * radius - 90))
    width = F.when(edge + radius < 90, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(radius)) / F.cos(F.radians(edge)))))).otherwise(FULL)
    return F.greatest(F.lit(1), F.floor(FULL / width)).cast("long")


def sky_pairs(left: DataFrame, right: DataFrame, radius_deg: float, *, prefix: tuple[str, str] = ("l_", "r_"), also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows (columns prefixed) whose ra_deg, dec_deg lie within radius_deg on the sphere and whose columns `also` are
    equal, with their distance."""
    a = left.select(*[F.col(c).alias(prefix[0] + c) for c in left.columns])
    b = right.select(*[F.col(c).alias(prefix[1] + c) for c in right.columns])
    a = a.withColumn("_z", _zone(F.col(f"{prefix[0]}dec_deg"), radius_deg))
    a = a.withColumn("_c", F.floor(F.pmod(F.col(f"{prefix[0]}ra_deg"), F.lit(FULL)) / FULL * _ra_cells(F.col("_z"), radius_deg)))
    b = b.withColumn("_z", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _zone(F.col(f"{prefix[1]}dec_deg"), radius_deg) + d)))
    n = _ra_cells(F.col("_z"), radius_deg)
    own = F.floor(F.pmod(F.col(f"{prefix[1]}ra_deg"), F.lit(FULL)) / FULL * n)
    b = b.withColumn("_c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(own + d, n)))))
    d = haversine(F.col(f"{prefix[0]}ra_deg"), F.col(f"{prefix[0]}dec_deg"), F.col(f"{prefix[1]}ra_deg"), F.col(f"{prefix[1]}dec_deg"))
    same = reduce(and_, [a[c] == b[c] for c in ("_z", "_c")] + [a[f"{prefix[0]}{c}"] == b[f"{prefix[1]}{c}"] for c in also])
    return a.join(b, same).withColumn("distance", d).where(F.col("distance") <= radius_deg).drop("_z", "_c")


#: Halvings of the radius that are tried, and the pairs for each position that the first round may make, about.
HALVINGS, FEW_PAIRS = 24, 16


def nearest_on_sky(stars: DataFrame, key: str, n: int, radius_deg: float) -> DataFrame:
    """ra_deg, dec_deg, ids and near of each position of stars (key, ra_deg, dec_deg): the n lowest keys that lie there, and
    the n nearest stars within radius_deg, the position's own among them: structs (distance, id, ra, dec), ties by id.

    Rounds of pairs, first so near that they make about FEW_PAIRS for each position, then within twice as much for positions
    that have fewer than n, up to the radius. A position with n within a round's radius has its n nearest. However many stars
    share a position, n stand for them. Runs at once.
    """
    ra, dec = clean(F.col("ra_deg").cast("double")), clean(F.col("dec_deg").cast("double"))
    own = stars.select(F.col(key).alias("id"), ra.alias("ra_deg"), dec.alias("dec_deg")).where("ra_deg is not null and dec_deg is not null")
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy("ra_deg", "dec_deg").orderBy("id"))).where(F.col("_r") <= n)
    own = cut(own.groupBy("ra_deg", "dec_deg").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    wide = own.select("ra_deg", "dec_deg", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("_k")).withColumn("_w", radius_deg / F.pow(F.lit(2.0), "_k"))
    cells = wide.groupBy("_k", F.floor(F.col("dec_deg") / F.col("_w")), F.floor(F.col("ra_deg") * F.cos(F.radians("dec_deg")) / F.col("_w"))).agg(F.count("*").alias("_n"))
    met = {r["_k"]: r["_p"] / r["_all"] for r in cells.groupBy("_k").agg(F.sum(F.col("_n") * F.col("_n")).alias("_p"), F.sum("_n").alias("_all")).collect()}  # a row for each halving
    k = min([k for k, share in met.items() if share <= FEW_PAIRS], default=HALVINGS)
    open_, found = own.select("ra_deg", "dec_deg"), None
    while True:
        pairs = sky_pairs(open_, own, radius_deg / 2**k).select("l_ra_deg", "l_dec_deg", "distance", F.explode("r_ids").alias("id"), F.col("r_ra_deg").alias("ra"), F.col("r_dec_deg").alias("dec"))
        place = Window.partitionBy("l_ra_deg", "l_dec_deg").orderBy("distance", "id")
        near = pairs.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= n).groupBy(F.col("l_ra_deg").alias("ra_deg"), F.col("l_dec_deg").alias("dec_deg")).agg(F.array_sort(F.collect_list(F.struct("distance", "id", "ra", "dec"))).alias("near"))
        near = cut(near)
        settled = near if k == 0 else near.where(F.size("near") == n)
        found = settled if found is None else found.unionByName(settled)
        if k == 0:
            break
        open_ = cut(open_.join(settled.select("ra_deg", "dec_deg"), ["ra_deg", "dec_deg"], "left_anti"))
        if open_.isEmpty():
            break
        k -= 1
    return own.join(found, ["ra_deg", "dec_deg"])


def _halvings(asked: DataFrame, offered: DataFrame, radius: float, cells: Callable[[Column], list[Column]]) -> int:
    """How often the radius is halved so that rows of asked have about FEW_PAIRS of offered within it, on average."""
    both = asked.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(offered.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    wide = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("_k")).withColumn("_w", radius / F.pow(F.lit(2.0), "_k"))
    met = wide.groupBy("_k", *cells(F.col("_w"))).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    met = met.groupBy("_k").agg((F.sum(F.col("_a").cast("double") * F.col("_b")) / F.greatest(F.sum("_a"), F.lit(1))).alias("_p")).collect()  # a row for each halving
    return min([r["_k"] for r in met if r["_p"] <= FEW_PAIRS], default=HALVINGS if met else 0)


def nearest_of(asked: DataFrame, offered: DataFrame, key: str, tie: str, radius_deg: float, *, by: tuple[str, ...] = (), carry: tuple[str, ...] = (), also: tuple[str, ...] = (), inside: Column | None = None) -> DataFrame:
    """key, distance, tie and carry: for each row of asked (key, ra_deg, dec_deg, ...) the nearest one of offered (tie, ra_deg,
    dec_deg, ...) within radius_deg of which `inside` holds, ties by the lowest `tie`. Rows that have none are left out.

    by: the columns of offered, besides the position, that `inside` (of l_ and r_ columns) uses; rows equal in them and in
    position are one row. also: columns of both that must be equal. Rounds of pairs, first so near that there are about
    FEW_PAIRS for each row, then within twice as much for rows that have none yet, up to the radius. Runs at once.
    """
    place = ["ra_deg", "dec_deg"]
    own = cut(offered.groupBy(*place, *by, *also).agg(F.min(tie).alias(tie), *[F.min_by(c, tie).alias(c) for c in carry]))
    open_ = cut(asked)
    spots = lambda w: [F.floor(F.col("dec_deg") / w), F.floor(F.col("ra_deg") * F.cos(F.radians("dec_deg")) / w)]
    k = _halvings(open_.select(*place), own.select(*place), radius_deg, spots)
    found, what = None, ["distance", f"r_{tie}", *[f"r_{c}" for c in carry]]
    while True:
        pairs = sky_pairs(open_, own, radius_deg / 2**k, also=also)
        pairs = pairs if inside is None else pairs.where(inside)
        best = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min_by(F.struct(*what), F.struct("distance", f"r_{tie}")).alias("_near"))
        best = cut(best.select(key, "_near.distance", F.col(f"_near.r_{tie}").alias(tie), *[F.col(f"_near.r_{c}").alias(c) for c in carry]))
        found = best if found is None else found.unionByName(best)
        if k == 0:
            return found
        open_ = cut(open_.join(best.select(key), key, "left_anti"))
        if open_.isEmpty():
            return found
        k -= 1


def nearest(pairs: DataFrame, key: str, tie: str) -> DataFrame:
    """The nearest partner of each key, ties by the partner's id."""
    w = Window.partitionBy(key).orderBy("distance", tie)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def blended(stars: DataFrame, key: str, radius: float) -> DataFrame:
    """stars with is_blended: another star within radius."""
    hits = plane_pairs(stars.select(key, "x", "y"), stars.select(key, "x", "y"), radius).where(F.col(f"l_{key}") != F.col(f"r_{key}")).select(F.col(f"l_{key}").alias(key)).distinct().withColumn("_hit", F.lit(True))
    return stars.join(hits, key, "left").withColumn("is_blended", F.coalesce("_hit", F.lit(False))).drop("_hit")


def contamination(stars: DataFrame, key: str, *, low: float = 0.5, high: float = 25.0, max_fainter: float = 3.0, cap: float = 2.0) -> DataFrame:
    """stars with contamination: flux of neighbours at low < d <= high, not fainter by more than max_fainter, over own."""
    pairs = plane_pairs(stars.select(key, "x", "y", "mag"), stars.select(key, "x", "y", "mag"), high)
    pairs = pairs.where((F.col(f"l_{key}") != F.col(f"r_{key}")) & (F.col("distance") > low) & (F.col("r_mag") - F.col("l_mag") <= max_fainter))
    sums = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(F.sum(F.pow(F.lit(10.0), -0.4 * (F.col("r_mag") - F.col("l_mag")))).alias("_c"))
    return stars.join(sums, key, "left").withColumn("contamination", F.least(F.coalesce("_c", F.lit(0.0)), F.lit(cap))).drop("_c")


def isolated(stars: DataFrame, key: str, group: str, *, radius: float, max_dmag: float, n_min: int) -> DataFrame:
    """Stars without a neighbour of like brightness within radius, group by group; a group left with fewer than n_min
    keeps all its stars."""
    cols = [key, group, "x", "y", "mag"]
    pairs = plane_pairs(stars.select(*cols), stars.select(*cols), radius)
    crowd = pairs.where((F.col(f"l_{group}") == F.col(f"r_{group}")) & (F.col(f"l_{key}") != F.col(f"r_{key}")) & (F.abs(F.col("l_mag") - F.col("r_mag")) < max_dmag))
    crowd = crowd.select(F.col(f"l_{key}").alias(key)).distinct().withColumn("_crowded", F.lit(True))
    t = stars.join(crowd, key, "left").withColumn("_alone", F.col("_crowded").isNull())
    left = F.sum(F.col("_alone").cast("int")).over(Window.partitionBy(group))
    return t.withColumn("_left", left).where(F.col("_alone") | (F.col("_left") < n_min)).drop("_crowded", "_alone", "_left")


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Greedy matching by ascending distance, ties by the ids; see greedy()."""
    return greedy(pairs, left, right, ["distance"])


def one_to_one_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius: float) -> DataFrame:
    """_l and _r (the keys) and distance: what one_to_one() takes of all pairs of left and right (key, x, y) within radius.

    Pairs come by ascending distance, so those within a part of the radius are settled before all others: rounds, first so
    near that there are about FEW_PAIRS for each row, then within twice as much for rows that are still free on both sides.
    Runs at once.
    """
    a, b = (cut(t.select(k, "x", "y").where(F.col(k).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())) for t, k in ((left, left_key), (right, right_key)))
    k = _halvings(a.select("x", "y"), b.select("x", "y"), radius, lambda w: [F.floor(F.col("x") / w), F.floor(F.col("y") / w)])
    kept = None
    while True:
        pairs = plane_pairs(a, b, radius / 2**k, prefix=("l_", "r_")).select(F.col(f"l_{left_key}").alias("_l"), F.col(f"r_{right_key}").alias("_r"), "distance")
        new = one_to_one(pairs, "_l", "_r")
        kept = new if kept is None else kept.unionByName(new)
        if k == 0:
            return kept
        a, b = (cut(t.join(new.select(F.col(c).alias(key)), key, "left_anti")) for t, c, key in ((a, "_l", left_key), (b, "_r", right_key)))
        k -= 1


def ra_ranges(ra_min: float, ra_max: float) -> list[tuple[float, float]]:
    """The closed ranges within 0 to 360 that a range of right ascension covers: two where it passes 0 degrees."""
    low, high = ra_min % FULL, ra_max % FULL
    if ra_max - ra_min >= FULL:
        return [(0.0, FULL)]
    return [(low, high)] if low <= high else [(0.0, high), (low, FULL)]


def boxes(df: DataFrame, ra_min: float, ra_max: float, dec_min: float, dec_max: float, *, turns: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """A rectangle of sky; a range that passes 0 degrees wraps, and one of a full circle has all.

    The conditions are plain ranges of ra_deg and dec_deg, so they reach a scan. turns: the full circles that ra_deg may be
    off by; by default it lies anywhere from -360 to 720.
    """
    ranges = [F.col("ra_deg").between(low + FULL * k, high + FULL * k) for low, high in ra_ranges(ra_min, ra_max) for k in turns]
    return df.where(F.col("dec_deg").between(dec_min, dec_max) & reduce(or_, ranges))


# The strips that a sky table is cut into, and the bands within them that its rows follow, in degrees.
STRIP_RA, STRIP_DEC, BAND = 7.5, 5.0, 0.25


def strip_of(ra: Column, dec: Column, ra_step: float = STRIP_RA, dec_step: float = STRIP_DEC) -> Column:
    """The strip (see strips()) in which a position lies; the pole belongs to the last row."""
    n_ra, n_dec = math.ceil(FULL / ra_step), math.ceil(180 / dec_step)
    row, column = F.floor((dec + 90) / dec_step), F.floor(F.pmod(ra, F.lit(FULL)) / ra_step)
    return F.when(ra.isNotNull() & dec.isNotNull(), F.least(row, F.lit(n_dec - 1)) * n_ra + F.least(column, F.lit(n_ra - 1))).cast("int")


def box_strips(ra_min: float, ra_max: float, dec_min: float, dec_max: float, ra_step: float = STRIP_RA, dec_step: float = STRIP_DEC) -> list[int]:
    """The strips that a box touches."""
    n_ra, n_dec = math.ceil(FULL / ra_step), math.ceil(180 / dec_step)
    cell = lambda x, step, n: min(max(math.floor(x / step), 0), n - 1)
    rows = range(cell(dec_min + 90, dec_step, n_dec), cell(dec_max + 90, dec_step, n_dec) + 1) if dec_min <= dec_max else []
    columns = sorted({j for low, high in ra_ranges(ra_min, ra_max) for j in range(cell(low, ra_step, n_ra), cell(high, ra_step, n_ra) + 1)} | ({0} if any(high == FULL for _, high in ra_ranges(ra_min, ra_max)) else set()))
    return [i * n_ra + j for i in rows for j in columns]


def write_clustered(df: DataFrame, path: str, *, ra_step: float = STRIP_RA, dec_step: float = STRIP_DEC) -> None:
    """Write a sky table (ra_deg, dec_deg and more) as Parquet by strip of sky, with ra_deg brought to 0 to 360.

    Rows are dealt into ranges of (strip, band of declination, right ascension): a strip that holds a third of all stars
    is written by many tasks, and a file's row groups each cover a small piece of sky.
    """
    t = df.withColumn("ra_deg", F.pmod(F.col("ra_deg").cast("double"), F.lit(FULL))).withColumn("sky_cell", strip_of(F.col("ra_deg"), F.col("dec_deg"), ra_step, dec_step))
    t = t.withColumn("_band", F.floor(F.col("dec_deg") / BAND))
    order = ["sky_cell", "_band", "ra_deg"]
    t.repartitionByRange(*order).sortWithinPartitions(*order).drop("_band").write.partitionBy("sky_cell").parquet(path)


def read_box(spark: SparkSession, path: str, schema: str, ra_min: float, ra_max: float, dec_min: float, dec_max: float, *, ra_step: float = STRIP_RA, dec_step: float = STRIP_DEC) -> DataFrame:
    """The rows of a clustered table in a box: of the folders only those of its strips, of their row groups only those whose
    ranges meet it. schema: the table's columns without sky_cell."""
    t = spark.read.schema(f"{schema}, sky_cell int").parquet(path)
    cells = box_strips(ra_min, ra_max, dec_min, dec_max, ra_step, dec_step)
    return boxes(t.where(F.col("sky_cell").isin(cells)), ra_min, ra_max, dec_min, dec_max, turns=(0,)).drop("sky_cell")


def catalogue_box(df: DataFrame, ra_min: float, ra_max: float, dec_min: float, dec_max: float, *, order: list[str], limit: int | None = None) -> DataFrame:
    """boxes() with each object once, by oid where it has one, else by position, and the first `limit` rows by order."""
    t = boxes(df, ra_min, ra_max, dec_min, dec_max)
    key = [F.col("oid"), F.when(F.col("oid").isNull(), F.col("ra_deg")), F.when(F.col("oid").isNull(), F.col("dec_deg"))]
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return t.orderBy(*order).limit(limit) if limit is not None else t


def strips(ra_step: float, dec_step: float, dec_min: float = -90.0, dec_max: float = 90.0):
    """SQL of a grid of half-open sky strips that covers the circle: the last strip of each direction is closed."""
    n_ra, n_dec = math.ceil(FULL / ra_step), math.ceil((dec_max - dec_min) / dec_step)
    return (
        f"select i * {n_ra} + j as strip, j * {ra_step} as ra_min, least((j + 1) * {ra_step}, {FULL}) as ra_max, {dec_min} + i * {dec_step} as dec_min, "
        f"least({dec_min} + (i + 1) * {dec_step}, {dec_max}) as dec_max, j = {n_ra - 1} as ra_closed, i = {n_dec - 1} as dec_closed "
        f"from (select explode(sequence(0, {n_dec - 1})) as i) a cross join (select explode(sequence(0, {n_ra - 1})) as j) b"
    )
