"""The n rows nearest in value, group by group, without comparing all rows of a group with each other.

Rows are numbered in the order of (group, value); a value's nearest are among the n before and the n after it. Numbers are
cut into blocks, each block gets the n numbers beyond its edges as well, and a window over a block finds both sides. So what
is shuffled is rows, not pairs, and no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.expr import clean
from skylattice.operators.shared import cut, numbered

#: Distinct values in a block.
BLOCK = 4096


def nearest_in_value(rows: DataFrame, key: str, group: str, value: str, n: int) -> DataFrame:
    """key, other, gap, rank: for each row the n others of its group with the smallest |difference of value|, ties by key.

    Keys are distinct. Rows without a group or value are no one's neighbour and have none. Of rows equal in value only the
    n + 1 of lowest key can be among the n nearest of anyone, however many there are; they stand for all of them.
    """
    plain = cut(rows.select(F.col(key).alias("_id"), F.col(group).alias("_g"), clean(F.col(value).cast("double")).alias("_v")).where("_g is not null and _v is not null"))
    first = numbered(plain, "_nth", ["_id"], ["_g", "_v"]).where(F.col("_nth") <= n + 1)
    values = first.groupBy("_g", "_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
    placed = numbered(values, "_k", ["_v"], ["_g"])
    size = max(BLOCK, n)
    block = F.floor((F.col("_k") - 1) / size)
    inside = (F.col("_k") - 1) % size
    shared = F.array_compact(F.array(block, F.when(inside < n, block - 1), F.when(inside >= size - n, block + 1)))
    blocks = placed.withColumn("_own", block).withColumn("_block", F.explode(shared))
    order = Window.partitionBy("_g", "_block").orderBy("_k")
    pair = F.struct("_v", "_ids")
    seen = blocks.withColumn("_before", F.reverse(F.collect_list(pair).over(order.rowsBetween(-n, -1)))).withColumn("_after", F.collect_list(pair).over(order.rowsBetween(1, n)))

    def offered(side: str):
        every = F.flatten(F.transform(side, lambda p: F.transform(p["_ids"], lambda i: F.struct(F.abs(F.col("_v") - p["_v"]).alias("gap"), i.alias("other")))))
        return F.slice(every, 1, n)

    own = F.transform("_ids", lambda i: F.struct(F.lit(0.0).alias("gap"), i.alias("other")))
    offers = seen.where("_block = _own").select("_g", "_v", F.concat(own, offered("_before"), offered("_after")).alias("_offers"))
    met = plain.join(offers, ["_g", "_v"])
    chosen = F.slice(F.array_sort(F.filter("_offers", lambda o: o["other"] != F.col("_id"))), 1, n)
    out = met.select("_id", F.posexplode(chosen).alias("_r", "_o"))
    return out.select(F.col("_id").alias(key), F.col("_o.other").alias("other"), F.col("_o.gap").alias("gap"), (F.col("_r") + 1).alias("rank"))


def nearest_offers(asked: DataFrame, offered: DataFrame, keys: list[str], value: str, carry: str, reach: float) -> DataFrame:
    """asked with _offers: structs (value, carry) of offered rows of equal keys, among which are all those nearest in value
    within reach, on either side; what is farther away may be among them too.

    Each row meets the last values before it and the first after it in cells as wide as the reach, so what is shuffled is rows,
    not pairs. Values closer than 1e-9 go together: differences between them can be lost in rounding, so that they tie. Rows
    without a value have no offers and offer nothing. Give each value of offered once for its keys.
    """
    cell, place = F.floor(F.col(value) / (reach * (1 + 1e-6))), [*keys, "_cell"]
    all_ = Window.partitionBy(*place)
    own = offered.where(clean(F.col(value)).isNotNull()).select(*keys, F.col(value), F.col(carry)).withColumn("_cell", cell)
    own = own.withColumn("_low", F.min(value).over(all_)).withColumn("_high", F.max(value).over(all_))
    # the outermost values of a cell are offered to the next one too
    own = own.withColumn("_cell", F.explode(F.array_compact(F.array("_cell", F.when(F.col(value) <= F.col("_low") + 1e-9, F.col("_cell") - 1), F.when(F.col(value) >= F.col("_high") - 1e-9, F.col("_cell") + 1)))))
    rising = all_.orderBy(value)
    apart = F.coalesce(F.col(value) - F.lag(value).over(rising) > 1e-9, F.lit(True)).cast("int")
    own = own.withColumn("_apart", apart).withColumn("_group", F.sum("_apart").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    groups = own.groupBy(*place, "_group").agg(F.min(value).alias(value), F.collect_list(F.struct(value, carry)).alias("_some")).drop("_group")
    both = groups.withColumn("_asks", F.lit(0)).unionByName(asked.where(clean(F.col(value)).isNotNull()).withColumn("_cell", cell).withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    before = F.last("_some", ignorenulls=True).over(all_.orderBy(value, "_asks").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_some", ignorenulls=True).over(all_.orderBy(F.desc(value), "_asks").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_before", before).withColumn("_after", after).where("_asks = 1")
    none = F.array().cast(dict(groups.dtypes)["_some"])
    return met.select(*asked.columns, F.concat(F.coalesce("_before", none), F.coalesce("_after", none)).alias("_offers"))


def within_value(rows: DataFrame, key: str, group: str, value: str, limit: float) -> DataFrame:
    """key, other, gap: pairs of rows of a group whose values differ by limit at most, both ways, through cells of value as
    wide as the limit."""
    a = rows.select(F.col(key), F.col(group).alias("_g"), F.col(value).alias("_v"), F.floor(F.col(value) / limit).alias("_c"))
    b = a.select(F.col(key).alias("other"), "_g", F.col("_v").alias("_w"), F.explode(F.array(*[F.col("_c") + i for i in (-1, 0, 1)])).alias("_c"))
    gap = F.abs(F.col("_v") - F.col("_w"))
    return a.join(b, ["_g", "_c"]).where((F.col(key) != F.col("other")) & (gap <= limit)).select(key, "other", gap.alias("gap"))


def nearest_alike(rows: DataFrame, key: str, group: str, value: str, n: int, alike: str, limit: float, *, width: float) -> DataFrame:
    """key, other, gap: for each row the n others of its group nearest in value among those whose `alike` differs by less
    than limit, ties by key; fewer where there are fewer.

    Rounds of pairs in cells of (group, alike, value): first within `width` of value, then, for rows that have fewer than n,
    within four times as much, until the whole range of values is covered. A row that has n within the width has its n
    nearest. Rows without a group, value or alike have none.
    """
    plain = cut(rows.select(F.col(key).alias("_id"), F.col(group).alias("_g"), clean(F.col(value).cast("double")).alias("_v"), clean(F.col(alike).cast("double")).alias("_a")).where("_g is not null and _v is not null and _a is not null"))
    span = plain.agg((F.max("_v") - F.min("_v")).alias("x")).first()["x"]  # one row
    best = Window.partitionBy("_id").orderBy("gap", "other")
    open_, kept = plain, None
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        cells = lambda t: t.withColumn("_ca", F.floor(F.col("_a") / limit)).withColumn("_cv", F.floor(F.col("_v") / width))  # noqa: B023, E731
        other = cells(plain).select("_g", F.col("_id").alias("other"), F.col("_v").alias("_w"), F.col("_a").alias("_b"), F.explode(F.transform(near, lambda i: F.col("_ca") + i)).alias("_ca"), "_cv")
        other = other.withColumn("_cv", F.explode(F.transform(near, lambda i: F.col("_cv") + i)))
        pairs = cells(open_).join(other, ["_g", "_ca", "_cv"]).withColumn("gap", F.abs(F.col("_v") - F.col("_w")))
        pairs = pairs.where((F.col("_id") != F.col("other")) & (F.col("gap") <= width) & (F.abs(F.col("_a") - F.col("_b")) < limit))
        found = cut(pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).select("_id", "other", "gap", "_r"))
        last = span is None or width >= span
        settled = found if last else found.join(found.where(F.col("_r") == n).select("_id"), "_id", "left_semi")
        kept = settled if kept is None else kept.unionByName(settled)
        if last:
            break
        open_ = cut(open_.join(settled.select("_id").distinct(), "_id", "left_anti"))
        if open_.isEmpty():
            break
        width *= 4
    return kept.select(F.col("_id").alias(key), "other", "gap")
