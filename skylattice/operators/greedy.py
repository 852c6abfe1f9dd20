"""Greedy one-to-one matching: pairs in a total order, each taken while both of its sides are free.

Up to a number of pairs, one pass over all of them in order settles them: it remembers the sides taken, no more. Of more pairs,
one that is the first of both its sides is taken whatever else happens; what is left falls into connected groups. Groups are found in rounds that halve paths, so a long chain needs logarithmically many;
then every group is settled in order in one pass over sorted rows, where a task remembers the sides taken in the group at
hand. Tables with more pairs than a group may have go in rounds of proposals: the first pairs of each left side are matched, then those
that it may still get after what right sides hold, until no free one has any left. The greedy choice is the one stable
matching of that order, so what a right side holds only gets better, and no pair that is dropped could be taken. Groups that
are still too large go in rounds of one proposal each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.shared import cut

#: Pairs of a group that is settled in one pass: the sides that a task remembers are twice as many at most.
GROUP_PAIRS = 1 << 20
#: Pairs that one pass in order settles at once. Rounds over groups cost the driver plans and tasks, and lists of near wishes
#: make one group anyway; what a task keeps is the sides it takes.
PASS_PAIRS = 1 << 24
#: Pairs that a left side proposes in a round over a large table.
LIST = 16


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is connected with) of edges (a, b: longs).

    Each round hangs larger neighbours under a node's smallest neighbour, then all neighbours of smaller number as well
    (Kiveris et al. 2014), until every component is a star.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        large = both.join(low, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(low.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("_m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _first_of_both(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    a, b = (F.row_number().over(Window.partitionBy(side).orderBy(*order)) for side in (left, right))
    return pairs.withColumn("_a", a).withColumn("_b", b).where("_a = 1 and _b = 1").drop("_a", "_b")


def _without(pairs: DataFrame, taken: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").select(*pairs.columns)


def _proposals(pairs: DataFrame, left: str, right: str, order: list[str], most: int) -> DataFrame:
    """The pairs that greedy takes, in rounds in which each left side proposes its `most` first pairs that are left; those that
    are free propose eight times as many in each further round, if most isn't 1."""
    columns, place = pairs.columns, F.struct(*order)
    row = F.struct(*order, *[c for c in columns if c not in order])
    first = lambda t, side: t.groupBy(side).agg(F.min(row).alias("_p")).select(*[F.col(f"_p.{c}").alias(c) for c in columns])
    live, held, more = pairs, pairs.limit(0), most
    while True:
        free = live.join(held.select(left), left, "left_anti")
        if most == 1:
            asked = cut(first(free, left))
            if asked.isEmpty():
                return held
            held = cut(first(held.unionByName(asked), right))
        else:
            if free.isEmpty():
                return held
            nth = F.row_number().over(Window.partitionBy(left).orderBy(*order))
            lists = live.join(held.select(left, F.lit(True).alias("_held")), left, "left").withColumn("_n", nth)
            lists = lists.where(F.col("_n") <= F.when(F.col("_held"), most).otherwise(more)).select(*columns)
            held, more = _settled(cut(held.unionByName(lists)), left, right, order), 8 * more
        # a pair is left if it comes before what its right side holds, unless its left side has one that is final: what is held
        # is final if no pair before it is left
        holds = held.select(F.col(right).alias("_s"), F.col(left).alias("_l"), place.alias("_h"))
        live = cut(live.join(holds.select("_s", "_h"), F.col(right) == F.col("_s"), "left").where(F.col("_h").isNull() | (place < F.col("_h"))).select(*columns))
        final = holds.join(live.select(F.col(right).alias("_s")).distinct(), "_s", "left_anti").select(F.col("_l").alias(left))
        live = cut(live.join(final, left, "left_anti").select(*columns))


def greedy(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """The pairs that are taken when they come in `order`, equal ones by left and right, and sides are used once.

    Runs at once. A pair that comes twice is taken once; pairs with a null side go.
    """
    order = [*order, *[c for c in (left, right) if c not in order]]
    every = cut(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()))
    if every.count() > GROUP_PAIRS:
        return _proposals(every, left, right, order, LIST)
    return _settled(every, left, right, order)


def _in_order(pairs: DataFrame, left: str, right: str, columns: list[str]) -> DataFrame:
    """The pairs (columns) that are taken one after the other within each component; its rows are sorted and lie in one task."""
    kind = pairs.select(*columns).schema

    def run(batches):
        now, lefts, rights = None, set(), set()
        for batch in batches:
            keep = []
            for group, a, b in zip(*(batch.column(c).to_pylist() for c in ("component", left, right)), strict=True):
                if group != now:
                    now, lefts, rights = group, set(), set()
                free = a not in lefts and b not in rights
                if free:
                    lefts.add(a)
                    rights.add(b)
                keep.append(free)
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return pairs.select("component", *columns).mapInArrow(run, kind)


def _settled(every: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """The pairs that greedy takes, by one pass, or by first pairs of both sides and connected groups."""
    columns = every.columns
    if every.count() <= PASS_PAIRS:
        return cut(_in_order(every.withColumn("component", F.lit(0)).repartition(1).sortWithinPartitions(*order), left, right, columns))
    kept = cut(_first_of_both(every, left, right, order))
    open_ = cut(_without(every, kept, left, right))
    if open_.isEmpty():
        return kept
    node: dict[str, Column] = {side: F.xxhash64(F.lit(k), F.col(side)) for k, side in enumerate((left, right))}  # nodes that fall together only make a group larger
    groups = connected(open_.select(node[left].alias("a"), node[right].alias("b"))).withColumnRenamed("node", "_n")
    grouped = cut(open_.withColumn("_h", node[left]).join(groups, F.col("_h") == F.col("_n")).select(*columns, "component"))
    size = grouped.groupBy("component").agg(F.count("*").alias("_size")).where(F.col("_size") > GROUP_PAIRS).select("component")
    large = cut(grouped.join(size, "component", "left_semi").select(*columns))

    rest = grouped.join(size, "component", "left_anti").repartition("component").sortWithinPartitions("component", *order)
    kept = kept.unionByName(_in_order(rest, left, right, columns))
    if not large.isEmpty():
        kept = kept.unionByName(_proposals(large, left, right, order, 1))
    return cut(kept)
