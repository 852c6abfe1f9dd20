"""What several operators need: cutting lineage, numbering rows in order, exact quantiles by group."""

from __future__ import annotations

import math
import sys
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary folder where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skylattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the checkpoint folder: later steps read it instead of repeating its plan."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with the number of each row from 1 in the given order, within keys if there are any.

    Rows are dealt into ranges of the order, numbered in each, and the ranges' counts are added up: no task sees more than
    its range, however large a group is.
    """
    keys = keys or []
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = dealt["_range"] == counts["_r"]
    for i, k in enumerate(keys):
        same = same & dealt[k].eqNullSafe(counts[f"_key{i}"])
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(counts, same).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def group_quantiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys, n and one column for each share: exact quantiles, interpolated, of the values that aren't NULL."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), "_k", ["_v"], keys)
    sized = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys) if keys else rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))

    def at(share: float) -> tuple[Column, Column]:
        place = (F.col("n") - 1) * F.lit(float(share))
        low, part = F.floor(place), place - F.floor(place)
        return (F.col("_k") - 1 == low) | (F.col("_k") - 1 == F.ceil(place)), F.when(F.col("_k") - 1 == low, 1 - part).when(F.col("_k") - 1 == F.ceil(place), part)

    hit, sums = F.lit(False), []
    for name, share in shares.items():
        inside, weight = at(share)
        hit = hit | inside
        sums.append(F.sum(weight * F.col("_v")).alias(name))
    return sized.where(hit).groupBy(*keys).agg(F.max("n").alias("n"), *sums)


#: Rows that are looked at on the driver instead of being counted, and cells of a histogram.
FEW, CELLS = 4096, 1024


def interpolated(values: dict[int, float], n: int, share: float) -> float:
    """The quantile of n values between the two that stand next to it (place from 0 -> value), as Spark's percentile."""
    place = (n - 1) * share
    low, high = math.floor(place), math.ceil(place)
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - place) * values[low] + (place - low) * values[high]


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Exact quantiles of whole columns, name -> (column, share): equal to Spark's percentile bit by bit, without a sort and
    without a buffer of values. NULL and NaN don't count; a column without values gives None.

    Tables of up to FEW rows come to the driver. Of longer ones the ranks next to each quantile are closed in: counts, lowest
    and highest values by CELLS equal cells of an interval say in which cell a rank lies, which is the next interval, until it
    holds one value or FEW rows. A pass is one aggregate; the interval shrinks by CELLS at least in each. It runs at once, and
    df is read again for each pass: give it a table or a checkpoint.
    """
    t = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_{i}") for i, (c, _) in enumerate(wanted.values())])
    head = t.limit(FEW + 1).toArrow()
    if head.num_rows <= FEW:
        out = {}
        for i, (name, (_, share)) in enumerate(wanted.items()):
            values = sorted(head.column(i).drop_null().to_pylist())
            out[name] = interpolated(dict(enumerate(values)), len(values), share) if values else None
        return out
    sizes = t.agg(*[f(f"_{i}").alias(f"{n}{i}") for i in range(len(wanted)) for n, f in (("n", F.count), ("a", F.min), ("z", F.max))]).first()
    # a rank: column, place, and the interval it is in with the number of values below and inside
    ranks = {}
    for i, (_, share) in enumerate(wanted.values()):
        if n := sizes[f"n{i}"]:
            for place in {math.floor((n - 1) * share), math.ceil((n - 1) * share)}:
                ranks[i, place] = (sizes[f"a{i}"], sizes[f"z{i}"], 0, n)
    top = sys.float_info.max
    while open_ := sorted({(i, low, high) for (i, _), (low, high, _, n) in ranks.items() if low < high and n > FEW}):
        hits = []
        for k, (i, low, high) in enumerate(open_):
            a, z, v = max(low, -top) / 2, min(high, top) / 2, F.col(f"_{i}")
            cell = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((v / 2 - a) / F.lit(z - a) * CELLS))).cast("int")
            hits.append(F.when(v.between(low, high), F.struct(F.lit(k).alias("k"), cell.alias("cell"), v.alias("v"))))
        counted = t.select(F.inline(F.array_compact(F.array(*hits)))).groupBy("k", "cell").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        cells: dict[int, list] = {}
        for r in counted.orderBy("k", "cell").collect():  # CELLS rows for each interval at most
            cells.setdefault(r["k"], []).append(r)
        for (i, place), (low, high, below, n) in ranks.items():
            if (i, low, high) in open_:
                for r in cells[open_.index((i, low, high))]:
                    if place < below + r["n"]:
                        ranks[i, place] = (r["a"], r["z"], below, r["n"])
                        break
                    below += r["n"]
    left = sorted({(i, low, high) for (i, _), (low, high, _, _) in ranks.items() if low < high})
    lists = t.agg(*[F.sort_array(F.collect_list(F.when(F.col(f"_{i}").between(low, high), F.col(f"_{i}")))).alias(f"x{k}") for k, (i, low, high) in enumerate(left)]).first() if left else {}
    found: dict[int, dict[int, float]] = {}
    for (i, place), (low, high, below, _) in ranks.items():
        found.setdefault(i, {})[place] = low if low == high else lists[f"x{left.index((i, low, high))}"][place - below]
    return {name: interpolated(found[i], sizes[f"n{i}"], share) if i in found else None for i, (name, (_, share)) in enumerate(wanted.items())}


def known(x: float | None) -> Column:
    """A number that the driver knows, or NULL, as a column."""
    return F.lit(x).cast("double")
