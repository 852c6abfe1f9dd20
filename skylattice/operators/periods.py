"""Period search over whole grids: Lomb-Scargle powers of all frequencies from few sums over the points.

The frequencies of a band stand in steps of 1 / (oversample * span). A key of up to MOST_POINTS points is worked on where its
points meet, each shuffled once: the sums over points change so slowly with frequency that those of a coarse grid, SAMPLES to
a cycle of the span, give all others by Lagrange interpolation through NODES of them (to 1.3e-9 of the sum of |value|).

Keys with more points go block by block. A block of frequencies covers CYCLES cycles of the span. For a block the points are turned back by its first frequency and gathered in the cells of a regular time grid, CELLS for each
cycle, with their first ORDERS moments about the cell's middle: sums that Spark combines where the points lie. So what a block
needs is at most CYCLES * CELLS + 1 rows, however many points a star has, and a star's blocks are worked on side by side. The
sums over cells for all frequencies of a block are one matrix of turning factors times those moments.

Leaving out higher moments costs at most 1.3e-8 of the sum of |value| in the sums with values and 3.7e-6 of the number of
points in those without, so powers are those of the direct sums to about 1e-5 of the strongest.
"""

from __future__ import annotations

from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.expr import clean
from skylattice.operators.shared import cut

# Edges of the bands in days, and grid steps for each 1 / span.
BANDS, OVERSAMPLE = (0.05, 0.1, 0.25, 0.5, 1.1, 2.0, 5.0, 10.0, 50.0), 500
#: Cycles of the span in a block, time cells for each of them, moments, and blocks that a task turns at a time.
CYCLES, CELLS, ORDERS, BLOCKS = 8, 8, 8, 32
#: Points of a key that come to one task as they are; sums for each cycle of the span, and how many of them give one between.
MOST_POINTS, SAMPLES, NODES = 4096, 4, 20
#: Frequencies whose powers are made at a time.
PIECE = 1 << 16
SUMS = [f"{part}{m}" for part in ("yc", "ys", "nc", "ns") for m in range(ORDERS)]


@lru_cache(8)
def _weights(parts: int) -> np.ndarray:
    """(parts, NODES): what each of the NODES equidistant values around an interval counts at each of its equal parts."""
    node = np.arange(NODES) - (NODES // 2 - 1)
    x = np.arange(parts)[:, None] / parts
    out = np.ones((parts, NODES))
    for i in range(NODES):
        for j in range(NODES):
            if i != j:
                out[:, i] *= (x[:, 0] - node[j]) / (node[i] - node[j])
    return out


def _sums(t: np.ndarray, y: np.ndarray, low: float, step: float, first: int, n: int, parts: int) -> np.ndarray:
    """The sums of y * exp(2 pi i f t) at f = low + k * step for k from first (a multiple of parts) on, n of them; only those
    of every parts-th frequency are taken over the points."""
    before = NODES // 2 - 1 if parts > 1 else 0
    count = -(-n // parts) + (NODES - 1 if parts > 1 else 0)
    wide = min(64, count)
    start = low + (first - before * parts) * step
    outer = np.exp(2j * np.pi * ((start + np.arange(-(-count // wide)) * (wide * parts * step))[:, None] * t % 1.0)) * y
    inner = np.exp(2j * np.pi * (np.arange(wide) * (parts * step))[:, None] * t)
    coarse = (outer @ inner.T).ravel()[:count]
    if parts == 1:
        return coarse
    near = np.lib.stride_tricks.sliding_window_view(coarse, NODES)
    weights = _weights(parts).T
    return (near.real @ weights + 1j * (near.imag @ weights)).ravel()[:n]


def _band_powers(t: np.ndarray, y: np.ndarray, low: float, high: float, oversample: int):
    """Frequencies and powers of a band, PIECE by PIECE, of points (t, y); NaN as in _powers."""
    span, points = t.max() - t.min(), len(t)
    step = 1 / (oversample * span)
    t, y = t - t.min() - span / 2, y - y.mean()  # about the middle the sums change most slowly; powers don't depend on it
    one, two = max(1, oversample // SAMPLES), max(1, oversample // (2 * SAMPLES))
    steps, piece = int(np.ceil((high - low) / step)), PIECE // (one * two) * (one * two) or one * two
    for first in range(0, steps, piece):
        n = min(piece, steps - first)
        s = _sums(t, y, low, step, first, n, one)
        n2 = _sums(2 * t, np.ones(points), low, step, first, n, two)
        size, whole = np.abs(n2), s.real**2 + s.imag**2
        with np.errstate(divide="ignore", invalid="ignore"):
            # twice the squared cosine part less that of the sine part, about the time at which the two don't mix
            apart = np.where(size > 0, ((s.real**2 - s.imag**2) * n2.real + 2 * s.real * s.imag * n2.imag) / size, s.real**2 - s.imag**2)
            power = ((whole + apart) / (points + size) + (whole - apart) / (points - size)) / 2
        power[~(points - size > 1e-3 * points)] = np.nan
        yield low + np.arange(first, first + n) * step, power


@lru_cache(2)
def _turns(oversample: int) -> tuple[np.ndarray, np.ndarray]:
    """Turning factors of frequency k of a block for cell c, and the same for twice the frequency."""
    k, c = np.arange(CYCLES * oversample), np.arange(CYCLES * CELLS + 1)
    one = np.exp(2j * np.pi / (CELLS * CYCLES * oversample) * (np.outer(k, c) % (CELLS * CYCLES * oversample)))
    return one, one * one


def _powers(rows: pa.Table, oversample: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, frequencies) of the blocks in rows, which hold their cells: frequencies, and powers of those of the band."""
    column = {c: rows.column(c).to_numpy() for c in ("block", "cell", "points", "steps", "first", "step", *SUMS)}
    nth, one, block = np.unique(column["block"], return_index=True, return_inverse=True)
    single, double = _turns(oversample)
    n, cells = single.shape
    moments = np.zeros((2, cells, len(nth), ORDERS), complex)
    for i, part in enumerate("yn"):
        for m in range(ORDERS):
            moments[i, column["cell"], block, m] = column[f"{part}c{m}"] + 1j * column[f"{part}s{m}"]
    step = 2j * np.pi * np.arange(n) / (CELLS * n)
    sums = []
    for i, turn in enumerate((single, double)):
        by_order = (turn @ moments[i].reshape(cells, -1)).reshape(n, len(nth), ORDERS)
        sums.append(sum(((i + 1) * step[:, None]) ** m / factorial(m) * by_order[:, :, m] for m in range(ORDERS)))
    y, n2 = sums
    points = column["points"][one]
    turned = y * np.exp(-0.5j * np.angle(n2))  # about the time at which sine and cosine don't mix
    size = np.abs(n2)
    with np.errstate(divide="ignore", invalid="ignore"):
        power = (turned.real**2 / ((points + size) / 2) + turned.imag**2 / ((points - size) / 2)) / 2
    power[~(points - size > 1e-3 * points)] = np.nan  # all points at one phase: no sine part to divide by
    k = np.arange(n)
    inside = nth[:, None] * n + k < column["steps"][one][:, None]
    frequency = column["first"][one][:, None] + k * column["step"][one][:, None]
    return np.where(inside, frequency, np.nan), np.where(inside, power.T, np.nan)


def _table(rows: pa.Table, frequency: np.ndarray, power: np.ndarray) -> pa.Table:
    same = pa.array(np.zeros(len(power)), pa.int32())
    return pa.table({"k": rows.column("_key").take(same), "band": rows.column("band").take(same), "frequency": pa.array(frequency, pa.float64()), "power": pa.array(power, pa.float64())})


def _plain(points: DataFrame, key: str, time: str, value: str) -> DataFrame:
    t, y = clean(F.col(time).cast("double")), clean(F.col(value).cast("double"))
    return points.select(F.col(key).alias("_key"), t.alias("t"), y.alias("y")).where("_key is not null and t is not null and y is not null")


def _parted(points: DataFrame, key: str, time: str, value: str) -> tuple[DataFrame, DataFrame | None]:
    """Keys with their points in one row (_key, points), and the points (_key, t, y) of those that have more than MOST_POINTS,
    if there are such keys."""
    plain = _plain(points, key, time, value)
    large = plain.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_POINTS).select("_key")
    large = cut(large)  # keys with MOST_POINTS rows each at least
    none = large.isEmpty()
    few = plain if none else plain.join(large, "_key", "left_anti")
    # as many partitions as there are: little data, much work for each row
    few = few.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").groupBy("_key").agg(F.collect_list(F.struct("t", "y")).alias("points"))
    return few, None if none else plain.join(large, "_key", "left_semi")


def _by_key(few: DataFrame, kind: str, bands: tuple[float, ...], oversample: int, keep) -> DataFrame:
    """k, band, frequency, power of keys with their points in one row; keep picks among the pieces of a band."""

    def made(keys: pa.Array, held: list) -> pa.RecordBatch:
        row, band = (np.repeat(np.array([h[i] for h in held], np.int32), [len(h[3]) for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(band), *[pa.array(np.concatenate([h[i] for h in held]), pa.float64()) for i in (2, 3)]], names=["k", "band", "frequency", "power"])

    def run(batches):
        for batch in batches:
            lists, held, size = batch.column("points"), [], 0
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            every_t, every_y = flat.field("t").to_numpy(), flat.field("y").to_numpy()
            for i in range(batch.num_rows):
                t, y = every_t[ends[i] : ends[i + 1]], every_y[ends[i] : ends[i + 1]]
                if len(t) < 3 or not t.max() > t.min():
                    continue
                for band, (short, long) in enumerate(zip(bands, bands[1:])):  # noqa: B905
                    for frequency, power in keep(_band_powers(t, y, 1 / long, 1 / short, oversample)):
                        held.append((i, band, frequency, power))
                        size += len(power)
                        if size >= PIECE or len(held) >= PIECE // 64:
                            yield made(batch.column("_key"), held)
                            held, size = [], 0
            if held:
                yield made(batch.column("_key"), held)

    return few.mapInArrow(run, f"k {kind}, band int, frequency double, power double")


def _blocks(plain: DataFrame, bands: tuple[float, ...], oversample: int) -> DataFrame:
    """The cells of every block of points (_key, t, y): _key, band, chunk, block, cell, points, steps, first, step and the sums of moments."""
    star = plain.groupBy("_key").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("span"), F.avg("y").alias("mean"), F.count("*").alias("points")).where("span > 0 and points > 2")
    edges = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(1 / long).alias("low"), F.lit(1 / short).alias("high")) for i, (short, long) in enumerate(zip(bands, bands[1:]))])  # noqa: B905
    star = star.withColumn("step", 1 / (F.lit(float(oversample)) * F.col("span"))).select("*", F.inline(edges))
    star = star.withColumn("steps", F.ceil((F.col("high") - F.col("low")) / F.col("step")))
    star = star.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("steps") - 1) / (CYCLES * oversample)))))
    star = star.withColumn("first", F.col("low") + F.col("block") * (CYCLES * oversample) * F.col("step"))
    lain = plain.join(star, "_key").withColumn("_u", (F.col("t") - F.col("start")) / F.col("span") * (CYCLES * CELLS)).withColumn("cell", F.round("_u").cast("int"))
    lain = lain.withColumn("_d", F.col("_u") - F.col("cell")).withColumn("_p", 2 * np.pi * F.pmod(F.col("first") * (F.col("t") - F.col("start")), F.lit(1.0))).withColumn("_y", F.col("y") - F.col("mean"))
    sums = {"yc": F.col("_y") * F.cos("_p"), "ys": F.col("_y") * F.sin("_p"), "nc": F.cos(2 * F.col("_p")), "ns": F.sin(2 * F.col("_p"))}
    own = ["_key", "band", "block", "cell", "points", "steps", "first", "step"]
    cells = lain.groupBy(*own).agg(*[F.sum(x * F.pow("_d", m)).alias(f"{n}{m}") for n, x in sums.items() for m in range(ORDERS)])
    # as many partitions as there are: little data, much work for each row
    return cells.withColumn("chunk", F.floor(F.col("block") / BLOCKS)).repartition(int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "band", "chunk")


def spectrum(points: DataFrame, key: str, time: str, value: str, *, bands: tuple[float, ...] = BANDS, oversample: int = OVERSAMPLE) -> DataFrame:
    """key, band, frequency, power: every frequency of every band, from the longest period of each in equal steps.

    Points without key, time or value go; keys with fewer than three points, or all at one time, have no spectrum. Power is
    that of the mean-free values, NULL where all points fall on one phase of a frequency.
    """
    kind = dict(points.dtypes)[key]

    def run(rows: pa.Table) -> pa.Table:
        frequency, power = _powers(rows, oversample)
        inside = ~np.isnan(frequency)
        return _table(rows, frequency[inside], power[inside])

    few, large = _parted(points, key, time, value)
    found = _by_key(few, kind, bands, oversample, iter)
    if large is not None:
        found = found.unionByName(_blocks(large, bands, oversample).groupBy("_key", "band", "chunk").applyInArrow(run, f"k {kind}, band int, frequency double, power double"))
    return found.select(F.col("k").alias(key), "band", "frequency", F.nanvl("power", F.lit(None)).alias("power"))


def band_peaks(points: DataFrame, key: str, time: str, value: str, *, bands: tuple[float, ...] = BANDS, oversample: int = OVERSAMPLE) -> DataFrame:
    """key, band, period, power: the strongest frequency of each band, of equals the lowest; see spectrum()."""
    kind = dict(points.dtypes)[key]

    def run(rows: pa.Table) -> pa.Table:
        frequency, power = _powers(rows, oversample)
        strongest = [] if np.isnan(power).all() else [int(np.nanargmax(power))]
        return _table(rows, frequency.ravel()[strongest], power.ravel()[strongest])

    def strongest(pieces):
        best = None
        for frequency, power in pieces:
            if not np.isnan(power).all():
                i = int(np.nanargmax(power))
                if best is None or power[i] > best[1]:
                    best = frequency[i], power[i]
        if best is not None:
            yield np.array([best[0]]), np.array([best[1]])

    few, large = _parted(points, key, time, value)
    found = _by_key(few, kind, bands, oversample, strongest)
    if large is not None:
        found = found.unionByName(_blocks(large, bands, oversample).groupBy("_key", "band", "chunk").applyInArrow(run, f"k {kind}, band int, frequency double, power double"))
    best = found.groupBy("k", "band").agg(F.max_by("frequency", F.struct("power", -F.col("frequency"))).alias("_f"), F.max("power").alias("power"))
    return best.select(F.col("k").alias(key), "band", (1 / F.col("_f")).alias("period"), "power")


def find_period(points: DataFrame, key: str, time: str, value: str, *, hints: DataFrame | None = None, bands: tuple[float, ...] = BANDS, oversample: int = OVERSAMPLE) -> DataFrame:
    """key, period, power, band of the strongest band, of equals the shorter periods; a positive hint (key, period) is taken
    as it is, without a search."""
    known = hints.where(clean(F.col("period").cast("double")) > 0).select(key, F.col("period").cast("double").alias("period")) if hints is not None else None
    open_ = points.join(known, key, "left_anti") if known is not None else points
    peaks = band_peaks(open_, key, time, value, bands=bands, oversample=oversample)
    best = peaks.groupBy(key).agg(F.max_by(F.struct("period", "power", "band"), F.struct("power", -F.col("band"))).alias("_b")).select(key, "_b.period", "_b.power", "_b.band")
    if known is None:
        return best
    hinted = points.select(key).distinct().join(known, key).select(key, "period", F.lit(None).cast("double").alias("power"), F.lit(None).cast("int").alias("band"))
    return best.unionByName(hinted)
