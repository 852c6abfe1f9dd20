"""Helpers that the training-data operators share: cutting lineage, Arrow text slices, hashing of spans.

Text columns travel as Arrow batches. Every helper treats a null text as empty, looks at whole texts only, and works on
slices of bounded size, so a batch of very long documents never has to be expanded at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- shared storage


def let_go_of_shuffles(spark: SparkSession) -> None:
    """From now on, what an action has shuffled is deleted when the action ends: rounds would pile it up otherwise. What is
    needed again lies in checkpoints and written tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary folder where that is unset and Spark is local."""
    let_go_of_shuffles(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skylattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Checkpoints after which the driver lets go of plans it no longer needs, so that Spark deletes their shuffles and files.
CLEAN_AFTER = 8
_checkpoints = count(1)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the checkpoint folder, so that a lost executor loses nothing of it."""
    spark = df.sparkSession
    if next(_checkpoints) % CLEAN_AFTER == 0:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: for wide rows, where columns are pruned later."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_version(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# ---------------------------------------------------------------- narrow facts meet wide rows

#: Words of the key filter: 64 bits each, at most 2 MB in all when broadcast.
FILTER_WORDS = 1 << 17


def bitmap(df: DataFrame, h: Column) -> DataFrame:
    """A bitmap of the 64-bit hashes h over df: (word, bits), at most FILTER_WORDS rows; it may say yes wrongly, never no."""
    hashed = df.select(h.alias("_h"))
    bit = F.expr("shiftleft(1L, cast(pmod(_h, 64) as int))")
    return hashed.select(F.pmod(F.shiftright("_h", 6), F.lit(FILTER_WORDS)).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def split(df: DataFrame, h: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash may be in the bitmap, and rows whose hash certainly isn't; neither is shuffled."""
    told = df.withColumn("_h", h).withColumn("_w", F.pmod(F.shiftright("_h", 6), F.lit(FILTER_WORDS)))
    told = told.join(F.broadcast(bits), F.col("_w") == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, cast(pmod(_h, 64) as int))")), F.lit(0)) != 0
    return told.where(hit).select(*df.columns), told.where(~hit).select(*df.columns)


def key_filter(keys: DataFrame) -> DataFrame:
    return bitmap(keys, F.xxhash64("doc_id", "version"))


def split_rows(rows: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows that may be among the keys (doc_id, version) of a key filter, and rows that certainly aren't."""
    return split(rows, F.xxhash64("doc_id", "version"), bits)


def attach(rows: DataFrame, facts: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """rows with the column `name` of facts (doc_id, version, name)."""
    other = facts.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), name)
    return rows.join(other, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["version"] == F.col("_v")), how).drop("_d", "_v")


# ---------------------------------------------------------------- Arrow text


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` holds at most about `limit` bytes in each, with at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of each (one more than there are texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the offsets of each."""
    data, at = utf8(column)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[at]


# ---------------------------------------------------------------- hashing


#: Start, step and the two multipliers of a hash. This one is known to everybody; where hashes decide, a run draws its own.
Key = tuple[int, int, int, int]
PUBLIC: Key = (0x9FB21C651E98DF25, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93)


def secret_keys(n: int) -> list[Key]:
    """Random keys for one run: texts can't be written so that they fall together under them."""
    return [tuple(secrets.randbits(64) | 1 for _ in range(4)) for _ in range(n)]


def mix(x: np.ndarray, key: Key = PUBLIC) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U64(32))
    x *= U64(key[2])
    x ^= x >> U64(32)
    x *= U64(key[3])
    x ^= x >> U64(32)
    return x


#: The lowest 0 to 8 bytes of a word.
LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Bytes of a span that are folded in word by word; what follows goes through one digest.
FOLDED = 512


def eights(symbols: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one word; beyond the end there are zeros. One copy of the bytes, no more."""
    padded = np.zeros(symbols.nbytes + 8, np.uint8)
    padded[:-8] = np.ascontiguousarray(symbols).view(np.uint8)
    return np.ndarray((symbols.nbytes + 1,), "<u8", padded, 0, (1,))


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, key: Key = PUBLIC) -> np.ndarray:
    """64-bit hashes of spans of a byte or code-point array, from their own bytes alone.

    A span's length and its words go through a scramble one after another, so no two texts of a simple form fall together
    as they would under a rolling polynomial. Where equality decides a result, the bytes are compared besides, or two hashes
    of secret keys are.
    """
    word, scale = eights(symbols), symbols.itemsize
    at, left = start.astype(np.int64) * scale, (end - start).astype(np.int64) * scale
    out = mix(left.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64((seed * 0xA24BAED4963EE407 + key[0]) & ((1 << 64) - 1)), key)
    open_: np.ndarray | slice = slice(None)
    for _ in range(FOLDED // 8):
        out[open_] = mix(out[open_] ^ (word[at] & LOWEST[np.minimum(left, 8)]), key) + U64(key[1])
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        open_ = more if isinstance(open_, slice) else open_[more]
        at, left = at[more] + 8, left[more] - 8
    raw = memoryview(np.ascontiguousarray(symbols)).cast("B")
    rest = [int.from_bytes(hashlib.blake2b(raw[a : a + n], digest_size=8).digest(), "little") for a, n in zip(at.tolist(), left.tolist(), strict=True)]
    out[open_] = mix(out[open_] ^ np.array(rest, U64), key)
    return out


def same_spans(symbols: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> bool:
    """Whether each span of so many symbols from start on holds the same bytes as the one from other on."""
    word, scale = eights(symbols), symbols.itemsize
    moved = np.flatnonzero(start != other)
    a, b, left = start[moved] * scale, other[moved] * scale, size[moved] * scale
    for _ in range(FOLDED // 8):
        if ((word[a] ^ word[b]) & LOWEST[np.minimum(left, 8)]).any():
            return False
        more = np.flatnonzero(left > 8)
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
        if not len(left):
            return True
    raw = memoryview(np.ascontiguousarray(symbols)).cast("B")
    return all(raw[i : i + n] == raw[j : j + n] for i, j, n in zip(a.tolist(), b.tolist(), left.tolist(), strict=True))


def distinct_spans(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each different span, and for every span which of those it equals. Hashes propose, bytes decide."""
    _, first, back = np.unique(span_hashes(symbols, start, end), return_index=True, return_inverse=True)
    one = first[back]
    if (end - start == (end - start)[one]).all() and same_spans(symbols, start, start[one], end - start):
        return first, back
    table: dict[bytes, int] = {}
    places = []
    back = np.empty(len(start), np.int64)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        back[i] = table.setdefault(symbols[a:b].tobytes(), len(table))
        if back[i] == len(places):
            places.append(i)
    return np.array(places, np.int64), back


def window_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all spans of k symbols, by doubling: two spans that overlap or touch make the one they cover."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, U64)
    if symbols.dtype == np.uint8 and k >= 8:
        h, have = mix(eights(symbols)[: n - 7]), 8
    else:
        h, have = mix(symbols.astype(U64) + U64(0x9FB21C651E98DF25)), 1
    while have < k:
        step = min(have, k - have)
        joined = h[: len(h) - step] * U64(0x9E3779B97F4A7C15)
        joined += h[step:]
        h = mix(joined)
        have += step
    return h


def span_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of spans of bytes, as two columns of longs: equal digests stand for equal bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    out = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    two = np.frombuffer(out, np.int64).reshape(-1, 2)
    return two[:, 0].copy(), two[:, 1].copy()


def let_go() -> None:
    """Give memory that freed arrays and batches have left in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows and bytes of an Arrow batch on its way to a worker: texts can be long, and the JVM keeps buffers as large as the
#: largest batch that it has sent.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def tidy(run):
    """A task function for mapInArrow that gets its rows in small batches and gives its memory back when it ends."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        let_go_of_shuffles(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            let_go()

    return wrapped


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words precede each text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    gap = SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:n]
    stop = ~gap
    stop[:-1] &= gap[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, at)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    shift = start - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(start) else start
    return np.repeat(shift, count) + np.arange(total, dtype=np.int64)


# ---------------------------------------------------------------- order over the whole table


def key_buckets(df: DataFrame, key: str, n: int) -> list[int]:
    """Bounds that cut a long column into about n buckets of equal row counts; few and small enough for a literal."""
    got = df.select(key).where(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted({int(x) for x in got})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at most key; null keys come first."""
    if not bounds:
        return F.lit(0)
    bucket = F.coalesce(key, F.lit(-(1 << 63)))
    # array_position on a sorted literal would be linear; a typed sequence search keeps this inside the code generator
    return _search(bucket, bounds, 0, len(bounds))


def _search(key: Column, bounds: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < F.lit(bounds[mid]), _search(key, bounds, low, mid)).otherwise(_search(key, bounds, mid + 1, high))
