"""Vector code compression: product codes with integer codebooks, searched by equal averages.

Entries of a codebook stand in order of their component sums. By Cauchy and Schwarz a vector x of k components and an entry e
have (sum x - sum e)^2 <= k |x - e|^2, so the search starts at the vector's own sum, goes outward on both sides, and leaves a
side when the squared gap of sums over k is strictly above the best distance so far; an entry that ties is still seen.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, tidy, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to this number are broadcast (about 40 bytes each); more are joined.
BROADCAST_LABELS = 100_000
#: Vectors that are searched at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries: parts, entries, components (long)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (n, k) the index of the nearest entry, of equal ones the lowest, and the squared distance."""
    n, k = x.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, total = sums[order], x.sum(axis=1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(order), np.int64)
    middle = np.searchsorted(sums, total)
    for place, step in ((middle.copy(), 1), (middle - 1, -1)):
        open_ = np.arange(n)
        while True:
            open_ = open_[(place[open_] >= 0) & (place[open_] < len(order))]
            gap = total[open_] - sums[place[open_]]
            # gap^2 / k > best, in whole numbers; the gap is bounded, so its square fits
            open_ = open_[-(-gap * gap // k) <= best[open_]]
            if not len(open_):
                break
            entry = order[place[open_]]
            difference = x[open_] - entries[entry]
            d = np.einsum("ij,ij->i", difference, difference)
            nearer = (d < best[open_]) | ((d == best[open_]) & (entry < index[open_]))
            best[open_[nearer]], index[open_[nearer]] = d[nearer], entry[nearer]
            place[open_] += step
    return index, best


def largest(dims: int, parts: int) -> int:
    """Integers beyond this count as this: squared gaps of sums and sums of squared differences then fit a long."""
    return (1 << 30) // max(dims // parts, math.isqrt(dims - 1) + 1)


def _integers(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    """floor(SCALE x) of a batch of arrays of `dims` components."""
    x = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(x * SCALE), -largest(dims, parts), largest(dims, parts)).astype(np.int64)


def _parts_of(column: pa.Array, dims: int, parts: int):
    """The integer vectors of a batch, block by block: (first row, vectors as rows, parts, components)."""
    for at in range(0, len(column), BLOCK):
        block = _integers(column.slice(at, BLOCK), dims, parts)
        yield at, block.reshape(len(block), parts, dims // parts)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd)


def _first_entries(kept: DataFrame, key: str, vector: str, entries: int) -> np.ndarray:
    """The vectors of the smallest keys in order; rows of equal key by their components."""
    rows = kept.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).toArrow()
    return rows.column("v").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))


def train(kept: DataFrame, dims: int, *, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of vectors of `dims` components: the first `entries` rows by key, moved `rounds` times to the floor of their
    means. Only sums and counts by part and entry, combined where the rows lie, come to the driver: parts times entries rows."""
    spark, k = kept.sparkSession, dims // parts
    start = _first_entries(kept, key, vector, entries)
    books = np.ascontiguousarray(_integers(start, dims, parts).reshape(len(start), parts, k).transpose(1, 0, 2))
    spread = kept.select(F.col(vector).alias("v"))
    names = [f"s{i}" for i in range(k)]
    for _ in range(rounds if len(start) else 0):

        def run(batches, books=books):
            count = np.zeros(books.shape[:2], np.int64)
            sums = np.zeros(books.shape, np.int64)
            for batch in batches:
                for _, x in _parts_of(batch.column("v"), dims, parts):
                    for p in range(parts):
                        index, _ = nearest(x[:, p], books[p])
                        count[p] += np.bincount(index, minlength=books.shape[1])
                        np.add.at(sums[p], index, x[:, p])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *[pa.array(sums[p, e, i]) for i in range(k)]], names=["p", "e", "n", *names])

        schema = ", ".join(f"{c} long" for c in ["p", "e", "n", *names])
        moved = spread.mapInArrow(tidy(run), schema).groupBy("p", "e").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *names]])
        books = books.copy()
        for r in moved.collect():  # parts times entries rows at most
            books[int(r["p"]), int(r["e"])] = [int(r[c]) // int(r["n"]) for c in names]
    return Codebooks(books)


def encode(kept: DataFrame, books: Codebooks, dims: int, *, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """kept with its codes (two hexadecimal digits for each part) and errors instead of vectors."""
    columns = [c for c in kept.columns if c != vector and c.lower() not in (code.lower(), error.lower())]
    hold, parts = fresh(kept, "_vector"), books.entries.shape[0]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for at, x in _parts_of(batch.column(hold), dims, parts):
                for p in range(parts):
                    index, d = nearest(x[:, p], books.entries[p])
                    codes[at : at + len(x), p] = index
                    errors[at : at + len(x)] += d
            written_out = ["".join(row) for row in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(written_out, pa.string()), pa.array(errors)], names=[*columns, code, error])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in kept.select(*columns).dtypes], f"`{code}` string", f"`{error}` long"])
    return kept.select(*columns, kept[vector].alias(hold)).mapInArrow(tidy(run), schema)


def decode(codes: DataFrame, books: Codebooks, *, code: str = "code", vector: str = "embedding") -> DataFrame:
    """codes with the vectors that they stand for (array of float) instead of the codes: entries over SCALE."""
    columns = [c for c in codes.columns if c != code and c.lower() != vector.lower()]
    hold = fresh(codes, "_code")

    def run(batches):
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column(hold).to_pylist())), np.uint8).reshape(batch.num_rows, -1)
            values = np.concatenate([books.entries[p][index[:, p]] for p in range(books.entries.shape[0])], axis=1) / SCALE
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], lists], names=[*columns, vector])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in codes.select(*columns).dtypes], f"`{vector}` array<float>"])
    return codes.select(*columns, codes[code].alias(hold)).mapInArrow(tidy(run), schema)


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every usable vector.

    Vectors that are null or hold a null, NaN or infinite component go. So do those that don't have as many components as
    the vector of the smallest key, among those whose number is a multiple of `parts`: they can't be cut into the same
    parts. Integers beyond largest(dims, parts), 134,217,728 for 64 components, count as that. Rows of null key count as the largest, rows of equal
    key stand in the order of their components, repeated rows are rows like others; with fewer rows than entries there are
    fewer entries, and an empty table gives an empty result. Equal distances go to the lower index. Null labels are one
    label. Other columns don't matter.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: 256 entries at most")
    kept = usable(vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.col(label).alias("_label")), "_vector")
    kept = kept.where((F.size("_vector") > 0) & (F.size("_vector") % parts == 0))
    first = _first_entries(kept, "_key", "_vector", 1)
    dims = len(first[0]) if len(first) else parts
    kept = kept.where(F.size("_vector") == dims)
    books = train(kept, dims, key="_key", vector="_vector", parts=parts, entries=entries, rounds=rounds)
    coded = written(encode(kept, books, dims, vector="_vector"), "vector-codes")
    sums = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_other"))
    few = sums.count() <= BROADCAST_LABELS
    told = coded.join(F.broadcast(sums) if few else sums, F.col("_label").eqNullSafe(F.col("_other")))
    return told.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
