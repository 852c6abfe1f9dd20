"""Document fingerprints of closed syncmers.

A k-mer is chosen when its smallest inner s-mer lies at its first or last place. That depends on the k-mer alone, so
equal passages give equal anchors wherever they stand. A fingerprint keeps the anchors of lowest hash with their places;
two fingerprints are alike by the anchors they share in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, code_points, cut, expand, key_buckets, mix, partitions, row_version, sliding_min, text_slices, tidy, window_hashes

#: Code points of a k-mer and of its inner s-mers.
K, S = 10, 5
#: Anchors of a fingerprint, those of lowest hash. Base-64 signs of an anchor's hash and of its place.
KEPT, HASH_SIGNS, PLACE_SIGNS = 128, 6, 6
#: A symbol that is no code point; K - 1 of them stand before and after each text.
EDGE = 0x110000
#: The signs of base 64 in an order that sorts by value.
SIGNS = np.frombuffer(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", np.uint8)
WIDTH = HASH_SIGNS + PLACE_SIGNS


def padded(points: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with k - 1 edge signs before and after each, so that every text but an empty one has k-mers."""
    size = np.diff(at)
    wide = np.where(size > 0, size + 2 * (k - 1), 0)
    out_at = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(int(out_at[-1]), EDGE, np.uint32)
    out[expand(out_at[:-1] + (k - 1), size)] = points
    return out, out_at


def syncmers(points: np.ndarray, at: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in points where a closed syncmer begins that lies within one text, and the hashes of those k-mers."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = window_hashes(points, s)
    w = k - s + 1
    low = sliding_min(inner, w)
    chosen = (inner[: len(low)] == low) | (inner[w - 1 :] == low)
    inside = np.zeros(n + 1, bool)
    ends = at[1:][np.diff(at) > 0]
    inside[expand(np.maximum(ends - k + 1, 0), np.minimum(k - 1, ends))] = True  # these reach beyond their text's end
    place = np.flatnonzero(chosen & ~inside[: len(low)])
    # two inner windows that overlap cover a k-mer: their hashes name it
    name = mix(inner[place] * np.uint64(0x9E3779B97F4A7C15) + inner[place + k - s]) if k <= 2 * s else window_hashes(points, k)[place]
    return place, name


def fingerprints(points: np.ndarray, at: np.ndarray) -> list[str]:
    """A fingerprint for each text; equal texts have equal ones, and an empty text has an empty one.

    WIDTH signs for each anchor, ordered by hash: the highest bits of the hash, and the place. The nth time that a text
    has a k-mer is an anchor of its own, so a text that repeats itself has as many as others. Texts of any length are
    treated alike: the edge signs give the shortest one anchors too.
    """
    n_texts = len(at) - 1
    wide, wide_at = padded(points, at, K)
    place, name = syncmers(wide, wide_at, K, S)
    row = np.searchsorted(wide_at, place, "right") - 1
    place = place - wide_at[row]
    # how often the k-mer came before in its text
    order = np.argsort(mix(name + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), kind="stable")
    r, v = row[order], name[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    nth = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    value = np.empty(len(r), np.uint64)
    value[order] = mix(v + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6 * HASH_SIGNS)
    # far above the lowest KEPT nothing matters: most of a long text's anchors needn't be sorted
    many = np.bincount(row, minlength=n_texts)
    share = np.where(many > 4 * KEPT, 3.0 * KEPT / np.maximum(many, 1), 1.0)
    low = np.flatnonzero(value.astype(np.float64) < share[row] * 2.0 ** (6 * HASH_SIGNS))
    r, v, p, got = _lowest(row[low], value[low], place[low], n_texts)
    thin = np.flatnonzero((got < KEPT) & (share < 1))
    if len(thin):  # too few were left by chance: take all of those
        again, stay = np.isin(row, thin), ~np.isin(r, thin)
        r2, v2, p2, _ = _lowest(row[again], value[again], place[again], n_texts)
        r, v, p = np.concatenate([r[stay], r2]), np.concatenate([v[stay], v2]), np.concatenate([p[stay], p2])
        order = np.argsort(r, kind="stable")
        r, v, p = r[order], v[order], p[order]
    signs, first = _signs(v, p), np.searchsorted(r, np.arange(n_texts + 1))
    return [signs[WIDTH * a : WIDTH * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _lowest(row: np.ndarray, value: np.ndarray, place: np.ndarray, n: int):
    """The KEPT lowest distinct values of each row with their first places, ordered by row and value."""
    order = np.lexsort((place, value, row))
    r, v, p = row[order], value[order], place[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    r, v, p = r[new], v[new], p[new]
    first = np.searchsorted(r, np.arange(n))
    keep = np.arange(len(r)) - first[r] < KEPT
    r, v, p = r[keep], v[keep], p[keep]
    return r, v, p, np.bincount(r, minlength=n)


def _signs(value: np.ndarray, place: np.ndarray) -> str:
    cells = np.empty((len(value), WIDTH), np.uint8)
    for i in range(HASH_SIGNS):
        cells[:, i] = SIGNS[((value >> np.uint64(6 * (HASH_SIGNS - 1 - i))) & np.uint64(63)).astype(np.int64)]
    for i in range(PLACE_SIGNS):
        cells[:, HASH_SIGNS + i] = SIGNS[(place >> (6 * (PLACE_SIGNS - 1 - i))) & 63]
    return cells.tobytes().decode("ascii")


def likeness(a: str, b: str) -> float:
    """How much of two texts their fingerprints share, 0 to 1: 1 for equal fingerprints, near 0 for unrelated texts.

    Among the lowest anchors of both together, those that both have and that stand in the same order in both; as a
    share of two texts' anchors (twice what is shared by the sum). An empty text is like an empty text only.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    one = {a[i : i + HASH_SIGNS]: a[i + HASH_SIGNS : i + WIDTH] for i in range(0, len(a), WIDTH)}
    two = {b[i : i + HASH_SIGNS]: b[i + HASH_SIGNS : i + WIDTH] for i in range(0, len(b), WIDTH)}
    if one.keys().isdisjoint(two):
        return 0.0
    full = len(one) >= KEPT or len(two) >= KEPT
    union = sorted(one.keys() | two.keys())
    lowest = union[:KEPT] if full else union
    shared = sorted((one[h], two[h]) for h in lowest if h in one and h in two)
    chain: list[str] = []
    for _, place in shared:
        i = bisect_left(chain, place)
        chain[i : i + 1] = [place]
    jaccard = len(chain) / len(lowest)
    return 2 * jaccard / (1 + jaccard)


def _edited(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text but the last, its last quarter replaced by as much of the next one's beginning."""
    size = np.diff(at)
    quarter = size[:-1] // 4
    given = np.minimum(quarter, size[1:])
    keep = size[:-1] - quarter
    start = np.ravel(np.column_stack([at[:-2], at[1:-1]]))
    count = np.ravel(np.column_stack([keep, given]))
    return points[expand(start, count)], np.concatenate([[0], np.cumsum(keep + given)])


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the next row by key, then by a hash of the text; after the last comes the first, so a table of
    one row is its own next. A null text is empty; null keys come first; repeated rows are rows like others. A very long
    text is read whole, and its fingerprint is no longer than others'. An empty table gives an empty result; other columns of
    docs are left out. Rows are cut into ranges of keys, and each range also gets the first row of the next, so no range waits for another.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    n = partitions(spark)
    bounds = key_buckets(docs, key, min(4 * n, 4096))
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("version", row_version(F.col("text"))).withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    heads = cut(rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "version")).alias("head")))
    after = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    borrowed = heads.select(F.col("bucket").alias("_b"), F.col("head.doc_id").alias("_k"), F.col("head.version").alias("_v"), after.alias("_to"))
    # at most 4096 rows, one for each range of keys
    tails = rows.join(F.broadcast(borrowed), (rows["bucket"] == F.col("_b")) & rows["doc_id"].eqNullSafe(F.col("_k")) & (rows["version"] == F.col("_v")))
    tails = tails.select("doc_id", "text", "version", F.col("_to").alias("bucket")).dropDuplicates(["bucket"])
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "version").select("doc_id", "text", "tail")

    def run(batches):
        carry = None
        for batch in text_slices(batches, "text"):
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            carry = batch.slice(batch.num_rows - 1)
            if batch.num_rows < 2:
                continue
            points, at = code_points(batch.column("text"))
            prints = fingerprints(points, at)
            edited, edited_at = _edited(points, at)
            edited_prints = fingerprints(edited, edited_at)
            own = np.flatnonzero(~batch.column("tail").to_numpy(zero_copy_only=False)[:-1])
            raw = edited.tobytes()
            sha = [hashlib.sha256(raw[4 * edited_at[i] : 4 * edited_at[i + 1]].decode("utf-32-le").encode("utf-8")).hexdigest() for i in own.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(own)),
                    pa.array(np.diff(at)[own]),
                    pa.array(sha, pa.string()),
                    pa.array([prints[i] for i in own.tolist()], pa.string()),
                    pa.array([edited_prints[i] for i in own.tolist()], pa.string()),
                    pa.array([likeness(prints[i], edited_prints[i]) for i in own.tolist()], pa.float64()),
                    pa.array([likeness(prints[i], prints[i + 1]) for i in own.tolist()], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    out = dealt.mapInArrow(tidy(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", key)
