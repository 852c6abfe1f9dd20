"""A content-addressed store of token ids: unique chunks, document recipes and Merkle manifests, all as Parquet.

    chunks/     kind=chunk: digest, n, data (ids as little-endian 16 or 32-bit integers); each digest once
    recipes/    number, doc_id, version, start, n_tokens, chunks (digests in order), root; ascending doc_id by bucket
    manifest/   level, node, children, tokens, hash: a Merkle tree over the documents in order, FANOUT children to a node;
                the only node of the highest level is the store's root

A rolling hash over the last ids cuts a document's stream where its low bits are zero, so an edit moves only the cuts
beside it and equal passages give equal chunks. Chunk data crosses the network once, to meet its copies.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, key_buckets, partitions, row_version, text_slices, tidy, window_hashes
from .tokens import word_ids

#: Ids in the rolling hash's window; one cut in so many ids on average; the longest chunk.
WINDOW, EVERY, LONGEST = 16, 256, 4096
#: Documents whose roots one manifest row covers, about.
MANIFEST_DOCS = 50_000
DIGEST = 16
#: Children of a node of the manifest.
FANOUT = 256
#: Digests that a task remembers, so that it sends the copies of a chunk once.
RECENT = 200_000


def cuts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts over the ids of all documents (offsets at), and the number of chunks before each document."""
    mark = np.zeros(len(ids) + 1, bool)
    roll = window_hashes(ids, WINDOW)
    mark[np.flatnonzero((roll & np.uint64(EVERY - 1)) == 0) + WINDOW] = True
    # a window that reaches into the document before depends on it: no cut there
    for k in range(1, WINDOW):
        inside = at[:-1][np.diff(at) >= k] + k
        mark[inside] = False
    mark[at] = True
    starts = np.flatnonzero(mark[: len(ids)])
    size = np.diff(np.append(starts, len(ids)))
    pieces = -(-size // LONGEST)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + nth * LONGEST
    return starts, np.searchsorted(starts, at)


def _chunk_rows(source: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    kind = dict(source.dtypes)["doc_id"]

    def run(batches):
        encoder = word_ids(tokenizer)
        seen: set[bytes] = set()  # what this task has sent lately
        for batch in text_slices(batches, "text"):
            if len(seen) > RECENT:
                seen = set()
            ids, at = encoder.ids(batch.column("text"))
            n = len(at) - 1
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(n + 1)
            starts, first = cuts(ids, at)
            ends = np.append(starts[1:], len(ids))
            narrow = len(ids) == 0 or int(ids.max()) < 1 << 16
            raw = ids.astype("<u2" if narrow else "<u4").tobytes()
            width = 2 if narrow else 4
            data = [raw[width * a : width * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            digest = [hashlib.blake2b(d, digest_size=DIGEST, person=b"ids%d" % width).digest() for d in data]
            size = ends - starts
            unique = [i for i, d in enumerate(digest) if not (d in seen or seen.add(d))]
            recipe = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(digest, pa.binary()))
            sizes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(size, pa.int64()))
            yield _rows("recipe", n, batch, digest=recipe, sizes=sizes)
            yield _rows("chunk", len(unique), None, data=pa.array([data[i] for i in unique], pa.binary()), own=pa.array([digest[i] for i in unique], pa.binary()), kind_type=batch.schema.field("doc_id").type)

    def _rows(name, n, batch, digest=None, sizes=None, data=None, own=None, kind_type=None):
        keys = batch.column("doc_id") if batch is not None else pa.nulls(n, kind_type)
        version = batch.column("version") if batch is not None else pa.nulls(n, pa.int64())
        bucket = batch.column("bucket") if batch is not None else pa.nulls(n, pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * n), own if own is not None else pa.nulls(n, pa.binary()), keys, version, bucket, data if data is not None else pa.nulls(n, pa.binary()), digest if digest is not None else pa.nulls(n, pa.list_(pa.binary())), sizes if sizes is not None else pa.nulls(n, pa.list_(pa.int64()))],
            names=["kind", "digest", "doc_id", "version", "bucket", "data", "chunks", "sizes"],
        )

    return source.mapInArrow(tidy(run), f"kind string, digest binary, doc_id {kind}, version long, bucket int, data binary, chunks array<binary>, sizes array<long>")


def write_store(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode docs and write the store under path.

    A null text is empty and still has its end id. Rows of equal key are told apart by a hash of their text; rows equal in
    both are kept, each with a recipe of its own. A very long text is one recipe of many chunks. An empty table gives a store
    without rows; other columns of docs aren't stored.
    """
    spark = docs.sparkSession
    rows = docs.count()
    bounds = key_buckets(docs, key, max(1, min(4096, -(-rows // MANIFEST_DOCS))))
    source = docs.select(docs[key].alias("doc_id"), row_version(docs[text]).alias("version"), bucket_of(docs[key], bounds).alias("bucket"), docs[text].alias("text"))
    made = _chunk_rows(source, tokenizer, end_id)
    # copies of a chunk meet here: they are equal, so any one stays; recipes spread by their own hash
    spread = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "version"))
    dealt = made.repartition(partitions(spark), spread)

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            own = batch.column("digest").to_pylist()
            keep = []
            for i, d in enumerate(own):
                if d is None or d not in seen:
                    keep.append(i)
                    if d is not None:
                        seen.add(d)
            yield batch.take(pa.array(keep, pa.int32()))

    dealt.mapInArrow(tidy(once), made.schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = _raw(spark, path, made.schema).where("kind = 'recipe'").select("bucket", "doc_id", "version", "chunks", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))
    root = F.sha2(F.array_join(F.transform("chunks", F.hex), "").cast("binary"), 256)
    totals = recipes.groupBy("bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    base = totals.select(F.col("bucket").alias("_b"), F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("_base"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("_before"))
    order = Window.partitionBy("bucket").orderBy("doc_id", "version")
    ordered = recipes.withColumn("_in", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_nth", F.row_number().over(order)).join(F.broadcast(base), F.col("bucket") == F.col("_b"))
    ordered = ordered.select("bucket", (F.col("_before") + F.col("_nth") - 1).alias("number"), "doc_id", "version", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "chunks", root.alias("root"))
    ordered.repartitionByRange(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "doc_id", "version").write.option("compression", "zstd").parquet(f"{path}/recipes")
    leaves = spark.read.parquet(f"{path}/recipes").select(F.col("number").alias("node"), "n_tokens", "root")
    below, level, n = leaves.select("node", F.col("n_tokens").alias("tokens"), F.col("root").alias("hash")), 0, rows
    while n:
        n, level = -(-n // FANOUT), level + 1
        _nodes(below).withColumn("level", F.lit(level)).write.mode("append").parquet(f"{path}/manifest")
        below = spark.read.parquet(f"{path}/manifest").where(F.col("level") == level).select("node", "tokens", "hash")
        if n == 1:
            break
    if not rows:
        _nodes(below).withColumn("level", F.lit(1)).write.parquet(f"{path}/manifest")


def _raw(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/chunks")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, data binary, kind string").parquet(f"{path}/chunks").where("kind = 'chunk'").select("digest", "data")


def _nodes(below: DataFrame) -> DataFrame:
    """The next level of the manifest: node, children, tokens, hash over those of FANOUT nodes (node, tokens, hash) below."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
    up = F.floor(F.col("node") / FANOUT).cast("long")
    return below.groupBy(up.alias("parent")).agg(F.count("*").alias("children"), F.sum("tokens").alias("tokens"), F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("hash")).withColumnRenamed("parent", "node")


def store_root(spark: SparkSession, path: str) -> str | None:
    """The hash that stands for the whole store; None for an empty one."""
    top = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("level")).select("hash").first()
    return top["hash"] if top else None


def crc_matrix() -> list[np.ndarray]:
    """For each k, what 2**k zero bytes do to a CRC-32: 32 words, one for each bit set."""
    row = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    square = lambda m: [_times(m, x) for x in m]
    row = square(square(square(row)))
    out = []
    for _ in range(48):
        out.append(np.array(row, np.uint32))
        row = square(row)
    return out


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def crc_joined(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of the joined parts of each group; groups begin at places `first` and have one part at least."""
    bits = crc_matrix()
    group_end = np.append(first[1:], len(crc))
    total = np.cumsum(n_bytes)
    rest = total[np.repeat(group_end, group_end - first) - 1] - total  # bytes after each part in its group
    value = crc.astype(np.uint32)
    for k in range(int(rest.max(initial=0)).bit_length()):
        on = np.flatnonzero((rest >> k) & 1)
        if len(on):
            v, moved = value[on], np.zeros(len(on), np.uint32)
            for i in range(32):
                moved ^= bits[k][i] * ((v >> np.uint32(i)) & np.uint32(1))
            value[on] = moved
    return np.bitwise_xor.reduceat(value, first)


def chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc of every stored chunk, read from its bytes; a chunk whose bytes don't give its digest is an error."""
    raw = _chunks(spark, path)

    def run(batches):
        for batch in batches:
            n, crc = [], []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist(), strict=True):
                width = next((w for w in (2, 4) if hashlib.blake2b(data, digest_size=DIGEST, person=b"ids%d" % w).digest() == digest), 0)
                if not width:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                n.append(len(data) // width)
                crc.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return raw.mapInArrow(tidy(run), "digest binary, n long, crc long")


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes, after the manifest is checked level by level: each node against what the nodes below it hash to, and the
    lowest against the documents' chunks."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    below = recipes.select(F.col("number").alias("node"), F.col("n_tokens").alias("tokens"), F.sha2(F.array_join(F.transform("chunks", F.hex), "").cast("binary"), 256).alias("hash"))
    levels = manifest.agg(F.max("level")).first()[0] or 1
    for level in range(1, levels + 1):
        now, kept = _nodes(below).select("node", "children", "tokens", "hash"), manifest.where(F.col("level") == level).select("node", "children", "tokens", "hash")
        both = now.join(kept.select(F.col("node").alias("_n"), F.struct("children", "tokens", "hash").alias("_k")), F.col("node") == F.col("_n"), "full_outer")
        wrong = both.where(~F.struct("children", "tokens", "hash").eqNullSafe(F.col("_k"))).count()
        if wrong:
            raise ValueError(f"{wrong} manifest nodes of level {level} of {path} don't match what is below them")
        below = kept.select("node", "tokens", "hash")
    return recipes


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files.

    Chunks are verified and digested where they lie; only digests move. A document's CRC is joined from its chunks'.
    """
    recipes = verified_recipes(spark, path)
    parts = recipes.select("doc_id", "version", "start", F.posexplode("chunks").alias("seq", "digest"))
    facts = parts.join(chunk_facts(spark, path), "digest", "left")
    got = facts.groupBy("doc_id", "version", "start").agg(F.collect_list(F.struct("seq", "n", "crc")).alias("parts"))
    kind = dict(recipes.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [sorted(x, key=lambda p: p["seq"]) for x in batch.column("parts").to_pylist()]
            if any(p["n"] is None for x in lists for p in x) or any([p["seq"] for p in x] != list(range(len(x))) for x in lists):
                raise ValueError("a recipe names a chunk that isn't stored")
            size = np.array([len(x) for x in lists], np.int64)
            n = np.array([p["n"] for x in lists for p in x], np.int64)
            crc = np.array([p["crc"] for x in lists for p in x], np.int64)
            first = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.add.reduceat(n, first)), pa.array(crc_joined(crc, 4 * n, first).astype(np.int64))],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return got.select("doc_id", "start", "parts").mapInArrow(tidy(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document, rebuilt from the store's files."""
    recipes = verified_recipes(spark, path)
    chunks = _chunks(spark, path)
    parts = recipes.select("doc_id", "version", "start", F.posexplode("chunks").alias("seq", "digest")).join(chunks, "digest")
    got = parts.groupBy("doc_id", "version", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "data"))).alias("parts"))
    kind = dict(recipes.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            lists = []
            for parts in batch.column("parts").to_pylist():
                own = []
                for p in parts:
                    width = 2 if hashlib.blake2b(p["data"], digest_size=DIGEST, person=b"ids2").digest() == p["digest"] else 4
                    own.append(np.frombuffer(p["data"], f"<u{width}").astype(np.int32))
                lists.append(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return got.select("doc_id", "start", "parts").mapInArrow(tidy(run), f"doc_id {kind}, start long, ids array<int>")
