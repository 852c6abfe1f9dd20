"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents go longest first, in phases of lengths of which at least so many fit a sequence. A round sorts the open
documents of the phase and all gaps by size, longest first, gaps before documents of the same size, and matches each
document with its successor: the smallest gap that holds it and isn't taken. In that order gaps are opening brackets and
documents closing ones, so the successor of a document is the bracket it closes. Depths come from counts by size (at most
`capacity` rows); ranks within a size settle which of several documents gets which of several gaps, so no gap is named
twice. Documents and gaps of one depth then meet, gaps shrink by what they took, and the next round begins. What finds
no gap opens sequences, each filled before the next begins. Every row moves by (size, shard) or by depth; neither grows
with the data in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, text_slices, tidy, written
from .tokens import word_ids

CAPACITY = 2048
#: Phases: lengths of which so many fit a sequence at least.
PHASES = (1, 2, 3, 4, 6, 8, 16, 32, 128)
#: The rounds of a phase go on while they place one in so many of its open documents at least; the rest opens sequences.
WORTH = 10


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of at most `capacity` ids of each document: key, piece, start, length, ids_crc32.

    A document's ids are those of its text (null: none) and end_id; only longer ones are cut, and just the last piece may
    be shorter. An empty text gives one piece of one id; a very long one as many pieces as it needs. Repeated rows give
    repeated pieces, an empty table gives none, and other columns, whatever their names, are left out.
    """
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches):
        encoder = word_ids(tokenizer)
        for batch in text_slices(batches, "text"):
            ids, at = encoder.ids(batch.column("text"))
            row, piece, length, crc = [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for k in range(0, len(own), capacity):
                    part = own[k : k + capacity]
                    row.append(i)
                    piece.append(k // capacity)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row, pa.int32())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)[key]
    out = source.mapInArrow(tidy(run), f"key {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def _sweep(gaps: DataFrame, docs: DataFrame) -> DataFrame:
    """By size: gaps (size, g) and documents (size, d) met in the order of size; at most `capacity` rows.

    open: greater gaps that are left when this size comes; g: gaps of this size; taken: documents of this size that find
    a gap.
    """
    both = gaps.select("size", "g", F.lit(0).cast("long").alias("d")).unionByName(docs.select("size", F.lit(0).cast("long").alias("g"), "d"))
    both = both.groupBy("size").agg(F.sum("g").alias("g"), F.sum("d").alias("d"))
    down = Window.orderBy(F.col("size").desc())
    level = both.withColumn("after", F.sum(F.col("g") - F.col("d")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # documents that found nothing leave no trace: depths count from the lowest level so far
    lowest = F.least(F.lit(0), F.coalesce(F.min("after").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = level.withColumn("open", F.col("after") - F.col("g") + F.col("d") - lowest)
    return level.select("size", "open", "g", F.least("d", F.col("open") + F.col("g")).alias("taken"))


def _round(gaps: DataFrame, docs: DataFrame, counts: DataFrame, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """Gaps (seq, size, used) and documents (size, rank, nth) matched; and how many of each length found a gap.

    The result has a row for each gap (kind 0), with the length it takes (0: none), and one for each matched document
    (kind 1), with its sequence and place.
    """
    spread = gaps.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)))
    sums = spread.groupBy("size", "shard").agg(F.count("*").alias("n"))
    rows = _sweep(sums.groupBy("size").agg(F.sum("n").alias("g")), counts).toArrow()  # at most `capacity` rows
    taken = {size: n for size, n in zip(rows["size"].to_pylist(), rows["taken"].to_pylist(), strict=True) if n}
    sweep = gaps.sparkSession.createDataFrame(rows)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = spread.withColumn("nth", F.row_number().over(Window.partitionBy("size", "shard").orderBy("seq"))).join(sums.select("size", "shard", before.alias("before")), ["size", "shard"])
    facts = F.broadcast(sweep)  # at most `capacity` rows
    none = F.lit(None).cast("long")
    opening = ranked.join(facts, "size").select(F.lit(0).alias("kind"), "size", "seq", "used", none.alias("rank"), (F.col("open") + F.col("before") + F.col("nth")).alias("depth"))
    closing = docs.join(facts, "size").where("nth <= taken").select(F.lit(1).alias("kind"), "size", none.alias("seq"), none.alias("used"), "rank", (F.col("open") + F.col("g") - F.col("nth") + 1).alias("depth"))
    level = Window.partitionBy("depth").orderBy(F.col("size").desc(), "kind")
    document = F.col("kind") == 1
    met = opening.unionByName(closing).select(
        "kind",
        "size",
        "rank",
        F.when(document, F.lag("seq").over(level)).otherwise(F.col("seq")).alias("seq"),
        F.when(document, F.lag("used").over(level)).otherwise(F.col("used")).alias("used"),
        F.when(document | (F.coalesce(F.lead("kind").over(level), F.lit(0)) == 0), F.lit(0)).otherwise(F.lead("size").over(level)).cast("long").alias("takes"),
    )
    return cut(met), taken


def _openings(left: list[tuple[int, int]], opened: int, capacity: int) -> tuple[pa.Table, int]:
    """How what found no gap opens sequences, longest first, each filled before the next begins. left: lengths, longest
    first, and how many of each; the sequences opened so far come out increased.

    A row says of the documents of one length from the `low`th (exclusive) to the `high`th that they go `each` to a sequence
    from `first` on, beginning at `start` in it: at most three rows for each length, 3 * capacity in all.
    """
    rows, last, room = [], 0, 0
    for size, n in left:
        at = min(n, room // size)
        if at:  # the sequence opened last has room
            rows.append((size, 0, at, last, at, capacity - room))
            room -= at * size
        each = capacity // size
        whole = (n - at) // each
        if whole:
            rows.append((size, at, at + whole * each, opened, each, 0))
            opened += whole
            at += whole * each
        if at < n:
            rows.append((size, at, n, opened, n - at, 0))
            last, room = opened, capacity - (n - at) * size
            opened += 1
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("size", "low", "high", "first", "each", "start"), zip(*rows, strict=True), strict=True)}), opened


def pack(pieces: DataFrame, *, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: which sequence holds each, and where; sequences are filled without gaps.

    Lengths are 1 to capacity; others are an error. Ties, nulls in `order` and repeated rows are told apart by rank alone.
    An empty table gives an empty result. Columns keep their names and values, whatever they are called; those named
    sequence_id or offset are replaced. Pieces of one length may be a third of all: they are ranked in shards whose
    offsets are summed up first.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    shards = 4 * partitions(spark)
    row = F.struct(*[pieces[c] for c in names])
    base = cut(pieces.select(row.alias("row"), pieces[length].cast("long").alias("size"), F.pmod(F.xxhash64(*[pieces[c] for c in order]), F.lit(shards)).alias("shard")))
    sums = base.groupBy("size", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("size", "shard").orderBy(*[F.col(f"row.`{c}`") for c in order]))
    ranked = base.withColumn("nth", number).join(sums.select("size", "shard", before.alias("before")), ["size", "shard"])
    # a piece is known by its length and its rank among those of that length
    ranked = written(ranked.select("row", "size", (F.col("before") + F.col("nth")).alias("rank")), "pack-pieces")
    todo = {int(r["size"]): int(r["n"]) for r in sums.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    if todo and not 1 <= min(todo) <= max(todo) <= capacity:
        raise ValueError(f"lengths go from {min(todo)} to {max(todo)}; allowed are 1 to {capacity}")
    done = dict.fromkeys(todo, 0)
    bounds = sorted({capacity // k for k in PHASES if k <= capacity} | {0}, reverse=True)
    placed, gaps, opened = [], None, 0
    for high, low in zip(bounds, bounds[1:]):  # noqa: B905
        own = sorted((n for n in todo if low < n <= high), reverse=True)
        worth = gaps is not None
        while left := sum(todo[n] - done[n] for n in own):
            rest = [(n, todo[n] - done[n], done[n]) for n in own if todo[n] > done[n]]
            # what changes from round to round is data, not part of the plan: its generated code is compiled once
            counts = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("size", "d", "done"), zip(*rest, strict=True), strict=True)}))
            docs = ranked.select("size", "rank").join(F.broadcast(counts), "size").where("rank > done")
            docs = docs.select("size", "rank", (F.col("rank") - F.col("done")).alias("nth"))
            if worth:
                met, taken = _round(gaps, docs, counts.select("size", "d"), shards)
                placed.append(met.where("kind = 1").select("size", "rank", "seq", "used"))
                gaps = met.where("kind = 0").select("seq", (F.col("size") - F.col("takes")).alias("size"), (F.col("used") + F.col("takes")).alias("used")).where("size > 0")
                for n, found in taken.items():
                    done[n] += found
                worth = sum(taken.values()) * WORTH >= left
                continue
            runs, opened = _openings([(n, d) for n, d, _ in rest], opened, capacity)
            inside = (F.col("nth") > F.col("low")) & (F.col("nth") <= F.col("high"))
            new = docs.join(F.broadcast(spark.createDataFrame(runs)), "size").where(inside).withColumn("at", F.col("nth") - F.col("low") - 1)
            new = cut(new.select("size", "rank", F.expr("first + at div each").alias("seq"), F.expr("start + at % each * size").alias("used")))
            placed.append(new)
            filled = new.groupBy("seq").agg(F.sum("size").alias("used")).where(F.col("used") < capacity)
            filled = filled.select("seq", (F.lit(capacity) - F.col("used")).alias("size"), "used")
            gaps = filled if gaps is None else gaps.unionByName(filled)
            break
    if not placed:
        return pieces.select(*names).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return ranked.join(where, ["size", "rank"]).select("row.*", F.col("seq").alias("sequence_id"), F.col("used").alias("offset"))
