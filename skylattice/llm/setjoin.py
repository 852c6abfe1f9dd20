"""An exact set-similarity self-join over records made in tasks (lines or documents), shared by two operators.

Records with the same set are one class from the start. Tokens have one global order: rarest first by a count sketch of
fixed size, then by hash; any fixed order gives exact results, rarity only keeps groups small. A set of n tokens shows its
first n - ceil(t n) + 1 tokens; two sets of similarity t share one of those. Shown tokens travel packed, meet by token,
and tokens shown once drop out at once. In a token's group, pairs are tested by length, place and a parity sketch.

A group of thousands of near copies has millions of pairs, of which a few thousand tell all: pairs are taken in rounds,
one for each record and round at first, and pairs whose answer follows from earlier ones (equal labels) are left out. The
last round takes all pairs still open, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, expand, key_filter, mix, partitions, row_version, split_rows, text_slices, tidy, written

#: Cells of the count sketch (one byte each in a task, summed in longs), and in how many parts it travels.
SKETCH, SKETCH_PARTS = 1 << 20, 64
#: Classes that a task remembers, so that it sends the shown tokens of copies once.
RECENT = 500_000
#: Shown tokens that travel in one row, about.
CHUNK = 1 << 16
#: Labels up to this number are broadcast (16 bytes each); more go through a join.
BROADCAST_LABELS = 500_000
#: Shown tokens that a task gathers before it deals them out, so that rows don't get shorter as parts become more.
PACKED = 1 << 18
#: Classes that are gone of which tasks know; those of any more are taken out of the pairs afterwards.
KNOWN = 1_000_000
#: Pairs that a task looks at in one step.
AT_ONCE = 1 << 18
#: The bits of a token's hash that travel.
SHOWN = np.uint64(0xFFFFFFFF)
#: The words of a parity sketch, 64 bits each: those of 64 bits tell nothing of sets of 150 tokens or more.
PARITY = ("p0", "p1", "p2", "p3")
POSTING = np.dtype([("token", "<u4"), ("cls", "<i8"), *((c, "<u8") for c in PARITY), ("n", "<u4"), ("at", "<u4")])
#: The same with the place of the class in an order of classes, and half the sketch, of the tokens after this one: these are
#: many, and their sets short.
HALF = len(PARITY) // 2
PLACED = np.dtype([*(x for x in POSTING.descr if x[0] not in PARITY[HALF:]), ("rank", "<i8")])


@dataclass(frozen=True)
class Rule:
    """Two sets are linked when over * intersection >= part * union."""

    part: int
    over: int

    def shown(self, n: np.ndarray) -> np.ndarray:
        return n - (-(-self.part * n // self.over)) + 1

    def needed(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return -(-self.part * (n + m) // (self.part + self.over))

    def least(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Shown tokens that linked sets of n and m share at least; see likely()."""
        return self.needed(n, m) - -(-self.part * np.maximum(n, m) // self.over) + 1


#: Makes the records of a slice: row of each record, its number in the row, token hashes and offsets into them; and, if asked
#: for, the same tokens under a second key.
Records = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]


def order_within(group: np.ndarray, key: np.ndarray, *, full: bool = True) -> np.ndarray:
    """The order by group (small numbers, not negative), then by key (unsigned 64 bits).

    One sort of whole words: the group, and as much of the key as fits beside it. Where keys of a group fall together in
    that part and come out of order, the two are sorted in full; not so if any order will do among such keys.
    """
    if not len(group):
        return np.zeros(0, np.int64)
    room = np.uint64(64 - max(1, int(group.max()).bit_length()))
    word = (group.astype(np.uint64) << room) | (key >> (np.uint64(64) - room))
    order = np.argsort(word)
    w, k = word[order], key[order]
    if full and ((w[1:] == w[:-1]) & (k[1:] < k[:-1])).any():
        return np.lexsort((key, group))
    return order


def distinct(tokens: np.ndarray, at: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The different tokens of each record, ordered by hash, their offsets, and what check has of them."""
    record = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = order_within(record, tokens)
    t, r = tokens[order], record[order]
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    return t[keep], np.searchsorted(r[keep], np.arange(len(at))), check[order][keep] if check is not None else None


def signatures(tokens: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(seed)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


@dataclass(frozen=True)
class Order:
    """The levels of the count sketch of tokens, and classes whose 64-bit names stand for several sets: their records go by
    a second name instead, made of other hashes of the same tokens. At 10**12 sets some tens of thousands are to be
    expected, here none."""

    levels: np.ndarray
    shared_names: np.ndarray


def class_names(tokens: np.ndarray, at: np.ndarray, check: np.ndarray | None, order: Order) -> np.ndarray:
    """Names of sets: by their tokens, or by the tokens under the second key (check) where that name stands for several."""
    names = signatures(tokens, at, 1)
    if check is None:
        return names
    return np.where(np.isin(names, order.shared_names), signatures(check, at, 2), names)


def parities(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 bits of each set, each flipped by the tokens that fall on it: two sets differ in as many tokens at least as bits."""
    cell = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)
    word, bit = cell >> np.uint64(6), np.uint64(1) << (cell & np.uint64(63))
    out = np.empty((len(at) - 1, len(PARITY)), np.uint64)
    for w in range(len(PARITY)):
        total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == np.uint64(w), bit, np.uint64(0)))])
        out[:, w] = total[at[1:]] ^ total[at[:-1]]
    return out


def later_parities(tokens: np.ndarray, at: np.ndarray, place: np.ndarray, record: np.ndarray) -> np.ndarray:
    """Half sketches of the tokens of a record after each place: cells that lie half a sketch apart are one."""
    cell = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)
    word, bit = (cell >> np.uint64(6)) % np.uint64(HALF), np.uint64(1) << (cell & np.uint64(63))
    out = np.empty((len(place), HALF), np.uint64)
    for w in range(HALF):
        total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == np.uint64(w), bit, np.uint64(0)))])
        out[:, w] = total[at[record + 1]] ^ total[place + 1]
    return out


def sketches(table: np.ndarray | dict[str, np.ndarray]) -> np.ndarray:
    """The parity sketches of postings, a row each."""
    there = [c for c in PARITY if c in (table.dtype.names if isinstance(table, np.ndarray) else table)]
    return np.stack([table[c].view(np.uint64) if table[c].dtype == np.int64 else table[c] for c in there], axis=1)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, version, text: the version tells rows of one doc_id apart; rows equal in both are interchangeable."""
    return docs.select(docs[key].alias("doc_id"), row_version(docs[text]).alias("version"), F.coalesce(docs[text], F.lit("")).alias("text"))


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - 20)).astype(np.int64)


def first_pass(rows: DataFrame, records: Records) -> tuple[DataFrame, Order]:
    """(doc_id, version, record, n, cls) of every record, and the order of tokens. Sets are told apart by 128 bits."""
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "version", "record", "n", "cls", "other", "part", "cells"]

    def run(batches: Iterator[pa.RecordBatch]):
        sketch, ids, cells = np.zeros(SKETCH, np.uint32), None, []

        def counted():
            if cells:
                np.add(sketch, np.bincount(np.concatenate(cells), minlength=SKETCH), out=sketch, casting="unsafe")
                cells.clear()

        for batch in text_slices(batches, "text"):
            ids = batch.schema.field("doc_id").type
            row, number, tokens, at, check = records(batch, True)
            tokens, at, check = distinct(tokens, at, check)
            cells.append(_cells(tokens).astype(np.uint32))
            if sum(map(len, cells)) > SKETCH:
                counted()
            n = len(row)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("version").take(take), pa.array(number.astype(np.int32)), pa.array(np.diff(at).astype(np.int32)), pa.array(signatures(tokens, at, 1)), pa.array(signatures(check, at, 2)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names
            )
        if ids is not None:
            counted()
            parts = np.minimum(sketch, 255).astype(np.uint8).reshape(SKETCH_PARTS, -1)
            n = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays([pa.nulls(n, ids), *[pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())], pa.array(np.arange(n, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    made = written(rows.mapInArrow(tidy(run), f"doc_id {kind}, version long, record int, n int, cls long, other long, part int, cells binary"), "set-records")

    def add(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(cells, np.uint8).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["part", "cells"])

    # each task adds up its share of the parts; the sums are of fixed size
    parts = made.where("part is not null").select("part", "cells").repartition(SKETCH_PARTS, "part").mapInArrow(tidy(add), "part int, cells binary").collect()
    sketch = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int64)
    for r in parts:
        sketch[r["part"]] = np.frombuffer(r["cells"], "<i8")
    found = made.where("part is null").drop("part", "cells")
    several = found.groupBy("cls").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("cls").collect()
    shared_names = np.array(sorted(r["cls"] for r in several), np.int64)
    if several:
        told = rows.sparkSession.createDataFrame(several, "cls long").withColumn("_several", F.lit(True))
        found = found.join(told, "cls", "left").withColumn("cls", F.when(F.col("_several"), F.col("other")).otherwise(F.col("cls")))
    return found.select("doc_id", "version", "record", "n", "cls"), Order(levels(np.minimum(sketch.ravel(), (1 << 30))), shared_names)


def levels(counts: np.ndarray) -> np.ndarray:
    """How frequent a count below 2**31 is, in 9 bits: exact to 31, sixteen steps in each doubling beyond."""
    return ((np.maximum(counts, 1).astype(np.float32).view(np.uint32) >> np.uint32(19)) - np.uint32(127 << 4)).astype(np.uint16)


def ordered(tokens: np.ndarray, at: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The (different) tokens of each record by the global order: lowest level first, then by hash."""
    record = np.repeat(np.arange(len(at) - 1), np.diff(at))
    level = sketch[_cells(tokens)].astype(np.uint64)
    rank = (level << np.uint64(55)) | (tokens >> np.uint64(9))
    order = order_within(record, rank)
    r, out = rank[order], tokens[order]
    if ((r[1:] == r[:-1]) & (out[1:] != out[:-1])).any():  # tokens that differ in their last bits only
        out = tokens[np.lexsort((tokens, level, record))]
    return out


def shown_tokens(rows: DataFrame, records: Records, sketch: Order, rule: Rule, *, most: int, keep_all: bool, record_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Shown tokens meet: the pairs of the first round, and what later rounds look at.

    Pairs: (a, b, votes), of each record with the `most` first that pass in each group. Tokens: those that
    two classes or more show, all of them or only those of groups cut short, packed by whole groups. A token here is 32 bits of its
    hash: tokens that fall together make a group larger, and where two of one class do, it has a posting for each place.
    Tokens that the count sketch has once lie in one record and don't travel.

    record_bits: rows have a `number` that orders them, and the lowest (number, record) of a class, the record in so many
    bits, goes along as its rank. Then a is the one of lower rank, each record is about the `most` nearest of lower rank in a
    task, and instead of votes pairs have how `far` they are; see placed_pairs(). All tokens have to be kept for more rounds.
    """
    spark, posting = rows.sparkSession, POSTING if record_bits is None else PLACED
    shared = spark.sparkContext.broadcast(sketch)
    n_parts, bits = max(2 * partitions(spark), 8), SHOWN

    def by_part(out: np.ndarray) -> pa.RecordBatch:
        part = (out["token"] % np.uint32(n_parts)).astype(np.int64)
        order = np.argsort((part << 32) | out["token"])
        out, ends = out[order], np.searchsorted(part[order], np.arange(n_parts + 1))
        some = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed_bytes(out[ends[i] : ends[i + 1]]) for i in some.tolist()], pa.binary())], names=["part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[int, int] = {}  # the lowest rank sent
        made = []
        for batch in text_slices(batches, "text"):
            if len(seen) > RECENT:
                seen = {}
            row, number, tokens, at, check = records(batch, bool(len(shared.value.shared_names)))
            tokens, at, check = distinct(tokens, at, check)
            cls = class_names(tokens, at, check, shared.value)
            size = np.diff(at)
            rank = np.zeros(len(cls), np.int64) if record_bits is None else (batch.column("number").to_numpy()[row] << record_bits) | number
            keep = []
            for i, (c, n, r) in enumerate(zip(cls.tolist(), size.tolist(), rank.tolist(), strict=True)):
                if n and r < seen.get(c, r + 1):
                    seen[c] = r
                    keep.append(i)
            if not keep:
                continue
            tokens = tokens[expand(at[keep], size[keep])]
            n, cls, rank = size[keep], cls[keep], rank[keep]
            at = np.concatenate([[0], np.cumsum(n)])
            parity = parities(tokens, at) if record_bits is None else None
            tokens = ordered(tokens, at, shared.value.levels)
            count = rule.shown(n)
            place = expand(at[:-1], count)
            record = np.repeat(np.arange(len(n)), count)
            met = shared.value.levels[_cells(tokens[place])] > 0
            place, record = place[met], record[met]
            out = np.empty(len(place), posting)
            out["token"], out["cls"], out["n"], out["at"] = tokens[place] & bits, cls[record], n[record], place - at[record]
            parity = later_parities(tokens, at, place, record) if parity is None else parity[record]
            for w, c in enumerate(PARITY[: parity.shape[1]]):
                out[c] = parity[:, w]
            if record_bits is not None:
                out["rank"] = rank[record]
            made.append(out)
            if sum(map(len, made)) > PACKED:
                yield by_part(np.concatenate(made))
                made = []
        if made:
            yield by_part(np.concatenate(made))

    def meet(batches: Iterator[pa.RecordBatch]):
        held = [unpacked_bytes(x.as_buffer(), posting) for batch in batches for x in batch.column("packed")]
        if not held:
            return
        every = np.concatenate(held)
        every = every[order_within(every["token"], every["cls"].astype(np.uint64))]
        if record_bits is not None:  # each task sent the lowest rank it met
            new = np.flatnonzero(np.append(True, (every["token"][1:] != every["token"][:-1]) | (every["cls"][1:] != every["cls"][:-1])))
            every["rank"] = np.repeat(np.minimum.reduceat(every["rank"], new), np.diff(np.append(new, len(every))))
        again = (every["token"][1:] == every["token"][:-1]) & (every["cls"][1:] == every["cls"][:-1])
        if (again & (every["at"][1:] != every["at"][:-1])).any():  # a class with two tokens that fall together keeps both places
            every = every[np.lexsort((every["at"], every["cls"], every["token"]))]
            again = (every["token"][1:] == every["token"][:-1]) & (every["cls"][1:] == every["cls"][:-1])
        keep = np.ones(len(every), bool)
        keep[1:] = ~again | (every["at"][1:] != every["at"][:-1])
        every = every[keep]
        same = every["token"][1:] == every["token"][:-1]
        many = np.zeros(len(every), bool)
        many[1:] |= same
        many[:-1] |= same
        every = every[many]
        if record_bits is not None:
            low, high, votes = placed_pairs(every, rule, most)
        else:
            token, cls, n, at = (every[c].astype(np.int64) for c in ("token", "cls", "n", "at"))
            a, b, short = pairs_of_groups(token, cls, cls, sketches(every), n, at, rule, most, 0)
            low, high, votes = counted_pairs(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(votes), pa.nulls(len(low), pa.binary())], names=names)
        left = every if keep_all else every[np.isin(token, short)]
        if not len(left):
            return
        parts = packed_groups(left)
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(parts, pa.binary())], names=names)

    names = ["a", "b", "votes", "packed"]
    packed = rows.mapInArrow(tidy(run), "part int, packed binary").repartition(n_parts, "part")
    made = written(packed.mapInArrow(tidy(meet), "a long, b long, votes long, packed binary"), "set-tokens")
    pairs = made.where("packed is null").groupBy("a", "b").agg((F.sum if record_bits is None else F.min)("votes").alias("votes"))
    return pairs if record_bits is None else pairs.withColumnRenamed("votes", "far"), made.where("packed is not null").select("packed")


def unpacked(shown: DataFrame) -> DataFrame:
    """(token, cls, p0 to p3, n, at) of packed groups; the tokens of a group follow each other in one task."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for x in batch.column("packed"):
                e = unpacked_bytes(x.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(e[c].view(np.int64) if c in PARITY else e[c].astype(np.int64)) for c in POSTING.names], names=list(POSTING.names))

    return shown.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in POSTING.names))


def packed_groups(postings: np.ndarray) -> list[bytes]:
    """Postings in the order of tokens, packed so that whole groups stay together, about CHUNK tokens in a row."""
    edges = np.flatnonzero(np.append(True, postings["token"][1:] != postings["token"][:-1]))
    cuts = np.unique(edges[np.searchsorted(edges, np.arange(0, len(postings), CHUNK), "right") - 1])
    return [packed_bytes(postings[i:j]) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(postings)], strict=True)]


def packed_bytes(postings: np.ndarray) -> bytes:
    """Postings, column by column and within a column byte by byte of its words: high bytes are alike and compress."""
    return b"".join(np.ascontiguousarray(postings[c]).view(np.uint8).reshape(len(postings), -1).T.tobytes() for c in postings.dtype.names)


def unpacked_bytes(raw: memoryview | bytes, posting: np.dtype = POSTING) -> np.ndarray:
    data, at = np.frombuffer(raw, np.uint8), 0
    out = np.empty(len(data) // posting.itemsize, posting)
    for c in posting.names:
        kind = posting[c]
        end = at + kind.itemsize * len(out)
        out[c] = np.ascontiguousarray(data[at:end].reshape(kind.itemsize, -1).T).view(kind).ravel()
        at = end
    return out


def counted_pairs(a: np.ndarray, b: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, smaller class first unless they are ordered already, and how often each comes."""
    low, high = (a, b) if ordered else (np.minimum(a, b), np.maximum(a, b))
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new], np.diff(np.append(np.flatnonzero(new), len(low))).astype(np.int64)


def pairs_of_groups(token, label, cls, parity, n, at, rule: Rule, most: int | None, turn: int, rank=None, gone=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes in the groups of equal tokens that pass the filters and differ in label, and tokens cut short.

    Each record meets those before it in its group, one step further at a time, and after `most` pairs no more: its token
    then counts as cut short. The order within a group is by size at first and changes with turn.

    rank and gone: the one of lower rank comes first, and a pair is left out if the other is gone. With `most`, each record
    is that often about the other one, whichever of the two stands first in the group, and no token counts as cut short. With
    rank and without `most`, a pair comes from every shown token that its sets share: then tokens before this one may be
    shared as well.
    """
    nearby = mix(cls.astype(np.int64).view(np.uint64) + np.uint64(turn))
    bits = np.uint64(int(n.max()).bit_length() if len(n) else 1)
    order = order_within(token, nearby if turn else (n.astype(np.uint64) << (np.uint64(64) - bits)) | (nearby >> bits), full=False)
    token, label, cls, parity, n, at = (x[order] for x in (token, label, cls, parity, n, at))
    if rank is not None:
        rank, gone = rank[order], None if gone is None else gone[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
    had = np.zeros(len(token), np.int64)
    open_, d = np.flatnonzero(~first), 0
    left, right, short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(open_):
        d += 1
        open_ = open_[open_ - d >= start[open_]]
        i = open_ - d
        a, b = n[i], n[open_]
        fits = rule.over * np.minimum(a, b) >= rule.part * np.maximum(a, b)
        if not turn:  # by size: what is too short now only gets shorter
            open_, i, a, b, fits = open_[fits], i[fits], a[fits], b[fits], fits[fits]
        need = rule.needed(a, b)
        before = np.minimum(at[i], at[open_]) if rank is not None and not most else 0
        good = fits & (label[i] != label[open_]) & (before + np.minimum(a - at[i], b - at[open_]) >= need)
        if gone is not None:
            good &= ~np.where(rank[i] < rank[open_], gone[open_], gone[i])
        differ = np.bitwise_count(parity[i[good]] ^ parity[open_[good]])
        good[good] &= (differ.sum(1, dtype=np.int64) if differ.ndim > 1 else differ) <= (a + b - 2 * need)[good]
        if good.any():
            one, two = i[good], open_[good]
            if rank is not None:
                one, two = np.where(rank[one] < rank[two], one, two), np.where(rank[one] < rank[two], two, one)
                if most:  # the later one of the pair asks
                    wants = had[two] < most
                    one, two = one[wants], two[wants]
                    np.add.at(had, two, 1)
            left.append(cls[one])
            right.append(cls[two])
            if most and rank is None:
                had[open_[good]] += 1
                done = had[open_] >= most
                more = open_[done]
                short.append(token[more[more - d > start[more]]])
                open_ = open_[~done]
    return np.concatenate(left), np.concatenate(right), np.unique(np.concatenate(short))


def placed_pairs(every: np.ndarray, rule: Rule, most: int | None, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, far): pairs of classes in groups of equal tokens (PLACED, a group's postings one after another), the one of
    lower rank first, that pass the filters as if the token were the first that both have; of each b the `most` nearest or
    all, and none whose b is gone. far tells how much the two differ at least, in parts of their size.

    A set of n with so many tokens before this one can be linked with sets of up to a size: the smaller one of a pair has to
    reach the larger, so it stands among the first of its shown tokens, and the larger one meets a range of sizes of those.
    All tokens before this one are in one of the sets only, and so are those after it that their sketches tell apart.
    """
    if not len(every):
        return (np.zeros(0, np.int64),) * 3
    n, at = every["n"].astype(np.int64), every["at"].astype(np.int64)
    bits = np.uint64(int(n.max()).bit_length())
    order = order_within(every["token"].astype(np.int64), n.astype(np.uint64) << (np.uint64(64) - bits), full=False)
    n, at, token, cls, rank = n[order], at[order], every["token"][order], every["cls"][order], every["rank"][order]
    parity = [every[c][order] for c in PARITY[:HALF]]
    gone = np.zeros(len(n), bool) if gone is None else gone[order]
    group = np.cumsum(np.append(False, token[1:] != token[:-1]))
    largest = (n - at) * (rule.part + rule.over) // rule.part - n
    key = group * (int(n.max()) + 2) + n
    low, high = key - n - (-rule.part * n // rule.over), key - n + np.minimum(n, largest)
    found = [(np.zeros(0, np.int64),) * 3]
    for probes, others in ((~gone, True), (gone, ~gone)):  # of two that are gone neither asks
        probe, short = np.flatnonzero(probes), np.flatnonzero((largest >= n) & others)
        first = np.searchsorted(key[short], low[probe])
        last = np.minimum(np.searchsorted(key[short], high[probe], "right"), np.searchsorted(short, probe))
        count = np.maximum(last - first, 0)
        ends = np.cumsum(count)
        begin = 0
        while begin < len(probe):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
            j, i = np.repeat(probe[begin:end], count[begin:end]), short[expand(first[begin:end], count[begin:end])]
            begin = end
            fits = largest[i] >= n[j]
            i, j = i[fits], j[fits]
            far = at[i] + at[j]
            for p in parity:
                far += np.bitwise_count(p[i] ^ p[j])
            fits = far <= n[i] + n[j] - 2 * rule.needed(n[i], n[j])
            i, j, far = i[fits], j[fits], far[fits]
            far = (far << 20) // (n[i] + n[j])
            i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            fits = ~gone[j] & (cls[i] != cls[j])
            found.append(nearest_pairs(cls[i[fits]], cls[j[fits]], far[fits], most))
    a, b, far = (np.concatenate(x) for x in zip(*found, strict=True))
    return nearest_pairs(a, b, far, most)


def nearest_pairs(a: np.ndarray, b: np.ndarray, far: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, each as near as it comes, of each b the `most` nearest."""
    order = np.lexsort((far, a, b))
    a, b, far = a[order], b[order], far[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    a, b, far = a[new], b[new], far[new]
    if most is not None:
        order = np.lexsort((mix(a.view(np.uint64)), far, b))
        a, b, far = a[order], b[order], far[order]
        start = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
        nth = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        a, b, far = a[nth < most], b[nth < most], far[nth < most]
    return a, b, far


def candidates(shown: DataFrame, labels: DataFrame | None, rule: Rule, *, most: int | None, turn: int) -> DataFrame:
    """(a, b, votes): pairs of classes, a < b, with the number of groups that name them.

    labels: (cls, label), pairs of one label aren't asked for.
    """
    told = unpacked(shown)
    if labels is None:
        told = told.withColumn("label", F.col("cls"))
    else:
        named = labels.withColumnRenamed("cls", "_c")
        few = labels.count() <= BROADCAST_LABELS
        told = told.join(F.broadcast(named) if few else named, F.col("cls") == F.col("_c"), "left").drop("_c").withColumn("label", F.coalesce("label", "cls"))
        if not few:  # that join has parted the groups
            told = told.repartition(max(2 * partitions(shown.sparkSession), 8), "token")
    dealt = told.select("token", "label", "cls", *PARITY, "n", "at")

    def run(batches: Iterator[pa.RecordBatch]):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        c = {x: table[x].to_numpy() for x in table.column_names}
        a, b, _ = pairs_of_groups(c["token"], c["label"], c["cls"], sketches(c), c["n"], c["at"], rule, most, turn)
        low, high, votes = counted_pairs(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(votes)], names=["a", "b", "votes"])

    return dealt.mapInArrow(tidy(run), "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes"))


def open_candidates(shown: DataFrame, gone: DataFrame, rule: Rule, *, most: int | None, turn: int = 0) -> DataFrame:
    """(a, b, votes): pairs of classes, the one of lower rank first, of which the other isn't among the gone (cls).

    Without `most` all of them that share as many shown tokens as linked sets do at least: shown must hold every token that
    two classes show. With it, of each record and group the `most` first.
    """
    spark = shown.sparkSession
    few = gone.count() <= BROADCAST_LABELS

    def paired(c: dict[str, np.ndarray], out: np.ndarray) -> pa.RecordBatch:
        n = c["n"].astype(np.int64)
        a, b, _ = pairs_of_groups(c["token"].astype(np.int64), c["cls"], c["cls"], sketches(c), n, c["at"].astype(np.int64), rule, most, turn, c["rank"], out)
        low, high, votes = counted_pairs(a, b, ordered=True)
        every, first = np.unique(c["cls"], return_index=True)
        size = n[first]
        least = rule.least(size[np.searchsorted(every, low)], size[np.searchsorted(every, high)]) if len(low) else low
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(votes), pa.array(least)], names=["a", "b", "votes", "least"])

    if few:  # they go to the tasks as they are; groups stay packed until then
        known = spark.sparkContext.broadcast(np.sort(gone.toArrow()["cls"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]):
            held = [unpacked_bytes(x.as_buffer(), PLACED) for batch in batches for x in batch.column("packed")]
            if not held:
                return
            every = np.concatenate(held)
            yield paired({c: np.ascontiguousarray(every[c]) for c in PLACED.names}, np.isin(every["cls"], known.value))

        met = shown.mapInArrow(tidy(run), "a long, b long, votes long, least long")
    else:

        def unpack(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for x in batch.column("packed"):
                    e = unpacked_bytes(x.as_buffer(), PLACED)
                    yield pa.RecordBatch.from_arrays([pa.array(e[c].view(np.int64) if c in PARITY else e[c].astype(np.int64)) for c in PLACED.names], names=list(PLACED.names))

        def run(batches: Iterator[pa.RecordBatch]):
            held = [batch for batch in batches if batch.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            c = {x: table[x].to_numpy() for x in table.column_names}
            yield paired(c, np.asarray(c["gone"], bool))

        flat = shown.mapInArrow(tidy(unpack), ", ".join(f"{c} long" for c in PLACED.names))
        named = gone.select(F.col("cls").alias("_c"))
        flat = flat.join(named, F.col("cls") == F.col("_c"), "left").withColumn("gone", F.col("_c").isNotNull()).drop("_c")
        # that join has parted the groups
        met = flat.repartition(max(2 * partitions(spark), 8), "token").mapInArrow(tidy(run), "a long, b long, votes long, least long")
    pairs = met.groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.first("least").alias("least"))
    return (pairs if most else pairs.where("votes >= least")).select("a", "b", "votes")


def open_pairs(shown: DataFrame, gone: DataFrame, rule: Rule, *, most: int | None) -> DataFrame:
    """(a, b, far): placed_pairs() of shown tokens, of which b isn't among the gone (cls), the `most` nearest of each b in a
    task or all. Groups stay packed until they are looked at, one row at a time."""
    some = gone.count() > KNOWN
    known = shown.sparkSession.sparkContext.broadcast(np.append(np.sort((gone.limit(KNOWN) if some else gone).toArrow()["cls"].to_numpy()), np.iinfo(np.int64).max))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for x in batch.column("packed"):
                every = unpacked_bytes(x.as_buffer(), PLACED)
                out = known.value[:-1]
                if len(out):
                    out = known.value[np.searchsorted(out, every["cls"])] == every["cls"]
                a, b, far = placed_pairs(every, rule, most, out if len(out) else None)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far)], names=["a", "b", "far"])

    pairs = shown.mapInArrow(tidy(run), "a long, b long, far long")
    if some:
        pairs = pairs.join(gone.select(F.col("cls").alias("b")), "b", "left_anti")
    return pairs.groupBy("a", "b").agg(F.min("far").alias("far"))


def shown_lists(shown: DataFrame) -> DataFrame:
    """(cls, n, seen): what each class shows that others show too."""
    return written(unpacked(shown).groupBy("cls").agg(F.first("n").cast("long").alias("n"), F.collect_list("token").alias("seen")), "set-lists")


def likely(pairs: DataFrame, lists: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, …) that share enough of what they show.

    Of two linked sets, take the one whose shown tokens end first: at most n - needed of them are missing in the other,
    the rest is shown by both. So linked sets share needed - ceil(t max(n, m)) + 1 shown tokens at least, and as many fewer
    different ones of 32 bits as fall together in one of them.
    """
    one = lists.select(F.col("cls").alias("a"), F.col("n").alias("_n"), F.col("seen").alias("_s"))
    two = lists.select(F.col("cls").alias("b"), F.col("n").alias("_m"), F.col("seen").alias("_t"))
    up = lambda x, y: f"cast(({x} + {y} - 1) div {y} as long)"
    least = F.expr(f"{up(f'{rule.part} * (_n + _m)', rule.part + rule.over)} - {up(f'{rule.part} * greatest(_n, _m)', rule.over)} + 1")
    met = pairs.join(one, "a").join(two, "b")
    return met.where(F.size(F.array_intersect("_s", "_t")) + F.size("_s") - F.size(F.array_distinct("_s")) >= least).select(*pairs.columns)


# ---------------------------------------------------------------- sets of chosen classes


def fetch_sets(rows: DataFrame, records: Records, sketch: Order, wanted: DataFrame) -> DataFrame:
    """(cls, tokens) of wanted records (doc_id, version, record, cls): tokens by global order, most frequent first."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    lists = cut(wanted.groupBy("doc_id", "version").agg(F.collect_set("record").alias("records")))
    may, _ = split_rows(rows, cut(key_filter(lists)))

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for batch in text_slices(batches, "text"):
            row, number, tokens, at, check = records(batch, bool(len(shared.value.shared_names)))
            lists = batch.column("records")
            own, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            asked = (np.repeat(np.arange(batch.num_rows), np.diff(ends)) << 32) | own
            keep = np.flatnonzero(np.isin((row.astype(np.int64) << 32) | number, asked))
            size = np.diff(at)[keep]
            own = expand(at[keep], size)
            tokens, at, check = distinct(tokens[own], np.concatenate([[0], np.cumsum(size)]), check[own] if check is not None else None)
            cls = class_names(tokens, at, check, shared.value)
            tokens = ordered(tokens, at, shared.value.levels)
            raw = [tokens[a:b][::-1].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            new = [i for i, c in enumerate(cls.tolist()) if not (c in seen or seen.add(c))]  # rows that are equal lie in one task
            yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array([raw[i] for i in new], pa.binary())], names=["cls", "tokens"])

    return attach(may, lists, "records").mapInArrow(tidy(run), "cls long, tokens binary")


def sets_of(pairs: DataFrame, rows: DataFrame, records: Records, sketch: Order, firsts: DataFrame) -> DataFrame:
    """(cls, tokens) of the classes that pairs (a, b) name; firsts: (cls, doc_id, version, record), where each is met."""
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    return fetch_sets(rows, records, sketch, firsts.join(named, "cls", "left_semi"))


class Trie:
    """Sets in global order, most frequent first, as a prefix tree with compressed edges.

    Neighbours in sorted order share their beginning with an ancestor; what the probe has of it is counted once.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.places = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = sets
        self.common = [0]
        for p, q in zip(self.places, self.places[1:]):  # noqa: B905
            a, b = sets[p], sets[q]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common.append(int(differ[0]) if len(differ) else m)

    def overlaps(self, probe: np.ndarray, needed: Callable[[int], int]) -> list[tuple[int, int]]:
        """(place, overlap) of the sets whose overlap with the probe reaches needed(size).

        The walk keeps a stack of (depth, overlap so far) along the current path. Where the overlap so far and what is
        left of the longest set below can't reach the lowest bound below, the whole subtree is left at once.
        """
        probe = np.sort(probe)
        out, stack, skip = [], [(0, 0)], 0
        for k, place in enumerate(self.places):
            if k < skip:
                continue
            own, depth = self.sets[place], self.common[k]
            # back to the branching point of this set and the one before
            while stack[-1][0] > depth:
                stack.pop()
            at, got = stack[-1]
            if at < depth:
                got += _members(own[at:depth], probe)
                at = depth
                stack.append((at, got))
            need = needed(len(own))
            if got + len(own) - at < need or got + len(probe) < need:
                continue
            following = self.common[k + 1] if k + 1 < len(self.places) else len(own)
            if at < following <= len(own):  # the part shared with the next set is a node of its own
                got += _members(own[at:following], probe)
                at = following
                stack.append((at, got))
                end, longest, least = k, len(own), need
                while end + 1 < len(self.places) and self.common[end + 1] >= at:
                    end += 1
                    longest = max(longest, len(self.sets[self.places[end]]))
                    least = min(least, needed(len(self.sets[self.places[end]])))
                if got + min(longest - at, len(probe) - got) < least:  # nothing below can reach its bound
                    skip = end + 1
                    continue
                if got + len(own) - at < need:
                    continue
            got += _members(own[at:], probe)
            if got >= need:
                out.append((place, got))
        return out


def _members(tokens: np.ndarray, probe: np.ndarray) -> int:
    if not len(tokens) or not len(probe):
        return 0
    i = np.searchsorted(probe, tokens)
    i[i == len(probe)] = 0
    return int((probe[i] == tokens).sum())


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of pairs whose sets are linked.

    Pairs meet the sets of b by key, then those of a; there the sets of b that came with the same a form a trie that a's
    set walks. Rows of one a may come in several batches: each has its own trie.
    """
    with_b = pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = with_b.select("a", "b", "tokens_b").join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a")), "a").select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_slices(batches, "tokens_b", 16 << 20):
            a = batch.column("a").to_numpy()
            b = batch.column("b").to_numpy()
            left, right = batch.column("tokens_a"), batch.column("tokens_b")
            order = np.argsort(a, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(a[order]) != 0, True)) + 1
            begin, keep = 0, []
            for end in ends.tolist():
                group = order[begin:end]
                begin = end
                probe = np.frombuffer(left[int(group[0])].as_buffer(), np.uint64)
                trie = Trie([np.frombuffer(right[int(i)].as_buffer(), np.uint64) for i in group])
                m = len(probe)
                keep += [int(group[p]) for p, _ in trie.overlaps(probe, lambda n, m=m: int(rule.needed(n, m)))]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")
