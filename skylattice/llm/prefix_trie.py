"""Conversation prefix tries: double arrays by prefix shard, and shared upper nodes merged over all shards.

Turns are named by 128-bit digests of role and text. Equal conversations become one class with a count, so copies weigh
nothing. Classes are dealt into ranges of their turn names, whole prefixes side by side, and each range is read in runs of
bounded size; a run is a shard. In a shard turns get dense ids, BASE and CHECK are packed over them, and a walk along the
arrays gives every class its nodes. A node lies in two shards only if it is on the first or the last path of each of them:
those are merged by name, and what their subtrees gather in all shards is added up; all other nodes are whole where they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, tidy, written

#: Turns in a shard, about; a longer conversation is a shard of its own.
SHARD_TURNS = 1 << 18
#: Turns that order the classes; beyond them a hash of the whole does, so that no common beginning is one range.
ORDERED = 8
#: Places at which children of several turns are tried before they go to the end of the arrays.
TRIES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)


def turn_sequences(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id (long) and turns: an array of (name, words) in the order of turn, null first.

    Null role and text count as empty; of equal turns the one whose digest is lower comes first, repeated rows are turns
    like others. Rows without a conversation id belong to none and go. A conversation is one row of the result, 24 bytes a
    turn, as a document is one row; its texts never meet.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    framed = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    name = F.substring(F.unhex(F.sha2(framed, 256)), 1, 16)
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"),
        F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), name.alias("name"), F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words")).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("turns"))


def with_borrowed_heads(sequences: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every instead, h = crc32(c) % heads: all of
    them if that one has fewer, none if it is absent; then c's own turns after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    lenders = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_lender"), F.slice("turns", 1, heads - 1).alias("_head"))
    none = F.array().cast(sequences.schema["turns"].dataType)
    joined = sequences.withColumn("_h", h).join(lenders, F.col("conv_id") - F.col("conv_id") % every == F.col("_lender"), "left")
    head = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


# ---------------------------------------------------------------- one shard


class DoubleArray:
    """A trie over dense ids: the child of node s by id c is t = BASE[s] + c, if CHECK[t] = s. Node 0 is the root."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        """ids: those of all paths one after another, from offsets on."""
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = -2
        self.low = self.high = 1  # no place before low is free, none from high on is taken
        self.width = int(ids.max()) + 1 if len(ids) else 1
        size = np.diff(offsets)
        at = np.zeros(len(size), np.int64)
        for depth in range(int(size.max()) if len(size) else 0):
            open_ = np.flatnonzero(size > depth)
            code = ids[offsets[open_] + depth]
            edge, back = np.unique(at[open_] * self.width + code, return_inverse=True)
            at[open_] = self._put(edge // self.width, edge % self.width)[back]

    def _grow(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free places."""
        reach = 2 * n + 1024
        while True:
            self._grow(self.low + reach)
            found = np.flatnonzero(self.check[self.low : self.low + reach] == -1)[:n] + self.low
            if len(found) == n:
                return found
            reach *= 2

    def _put(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Place edges, sorted by parent and id; the children's places."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(parent)))
        place = np.zeros(len(parent), np.int64)
        for i in np.flatnonzero(count > 1).tolist():
            a, z = first[i], first[i] + count[i]
            place[a:z] = self._base_for(code[a:z]) + code[a:z]
            self.check[place[a:z]], self.base[parent[a]] = parent[a], place[a] - code[a]
            self.high = max(self.high, int(place[z - 1]) + 1)
        alone = first[count == 1]
        if len(alone):
            place[alone] = self._free(len(alone))
            self.check[place[alone]], self.base[parent[alone]] = parent[alone], place[alone] - code[alone]
            self.low = int(place[alone][-1]) + 1
        self.high = max(self.high, int(place.max()) + 1)
        return place

    def _base_for(self, code: np.ndarray) -> int:
        """The lowest base tried at which all children find a free place."""
        candidates = self._free(max(1, min(4096, TRIES // len(code)))) - code[0]
        self._grow(int(candidates[-1] + code[-1]) + 1)
        fits = (self.check[candidates[:, None] + code[None, :]] == -1).all(axis=1)
        if fits.any():
            return int(candidates[np.argmax(fits)])
        self._grow(self.high - int(code[0]) + int(code[-1]) + 1)
        return self.high - int(code[0])

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children of these nodes by these ids; -1 where there is none."""
        to = self.base[node] + code
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == node), to, -1)


NODE = "run long, key binary, parent_key binary, shared boolean, open boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"


def shard_nodes(run: int, conv: np.ndarray, copies: np.ndarray, ends: list[str], names: list[bytes], words: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The nodes of a shard: classes in their order, with smallest conversation, copies, digest of their conversations, and
    turns (names, words) from offsets on. Of shared nodes only what the nodes below that aren't shared give."""
    dense: dict[bytes, int] = {}
    ids = np.array([dense.setdefault(x, len(dense)) for x in names], np.int64)
    turn_names = list(dense)
    trie = DoubleArray(ids, offsets)
    size, n = np.diff(offsets), len(trie.check)
    count, least, weight = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    depth_of, shared = np.zeros(n, np.int64), np.zeros(n, bool)
    key: dict[int, bytes] = {0: ROOT}
    ended: dict[int, str] = {}
    levels, at = [np.zeros(1, np.int64)], np.zeros(len(size), np.int64)
    shared[0] = True
    depth = 0
    open_ = np.arange(len(size))
    while True:
        np.add.at(count, at[open_], copies[open_])
        np.minimum.at(least, at[open_], conv[open_])
        for i in open_[size[open_] == depth].tolist():
            ended[int(at[i])] = ends[i]
        open_ = open_[size[open_] > depth]
        if not len(open_):
            break
        turn = offsets[open_] + depth
        depth += 1
        at[open_] = trie.step(at[open_], ids[turn])
        place, one = np.unique(at[open_], return_index=True)
        weight[place], depth_of[place] = words[turn[one]], depth
        parent = trie.check[place]
        for t, p, c in zip(place.tolist(), parent.tolist(), ids[turn[one]].tolist(), strict=True):
            key[t] = hashlib.blake2b(key[p] + turn_names[c], digest_size=16).digest()
        if depth > ORDERED:
            shared[place] = shared[parent]
        else:
            for edge in (0, len(size) - 1):
                if size[edge] >= depth:
                    shared[at[edge]] = True
        levels.append(place)
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for place in reversed(levels):
        own = place[~shared[place]]
        leaves[own] += children[own] == 0
        saved[own] += (count[own] - 1) * weight[own]
        np.add.at(children, trie.check[own], 1)
        below = place[place > 0]
        for total in (leaves, saved):
            np.add.at(total, trie.check[below], total[below])
    node = np.concatenate(levels)
    parent = np.where(node == 0, 0, trie.check[node])
    near = shared[node] | shared[parent]
    top = node == 0
    listed = node.tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(node), run)),
            pa.array([key[i] if k else None for i, k in zip(listed, near.tolist(), strict=True)], pa.binary()),
            pa.array([key[p] if k and not t else None for p, k, t in zip(parent.tolist(), near.tolist(), top.tolist(), strict=True)], pa.binary()),
            pa.array(shared[node]),
            pa.array(shared[parent] & ~shared[node]),
            pa.array(least[node]),
            pa.array(depth_of[node]),
            pa.array(least[parent], mask=top),
            *[pa.array(x[node]) for x in (count, children, leaves, saved, weight)],
            pa.array([ended.get(i) for i in listed], pa.string()),
        ],
        names=[c.split()[0] for c in NODE.split(", ")],
    )


# ---------------------------------------------------------------- all shards


def _ends(sequences: DataFrame) -> DataFrame:
    """seq, ends: SHA-256 of the decimal conversation ids of each whole sequence, ascending, with commas between.

    Ids are ordered over all tasks and joined in pieces of at most a batch; what is hashed one after the other in a task
    are those pieces, never a list of them."""

    def pieces(batches):
        for batch in batches:
            seq, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
            first = [i for i in range(len(seq)) if not i or seq[i] != seq[i - 1]]
            joined = [",".join(map(str, ids[a:b])) for a, b in zip(first, [*first[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([seq[i] for i in first], pa.binary()), pa.array([ids[i] for i in first], pa.int64()), pa.array(joined, pa.string())], names=["seq", "first", "piece"])

    def hashed(batches):
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for seq, piece in zip(batch.column("seq").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if seq == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["seq", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["seq", "ends"])

    n = partitions(sequences.sparkSession)
    ordered = sequences.select("seq", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    joined = ordered.mapInArrow(tidy(pieces), "seq binary, first long, piece string")
    return joined.repartition(n, "seq").sortWithinPartitions("seq", "first").mapInArrow(tidy(hashed), "seq binary, ends string")


def _shards(batches):
    """Shards of a task's classes, in order."""
    run = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    turns = 0

    def made():
        sizes = [len(x[3]) for x in held]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        conv, copies = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        return shard_nodes(run, conv, copies, [x[2] for x in held], [t for x in held for t in x[3]], np.concatenate([x[4] for x in held]).astype(np.int64), offsets)

    for batch in batches:
        listed = batch.column("turns")
        at = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        flat = listed.flatten()
        names, words = flat.field("name").to_pylist(), flat.field("words").to_numpy(zero_copy_only=False)
        facts = zip(batch.column("conv_id").to_pylist(), batch.column("copies").to_pylist(), batch.column("ends").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)
        for conv, copies, ends, a, z in facts:
            if held and turns + z - a > SHARD_TURNS:
                yield made()
                run, held, turns = run + 1, [], 0
            held.append((conv, copies, ends, names[a:z], words[a:z]))
            turns += z - a
    if held:
        yield made()


def _subtrees(rows: pd.DataFrame) -> pd.DataFrame:
    """What the nodes of a shard's shared part gather from below."""
    place = {k: i for i, k in enumerate(rows["key"])}
    parent = np.array([place.get(k, -1) for k in rows["parent_key"]])
    depth = rows["depth"].to_numpy()
    sums = rows[["leaves", "saved"]].to_numpy().copy()
    for d in range(int(depth.max()), 0, -1):
        own = np.flatnonzero(depth == d)
        np.add.at(sums, parent[own], sums[own])
    return pd.DataFrame({"key": rows["key"], "leaves": sums[:, 0], "saved": sums[:, 1]})


def _result(parent: Column) -> list[Column]:
    return [*[F.col(c) for c in ("conv_id", "depth")], parent.alias("parent_conv_id"), *[F.col(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the sequences (conv_id, turns: array of (name, words)), the empty one included.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation without turns
    is a member of the root alone; the root's parent is null; repeated conversation ids count as often as they come. An
    empty table has no node, not even the root, which would have no member. Columns beside the two don't matter.
    """
    names = F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), "")
    rows = written(sequences.select("conv_id", "turns", F.substring(F.unhex(F.sha2(names, 256)), 1, 16).alias("seq")), "sequences")
    classes = rows.groupBy("seq", "turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    classes = written(classes.join(_ends(rows), "seq"), "classes")
    order = [F.slice(F.col("turns.name"), 1, ORDERED), F.col("seq")]
    dealt = classes.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    nodes = written(dealt.select("conv_id", "copies", "ends", "turns").mapInArrow(tidy(_shards), NODE), "nodes")

    upper = nodes.where("shared")
    merged = upper.groupBy("key").agg(
        F.first("parent_key", True).alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("run").alias("owner"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = cut(merged)
    below = merged.groupBy(F.col("parent_key").alias("_of")).agg(F.count("*").alias("_more")).where(F.col("_of").isNotNull())
    merged = cut(merged.join(below, F.col("key") == F.col("_of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_of", "_more"))
    # a shared node counts in the first shard that has it, for all that stands above it there
    facts = merged.select("key", "owner", F.col("conv_id").alias("least"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    first = F.col("owner") == F.col("run")
    parts = cut(upper.select("run", "key", "parent_key", "depth").join(facts, "key").select("run", "key", "parent_key", "depth", "least", *[F.when(first, F.col(c)).otherwise(0).alias(d) for c, d in (("leaf", "leaves"), ("own", "saved"))]))
    gathered = parts.select("run", "key", "parent_key", "depth", "leaves", "saved").groupBy("run").applyInPandas(_subtrees, "key binary, leaves long, saved long")
    gathered = gathered.groupBy("key").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    above = merged.select(F.col("key").alias("_of"), F.col("conv_id").alias("_above"))
    whole = merged.join(gathered, "key").withColumn("n_leaves", F.col("n_leaves") + F.col("_leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("_saved"))
    whole = whole.join(above, F.col("parent_key") == F.col("_of"), "left").select(*_result(F.col("_above")))
    hanging = nodes.where("open").join(parts.select(F.col("run").alias("_run"), F.col("key").alias("_of"), "least"), (F.col("run") == F.col("_run")) & (F.col("parent_key") == F.col("_of"))).select(*_result(F.col("least")))
    return whole.unionByName(hanging).unionByName(nodes.where("not shared and not open").select(*_result(F.col("parent_conv_id"))))


def conversation_trie(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20, heads: int = 4) -> DataFrame:
    """The nodes of conversations rebuilt with borrowed beginnings: turn_sequences, with_borrowed_heads and prefix_nodes, where
    it says what nulls, empty texts, ties, repeated rows and empty tables give. Very long texts are hashed and counted
    whole in their own rows; columns with clashing names don't matter."""
    plain = turns.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return prefix_nodes(with_borrowed_heads(written(turn_sequences(plain), "turns"), every, heads))
