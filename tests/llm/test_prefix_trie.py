import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skylattice.llm import prefix_trie
from skylattice.llm.prefix_trie import DoubleArray, conversation_trie, prefix_nodes, turn_sequences

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, run string"


def by_hand(rows, every=20, heads=4):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    for c, turns in own.items():
        own[c] = [(role, text) for _, _, role, text in sorted(turns, key=lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))]
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        lender = c - int(np.fmod(c, every))
        built[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    return nodes_of(built)


def nodes_of(built):
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if built[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, n=160, seed=2, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(-25, n - 25):
        if c % 37 == 5:
            continue
        for t in range(r.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, t if r.random() > 0.1 else None, r.choice(["user", "user", "system", None]) if t else "user", r.choice(["", "a b", "a  b c", None, "x" * 50, "hello there"]) if t else r.choice(["hi", "hi", "hi", "yo"]), "c", "c"))
    for c in range(n, n + 60):  # copies, and near copies that part late
        rows += [(c, t, "user", f"same {t}" if t < 11 or c % 3 else f"other {c}", "c", "c") for t in range(14)]
    rows += [(n + 100, t, "user", f"word {t % 7}", "c", "c") for t in range(long)]
    rows += [(None, 1, "user", "nobody's", "c", "c"), (n + 101, 3, "a", "bc", "c", "c"), (n + 101, 3, "ab", "c", "c", "c"), (n + 102, 4, "ab", "c", "c", "c"), (n + 102, 4, "ab", "c", "c", "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("shard", [1, 40, 1 << 18])
def test_nodes_are_those_of_plain_prefixes(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    df = table(spark, long=300)
    got = conversation_trie(df)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(df.collect())


def test_empty_and_turnless(spark):
    assert conversation_trie(table(spark).limit(0)).count() == 0
    rows = [(1, []), (2, []), (3, [(b"x" * 16, 2)])]
    got = prefix_nodes(spark.createDataFrame(rows, "conv_id long, turns array<struct<name: binary, words: long>>")).collect()
    assert sorted(map(tuple, got), key=str)[0][:7] == (1, 0, None, 3, 1, 1, 0) and len(got) == 2


def test_turns_in_order(spark):
    df = spark.createDataFrame([(1, 2, "u", "b"), (1, None, "u", "a"), (1, -1, "u", "c d")], "conv_id int, turn int, role string, text string")
    row = turn_sequences(df).first()
    assert [t["words"] for t in row["turns"]] == [1, 2, 1] and all(len(t["name"]) == 16 for t in row["turns"])


def test_double_array():
    r = random.Random(7)
    paths = sorted({tuple(r.randrange(1, 5 if i % 3 else 400) for _ in range(r.randint(0, 9))) for i in range(3000)})
    ids = np.array([x for p in paths for x in p], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    trie = DoubleArray(ids, offsets)
    found = {(): 0}
    for p in paths:
        node = np.zeros(1, np.int64)
        for d, x in enumerate(p):
            node = trie.step(node, np.array([x]))
            assert node[0] > 0 and found.setdefault(p[: d + 1], int(node[0])) == node[0]
    assert len(set(found.values())) == len(found) == (trie.check != -1).sum()
    for p, node in list(found.items())[:300]:
        for x in range(0, 400, 7):
            assert trie.step(np.array([node]), np.array([x]))[0] == found.get((*p, x), -1)
