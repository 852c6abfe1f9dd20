import random
import re

import numpy as np

from skylattice.llm import ngram_join, setjoin
from skylattice.llm.common import mix
from skylattice.llm.line_dedup import dedup_lines
from skylattice.llm.ngram_join import count_links, link_documents, linked_pairs, one_of_each
from skylattice.llm.setjoin import PLACED, Rule, Trie, open_candidates, packed_bytes, packed_groups, pairs_of_groups

from .samples import documents, empty


def shingle_set(text, size=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def by_hand(rows, part, over, size=4):
    """component_id of each row, over all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and over * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low.setdefault(find(i), []).append(k)
    return [min((k for k in low[find(i)] if k is not None), default=None) for i in range(len(rows))], sets, [find(i) for i in range(len(rows))]


def near_copies(seed, n=60, groups=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))) for _ in range(n)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 90))]
        for _ in range(r.randint(2, 25)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own).capitalize())
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    texts += [f"{t} {passage}" for t in texts[:20]]
    texts += ["a b", "A  b", "a", "", None, " \n ", "a b c d", "a b c d e", texts[3], texts[3]]
    return texts


def test_components_against_all_pairs(spark):
    for seed, part, over in ((1, 85, 100), (2, 60, 100)):
        rows = list(enumerate(near_copies(seed))) + [(7, near_copies(seed)[9]), (None, near_copies(seed)[70]), (None, "alone")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", __import__("pyspark").sql.functions.lit(1))
        got = link_documents(docs, rule=Rule(part, over)).collect()
        want, sets, _ = by_hand(rows, part, over)
        key = lambda x: tuple(str(v) for v in x)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(((k, len(s), c) for (k, _), s, c in zip(rows, sets, want, strict=True)), key=key)


def test_one_of_each_stays(spark):
    rows = list(enumerate(near_copies(3)))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows] + [(5, rows[5][1], 5)], "doc_id long, text string, version int")
    got = one_of_each(docs, size=5, rule=Rule(80, 100))
    assert got.columns == docs.columns
    _, sets, root = by_hand(rows, 80, 100, 5)
    first = {}
    for (i, _), s, g in zip(rows, sets, root, strict=True):
        first.setdefault(g if s else ("empty", i), i)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())
    assert one_of_each(empty(spark)).count() == 0 and link_documents(empty(spark)).count() == 0


def test_awkward_tables(spark):
    docs = documents(spark, 40)
    got = link_documents(docs).collect()
    assert len(got) == docs.count() and one_of_each(docs).columns == docs.columns


def test_trie_walk():
    r = np.random.default_rng(5)
    for _ in range(40):
        order = r.permutation(60).astype(np.uint64)
        sets = [order[np.sort(r.choice(60, r.integers(1, 60), replace=False))] for _ in range(12)]
        sets += [sets[0], sets[0][:5], sets[1][:1]]
        probe = r.choice(60, 40, replace=False).astype(np.uint64)
        bound = int(r.integers(1, 25))
        got = dict(Trie(sets).overlaps(probe, lambda n: bound))
        want = {i: len(set(s.tolist()) & set(probe.tolist())) for i, s in enumerate(sets)}
        assert got == {i: n for i, n in want.items() if n >= bound}


def test_every_link_is_found(spark):
    rows = list(enumerate(near_copies(4, n=40, groups=3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 70 * len(a | b)
    want = [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in count_links(docs, rule=Rule(70, 100)).collect()}
    assert got == dict(enumerate(want))
    pairs, members = linked_pairs(docs, rule=Rule(70, 100))
    names = {r["doc_id"]: r["cls"] for r in members.collect()}
    different = {(min(names[i], names[j]), max(names[i], names[j])) for i, a in enumerate(sets) for j, b in enumerate(sets) if a != b and linked(a, b)}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == different


def thue_morse(n, a, b):
    one, two = [a], [b]
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_texts_that_fool_rolling_hashes(spark):
    one, two = ("".join(x) for x in thue_morse(11, "a", "b"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in link_documents(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == {1: one, 2: two, 3: ""}


def test_sets_whose_names_meet_are_told_apart(spark, monkeypatch):
    real = setjoin.signatures
    monkeypatch.setattr(setjoin, "signatures", lambda t, at, seed: real(t, at, seed) % 5 if seed == 1 else real(t, at, seed))
    tokens = np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(0, 41, 4)
    order = setjoin.Order(np.zeros(1), np.arange(-5, 5))
    assert len(set(setjoin.class_names(tokens, at, mix(tokens), order).tolist())) == 10


#: Two words that fall together under the public key, found by running its scramble backwards.
TWINS = ("abcdefghijklmnop", '1ckwj6re/#~q6:f"')


def test_words_written_to_fall_together_are_told_apart(spark):
    filler = [" ".join(f"f{i}x{j}" for j in range(9)) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate([*TWINS, *filler])), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in link_documents(docs).collect()} == {i: i for i in range(5)}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_shown_tokens_that_fall_together_lose_no_link(spark, monkeypatch):
    """With 7 bits for a token instead of 32 nearly every set has tokens that fall together."""
    monkeypatch.setattr(setjoin, "SHOWN", np.uint64(127))
    r = random.Random(11)
    rows = []
    for g in range(12):  # two sets of 100 that share exactly the 92 needed at 0.85, and two of 91
        common = [f"g{g}c{i}" for i in range(92 if g % 2 else 91)]
        for side in "ab":
            own = common + [f"g{g}{side}{i}" for i in range(100 - len(common))]
            r.shuffle(own)
            rows.append((len(rows), "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in link_documents(docs, size=1).collect()}
    assert got == {k: k - k % 2 if (k // 2) % 2 else k for k, _ in rows}
    assert len(linked_pairs(docs, size=1)[0].collect()) == 6
    texts = near_copies(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _, _ = by_hand(list(enumerate(texts)), 85, 100)
    assert [x["component_id"] for x in sorted(link_documents(docs).collect(), key=lambda x: x["doc_id"])] == want


def test_pairs_that_tell_nothing_or_share_too_little_are_not_made(spark):
    n, rule = 200, Rule(80, 100)
    cls, one = np.arange(n), np.ones(n, np.int64)
    same = (cls.astype(np.uint64) * np.uint64(0), 20 * one, 0 * one)
    gone = cls > 0
    a, _, _ = pairs_of_groups(0 * one, cls, cls, *same, rule, None, 0, cls, gone)
    assert not len(a)  # the first line is the earlier one of each pair, and all others are gone
    gone[150] = False
    a, b, _ = pairs_of_groups(0 * one, cls, cls, *same, rule, None, 0, cls, gone)
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) == [(i, 150) for i in range(150)]
    # lines of 20 words that share one shown word: linked ones share three at least
    part = np.zeros(n, PLACED)
    part["token"], part["cls"], part["n"], part["rank"] = 7, cls, 20, cls
    shown = spark.createDataFrame([(bytearray(packed_bytes(part)),)], "packed binary")
    none = spark.createDataFrame([], "cls long")
    assert open_candidates(shown, none, rule, most=None).count() == 0
    again = np.concatenate([part[:3]] * 3)
    again["token"], again["at"] = np.repeat([7, 8, 9], 3), np.repeat([0, 1, 2], 3)
    shown = spark.createDataFrame([(bytearray(x),) for x in packed_groups(again)], "packed binary")
    assert sorted(tuple(r) for r in open_candidates(shown, none, rule, most=None).collect()) == [(0, 1, 3), (0, 2, 3), (1, 2, 3)]


def test_rounds_are_bounded(spark, monkeypatch):
    """However many links the rounds go on to find: the driver keeps the plans of each."""
    asked, own = [], ngram_join.candidates
    monkeypatch.setattr(ngram_join, "WORTH", 1)
    monkeypatch.setattr(ngram_join, "candidates", lambda *a, **b: asked.append(b["most"]) or own(*a, **b))
    rows = list(enumerate(near_copies(1)))
    expected, sets, _ = by_hand(rows, 85, 100)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: (len(s), c) for (k, _), s, c in zip(rows, sets, expected, strict=True)}
    assert len(asked) <= 3 and asked[-1] is None


def test_sketches_tell_long_sets_apart():
    """64 bits told nothing of sets this long: every pair of a group was a candidate."""
    r = np.random.default_rng(2)
    n, rule = 40, Rule(80, 100)
    common = r.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = [np.concatenate([common, r.integers(0, 1 << 63, 60, dtype=np.uint64)]) for _ in range(n)]
    sets[1] = np.concatenate([sets[0][:170], sets[1][170:]])
    at = np.arange(0, 180 * n + 1, 180)
    cls, one = np.arange(n), np.ones(n, np.int64)
    a, b, _ = pairs_of_groups(0 * one, cls, cls, setjoin.parities(np.concatenate(sets), at), 180 * one, 0 * one, rule, None, 0)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == {(0, 1)}


def test_ranges_of_size_find_what_all_pairs_do(monkeypatch):
    """In a group of a frequent token every pair was looked at; now only sizes that the places of the token allow."""
    r, rule, n = np.random.default_rng(8), Rule(80, 100), 3000
    part = np.zeros(n, PLACED)
    part["token"], part["cls"], part["rank"], part["n"] = np.sort(r.integers(0, 3, n)), r.permutation(n), r.permutation(n), r.integers(1, 90, n)
    part["at"] = r.integers(0, rule.shown(part["n"].astype(np.int64)))
    for c in ("p0", "p1"):  # few bits, so that many pairs pass and many don't
        part[c] = np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
        part[c] |= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
    gone = r.random(n) < 0.5
    m, at = part["n"].astype(np.int64), part["at"].astype(np.int64)
    need = rule.needed(m[:, None], m[None, :])
    far = at[:, None] + at[None, :] + sum(np.bitwise_count(part[c][:, None] ^ part[c][None, :]).astype(np.int64) for c in ("p0", "p1"))
    good = (np.minimum((m - at)[:, None], (m - at)[None, :]) >= need) & (far <= m[:, None] + m[None, :] - 2 * need)
    good &= (part["token"][:, None] == part["token"][None, :]) & (part["rank"][:, None] < part["rank"][None, :]) & ~gone[None, :]
    want = {(int(part["cls"][i]), int(part["cls"][j])): int((far[i, j] << 20) // (m[i] + m[j])) for i, j in zip(*np.nonzero(good), strict=True)}
    looked, own = [], setjoin.expand
    monkeypatch.setattr(setjoin, "expand", lambda start, count: looked.append(int(count.sum())) or own(start, count))
    monkeypatch.setattr(setjoin, "AT_ONCE", 1000)
    a, b, d = setjoin.placed_pairs(part, rule, None, gone)
    assert {(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), d.tolist(), strict=True)} == want and len(a) == len(want) > 100
    assert sum(looked) < n * n / 6 / 4
    a, b, d = setjoin.placed_pairs(part, rule, 2, gone)
    near = {}
    for (x, y), z in want.items():
        near.setdefault(y, []).append(z)
    got = {}
    for x, y, z in zip(a.tolist(), b.tolist(), d.tolist(), strict=True):
        assert want[x, y] == z
        got.setdefault(y, []).append(z)
    assert {y: sorted(z) for y, z in got.items()} == {y: sorted(z)[:2] for y, z in near.items()}


def test_more_gone_than_tasks_know_of(spark, monkeypatch):
    part = np.zeros(60, PLACED)
    part["token"], part["cls"], part["n"], part["rank"] = 7, np.arange(60), 20, np.arange(60)
    shown = spark.createDataFrame([(bytearray(packed_bytes(part)),)], "packed binary")
    gone = spark.createDataFrame([(i,) for i in range(60) if i != 40], "cls long")
    for known in (10, 1000):
        monkeypatch.setattr(setjoin, "KNOWN", known)
        got = setjoin.open_pairs(shown, gone, Rule(80, 100), most=None).collect()
        assert sorted((x["a"], x["b"]) for x in got) == [(i, 40) for i in range(40)]


def test_tokens_dealt_out_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PACKED", 50)
    rows = [(i, f"a{i // 3} b{i // 3} c{i // 3} d{i // 3} e{i // 3}" + (" more" if i % 3 == 2 else "")) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i % 3 == 0 else "" for i, t in rows}
