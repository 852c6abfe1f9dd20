"""The registered queries with their production parameters over the driver's smallest tables, against brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skylattice.llm import queries

from .test_tokens_and_store import one_by_one, packed

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), zip(t["text"].to_pylist(), t["source"].to_pylist(), strict=True), strict=True))


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def test_mixing(spark, docs):
    got = rows(spark, "op1_source_mix")
    size = {k: len(WORD.findall(t or "")) for k, (t, _) in docs.items()}
    assert {r["doc_id"]: r["size"] for r in got} == size and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    sums, taken, target = Counter(), Counter(), {}
    for r in got:
        sums[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    want, open_ = {}, set(sums)
    while open_:  # what is above its limit stops there, the rest shares what is left
        left = sum(sums.values()) - sum(want.values())
        full = [s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 3 * sums[s]]
        for s in full or open_:
            want[s] = 3 * sums[s] if full else left * weights[s] / sum(weights[x] for x in open_)
        open_ -= set(want)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 64 for s in sums)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, rows(spark, "op1_source_mix")), key=str)


def test_suffix_dedup(spark, docs):
    texts = {k: (t or "").encode() for k, (t, _) in docs.items()}
    windows = Counter(hashlib.blake2b(t[i : i + 400], digest_size=16).digest() for t in texts.values() for i in range(len(t) - 399))
    for r in rows(spark, "op2_suffix_dedup"):
        t = texts[r["doc_id"]]
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if windows[hashlib.blake2b(t[i : i + 400], digest_size=16).digest()] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["removed"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), bool(gone.any()))


def test_token_counts(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(spark, "op5_token_counts"):
        text = docs[r["doc_id"]][0] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_ngram_join(spark, docs):
    sets = {}
    for k, (t, _) in docs.items():
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))} if own else set()
    by_shingle = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by_shingle[x].append(k)
    shared = Counter((a, b) for own in by_shingle.values() for i, a in enumerate(own) for b in own[i + 1 :])
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op6_ngram_join")}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


def test_fingerprints(spark, docs):
    order = sorted(docs)
    got = {r["doc_id"]: r for r in rows(spark, "op7_fingerprints")}
    prints = {}
    for i, k in enumerate(order):
        text, following = docs[k][0] or "", docs[order[(i + 1) % len(order)]][0] or ""
        m = len(text) // 4
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(text), hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest())
        assert prints.setdefault(text, got[k]["fingerprint"]) == got[k]["fingerprint"]
        if len(text) > 100 and text != following:
            assert got[k]["near_edited"] > 0.5 and got[k]["near_edited"] > got[k]["near_next"]


def test_store_and_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, (t, _) in docs.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op8_token_store")}
    start, pieces = 0, []
    for k in sorted(docs):
        own = [*ids[k], 2]
        assert got[k] == (start, len(own), crc(own))
        start += len(own)
        own = [*ids[k], 0]
        pieces += [(k, i // 2048, i, len(own[i : i + 2048]), crc(own[i : i + 2048])) for i in range(0, len(own), 2048)]
    out = rows(spark, "op9_best_fit_packing")
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(pieces)
    n = packed([(r["sequence_id"], r["offset"], r["length"]) for r in out], 2048)
    assert n <= one_by_one([p[3] for p in pieces], 2048) * 1.02 + 1


def test_media(spark, docs):
    for r in rows(spark, "op10_media_columns"):
        raw = (docs[r["doc_id"]][0] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
