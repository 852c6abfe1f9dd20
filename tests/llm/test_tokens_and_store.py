import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import common, token_store
from skylattice.llm.common import distinct_spans, window_hashes
from skylattice.llm.packing import pack, token_pieces
from skylattice.llm.token_counts import token_counts
from skylattice.llm.token_store import crc_joined, read_digests, read_ids, store_root, write_store
from skylattice.llm.tokens import merge_counter, word_ids

from .samples import documents, empty

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["'s", "'re", "'ll", "<|endoftext|>", "<s>", "▁", "  ", "́", "　", "中", "İ", "ſ", "①", "\x1c", "\x85", "ﬁ", "<|", "😀", "\x00", "가", "Å", "ǅ", "²", "Σ", "ς", "あ"]


def odd_texts(n):
    r = random.Random(5)
    signs = list("abcDE'’ st.!?0129\n\t éÉßäñ") + ODD
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(n)] + [None, "", " "]


def test_ids_and_counts_are_the_libraries():
    texts = odd_texts(4000)
    ids, at = word_ids(WORD).ids(pa.array(texts))
    n = merge_counter(PIECE).counts(pa.array(texts))
    library, pieces = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert n[i] == len(pieces.encode(text or ""))


def test_token_counts(spark):
    docs = documents(spark).withColumnRenamed("size", "n_tokens")
    got = token_counts(docs, PIECE, limit=300).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 300) for r in got)
    assert token_counts(empty(spark), PIECE).count() == 0


def test_crc_of_joined_parts():
    r = np.random.default_rng(1)
    parts = [r.bytes(n) for n in (1, 0, 5, 4096, 17, 3)]
    crc, size, first = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), np.array([0, 2, 5])
    want = [zlib.crc32(b"".join(parts[a:b])) for a, b in ((0, 2), (2, 5), (5, 6))]
    assert crc_joined(crc, size, first).tolist() == want


def test_store_round_trip(spark, tmp_path):
    docs = documents(spark)
    path = f"file://{tmp_path}/store"
    write_store(docs, path, WORD)
    library = Tokenizer.from_file(WORD)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, start = {}, 0
    for r in rows:
        own = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[start] = (r["doc_id"], len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own)
        start += len(own)
    got = {r["start"]: (r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_digests(spark, path).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert {r["start"]: list(r["ids"]) for r in read_ids(spark, path).collect()} == {k: v[3] for k, v in want.items()}
    stored = spark.read.parquet(f"{path}/chunks").where("kind = 'chunk'")
    assert stored.count() == stored.select("digest").distinct().count()
    write_store(empty(spark), f"file://{tmp_path}/none", WORD)
    assert read_digests(spark, f"file://{tmp_path}/none").count() == 0


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    write_store(documents(spark, 10), path, WORD)
    root = store_root(spark, path)
    assert len(root) == 64
    spark.read.parquet(f"{path}/manifest").selectExpr("node", "children", "tokens", "'0' hash", "level").write.parquet(f"{path}/other")
    (tmp_path / "store/manifest").rename(tmp_path / "store/old")
    (tmp_path / "store/other").rename(tmp_path / "store/manifest")
    with pytest.raises(ValueError, match="manifest"):
        read_digests(spark, path)


def test_tree_of_many_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FANOUT", 3)
    docs = documents(spark, 20)
    write_store(docs, f"file://{tmp_path}/store", WORD)
    tree = spark.read.parquet(f"file://{tmp_path}/store/manifest").collect()
    rows, sizes = docs.count(), []
    while rows > 1:
        rows = -(-rows // 3)
        sizes.append(rows)
    assert [sum(r["level"] == k + 1 for r in tree) for k in range(len(sizes))] == sizes and all(r["children"] <= 3 for r in tree)
    assert read_digests(spark, f"file://{tmp_path}/store").count() == docs.count()
    write_store(docs.repartition(3), f"file://{tmp_path}/again", WORD)
    assert store_root(spark, f"file://{tmp_path}/again") == store_root(spark, f"file://{tmp_path}/store")


def test_packing(spark):
    docs = documents(spark)
    got = pack(token_pieces(docs, WORD, capacity=512), capacity=512).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for r in docs.collect():
        own = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(own), 512):
            part = np.array(own[k : k + 512], "<u4")
            want.append((str(r["doc_id"]), k // 512, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(w[3] for w in want)
    assert len(sequences) <= one_by_one([w[3] for w in want], 512) * 1.02 + 1
    assert total <= 512 * len(sequences)
    assert pack(token_pieces(empty(spark), WORD)).count() == 0


def one_by_one(lengths, capacity):
    """Sequences that best fit uses when documents come one by one, longest first."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def packed(rows, capacity):
    """Sequences of rows (sequence_id, offset, length), each without gaps and within the capacity."""
    used = {}
    for seq, offset, length in rows:
        used.setdefault(seq, []).append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_best_fit_against_one_by_one(spark):
    r = random.Random(2)
    cases = [[r.randint(1, 64) for _ in range(300)], [33] * 100 + [31] * 70 + [1] * 200]
    for lengths in cases:
        docs = spark.createDataFrame([(i % 50 or None, n, i, "x", "y", 0) for i, n in enumerate(lengths)], "doc_id long, length int, _rank long, size string, row string, seq int").withColumn("piece", F.lit(0))
        got = pack(docs, capacity=64).collect()
        assert sorted((r["_rank"], r["length"], r["size"], r["row"]) for r in got) == [(i, n, "x", "y") for i, n in enumerate(lengths)]
        n = packed([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
        assert n <= one_by_one(lengths, 64) * 1.04 + 1, (n, one_by_one(lengths, 64), -(-sum(lengths) // 64))
    with pytest.raises(ValueError, match="lengths"):
        pack(docs, capacity=5)


def thue_morse(n, a="a", b="b"):
    """Two different texts of 2**n symbols that any polynomial hash modulo 2**64 takes for one."""
    one, two = a, b
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_texts_that_fool_rolling_hashes(spark):
    for n in (10, 11):
        one, two = thue_morse(n)
        for texts in ([one, two], [two, one]):
            ids, at = word_ids(WORD).ids(pa.array(texts))
            library = Tokenizer.from_file(WORD)
            assert [ids[at[i] : at[i + 1]].tolist() for i in range(2)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
            pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)
            assert merge_counter(PIECE).counts(pa.array(texts)).tolist() == [len(pieces.encode(t)) for t in texts]
        data = np.frombuffer((one + two + one).encode(), np.uint8)
        start = np.arange(3) * len(one)
        first, back = distinct_spans(data, start, start + len(one))
        assert len(first) == 2 and back[0] == back[2] != back[1]
        h = window_hashes(data, len(one))
        assert h[0] == h[2 * len(one)] != h[len(one)]


def test_spans_whose_hashes_meet_are_told_apart(monkeypatch):
    data = np.frombuffer(b"red blue red green blue", np.uint8)
    start, end = np.array([0, 4, 9, 13, 19]), np.array([3, 8, 12, 18, 23])
    monkeypatch.setattr(common, "span_hashes", lambda s, a, b, seed=0: np.zeros(len(a), np.uint64))
    first, back = distinct_spans(data, start, end)
    assert first.tolist() == [0, 1, 3] and back.tolist() == [0, 1, 0, 2, 1]
