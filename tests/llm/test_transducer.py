import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import transducer
from skylattice.llm.transducer import MergeList, TextMachine, decode, encode, streaming_ids

from .samples import documents, empty
from .test_tokens_and_store import odd_texts

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def long_words(n, seed=4):
    r = random.Random(seed)
    names = [t for t in Tokenizer.from_file(WORD).get_vocab() if t.isascii() and t.isalpha()]
    for i in range(n):
        yield "".join(r.choice(names) for _ in range(300)) if i % 2 else "".join(r.choice("aehlnors"[: 1 + i % 8]) for _ in range(2500))


def test_stable_tokens_are_the_librarys(library):
    merges = MergeList(WORD)
    assert 32 <= merges.lookahead <= 500
    for word in long_words(40):
        want = [t.id for t in library.model.tokenize(word)]
        for step in (1, 13, 400):
            assert [x for some in merges.stream(merges.symbols(word), step) for x in some] == want


def test_memory_of_the_stream_is_constant():
    merges, held = MergeList(WORD), []
    one = merges.merged
    merges.merged = lambda symbols: held.append(len(symbols)) or one(symbols)
    assert sum(map(len, merges.stream(merges.symbols("la" * 40_000), 512))) > 0
    assert max(held) <= 512 + merges.lookahead + 32


def small_list(path, rules, end="</w>"):
    from skylattice.llm.tokens import byte_letters

    tokens = [*byte_letters(), *[c + end for c in byte_letters()], *[a + b for a, b in rules]]
    data = {"added_tokens": [], "decoder": None, "model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": rules, "end_of_word_suffix": end}}
    path.write_text(json.dumps(data))
    return MergeList(str(path))


def test_lookahead_of_a_chain(tmp_path):
    # ab, bc, cd: whether bc joins depends on cd, and so on; the earlier the rule, the further right it stands
    merges = small_list(tmp_path / "m.json", [["d", "e"], ["c", "d"], ["b", "c"], ["a", "b"]])
    assert merges.lookahead == 4
    for word in ("abcde", "abcd", "abcdeabcdabcde", "abcabcdabcdebc"):
        whole = merges.merged(list(merges.symbols(word)))[0]
        assert [x for some in merges.stream(merges.symbols(word), 1) for x in some] == whole
    with pytest.raises(ValueError):
        small_list(tmp_path / "n.json", [["ab", "c"], ["a", "b"]])


def test_texts_of_all_kinds(library):
    texts = odd_texts(3000)
    ids, at = streaming_ids(WORD).ids(pa.array(texts))
    machine = TextMachine(WORD)
    for i, text in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == library.encode(text or "", add_special_tokens=False).ids
        assert "".join(machine.feed([own[k : k + 3] for k in range(0, len(own), 3)])) == library.decode(own, skip_special_tokens=False)


def test_text_machine_keeps_parts_of_letters():
    ids = streaming_ids(WORD).ids(pa.array(["Héllo wörld 中中 😀 x"]))[0].tolist()
    machine = TextMachine(WORD, "text")
    assert "".join(machine.feed([[i] for i in ids])) == "héllo wörld 中中 😀 x "
    first = streaming_ids(WORD).merges.inner["ð"]  # the first byte of a letter of four, and nothing after it
    assert "".join(machine.feed([[first], ids])) == "�héllo wörld 中中 😀 x "


def test_encode_and_decode(spark, library, monkeypatch):
    docs = documents(spark).withColumn("n_tokens", F.lit("clash")).withColumn("IDS", F.lit("clash"))
    monkeypatch.setattr(transducer, "TEXT_STEP", 1 << 20)
    coded = encode(docs, WORD)
    rows = decode(coded, WORD).select("doc_id", "n_tokens", "ids", "text").collect()
    want = sorted((str(r["doc_id"]), i := library.encode(r["text"] or "", add_special_tokens=False).ids, len(i), library.decode(i, skip_special_tokens=False)) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"], r["n_tokens"], r["text"]) for r in rows) == want
    assert decode(encode(empty(spark), WORD), WORD).count() == 0


def test_windows_of_a_long_text(library):
    text = " ".join(long_words(6)) + " it's <|endoftext|> a b's 's" + " x" * 3000
    parts = list(transducer._windows(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_registered_query(spark, library):
    import os

    import pyarrow.parquet as pq

    from skylattice.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables aren't here")
    docs = pq.read_table(f"{data}/documents.parquet").to_pydict()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in zip(docs["doc_id"], docs["text"], strict=True)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {tuple(r) for r in queries.QUERIES["op13_bpe_codec"](spark, data).collect()}
    assert got == {(k, len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for k, i in ids.items()}
