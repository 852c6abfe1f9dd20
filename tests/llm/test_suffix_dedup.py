import hashlib
import random
from collections import Counter

from skylattice.llm.suffix_dedup import remove_repeats

from .samples import documents, empty


def brute(rows, length):
    windows = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def planted(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdé f") for _ in range(n))
    shared = [line(r.randint(30, 160)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [line(r.randint(0, 120))]
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a, b = sorted((r.randint(0, len(s)), r.randint(0, len(s))))
            parts += [r.choice([s, s[a:b]]), line(r.choice([0, 1, 2, 40]))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3] + "x", "y" + texts[4], "a" * 300, "ab" * 200, "a" * 55, "", None]
    # edits of one text, so that contexts differ around the same passage
    base = line(500)
    for _ in range(12):
        i = r.randint(0, 499)
        texts.append(base[:i] + r.choice("xyz") + base[i + 1 :])
    return texts


def test_against_brute_force(spark):
    for seed, length, k in ((1, 40, 12), (2, 64, 16), (3, 50, 20)):
        texts = planted(seed)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "other " * 30), (None, texts[7])], "doc_id long, text string")
        want = brute([(r["text"] or "").encode() for r in docs.collect()], length)
        assert result(remove_repeats(docs, length=length, k=k)) == want


def test_awkward_tables(spark):
    docs = documents(spark, 30).withColumnRenamed("size", "version")
    want = brute([(r["text"] or "").encode() for r in docs.where("doc_id is null or doc_id <> 32").collect()], 60)
    assert result(remove_repeats(docs.where("doc_id is null or doc_id <> 32"), length=60, k=20)) == want
    assert remove_repeats(empty(spark)).count() == 0
