"""The stages one after another over a small table, each held against what its operator promises."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm.setjoin import Rule

from .samples import documents
from .test_line_dedup import by_hand as without_later_lines
from .test_setjoin import shingle_set


def test_stages(spark, tmp_path):
    one_language = documents(spark, 60).drop("size", "_key").withColumn("lang", F.lit("xx"))
    one_language.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        kept.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    assert all(t.columns == columns for t in kept[:-1])
    # language ID: texts with letters stay, others go
    first = kept[0].collect()
    assert all(r["text"] and re.search("[a-z]", r["text"]) for r in first) and len(first) >= 60
    # line dedup: as all pairs of lines say (rows equal in key and text come one after the other)
    rows = sorted(first, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = without_later_lines([(r["doc_id"], r["text"]) for r in rows], 80, 100)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept[1].collect()) == sorted((str(k), t) for k, t in want)
    # n-gram join: no two that stay are linked, and each that goes is linked to one that was there
    before, after = kept[1].collect(), kept[2].collect()
    rule = Rule(80, 100)
    linked = lambda a, b: a and b and rule.over * len(a & b) >= rule.part * len(a | b)
    sets = [shingle_set(r["text"], 5) for r in after]
    assert not any(linked(sets[i], sets[j]) for i in range(len(sets)) for j in range(i))
    assert len(after) <= len(before)
    # mixing and packing: only words of what was there, and gapless sequences
    assert {r["doc_id"] for r in kept[3].collect()} <= {r["doc_id"] for r in after}
    sequences = {}
    for r in kept[4].collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
