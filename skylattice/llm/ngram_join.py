"""N-gram Jaccard join of documents: links, their components, and one document of each.

Documents are sets of word 4-shingles; the join engine proposes pairs, and a prefix tree of the proposed sets decides
them. Only components are asked for, so a pair whose documents are connected already is never tested.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Key, cut, key_filter, mix, secret_keys, span_hashes, split_rows, utf8, words
from .setjoin import Rule, candidates, first_pass, keyed, likely, sets_of, shown_lists, shown_tokens, verify

SHINGLE = 4
RULE = Rule(85, 100)
#: Rounds in which each document asks for one partner, before the one that takes all pairs that are left: so many at most,
#: as the driver keeps the plans and tasks of each. Another one is worth its while if the last found so many links, and
#: a quarter of what the first one did.
ROUNDS, WORTH = 3, 200


def shingles(size: int = SHINGLE):
    """Records: one for each text, the hashes of its word shingles under keys drawn for this run; fewer words than `size` make
    one shingle."""
    one, two = secret_keys(2)

    def records(batch: pa.RecordBatch, check: bool = False):
        data, at = utf8(batch.column("text"))
        data = LOWER[data]
        start, end, first = words(data, at)
        count = np.diff(first)
        n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
        total = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(n)), n)
        place = first[:-1][text] + np.arange(total[-1]) - total[:-1][text]
        have = np.minimum(count, size)[text]

        def hashed(key: Key) -> np.ndarray:
            # a short text's shingle is padded; padding can't be mistaken for a word because the number of words is mixed in
            padded = np.concatenate([span_hashes(data, start, end, key=key), np.zeros(size, np.uint64)])
            out = have.astype(np.uint64)
            for i in range(size):
                out = mix(out * np.uint64(key[1]) + np.where(i < have, padded[place + i], np.uint64(0)), key)
            return out

        return np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), hashed(one), total, hashed(two) if check else None

    return records


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the smallest class of the component of each class in edges (a, b), by large and small stars."""
    edges = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.least("m", "v").alias("u"), F.greatest("m", "v").alias("v"))
        low = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        told = large.join(low, large["v"] == F.col("w")).select("u", "v", "m")
        small = told.select(F.least("u", "m").alias("u"), F.greatest("u", "m").alias("v")).unionByName(told.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("v").alias("cls")).agg(F.min("u").alias("label"))


def near_labels(edges: DataFrame) -> DataFrame:
    """(cls, label): a class of the same component for each class in edges (a, b), the smallest within two or three links.
    Classes of one component may differ in it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    on = low.select(F.col("u").alias("w"), F.col("m").alias("further"))
    return low.join(on, low["m"] == F.col("w")).select(F.col("u").alias("cls"), F.col("further").alias("label"))


def linked_classes(rows: DataFrame, size: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, record, n, cls) of every row, and (cls, label) of classes linked to another."""
    records = shingles(size)
    found, sketch = first_pass(rows, records)
    proposed, shown = shown_tokens(rows, records, sketch, rule, most=1, keep_all=True)
    lists = shown_lists(shown)
    some = F.struct(F.col("doc_id").isNotNull().alias("_some"), "doc_id", "version", "record")
    firsts = found.where("n > 0").join(lists.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min(some).alias("one")).select("cls", "one.doc_id", "one.version", "one.record")
    firsts = cut(firsts)
    edges = tested = labels = None
    turn, last, worth = 0, False, WORTH
    while True:
        pairs = candidates(shown, labels, rule, most=None if last else 1, turn=turn) if turn else proposed
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        if not last:  # of a document's proposals, the one that most groups make: only those meet the lists
            best = pairs.groupBy("b").agg(F.max_by(F.struct("a", "b"), F.struct("votes", F.xxhash64("a", F.lit(turn)))).alias("best"))
            pairs = cut(best.select("best.a", "best.b"))
        asked = pairs
        pairs = cut(likely(pairs, lists, rule).select("a", "b"))
        good = cut(verify(pairs, sets_of(pairs, rows, records, sketch, firsts), rule))
        n = good.count()
        if n or edges is None:
            edges = good if edges is None else edges.unionByName(good)
        if last:
            labels = components(edges) if n else labels
            break
        worth = worth if turn else max(WORTH, n // 4)
        turn, last = turn + 1, n < worth or turn + 1 >= ROUNDS
        # whole components before the last round; before others it is enough that most of what is connected is known to be
        labels = components(edges) if last else cut(near_labels(edges))
        tested = asked if tested is None else tested.unionByName(asked)
    return found, labels


def linked_pairs(docs: DataFrame, *, size: int = SHINGLE, rule: Rule = RULE, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link: pairs (a, b) of different sets that are linked, a < b, and members (key, n_shingles, cls) of each set.

    All candidates of all shown n-grams are tested, none is left out because others connect it; documents of one set are
    linked with each other and aren't written as pairs. Empty sets, null texts among them, have no class; a null key is kept.
    Very long texts are read whole, an empty table gives empty results, other columns don't matter. The pairs of n sets that are all alike
    are n * n / 2: for components alone link_documents does with far fewer.
    """
    rows, records = keyed(docs, key, text), shingles(size)
    found, sketch = first_pass(rows, records)
    proposed, shown = shown_tokens(rows, records, sketch, rule, most=1, keep_all=True)
    lists = shown_lists(shown)
    some = F.struct(F.col("doc_id").isNotNull().alias("_some"), "doc_id", "version", "record")
    firsts = cut(found.where("n > 0").join(lists.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min(some).alias("one")).select("cls", "one.doc_id", "one.version", "one.record"))
    every = candidates(shown, None, rule, most=None, turn=1).unionByName(proposed).select("a", "b").distinct()
    pairs = cut(likely(every, lists, rule))
    good = cut(verify(pairs, sets_of(pairs, rows, records, sketch, firsts), rule))
    return good, found.select(F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))


def count_links(docs: DataFrame, *, size: int = SHINGLE, rule: Rule = RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links for every row: how many other rows it is linked with, copies counted. What linked_pairs
    says of nulls, empty and very long texts, repeated rows, empty tables and other columns holds here."""
    pairs, members = linked_pairs(docs, size=size, rule=rule, key=key, text=text)
    sizes = cut(members.where("cls is not null").groupBy("cls").agg(F.count("*").alias("rows")))
    both = pairs.select(F.col("a").alias("cls"), F.col("b").alias("_o")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("_o")))
    others = both.join(sizes.select(F.col("cls").alias("_o"), F.col("rows").alias("_r")), "_o").groupBy("cls").agg(F.sum("_r").alias("_linked"))
    total = sizes.join(others, "cls", "left").select(F.col("cls").alias("_c"), (F.col("rows") - 1 + F.coalesce("_linked", F.lit(0))).alias("_n"))
    return members.join(total, F.col("cls") == F.col("_c"), "left").select(key, "n_shingles", F.coalesce("_n", F.lit(0)).alias("n_links"))


def link_documents(docs: DataFrame, *, size: int = SHINGLE, rule: Rule = RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the size of its set, and the smallest doc_id reachable by links.

    A null text and one without words have an empty set, linked with nothing; repeated rows have equal sets and are
    linked. A null doc_id is never the smallest unless its component has no other. A very long text is read whole, an empty
    table gives an empty result, and extra columns are ignored.
    """
    _, _, out = _components_of(docs, size, rule, key, text)
    return out.select(F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component_id"))


def _components_of(docs: DataFrame, size: int, rule: Rule, key: str, text: str):
    rows = keyed(docs, key, text)
    found, labels = linked_classes(rows, size, rule)
    own = found.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    own = own.join(labels.select(F.col("cls").alias("_c"), "label"), F.col("cls") == F.col("_c"), "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = own.groupBy("label").agg(F.min("low").alias("component_id"))
    own = own.join(lowest, "label").select(F.col("cls").alias("_c"), "label", "component_id")
    out = found.join(own, (F.col("cls") == F.col("_c")) & (F.col("n") > 0), "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows, found, out


def one_of_each(docs: DataFrame, *, size: int = 5, rule: Rule = Rule(80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when each component keeps one document, that of the lowest doc_id (then text hash).

    Rows with an empty set all stay. All columns of docs are kept as they are. Rows that are certainly alone don't move.
    """
    _, _, out = _components_of(docs, size, rule, key, text)
    out = out.where("n > 0").select("doc_id", "version", "label")
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "version")
    group = out.groupBy("label").agg(F.count("*").alias("rows"), F.min(order).alias("one")).where("rows > 1")
    members = cut(out.join(group, "label").select("doc_id", "version", (F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("version") == F.col("one.version"))).alias("stays")).distinct())
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[key].alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"))
    may, alone = split_rows(wide, cut(key_filter(members)))
    facts = members.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "stays")
    told = may.join(facts, may["doc_id"].eqNullSafe(F.col("_d")) & (may["version"] == F.col("_v")), "left")
    single = told.where("stays is null").select("_row")
    kept = told.where("stays").select("doc_id", "version", "_row").dropDuplicates(["doc_id", "version"]).select("_row")
    return alone.select("_row").unionByName(single).unionByName(kept).select("_row.*")
