"""Line dedup by an exact set-similarity join over the words of lines.

A line is a record of the join engine: its set is its lower-cased words, ordered by rarity; prefix, length and place
filters propose pairs, Jaccard decides them. A line goes when a line before it, in the same document or an earlier one, is
alike, whether or not that one stays itself. So the result doesn't depend on the order of work, and a line whose removal
is settled needs no further test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, attach, bitmap, cut, fresh, key_filter, secret_keys, span_hashes, split, split_rows, text_slices, tidy, utf8, words
from .setjoin import Rule, first_pass, keyed, open_pairs, sets_of, shown_tokens, verify

RULE = Rule(80, 100)
#: Rounds at most in which each line asks for one partner, before the one that takes all pairs that are left. Another one
#: is worth its while if more than one in so many lines that asked isn't settled.
ROUNDS, UNSETTLED = 2, 20


def lines():
    """Records: one for each line that has a word; the hashes of its lower-cased words under keys drawn for this run."""
    one, two = secret_keys(2)

    def records(batch: pa.RecordBatch, check: bool = False):
        data, at = utf8(batch.column("text"))
        breaks = data == 10
        data = LOWER[data]
        start, end, _ = words(data, at)
        text = np.searchsorted(at, start, "right") - 1
        seen = np.concatenate([[0], np.cumsum(breaks)])
        line = seen[start] - seen[at[text]]
        new = np.ones(len(start), bool)
        new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        first = np.flatnonzero(new)
        return text[first], line[first], span_hashes(data, start, end, key=one), np.append(first, len(start)), span_hashes(data, start, end, key=two) if check else None

    return records


def in_order(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """found with the place of each line (null keys first, then by key, text hash and line) as one integer, rows with a
    `number` that orders them in the same way, and how many bits the line takes in a place.

    Whole numbers that tell texts apart are their own order. Others get a number by a sort of the keys, and then the texts
    meet their numbers once.
    """
    keys = cut(found.groupBy("doc_id", "version").agg(F.max("record").alias("record")))
    whole = dict(keys.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    many = keys.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("different"), F.max("record").alias("record"), *([F.min("doc_id").alias("low"), F.max("doc_id").alias("high")] if whole else [])).first()
    bits = int(many["record"] or 0).bit_length()
    if whole and many["n"] and many["n"] == many["different"] and (many["high"] - many["low"]).bit_length() + bits <= 62:
        number = F.when(F.col("doc_id").between(many["low"], many["high"]), F.col("doc_id").cast("long") - F.lit(many["low"]))
        rows = rows.withColumn("number", F.coalesce(number, F.lit(0)))  # texts without a line may lie beyond
        return found.withColumn("place", F.shiftleft(number, bits).bitwiseOR(F.col("record").cast("long"))), rows, bits
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "version")
    numbers = numbered(keys.select("doc_id", "version", order.alias("order")), "order").select("doc_id", "version", "number")
    numbers = cut(numbers)
    placed = attach(found, numbers, "number").withColumn("place", F.shiftleft("number", bits).bitwiseOR(F.col("record").cast("long"))).drop("number")
    return placed, attach(rows, numbers, "number"), bits


def numbered(keys: DataFrame, order: str) -> DataFrame:
    """keys with a number in their order, from 0 on without gaps: range by range, counts of ranges are added up."""
    ranges = cut(keys.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ranges.join(F.broadcast(starts), part == F.col("_part")).withColumn("number", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def later_lines(rows: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, version, record): lines of rows (doc_id, version, text) that a line before them is alike to."""
    records = lines()
    found, sketch = first_pass(rows, records)
    found, ordered, bits = in_order(found, rows)
    proposed, shown = shown_tokens(ordered, records, sketch, rule, most=1, keep_all=True, record_bits=bits)
    gone = rows.sparkSession.createDataFrame([], "cls long")
    tested = None
    turn, last, settled = 0, False, 0
    while True:
        # each line asks for one partner at a time; at last for all that are left. a is the earlier one of the two
        pairs = proposed
        if turn:
            pairs = open_pairs(shown, gone, rule, most=None if last else turn + 1)
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if not last:  # the nearest partner
            pairs = pairs.groupBy("b").agg(F.min_by("a", F.struct("far", F.xxhash64("a"))).alias("a"))
        pairs = cut(pairs.select("a", "b"))
        met = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("cls")), F.col("cls"))
        near, _ = split(found.select("cls", "place", "doc_id", "version", "record"), F.col("cls"), met)
        firsts = near.groupBy("cls").agg(F.min(F.struct("place", "doc_id", "version", "record")).alias("first")).select("cls", "first.doc_id", "first.version", "first.record")
        alike = verify(pairs, sets_of(pairs, rows, records, sketch, firsts), rule).select(F.col("b").alias("cls"))
        gone = cut(gone.unionByName(alike).distinct())
        if last:
            break
        asked, before, settled = pairs.count(), settled, gone.count()
        turn += 1
        last = turn >= ROUNDS or UNSETTLED * (asked - (settled - before)) <= asked
        tested = pairs if tested is None else tested.unionByName(pairs)
    classes = found.groupBy("cls").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    told = classes.join(gone.withColumn("_gone", F.lit(True)), "cls", "left").where("_gone or copies > 1").select(F.col("cls").alias("_c"), "first", "_gone")
    hit = found.join(told, F.col("cls") == F.col("_c"))
    return hit.where(F.coalesce("_gone", F.lit(False)) | (F.col("place") != F.col("first"))).select("doc_id", "version", "record")


def dedup_lines(docs: DataFrame, *, rule: Rule = RULE, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """docs with the later ones of alike lines taken out of their text; with n_lines and n_removed too if counts.

    Lines are what line feeds part; those without a word always stay, and a text that loses nothing stays as it is, null
    too. Of rows equal in key and text, one counts as the first, and the others' lines come after it. A text that loses
    all its lines is empty; its row stays. Columns of docs keep their values; the text is the only one that changes.
    """
    rows = keyed(docs, key, text)
    removed = later_lines(rows, rule)
    repeated = rows.groupBy("doc_id", "version").agg(F.count("*").alias("copies")).where("copies > 1").select("doc_id", "version")
    facts = removed.groupBy("doc_id", "version").agg(F.collect_set("record").alias("lines"), F.lit(False).alias("again"))
    facts = facts.unionByName(repeated.select("doc_id", "version", F.array().cast("array<int>").alias("lines"), F.lit(True).alias("again")))
    facts = cut(facts.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("lines")).alias("lines"), F.max("again").alias("again")))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("_row"), docs[text].alias("_text"), docs[key].alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"))
    may, rest = split_rows(wide, cut(key_filter(facts)))
    other = facts.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "lines", "again")
    told = may.join(other, may["doc_id"].eqNullSafe(F.col("_d")) & (may["version"] == F.col("_v")), "left")
    base = ["_row", "_text", "lines"]
    plain = told.where("not coalesce(again, false)").select(*base, F.lit(1).alias("copy"))
    twice = told.where("again").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "version").orderBy(F.lit(1)))).select(*base, "copy")
    work = plain.unionByName(twice)
    kept = [c for c in docs.columns if c != text]
    hold, lost, total, lines_of, copy = (fresh(docs, x) for x in ("_text", "_lost", "_total", "_lines", "_copy"))
    flat = work.select("_row.*", F.col("_text").alias(hold), F.col("lines").alias(lines_of), F.col("copy").alias(copy))
    types = dict(docs.dtypes)

    def run(batches):
        for batch in text_slices(batches, hold):
            out, n, all_ = [], [], []
            for value, gone, nth in zip(batch.column(hold).to_pylist(), batch.column(lines_of).to_pylist(), batch.column(copy).to_pylist(), strict=True):
                if not value or (not gone and nth == 1):
                    out.append(value)
                    n.append(0)
                    all_.append(0 if value is None else value.count("\n") + 1)
                    continue
                parts, gone = value.split("\n"), set(gone or ())
                keep = [p for i, p in enumerate(parts) if (i not in gone and nth == 1) or not p.strip(" \t\v\f\r")]
                out.append("\n".join(keep))
                n.append(len(parts) - len(keep))
                all_.append(len(parts))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(all_, pa.int64())], names=[*kept, hold, lost, total])

    changed = flat.mapInArrow(tidy(run), ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{hold}` string", f"`{lost}` long", f"`{total}` long"]))
    breaks = F.when(F.col("_text").isNull(), 0).otherwise(F.regexp_count("_text", F.lit("\n")) + 1).cast("long")
    same = rest.select("_row.*", F.col("_text").alias(hold), F.lit(0).cast("long").alias(lost), breaks.alias(total))
    both = changed.unionByName(same)
    out = both.select(*[F.col(hold).alias(c) if c == text else F.col(c) for c in docs.columns], F.col(lost), F.col(total))
    if not counts:
        return out.select(*docs.columns)
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], F.col(total).alias("n_lines"), F.col(lost).alias("n_removed"))
