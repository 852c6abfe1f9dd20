"""Removing long repeated byte strings: suffixes sampled by a cover, named by what they begin with, the rest merged in.

A string of `length` bytes that starts at two places is found through suffixes sampled so that both places have a sampled
suffix at the same distance. A difference cover of the places modulo v gives that, for one suffix in sqrt(v); the sample
here has the same property for one in about 175: the suffix whose first K bytes hash lowest among the W starts in the
string, which depends on the string alone. (With residues, every sampled suffix of every text has to be sorted, which
doesn't fit the disk at this length; the README has the figures.)

1. Each sampled suffix stands for a run of window starts. It forms a triple (what lies before it, its first K bytes, what
   follows) over all bytes that those windows cover, and gets a name by that content. Triples with the same name are
   repeats of each other at every window of the run; one of them stays as a representative.
2. Names of a lower level tell which runs can meet others that don't have the same triple: a window start covers either
   the longer half after the suffix or the one before it, so a run goes on only where such a half has a double. That is a
   small part of the text.
3. The remaining suffixes, one for each window start of such runs, are merged with those of the representatives: first
   in cells of CELL starts, by all that a cell covers (a double settles the cell) and by what all its windows cover (no
   double, no repeat), then one by one, by their whole prefix of `length` bytes.

Names are 128-bit digests of the bytes themselves, so no level needs the ranks of the one before, and counting equal names is
map-side combined, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap, cut, expand, key_filter, mix, row_version, sliding_min, span_digests, span_hashes, split, split_rows, text_slices, tidy, utf8, window_hashes, written

LENGTH = 400
#: Bytes whose hash chooses a sampled suffix.
K = 48
SLICE = 1 << 20
#: Window starts that are tested together before they are tested one by one.
CELL = 16
HALF = np.uint64(32)


def sampled_runs(data: np.ndarray, at: np.ndarray, length: int, k: int):
    """Runs of window starts with the same sampled suffix: text, first start, windows, place of the suffix (in data)."""
    n = len(data)
    w = length - k + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = window_hashes(data, k)
    ranked = (hashes >> HALF << HALF) | np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equals
    chosen = (sliding_min(ranked, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(chosen) + 1, bool)
    size = np.diff(at)
    long = np.flatnonzero(size >= length)
    valid[expand(at[long], size[long] - length + 1)] = True
    valid = valid[: len(chosen)]
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    new[at[long]] = True
    start = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), len(chosen))
    end = stop[np.searchsorted(stop, start, "right")]
    return np.searchsorted(at, start, "right") - 1, start, end - start, chosen[start]


def _runs(docs: DataFrame, kind: str, length: int, k: int) -> DataFrame:
    middle = (length - k) // 2

    def run(batches):
        for batch in text_slices(batches, "text", SLICE):
            data, at = utf8(batch.column("text"))
            text, start, n, place = sampled_runs(data, at, length, k)
            if not len(text):
                continue
            row, before = pa.array(text, pa.int64()), place - start
            name = span_digests(data, start, start + n + length - 1)
            # starts nearer to the suffix than `middle` cover what follows it, the others what goes before it
            near, far = before - n + 1 < middle, before >= middle
            after = span_hashes(data, place, np.where(near, place + length - middle, place), 1)
            ahead = span_hashes(data, np.where(far, place - middle, place), place + k, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("version").take(row), pa.array((start - at[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(name[0]), pa.array(name[1]), pa.array(after.view(np.int64), mask=~near), pa.array(ahead.view(np.int64), mask=~far)],
                names=["doc_id", "version", "start", "n", "before", "name1", "name2", "after", "ahead"],
            )

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, version long, start int, n int, before int, name1 long, name2 long, after long, ahead long")


def _live_runs(batch: pa.RecordBatch, *fields: str):
    """Row of each of a batch's runs, and their fields."""
    runs = batch.column("runs")
    offsets = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))])
    flat = runs.flatten()
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _cells(live: DataFrame, kind: str, length: int) -> DataFrame:
    """live: doc_id, version, text, runs (start, n, known, place). Runs cut into cells of CELL distances from the suffix.

    core names what every window of the cell covers, whether this run has all of them or not; name1 and name2 name what
    the windows of this run in the cell cover together.
    """

    def run(batches):
        for batch in text_slices(batches, "text", SLICE):
            data, at = utf8(batch.column("text"))
            row, start, n, known, place = _live_runs(batch, "start", "n", "known", "place")
            start, n, place = start.astype(np.int64), n.astype(np.int64), place.astype(np.int64)
            low, high = place - start - n + 1, place - start
            count = high // CELL - low // CELL + 1
            cell = expand(low // CELL, count)
            run_of = np.repeat(np.arange(len(row)), count)
            first = np.maximum(low[run_of], cell * CELL)
            last = np.minimum(high[run_of], cell * CELL + CELL - 1)
            row, known, base = row[run_of], known[run_of], at[row[run_of]] + place[run_of]
            begin, m = base - last, last - first + 1
            core = mix(span_hashes(data, base - cell * CELL, base - cell * CELL - CELL + 1 + length, 1) + cell.astype(np.uint64))
            names = span_digests(data, begin, begin + m + length - 1)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("version").take(take), pa.array((begin - at[row]).astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(known), pa.array(core.view(np.int64)), pa.array(names[0]), pa.array(names[1])],
                names=["doc_id", "version", "start", "n", "known", "core", "name1", "name2"],
            )

    return live.mapInArrow(tidy(run), f"doc_id {kind}, version long, start int, n int, known boolean, core long, name1 long, name2 long")


def _windows(live: DataFrame, kind: str, length: int) -> DataFrame:
    """live: doc_id, version, text, runs (start, n, known). One row for each window start of the runs."""

    def run(batches):
        for batch in text_slices(batches, "text", SLICE):
            data, at = utf8(batch.column("text"))
            row, start, n, known = _live_runs(batch, "start", "n", "known")
            place = expand(start.astype(np.int64) + at[row], n.astype(np.int64))
            known, row = np.repeat(known, n), np.repeat(row, n)
            names = span_digests(data, place, place + length)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("version").take(take), pa.array((place - at[row]).astype(np.int32)), pa.array(known), pa.array(names[0]), pa.array(names[1])],
                names=["doc_id", "version", "start", "known", "name1", "name2"],
            )

    return live.mapInArrow(tidy(run), f"doc_id {kind}, version long, start int, known boolean, name1 long, name2 long")


def _doubled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (…, known, name1, name2) not known whose name stands in another row too, and all the others."""
    names = ["name1", "name2"]
    # what isn't known stands in one row of the table, so its row counts once; any other row of its name is another place
    again = cut(rows.groupBy(*names).agg(F.count("*").alias("copies"), F.min("known").alias("_all")).where("copies > 1 and not _all").select(*names))
    may, rest = split(rows, F.xxhash64(*names), cut(bitmap(again, F.xxhash64(*names))))
    told = may.join(again.withColumn("_hit", F.lit(True)), names, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & ~F.col("known"))
    return told.where("_hit").select(*rows.columns), told.where("not _hit").select(*rows.columns).unionByName(rest)


def _with_text(rows: DataFrame, runs: DataFrame, *fields: str) -> DataFrame:
    """rows with the runs (fields) of their key, those without any left out."""
    live = cut(runs.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*fields)).alias("runs")))
    near, _ = split_rows(rows, cut(key_filter(live)))
    return attach(near, live, "runs").select("doc_id", "version", "text", "runs")


def repeated_windows(docs: DataFrame, *, length: int = LENGTH, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version, start, n: window starts whose `length` bytes also start elsewhere, as runs; each run once or more.

    version is a hash of the text, which tells rows of one key apart; rows equal in both repeat each other.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("doc_id"), row_version(docs[text]).alias("version"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") >= length)
    runs = written(_runs(rows, kind, length, k), "suffix-runs")
    triple = ["name1", "name2", "n"]
    copied = cut(runs.groupBy(*triple).agg(F.count("*").alias("copies")).where("copies > 1").select(*triple))
    name = F.xxhash64(*triple)
    may, single = split(runs, name, cut(bitmap(copied, name)))
    marked = written(may.join(copied.withColumn("known", F.lit(True)), triple, "left").withColumn("known", F.coalesce("known", F.lit(False))), "suffix-known")
    whole = marked.where("known").select("doc_id", "version", "start", "n")
    one = marked.where("known").groupBy(*triple).agg(F.min(F.struct("doc_id", "version", "start", "before", "after", "ahead")).alias("one"), F.first("known").alias("known")).select("n", "known", "one.*")
    columns = ["doc_id", "version", "start", "n", "before", "after", "ahead", "known"]
    triples = one.select(*columns).unionByName(marked.where("not known").select(*columns)).unionByName(single.withColumn("known", F.lit(False)).select(*columns))

    def met(half: str) -> DataFrame:
        """Triples whose half is met in another triple too, one of them not known yet."""
        own = triples.where(F.col(half).isNotNull())
        common = cut(own.groupBy(half).agg(F.count("*").alias("_n"), F.min("known").alias("_all")).where("_n > 1 and not _all").select(half))
        near, _ = split(own, F.col(half), cut(bitmap(common, F.col(half))))
        return near.join(common, half, "left_semi").select("doc_id", "version", "start", "n", "before", "known", (F.col("start") + F.col("before")).alias("place"))

    past = F.greatest(F.lit(0), F.col("before") - (length - k) // 2 + 1)  # starts of the run that cover what goes before
    live = met("after").select("doc_id", "version", (F.col("start") + past).alias("start"), (F.col("n") - past).alias("n"), "known", "place").unionByName(met("ahead").select("doc_id", "version", "start", F.least("n", past).alias("n"), "known", "place"))
    live = live.where("n > 0")
    cells = written(_cells(_with_text(rows, live, "start", "n", "known", "place"), kind, length), "suffix-cells")
    settled, open_ = _doubled(cells)
    told = settled.withColumn("known", F.lit(True)).unionByName(open_)
    # a cell whose core has no double has no repeat; one that is open beside a double goes on window by window
    cores = cut(told.groupBy("core").agg(F.count("*").alias("_n"), F.min("known").alias("_all")).where("_n > 1 and not _all").select("core"))
    near, _ = split(told, F.col("core"), cut(bitmap(cores, F.col("core"))))
    last = near.join(cores, "core", "left_semi").select("doc_id", "version", "start", "n", "known")
    windows = written(_windows(_with_text(rows, last, "start", "n", "known"), kind, length), "suffix-windows")
    single, _ = _doubled(windows)
    return whole.unionByName(settled.select("doc_id", "version", "start", "n")).unionByName(single.select("doc_id", "version", "start", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the whole text's bytes, what is removed, and what stays: n_bytes, n_removed, n_spans, kept (binary).

    Removed is each byte covered by a `length`-byte string that also starts anywhere else, in this document or another,
    overlaps counted, judged on the input. A null text is empty. Texts shorter than `length`, and empty tables, lose
    nothing; repeated rows of at least `length` bytes are removed whole. Only doc_id is carried along.
    """
    kind = dict(docs.dtypes)[key]
    found = repeated_windows(docs, length=length, k=k, key=key, text=text)
    spans = cut(found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    rows = docs.select(docs[key].alias("doc_id"), row_version(docs[text]).alias("version"), F.coalesce(docs[text], F.lit("")).alias("text"))
    may, whole = split_rows(rows, cut(key_filter(spans)))
    both = attach(may, spans, "spans", "left").select("doc_id", "text", "spans").unionByName(whole.select("doc_id", "text", F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans")))

    def run(batches):
        for batch in text_slices(batches, "text"):
            data, at = utf8(batch.column("text"))
            n_removed, n_spans, kept = [], [], []
            for i, spans in enumerate(batch.column("spans")):
                own = data[at[i] : at[i + 1]]
                if not spans.is_valid:
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(own.tobytes())
                    continue
                start = spans.values.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + spans.values.field("n").to_numpy(zero_copy_only=False) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
