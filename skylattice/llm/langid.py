"""Language identification by interpolated Kneser-Ney character models.

Training counts 4-grams of letters over every training row, where it lies; the counts meet once. Everything of the
models comes from all 4-grams by aggregates and joins by n-gram, whatever their number. The tables are dealt into parts of
bounded size, by language block and by key, and each part is a sorted hash array: n-grams ordered by a scrambled key, beside
each a row of log probabilities, one for each language of the block. Small models stay in the workers; of larger ones a
worker holds one part at a time. A text belongs to the language with the lowest cross-entropy per character. A calibration fold, which takes no part in the counts, gives the score and
the limits beyond which a prediction is rejected.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, code_points, fresh, mix, text_slices, tidy, written

ORDER = 4
#: Languages of a block, which share a table; numbers of a part of a table, about; bytes up to which a worker holds all
#: parts of a model.
BLOCK, PART_CELLS, HELD_BYTES = 8, 1 << 22, 160 << 20
#: n-grams are dealt into parts by their remainder by this prime.
DEAL = 1_000_003
#: Bytes of text that are scored at once with a model that isn't held, and places that are expanded at once.
LONG_SLICE, PLACES = 16 << 20, 1 << 20
#: Rows of the calibration fold that the score is fitted on, about (a hash of doc_id chooses them); of a language that has
#: too few among these, so many, or all that the fold has.
CALIBRATION_ROWS, LANGUAGE_ROWS = 20_000, 500
#: Rightly predicted calibration rows from which a language's deviation is its own alone.
OWN_ROWS = 20
#: Distinct 4-grams that a task gathers before it sends them on.
TASK_GRAMS = 2_000_000
#: A prediction is rejected where its score is lower, or its cross-entropy lies this many deviations above the mean.
LEAST_SCORE, MOST_DEVIATIONS = 0.5, 8.0
UNKNOWN = "und"


@lru_cache(1)
def _symbols() -> np.ndarray:
    """For each code point 32 if it is no letter, else its lower case; those beyond 16 bits share a private range."""
    out = np.full(0x110000, 32, np.uint16)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            small = chr(c).lower()
            code = ord(small) if len(small) == 1 else c
            out[c] = code if code < 0x10000 else 0xE000 + code % 0x1900
    return out


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all 4-grams, the number before each text, and the letters of each text.

    Letters are lower-cased, every run of anything else is one space, and a text begins with ORDER - 1 spaces and ends with one, so that each
    of its symbols has a full history.
    """
    points, at = code_points(texts)
    symbol = _symbols()[points]
    letter = symbol != 32
    first = np.zeros(len(symbol) + 1, bool)
    first[at] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:-1]  # the first sign after a letter stands for the whole run
    before = np.concatenate([[0], np.cumsum(keep)])[at]
    letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[at])
    size = np.diff(before)
    pad = ORDER - 1
    start = before[:-1] + (pad + 1) * np.arange(len(size))
    out = np.full(int(before[-1]) + (pad + 1) * len(size), 32, np.uint64)
    place = np.arange(int(before[-1])) + np.repeat((pad + 1) * np.arange(len(size)) + pad, size)
    out[place] = symbol[keep]
    ends_open = np.ones(len(size), bool)  # a text that ends in a space already has it
    has = size > 0
    ends_open[has] = out[start[has] + pad + size[has] - 1] != 32
    n = size + ends_open
    n[~has] = 0
    key = out[: len(out) - pad].copy() if len(out) > pad else np.zeros(0, np.uint64)
    for i in range(1, ORDER):
        key = (key << np.uint64(16)) | out[i : len(out) - pad + i]
    shift = start - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else start
    key = key[np.repeat(shift, n) + np.arange(int(n.sum()))]
    return key, np.concatenate([[0], np.cumsum(n)]), letters


# ---------------------------------------------------------------- sorted hash arrays


class HashArray:
    """64-bit keys in the order of their scrambled value, found through a directory of its highest bits."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(keys)
        self.order = np.argsort(hashed, kind="stable")
        self.hashed = np.append(hashed[self.order], np.uint64(0))
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        top = np.searchsorted(self.hashed[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.first = np.append(top, len(keys)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none; rows are in hash order."""
        hashed = mix(keys)
        at = self.first[(hashed >> self.shift).astype(np.int64)]
        out = np.where(self.hashed[at] == hashed, at, np.int32(-1))
        if len(self.hashed) == 1:
            return np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(out < 0)
        at, hashed = at[open_], hashed[open_]
        for _ in range(1, self.longest):
            at = np.minimum(at + 1, len(self.hashed) - 2)
            value = self.hashed[at]
            hit = value == hashed
            out[open_[hit]] = at[hit]
            more = value < hashed
            open_, at, hashed = open_[more], at[more], hashed[more]
            if not len(open_):
                break
        return out


class Table:
    """Rows of float32, one for each key, in parts that are broadcast one by one."""

    def __init__(self, parts: list[Broadcast], width: int):
        self.parts, self.width = parts, width

    def rows(self, keys: np.ndarray, held: bool) -> tuple[np.ndarray, np.ndarray]:
        """The row of each key, and whether there is one; the others' rows mean nothing."""
        if len(self.parts) == 1:
            return self._look(0, keys, held)
        owner = np.mod(keys.view(np.int64), DEAL) % len(self.parts)
        out, found = np.zeros((len(keys), self.width), np.float32), np.zeros(len(keys), bool)
        for i in range(len(self.parts)):
            own = np.flatnonzero(owner == i)
            if len(own):
                out[own], found[own] = self._look(i, keys[own], held)
        return out, found

    def _look(self, i: int, keys: np.ndarray, held: bool) -> tuple[np.ndarray, np.ndarray]:
        part = self.parts[i]
        index, values = part.value
        if not held:
            part.__dict__.pop("_value", None)  # the file stays, and is read again when the part is needed again
        if not len(values):
            return np.zeros((len(keys), self.width), np.float32), np.zeros(len(keys), bool)
        row = index.find(keys)
        return values[row], row >= 0


@dataclass
class Level:
    """N-grams of one order: log probabilities by language, and log weights of the lower order by history."""

    grams: Table
    histories: Table


@dataclass
class Model:
    languages: list[str]
    blocks: list[list[Level]]  # for each BLOCK languages, the highest order first
    log_uniform: float
    held: bool
    weights: np.ndarray  # of the score: constant, margin, log length
    mean: np.ndarray
    deviation: np.ndarray

    @property
    def slice_bytes(self) -> int:
        return SLICE_BYTES if self.held else LONG_SLICE

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of each 4-gram's last symbol given the others, for each language."""
        return np.concatenate([self._level(keys, levels, 0) for levels in self.blocks], axis=1)

    def _level(self, keys: np.ndarray, levels: list[Level], k: int) -> np.ndarray:
        if k == len(levels):
            return np.full((len(keys), levels[0].grams.width), self.log_uniform, np.float32)
        out, found = levels[k].grams.rows(keys, self.held)
        miss = np.flatnonzero(~found)
        if len(miss):
            lost = keys[miss]
            lower = lost & np.uint64((1 << (16 * (len(levels) - k - 1))) - 1)
            rest, known = levels[k].histories.rows(lost >> np.uint64(16), self.held)
            out[miss] = np.where(known[:, None], rest, 0) + self._level(lower, levels, k + 1)
        return out

    def _entropies(self, key: np.ndarray, at: np.ndarray, levels: list[Level]) -> np.ndarray:
        """Cross-entropy per symbol in nats (texts, languages of a block)."""
        n = np.diff(at)
        total = np.zeros((len(n), levels[0].grams.width))
        if not self.held:
            distinct, key = np.unique(key, return_inverse=True)
            table = self._level(distinct, levels, 0)
        for low in range(0, len(key), PLACES):
            high = min(low + PLACES, len(key))
            values = self._level(key[low:high], levels, 0) if self.held else table[key[low:high]]
            begin = np.unique(np.append(at[(at > low) & (at < high)], low))
            total[np.searchsorted(at, begin, "right") - 1] += np.add.reduceat(values, begin - low, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None]

    def nearest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number and cross-entropy per symbol in nats, how much more the second best has, and the
        symbols and letters of each text."""
        key, at, letters = grams(texts)
        n = np.diff(at)
        best, low, second = np.zeros(len(n), np.int64), np.full(len(n), np.inf), np.full(len(n), np.inf)
        for b, levels in enumerate(self.blocks):
            entropy = self._entropies(key, at, levels)
            own = entropy.argmin(axis=1)
            least = entropy[np.arange(len(n)), own]
            next_ = np.partition(entropy, 1, axis=1)[:, 1] if entropy.shape[1] > 1 else np.full(len(n), np.inf)
            better = least < low
            second = np.minimum(np.where(better, next_, second), np.where(better, low, least))
            best, low = np.where(better, b * BLOCK + own, best), np.minimum(low, least)
        return best, low, second - low if len(self.languages) > 1 else np.ones(len(n)), n, letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, and whether the prediction is rejected."""
        if not self.languages:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        best, low, margin, n, letters = self.nearest(texts)
        score = 1 / (1 + np.exp(-np.clip(_features(margin, n) @ self.weights, -40, 40)))
        none = letters == 0
        score[none] = 0
        rejected = none | (score < LEAST_SCORE) | (low > self.mean[best] + MOST_DEVIATIONS * self.deviation[best])
        return [UNKNOWN if z else self.languages[b] for z, b in zip(none.tolist(), best.tolist(), strict=True)], score, np.where(none, 0, low), rejected


def _features(margin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A constant, how far the second best is in nats per symbol, and the same times the log of the length."""
    return np.column_stack([np.ones(len(n)), margin, margin * np.log1p(n)])


# ---------------------------------------------------------------- training


def _kneser_ney(counts: DataFrame) -> tuple[list[str], list[list[Level]], float, bool]:
    """Languages, levels of each block of them, log of the uniform probability, and whether workers hold all, from
    counts (lang, gram, n) of 4-grams.

    The highest order uses counts, the lower ones how many different symbols stand before an n-gram. Each order takes a
    discount n1 / (n1 + 2 n2) from what it has and gives it to the lower one; the lowest gives it to all symbols alike.
    """
    spark = counts.sparkSession
    tables = {ORDER: written(counts, "grams")}
    for m in range(ORDER - 1, 0, -1):
        tables[m] = written(tables[m + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * m)) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
    rare = [t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).withColumn("m", F.lit(m)) for m, t in tables.items()]
    found = {(r["m"], r["lang"]): (r["once"], r["twice"]) for r in reduce(DataFrame.unionByName, rare).collect()}
    languages = sorted({lang for _, lang in found})
    if not languages:
        return [], [], 0.0, True
    log_uniform = float(-np.log(tables[1].select("gram").distinct().count() + 1))
    width = min(BLOCK, len(languages))
    slots = range(width)
    dense: DataFrame | None = None
    made: dict[tuple[int, str], DataFrame] = {}
    for m in range(1, ORDER + 1):
        known = []
        for i, lang in enumerate(languages):
            once, twice = found[m, lang]
            known.append((lang, i // BLOCK, i % BLOCK, min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5))
        told = F.broadcast(spark.createDataFrame(known, "lang string, block int, slot int, d double"))
        table = tables[m].join(told, "lang").withColumn("history", F.shiftrightunsigned("gram", 16))

        def by_slot(value: Column) -> Column:
            return F.array(*[F.sum(F.when(F.col("slot") == i, value)) for i in slots])  # noqa: B023

        histories = table.groupBy("block", "history").agg(by_slot(F.col("n")).alias("total"), by_slot(F.col("d")).alias("kept"))
        rest = F.array(*[F.coalesce(F.col("kept")[i] / F.col("total")[i], F.lit(1.0)) for i in slots])
        histories = written(histories.select("block", F.col("history").alias("key"), "total", rest.alias("rest")), "histories")
        own = table.groupBy("block", "gram", "history").agg(by_slot(F.col("n") - F.col("d")).alias("own"))
        own = own.join(histories.withColumnRenamed("key", "history"), ["block", "history"])
        if dense is None:
            below = F.lit(float(np.exp(log_uniform)))
            p = [F.coalesce(F.col("own")[i] / F.col("total")[i], F.lit(0.0)) + F.col("rest")[i] * below for i in slots]
        else:
            own = own.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << (16 * (m - 1))) - 1)))
            own = own.join(dense.select("block", F.col("key").alias("low"), F.col("p").alias("below")), ["block", "low"])
            p = [F.coalesce(F.col("own")[i] / F.col("total")[i], F.lit(0.0)) + F.col("rest")[i] * F.col("below")[i] for i in slots]
        dense = written(own.select("block", F.col("gram").alias("key"), F.array(*p).alias("p")), "probabilities")
        for name, df, column in (("grams", dense, "p"), ("histories", histories, "rest")):
            made[m, name] = df.select("block", "key", F.transform(column, lambda x: F.log(x).cast("float")).alias("v"))
    sizes = reduce(DataFrame.unionByName, [df.groupBy("block").count().withColumns({"m": F.lit(m), "name": F.lit(name)}) for (m, name), df in made.items()])
    size = {(r["m"], r["name"], r["block"]): r["count"] for r in sizes.collect()}
    held = sum(size.values()) * (4 * width + 16) <= HELD_BYTES

    blocks = range(-(-len(languages) // BLOCK))

    def part_of(got: pa.Table, block: int) -> Broadcast:
        keys = HashArray(got["key"].to_numpy().astype(np.int64).view(np.uint64))
        values = np.asarray(got["v"].combine_chunks().flatten(), np.float32).reshape(-1, width)[keys.order, : len(languages) - BLOCK * block]
        keys.order = keys.order[:0]
        return spark.sparkContext.broadcast((keys, np.ascontiguousarray(values)))

    def tables_of(m: int, name: str) -> list[Table]:
        """The table of each block, which the driver reads and broadcasts part by part."""
        df, cells = made[m, name], [size[m, name, b] * width for b in blocks]
        if sum(cells) <= PART_CELLS:
            got = df.toArrow()
            parts = [[part_of(got.filter(pa.array(got["block"].to_numpy() == b)), b)] for b in blocks]
        else:
            parts = []
            for b in blocks:
                n = -(-cells[b] // PART_CELLS)
                dealt = [df.where((F.col("block") == b) & (F.pmod(F.pmod("key", F.lit(DEAL)), F.lit(n)) == i)) for i in range(n)]
                parts.append([part_of(x.toArrow(), b) for x in dealt])
        return [Table(own, min(width, len(languages) - BLOCK * b)) for b, own in zip(blocks, parts, strict=True)]

    levels = [Level(*at) for m in range(ORDER, 0, -1) for at in zip(tables_of(m, "grams"), tables_of(m, "histories"), strict=True)]
    return languages, [levels[b :: len(blocks)] for b in blocks], log_uniform, held


def _limits(number: int, best: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the cross-entropy for each language, from those of rightly predicted rows (language, value).

    A language with OWN_ROWS has its own. One with fewer has its own mean, and a deviation filled up to OWN_ROWS with that
    within all languages, wider as the mean is less sure. One without any takes those of all rows. Only without a single
    row there is nothing to tell a limit from, and none.
    """
    if not len(low):
        return np.full(number, np.inf), np.zeros(number)
    n = np.bincount(best, minlength=number)
    mean = np.bincount(best, low, number) / np.maximum(n, 1)
    squares = np.bincount(best, (low - mean[best]) ** 2, number)
    within = squares.sum() / max(1, len(low) - np.count_nonzero(n))
    filled = np.sqrt((squares + np.maximum(OWN_ROWS - n, 0) * within) / np.maximum(n, OWN_ROWS) * np.where(n < OWN_ROWS, 1 + 1 / np.maximum(n, 1), 1))
    return np.where(n > 0, mean, low.mean()), np.maximum(np.where(n > 0, filled, low.std()), 0.02)


def _fit_score(margin: np.ndarray, n: np.ndarray, right: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps; a row stands for as many as it was chosen from."""
    x, y = _features(margin, n), right.astype(float)
    w = np.zeros(x.shape[1])
    stands = share.min() / share
    ridge = np.diag([1e-3, 1e-3, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (stands * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (stands * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (lang, text)."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            distinct, back = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(back, counts).astype(np.int64)

        def sent():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in text_slices(batches, "text"):
            key, at, _ = grams(batch.column("text"))
            codes = batch.column("lang").dictionary_encode()
            own = np.repeat(codes.indices.to_numpy(), np.diff(at))
            for i, lang in enumerate(codes.dictionary.to_pylist()):
                mine = key[own == i]
                if len(mine):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(mine, return_counts=True))
                    size += len(parts[-1][0])
                    if len(parts) > 8:
                        size -= sum(len(k) for k, _ in parts)
                        parts[:] = [merged(parts)]
                        size += len(parts[0][0])
            if size > TASK_GRAMS:
                yield from sent()
                held, size = {}, 0
        yield from sent()

    return rows.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, calibration: DataFrame) -> Model:
    """A model from rows (lang, text), its score and limits fitted on calibration (lang, text, and share if its rows were
    chosen from more, by different shares). Null langs and texts take no part.

    Without rows the model knows no language and predicts `und` for everything. Without calibration rows, or with only
    right or only wrong ones among them, the score rests on the ridge alone.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages, blocks, log_uniform, held = _kneser_ney(gram_counts(rows))  # rows without a letter teach nothing
    model = Model(languages, blocks, log_uniform, held, np.zeros(3), np.full(len(languages), np.inf), np.zeros(len(languages)))
    if not languages:
        return model

    def run(batches):
        for batch in text_slices(batches, "text", model.slice_bytes):
            found = zip(("best", "low", "margin", "n", "letters"), model.nearest(batch.column("text")), strict=True)
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "share": batch.column("share")} | {k: pa.array(v) for k, v in found})

    fold = calibration.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.col("share") if "share" in calibration.columns else F.lit(1.0).alias("share"))
    found = fold.mapInArrow(tidy(run), "lang string, share double, best long, low double, margin double, n long, letters long").where("letters > 0").toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    own = np.array([number.get(x, -1) for x in found["lang"].to_pylist()], np.int64)
    found, own = found.filter(pa.array(own >= 0)), own[own >= 0]
    if found.num_rows:
        best, low, margin, n = (found[c].to_numpy() for c in ("best", "low", "margin", "n"))
        right = best == own
        weights = _fit_score(margin, n, right, found["share"].to_numpy())
        mean, deviation = _limits(len(languages), best[right], low[right])
        model = replace(model, weights=weights, mean=mean, deviation=deviation)
    return model


def fold_of(key: Column) -> Column:
    """The fold, 0 to 3, of a doc_id: crc32 of its text modulo 4; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from docs: counts over folds 0, 1 and what a bounded part of fold 3, by language, leaves of it;
    that part gives score and limits, fold 2 is held out."""
    rows = docs.select(docs[key].alias("key"), docs[lang].alias("lang"), docs[text].alias("text")).withColumn("fold", fold_of(F.col("key")))
    labelled = rows.where("fold <> 2 and lang is not null")
    sizes = labelled.where("fold = 3").groupBy("lang").agg(F.count("*").alias("rows"))
    n = sizes.agg(F.sum("rows")).first()[0] or 1
    share = F.least(F.lit(1.0), F.greatest(F.lit(CALIBRATION_ROWS / n), LANGUAGE_ROWS / F.col("rows")))
    told = labelled.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang", "left")
    place = F.pmod(F.xxhash64("key"), F.lit((1 << 31) - 1)) / F.lit(float((1 << 31) - 1))
    chosen = (F.col("fold") == 3) & (place < F.col("share"))
    return train(told.where(~F.coalesce(chosen, F.lit(False))).select("lang", "text"), told.where(chosen).select("lang", "text", "share"))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs, without `text`, and lang_pred, score, cross_entropy, rejected.

    lang_pred is `und`, score 0 and rejected true where the text is null or has no letter. Equal cross-entropies go to the
    language first by name. A very long text is read whole. Repeated rows, extra columns and empty tables pass; columns
    named like the new ones are replaced.
    """
    new = ("lang_pred", "score", "cross_entropy", "rejected")
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    return _with_predictions(docs, model, text, kept)


def keep_identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of docs whose language isn't rejected, with docs' own columns, whatever they are called.

    Null texts and those without a letter go; of repeated rows all stay or none. Very long texts are read whole, and an empty
    table gives none.
    """
    mark = fresh(docs, "rejected")
    hold = _with_predictions(docs, model, text, list(docs.columns), rejected=mark)
    return hold.where(~F.col(mark)).select(*docs.columns)


def _with_predictions(docs: DataFrame, model: Model, text: str, kept: list[str], rejected: str | None = None) -> DataFrame:
    hold = text if text in kept else fresh(docs, "_text")
    source = docs.select(*kept) if text in kept else docs.select(*kept, docs[text].alias(hold))
    names = [*kept, rejected] if rejected else [*kept, "lang_pred", "score", "cross_entropy", "rejected"]

    def run(batches):
        for batch in text_slices(batches, hold, model.slice_bytes):
            lang, score, low, out = model.predict(batch.column(hold))
            own = [batch.column(c) for c in kept]
            more = [pa.array(out)] if rejected else [pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*own, *more], names=names)

    extra = [f"`{rejected}` boolean"] if rejected else ["lang_pred string", "score double", "cross_entropy double", "rejected boolean"]
    return source.mapInArrow(tidy(run), ", ".join([f"`{c}` {t}" for c, t in docs.select(*kept).dtypes] + extra))
