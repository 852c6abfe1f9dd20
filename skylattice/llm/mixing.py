"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

Three steps. Sources: targets by weight, held to a multiple of what a source has. Quotas: targets become whole numbers of
equal blocks, first of sources and then of the shards of each source, each time by highest quotients w / (2s + 1). Blocks:
a shard's documents stand in a seeded order, its token stream is cut into blocks, and the quota picks blocks at even
distances from a seeded start; a quota above the number of blocks takes whole passes first. What a document gives then
follows from where its words lie in the stream, so no block ever becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights of sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each document at most this often.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a shard's stream, about; the largest block; blocks that the smallest target has at least.
SHARD_WORDS, BLOCK_WORDS, LEAST_BLOCKS = 1 << 19, 64, 400
SEED = 20240607
#: Sources up to this number are broadcast (100 bytes each); more go through a join.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: source, source_size, weight, target. sizes: source, source_size.

    Targets share the sum of all sizes by weight; none is above `most` times its source's size, and what is above goes to
    the others by weight. That is a water level: sources in the order of size by weight are filled up to their limit while
    their limit is below the level that the rest would get. Sources of size 0 get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (
        named.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_spent", F.coalesce(F.sum(F.col("source_size") * most).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_spent")) / F.col("_open"))
        # the first source whose limit is not below the level sets it for all that follow
        .withColumn("_final", F.first(F.when(F.col("source_size") * most >= F.col("_level") * F.col("weight"), F.col("_level")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, 0)))
    )
    limit = F.col("source_size") * F.lit(float(most))
    return level.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(limit, F.coalesce(F.col("_final") * F.col("weight"), limit))).alias("target"))


def apportion(rows: DataFrame, group: list[str], order: list[Column], weight: str, seats: str, quota: str) -> DataFrame:
    """rows with `quota`: `seats` of each group dealt by highest quotients weight / (2 quota + 1), ties by order.

    With n rows, W weight and K seats in a group, every quotient above W / (K - n/2) is among the highest K and none below
    W / (K + n/2) is. So only the quotients between the two are ranked, at most 2n of a group.
    """
    part = Window.partitionBy(*group)
    bounded = (
        rows.withColumn("_n", F.count("*").over(part))
        .withColumn("_w", F.sum(weight).over(part).cast("double"))
        .withColumn("_sure", F.when((F.col("_w") > 0) & (F.col(seats) > F.col("_n") / 2), F.floor(F.col(weight) * (F.col(seats) - F.col("_n") / 2) / F.col("_w") * (1 - 1e-12) + 0.5)).otherwise(0))
        .withColumn("_most", F.when(F.col("_w") > 0, F.floor(F.col(weight) * (F.col(seats) + F.col("_n") / 2) / F.col("_w") * (1 + 1e-12) + 0.5)).otherwise(0))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(part))
    )
    offers = bounded.withColumn("_s", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))))
    quotient = F.col(weight) / (2 * F.col("_s") + 1)
    ranked = offers.withColumn("_rank", F.row_number().over(part.orderBy(quotient.desc_nulls_last(), *order)))
    won = ranked.groupBy(*rows.columns, "_sure").agg(F.sum(F.when(F.col("_s").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)).alias("_won"))
    return won.select(*rows.columns, (F.col("_sure") + F.col("_won")).cast("long").alias(quota))


def _picks(docs: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...], most: int, shard_words: int, seed: int) -> DataFrame:
    """Every row's _key, _text (hash), source, size, source_size, target, and what the mix takes of it: _pass times the
    whole, and the words from _first on (its place in the shard's stream) whose block is picked."""
    sized = docs.select(docs[key].alias("_key"), docs[source].alias("source"), word_count(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("_text"))
    sized = cut(sized.withColumn("_order", F.xxhash64("_key", "_text", F.lit(seed))))
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    totals = totals.withColumn("_block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.coalesce(smallest, F.lit(1)) / LEAST_BLOCKS))).cast("long"))
    totals = totals.withColumn("_seats_all", F.round(F.sum("target").over(Window.partitionBy()) / F.col("_block")).cast("long"))
    totals = apportion(totals, ["_block"], [F.col("source").asc_nulls_last()], "target", "_seats_all", "_seats")
    totals = cut(totals.withColumn("_shards", F.ceil(F.col("source_size") / shard_words).cast("int")))
    few = totals.count() <= BROADCAST_SOURCES
    facts = totals.select(F.col("source").alias("_source"), "source_size", "target", "_shards", "_seats", "_block")
    sharded = sized.join(F.broadcast(facts) if few else facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sharded = sharded.withColumn("_shard", F.pmod(F.xxhash64("_order"), F.greatest(F.col("_shards"), F.lit(1))).cast("int"))
    shards = sharded.groupBy("source", "_shard").agg(F.sum("size").alias("_size"), *[F.first(c).alias(c) for c in ("_seats", "_block")])
    shards = apportion(shards, ["source"], [F.col("_shard")], "_size", "_seats", "_quota")
    shards = shards.withColumn("_blocks", F.ceil(F.col("_size") / F.col("_block")).cast("long")).withColumn("_quota", F.least(F.col("_quota"), F.col("_blocks") * most))
    shards = shards.select(F.col("source").alias("_source"), F.col("_shard").alias("_part"), "_blocks", "_quota")
    placed = sharded.withColumn("_end", F.sum("size").over(Window.partitionBy("source", "_shard").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_part")))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), F.greatest(F.col("_blocks"), F.lit(1)))
    placed = placed.withColumn("_pass", F.when(F.col("_blocks") > 0, F.floor(F.col("_quota") / F.col("_blocks"))).otherwise(0))
    placed = placed.withColumn("_rest", F.col("_quota") - F.col("_pass") * F.col("_blocks")).withColumn("_start", start).withColumn("_first", F.col("_end") - F.col("size"))
    return placed.withColumn("_some", F.when(F.col("size") == 0, 0).otherwise(_words_picked(F.col("_end")) - _words_picked(F.col("_first"))).cast("long"))


def _picked(block: Column) -> Column:
    """How many of the first so many blocks are picked: every (blocks / rest)th from the seeded start."""
    return _div(block * F.col("_rest") + F.col("_start"), F.greatest(F.col("_blocks"), F.lit(1)))


def _words_picked(word: Column) -> Column:
    """How many of the first so many words of the stream lie in picked blocks."""
    block = _div(word, F.col("_block"))
    inside = word - block * F.col("_block")
    return _picked(block) * F.col("_block") + inside * (_picked(block + 1) - _picked(block))


def mix_sources(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs.

    taken is how many words the mix takes of a document: 0 if none, its size once for each whole pass, up to `most` times
    its size. A null text has size 0; a null source is a source of its own, last in order. Documents of equal key and size
    in a source stand in any order among each other, so their taken counts may be exchanged between them but not changed.
    A very long text is counted whole and may lie in many blocks. Empty tables give empty results; columns of docs with
    clashing names don't matter.
    """
    placed = _picks(docs, key, source, text, weights, most, shard_words, seed)
    return placed.select(F.col("_key").alias(key), F.col("size"), F.col("source").alias(source), F.col("source_size"), F.col("target"), (F.col("_pass") * F.col("size") + F.col("_some")).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", chars: str = "n_chars", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shard_words: int = SHARD_WORDS, seed: int = SEED
) -> DataFrame:
    """The mix itself, with docs' columns: a row as it is for each whole pass, and a row with the picked words of the rest.

    The picked words keep their order and are parted by single spaces; `chars`, where docs has it, follows the text. Rows
    of which nothing is taken, such as those without a word, are not in the mix.
    """
    placed = _picks(docs, key, source, text, weights, most, shard_words, seed).where((F.col("_pass") > 0) & (F.col("size") > 0) | (F.col("_some") > 0))
    wanted = F.struct("_pass", "_some", "_first", "_block", "_blocks", "_rest", "_start")
    facts = placed.groupBy("_key", "_text", "source").agg(F.collect_list(wanted).alias("_picks"))
    facts = facts.select(F.col("_key").alias("_k"), F.col("_text").alias("_t"), F.col("source").alias("_s"), "_picks")
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[key].alias("_key"), F.xxhash64(docs[text]).alias("_text"), docs[source].alias("source"))
    met = wide.join(facts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")))
    single = met.where(F.size("_picks") == 1).select("_row", F.element_at("_picks", 1).alias("_p"))
    # rows equal in key, source and text: each takes one of their picks
    nth = F.row_number().over(Window.partitionBy("_key", "_text", "source").orderBy(F.lit(1)))
    several = met.where(F.size("_picks") > 1).withColumn("_nth", nth).where(F.col("_nth") <= F.size("_picks")).select("_row", F.expr("element_at(_picks, _nth)").alias("_p"))
    every = single.unionByName(several).select("_row", "_p.*")
    whole = every.where("_pass > 0").select("_row", F.explode(F.expr("sequence(1L, _pass)")).alias("_n"), F.col(f"_row.`{text}`").alias("_new")).drop("_n")
    words = F.regexp_extract_all(F.col(f"_row.`{text}`"), F.lit(WORD), F.lit(0))

    def inside(_, i: Column) -> Column:
        block = _div(F.col("_first") + i, F.col("_block"))
        return _picked(block + 1) > _picked(block)

    part = every.where("_some > 0").select("_row", F.array_join(F.filter(words, inside), " ").alias("_new"))
    both = whole.unionByName(part)
    return both.select(*[F.col("_new").alias(c) if c == text else F.char_length("_new").cast(dict(docs.dtypes)[c]).alias(c) if c == chars else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs that are not negative."""
    return ((a - F.pmod(a, b)) / b).cast("long")
