"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and calls one operator on all of docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .langid import fit, keep_identified
from .line_dedup import dedup_lines
from .mixing import mixed_documents
from .ngram_join import one_of_each
from .packing import pack, token_pieces
from .setjoin import Rule


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter (null and empty texts too), or unlike every language
    learned, go. Repeated rows have the same fate; equal scores go to the language first by name. Texts of any length are
    read whole; an empty table, or one without labels, gives none. Columns stay as they are."""
    return keep_identified(docs, fit(docs))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a line before them is alike to, by 0.8 of their words.

    Null and empty texts stay as they are, and no row goes; a text whose lines all go is empty. Of equal lines the first by
    doc_id, text hash and place stays; repeated rows count one after the other. Texts of any length and empty tables pass;
    only the text changes, whatever other columns are called."""
    return dedup_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their word 5-shingles: the lowest doc_id, then text hash.

    Null texts and those without a word are linked with nothing and stay; of repeated rows one stays. Texts of any length
    and empty tables pass, columns stay as they are."""
    return one_of_each(docs, size=5, rule=Rule(80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents once for each pass, and the picked words of the rest.

    Rows without a word, null texts too, are in no mix. A null source is one of its own, last in order. Repeated rows are
    rows like others; ties stand in seeded order. Very long texts are cut at words only where their blocks aren't picked; an
    empty table gives none. Columns stay, `n_chars` follows the text."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in sequences of 2048 tokens.

    A null or empty text is one piece of one token, a very long one as many pieces as it needs; repeated rows give repeated
    pieces, pieces of one length stand in the order of doc_id and piece, an empty table gives none. Only doc_id is carried."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
