"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import stages
from skylattice.llm.common import written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", stages.identify_language),
    ("line dedup", stages.remove_lines),
    ("n-gram Jaccard join", stages.keep_one_of_each),
    ("mixing sources to target weights", stages.mix),
    ("best-fit packing", stages.pack_sequences),
]

#: Language models, similarity joins and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
