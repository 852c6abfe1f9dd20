"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, text_slices, tidy, utf8
from .tokens import merge_counter


def token_counts(docs: DataFrame, model: str, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit, without `text`.

    A null text counts as empty: 0 bytes, 0 tokens. Rows are kept as they are, repeated rows too; an empty table gives
    an empty result, and a very long text is counted whole. Columns of docs that are named like the new ones are replaced. Each row stands alone, so the work
    has no shuffle, and a lost task is simply run again.
    """
    new = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    hold = fresh(docs, "_text")
    source = docs.select(*kept, docs[text].alias(hold))

    def run(batches):
        counter = merge_counter(model)
        for batch in text_slices(batches, hold):
            n = counter.counts(batch.column(hold))
            size = np.diff(utf8(batch.column(hold))[1])
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size), pa.array(n), pa.array(n > limit)], names=[*kept, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*kept).dtypes] + ["n_bytes long", "n_tokens long", "over_limit boolean"])
    return source.mapInArrow(tidy(run), schema)
