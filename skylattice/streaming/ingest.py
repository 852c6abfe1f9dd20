"""Streams of new frames: windows over events, libraries kept up to date batch by batch, ingest that resumes.

Each uses the same operators on what has arrived. A stream's checkpoint folder is its ledger: files that it has taken in
are not taken again, and a run that was broken off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylattice.operators.store import insert_or_replace, merge_pooled, pooled_nights, upsert
from skylattice.operators.variability import flux_cells, normalise_frames
from skylattice.sources.files import frame_rows
from skylattice.streaming.tables import KeyedTable


def frame_counts(events: DataFrame, ts: str, key: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by tumbling window; rows later than `late` are left out. Works on tables as well."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def sessions(events: DataFrame, ts: str, key: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once_within(events: DataFrame, ts: str, keys: list[str], *, late: str = "2 seconds") -> DataFrame:
    """The first row of each key; later ones that come within `late` are copies. On a table, the first by time."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    from pyspark.sql import Window

    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ts))).where("_r = 1").drop("_r")


def library_updater(table: KeyedTable, source: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that pools each batch's nights into a library (see store.merge_pooled), each batch once.

    source names the stream whose batches these are: the table remembers the last number taken from it, in the same step as
    the rows, so a batch that the stream repeats after a failure is passed over. A stream that begins with a new checkpoint
    folder counts from 0 and needs a name of its own.
    """
    (key,) = table.keys

    def update(batch: DataFrame, number: int) -> None:
        table.apply(pooled_nights(batch, key), lambda old, new: merge_pooled(old, new, key, nights="nights"), source=source, number=number)

    return update


def table_updater(table: KeyedTable, source: str, *, replace: bool = False, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each batch by the table's keys, of several rows of a key the last by order."""
    merge = insert_or_replace if replace else upsert

    def update(batch: DataFrame, number: int) -> None:
        table.apply(batch, lambda old, new: merge(old, new, table.keys, order=order), source=source, number=number)

    return update


def night_updater(table: KeyedTable, source: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for frames as they come (frame_id, catalog_id, flux and more): every frame is normalised by
    its own median and put into the table. A frame is a file, so a batch has it whole; one that comes again is replaced."""

    def update(batch: DataFrame, number: int) -> None:
        rows = flux_cells(batch.where("catalog_id is not null"))
        table.apply(normalise_frames(rows), lambda old, new: upsert(old, new, table.keys), source=source, number=number)

    return update


def ingest(spark: SparkSession, source: str, schema: str, update: Callable[[DataFrame, int], None], checkpoint: str, *, files: int = 100) -> StreamingQuery:
    """Take in the Parquet files under source that haven't been taken in yet, `files` at a time, and stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_frames(spark: SparkSession, path: str, update: Callable[[DataFrame, int], None], checkpoint: str, *, columns: list[str], pattern: str = "proc_*.csv", files: int = 100) -> StreamingQuery:
    """Take in the per-frame CSVs under path that have come since the last time, `files` at a time, and stop."""
    texts = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).text(path, wholetext=True)
    return frame_rows(texts, columns).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
