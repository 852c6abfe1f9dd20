"""Streams that are stopped and started again, tables that move only what changed, late rows."""

import math
import os
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylattice.operators import store
from skylattice.sources import files
from skylattice.streaming import ingest
from skylattice.streaming.tables import Conflict, KeyedTable

LIBRARY = "c string, rms double, n_frames long, n_obs long, median_mag double, suspect boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def put(spark, folder, values, schema, hour):
    """One Parquet file of a stream's source, older ones first."""
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    for name in set(os.listdir(folder)) - before:
        os.utime(f"{folder}/{name}", (1_700_000_000 + 3600 * hour,) * 2)


def test_table_moves_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], buckets=16)
    assert table.read().count() == 0 and table.manifest()["version"] == -1
    first = spark.createDataFrame([(i, f"a{i}") for i in range(200)] + [(None, "none")], "k long, v string")
    upsert = lambda old, new: store.upsert(old, new, ["k"])
    assert len(table.apply(first, upsert)) == 16
    before = table.manifest()["parts"]
    touched = table.apply(spark.createDataFrame([(7, "b7"), (None, "other")], "k long, v string"), upsert)
    after = table.manifest()["parts"]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == {str(b) for b in touched}
    assert rows(table.read()) == sorted([(i, "b7" if i == 7 else f"a{i}") for i in range(200)] + [(None, "other")], key=str)
    assert rows(table.read(0)) == rows(first)  # an earlier version is still there
    table.apply(spark.createDataFrame([(i,) for i in range(200)], "k long"), lambda old, gone: store.delete_keys(old, gone, ["k"]))
    assert rows(table.read()) == [(None, "other")] and len(table.manifest()["parts"]) == 1
    assert table.forget() == 3 - 1 and rows(table.read()) == [(None, "other")] and table.versions() == [2]


def test_readers_see_old_or_new(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v int", ["k"], buckets=4)
    upsert = lambda old, new: store.upsert(old, new, ["k"])
    table.apply(spark.createDataFrame([(1, 1), (2, 1)], "k long, v int"), upsert, source="s", number=0)

    def broken(_):
        raise OSError("the driver is lost here")

    change = spark.createDataFrame([(2, 5), (3, 5)], "k long, v int")
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", broken)
        with pytest.raises(OSError):
            table.apply(change, upsert, source="s", number=1)
    assert rows(table.read()) == [(1, 1), (2, 1)] and table.manifest()["applied"] == {"s": 0}
    table.apply(change, upsert, source="s", number=1)
    assert rows(table.read()) == [(1, 1), (2, 5), (3, 5)]
    assert table.apply(spark.createDataFrame([(1, 9)], "k long, v int"), upsert, source="s", number=1) == []
    assert rows(table.read()) == [(1, 1), (2, 5), (3, 5)]
    other = KeyedTable(spark, table.path, table.schema, ["k"])
    late = table.manifest()
    other.apply(spark.createDataFrame([(4, 4)], "k long, v int"), upsert)
    with pytest.raises(Conflict):
        table._commit(late | {"version": late["version"] + 1})
    assert rows(other.read()) == [(1, 1), (2, 5), (3, 5), (4, 4)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The query fails after the library was written and before its own commit; started again, it repeats that batch."""
    source = f"{tmp_path}/in"
    nights = [[("s", 0.3, 4, 1, 12.0, False), ("t", 0.1, 2, 1, 11.0, True)], [("s", 0.1, 12, 1, 13.0, False)], [("s", None, 0, 1, None, False), ("u", 0.2, 1, 1, 9.0, None)]]
    for hour, night in enumerate(nights):
        put(spark, source, night, LIBRARY, hour)
    table = KeyedTable(spark, f"file://{tmp_path}/library", LIBRARY, ["c"], buckets=8)
    update, seen = ingest.library_updater(table, "nights"), []

    def failing(batch, number):
        update(batch, number)
        seen.append(number)
        if seen == [0, 1]:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        ingest.ingest(spark, f"file://{source}", LIBRARY, failing, f"file://{tmp_path}/ledger", files=1).awaitTermination(120)
    assert table.manifest()["applied"] == {"nights": 1}
    ingest.ingest(spark, f"file://{source}", LIBRARY, failing, f"file://{tmp_path}/ledger", files=1).awaitTermination(120)
    assert seen == [0, 1, 1, 2] and table.manifest()["version"] == 2
    got = {r["c"]: r for r in table.read().collect()}
    assert (got["s"]["n_frames"], got["s"]["n_obs"], got["s"]["suspect"]) == (16, 3, False)
    assert got["s"]["rms"] == pytest.approx(math.sqrt((4 * 0.09 + 12 * 0.01) / 16)) and got["s"]["median_mag"] == pytest.approx(12.5)
    assert got["t"]["suspect"] is True and got["u"]["n_frames"] == 1
    once = KeyedTable(spark, f"file://{tmp_path}/once", LIBRARY, ["c"], buckets=8)  # all nights as one batch
    ingest.library_updater(once, "x")(spark.createDataFrame([r for night in nights for r in night], LIBRARY), 0)
    for r in once.read().collect():
        assert (r["n_frames"], r["n_obs"], r["suspect"]) == (got[r["c"]]["n_frames"], got[r["c"]]["n_obs"], got[r["c"]]["suspect"])
        assert r["rms"] == pytest.approx(got[r["c"]]["rms"]) and r["median_mag"] == pytest.approx(got[r["c"]]["median_mag"])


def test_frames_come_night_by_night(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    flux = {(f, s): 100.0 * f + 7 * s + (f * s) % 5 for f in range(1, 7) for s in range(1, 6)}

    def night(frames):
        for f in frames:
            lines = [f"{s},{flux[f, s]}" for s in range(1, 6)]
            text = "catalog_id,dao_flux,zone\n" + "\n".join(f"{x},linear" for x in lines) if f % 2 else "zone,flux,name,catalog_id,dao_flux\n" + "\n".join(f"linear,0,n,{x}" for x in lines)
            (folder / f"proc_{f:03d}.csv").write_text(text + "\n")
        (folder / "notes.txt").write_text("not a frame")

    table = KeyedTable(spark, f"file://{tmp_path}/cells", "catalog_id string, frame_id string, flux double", ["catalog_id", "frame_id"], buckets=4)
    update, batches = ingest.night_updater(table, "frames"), []

    def counted(batch, number):
        batches.append(number)
        update(batch.withColumn("flux", F.col("dao_flux")), number)

    for frames in ([1, 2, 3], [4, 5, 6]):
        night(frames)
        ingest.ingest_frames(spark, f"file://{folder}", counted, f"file://{tmp_path}/ledger", columns=["catalog_id", "dao_flux"], files=2).awaitTermination(120)
    assert len(batches) == 4
    want = [(str(s), f"proc_{f:03d}", flux[f, s] / statistics.median(flux[f, x] for x in range(1, 6))) for f, s in flux]
    assert rows(table.read()) == sorted(want, key=str)


START = datetime(2024, 1, 1)
EVENTS = "ts timestamp, star string, value double"


def event(minute, star="a", value=1.0):
    return (START + timedelta(minutes=minute), star, value)


#: Files of a stream. In the fourth, minute 20 comes when the watermark (10 minutes before 130) has closed its hour for good:
#: Spark drops by the watermark that the batch before has worked with.
FILES = [[event(5), event(20, value=3.0), event(50, "b")], [event(70), event(130)], [event(125, value=5.0), event(131, "b")], [event(20, value=99.0), event(135)], [event(400)], [event(700)], [event(900)]]


@pytest.mark.parametrize("kind", ["windows", "sessions"])
def test_stream_equals_table_without_late_rows(spark, tmp_path, kind):
    for hour, values in enumerate(FILES):
        put(spark, f"{tmp_path}/in", values, EVENTS, hour)
    operator = (lambda t: ingest.frame_counts(t, "ts", "star")) if kind == "windows" else (lambda t: ingest.sessions(t, "ts", "star"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = operator(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = [r for r in rows(spark.read.parquet(f"file://{tmp_path}/out")) if r[0] < START + timedelta(minutes=600)]  # what has closed for certain
    in_time = [e for values in FILES for e in values if e[2] != 99.0]
    closed = [r for r in rows(operator(spark.createDataFrame(in_time, EVENTS))) if r[0] < START + timedelta(minutes=600)]
    assert got == closed and len(got) >= 5
    late = rows(operator(spark.createDataFrame([e for values in FILES for e in values], EVENTS)))
    assert [r for r in late if r[0] < START + timedelta(minutes=600)] != closed


def test_csv_files_of_many_kinds(spark, tmp_path):
    texts = {
        "a": 'catalog_id,note,dao_flux\n1,"x, ""y""\nz",2.5\n2,,\n', "b": "﻿dao_flux,catalog_id\n7,3\n", "c": "catalog_id,dao_flux\n4\n5,6,7\n \n", "d": "zone\nlinear\n\n", "e": "catalog_id\n", "f": "",
        "g": "catalog_id,catalog_id,dao_flux\n8,9,1\n", "h": 'catalog_id,dao_flux\r\n"10", 3 \r\n',
    }
    for name, text in texts.items():
        (tmp_path / f"proc_{name}.csv").write_text(text, encoding="utf-8", newline="")
    read = lambda **k: sorted((r["frame_id"][5:], r["catalog_id"], r["dao_flux"]) for r in files.frames(spark, f"file://{tmp_path}", ["catalog_id", "dao_flux"], **k).collect())
    want = [("a", "1", 2.5), ("a", "2", None), ("b", "3", 7.0), ("c", "4", None), ("c", "5", 6.0), ("d", None, None), ("g", "8", 1.0), ("h", "10", 3.0)]
    assert read() == want
    assert read(names=F.col("_metadata.file_name") >= "proc_g") == [x for x in want if x[0] >= "g"]
    plan = files.frames(spark, f"file://{tmp_path}", ["catalog_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
