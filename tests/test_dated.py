"""Retention by days: what goes, what stays, and which files are opened."""

import os
import random

from pyspark.sql import functions as F

from replicalog.operators import events
from replicalog.sources.dated import DAY, DatedTable

from .test_core import EVENT, event


def test_retention_opens_the_border_day_and_open_warnings_only(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for day in range(12):
        for k in range(6):
            rows.append(event(day * 100 + k, day * DAY + rng.randint(0, DAY - 1), severity=1 if day in (2, 5) else 0, resolution=rng.choice([0, 2]) if day == 2 else 0))
    log = spark.createDataFrame(rows, EVENT)
    table = DatedTable(spark, f"file://{tmp_path}/log", EVENT, keeps=events.is_attention())
    table.append(log.where("id % 100 < 4"))
    table.append(log.where("id % 100 >= 4"))
    cutoff = 8 * DAY + DAY // 2
    opened = {d.day for d in table.to_read(cutoff)}
    assert opened <= {2, 8} and 8 in opened
    # Files of other days are spoiled: a read of one would fail.
    for d in table.days():
        if d.day not in opened:
            for f in os.listdir(f"{tmp_path}/log/{d.path}"):
                if f.endswith(".parquet"):
                    os.rename(f"{tmp_path}/log/{d.path}/{f}", f"{tmp_path}/log/{d.path}/{f}.kept")
                    open(f"{tmp_path}/log/{d.path}/{f}", "wb").write(b"spoiled")
    kept_files = {d.path for d in table.days() if d.day > 8 or d.day == 5}
    got = table.drop_before(cutoff)
    assert kept_files <= {d.path for d in table.days()}
    for d in table.days():
        for f in os.listdir(f"{tmp_path}/log/{d.path}"):
            if f.endswith(".kept"):
                os.rename(f"{tmp_path}/log/{d.path}/{f}", f"{tmp_path}/log/{d.path}/{f[:-5]}")
                if os.path.exists(f"{tmp_path}/log/{d.path}/.{f[:-5]}.crc"):
                    os.remove(f"{tmp_path}/log/{d.path}/.{f[:-5]}.crc")
    want = events.archive_events(log, 1, False, cutoff + 1)
    assert {r.id for r in table.read().collect()} == {r.id for r in want.collect()}
    preview = events.archive_preview(log, 1, False, cutoff + 1).first()
    assert got == {"deleted": preview.deleted, "kept": preview.kept_open}
    assert table.drop_before(cutoff) == {"deleted": 0, "kept": preview.kept_open}
    table.vacuum(1)
    assert {r.id for r in table.read().collect()} == {r.id for r in want.collect()} and len(table.versions()) == 1


def test_everything_goes_and_spans_are_read(spark, tmp_path):
    log = spark.createDataFrame([event(i, i * 10_000) for i in range(60)], EVENT)
    table = DatedTable(spark, str(tmp_path / "log"), EVENT, keeps=events.is_attention())
    table.append(log)
    assert {r.id for r in table.read(95_000, 250_000).collect()} == set(range(10, 25)) and len(table.read(95_000, 250_000).inputFiles()) == 2
    assert table.drop_before(300_000)["deleted"] == 0
    assert table.drop_before(300_000, everything=True) == {"deleted": 30, "kept": 0}
    assert {r.id for r in table.read().collect()} == set(range(30, 60))
    assert DatedTable(spark, str(tmp_path / "none"), EVENT).drop_before(5) == {"deleted": 0, "kept": 0}


def test_archived_files_by_age(spark, tmp_path):
    schema = "folder string, archive_path string, path string, size long, modified_s long"
    table = DatedTable(spark, str(tmp_path / "a"), schema, time="modified_s")
    table.append(spark.range(40).select(F.lit("f").alias("folder"), F.col("id").cast("string").alias("archive_path"), F.lit("p").alias("path"), F.lit(1).cast("long").alias("size"), (F.col("id") * 20_000).alias("modified_s")))
    assert table.drop_before(400_001)["deleted"] == 21 and table.read().count() == 19
