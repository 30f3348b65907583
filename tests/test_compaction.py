from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from fieldmosaic.streaming import daily

SCHEMA = "date date, row int, col int, v double"
DAYS = [datetime.date(2024, 3, d) for d in (1, 2, 3)]


def arrive(spark, folder, rows):
    """One more file, ingested as the next batch."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    stream = daily.watch_folder(spark, f"{folder}/landing", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    daily.ingest_daily(stream, f"{folder}/days", f"{folder}/bad", f"{folder}/check", F.col("v").isNotNull()).awaitTermination()


def merged(spark, folder):
    return sorted(tuple(r) for r in daily.read_ingested(spark, f"{folder}/days").select("date", "row", "col", "v").collect())


def compact(spark, folder):
    return daily.compact_ingested(spark, f"{folder}/days", f"{folder}/compacted")


def read(spark, folder):
    return sorted(tuple(r) for r in daily.read_compacted(spark, f"{folder}/days", f"{folder}/compacted").select("date", "row", "col", "v").collect())


def test_late_and_repeated_arrivals(spark, tmp_path):
    folder, rng = str(tmp_path), random.Random(2)
    cells = [(d, r, c, rng.random()) for d in DAYS[:2] for r in range(3) for c in range(4)]
    arrive(spark, folder, cells)
    assert read(spark, folder) == merged(spark, folder) == sorted(cells)  # nothing is compacted yet
    assert compact(spark, folder) == 2 and compact(spark, folder) == 0
    assert read(spark, folder) == sorted(cells)
    # a late part of the first day repeats cells with other values, and a new day begins
    late = [(DAYS[0], 0, 0, 99.0), (DAYS[0], 7, 7, 1.5), (DAYS[2], 1, 1, 2.5)]
    arrive(spark, folder, late)
    want = sorted([*cells, *late[1:]])
    assert read(spark, folder) == merged(spark, folder) == want  # two days are merged while read, one is scanned
    assert compact(spark, folder) == 2 and compact(spark, folder) == 0
    assert read(spark, folder) == want


def test_a_broken_compaction_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    arrive(spark, folder, [(DAYS[0], 0, 0, 1.0)])
    assert compact(spark, folder) == 1
    arrive(spark, folder, [(DAYS[0], 0, 1, 2.0)])
    # files of the next generation that the manifest does not know yet
    spark.createDataFrame([(0, 0, 77.0, DAYS[0], 2)], "row int, col int, v double, date date, generation long").write.mode("append").partitionBy(
        "date", "generation"
    ).parquet(f"{folder}/compacted/days")
    want = [(DAYS[0], 0, 0, 1.0), (DAYS[0], 0, 1, 2.0)]
    assert read(spark, folder) == want
    assert compact(spark, folder) == 1 and read(spark, folder) == want
