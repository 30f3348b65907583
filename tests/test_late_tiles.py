from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldmosaic.operators import windows
from fieldmosaic.streaming import daily, trailing

SCHEMA = "date date, row int, col int, v double"


def write_batch(spark, folder, number, rows):
    """What the ingest leaves of a batch: partitions of its own."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("batch_id", F.lit(number)).coalesce(1)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(f"{folder}/days")


def plain(rows, days):
    """Sums by looking at every pair of rows of a cell; the first value of a cell and day counts."""
    first = {}
    for d, r, c, v in rows:
        first.setdefault((d, r, c), v)
    out = []
    for d, r, c in first:
        near = [v for (e, r2, c2), v in first.items() if (r2, c2) == (r, c) and 0 <= (d - e).days < days and v is not None]
        out.append((d, r, c, round(sum(near), 6) if near else None, len(near)))
    return sorted(out, key=repr)


def read(spark, folder, days):
    df = trailing.read_trailing(spark, f"{folder}/sums")
    return sorted(((r["date"], r["row"], r["col"], None if r[f"v_{days}day"] is None else round(r[f"v_{days}day"], 6), r[f"v_{days}day_valid_days"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, days", [(1, 7), (2, 3), (3, 70)])
def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path, seed, days):
    rng, folder, start = random.Random(seed), str(tmp_path), datetime.date(2024, 1, 1)
    rows = [
        (start + datetime.timedelta(d), r, c, None if rng.random() < 0.1 else round(rng.random(), 3))
        for d in rng.sample(range(200), 25) for r in (5, 130) for c in (0, 1) if rng.random() < 0.8
    ]
    rng.shuffle(rows)
    cut = sorted(rng.sample(range(1, len(rows)), 2))
    arrived = []
    for number, part in enumerate((rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :])):
        write_batch(spark, folder, number, part)
        arrived += part
        assert trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v", days) > 0
        assert read(spark, folder, days) == plain(arrived, days)
    assert trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v", days) == 0
    batch = windows.trailing_sum(daily.read_ingested(spark, f"{folder}/days"), "v", days)
    assert trailing.read_trailing(spark, f"{folder}/sums").count() == batch.count()


def test_a_late_tile_rewrites_only_its_blocks(spark, tmp_path):
    folder, start = str(tmp_path), datetime.date(2024, 1, 1)
    rows = [(start + datetime.timedelta(d), r, 0, 1.0) for d in range(0, 180, 2) for r in (5, 130, 250)]
    write_batch(spark, folder, 0, rows)
    trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v")
    late = (start + datetime.timedelta(41), 130, 0, 5.0)
    write_batch(spark, folder, 1, [late])
    assert trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v") == 1
    fresh = spark.read.parquet(f"{folder}/sums/blocks").where("generation = 2")
    assert {(r["band"],) for r in fresh.select("band").distinct().collect()} == {(1,)}
    assert read(spark, folder, 7) == plain([*rows, late], 7)


def test_broken_refresh_and_replay(spark, tmp_path):
    folder, start = str(tmp_path), datetime.date(2024, 1, 1)
    rows = [(start + datetime.timedelta(d), 5, c, float(d)) for d in range(10) for c in range(3)]
    write_batch(spark, folder, 0, rows[:20])
    trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v")
    before = read(spark, folder, 7)
    # files of a generation that never reached the manifest
    junk = trailing.read_trailing(spark, f"{folder}/sums").withColumns({"v_7day": F.lit(-1.0), "chunk": F.lit(308), "band": F.lit(0), "generation": F.lit(2)})
    junk.write.mode("append").partitionBy("chunk", "band", "generation").parquet(f"{folder}/sums/blocks")
    assert read(spark, folder, 7) == before == plain(rows[:20], 7)
    write_batch(spark, folder, 0, rows[:20])  # a replayed batch changes nothing
    assert trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v") == 0
    write_batch(spark, folder, 1, rows[20:])
    trailing.refresh_trailing(spark, f"{folder}/days", f"{folder}/sums", "v")
    assert read(spark, folder, 7) == plain(rows, 7)
