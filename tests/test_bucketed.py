from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.operators import align
from fieldmosaic.plans import product
from fieldmosaic.sources import bucketed

START = datetime.date(2024, 2, 1)
DAYS = [START + datetime.timedelta(d) for d in range(5)]
BANDS = list(names.BANDS)


@pytest.fixture()
def settings_back(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition"]
    before = {k: spark.conf.get(k) for k in keys}
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tables(spark):
    rng = random.Random(4)
    cells = [(r, c) for r in range(6) for c in range(5)]
    daily = [(d, r, c, rng.randrange(2), rng.random(), *[rng.random() for _ in BANDS]) for d in DAYS for r, c in cells if rng.random() < 0.6]
    grid = spark.createDataFrame(daily, "date date, row int, col int, VOD_QC int, value double, " + ", ".join(f"{b} double" for b in BANDS))
    lai = spark.createDataFrame([(START + datetime.timedelta(d), r, c, rng.random()) for d in (0, 8) for r, c in cells if rng.random() < 0.8], "date date, row int, col int, LAI double")
    static = spark.createDataFrame([(r, c, rng.random()) for r, c in cells], "row int, col int, Hveg double")
    annual = spark.createDataFrame([(2024, r, c, 0.5) for r, c in cells[::2]], "year int, row int, col int, GRA double")
    return grid, lai, static, annual, static.select("row", "col")


def features(spark, keep, bucketed_cells):
    grid, lai, static, annual, cells = tables(spark)
    daily = keep("daily", grid, "date")
    more = {"cells": keep("cells", cells), "segments": keep("segments", align.composite_segments(lai, "LAI"))} if bucketed_cells else {"rows": 6, "columns": 5}
    return product.daily_features(
        spark.createDataFrame([(d,) for d in DAYS], "date date"), daily.select("date", "row", "col", "VOD_QC", *BANDS), lai,
        daily.select("date", "row", "col", F.col("value").alias("LST")), daily.select("date", "row", "col", F.col("value").alias("rain")),
        keep("static", static), keep("annual", annual), bands=BANDS, **more,
    )


def left_spine(df):
    """Names of the nodes from the result down the first inputs."""
    node, out = df._jdf.queryExecution().executedPlan(), []
    while True:
        out.append(node.nodeName())
        if node.children().isEmpty():
            return out
        node = node.children().head()


@pytest.mark.parametrize("days", [DAYS, []])
def test_days_without_any_composite(spark, days):
    lai = spark.createDataFrame([], "date date, row int, col int, LAI double")
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    brackets = dates.join(align.bracketing_days(dates, lai), ["date"], "left")
    made = product.rasters.cells_on_days(spark.createDataFrame([(1, 2)], "row int, col int"), brackets)
    assert made.count() == len(days) and made.where("__start IS NOT NULL").count() == 0


def test_cells_of_the_days_are_not_shuffled(spark, tmp_path, settings_back):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def keep(name, df, partition=None):
        return bucketed.write_bucketed(df, f"t_{name}", f"{tmp_path}/{name}", 4, partition)

    plain = features(spark, lambda name, df, partition=None: df, False)
    expected = sorted(map(str, plain.select(sorted(plain.columns)).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    made = features(spark, keep, True)
    spine = left_spine(made)
    assert sum("Join" in n for n in spine) >= 5 and spine[-1].startswith("Scan parquet") and spine[-1].endswith("t_cells")
    assert not [n for n in spine if "Exchange" in n]
    assert sorted(map(str, made.select(sorted(made.columns)).collect())) == expected and len(expected) == 150
    for name in ("daily", "cells", "segments", "static", "annual"):
        spark.sql(f"DROP TABLE t_{name}")
