from __future__ import annotations

import datetime
import random

import pytest

from fieldmosaic.operators import align, rasters
from fieldmosaic.plans import product

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


@pytest.fixture
def composites(rows):
    """Values every eight days without the third composite; cells miss some composites, some values are NULL."""
    rng = random.Random(3)
    data = [(day(d), r, c, None if rng.random() < 0.2 else rng.randint(0, 90) / 8) for d in (0, 8, 24, 32) for r in range(4) for c in range(5) if rng.random() < 0.8]
    return rows("date date, row int, col int, lai double", data)


def plain(grid, asked):
    """Both sides looked up one by one."""
    values = {(r.date, r.row, r.col): r.lai for r in grid.collect()}
    days = sorted({k[0] for k in values})
    out = {}
    for i, d, r, c in asked:
        low, high = max((x for x in days if x <= d), default=None), min((x for x in days if x >= d), default=None)
        one, two = values.get((low, r, c)), values.get((high, r, c))
        if low is None or high is None or one is None or two is None:
            out[i] = None
        else:
            w = 0.0 if low == high else (d - low).days / (high - low).days
            out[i] = one * (1.0 - w) + two * w
    return out


@pytest.fixture
def asked(rows):
    data = [(i, day(d), r, c) for i, (d, r, c) in enumerate((d, r, c) for d in range(-2, 36) for r in range(4) for c in range(6))]
    return data, rows("id long, date date, row int, col int, low string, weight string, start_date string", [(*x, "l", "w", "s") for x in data])


def test_segments_equal_two_lookups(spark, composites, asked, tmp_path):
    data, samples = asked
    want = plain(composites, data)
    found = align.interpolated_values(samples, composites, "lai")
    assert sorted(found.columns) == sorted([*samples.columns, "lai"])
    assert {r.id: r.lai for r in found.collect()} == want
    # segments that were written once serve any days
    path = str(tmp_path / "segments")
    align.composite_segments(composites, "lai").write.parquet(path)
    again = align.interpolated_values(samples, composites, "lai", spark.read.parquet(path))
    assert {r.id: r.lai for r in again.collect()} == want


def test_segments_of_an_empty_grid(rows, asked):
    _, samples = asked
    empty = rows("date date, row int, col int, lai double", [])
    assert align.composite_segments(empty, "lai").collect() == []
    assert {r.lai for r in align.interpolated_values(samples, empty, "lai").collect()} == {None}


def test_samples_meet_two_tables_only(spark, composites, asked):
    """The days' brackets and the segments: no third join on the samples' side."""
    _, samples = asked
    plan = align.interpolated_values(samples, composites, "lai", align.composite_segments(composites, "lai"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftOuter") == 3  # with the calendar join inside the segments
    assert plan.count("Join LeftOuter, (((__start") == 1


def test_observed_cells_equal_the_full_grid(rows):
    rng = random.Random(5)
    seen = [(day(d), r, c) for d in range(4) for r in range(6) for c in range(7) if rng.random() < 0.4]
    daily = rows("date date, row int, col int, VOD_QC int, tau double, LST double, rain double", [(*k, rng.choice([0, 0, 256, 3]), rng.random(), rng.random(), rng.random()) for k in seen])
    lai = rows("date date, row int, col int, LAI double", [(day(d), r, c, rng.random()) for d in (0, 8) for r in range(6) for c in range(7)])
    static = rows("row int, col int, Hveg double", [(r, c, rng.random()) for r in range(6) for c in range(7)])
    annual = rows("year int, row int, col int, GRA double, SAV double", [(2024, r, c, 0.5, 0.25) for r in range(6) for c in range(7)])
    dates = daily.select("date").distinct().where(f"date > DATE '{day(0)}'")

    def made(**how):
        table = product.daily_features(
            dates, daily.select("date", "row", "col", "VOD_QC", "tau"), lai, daily.select("date", "row", "col", "LST"), daily.select("date", "row", "col", "rain"),
            static, annual, bands=["tau"], **how,
        )
        return {(r.date, r.row, r.col): r for r in table.collect()}

    whole, sparse = made(rows=6, columns=7), made(observed=daily)
    keys = {k for k in seen if k[0] > day(0)}
    assert set(sparse) == keys and len(whole) == 3 * 42
    assert all(sparse[k] == whole[k] for k in keys)
    assert rasters.observed_cells(daily.limit(0), dates).collect() == []
