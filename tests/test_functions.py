from __future__ import annotations

import cmath
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.functions import calendar, cells, landcover, microwave, qcbits, values


def one(df):
    return [tuple(r) for r in df.collect()]


def test_number_text(rows):
    df = rows("t string", [("1.5",), (" 2 ",), ("-3e2",), (".5",), ("n/a",), ("",), (None,), ("NaN",), ("Infinity",), ("1d",), ("1e999",)])
    assert [r[0] for r in one(df.select(values.to_number("t")))] == [1.5, 2.0, -300.0, 0.5] + [None] * 7


def test_nan_and_infinity_become_null(rows):
    df = rows("v double", [(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,), (None,)])
    assert [r[0] for r in one(df.select(values.finite("v")))] == [None, None, None, 2.0, None]


def test_clip_keeps_null(rows):
    df = rows("v double", [(-1.0,), (0.5,), (2.0,), (None,)])
    assert [r[0] for r in one(df.select(values.clip(F.col("v"), 0, 1)))] == [0.0, 0.5, 1.0, None]


def test_days(rows):
    df = rows("t string", [("20240131",), ("20240131.0",), ("2024-01-31",), ("2024-01-31 10:00:00",), ("2024/01/31",), ("20241331",), ("bad",), (None,), ("123",)])
    assert [r[0] for r in one(df.select(calendar.parse_day("t")))] == [dt.date(2024, 1, 31)] * 5 + [None] * 4


def test_clock(rows):
    df = rows("t string", [("0930",), ("930",), ("09:30",), ("9:30",), ("09:30:15",), ("25:00",), ("12:61",), ("noon",), (None,)])
    got = [r[0] for r in one(df.select(calendar.clock_seconds("t")))]
    assert got == [34200, 34200, 34200, 34200, 34215, None, None, None, None]


def test_moment_without_clock_keeps_the_day(rows):
    df = rows("d date, t string", [(dt.date(2024, 1, 1), "1200"), (dt.date(2024, 1, 1), None), (None, "1200")])
    got = [r[0] for r in one(df.select(calendar.sampling_moment("d", "t")))]
    assert got == [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1), None]


def test_eight_day_windows(rows):
    days = [(2002, 1, 1), (2002, 1, 2), (2002, 1, 8), (2002, 1, 9), (2002, 12, 31), (2004, 12, 31)]
    want = [(2002, 1, 1), (2002, 1, 1), (2002, 1, 1), (2002, 1, 9), (2002, 12, 27), (2004, 12, 26)]
    df = rows("d date", [(dt.date(*d),) for d in days])
    assert [r[0] for r in one(df.select(calendar.eight_day_start("d")))] == [dt.date(*d) for d in want]


def test_file_names(rows):
    df = rows("n string", [("GLASS.A2020061.hdf",), ("20200301.h5",), ("MOD11C1_2020061_x.h5",), ("2020400.h5",), ("none",)])
    assert [r[0] for r in one(df.select(calendar.file_name_day("n")))] == [dt.date(2020, 3, 1)] * 3 + [None] * 2


def test_cells(rows):
    points = [(89.95, -179.95), (-89.95, 179.95), (90.0, 180.0), (-90.0, -180.0), (12.34, -0.05)]
    df = rows("lat double, lon double", points)
    near = one(df.select(cells.nearest_row("lat"), cells.nearest_col("lon")))
    assert near[0] == (0, 0) and near[1] == (1799, 3599) and near[2] == (0, 0) and near[3] == (1799, 0)
    floors = one(df.select(*cells.floor_cell("lat", "lon")))
    assert floors[0] == (0, 0) and floors[2] == (-1, -1) and floors[3] == (-1, -1)
    assert one(df.select(*cells.aligned_cell("lat", "lon")))[1] == (1799, 3599)


def test_center_round_trip(rows):
    df = rows("row int, col int", [(0, 0), (1799, 3599), (899, 1800), (900, 1799)])
    placed = df.withColumns({"lat": cells.center_lat("row"), "lon": cells.center_lon("col")})
    back = placed.select("row", "col", *[c.alias(n) for n, c in zip("ab", cells.aligned_cell("lat", "lon"))])
    assert all((r.row, r.col) == (r.a, r.b) for r in back.collect())
    near = placed.select("row", "col", cells.nearest_row("lat").alias("a"), cells.nearest_col("lon").alias("b"))
    assert all((r.row, r.col) == (r.a, r.b) for r in near.collect())


def test_site_hash_of_missing_parts(rows):
    df = rows("n string, lat double, lon double", [("a", 1.0, 2.0), ("a", 1.00001, 2.0), (None, 1.0, 2.0), ("a", None, 2.0)])
    ids = [r[0] for r in one(df.select(cells.site_hash("n", "lat", "lon")))]
    assert ids[0] == ids[1] and len(set(ids)) == 3 and all(len(i) == 12 for i in ids)


@pytest.mark.parametrize(
    "qc, band, joint, single",
    [(0, 1.0, 0, 0), (1, 1.0, 1, 1), (2, 1.0, 2, 2), (3, 1.0, 2, 2), (4, 1.0, 3, 3), (8, 1.0, 4, 4), (12, 1.0, 0, 0), (16, 1.0, 5, 5),
     (17, 1.0, 5, 5), (32, 1.0, 0, 0), (255, 1.0, 6, 6), (256, 1.0, 0, 0), (271, 1.0, 2, 2), (0, None, 6, 0), (None, 1.0, None, None)],
)
def test_quality_flag(rows, qc, band, joint, single):
    df = rows("qc int, band double", [(qc, band)])
    assert one(df.select(qcbits.priority_flag("qc", ["band"], True), qcbits.priority_flag("qc", ["band"]))) == [(joint, single)]


def test_raw_repair_limits(rows):
    df = rows("v double", [(0.0,), (7500.0,), (65535.0,), (7499.0,), (None,)])
    assert [r[0] for r in one(df.select(F.round(values.repair_raw("v", "lst"), 6)))] == [None, 150.0, 1310.7, None, None]


def test_fractions(rows):
    schema = ", ".join(f"{c} double" for c in "abc")
    df = rows(schema, [(1.0, 0.0, 0.0), (0.4, 0.4, 0.0), (0.0, 0.0, 0.0), (None, None, None), (-1.0, 2.0, 2.0)])
    got = one(df.select(landcover.dominant_class(["a", "b", "c"]), landcover.dominant_class(["a", "b", "c"], legacy_first_class=True),
                        landcover.dominant_share(["a", "b", "c"]), F.round(landcover.entropy(["a", "b", "c"]), 9)))
    assert got == [("a", "a", 1.0, 0.0), ("a", "a", 0.5, round(math.log(2), 9)), (None, "a", None, 0.0), (None, "a", None, 0.0), ("b", "b", 0.5, round(math.log(2), 9))]


def test_weight_bounds(rows):
    df = rows("p double", [(None,), (0.0,), (0.5,), (1.0,), (7.0,), (-1.0,)])
    assert [r[0] for r in one(df.select(landcover.purity_weight("p")))] == [0.2, 0.2, 0.25, 1.0, 1.0, 0.2]


def test_merged_groups_of_missing_classes(rows):
    classes = names.VEGETATION_CLASSES + names.NONVEGETATION_CLASSES
    df = rows(", ".join(f"{c} double" for c in classes), [tuple([None] * len(classes)), tuple(0.5 if c == "BAR" else None for c in classes)])
    made = df.withColumns(landcover.merged_groups()).withColumns(landcover.merged_dominant())
    assert one(made.select("NonVeg", "lc_dom", "lc_dom_frac", "nonveg_skip")) == [(None, "Unknown", None, 0), (0.5, "NonVeg", 0.5, 1)]


def forward(lfmc, cover, height, hz):
    """The chain with Python complex numbers."""
    f, m = hz / 1e9, lfmc / (lfmc + 100)
    free = 4.9 + 75 / (1 + 1j * f / 18)
    bound = 2.9 + 55 / (1 + (1j * f / 0.18) ** 0.5)
    eps = 1.7 - 0.74 * m + 6.16 * m * m + max(m * (0.55 * m - 0.076), 0) * free + 4.64 * m * m / (1 + 7.36 * m * m) * bound
    can = (1 + cover * (eps ** (1 / 3) - 1)) ** 3
    return 4 * math.pi * height / (names.LIGHT_SPEED / hz) * -cmath.sqrt(can).imag


def test_forward_chain_matches_complex_numbers(rows):
    cases = [(80.0, 0.3, 5.0, "C"), (120.0, 0.9, 20.0, "Ku"), (10.0, 0.0, 1.0, "X"), (300.0, 1.0, 2.0, "X")]
    df = rows("lfmc double, cover double, height double, band string", cases)
    got = [r[0] for r in one(microwave.with_forward_depth(df, "lfmc", "cover", "height", "band").select("vod_base"))]
    for value, (lfmc, cover, height, band) in zip(got, cases):
        assert value == pytest.approx(forward(lfmc, cover, height, names.BAND_HZ[band]), rel=1e-9, abs=1e-12)


def test_forward_chain_of_missing_inputs(rows):
    df = rows("lfmc double, cover double, height double, band string", [(None, 0.3, 5.0, "C"), (80.0, 1.5, 5.0, "C"), (80.0, 0.3, None, "C"), (80.0, 0.3, 5.0, "L")])
    assert [r[0] for r in one(microwave.with_forward_depth(df, "lfmc", "cover", "height", "band").select("vod_base"))] == [None] * 4


def test_moisture_round_trip(rows):
    df = rows("v double", [(0.0,), (50.0,), (399.0,), (-20.0,), (None,)])
    got = [r[0] for r in one(df.select(F.round(microwave.moisture_percent(microwave.gravimetric_moisture("v")), 6)))]
    assert got == [0.0, 50.0, 399.0, 0.0, None]
