"""Samples with all gridded predictors: one plan of left equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import align


def place_on_grid(grid_days: DataFrame, check: bool = False) -> DataFrame:
    """Row and column of cell-centre coordinates; ``check`` fails on a row outside the grid."""
    row, column = cells.aligned_cell("grid_lat", "grid_lon")
    placed = grid_days.drop("row", "col").withColumns({"row": row, "col": column})
    if check and not placed.where(~cells.in_grid("row", "col")).isEmpty():
        raise ValueError("coordinates outside the grid")
    return placed.withColumns({"grid_lat": cells.center_lat("row"), "grid_lon": cells.center_lon("col")})


def align_all(
    samples: DataFrame,
    daily_bands: DataFrame,
    bands: Sequence[str],
    static: DataFrame,
    annual: DataFrame,
    other_daily: Sequence[DataFrame] = (),
    eight_day: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Masked bands, further daily grids, static, 8-day and same-year annual values.

    The join by cell comes first: all others add a day or a year to that key, so
    the samples are shuffled once where a session lets joins keep a coarser distribution.
    """
    out = align.static_values(samples, static)
    out = align.masked_daily_values(out, daily_bands, bands)
    for grid in other_daily:
        out = align.daily_values(out, grid)
    for value, grid in (eight_day or {}).items():
        out = align.eight_day_values(out, grid, value)
    return align.annual_values(out.withColumn("year", F.year("date")), annual)
