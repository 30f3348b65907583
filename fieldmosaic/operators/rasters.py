"""Long rasters: one row per valid cell, keyed (date, row, col) or (year, row, col)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names
from ..functions import cells, qcbits, values


def block_mean(df: DataFrame, bands: Sequence[str], factor: int = 2, keys: Sequence[str] = (), size: tuple[int, int] | None = None) -> DataFrame:
    """Down-sample by the mean of the valid cells of each factor x factor block.

    ``size`` (rows, columns) drops the odd trailing edge. A block without any
    valid cell has NULL.
    """
    if size is not None:
        rows, columns = (n // factor * factor for n in size)
        df = df.where((F.col("row") < rows) & (F.col("col") < columns))
    coarse = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    picked = df.select(*keys, *coarse, *bands)
    return picked.groupBy(*keys, "row", "col").agg(*[F.avg(b).alias(b) for b in bands])


def mosaic(df: DataFrame, bands: Sequence[str], tile: str = "tile", pixel: str = "pixel_no") -> DataFrame:
    """First tile in order wins per cell and band; within a tile the last pixel wins.

    Expects lat/lon of pixel centres; each band is filled on its own.
    """
    column = F.round((cells.wrap_longitude("lon") + F.lit(179.95)) / F.lit(names.CELL_DEG))
    row = F.round((F.lit(89.95) - F.col("lat")) / F.lit(names.CELL_DEG))
    placed = df.withColumns(
        {
            "row": values.clip(row, 0, names.GRID_ROWS - 1).cast("int"),
            "col": values.clip(column, 0, names.GRID_COLS - 1).cast("int"),
        }
    )
    rank = F.struct(F.col(tile), -F.col(pixel))
    picks = [F.min_by(F.col(b), F.when(F.col(b).isNotNull(), rank)).alias(b) for b in bands]
    return placed.groupBy("row", "col").agg(*picks)


def flag_counts(df: DataFrame, flag: str = "flag", keys: Sequence[str] = ()) -> DataFrame:
    """Count and share per quality flag; the share window sees one row per flag."""
    counted = df.groupBy(*keys, flag).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("ratio", F.col("n") / whole)


def band_statistics(df: DataFrame, band: str, flag: Column, keep: Sequence[int] = (0,)) -> DataFrame:
    """Valid share of all cells and min/max/mean over the valid ones."""
    ok = flag.isin(list(keep)) & F.col(band).isNotNull()
    valid = F.when(ok, F.col(band))
    return df.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count(valid).alias("n_valid"),
        F.try_divide(F.count(valid), F.count(F.lit(1))).alias("valid_ratio"),
        F.min(valid).alias("min_value"),
        F.max(valid).alias("max_value"),
        F.avg(valid).alias("mean_value"),
    )


def missing_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: share of NULLs. One pass, then a one-row unpivot."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "missing_ratio")


def _strips(dates: DataFrame, rows: int) -> DataFrame:
    """Every grid row of every date, spread over the executors.

    The number of partitions is given because the strips themselves are tiny
    and would otherwise be coalesced into one task before they are expanded.
    """
    strips = dates.select("date").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    count = int(dates.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return strips.repartition(count, F.col("date"), F.col("row"))


def scaffold(dates: DataFrame, rows: int = names.GRID_ROWS, columns: int = names.GRID_COLS, cell_deg: float = names.CELL_DEG) -> DataFrame:
    """Every grid cell of every date with centre coordinates.

    The cells of a date are generated row by row on the executors: the date
    list is expanded to grid rows, these are spread, then expanded to cells.
    """
    grid = _strips(dates, rows).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return grid.select(
        "date",
        F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"),
        *_centre(cell_deg),
    )


def _centre(cell_deg: float) -> list[Column]:
    return [
        (F.lit(90.0) - (F.col("row") + 0.5) * F.lit(cell_deg)).alias("lat"),
        (F.lit(-180.0) + (F.col("col") + 0.5) * F.lit(cell_deg)).alias("lon"),
    ]


def cells_on_days(cells: DataFrame, brackets: DataFrame, cell_deg: float = names.CELL_DEG) -> DataFrame:
    """Every cell on every day of ``align.bracketing_days``, with ``__start`` and ``__weight`` of its composite.

    The days are collected, one row per day of the calendar, and written into the plan: the cells
    keep their distribution, which a join by date would lose.
    """
    days = brackets.select("date", "prev_date", "weight").collect()
    listed = [F.struct(F.lit(d).alias("date"), F.lit(start).cast("date").alias("__start"), F.lit(weight).cast("double").alias("__weight")) for d, start, weight in days]
    none = F.array().cast("array<struct<date:date,__start:date,__weight:double>>")
    return cells.select("row", "col", F.inline(F.array(*listed) if listed else none)).select("date", "row", "col", *_centre(cell_deg), "__start", "__weight")


def observed_cells(observed: DataFrame, dates: DataFrame, cell_deg: float = names.CELL_DEG) -> DataFrame:
    """The distinct cells of some rows on the given dates, with centre coordinates: a sparse ``scaffold``."""
    kept = observed.select("date", "row", "col").distinct().join(dates.select("date").distinct(), ["date"], "left_semi")
    return kept.select("date", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *_centre(cell_deg))


def to_full_grid(
    dates: DataFrame, predictions: DataFrame, value: str = "lfmc_pred", rows: int = names.GRID_ROWS, columns: int = names.GRID_COLS
) -> DataFrame:
    """Predictions on every cell of their dates, NULL where there is none.

    Cells are not joined one by one: a grid row of a day is joined with the columns that have a
    prediction, at most as many as the grid has, and expanded to the others, so no task sorts cells.
    """
    row, column = (F.col(c).try_cast("int") for c in ("row", "col"))
    inside = (row == F.col("row")) & row.between(0, rows - 1) & (column == F.col("col")) & column.between(0, columns - 1)
    found = predictions.where(inside).select("date", row.alias("row"), column.alias("col"), value)
    seen = found.groupBy("date", "row").agg(F.collect_set("col").alias("__seen"))
    every = F.sequence(F.lit(0), F.lit(columns - 1))
    left_over = F.when(F.col("__seen").isNull(), every).otherwise(F.array_except(every, "__seen"))
    empty = _strips(dates, rows).join(seen, ["date", "row"], "left").select("date", "row", F.explode(left_over).alias("col"))
    nothing = F.lit(None).cast(found.schema[value].dataType).alias(value)
    return dates.select("date").join(found, "date").select("date", "row", "col", value).unionAll(empty.select("date", "row", "col", nothing))


def predictor_valid(row: str = "row", column: str = "col") -> Column:
    return cells.in_grid(row, column).cast("int")


def valid_for_inference(bands: Sequence[str] = tuple(names.BANDS), lai: str = "LAI", lst: str = "LST") -> Column:
    usable = values.any_present([*bands, lai, lst])
    return (cells.in_grid("row", "col") & usable).cast("int")


def masked_bands(df: DataFrame, bands: Sequence[str], qc: str = "qc_raw", keep: Sequence[int] = (0,), any_band_missing_is_fill: bool = False) -> DataFrame:
    """Bands kept only where the priority flag is in ``keep``; adds the flag."""
    flag = qcbits.priority_flag(qc, bands, any_band_missing_is_fill)
    flagged = df.withColumn("vod_qc", flag)
    return flagged.withColumns({b: F.when(F.col("vod_qc").isin(list(keep)), F.col(b)) for b in bands})
