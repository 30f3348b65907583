"""Daily whole-grid feature tables, masks and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import landcover, qcbits, values
from ..operators import align, modeling, rasters, windows
from .frames import aligned_for_scoring, season_terms


def daily_features(
    dates: DataFrame,
    daily: DataFrame,
    lai: DataFrame,
    lst: DataFrame,
    rain: DataFrame,
    static: DataFrame,
    annual: DataFrame,
    bands: Sequence[str] = tuple(names.BANDS),
    qc: str = "VOD_QC",
    observed: DataFrame | None = None,
    cells: DataFrame | None = None,
    segments: DataFrame | None = None,
    **grid,
) -> DataFrame:
    """Every cell of every date with all predictors and validity flags.

    With ``observed(date, row, col)`` only those cells are built: about one cell in
    twenty has data on a day, and a mask that needs a daily value drops the others anyway.

    With ``cells(row, col)`` and ``segments`` (``align.composite_segments`` of ``lai``), both and the other tables
    written by ``bucketed.write_bucketed``, no join shuffles the cells of the days.

    Date is a key like row and column, so a year of days is one job. The rain
    total is computed on the rain table, which holds only valid cells, before
    it meets the full grid.
    """
    masked = daily.select("date", "row", "col", qc, *[c for c in daily.columns if c in ("SM",)], *qcbits.mask_by_raw_zero(bands, qc))
    keys = ["date", "row", "col"]
    if cells is not None:
        asked_days = dates.select("date").distinct().join(align.bracketing_days(dates, lai), ["date"], "left")
        base = rasters.cells_on_days(cells, asked_days)
    else:
        base = rasters.scaffold(dates, **grid) if observed is None else rasters.observed_cells(observed, dates)
    today = rain.select(*keys, "rain")
    asked = rain_rows(dates, today)
    totals = windows.trailing_sum(asked, "rain", 7, out="rain_7day")
    # By cell first: the joins that follow add a day or a year to that key and keep its distribution.
    out = align.static_values(base, static)
    out = align.annual_values(out.withColumn("year", F.year("date")), annual).drop("year")
    out = out.join(masked, keys, "left").join(lst, keys, "left").join(totals, keys, "left")
    out = out.withColumn("rain_7day_valid_days", F.coalesce("rain_7day_valid_days", F.lit(0)))
    if cells is None:
        out = align.interpolated_values(out, lai, "LAI", segments)
    else:
        out = align.between_composites(out, align.composite_segments(lai, "LAI") if segments is None else segments, "LAI")
    present = {c: F.expr(values.finite_text(c)) if c in out.columns else F.lit(None).cast("double") for c in [*names.VEGETATION_CLASSES, *names.NONVEGETATION_CLASSES]}
    out = out.withColumns(present).withColumns(landcover.merged_groups()).withColumns(landcover.merged_dominant())
    return out.withColumns(
        {
            **season_terms(),
            "predictor_valid": rasters.predictor_valid(),
            "valid_for_inference": rasters.valid_for_inference(bands),
        }
    )


def rain_rows(dates: DataFrame, rain: DataFrame, days: int = 7) -> DataFrame:
    """Rain rows of the days the totals reach back to, plus a row without rain for
    each target date a cell may need although it has no value that day."""
    reached = align.date_targets(dates, days)
    used = rain.join(reached, ["date"], "left_semi")
    gaps = align.stack_days(rain, dates, days).select(F.col("target_date").alias("date"), "row", "col")
    both = used.unionByName(gaps.withColumn("rain", F.lit(None).cast("double")))
    return both.groupBy("date", "row", "col").agg(F.max("rain").alias("rain"))


def inference_mask(numeric: Sequence[str], category: str = "lc_dom", nonveg_max: float = names.NONVEG_INFERENCE_MAX, bands: Sequence[str] = tuple(names.BANDS), columns: Sequence[str] = ()) -> Column:
    """Valid cell, not mostly bare or built-up, all non-band features and the class present.

    A missing non-vegetation share passes.
    """
    mask = F.coalesce(F.col("valid_for_inference") == 1, F.lit(False))
    if not columns or "nonveg_frac" in columns:
        mask = mask & ~F.coalesce(F.col("nonveg_frac") > nonveg_max, F.lit(False))
    strict = [c for c in numeric if c not in bands]
    if strict:
        mask = mask & values.all_present(strict)
    return mask & F.col(category).isNotNull()


def temporal_mask(days: int, static: Sequence[str], category: str = "lc_dom", qc: str = "VOD_QC", nonveg_max: float = names.NONVEG_INFERENCE_MAX) -> Column:
    """Mask of the windowed product: good quality on the target day and the non-band
    dynamics present on every day of the window (``n_complete_days``)."""
    base = F.coalesce(F.col("valid_for_inference") == 1, F.lit(False))
    base = base & ~F.coalesce(F.col("nonveg_frac") > nonveg_max, F.lit(False))
    base = base & F.coalesce(F.col(qc) == 0, F.lit(False)) & F.col(category).isNotNull()
    return base & values.all_present(static) & (F.col("n_window_days") == days) & (F.col("n_complete_days") == days)


def predict_days(model: PipelineModel, features: DataFrame, numeric: Sequence[str], category: str = "lc_dom") -> DataFrame:
    """Predictions on the masked cells of any number of days."""
    ready = aligned_for_scoring(features, None)
    return modeling.score(model, ready, inference_mask(numeric, category))
