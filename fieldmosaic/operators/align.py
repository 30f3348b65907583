"""Pick up raster values for samples: exact, windowed, as-of and interpolated.

Raster tables hold one row per key, so every lookup is a left equi-join that
cannot multiply rows. As-of rules are resolved on the *dimension* (distinct days
or years, bounded by the calendar) and only then joined by equality. No size is
assumed for either side: Spark broadcasts a side only below its own size limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from .rasters import masked_bands

CELL = ["row", "col"]


def _prefixed(grid: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    picked = [c for c in (columns or grid.columns) if c not in keys]
    return grid.select(*keys, *picked)


def daily_values(samples: DataFrame, grid: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values of the sample's own day and cell; an absent day or cell gives NULL.

    On a table partitioned by date the join key prunes partitions dynamically.
    """
    keys = ["date", *CELL]
    return samples.join(_prefixed(grid, keys, columns), keys, "left")


def static_values(samples: DataFrame, grid: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return samples.join(_prefixed(grid, CELL, columns), CELL, "left")


def eight_day_values(samples: DataFrame, grid: DataFrame, value: str, index_out: str | None = None) -> DataFrame:
    """Value of the 8-day window that holds the sample day.

    ``<value>_index_date`` is set only when that window exists at all, also if
    the cell itself has no value in it.
    """
    index_out = index_out or f"{value}_index_date"
    windows = grid.select(F.col("index_date").alias(index_out)).distinct()
    values_of = grid.select(F.col("index_date").alias("__start"), *CELL, value)
    started = samples.withColumn("__start", calendar.eight_day_start("date"))
    found = started.join(values_of, ["__start", *CELL], "left")
    return found.join(windows, found["__start"] == windows[index_out], "left").drop("__start")


def annual_values(samples: DataFrame, grid: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    keys = ["year", *CELL]
    return samples.join(_prefixed(grid, keys, columns), keys, "left")


def previous_on_dimension(targets: DataFrame, available: DataFrame, key: str, out: str) -> DataFrame:
    """For each distinct target: the greatest available value <= it, else the smallest available.

    Both inputs are dimensions: distinct days (some 366 a year) or years. The
    window runs over their union, so its single task holds a calendar at most.
    """
    stops = available.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("__stop", F.col(key))
    asked = targets.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    both = asked.withColumn("__stop", F.lit(None).cast(stops.schema["__stop"].dataType)).unionByName(stops)
    axis = both.groupBy(key).agg(F.max("__stop").alias("__stop"))
    backward = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return axis.select(
        key,
        F.coalesce(F.last("__stop", True).over(backward), F.min("__stop").over(everything)).alias(out),
    ).join(asked, [key], "left_semi")


def as_of_year(samples: DataFrame, grid: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Annual values of the latest year not after the sample's, else of the first year."""
    choice = previous_on_dimension(samples, grid, "year", "year_used")
    picked = _prefixed(grid, ["year", *CELL], columns).withColumnRenamed("year", "year_used")
    return samples.join(choice, ["year"], "left").join(picked, ["year_used", *CELL], "left")


def as_of_date(samples: DataFrame, grid: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values of the latest grid day not after the sample day, else of the earliest grid day."""
    choice = previous_on_dimension(samples, grid, "date", "date_used")
    picked = _prefixed(grid, ["date", *CELL], columns).withColumnRenamed("date", "date_used")
    return samples.join(choice, ["date"], "left").join(picked, ["date_used", *CELL], "left")


def bracketing_days(targets: DataFrame, available: DataFrame) -> DataFrame:
    """Per distinct target day: enclosing grid days and linear weight of the later one.

    A day that exists is its own bracket with weight 0. Days before the first
    or after the last grid day have no bracket.
    """
    stops = available.select("date").where(F.col("date").isNotNull()).distinct().withColumn("__stop", F.col("date"))
    asked = targets.select("date").where(F.col("date").isNotNull()).distinct()
    both = asked.withColumn("__stop", F.lit(None).cast("date")).unionByName(stops)
    axis = both.groupBy("date").agg(F.max("__stop").alias("__stop"))
    backward = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    forward = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    bracket = axis.withColumns(
        {
            "prev_date": F.last("__stop", True).over(backward),
            "next_date": F.first("__stop", True).over(forward),
        }
    )
    span = F.datediff("next_date", "prev_date")
    weight = F.when(span == 0, F.lit(0.0)).otherwise(F.datediff("date", "prev_date") / span)
    kept = bracket.withColumn("weight", weight).where(F.col("prev_date").isNotNull() & F.col("next_date").isNotNull())
    return kept.drop("__stop").join(asked, ["date"], "left_semi")


def composite_segments(grid: DataFrame, value: str) -> DataFrame:
    """``(start_date, row, col, low, high)``: per cell one row for each composite and the one that follows it.

    ``high`` is NULL where the cell has no row in the next composite of the table, or there is none.
    One shuffle by cell; written once, distributed by cell, it serves any number of days.
    """
    days = grid.select("date").distinct()
    # one row per composite of the calendar
    following = days.withColumn("__next", F.lead("date").over(Window.orderBy("date")))
    cell = Window.partitionBy(*CELL).orderBy("date")
    paired = grid.select("date", *CELL, F.col(value).alias("low")).withColumns(
        {"__then": F.lead("date").over(cell), "__high": F.lead("low").over(cell)}
    )
    placed = paired.join(following, ["date"], "left")
    return placed.select(F.col("date").alias("start_date"), *CELL, "low", F.when(F.col("__then") == F.col("__next"), F.col("__high")).alias("high"))


def interpolated_values(samples: DataFrame, grid: DataFrame, value: str, segments: DataFrame | None = None) -> DataFrame:
    """Value on the exact day, else linear between the enclosing days.

    NULL when a side or an endpoint is missing. ``grid`` has one row per day and cell. The values of
    both sides come by one join with the segments of ``grid``, which may have been written before.
    """
    bracket = bracketing_days(samples, grid).select("date", F.col("prev_date").alias("__start"), F.col("weight").alias("__weight"))
    pairs = composite_segments(grid, value) if segments is None else segments
    return between_composites(samples.join(bracket, ["date"], "left"), pairs, value)


def between_composites(samples: DataFrame, segments: DataFrame, value: str) -> DataFrame:
    """Interpolated values of rows that know their segment's ``__start`` and the ``__weight`` of its end; both are dropped."""
    pairs = segments.select(F.col("start_date").alias("__start"), *CELL, F.col("low").alias("__low"), F.col("high").alias("__high"))
    blended = F.col("__low") * (F.lit(1.0) - F.col("__weight")) + F.col("__high") * F.col("__weight")
    joined = samples.join(pairs, ["__start", *CELL], "left")
    found = joined.withColumn(value, F.when(F.col("__weight") == 0, F.col("__low")).otherwise(blended))
    return found.drop("__start", "__weight", "__low", "__high")


def preferred_by_date(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of the first source, and the second source's rows of the days the first lacks.

    The choice is per day, as whole files, not per cell.
    """
    days = first.select("date").distinct()
    return first.unionByName(second.join(days, ["date"], "left_anti"))


def reattach_attributes(df: DataFrame, attributes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join to the distinct attribute rows; can multiply rows when keys are ambiguous.

    Prefer carrying the attribute columns along from the start.
    """
    return df.join(attributes.select(*keys, *columns).distinct(), list(keys), "left")


def all_auxiliaries(
    samples: DataFrame,
    static: DataFrame,
    annual: DataFrame,
    daily: DataFrame,
    eight_day: dict[str, DataFrame],
) -> DataFrame:
    """Static, as-of annual, daily and 8-day values of each sample in one plan."""
    out = static_values(samples, static)
    out = as_of_year(out.withColumn("year", F.year("date")), annual)
    out = daily_values(out, daily)
    for value, grid in eight_day.items():
        out = eight_day_values(out, grid, value)
    return out


def date_targets(targets: DataFrame, window: int) -> DataFrame:
    """(date, target_date, step): every day a target day's window reaches back to."""
    steps = targets.select(F.col("date").alias("target_date")).distinct()
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    return steps.withColumn("date", F.date_add("target_date", F.col("step") - F.lit(window - 1)))


def stack_days(daily: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """For each target day the cell rows of the last ``window`` days, with their step 0..window-1.

    The day list is expanded, not the cells, so this is one equi-join on date.
    """
    return daily.join(date_targets(targets, window), ["date"], "inner")


def mean_of_two(a: DataFrame, b: DataFrame, value: str = "lfmc_pred") -> DataFrame:
    """Aligned mean of two prediction grids that skips a missing side."""
    keys = ["date", *CELL]
    left = a.select(*keys, F.col(value).alias("__a"))
    right = b.select(*keys, F.col(value).alias("__b"))
    both = left.join(right, keys, "full_outer")
    mean = F.coalesce((F.col("__a") + F.col("__b")) / 2.0, F.col("__a"), F.col("__b"))
    return both.select(*keys, mean.alias(value))


def masked_daily_values(samples: DataFrame, grid: DataFrame, bands: Sequence[str], qc: str = "qc_raw", keep: Sequence[int] = (0,)) -> DataFrame:
    """Daily lookup with the quality mask applied below the join."""
    masked = masked_bands(grid, bands, qc, keep).select("date", *CELL, *bands, "vod_qc")
    return daily_values(samples, masked)
