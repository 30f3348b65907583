"""Trailing windows over days and over observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_number
from . import scale

CHUNK_DAYS = 64


def _with_halo(df: DataFrame, reach: int, date: str) -> DataFrame:
    """Rows by time chunk; a row also goes to the next chunk when its windows reach back to it.

    A window partition then holds ``CHUNK_DAYS + reach`` days of one cell
    instead of its whole history.
    """
    numbered = df.withColumn("__day", day_number(date))
    chunk = F.floor(F.col("__day") / CHUNK_DAYS)
    ahead = F.floor((F.col("__day") + reach) / CHUNK_DAYS)
    return numbered.withColumn("__own", chunk).withColumn("__chunk", F.explode(F.sequence(chunk, ahead)))


def _chunk_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "__chunk").orderBy("__day")


def _drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("__chunk") == F.col("__own")).drop("__day", "__own", "__chunk")


def trailing_sum(
    df: DataFrame,
    value: str,
    days: int = 7,
    include_current: bool = True,
    keys: Sequence[str] = ("row", "col"),
    date: str = "date",
    out: str | None = None,
) -> DataFrame:
    """Sum and number of valid days over the trailing calendar days; NULL without a valid day."""
    out = out or f"{value}_{days}day"
    reach = days - 1 if include_current else days
    frame = _chunk_window(keys).rangeBetween(-reach, 0 if include_current else -1)
    summed = _with_halo(df, reach, date).withColumns(
        {out: F.sum(value).over(frame), f"{out}_valid_days": F.count(value).over(frame)}
    )
    return _drop_halo(summed)


def day_windows(
    df: DataFrame,
    columns: Sequence[str],
    days: int,
    keys: Sequence[str] = ("row", "col"),
    date: str = "date",
    full_only: bool = True,
    required: Sequence[str] = (),
) -> DataFrame:
    """Sequences over consecutive calendar days, one row per cell and day.

    ``full_only`` keeps rows whose window has every day. ``n_complete_days``
    counts the days on which all ``required`` columns are present.
    """
    reach = days - 1
    frame = _chunk_window(keys).rangeBetween(-reach, 0)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    made = _with_halo(df, reach, date).withColumns(
        {
            "dyn_seq": F.collect_list(step).over(frame),
            "n_window_days": F.count(F.lit(1)).over(frame),
            "n_complete_days": F.count(F.when(complete, 1)).over(frame),
        }
    )
    made = _drop_halo(made)
    return made.where(F.col("n_window_days") == days) if full_only else made


def _last_steps(df: DataFrame, part: Sequence[str], order: Sequence[str], columns: Sequence[str], steps: int) -> DataFrame:
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(steps - 1), 0)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn("dyn_seq", F.collect_list(step).over(frame))


def observation_windows(
    df: DataFrame,
    columns: Sequence[str],
    steps: int = 4,
    keys: Sequence[str] = ("site_key",),
    order: Sequence[str] = ("date", "sample_id"),
    large_groups: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Sequences over the last ``steps`` observations of a site, full windows only.

    Counts rows, not days: gaps are allowed. All other columns come from the
    last row. With ``large_groups`` sites are cut into ordered slices, and each
    slice receives the last ``steps - 1`` rows before it.
    """
    if large_groups:
        out = _sliced_steps(df, list(keys), list(order), columns, steps, slices)
    else:
        out = _last_steps(df, keys, order, columns, steps)
    return out.where(F.size("dyn_seq") == steps)


def _sliced_steps(df: DataFrame, keys: list[str], order: list[str], columns: Sequence[str], steps: int, slices: int | None) -> DataFrame:
    sliced = scale.ordered_slices(df, [*keys, *order], slices).drop(scale.PLACE)
    part = [*keys, scale.SLICE]
    backward = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    tails = sliced.withColumn("__back", F.row_number().over(backward)).where(F.col("__back") <= max(steps - 1, 1))
    # Per site: the last rows up to the end of each slice, from slice tails only.
    row = F.struct(*[F.col(c) for c in sliced.columns if c != scale.SLICE])
    along = Window.partitionBy(*keys).orderBy(scale.SLICE, *order).rowsBetween(-(steps - 2) if steps > 1 else 0, 0)
    ends = tails.withColumn("__carry", F.collect_list(row).over(along)).where(F.col("__back") == 1)
    following = F.lead(scale.SLICE).over(Window.partitionBy(*keys).orderBy(scale.SLICE))
    halo = (
        ends.withColumn("__next", following)
        .where(F.col("__next").isNotNull())
        .select(F.col("__next").alias(scale.SLICE), F.explode("__carry").alias("__row"))
        .select(scale.SLICE, "__row.*")
        .withColumn("__halo", F.lit(True))
    )
    if steps == 1:
        halo = halo.limit(0)
    both = sliced.withColumn("__halo", F.lit(False)).unionByName(halo)
    return _last_steps(both, part, order, columns, steps).where(~F.col("__halo")).drop("__halo", scale.SLICE)


def site_key(lat: str = "lat", lon: str = "lon"):
    """Site of a window: coordinates at six decimals."""
    return F.concat_ws("_", F.format_string("%.6f", F.col(lat)), F.format_string("%.6f", F.col(lon)))


def best_source_per_date(files: DataFrame, change_year: int = 2012, older: str = "A", newer: str = "B") -> DataFrame:
    """One source per date: the older sensor first before ``change_year``, the newer one from then on."""
    preferred = F.when(F.year("date") < change_year, F.lit(older)).otherwise(F.lit(newer))
    rank = F.when(F.col("sensor") == preferred, 0).otherwise(1)
    usable = files.where(F.col("sensor").isin(older, newer))
    return scale.first_per_group(usable, ["date"], [rank, F.col("sensor")])


def first_file_per_date(files: DataFrame, name: str = "file_name") -> DataFrame:
    return scale.first_per_group(files, ["date"], [F.col(name)])
