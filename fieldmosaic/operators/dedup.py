"""Samples to site-day and grid-day grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import cells, landcover
from ..sources.tables import require_columns
from . import scale

DESCRIPTORS = ["site_name", "source", "protocol", "species", "individual_or_mean"]


def _tie_order(df: DataFrame, tie: Sequence[str]) -> list[Column]:
    order = [c for c in ("sampling_datetime", *tie) if c in df.columns]
    return [F.col(c) for c in order]


def _value_aggregate(strategy: str, order: list[Column]) -> tuple[dict, list[Column]]:
    """The quantile part and the plain part of the moisture reducer."""
    if strategy == "median":
        return {"lfmc_pct": ("lfmc_pct", 0.5)}, []
    if strategy == "mean":
        return {}, [F.avg("lfmc_pct").alias("lfmc_pct")]
    if strategy == "last":
        if not order:
            raise ValueError("strategy 'last' needs sampling_datetime or a tie column")
        return {}, [F.max_by("lfmc_pct", F.struct(*order)).alias("lfmc_pct")]
    raise ValueError(f"unknown strategy: {strategy}")


def first_present(column: str, order: Sequence[Column]) -> Column:
    """First non-NULL value in an explicit order."""
    key = F.struct(*order)
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), key)).alias(column)


def site_day(
    df: DataFrame,
    strategy: str = "median",
    by_vegetation: bool = True,
    vegetation_column: str | None = None,
    by_location: bool = False,
    precision: float = names.LOCATION_PRECISION,
    land_cover_column: str | None = None,
    tie: Sequence[str] = ("sorting_id",),
    large_groups: bool = False,
) -> DataFrame:
    """One row per site (or quantised location), day and vegetation kind.

    Medians, counts, descriptors, the most frequent site id and land cover come
    from a single aggregation. With ``large_groups`` the same values come from
    ordered slices and pre-counted values.
    """
    require_columns(df, ["date", "lfmc_pct", "lat", "lon", *([] if by_location else ["site_id"])])
    work = df.dropna(subset=["date", "lfmc_pct", "lat", "lon"])
    if by_vegetation:
        source = vegetation_column or next((c for c in ("species_functional_type", "functional_type") if c in df.columns), None)
        kind = landcover.vegetation_kind(source) if source else F.lit("Unknown")
    else:
        kind = F.lit("All")
    work = work.withColumn("veg_type", kind)
    if by_location:
        work = work.withColumn("site_loc_id", cells.location_key("lat", "lon", precision))
    keys = ["site_loc_id" if by_location else "site_id", "date"] + (["veg_type"] if by_vegetation else [])
    order = _tie_order(work, tie)
    quantiles, plain = _value_aggregate(strategy, order)
    quantiles.update({"lat": ("lat", 0.5), "lon": ("lon", 0.5)})
    plain.append(F.count(F.lit(1)).alias("n_obs"))
    if order:
        plain += [first_present(c, order) for c in DESCRIPTORS if c in work.columns]
    modes = []
    if land_cover_column:
        modes.append((land_cover_column, "igbp_500m", "igbp_500m_nunique"))
    if by_location and "site_id" in work.columns:
        modes.append(("site_id", "site_id", "site_id_nunique"))

    if large_groups:
        out = scale.large_group_quantiles(work, keys, quantiles, plain)
        for column, name, distinct_out in modes:
            out = scale.match_on(out, scale.smallest_mode(work, keys, column, name, distinct_out), keys, "left")
            out = out.fillna(0, subset=[distinct_out])
    else:
        compact = [F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in quantiles.items()]
        for column, name, distinct_out in modes:
            compact.append(F.mode(column, True).alias(name))
            compact.append(F.size(F.collect_set(column)).cast("bigint").alias(distinct_out))
        out = work.groupBy(*keys).agg(*compact, *plain)
    unknown = (F.col("veg_type") == "Unknown").cast("int") if by_vegetation else F.lit(0)
    return out.withColumn("veg_type_unknown_flag", unknown)


def to_grid(df: DataFrame) -> DataFrame:
    """Nearest cell of each point: row, col and centre coordinates."""
    placed = df.withColumns({"row": cells.nearest_row("lat"), "col": cells.nearest_col("lon")})
    return placed.withColumns({"grid_lat": cells.center_lat("row"), "grid_lon": cells.center_lon("col")})


def point_with_cell(site_days: DataFrame) -> DataFrame:
    """Scheme A: point values kept, plus the cell and the number of points in the cell-day."""
    keys = ["date", "row", "col"] + (["veg_type"] if "veg_type" in site_days.columns else [])
    return scale.group_size(to_grid(site_days), keys, "n_site_samples_in_pixel_day")


def grid_day(
    site_days: DataFrame,
    strategy: str = "mean",
    keep: Sequence[str] = ("source",),
    tie: Sequence[str] = ("site_loc_id", "site_id"),
    large_groups: bool = False,
) -> DataFrame:
    """Scheme B: one row per cell, day and vegetation kind, from one aggregation."""
    work = site_days if "veg_type" in site_days.columns else site_days.withColumn("veg_type", F.lit("All"))
    work = to_grid(work.dropna(subset=["date", "lat", "lon", "lfmc_pct", "veg_type"]))
    keys = ["date", "row", "col", "grid_lat", "grid_lon", "veg_type"]
    order = _tie_order(work, tie)
    quantiles, plain = _value_aggregate(strategy, order)
    n_rows = F.count(F.lit(1))
    plain += [
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n_obs_sum") if "n_obs" in work.columns else n_rows.alias("n_obs_sum"),
        n_rows.alias("n_records"),
    ]
    sites = F.count_distinct("site_id") if "site_id" in work.columns else n_rows
    plain.append(sites.alias("n_sites"))
    plain += [first_present(c, order) for c in keep if c in work.columns and order]
    if quantiles:
        return scale.group_quantiles(work, keys, quantiles, plain, large_groups)
    return work.groupBy(*keys).agg(*plain)


def combined_kind(df: DataFrame, keys: Sequence[str], functional_type: str, out: str = "FT") -> DataFrame:
    """Tree, Shrub or Herb when all members of a cell agree on it, else Mix."""
    kind = landcover.cell_kind(functional_type)
    agreed = (F.min(kind) == F.max(kind)) & (F.count(kind) == F.count(F.lit(1)))
    return df.groupBy(*keys).agg(F.when(agreed, F.min(kind)).otherwise("Mix").alias(out))
