"""Raw samples to site-day and grid-day tables and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..operators import cleaning, dedup


@dataclass(frozen=True)
class CleaningOptions:
    site_strategy: str = "median"
    grid_strategy: str = "mean"
    by_location: bool = True
    precision: float = names.LOCATION_PRECISION
    land_cover_column: str | None = "IGBP Land Cover"
    low: float = names.VALUE_MIN
    high: float = names.VALUE_MAX
    drop_isolated: bool = False
    drop_suspect: bool = False
    drop_dead: bool = True


@dataclass(frozen=True)
class CleaningResult:
    flagged: DataFrame
    strict: DataFrame
    site_day: DataFrame
    point_with_cell: DataFrame
    grid_day: DataFrame
    report: DataFrame


def clean(raw: DataFrame, options: CleaningOptions = CleaningOptions(), configured: dict[str, str] | None = None) -> CleaningResult:
    """All tables of the cleaning workflow as lazy DataFrames."""
    standard = cleaning.standardise(raw, configured)
    flagged = cleaning.add_flags(standard, options.low, options.high)
    drops = (options.drop_isolated, options.drop_suspect, options.drop_dead)
    strict = cleaning.strict_view(flagged, *drops)
    # The conflict flags take two aggregates and joins and drop no row, so the
    # site-day table is built from rows flagged without them.
    usable = cleaning.strict_view(cleaning.add_flags(standard, options.low, options.high, conflicts=False), *drops)
    land_cover = options.land_cover_column if options.land_cover_column in standard.columns else None
    site_day = dedup.site_day(
        usable, options.site_strategy, by_location=options.by_location, precision=options.precision, land_cover_column=land_cover
    )
    return CleaningResult(
        flagged,
        strict,
        site_day,
        dedup.point_with_cell(site_day),
        dedup.grid_day(site_day, options.grid_strategy),
        cleaning.flag_report(flagged),
    )


def full_report(result: CleaningResult) -> DataFrame:
    """One row of structs: flag counts and a summary of each table."""
    parts = {
        "qc_report": result.report,
        "std_summary": cleaning.summarise(result.flagged),
        "strict_summary": cleaning.summarise(result.strict),
        "site_day_summary": cleaning.summarise(result.site_day),
        "scheme_a_summary": cleaning.summarise(result.point_with_cell),
        "scheme_b_summary": cleaning.summarise(result.grid_day),
    }
    out = None
    for name, part in parts.items():
        row = part.select(F.struct(*part.columns).alias(name), F.lit(1).alias("__one"))
        out = row if out is None else out.join(row, ["__one"])
    return out.drop("__one")
