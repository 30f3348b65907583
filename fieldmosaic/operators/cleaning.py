"""Standardise, flag, filter and report raw ground samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import calendar, cells, values


def clean_header(header: str) -> str:
    return header.replace("﻿", "").replace("\xa0", " ").strip()


def tidy_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def resolve_headers(columns: Sequence[str], configured: dict[str, str] | None = None) -> dict[str, str]:
    """Core name -> existing header: the configured header if present, else the first known one."""
    found = {}
    for core, candidates in names.SAMPLE_HEADERS.items():
        wanted = clean_header((configured or {}).get(core) or "")
        for header in ([wanted] if wanted else []) + candidates:
            if header in columns and header not in found.values():
                found[core] = header
                break
    return found


def standardise(df: DataFrame, configured: dict[str, str] | None = None) -> DataFrame:
    """Core names and types, derived day terms and site id; other columns stay as they are."""
    df = tidy_headers(df)
    found = resolve_headers(df.columns, configured)
    if "date" not in found:
        raise KeyError("no sampling date column")
    df = df.withColumnsRenamed({header: core for core, header in found.items()})
    stored = dict(df.dtypes)
    typed: dict[str, Column] = {
        c: values.to_number(c) if stored[c] == "string" else values.finite(c) for c in ("lat", "lon", "lfmc_pct") if c in found
    }
    typed["date"] = calendar.parse_day("date")
    df = values.compute_once(df, typed)
    clock = "sampling_time_raw" in found
    return df.withColumns(
        {
            "sampling_datetime": calendar.sampling_moment("date", "sampling_time_raw")
            if clock
            else F.col("date").cast("timestamp_ntz"),
            "isolated_iforest": values.truthy("isolated_iforest_raw")
            if "isolated_iforest_raw" in found
            else F.lit(False),
            "site_id": cells.site_hash(
                "site_name" if "site_name" in found else None,
                "lat" if "lat" in found else F.lit(None).cast("double"),
                "lon" if "lon" in found else F.lit(None).cast("double"),
            ),
            "year": F.year("date"),
            "doy": F.dayofyear("date"),
        }
    )


def normal_protocol(protocol: Column | str) -> Column:
    """Trimmed lower-case text without the ``.0`` a spreadsheet adds."""
    return F.regexp_replace(F.lower(F.trim(values.col(protocol).cast("string"))), r"\.0$", "")


def hard_flags(low: float = names.VALUE_MIN, high: float = names.VALUE_MAX) -> dict[str, Column]:
    bad_date = F.col("date").isNull()
    bad_coord = ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    bad_value = ~F.coalesce(F.col("lfmc_pct").between(low, high), F.lit(False))
    return {
        "bad_date": bad_date.cast("int"),
        "bad_coord": bad_coord.cast("int"),
        "bad_lfmc": bad_value.cast("int"),
        "qc_hard": (bad_date | bad_coord | bad_value).cast("int"),
    }


def dead_protocol(protocol: Column | str, codes: Sequence[str] = tuple(names.DEAD_PROTOCOLS)) -> Column:
    return F.coalesce(normal_protocol(protocol).isin(list(codes)), F.lit(False)).cast("int")


def provider_suspect(text: Column | str, words: Sequence[str] = tuple(names.SUSPECT_WORDS)) -> Column:
    if not words:
        return F.lit(0)
    pattern = "|".join(re.escape(word.lower()) for word in words)
    return F.coalesce(F.lower(values.col(text)).rlike(pattern), F.lit(False)).cast("int")


def _conflicting(df: DataFrame, keys: list[str], members: list[str], out: str) -> DataFrame:
    """Keys with more than one distinct member, found on distinct pairs."""
    pairs = df.select(*keys, *members).distinct()
    return (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
        .select(*keys, F.lit(1).alias(out))
    )


def site_conflicts(df: DataFrame) -> DataFrame:
    """Flags for a name at several coordinates and for a coordinate with several names.

    Rows without a name take no part. Pairs are made distinct before counting
    and the flags are joined back, so no site has to fit into one task.
    """
    rounded = df.withColumns({"__lat": F.round("lat", 4), "__lon": F.round("lon", 4)})
    placed = rounded.where((F.col("bad_coord") == 0) & F.col("site_name").isNotNull())
    by_name = _conflicting(placed, ["site_name"], ["lat", "lon"], "site_coord_conflict")
    by_place = _conflicting(placed, ["__lat", "__lon"], ["site_name"], "coord_site_conflict")
    flagged = rounded.join(by_name, ["site_name"], "left").join(by_place, ["__lat", "__lon"], "left")
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("site_coord_conflict", "coord_site_conflict")}
    return flagged.withColumns(flags).select(*df.columns, *flags)


def add_flags(
    df: DataFrame,
    low: float = names.VALUE_MIN,
    high: float = names.VALUE_MAX,
    dead_codes: Sequence[str] = tuple(names.DEAD_PROTOCOLS),
    suspect_words: Sequence[str] = tuple(names.SUSPECT_WORDS),
    conflicts: bool = True,
) -> DataFrame:
    """All hard and soft flags as 0/1; no row is dropped."""
    flags = hard_flags(low, high)
    flags["dead_protocol"] = dead_protocol("protocol", dead_codes) if "protocol" in df.columns else F.lit(0)
    flags["provider_suspect"] = (
        provider_suspect("extra_info_flag", suspect_words) if "extra_info_flag" in df.columns else F.lit(0)
    )
    flagged = df.withColumns(flags)
    if conflicts and "site_name" in df.columns:
        return site_conflicts(flagged)
    return flagged.withColumns({"site_coord_conflict": F.lit(0), "coord_site_conflict": F.lit(0)})


REPORT_FLAGS = [
    "qc_hard", "bad_date", "bad_coord", "bad_lfmc", "provider_suspect",
    "isolated_iforest", "site_coord_conflict", "coord_site_conflict", "dead_protocol",
]


def flag_report(df: DataFrame) -> DataFrame:
    """One row: number of rows and number of rows per flag."""
    counts = [F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(f"n_{c}") for c in REPORT_FLAGS if c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)


def strict_view(
    df: DataFrame, drop_isolated: bool = False, drop_suspect: bool = False, drop_dead: bool = False
) -> DataFrame:
    keep = F.col("qc_hard") == 0
    if drop_isolated and "isolated_iforest" in df.columns:
        keep = keep & ~F.col("isolated_iforest")
    if drop_suspect and "provider_suspect" in df.columns:
        keep = keep & (F.col("provider_suspect") == 0)
    if drop_dead and "dead_protocol" in df.columns:
        keep = keep & (F.col("dead_protocol") == 0)
    return df.where(keep)


def audit_view(df: DataFrame) -> DataFrame:
    if "qc_hard" not in df.columns:
        raise KeyError("qc_hard column not found; add flags first")
    return df.where(F.col("qc_hard") == 1)


def summarise(df: DataFrame) -> DataFrame:
    """One row: size, value range, day range and number of sites, as far as columns exist."""
    picks = [F.count(F.lit(1)).alias("n_rows")]
    if "lfmc_pct" in df.columns:
        picks += [
            F.min("lfmc_pct").alias("lfmc_min"),
            F.max("lfmc_pct").alias("lfmc_max"),
            F.avg("lfmc_pct").alias("lfmc_mean"),
        ]
    if "date" in df.columns:
        picks += [F.min("date").alias("date_min"), F.max("date").alias("date_max")]
    if "site_id" in df.columns:
        picks.append(F.count_distinct("site_id").alias("n_sites"))
    return df.agg(*picks)
