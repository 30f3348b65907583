"""Dates: parsing, season terms, 8-day windows, dates in file names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import names
from .values import col, to_number

_TEXT_DATES = ["yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "MMM d, yyyy"]


def parse_day(c: Column | str) -> Column:
    """Eight-digit numbers as yyyyMMdd (also ``20240131.0``), else a written date; bad -> NULL."""
    text = F.trim(col(c).cast("string"))
    digits = to_number(text).cast("decimal(20,0)").cast("string")
    written = F.coalesce(
        F.to_date(text.try_cast("timestamp_ntz")),
        *[F.try_to_date(text, pattern) for pattern in _TEXT_DATES],
    )
    return (
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{8}\.\d*$|^\d\.\d+[eE]\+?0?7$"), F.try_to_date(digits, "yyyyMMdd"))
        .when(~text.rlike(r"^\d+(\.\d+)?$"), written)
    )


def clock_seconds(c: Column | str) -> Column:
    """Seconds after midnight for ``HHMM``, ``HMM``, ``HH:MM`` and ``HH:MM:SS``; else NULL."""
    text = F.trim(col(c).cast("string"))
    number = F.translate(text, ":", "").try_cast("int")
    clock = F.when(text.rlike(r"^\d{1,2}:?\d{2}$"), number * 100).when(text.rlike(r"^\d{1,2}:\d{2}:\d{2}$|^\d{6}$"), number)
    return F.when(
        (clock < 240000) & (clock % 10000 < 6000) & (clock % 100 < 60),
        F.floor(clock / 10000) * 3600 + F.floor(clock % 10000 / 100) * 60 + clock % 100,
    )


def add_seconds(day: Column, seconds: Column) -> Column:
    """Day plus seconds as a timestamp without zone; missing seconds keep the day."""
    return F.timestamp_add("SECOND", F.coalesce(seconds, F.lit(0)), day.cast("timestamp_ntz"))


def sampling_moment(day: Column | str, clock: Column | str) -> Column:
    """Sampling day plus time of day.

    ``HHMM`` and ``HH:MM`` are honoured, which is the stated intent of the
    workflow this follows (its own parser only ever accepted ``HH:MM:SS``).
    """
    return add_seconds(col(day), clock_seconds(clock))


def parse_moment(day_text: Column | str, clock_text: Column | str | None = None, to_day: bool = True) -> Column:
    """Alternative parser: day text with an optional trailing ``.0``, optional clock text."""
    day = parse_day(F.regexp_replace(F.trim(col(day_text).cast("string")), r"\.0$", ""))
    moment = day.cast("timestamp_ntz") if clock_text is None else sampling_moment(day, clock_text)
    return F.to_date(moment) if to_day else moment


def day_of_year_terms(day: Column | str, period: float = names.SEASON_PERIOD) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * F.dayofyear(col(day)).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def normalised_coordinates(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    return col(lat) / F.lit(90.0), col(lon) / F.lit(180.0)


def eight_day_start(day: Column | str) -> Column:
    """First day of the 8-day window within the year (windows restart on 1 January)."""
    day = col(day)
    return F.date_add(F.trunc(day, "year"), (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))


def file_name_day(name: Column | str) -> Column:
    """Date in a product file name: ``AYYYYDDD``, ``YYYYMMDD`` or ``YYYYDDD``."""
    name = col(name)

    def from_day_number(pattern: str) -> Column:
        year = F.regexp_extract(name, pattern, 1).try_cast("int")
        number = F.regexp_extract(name, pattern, 2).try_cast("int")
        day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), number - 1)
        return F.when(number.between(1, 366) & (F.year(day) == year), day)

    calendar = F.try_to_date(F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1), "yyyyMMdd")
    return F.coalesce(
        from_day_number(r"A(\d{4})(\d{3})(?!\d)"),
        calendar,
        from_day_number(r"(?<!\d)(\d{4})(\d{3})(?!\d)"),
    )


def day_number(day: Column | str) -> Column:
    """Days since 1970-01-01: the integer axis of the trailing windows."""
    return F.datediff(col(day), F.lit("1970-01-01").cast("date"))


__all__ = [
    "add_seconds", "clock_seconds", "day_number", "day_of_year_terms", "eight_day_start", "file_name_day",
    "normalised_coordinates", "parse_day", "parse_moment", "sampling_moment",
]
