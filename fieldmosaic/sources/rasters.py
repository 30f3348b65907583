"""Gridded products as date-partitioned long tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from .tables import finite_columns


def write_grid(df: DataFrame, path: str, by: str = "date", mode: str = "overwrite") -> None:
    """Partitioned by date (or year) and ordered by row, so files skip by min and max.

    Rows are spread by (date, row band) rather than by date alone: a day is
    written by several tasks, never one.
    """
    spread = df.repartition(F.col(by), F.floor(F.col("row") / 100)).sortWithinPartitions(by, "row", "col")
    spread.write.mode(mode).partitionBy(by).parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return finite_columns(spark.read.parquet(path))


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows of a day range; the filter prunes partitions."""
    return read_grid(spark, path).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def available_days(grid: DataFrame) -> DataFrame:
    return grid.select("date").where(F.col("date").isNotNull()).distinct().orderBy("date")


def available_years(grid: DataFrame, year: str = "year") -> DataFrame:
    return grid.select(F.col(year).alias("year")).where(F.col(year).isNotNull()).distinct().orderBy("year")


def days_in_file_names(df: DataFrame, name: Column | str = "file_name") -> DataFrame:
    """Sorted distinct days named by files, e.g. over ``_metadata.file_name``."""
    return available_days(df.select(calendar.file_name_day(name).alias("date")))


def new_days(arrived: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of days not processed yet."""
    return arrived.join(done.select("date").distinct(), ["date"], "left_anti")


def quarantine(df: DataFrame, usable: Column) -> tuple[DataFrame, DataFrame]:
    """Usable rows and the rest."""
    ok = F.coalesce(usable, F.lit(False))
    return df.where(ok), df.where(~ok)


def first_available(sources: Sequence[DataFrame], date: str = "date", out: str = "source") -> DataFrame:
    """Rows of each day from the first source that has the day; any number of sources in order.

    Only the distinct days of the sources are compared, which the calendar bounds.
    """
    marked = [df.withColumn(out, F.lit(i)) for i, df in enumerate(sources)]
    days = reduce(DataFrame.unionByName, [df.select(date, out).distinct() for df in marked])
    first = days.groupBy(date).agg(F.min(out).alias(out))
    return reduce(DataFrame.unionByName, marked).join(first, [date, out])
