"""Reports that grow by the day: mergeable sketches of distinct values, so that past rows are not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 14
#: Three standard errors of a sketch with 2^14 registers: a count is off by this share at most, but for three in a thousand.
RELATIVE_ERROR = 3 * 1.04 / 2 ** (LOG_SIZE / 2)


def day_sketches(df: DataFrame, distinct: dict[str, Sequence[str]], value: str, date: str = "date") -> DataFrame:
    """One row per day: rows, sums and range of a value, and a sketch for each named set of columns.

    A combination with a missing part is left out, as in ``count(DISTINCT ...)``. A row is a few times 10 KB,
    whatever the day holds, and partial sketches are merged on the map side.
    """
    whole = {}
    for name, columns in distinct.items():
        # lengths keep ('a', 'bc') and ('ab', 'c') apart
        parts = [part for c in columns for part in (F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))]
        whole[name] = F.hll_sketch_agg(F.concat(*parts), F.lit(LOG_SIZE)).alias(f"sketch_{name}")
    return df.groupBy(date).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.sum(value).alias("sum_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), *whole.values(),
    )


def merged_report(days: DataFrame, names: Sequence[str], keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The report over any choice of days: exact counts, mean, value and date range, and distinct counts within ``RELATIVE_ERROR``.

    Spark's estimate depends a little on the order in which sketches are merged, within that error.
    """
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{n}")).alias(f"n_{n}") for n in names]
    return days.groupBy(*keys).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), (F.sum("sum_value") / F.nullif(F.sum("n_values"), F.lit(0))).alias("mean_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.min(date).alias("date_min"), F.max(date).alias("date_max"), *[F.coalesce(c, F.lit(0)).alias(f"n_{n}") for n, c in zip(names, counts)],
    )


__all__ = ["RELATIVE_ERROR", "day_sketches", "merged_report"]
