"""Regression metrics, repeat summaries, counts and consistency diagnosis."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from . import scale


def finite_pairs(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return df.where(values.finite(y).isNotNull() & values.finite(y_hat).isNotNull())


def error_aggregates(y: str = "y", y_hat: str = "y_hat") -> dict[str, Column]:
    """n, MAE, RMSE, Pearson R and R2 over pairs with both sides present.

    R is built from the covariance because ``corr`` divides by zero for a
    constant side; here, as for fewer than two pairs, it is NULL.
    """
    pair = F.col(y).isNotNull() & F.col(y_hat).isNotNull()
    obs = F.when(pair, F.col(y).cast("double"))
    hat = F.when(pair, F.col(y_hat).cast("double"))
    error = hat - obs
    n = F.count(error)
    r2 = F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(obs) * n)
    return {
        "n": n,
        "MAE": F.avg(F.abs(error)),
        "RMSE": F.sqrt(F.avg(error * error)),
        "R": F.try_divide(F.covar_pop(obs, hat), F.stddev_pop(obs) * F.stddev_pop(hat)),
        "R2": r2,
    }


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y", y_hat: str = "y_hat", measures: Sequence[str] = ("n", "MAE", "RMSE", "R")) -> DataFrame:
    """One row per group from one map-side combined aggregate."""
    made = error_aggregates(y, y_hat)
    return df.groupBy(*keys).agg(*[made[m].alias(m) for m in measures])


def metrics_with_overall(df: DataFrame, split: str, group: str, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per split and group plus per split overall, in one pass with grouping sets."""
    made = error_aggregates(y, y_hat)
    whole = F.grouping(group) == 1
    measured = df.groupingSets([[split], [split, group]], split, group).agg(
        F.when(whole, "Overall").otherwise("Group").alias("level"),
        *[made[m].alias(m) for m in ("n", "MAE", "RMSE", "R2")],
    )
    label = F.when(F.col("level") == "Overall", "Overall").otherwise(F.coalesce(F.col(group), F.lit("NA")))
    named = measured.withColumn(group, label)
    return named.orderBy(split, F.col("level").desc(), F.col("n").desc(), group)


def weighted_mae(df: DataFrame, weight: str, y: str = "y", y_hat: str = "y_hat", keys: Sequence[str] = ()) -> DataFrame:
    loss = F.sum(F.col(weight) * F.abs(F.col(y_hat) - F.col(y)))
    return df.groupBy(*keys).agg((loss / F.greatest(F.sum(weight), F.lit(1e-8))).alias("weighted_mae"))


def repeat_summary(df: DataFrame, keys: Sequence[str] = ("scheme", "model", "split"), measures: Sequence[str] = ("MAE", "RMSE", "R")) -> DataFrame:
    """Mean and sample standard deviation over repeats; the deviation of one repeat is NULL."""
    picks = []
    for m in measures:
        picks += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*picks)


def with_counts(summary: DataFrame, raw: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Summary rows with the sample count of their group."""
    counts = raw.groupBy(*keys).agg(F.max(n).alias("n_samples"))
    return summary.join(counts, list(keys), "left")


def with_descriptions(summary: DataFrame, raw: DataFrame, keys: Sequence[str], description: str) -> DataFrame:
    texts = raw.groupBy(*keys).agg(F.min(description).alias(description))
    return summary.join(texts, list(keys), "left")


def model_comparison(families: Sequence[tuple[DataFrame, DataFrame]], keys: Sequence[str] = ("scheme", "model", "split")) -> DataFrame:
    """Summaries of all model families with sample counts, stacked and sorted."""
    stacked = None
    for summary, raw in families:
        part = with_counts(summary, raw, keys)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.orderBy(*keys)


def consistency_summary(df: DataFrame, y: str = "lfmc_pct", flag: str = "is_consistent", keys: Sequence[str] = ("split",)) -> DataFrame:
    """Counts, shares and conditional moments of agreeing and disagreeing rows per split."""
    yes, no = F.coalesce(F.col(flag), F.lit(False)), ~F.coalesce(F.col(flag), F.lit(False))
    n, n_yes, n_no = F.count(F.lit(1)), F.count(F.when(yes, 1)), F.count(F.when(no, 1))
    return df.groupBy(*keys).agg(
        n.alias("n_total"),
        n_yes.alias("n_consistent"),
        n_no.alias("n_inconsistent"),
        (n_yes / n).alias("consistent_ratio"),
        (n_no / n).alias("inconsistent_ratio"),
        F.avg(y).alias("lfmc_mean_total"),
        F.avg(F.when(yes, F.col(y))).alias("lfmc_mean_consistent"),
        F.avg(F.when(no, F.col(y))).alias("lfmc_mean_inconsistent"),
        F.stddev_samp(y).alias("lfmc_std_total"),
        F.stddev_samp(F.when(yes, F.col(y))).alias("lfmc_std_consistent"),
        F.stddev_samp(F.when(no, F.col(y))).alias("lfmc_std_inconsistent"),
    )


def grouped_moments(df: DataFrame, keys: Sequence[str], y: str = "lfmc_pct") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("lfmc_mean"), F.stddev_samp(y).alias("lfmc_std")
    )


def category_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def counts_per_year(df: DataFrame, y: str = "lfmc_pct", date: str = "date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.count(y).alias("n"))


def group_size_quantiles(df: DataFrame, key: str, counted: str, probabilities: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Quantiles of the rows per group.

    Counts of counts are the input of ``percentile``: N rows have at most
    sqrt(2 N) different group sizes, so the final buffer stays small.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(counted).alias("size"))
    spread = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    picks = [
        F.percentile("size", F.lit(float(p)), F.col("groups")).alias(f"q{str(p).replace('0.', '')}") for p in probabilities
    ]
    return spread.agg(F.sum("groups").alias("n_groups"), *picks)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the upper edge belongs to the last bin."""
    value = F.col(column)
    inside = df.where(value.between(low, high))
    bin_no = F.least(F.floor((value - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str, keys: Sequence[str] = (), large_groups: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max; exact for groups of any size."""
    plain = [
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    ]
    quartiles = {"p25": (column, 0.25), "p50": (column, 0.5), "p75": (column, 0.75)}
    return scale.group_quantiles(df, keys, quartiles, plain, large_groups)


def approximate_quantiles(
    df: DataFrame, column: str, probabilities: dict[str, float], keys: Sequence[str] = (), rank_error: float = 0.001
) -> DataFrame:
    """Quantiles of groups of any size by one pass and a summary of bounded size.

    Each is a value of the group whose rank is off by ``rank_error`` of the group's rows at most; missing
    values are left out. For exact quantiles see ``describe``.
    """
    # Spark's summary may be off by its own bound and one row more; half the bound leaves room for that row,
    # and groups too small for it are kept whole
    accuracy = F.lit(math.ceil(2 / rank_error))
    picks = [F.percentile_approx(column, F.lit(float(p)), accuracy).alias(name) for name, p in probabilities.items()]
    return df.groupBy(*keys).agg(F.count(column).alias("n"), *picks)


def rank_errors(df: DataFrame, column: str, quantiles: DataFrame, probabilities: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """How far the rank of each value of ``quantiles`` is from the one asked for, as a share of the group's rows.

    A value that several rows have has all of their ranks.
    """
    present = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("__v"))
    one_row = F.lit(1).alias("__one")
    named = [F.col(name).alias(f"__{name}") for name in probabilities]
    left, right = present.select("*", one_row), quantiles.select(*keys, *named, one_row)
    joined = scale.match_on(left, right.drop("__one"), list(keys)) if keys else left.join(right, "__one")
    shares = []
    for name, p in probabilities.items():
        below = F.avg((F.col("__v") < F.col(f"__{name}")).cast("double"))
        up_to = F.avg((F.col("__v") <= F.col(f"__{name}")).cast("double"))
        shares.append(F.greatest(F.lit(0.0), below - F.lit(float(p)), F.lit(float(p)) - up_to).alias(name))
    return joined.groupBy(*keys).agg(*shares)


def raster_statistics(df: DataFrame, band: str, keys: Sequence[str] = (), large_groups: bool = False) -> DataFrame:
    """Share of missing cells, min, median and max of a band."""
    plain = [
        F.avg(F.col(band).isNull().cast("double")).alias("missing_ratio"),
        F.min(band).alias("min_value"),
        F.max(band).alias("max_value"),
    ]
    return scale.group_quantiles(df, keys, {"median_value": (band, 0.5)}, plain, large_groups)


def split_counts(df: DataFrame, block: str = "block_id") -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(block).alias("n_blocks"))


def _sort_key(column: str, kind: T.DataType) -> Column:
    """The order of a column's values as a struct that all columns share."""
    exact = isinstance(kind, (T.IntegralType, T.DecimalType))
    real = isinstance(kind, T.FractionalType) and not exact
    return F.struct(
        (F.col(column) if exact else F.lit(None)).cast("decimal(38,10)").alias("exact"),
        (F.col(column) if real else F.lit(None)).cast("double").alias("real"),
        F.col(column).cast("string").alias("text"),
    )


def column_profile(df: DataFrame, columns: Sequence[str], preview: int = 3, count_missing: bool = False) -> DataFrame:
    """Per column: type, number of values, min, max, distinct count and lowest values.

    Numbers are compared as numbers, dates and texts in their own order; all are
    shown as text. ``count_missing`` lets NULL count as one distinct value. The columns
    are stacked and counted per value first, so a dominant value costs nothing extra.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c].simpleString()).alias("data_type"), _sort_key(c, kinds[c]).alias("value")) for c in columns]
    stacked = df.select(F.explode(F.array(*parts)).alias("__s")).select("__s.*")
    counted = stacked.groupBy("column_name", "data_type", "value").agg(F.count(F.lit(1)).alias("__c"))
    present = F.col("value.text").isNotNull()
    base = counted.groupBy("column_name", "data_type").agg(
        F.coalesce(F.sum(F.when(present, F.col("__c"))), F.lit(0)).alias("n_present"),
        F.min(F.when(present, F.col("value"))).getField("text").alias("min_text"),
        F.max(F.when(present, F.col("value"))).getField("text").alias("max_text"),
        F.count(F.lit(1) if count_missing else F.when(present, 1)).alias("n_distinct"),
    )
    first = scale.lowest_n(counted.where(present).select("column_name", "value"), ["column_name"], [F.col("value")], preview)
    shown = first.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("value")), lambda v: v["text"]), "|").alias("preview"))
    return base.join(shown, ["column_name"], "left")


