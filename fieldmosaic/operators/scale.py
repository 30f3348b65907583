"""Exact results for groups of any size.

A group may hold a third of all rows. Sums, counts and extrema are combined on
the map side and need no care. Exact quantiles, row numbers and last-n windows do:
by default one task holds the distinct values (or the rows) of a group; a caller who
knows of larger groups passes ``large_groups=True``, and the operator works over
*ordered slices*. Slices are contiguous ranges of the sort order, so a large group is
spread over many tasks and only per-slice totals travel between them. Both ways give
the same bits; the default builds its plan without running a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

SLICE = "__slice"
PLACE = "__at"


def match_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL matches NULL; the key columns of the left side stay."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    if not keys:
        raise ValueError("keys must not be empty")
    condition = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = part if condition is None else condition & part
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def ordered_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Rows with ``__slice``: the number of their contiguous range of the sort order.

    Equal sort keys share a slice. Without ``slices`` adaptive execution sizes them by
    bytes. The result is a checkpoint, so the slice numbers stay the same whatever is
    recomputed later; rows are sorted within a slice and ``__at`` counts them from 0.
    """
    columns = [F.col(c) for c in order]
    cut = df.repartitionByRange(slices, *columns) if slices else df.repartitionByRange(*columns)
    # the low 33 bits of the id number the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return durable(cut.sortWithinPartitions(*columns).withColumn(SLICE, F.spark_partition_id()).withColumn(PLACE, place))


def slice_offsets(sliced: DataFrame, keys: Sequence[str], measure: Column) -> DataFrame:
    """Per group and slice: ``__before`` (total in earlier slices) and ``__whole`` (group total).

    The windows see one row per slice of a group, never the rows themselves.
    """
    totals = sliced.groupBy(*keys, SLICE).agg(F.sum(measure).alias("__in"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__in").over(group).alias("__whole"),
    )


def row_index(df: DataFrame, order: Sequence[str], out: str = "sample_id", slices: int | None = None) -> DataFrame:
    """Dense 0-based row number in sort order: one shuffle, and no single-task window.

    ``order`` has to identify rows; ties get an arbitrary order among themselves.
    """
    sliced = ordered_slices(df, order, slices)
    offsets = slice_offsets(sliced, [], F.lit(1)).select(SLICE, "__before")
    return match_on(sliced, offsets, [SLICE]).withColumn(out, F.col("__before") + F.col(PLACE)).drop(SLICE, PLACE, "__before")


def sliced_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], slices: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    Equal values are counted first, then ranked over ordered slices; only the two
    values around each rank are kept.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    sliced = ordered_slices(counted, [*keys, value], slices)
    offsets = slice_offsets(sliced, keys, F.col("__c"))
    running = Window.partitionBy(*keys, SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        match_on(sliced.withColumn("__run", F.sum("__c").over(running)), offsets, [*keys, SLICE])
        .withColumn("__hi", F.col("__before") + F.col("__run"))
        .withColumn("__lo", F.col("__hi") - F.col("__c"))
    )
    aggregates, outputs = [F.max("__whole").alias("__whole")], []
    for name, q in probabilities.items():
        position = F.lit(float(q)) * (F.col("__whole") - 1)
        for side, rank in (("f", F.floor(position)), ("g", F.ceil(position))):
            here = (F.col("__lo") <= rank) & (rank < F.col("__hi"))
            aggregates.append(F.max(F.when(here, F.col(value))).alias(f"__{side}_{name}"))
        # the arithmetic of Spark's own percentile, so that both ways agree to the last bit
        low, high = F.col(f"__f_{name}"), F.col(f"__g_{name}")
        between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
        outputs.append(F.when(low == high, low).otherwise(between).alias(name))
    return ranked.groupBy(*keys).agg(*aggregates).select(*keys, *outputs)


def large_group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: dict[str, tuple[str, float]],
    aggregates: Sequence[Column] = (),
    slices: int | None = None,
) -> DataFrame:
    """Quantiles over ordered slices joined to map-side combined aggregates, one row per group."""
    keys = list(keys)
    by_column: dict[str, dict[str, float]] = {}
    for name, (column, q) in quantiles.items():
        by_column.setdefault(column, {})[name] = q
    out = df.groupBy(*keys).agg(F.lit(1).alias("__one"), *aggregates)
    for column, wanted in by_column.items():
        ranks = sliced_quantiles(df, keys, column, wanted, slices)
        if keys:
            out = match_on(out, ranks, keys, "left")
        else:
            out = match_on(out, ranks.withColumn("__one", F.lit(1)), ["__one"], "left")
    return out.drop("__one")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: dict[str, tuple[str, float]],
    aggregates: Sequence[Column] = (),
    large_groups: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """One row per group with exact quantiles and further aggregates.

    ``quantiles`` maps an output name to (column, probability). By default one shuffle:
    values are counted on the map side, and a task holds the distinct values of its
    groups. ``large_groups`` is for groups with more distinct values than that allows.
    """
    if large_groups:
        return large_group_quantiles(df, keys, quantiles, aggregates, slices)
    # One value buffer per column, whatever the number of its quantiles.
    wanted: dict[str, list[str]] = {}
    for name, (column, _) in quantiles.items():
        wanted.setdefault(column, []).append(name)
    buffers = [
        F.percentile(column, F.array(*[F.lit(float(quantiles[n][1])) for n in found])).alias(f"__q_{column}")
        for column, found in wanted.items()
    ]
    grouped = df.groupBy(*keys).agg(*buffers, *aggregates)
    plain = [c for c in grouped.columns if c not in keys and not c.startswith("__q_")]
    picks = [F.col(f"__q_{column}").getItem(i).alias(n) for column, found in wanted.items() for i, n in enumerate(found)]
    return grouped.select(*keys, *picks, *plain)


def smallest_mode(df: DataFrame, keys: Sequence[str], value: str, out: str, distinct_out: str | None = None) -> DataFrame:
    """Most frequent value per group (smallest on ties) and its distinct count, for groups of any size."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    picks = [F.min_by(value, F.struct(-F.col("__c"), F.col(value))).alias(out)]
    if distinct_out:
        picks.append(F.count(F.lit(1)).alias(distinct_out))
    return counted.groupBy(*keys).agg(*picks)


def group_size(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Group size on every row: a pre-aggregated count joined back, not a window.

    A window would send all rows of a group to one task; the join can split it.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return match_on(df, sizes, keys, "left")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group by an explicit order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest]).select(*df.columns)


def lowest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int | None = None) -> DataFrame:
    """The n lowest rows per group by an order that has no ties.

    Ranked per salted part of the group first, so the final window sees at most
    ``salts * n`` rows of any group. By default there are as many parts as shuffle partitions.
    """
    parts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(parts)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("__rn", F.row_number().over(part)).where(F.col("__rn") <= n).drop("__rn")
    return kept.withColumn("__rn", F.row_number().over(whole)).where(F.col("__rn") <= n).drop("__rn", "__salt")
