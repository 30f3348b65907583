"""Daily arrivals, late tiles and arriving samples as streams.

The batch operators stay the reference for the results: on a finished input
each stream gives the rows of its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import cells, landcover
from ..operators import scale
from ..sources import rasters


def watch_folder(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files arriving in a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest_daily(
    stream: DataFrame,
    target: str,
    rejected: str,
    checkpoint: str,
    usable: Column,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    closed: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the usable rows of each batch under its number; the others go to a quarantine table.

    A day may arrive in any number of batches: each has partitions of its own
    (``date`` and ``batch_id``), and only these are replaced when a batch is run
    again after a failure. ``read_ingested`` returns every cell of a day once.
    Rows of days that ``closed`` lists at that time are skipped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good, bad = rasters.quarantine(batch, usable)
            good = prepare(good) if prepare else good
            good = rasters.new_days(good, closed()) if closed else good
            spread = good.withColumn("batch_id", F.lit(batch_id)).repartition(F.col("date"), F.floor(F.col("row") / 100))
            spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(target)
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str, keys: Sequence[str] = ("date", "row", "col"), days: DataFrame | None = None) -> DataFrame:
    """Rows of an ingested table, of some ``days`` if given; of a cell that arrived twice, the one of the first batch."""
    rows = spark.read.parquet(target)
    if days is not None:
        rows = rows.join(days.select("date"), ["date"], "left_semi")
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return scale.first_per_group(rows, list(keys), [F.col("batch_id"), F.xxhash64(*rest)]).drop("batch_id")


_MANIFEST = "date date, generation long"


def _arrived(spark: SparkSession, target: str) -> DataFrame:
    """``(date, generation)`` of an ingested table: a day's generation is the number of its batches."""
    return spark.read.parquet(target).select("date", "batch_id").distinct().groupBy("date").agg(F.count(F.lit(1)).alias("generation"))


def _compacted_days(spark: SparkSession, compacted: str) -> DataFrame:
    """The generations that were compacted and recorded; none before the first compaction."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{compacted}/manifest").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def compact_ingested(spark: SparkSession, target: str, compacted: str, keys: Sequence[str] = ("date", "row", "col")) -> int:
    """Merge the batches of days that have arrived or changed since the last compaction; returns how many days.

    Only those days are read. Their rows are written as a new generation of the day first and recorded in the
    manifest last, so a compaction that was broken off leaves what readers see as it was, and running it
    again replaces its files. A replayed batch has the same rows and starts no generation.
    """
    stale = _arrived(spark, target).join(_compacted_days(spark, compacted), ["date", "generation"], "left_anti").collect()
    if not stale:  # at most one row per day of the calendar
        return 0
    days = spark.createDataFrame([(r["date"], r["generation"]) for r in stale], _MANIFEST)
    merged = read_ingested(spark, target, keys, days.select("date")).join(days, "date")
    spread = merged.repartition(F.col("date"), F.floor(F.col("row") / 100)) if "row" in merged.columns else merged
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "generation").parquet(f"{compacted}/days")
    days.coalesce(1).write.mode("append").parquet(f"{compacted}/manifest")
    return len(stale)


def read_compacted(spark: SparkSession, target: str, compacted: str, keys: Sequence[str] = ("date", "row", "col")) -> DataFrame:
    """The rows of ``read_ingested``: a plain scan of days as they were compacted, merged only where batches came since."""
    arrived, done = _arrived(spark, target), _compacted_days(spark, compacted)
    open_days = arrived.join(done, ["date", "generation"], "left_anti").select("date")
    merged = read_ingested(spark, target, keys, open_days)
    if done.isEmpty():
        return merged
    settled = arrived.join(done, ["date", "generation"], "left_semi")
    scanned = spark.read.parquet(f"{compacted}/days").join(settled, ["date", "generation"], "left_semi")
    return scanned.select(*merged.columns).unionByName(merged)


def sliding_sum(stream: DataFrame, value: str, days: int = 7, late: str = "30 days", keys: Sequence[str] = ("row", "col"), date: str = "date") -> DataFrame:
    """Trailing sums as a sliding window with a watermark for late daily tiles.

    A window that ends at midnight after day d is the trailing window of day d.
    Days are unique per cell, so counting values counts valid days.
    """
    timed = stream.withColumn("__ts", F.col(date).cast("timestamp")).withWatermark("__ts", late)
    span = F.window("__ts", f"{days} days", "1 day")
    summed = timed.groupBy(span.alias("__w"), *keys).agg(
        F.sum(value).alias(f"{value}_{days}day"), F.count(value).alias(f"{value}_{days}day_valid_days")
    )
    day = F.date_sub(F.to_date(F.col("__w.end")), 1).alias(date)
    return summed.select(day, *keys, f"{value}_{days}day", f"{value}_{days}day_valid_days")


def arriving_site_days(stream: DataFrame, moment: str = "ts", late: str = "2 days", identity: str = "sorting_id") -> DataFrame:
    """Samples without repeats, averaged per location, day and vegetation kind.

    Repeats of a sample within the watermark are dropped before aggregating.
    The mean is used: it is the reducer with a bounded state.
    """
    once = stream.withWatermark(moment, late).dropDuplicatesWithinWatermark([identity])
    placed = once.withColumns(
        {"site_loc_id": cells.location_key("lat", "lon"), "veg_type": landcover.vegetation_kind("functional_type")}
    )
    grouped = placed.groupBy(F.window(moment, "1 day").alias("__w"), "site_loc_id", "veg_type").agg(
        F.avg("lfmc_pct").alias("lfmc_pct"), F.count(F.lit(1)).alias("n_obs")
    )
    return grouped.select("site_loc_id", F.to_date(F.col("__w.start")).alias("date"), "veg_type", "lfmc_pct", "n_obs")


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over everything available into a Parquet table."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


__all__ = [
    "arriving_site_days", "compact_ingested", "ingest_daily", "read_compacted", "read_ingested", "sliding_sum", "watch_folder", "write_available",
]
