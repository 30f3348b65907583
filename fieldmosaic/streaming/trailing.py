"""Trailing sums over ingested days that stay right whenever a tile arrives.

A watermark gives up on late tiles. Here a late tile changes only what it reaches:
the windows of its cells in its own chunk of days, and in the next one if the windows
reach that far, are computed again. The table is kept in blocks, a chunk of days by a
band of grid rows. A block with changed cells is written as a new generation,
untouched cells copied; all other blocks stay as they are. The manifest is
appended last and by one file, so a refresh that was broken off is invisible, and
running it again replaces its files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import day_number
from ..operators import windows
from .daily import read_ingested

BAND_ROWS = 100
_BLOCK = ["chunk", "band"]
# A line is either a batch that was taken in (date, batch_id) or a block that was written (chunk, band).
_MANIFEST = "generation long, date date, batch_id int, chunk long, band long"


def _chunk(day: Column) -> Column:
    return F.floor(day / windows.CHUNK_DAYS)


def _band(keys: Sequence[str]) -> Column:
    return F.floor(F.col(keys[0]) / BAND_ROWS)


def _manifest(spark: SparkSession, sums: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{sums}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _current(manifest: DataFrame) -> DataFrame:
    """The newest generation of every block."""
    return manifest.where(F.col("chunk").isNotNull()).groupBy(*_BLOCK).agg(F.max("generation").alias("generation"))


def refresh_trailing(spark: SparkSession, target: str, sums: str, value: str, days: int = 7, keys: Sequence[str] = ("row", "col")) -> int:
    """Take in the batches of an ingested table that came since the last refresh; returns the number of blocks written.

    Afterwards ``read_trailing`` has the rows of ``windows.trailing_sum`` over ``read_ingested``, in whatever order the
    tiles came. Batches and blocks are counted by days and grid rows, not by cells, so their lists are small.
    """
    reach, keys = days - 1, list(keys)
    manifest = _manifest(spark, sums)
    arrived = spark.read.parquet(target).select("date", F.col("batch_id").cast("int").alias("batch_id")).distinct()
    fresh = arrived.join(manifest.select("date", "batch_id"), ["date", "batch_id"], "left_anti").collect()
    if not fresh:
        return 0
    batches = spark.createDataFrame([(r["date"], r["batch_id"]) for r in fresh], "date date, batch_id int")
    day = day_number("date")
    touched = (
        spark.read.parquet(target).join(batches, ["date", "batch_id"], "left_semi")
        .select(*keys, _band(keys).alias("band"), F.explode(F.sequence(_chunk(day), _chunk(day + reach))).alias("chunk"))
        .distinct()
    )
    written = [(r["chunk"], r["band"]) for r in touched.select(*_BLOCK).distinct().collect()]
    blocks = spark.createDataFrame(written, "chunk long, band long")
    # days whose values some window of a touched chunk needs
    chunks = blocks.select("chunk").distinct()
    needed = arrived.select("date").distinct().withColumn("chunk", F.explode(F.sequence(_chunk(day), _chunk(day + reach))))
    needed = needed.join(chunks, ["chunk"], "left_semi").select("date").distinct()
    source = read_ingested(spark, target, ("date", *keys), needed).select("date", *keys, value)
    marks = touched.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("chunk").alias("__touched"))
    same_cell = [source[k] == marks[f"__{k}"] for k in keys]
    reached = (F.col("__touched") == _chunk(day)) | (F.col("__touched") == _chunk(day + reach))
    if reach > windows.CHUNK_DAYS:
        reached = F.col("__touched").between(_chunk(day), _chunk(day + reach))
    inputs = source.join(marks, [*same_cell, reached], "left_semi")
    made = windows.trailing_sum(inputs, value, days, keys=keys).withColumns({"chunk": _chunk(day), "band": _band(keys)})
    made = made.join(touched, [*keys, *_BLOCK], "left_semi")
    generation = (manifest.agg(F.max("generation")).first()[0] or 0) + 1
    if generation > 1:
        kept = _blocks_of(spark, sums, _current(manifest).join(blocks, _BLOCK, "left_semi")).join(touched, [*keys, *_BLOCK], "left_anti")
        made = made.unionByName(kept.select(*made.columns))
    spread = made.withColumn("generation", F.lit(generation)).repartition(*_BLOCK, F.floor(F.col(keys[0]) / (BAND_ROWS // 10)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_BLOCK, "generation").parquet(f"{sums}/blocks")
    lines = [(generation, r["date"], r["batch_id"], None, None) for r in fresh] + [(generation, None, None, *b) for b in written]
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{sums}/manifest")
    return len(written)


def _blocks_of(spark: SparkSession, sums: str, wanted: DataFrame) -> DataFrame:
    """Rows of these generations of blocks: a scan pruned by partition."""
    return spark.read.parquet(f"{sums}/blocks").join(wanted, [*_BLOCK, "generation"], "left_semi")


def read_trailing(spark: SparkSession, sums: str) -> DataFrame:
    """The trailing sums as of the last refresh."""
    return _blocks_of(spark, sums, _current(_manifest(spark, sums))).drop(*_BLOCK, "generation")


__all__ = ["read_trailing", "refresh_trailing"]
