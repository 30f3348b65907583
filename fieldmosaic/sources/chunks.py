"""Grid days as chunks: one row holds the cells of a rectangle.

A day of the 1800 x 3600 grid is 100 rows of 180 x 360 cells. A chunk keeps which of its
cells are present as 64-bit words of a bitmap (only words with a present cell) and, per
value column, an array with one element for each present cell in order of position. An
absent cell costs nothing, a present one its value and a bit; a missing value of a
present cell stays NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names

CHUNK_ROWS = 180
CHUNK_COLS = 360
_KEYS = ["date", "chunk_row", "chunk_col"]


def grid_chunks(
    cells: DataFrame, columns: Sequence[str], rows: int = names.GRID_ROWS, cols: int = names.GRID_COLS, chunk_rows: int = CHUNK_ROWS, chunk_cols: int = CHUNK_COLS
) -> DataFrame:
    """``(date, chunk_row, chunk_col, words, bits, <columns>)`` of rows ``(date, row, col, <columns>)``.

    Every day of the input has all its chunks, empty ones included. A cell may occur once a day; cells
    outside the grid are an error, as are rows without a day, row or column. First the up to 64 cells
    of a word are put together, then the words of a chunk, so a task holds one chunk.
    """
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1) & F.col("date").isNotNull()
    checked = F.when(F.coalesce(inside, F.lit(False)), F.col("row")).otherwise(F.raise_error(F.lit("a cell outside the grid")).cast("int"))
    place = (F.col("row") % chunk_rows) * chunk_cols + F.col("col") % chunk_cols
    placed = cells.select(
        "date", F.floor(checked / chunk_rows).cast("int").alias("chunk_row"), F.floor(F.col("col") / chunk_cols).cast("int").alias("chunk_col"),
        place.cast("int").alias("place"), *columns,
    )
    words = placed.groupBy(*_KEYS, F.expr("cast(place div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("place", *columns))).alias("cells"),
    )
    once = F.when(F.bit_count("bits") == F.col("n"), F.col("word")).otherwise(F.raise_error(F.lit("a cell occurs twice in a day")).cast("int"))
    whole = words.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct(once.alias("word"), "bits", "cells"))).alias("__w"))
    flat = F.flatten(F.col("__w.cells"))
    filled = whole.select(*_KEYS, F.col("__w.word").alias("words"), F.col("__w.bits").alias("bits"), *[flat[c].alias(c) for c in columns])
    every = cells.select("date").distinct().withColumn("chunk_row", F.explode(F.sequence(F.lit(0), F.lit(-(-rows // chunk_rows) - 1)))).withColumn(
        "chunk_col", F.explode(F.sequence(F.lit(0), F.lit(-(-cols // chunk_cols) - 1)))
    )
    empty = [F.coalesce(c, F.array().cast(filled.schema[c].dataType)).alias(c) for c in ("words", "bits", *columns)]
    return every.join(filled, _KEYS, "left").select(*_KEYS, *empty)


def cells_of_chunks(chunks: DataFrame, columns: Sequence[str], chunk_rows: int = CHUNK_ROWS, chunk_cols: int = CHUNK_COLS) -> DataFrame:
    """``(date, row, col, <columns>)`` of the present cells, one by one."""
    set_bits = F.transform(
        F.arrays_zip("words", "bits"),
        lambda w: F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 1), lambda b: w["words"] * 64 + b
        ),
    )
    opened = chunks.withColumn("place", F.flatten(set_bits)).select(*_KEYS, F.explode(F.arrays_zip("place", *columns)).alias("__c"))
    return opened.select(
        "date",
        (F.col("chunk_row") * chunk_rows + F.expr(f"__c.place div {chunk_cols}")).cast("int").alias("row"),
        (F.col("chunk_col") * chunk_cols + F.col("__c.place") % chunk_cols).cast("int").alias("col"),
        *[F.col(f"__c.{c}").alias(c) for c in columns],
    )


def write_chunks(cells: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite", **shape: int) -> None:
    """Chunks in a folder for each day; as many tasks write as the shuffle has partitions, one file a day and task at most."""
    grid_chunks(cells, columns, **shape).write.mode(mode).partitionBy("date").parquet(path)
