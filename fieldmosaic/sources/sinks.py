"""Writers. All of them are plain distributed writes; nothing passes the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import values
from ..operators.cleaning import normal_protocol


def repair_mixed_columns(df: DataFrame) -> DataFrame:
    """One type per column: clock times and protocols as text, slope as number."""
    fixes = {}
    if "sampling_time_raw" in df.columns:
        fixes["sampling_time_raw"] = F.col("sampling_time_raw").cast("string")
    if "protocol" in df.columns:
        fixes["protocol"] = normal_protocol("protocol")
    if "Slope (%)" in df.columns:
        fixes["Slope (%)"] = values.to_number(F.col("`Slope (%)`"))
    return df.withColumns(fixes) if fixes else df


def write_samples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    repair_mixed_columns(df).write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode(mode).json(path)


def write_prediction_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Input columns plus the prediction, NULL where the row was masked."""
    writer = df.write.mode(mode)
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported form: {form}")


def write_prediction_grid(df: DataFrame, path: str, value: str = "lfmc_pred", mode: str = "overwrite") -> None:
    """Valid cells partitioned by date, with the grid geometry as JSON beside them.

    Cells without a prediction are absent; the full grid is a left join away.
    """
    from .rasters import write_grid

    write_grid(df.where(F.col(value).isNotNull()).select("date", "row", "col", value), f"{path}/cells", mode=mode)
    about = {
        "rows": names.GRID_ROWS,
        "cols": names.GRID_COLS,
        "crs": "EPSG:4326",
        "transform": [-180.0, names.CELL_DEG, 0.0, 90.0, 0.0, -names.CELL_DEG],
    }
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/geometry")


def write_results(raw: DataFrame, summary: DataFrame, path: str, stem: str, mode: str = "overwrite") -> None:
    raw.write.mode(mode).option("header", True).csv(f"{path}/{stem}_raw")
    summary.repartition(1).write.mode(mode).option("header", True).csv(f"{path}/{stem}_summary")


def write_splits(df: DataFrame, path: str, split: str = "split", order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One folder per split. Rows keep their partitions, so a large split is written by many tasks."""
    ordered = df.sortWithinPartitions(split, *order)
    ordered.write.mode(mode).partitionBy(split).parquet(path)
