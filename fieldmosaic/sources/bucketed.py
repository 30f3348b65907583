"""Grid tables distributed by cell once, so that later joins by cell need no shuffle.

All tables of a product share one number of buckets by (row, col). A join by (date, row,
col) or (year, row, col) keeps that distribution in a session with
``SESSION_DEFAULTS``. Daily tables are also partitioned by date, so that reading a
few days opens only their files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

CELL = ("row", "col")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, partition: str | None = None, keys: Sequence[str] = CELL) -> DataFrame:
    """Save as table ``name`` with files under ``path``, one file per bucket and partition value; returns the table.

    Take as many buckets as the largest table needs for tasks of some hundred megabytes.
    """
    writer = df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").option("path", path)
    if partition:
        writer = writer.partitionBy(partition)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name).select(*df.columns)


__all__ = ["write_bucketed"]
