"""Shared steps of the operators: input columns, written intermediates, hash keys and fixed-size filters."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(_PACKAGE.rglob("*.py")):
            packed.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, under names that no input column can clash with."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *more
    )


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of the frame has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write rows to the shared folder and read them back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written_frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` made and that nothing reads any more."""
    for df in written_frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package on the workers.

    A batch of whole texts is much larger than one of numbers, so a session that has
    Spark's default of 10,000 rows a batch is set to 1,000.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    return df.mapInArrow(work, schema)


def batch(columns: dict[str, pa.Array | Sequence | np.ndarray], **types: pa.DataType) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=types.get(name)) for name, c in columns.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def in_fold(id_column: str | Column, folds: int, number: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(folds) == F.lit(number), F.lit(False))


def input_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by one aggregate in the JVM."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(spark: SparkSession, size: int, per_bucket: int, most: int) -> int:
    """How many buckets of about ``per_bucket`` hold ``size``: one per shuffle partition at least, and otherwise ``most``.

    Where every block of input sends a row to every bucket, ``most`` keeps these
    rows from becoming many and tiny; larger inputs get larger buckets.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(-(-size // per_bucket), most), 1)


class KeyFilter:
    """Fixed-size bit set of 64-bit keys: never misses a key it holds, sometimes admits another.

    Its size does not depend on the number of keys, so it may be broadcast at any
    scale; an exact join always follows.
    """

    BITS = 23

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64, copy=False) * np.uint64(0x9FB21C651E98DF25)
        mask = np.uint64((1 << KeyFilter.BITS) - 1)
        return (keys >> np.uint64(64 - KeyFilter.BITS)), (keys >> np.uint64(8)) & mask

    @classmethod
    def of(cls, keys: DataFrame) -> "KeyFilter":
        """Of a frame's only column; each task sends its own bits, merged a few ranges at a time."""
        parts = 64

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << cls.BITS, dtype=bool)
            for rows in batches:
                for place in cls.places(rows.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)):
                    bits[place] = True
            if bits.any():
                packed = np.packbits(bits).reshape(parts, -1)
                used = np.flatnonzero(packed.any(axis=1))
                yield batch({"part": used.astype(np.int32), "bits": [packed[i].tobytes() for i in used]})

        rows = arrow_map(keys.select(F.col(keys.columns[0]).cast("long")), partial, "part int, bits binary")
        return cls(_merged_bits(rows, parts, (1 << cls.BITS) // 8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        one, two = self.places(keys)
        return self._at(one) & self._at(two)

    def _at(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _merged_bits(rows: DataFrame, parts: int, size: int) -> np.ndarray:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for some in batches:
            for part, bits in zip(some.column(0).to_pylist(), some.column(1)):
                value = np.frombuffer(bits.as_buffer(), np.uint8)
                found[part] = found[part] | value if part in found else value.copy()
        if found:
            yield batch({"part": np.array(list(found), np.int32), "bits": [v.tobytes() for v in found.values()]})

    out = np.zeros((parts, size // parts), np.uint8)
    for row in arrow_map(rows.repartition("part"), merge, "part int, bits binary").collect():
        out[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)
