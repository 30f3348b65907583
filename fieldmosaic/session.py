"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sample tables can put a third of their rows on one cell and day. The grid
    # side of such a join has one row per key, so splitting the sample side is
    # always worth the extra exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins by (date, row, col) may stay distributed by (row, col).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # HotSpot does not compile methods above 8000 bytes of bytecode. Stages with
    # dozens of class columns exceed that when fused and then run interpreted;
    # with this limit they fall back to split, compiled projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Wide feature expressions make thousands of Column calls; without the
    # per-call stack capture a plan is built several times faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoint files go when nothing refers to their rows any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "fieldmosaic",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the library's defaults; a cluster keeps its own partition count."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """One temporary folder of a local run, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="fieldmosaic-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def reliable_checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder, unless the application has set one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    reliable_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
