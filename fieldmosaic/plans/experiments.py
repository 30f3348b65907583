"""Experiment runs, coverage of temporal windows, and diagnosis."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import names
from ..operators import metrics, modeling, splits, windows
from ..session import scratch_path
from .frames import FrameSpec, experiment_frame, numeric_columns

Trainer = Callable[[DataFrame, Sequence[str], str, int], DataFrame]


def tree_trainer(iterations: int = 3000, rate: float = 0.03, depth: int = 8, loss: str = "absolute") -> Trainer:
    """Trainer that fits boosted trees and returns the frame with ``lfmc_pred``."""

    def train(frame: DataFrame, numeric: Sequence[str], category: str, seed: int) -> DataFrame:
        model = modeling.fit_trees(
            frame, numeric, category, loss=loss, weight="sample_weight", iterations=iterations, rate=rate, depth=depth, seed=seed
        )
        return model.transform(modeling.fill_bands(frame))

    return train


def run_experiments(
    base: DataFrame, specs: Sequence[FrameSpec], trainers: dict[str, Trainer], repeats: int = 1, seed: int = names.SPLIT_SEED, at_once: int = 3
) -> DataFrame:
    """Metric rows (scheme, model, repeat, split, n, MAE, RMSE, R) of all combinations.

    The runs are done here, several at once, and their few rows read back; if one fails,
    so does the call. Persist ``base`` before calling.
    """
    spark = base.sparkSession
    path = scratch_path(spark, "experiments")
    failed = run_resumable(base, specs, trainers, path, repeats, seed, at_once)
    if failed:
        raise RuntimeError(f"failed runs: {failed}")
    texts = F.create_map(*[F.lit(text) for spec in specs for text in (spec.code, spec.description)]) if specs else F.lit(None)
    described = F.element_at(texts, F.col("scheme")) if specs else texts.cast("string")
    return finished_runs(spark, path).select("scheme", described.alias("scheme_desc"), "model", "repeat", "split", "n", "MAE", "RMSE", "R")


RUN = ["scheme", "model", "repeat"]
#: Base rows for each core of the cluster beyond which a fit keeps all cores and their memory busy by itself.
SHARED_ROWS = 100_000


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of the runs under a folder that have ended; none before the first."""
    schema = "split string, n long, MAE double, RMSE double, R double, scheme string, model string, repeat int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ended_runs(spark: SparkSession, path: str) -> set[tuple[str, str, int]]:
    """Runs under a folder that have ended, told by their files: a scheme without rows leaves a file without rows."""
    schema = "path string, modificationTime timestamp, length long, content binary, scheme string, model string, repeat int"
    try:
        files = spark.read.schema(schema).format("binaryFile").load(f"{path}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {tuple(r) for r in files.select(*RUN).distinct().collect()}


def run_resumable(
    base: DataFrame, specs: Sequence[FrameSpec], trainers: dict[str, Trainer], path: str, repeats: int = 1, seed: int = names.SPLIT_SEED, at_once: int = 3
) -> dict[tuple[str, str, int], str]:
    """Runs of ``run_experiments`` that have not ended yet, several at once; returns the errors of those that failed.

    The runs of a spec share its frame, kept from its first run to its last. Up to ``at_once`` fits share the cluster, each in a scheduler pool of its own (they take turns fairly where the
    application schedules so). A base of more than ``SHARED_ROWS`` rows a core is fitted one run at a time: the kept rows
    of several such fits would push each other out of memory. A run's few rows are one file, written when it has ended, so whatever stops
    the application, the next call does the runs that are missing and no other; a failure stops no other run.
    A scheme may keep no row at all: its runs end without metric rows and without a call of the trainer.
    Read the results with ``finished_runs``. Persist ``base`` before calling.
    """
    spark = base.sparkSession
    done = ended_runs(spark, path)
    asked = [(spec, name, repeat) for spec in specs for repeat in range(1, repeats + 1) for name in trainers]
    missing = [(spec, name, repeat) for spec, name, repeat in asked if (spec.code, name, repeat) not in done]
    left = Counter(spec.code for spec, _, _ in missing)
    kept, lock = {}, Lock()

    def frame_of(spec: FrameSpec) -> DataFrame:
        with lock:
            if spec.code not in kept:
                kept[spec.code] = experiment_frame(base, spec, seed).persist(StorageLevel.MEMORY_AND_DISK)
            return kept[spec.code]

    def ended(spec: FrameSpec) -> None:
        with lock:
            left[spec.code] -= 1
            if not left[spec.code] and spec.code in kept:
                kept.pop(spec.code).unpersist()

    def one(spec: FrameSpec, name: str, repeat: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{spec.code}-{name}-{repeat}")
        try:
            frame = frame_of(spec)
            if frame.isEmpty():
                predicted = frame.withColumn("lfmc_pred", F.lit(None).cast("double"))
            else:
                predicted = trainers[name](frame, numeric_columns(base, spec), spec.category, seed + repeat - 1)
            rows = metrics.regression_metrics(predicted, ["split"], "lfmc_pct", "lfmc_pred").select("split", "n", "MAE", "RMSE", "R")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/scheme={spec.code}/model={name}/repeat={repeat}")
        finally:
            ended(spec)

    if missing and base.count() > SHARED_ROWS * spark.sparkContext.defaultParallelism:
        at_once = 1
    failed = {}
    with ThreadPoolExecutor(max_workers=at_once) as workers:
        running = {
            workers.submit(inheritable_thread_target(spark)(one), spec, name, repeat): (spec.code, name, repeat)
            for spec, name, repeat in missing
        }
        for future, run in running.items():
            error = future.exception()
            if error is not None:
                failed[run] = f"{type(error).__name__}: {error}"
    return failed


def with_agreement(base: DataFrame, seed: int = names.SPLIT_SEED) -> DataFrame:
    """Base rows with split and the label/class agreement flag."""
    return splits.spatial_split(base, seed).withColumn("is_consistent", F.col("igbp_to_lc_dom").eqNullSafe(F.col("lc_dom")))


def temporal_samples(frame: DataFrame, steps: int = names.WINDOW_STEPS, columns: Sequence[str] = tuple(names.WINDOW_DYNAMIC), **options) -> DataFrame:
    keyed = frame.withColumn("site_key", windows.site_key())
    return windows.observation_windows(keyed, columns, steps, ["site_key"], ["date", "sample_id"], **options)


def block_window_counts(frame: DataFrame, samples: DataFrame) -> DataFrame:
    """Blocks of the frame with their number of window samples per split."""
    counted = samples.groupBy("block_id", "split").agg(F.count(F.lit(1)).alias("n_window_samples"))
    blocks = frame.select("block_id", "block_lat", "block_lon").distinct()
    return splits.with_block_geometry(blocks.join(counted, ["block_id"], "inner"))


def temporal_coverage(samples: DataFrame) -> DataFrame:
    """Windows, sites and blocks per split.

    Distinct (site, block) pairs are counted first, so the two distinct counts
    work on small inputs.
    """
    pairs = samples.groupBy("split", "site_key", "block_id").agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy("split").agg(
        F.sum("__n").alias("n_window_samples"),
        F.count_distinct("site_key").alias("n_sites"),
        F.count_distinct("block_id").alias("n_blocks"),
    )


def samples_per_site(samples: DataFrame) -> DataFrame:
    return samples.groupBy("site_key", "split").agg(F.count(F.lit(1)).alias("n_samples"))


__all__ = [
    "block_window_counts", "run_experiments", "samples_per_site", "temporal_coverage", "temporal_samples",
    "tree_trainer", "with_agreement",
]
