"""Preprocessing and models with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import names
from ..session import reliable_checkpoints
from . import scale


# --- standardisation --------------------------------------------------------
def feature_statistics(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``mean_*`` and ``std_*`` of the training rows; a zero deviation becomes 1."""
    picks = []
    for c in columns:
        deviation = F.stddev_samp(c)
        picks += [F.avg(c).alias(f"mean_{c}"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"std_{c}")]
    return train.agg(*picks)


def _one_row(statistics: DataFrame) -> dict[str, float | None]:
    """A one-row aggregate as literals: its width is the number of features."""
    return statistics.first().asDict()


def standardise(df: DataFrame, columns: Sequence[str], statistics: DataFrame, bands: Sequence[str] = tuple(names.BANDS)) -> DataFrame:
    """``(x - mean) / std`` with the training statistics; missing bands become 0, the training mean."""
    known = _one_row(statistics)
    scaled = {}
    for c in columns:
        value = (F.col(c) - F.lit(known[f"mean_{c}"])) / F.lit(known[f"std_{c}"])
        scaled[c] = F.coalesce(value, F.lit(0.0)) if c in bands else value
    return df.withColumns(scaled)


def non_finite_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with the number of missing or non-finite values."""
    bad = [
        F.coalesce(F.sum(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1).otherwise(0)), F.lit(0)).alias(c)
        for c in columns
    ]
    return df.agg(*bad).unpivot([], list(columns), "column_name", "n_bad")


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = non_finite_cells(df, columns).agg(F.sum("n_bad")).first()[0]
    if bad:
        raise ValueError(f"{bad} feature cells are missing or not finite")
    return df


def sequence_statistics(train: DataFrame, columns: Sequence[str], sequence: str = "dyn_seq") -> DataFrame:
    """Mean and population deviation per feature over all samples and steps."""
    steps = train.select(F.explode(sequence).alias("step"))
    picks = []
    for i, c in enumerate(columns):
        value = F.col("step").getItem(i)
        deviation = F.stddev_pop(value)
        picks += [F.avg(value).alias(f"mean_{c}"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"std_{c}")]
    return steps.agg(*picks)


def standardise_sequences(df: DataFrame, columns: Sequence[str], statistics: DataFrame, sequence: str = "dyn_seq", bands: Sequence[str] = tuple(names.BANDS)) -> DataFrame:
    known = _one_row(statistics)

    def one_step(step: Column) -> Column:
        scaled = []
        for i, c in enumerate(columns):
            value = (step.getItem(i) - F.lit(known[f"mean_{c}"])) / F.lit(known[f"std_{c}"])
            scaled.append(F.coalesce(value, F.lit(0.0)) if c in bands else value)
        return F.array(*scaled)

    return df.withColumn(sequence, F.transform(sequence, one_step))


# --- labels -----------------------------------------------------------------
def label_ids(train: DataFrame, column: str) -> DataFrame:
    """Sorted distinct training labels with ids 0..n-1, by a row number that is never one task."""
    labels = train.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    return scale.row_index(labels, [column], "label_id")


def encode_labels(df: DataFrame, column: str, ids: DataFrame, out: str | None = None) -> DataFrame:
    """Label ids; labels the training rows do not have get id n."""
    unknown = ids.count()
    coded = df.join(ids, [column], "left").withColumn("label_id", F.coalesce("label_id", F.lit(unknown)))
    return coded.withColumnRenamed("label_id", out) if out else coded


def fill_bands(df: DataFrame, bands: Sequence[str] = tuple(names.BANDS)) -> DataFrame:
    return df.fillna(0.0, subset=[b for b in bands if b in df.columns])


# --- trees ------------------------------------------------------------------
def tree_pipeline(
    numeric: Sequence[str],
    category: str | None = None,
    label: str = "lfmc_pct",
    loss: str = "absolute",
    weight: str | None = None,
    validation: str | None = None,
    iterations: int = 3000,
    rate: float = 0.03,
    depth: int = 8,
    seed: int = names.SPLIT_SEED,
    max_bins: int = 64,
) -> Pipeline:
    """Boosted trees over numeric columns and one optional category.

    ``validation`` names a boolean column; its rows stop the boosting early.
    """
    stages, inputs = [], list(numeric)
    if category:
        stages.append(StringIndexer(inputCol=category, outputCol=f"{category}_id", stringOrderType="alphabetAsc", handleInvalid="keep"))
        inputs.append(f"{category}_id")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    options = {"weightCol": weight} if weight else {}
    if validation:
        options["validationIndicatorCol"] = validation
    stages.append(
        GBTRegressor(
            labelCol=label, featuresCol="features", predictionCol="lfmc_pred", lossType=loss,
            maxIter=iterations, stepSize=rate, maxDepth=depth, maxBins=max_bins, seed=seed, **options,
        )
    )
    return Pipeline(stages=stages)


def enough_rows(rows: DataFrame, category: str | None, learned: Column, bins: int = 64) -> DataFrame:
    """Rows whose ``learned`` ones are repeated if they are fewer than the category has values.

    Spark's trees ask for a row per value and one for unknown values. As all learned rows are repeated as often,
    means and splits are those of the rows themselves.
    """
    few = len(rows.where(learned).select(F.lit(1)).take(bins)) if category else 0
    if not 0 < few < bins or rows.select(category).distinct().count() < few:
        return rows
    copies = F.when(learned, -(-bins // few)).otherwise(1)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")


@contextmanager
def kept_rows(df: DataFrame) -> Iterator[DataFrame]:
    """Train and val rows with filled bands, kept unless the caller keeps ``df`` itself."""
    used = fill_bands(df.where(F.col("split").isin("train", "val")))
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield used
        return
    used.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield used
    finally:
        used.unpersist()


def fit_trees(df: DataFrame, numeric: Sequence[str], category: str | None = None, **options) -> PipelineModel:
    """Fit on train rows; val rows, when present, only stop the boosting.

    The rows are kept while the model is fitted, and the boosting cuts its lineage
    in the shared checkpoint folder every ``checkpointInterval`` (10) trees.
    """
    reliable_checkpoints(df.sparkSession)
    with kept_rows(df) as used:
        rows = used
        if options.get("validation") is None:
            if used.where(F.col("split") == "val").isEmpty():
                rows = used.where(F.col("split") == "train")
            else:
                rows = used.withColumn("is_validation", F.col("split") == "val")
                options["validation"] = "is_validation"
        learned = ~F.col(options["validation"]) if options.get("validation") else F.lit(True)
        rows = enough_rows(rows, category, learned, options.get("max_bins", 64))
        return tree_pipeline(numeric, category, **options).fit(rows)


@dataclass(frozen=True)
class Boosted:
    """A model cut to its best number of trees, and the validation error after each tree up to the stop."""

    model: PipelineModel
    trees: int
    errors: tuple[float, ...]


def best_prefix(errors: Sequence[float], patience: int) -> tuple[int, int | None]:
    """How many trees have the lowest error, and after how many the wait for a lower one ends (None: not yet).

    Of equal errors the earlier counts; trees after the end are not looked at.
    """
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, i + 1
    return best + 1, None


def staged_errors(model: PipelineModel, rows: DataFrame, loss: str = "absolute") -> list[float]:
    """Mean loss on some rows after each tree, by one pass over the rows."""
    prepared = PipelineModel(model.stages[:-1]).transform(rows)
    return model.stages[-1].evaluateEachIteration(prepared, loss)


def first_trees(model: PipelineModel, trees: int) -> PipelineModel:
    """The model with its first trees only; the trees themselves are not fitted again."""
    whole = model.stages[-1]
    gateway = SparkSession.getActiveSession().sparkContext._gateway
    kind = gateway.jvm.org.apache.spark.ml.regression
    picked = gateway.new_array(kind.DecisionTreeRegressionModel, trees)
    weights = gateway.new_array(gateway.jvm.double, trees)
    for i, (tree, weight) in enumerate(zip(whole._java_obj.trees(), whole.treeWeights)):
        if i < trees:
            picked[i], weights[i] = tree, weight
    cut = GBTRegressionModel(kind.GBTRegressionModel(f"{whole.uid}_{trees}", picked, weights, whole.numFeatures))
    cut._resetUid(f"{whole.uid}_{trees}")
    cut.setFeaturesCol(whole.getFeaturesCol()).setPredictionCol(whole.getPredictionCol())
    return PipelineModel([*model.stages[:-1], cut])


def fit_best_trees(
    df: DataFrame, numeric: Sequence[str], category: str | None = None, iterations: int = 3000, patience: int = 150, loss: str = "absolute", **options
) -> Boosted:
    """Fit on train rows until the error on val rows has not fallen for ``patience`` trees, and keep the best number of trees.

    Spark's boosting can't wait, nor go on from a fitted model. So a number of trees is fitted, the error
    after each is taken, and the number is doubled while the wait has not ended. A longer fit repeats the trees of
    a shorter one, so the result is that of one long fit that stops, at twice its work at most. Without val rows
    all ``iterations`` trees are kept; rows of other splits are not used.
    """
    reliable_checkpoints(df.sparkSession)
    with kept_rows(df) as used:
        train, val = used.where(F.col("split") == "train"), used.where(F.col("split") == "val")
        train = enough_rows(train, category, F.lit(True), options.get("max_bins", 64))
        waits = not val.isEmpty()
        trees = min(iterations, 2 * patience) if waits else iterations
        while True:
            model = tree_pipeline(numeric, category, loss=loss, iterations=trees, **options).fit(train)
            if not waits:
                return Boosted(model, trees, ())
            errors = staged_errors(model, val, loss)
            best, stop = best_prefix(errors, patience)
            if stop is not None or trees >= iterations or len(errors) < trees:
                return Boosted(first_trees(model, best), best, tuple(errors[:stop]))
            trees = min(iterations, 2 * trees)


def score(model: PipelineModel, df: DataFrame, valid: Column, out: str = "lfmc_pred") -> DataFrame:
    """Predictions on the valid rows, NULL on the others, in one pass over the input.

    Missing inputs are filled so that every row can be assembled; the originals
    are what is returned.
    """
    assembler = next(stage for stage in model.stages if isinstance(stage, VectorAssembler))
    inputs = [c for c in assembler.getInputCols() if c in df.columns]
    marked = df.withColumns({"__valid": F.coalesce(valid, F.lit(False)), **{f"__in_{c}": F.col(c) for c in inputs}})
    ready = marked.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in inputs})
    scored = model.transform(ready)
    columns = [F.col(f"__in_{c}").alias(c) if c in inputs else F.col(c) for c in df.columns if c != out]
    return scored.select(*columns, F.when(F.col("__valid"), F.col(out)).alias(out))


def save_artifact(model: PipelineModel, path: str, model_name: str, numeric: Sequence[str], category: str | None) -> None:
    """Model plus a small JSON description next to it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    text = json.dumps({"model_name": model_name, "numeric": list(numeric), "category": category})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_artifact(spark, path: str, model_name: str) -> tuple[PipelineModel, dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about["model_name"] != model_name:
        raise ValueError(f"artifact holds {about['model_name']}, not {model_name}")
    return PipelineModel.load(f"{path}/model"), about
