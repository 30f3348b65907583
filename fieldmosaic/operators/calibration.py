"""Long band tables and the per-band scale of the forward model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import microwave, values
from . import metrics, scale

BAND_COLUMNS = {"C": "tau_c_h", "X": "tau_x_h", "Ku": "tau_ku_h"}


def bands_to_long(
    df: DataFrame, keep: Sequence[str], bands: dict[str, str] | None = None, target: str = "lfmc_pct", height: str = "canopy_height"
) -> DataFrame:
    """One row per (sample, band) with a value; samples need target and height.

    A sample without any band vanishes with its last missing band, so no
    separate test is needed.
    """
    bands = bands or BAND_COLUMNS
    ready = df.dropna(subset=[target, height]).select(*keep, target, height, *[F.col(c).alias(b) for b, c in bands.items()])
    long = ready.unpivot([*keep, target, height], list(bands), "band", "vod_obs")
    return long.where(F.col("vod_obs").isNotNull())


def positive_height(df: DataFrame, height: str = "canopy_height") -> DataFrame:
    return df.where(F.col(height) > 0)


def scale_targets(long: DataFrame, lfmc: str = "lfmc_pct", cover: str = "vegf", height: str = "canopy_height") -> DataFrame:
    """Observed over modelled depth per row; NULL where the model value vanishes.

    Quantiles and counts skip NULL, so the rows stay: a filter would be pushed
    below the chain and evaluate it twice.
    """
    modelled = microwave.with_forward_depth(long, lfmc, cover, height, "band", "base_term")
    ratio = F.when(F.col("base_term") > 1e-8, F.col("vod_obs") / F.col("base_term"))
    return modelled.withColumn("eta_target", ratio)


def band_scale(targets: DataFrame, key: str = "band", large_groups: bool = False) -> DataFrame:
    """Per band: 1 % and 99 % quantile of the ratio and the median of the clipped ratio.

    Clipping at quantiles around the middle leaves the median as it is.
    """
    wanted = {"eta_lo": ("eta_target", 0.01), "eta_hi": ("eta_target", 0.99), "eta": ("eta_target", 0.5)}
    return scale.group_quantiles(targets, [key], wanted, [F.count("eta_target").alias("n")], large_groups)


def predict_depth(
    long: DataFrame, eta: DataFrame, lfmc: str = "lfmc_pct", cover: str = "vegf", height: str = "canopy_height", key: str = "band"
) -> DataFrame:
    """Modelled depth with the fitted scale, never below 0."""
    scaled = long.join(eta.select(key, F.greatest("eta", F.lit(1e-6)).alias("eta_h")), [key], "left")
    modelled = microwave.with_forward_depth(scaled, lfmc, cover, height, "band", "base_term")
    return modelled.withColumn("vod_hat", values.clip(F.col("eta_h") * F.col("base_term"), 0.0)).drop("base_term")


def fit_and_score(long: DataFrame, train_split: str = "train") -> DataFrame:
    """Fit the scale on one split, attach predictions, and report errors per split and band.

    A band holds a third of all rows, nearly all with a ratio of their own, so the scale is
    taken through ordered slices.
    """
    eta = band_scale(scale_targets(long.where(F.col("split") == train_split)), large_groups=True)
    predicted = predict_depth(long, eta)
    return metrics.regression_metrics(predicted, ["split", "band"], "vod_obs", "vod_hat")
