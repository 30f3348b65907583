"""Raster statistics, metrics, summaries and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.functions import qcbits, values
from fieldmosaic.operators import calibration, metrics, modeling, rasters, splits
from fieldmosaic.plans import experiments, frames

from . import twins
from .registry import query, rounded, rounded_doubles

_FLAG = """CASE WHEN qc_raw & 255 = 255 THEN 6 WHEN qc_raw & 16 <> 0 THEN 5 WHEN (qc_raw >> 2) & 3 = 2 THEN 4 WHEN (qc_raw >> 2) & 3 = 1 THEN 3
                WHEN qc_raw & 2 <> 0 THEN 2 WHEN qc_raw & 1 <> 0 THEN 1 ELSE 0 END"""


@query(
    "ag10_flag_counts",
    f"SELECT {_FLAG} AS flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM fx_grid_daily), 9) AS ratio FROM fx_grid_daily GROUP BY 1",
    ["fx_grid_daily"],
)
def _(x):
    flagged = x.fx_grid_daily.withColumn("flag", qcbits.priority_flag("qc_raw"))
    return rounded(rasters.flag_counts(flagged), "ratio", digits=9)


@query(
    "ag10_band_statistics",
    f"""SELECT count(*) AS n_cells, count(v) AS n_valid, round(count(v) / count(*), 9) AS valid_ratio, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean_value
        FROM (SELECT CASE WHEN {_FLAG} = 0 THEN tau_ku_h END AS v FROM fx_grid_daily)""",
    ["fx_grid_daily"],
)
def _(x):
    made = rasters.band_statistics(x.fx_grid_daily, "tau_ku_h", qcbits.priority_flag("qc_raw"))
    return rounded(made.withColumn("valid_ratio", F.round("valid_ratio", 9)), "mean_value")


@query(
    "ag11_missing_ratios",
    "SELECT column_name, missing_ratio FROM (SELECT round(avg(CAST(tau_ku_h IS NULL AS INT)), 9) AS tau_ku_h, round(avg(CAST(rain IS NULL AS INT)), 9) AS rain, 0.0 AS tau_x_h FROM fx_grid_daily) UNPIVOT (missing_ratio FOR column_name IN (tau_ku_h, rain, tau_x_h))",
    ["fx_grid_daily"],
)
def _(x):
    return rounded(rasters.missing_ratios(x.fx_grid_daily, ["tau_ku_h", "rain", "tau_x_h"]), "missing_ratio", digits=9)


@query(
    "ag11_raster_statistics",
    "SELECT date, round(avg(CAST(tau_ku_h IS NULL AS INT)), 9) AS missing_ratio, min(tau_ku_h) AS min_value, round(median(tau_ku_h), 8) AS median_value, max(tau_ku_h) AS max_value FROM fx_grid_daily GROUP BY date",
    ["fx_grid_daily"],
)
def _(x):
    made = metrics.raster_statistics(x.fx_grid_daily, "tau_ku_h", ["date"])
    return made.withColumns({"missing_ratio": F.round("missing_ratio", 9), "median_value": F.round("median_value", 8)})


@query(
    "ag12_block_mean",
    """SELECT CAST(floor(row / 2) AS INT) AS row, CAST(floor(col / 2) AS INT) AS col, round(avg(v), 6) AS value
       FROM (SELECT row, col, CASE WHEN raw_value <> 255 THEN raw_value * 0.01e0 END AS v FROM fx_pixels WHERE row < 198 AND col < 98) GROUP BY 1, 2""",
    ["fx_pixels"],
)
def _(x):
    valid = x.fx_pixels.select("row", "col", values.repair_raw("raw_value", "land_cover").alias("value"))
    return rounded(rasters.block_mean(valid, ["value"], 2, size=(199, 99)), "value")


_TILES = """t AS (SELECT CAST(l_suppkey % 7 AS INT) AS tile, l_orderkey * 10 + l_linenumber AS pixel_no, (l_partkey % 60) / 40.0 + 10 AS lat, (l_suppkey % 50) / 40.0 + 20 AS lon,
                     CASE WHEN l_quantity > 25 THEN l_quantity END AS forest, CASE WHEN l_discount > 0.04 THEN l_extendedprice END AS herb FROM lineitem)"""


@query(
    "ag13_mosaic",
    f"""WITH {_TILES}, u AS (SELECT tile, pixel_no, lat, lon, max(forest) AS forest, max(herb) AS herb FROM t GROUP BY 1, 2, 3, 4),
        p AS (SELECT *, CAST(round((89.95e0 - lat) / 0.1e0) AS INT) AS row, CAST(round((lon + 179.95e0) / 0.1e0) AS INT) AS col FROM u)
        SELECT row, col, arg_min(forest, CASE WHEN forest IS NOT NULL THEN (tile, -pixel_no) END) AS forest, arg_min(herb, CASE WHEN herb IS NOT NULL THEN (tile, -pixel_no) END) AS herb
        FROM p GROUP BY row, col""",
)
def _(x):
    raw = x.table("lineitem").select(
        (F.col("l_suppkey") % 7).cast("int").alias("tile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pixel_no"),
        ((F.col("l_partkey") % 60) / 40 + 10).alias("lat"), ((F.col("l_suppkey") % 50) / 40 + 20).alias("lon"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("forest"),
        F.when(F.col("l_discount") > 0.04, F.col("l_extendedprice")).alias("herb"),
    )
    pixels = raw.groupBy("tile", "pixel_no", "lat", "lon").agg(F.max("forest").alias("forest"), F.max("herb").alias("herb"))
    return rasters.mosaic(pixels, ["forest", "herb"])


_ERR = "count(*) AS n, round(avg(abs(y_hat - y)), 6) AS MAE, round(sqrt(avg((y_hat - y) * (y_hat - y))), 6) AS RMSE"


@query("ag14_regression_metrics", f"SELECT split, {_ERR}, round(corr(y, y_hat), 6) AS R FROM fx_pred GROUP BY split", ["fx_pred"])
def _(x):
    return rounded_doubles(metrics.regression_metrics(x.fx_pred, ["split"]))


@query(
    "ag15_metrics_with_r2",
    f"SELECT grp, {_ERR}, round(1 - sum((y_hat - y) * (y_hat - y)) / nullif(var_pop(y) * count(*), 0), 6) AS R2 FROM fx_pred GROUP BY grp",
    ["fx_pred"],
)
def _(x):
    return rounded_doubles(metrics.regression_metrics(x.fx_pred, ["grp"], measures=["n", "MAE", "RMSE", "R2"]))


@query(
    "ag16_group_and_overall",
    f"""SELECT split, CASE WHEN grouping(grp) = 1 THEN 'Overall' ELSE coalesce(grp, 'NA') END AS grp, CASE WHEN grouping(grp) = 1 THEN 'Overall' ELSE 'Group' END AS level, {_ERR},
        round(1 - sum((y_hat - y) * (y_hat - y)) / nullif(var_pop(y) * count(*), 0), 6) AS R2
        FROM (SELECT * REPLACE (CASE WHEN grp = 'A' THEN NULL ELSE grp END AS grp) FROM fx_pred) GROUP BY GROUPING SETS ((split), (split, grp))""",
    ["fx_pred"],
)
def _(x):
    holed = x.fx_pred.withColumn("grp", F.when(F.col("grp") != "A", F.col("grp")))
    return rounded_doubles(metrics.metrics_with_overall(holed, "split", "grp"))


@query(
    "ag17_repeat_summary",
    """SELECT scheme, model, split, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std, round(avg(rmse * 2), 6) AS mae_mean, round(stddev_samp(rmse * 2), 6) AS mae_std
       FROM fx_runs GROUP BY ALL""",
    ["fx_runs"],
)
def _(x):
    runs = x.fx_runs.withColumn("mae", F.col("rmse") * 2)
    return rounded_doubles(metrics.repeat_summary(runs, measures=["rmse", "mae"]))


_AGREE = f"""{twins.base(names.CORE_FEATURES)}, b AS (SELECT *, {twins.BLOCK} AS block_id, coalesce(igbp_to_lc_dom = lc_dom, false) AS ok FROM base),
    {twins.split_of('b', 's')}, f AS (SELECT * FROM b JOIN s_blocks USING (block_id))"""


def _agreement(x):
    return experiments.with_agreement(frames.training_base(x.fx_predictors))


@query(
    "ag18_consistency_summary",
    f"""WITH {_AGREE} SELECT split, count(*) AS n_total, count(*) FILTER (ok) AS n_consistent, count(*) FILTER (NOT ok) AS n_inconsistent,
        round(count(*) FILTER (ok) / count(*), 9) AS consistent_ratio, round(count(*) FILTER (NOT ok) / count(*), 9) AS inconsistent_ratio,
        round(avg(lfmc_pct), 6) AS lfmc_mean_total, round(avg(lfmc_pct) FILTER (ok), 6) AS lfmc_mean_consistent, round(avg(lfmc_pct) FILTER (NOT ok), 6) AS lfmc_mean_inconsistent,
        round(stddev_samp(lfmc_pct), 6) AS lfmc_std_total, round(stddev_samp(lfmc_pct) FILTER (ok), 6) AS lfmc_std_consistent, round(stddev_samp(lfmc_pct) FILTER (NOT ok), 6) AS lfmc_std_inconsistent
        FROM f GROUP BY split""",
    ["fx_predictors"],
)
def _(x):
    made = metrics.consistency_summary(_agreement(x))
    ratios = {c: F.round(c, 9) for c in ("consistent_ratio", "inconsistent_ratio")}
    return rounded(made.withColumns(ratios), *[c for c in made.columns if c.startswith("lfmc")])


@query(
    "ag19_consistency_by_class",
    f"WITH {_AGREE} SELECT split, igbp_label, lc_dom, ok AS is_consistent, count(*) AS n, round(avg(lfmc_pct), 6) AS lfmc_mean, round(stddev_samp(lfmc_pct), 6) AS lfmc_std FROM f GROUP BY ALL",
    ["fx_predictors"],
)
def _(x):
    return rounded(metrics.grouped_moments(_agreement(x), ["split", "igbp_label", "lc_dom", "is_consistent"]), "lfmc_mean", "lfmc_std")


@query(
    "ag19_consistency_by_kind",
    f"WITH {_AGREE} SELECT split, FT, ok AS is_consistent, count(*) AS n, round(avg(lfmc_pct), 6) AS lfmc_mean, round(stddev_samp(lfmc_pct), 6) AS lfmc_std FROM f GROUP BY ALL",
    ["fx_predictors"],
)
def _(x):
    return rounded(metrics.grouped_moments(_agreement(x), ["split", "FT", "is_consistent"]), "lfmc_mean", "lfmc_std")


_SPLIT = f"b AS (SELECT *, {twins.BLOCK} AS block_id FROM fx_predictors), {twins.split_of('b', 's')}, f AS (SELECT * FROM b JOIN s_blocks USING (block_id))"


@query(
    "ag20_feature_statistics",
    f"""WITH {_SPLIT} SELECT round(avg(LAI), 6) AS mean_LAI, round(stddev_samp(LAI), 6) AS std_LAI, round(avg(VOD_Ku_Hpol_Asc), 6) AS mean_VOD_Ku_Hpol_Asc,
        round(stddev_samp(VOD_Ku_Hpol_Asc), 6) AS std_VOD_Ku_Hpol_Asc FROM f WHERE split = 'train'""",
    ["fx_predictors"],
)
def _(x):
    train = splits.spatial_split(x.fx_predictors).where("split = 'train'")
    return rounded_doubles(modeling.feature_statistics(train, ["LAI", "VOD_Ku_Hpol_Asc"]))


_SEQUENCES = """w AS (SELECT *, list([VOD_Ku_Hpol_Asc, LST]) OVER (PARTITION BY lat, lon ORDER BY date, sample_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS dyn_seq
       FROM (SELECT sample_id, date, lat, lon, LST, VOD_Ku_Hpol_Asc FROM fx_predictors)), s AS (SELECT sample_id, dyn_seq FROM w WHERE len(dyn_seq) = 4),
     steps AS (SELECT sample_id, unnest(dyn_seq) AS step FROM s)"""


def sequences(x):
    return experiments.temporal_samples(x.fx_predictors, 4, ["VOD_Ku_Hpol_Asc", "LST"])


@query(
    "ag21_sequence_statistics",
    f"""WITH {_SEQUENCES} SELECT round(avg(step[1]), 6) AS mean_VOD_Ku_Hpol_Asc, round(stddev_pop(step[1]), 6) AS std_VOD_Ku_Hpol_Asc,
        round(avg(step[2]), 6) AS mean_LST, round(stddev_pop(step[2]), 6) AS std_LST FROM steps""",
    ["fx_predictors"],
)
def _(x):
    return rounded_doubles(modeling.sequence_statistics(sequences(x), ["VOD_Ku_Hpol_Asc", "LST"]))


@query(
    "ag22_band_scale",
    """SELECT band, count(*) AS n, round(quantile_cont(r, 0.01), 6) AS eta_lo, round(quantile_cont(r, 0.99), 6) AS eta_hi, round(median(r), 6) AS eta
       FROM (SELECT l_returnflag AS band, l_extendedprice / l_quantity / 100 AS r FROM lineitem) GROUP BY band""",
)
def _(x):
    targets = x.table("lineitem").select(
        F.col("l_returnflag").alias("band"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("eta_target")
    )
    return rounded_doubles(calibration.band_scale(targets))


@query(
    "ag22_band_scale_sliced",
    """SELECT band, count(*) AS n, round(quantile_cont(r, 0.01), 6) AS eta_lo, round(quantile_cont(r, 0.99), 6) AS eta_hi, round(median(r), 6) AS eta
       FROM (SELECT l_returnflag AS band, l_extendedprice / l_quantity / 100 AS r FROM lineitem) GROUP BY band""",
)
def _(x):
    """The same with every band taken through ordered slices."""
    targets = x.table("lineitem").select(
        F.col("l_returnflag").alias("band"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("eta_target")
    )
    return rounded_doubles(calibration.band_scale(targets, large_groups=True))


@query(
    "ag24_present_sum",
    "SELECT date, row, col, CASE WHEN coalesce(tau_ku_h, rain) IS NULL THEN NULL ELSE round(coalesce(tau_ku_h, 0) + coalesce(rain, 0), 6) END AS total FROM fx_grid_daily",
    ["fx_grid_daily"],
)
def _(x):
    return x.fx_grid_daily.select("date", "row", "col", F.round(values.sum_present(["tau_ku_h", "rain"]), 6).alias("total"))


@query(
    "ag25_weighted_mae",
    "SELECT split, round(sum(l_linenumber * abs(y_hat - y)) / greatest(sum(l_linenumber), 1e-8), 6) AS weighted_mae FROM fx_pred GROUP BY split",
    ["fx_pred"],
)
def _(x):
    return rounded(metrics.weighted_mae(x.fx_pred, "l_linenumber", keys=["split"]), "weighted_mae")


_DESCRIBE = """count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 5) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
       round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(median(o_totalprice), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75 FROM orders"""


@query("ag26_describe", f"SELECT {_DESCRIBE}")
def _(x):
    return rounded_doubles(rounded(metrics.describe(x.table("orders"), "o_totalprice"), "std", digits=5))


@query("ag26_describe_by_group_sliced", f"SELECT o_orderstatus, {_DESCRIBE} GROUP BY o_orderstatus")
def _(x):
    made = metrics.describe(x.table("orders"), "o_totalprice", ["o_orderstatus"], large_groups=True)
    return rounded_doubles(rounded(made, "std", digits=5))


@query(
    "ag26_approximate_quantiles",
    """SELECT grp, count(y) AS n, true AS median_within, true AS p99_within, true AS a_row_has_it FROM fx_pred GROUP BY grp
       UNION ALL SELECT 'all', count(y), true, true, true FROM fx_pred""",
    ["fx_pred"],
)
def _(x):
    """Median and 99th percentile by one pass, per group and overall, and whether their ranks are within the stated error."""
    wanted, error = {"median": 0.5, "p99": 0.99}, 0.001
    out = None
    for keys in (["grp"], []):
        found = metrics.approximate_quantiles(x.fx_pred, "y", wanted, keys, error)
        off = metrics.rank_errors(x.fx_pred, "y", found, wanted, keys).withColumnsRenamed({c: f"{c}_off" for c in wanted})
        both = found.join(off, keys) if keys else found.withColumn("grp", F.lit("all")).join(off.withColumn("grp", F.lit("all")), "grp")
        made = both.select("grp", "n", *[(F.col(f"{c}_off") <= error).alias(f"{c}_within") for c in wanted], F.col("median").isNotNull().alias("a_row_has_it"))
        out = made if out is None else out.unionByName(made)
    return out
