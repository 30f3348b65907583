"""Preprocessing and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.operators import align, calibration, modeling, rasters, splits, windows
from fieldmosaic.plans import frames, product
from fieldmosaic.session import scratch_path

from . import twins
from .aggregates import _SEQUENCES, _SPLIT, sequences
from .registry import query, rounded, rounded_doubles
from .splits import _long


def _split(x):
    return splits.spatial_split(x.fx_predictors)


def _scaled(c: str, band: bool) -> str:
    value = f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END"
    return f"round(coalesce({value}, 0), 6) AS {c}" if band else f"round({value}, 6) AS {c}"


_STATS = "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("LAI", "LST", "VOD_Ku_Hpol_Asc")
) + " FROM f WHERE split = 'train')"


@query(
    "ml1_standardise",
    f"WITH {_SPLIT}, {_STATS} SELECT sample_id, split, {_scaled('LAI', False)}, {_scaled('LST', False)}, {_scaled('VOD_Ku_Hpol_Asc', True)} FROM f, st",
    ["fx_predictors"],
)
def _(x):
    frame = _split(x).select("sample_id", "split", "LAI", "LST", "VOD_Ku_Hpol_Asc")
    columns = ["LAI", "LST", "VOD_Ku_Hpol_Asc"]
    return rounded_doubles(modeling.standardise(frame, columns, modeling.feature_statistics(frame.where("split = 'train'"), columns)))


@query(
    "ml2_standardise_sequences",
    f"""WITH {_SEQUENCES}, st AS (SELECT avg(step[1]) AS m1, stddev_pop(step[1]) AS s1, avg(step[2]) AS m2, stddev_pop(step[2]) AS s2 FROM steps)
        SELECT sample_id, list_transform(dyn_seq, lambda q: [round(coalesce((q[1] - m1) / s1, 0), 5), round((q[2] - m2) / s2, 5)]) AS dyn_seq FROM s, st""",
    ["fx_predictors"],
)
def _(x):
    made = sequences(x).select("sample_id", "dyn_seq")
    columns = ["VOD_Ku_Hpol_Asc", "LST"]
    scaled = modeling.standardise_sequences(made, columns, modeling.sequence_statistics(made, columns))
    return scaled.withColumn("dyn_seq", F.transform("dyn_seq", lambda step: F.transform(step, lambda v: F.round(v, 5))))


@query(
    "ml3_train_label_ids",
    f"""WITH {_SPLIT}, kinds AS (SELECT sample_id, split, CASE WHEN split <> 'train' AND sample_id % 5 = 0 THEN 'unseen' ELSE coalesce(FT, 'none') END AS kind FROM f),
        ids AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS id FROM (SELECT DISTINCT kind FROM kinds WHERE split = 'train'))
        SELECT sample_id, split, kind, coalesce(id, (SELECT count(*) FROM ids)) AS label_id FROM kinds LEFT JOIN ids USING (kind)""",
    ["fx_predictors"],
)
def _(x):
    unseen = (F.col("split") != "train") & (F.col("sample_id") % 5 == 0)
    kinds = _split(x).select("sample_id", "split", F.when(unseen, "unseen").otherwise(F.coalesce("FT", F.lit("none"))).alias("kind"))
    ids = modeling.label_ids(kinds.where("split = 'train'"), "kind")
    return modeling.encode_labels(kinds, "kind", ids)


@query(
    "ml4_all_label_ids",
    """SELECT sample_id, igbp_label, id AS label_id FROM fx_predictors JOIN (SELECT igbp_label, row_number() OVER (ORDER BY igbp_label) - 1 AS id FROM (SELECT DISTINCT igbp_label FROM fx_predictors)) USING (igbp_label)""",
    ["fx_predictors"],
)
def _(x):
    rows = x.fx_predictors.select("sample_id", "igbp_label")
    return modeling.encode_labels(rows, "igbp_label", modeling.label_ids(rows, "igbp_label"))


@query("ml5_zero_filled_bands", f"SELECT sample_id, LAI, {', '.join(f'coalesce({b}, 0) AS {b}' for b in names.BANDS)} FROM fx_predictors", ["fx_predictors"])
def _(x):
    return modeling.fill_bands(x.fx_predictors.select("sample_id", "LAI", *names.BANDS))


@query(
    "ml9_ensemble_mean",
    """SELECT date, row, col, round(coalesce((a.p + b.p) / 2, a.p, b.p), 9) AS lfmc_pred
       FROM (SELECT date, row, col, CASE WHEN qc_raw = 0 THEN tau_x_h END AS p FROM fx_grid_daily) a JOIN (SELECT date, row, col, tau_ku_h AS p FROM fx_grid_daily) b USING (date, row, col)""",
    ["fx_grid_daily"],
)
def _(x):
    grid = x.fx_grid_daily
    a = grid.select("date", "row", "col", F.when(F.col("qc_raw") == 0, F.col("tau_x_h")).alias("lfmc_pred"))
    return rounded(align.mean_of_two(a, grid.select("date", "row", "col", F.col("tau_ku_h").alias("lfmc_pred"))), "lfmc_pred", digits=9)


_CHAIN = """j AS (
  SELECT p.sample_id, p.lfmc_pct, s.canopy_height AS h, g.tau_c_h, g.tau_x_h, g.tau_ku_h, ((p.sample_id % 9) + 1) / 10.0 AS v,
         CASE p.sample_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split
  FROM fx_points p JOIN fx_static s ON s.row = p.row AND s.col = p.col JOIN fx_grid_daily g ON g.date = p.date AND g.row = p.row AND g.col = p.col
  WHERE s.canopy_height IS NOT NULL AND p.sample_id % 29 <> 0),
l AS (SELECT sample_id, split, lfmc_pct, h, v, band, vod_obs, hz, hz / 1e9 AS f FROM (
  SELECT *, 'C' AS band, tau_c_h AS vod_obs, 6.9e9 AS hz FROM j UNION ALL SELECT *, 'X', tau_x_h, 10.65e9 FROM j UNION ALL SELECT *, 'Ku', tau_ku_h, 18.7e9 FROM j) WHERE vod_obs IS NOT NULL),
w AS (SELECT *, 4.9 + 75 / (1 + (f / 18) * (f / 18)) AS fr, -75 * (f / 18) / (1 + (f / 18) * (f / 18)) AS fi, sqrt(f / 0.36) AS q,
             least(greatest(lfmc_pct / (lfmc_pct + 100), 0), 0.999999) AS m FROM l),
b AS (SELECT *, 2.9 + 55 * (1 + q) / ((1 + q) * (1 + q) + q * q) AS br, -55 * q / ((1 + q) * (1 + q) + q * q) AS bi FROM w),
e AS (SELECT *, 1.7 - 0.74 * m + 6.16 * m * m + greatest(m * (0.55 * m - 0.076), 0) * fr + 4.64 * m * m / (1 + 7.36 * m * m) * br AS vr,
             least(greatest(m * (0.55 * m - 0.076), 0) * fi + 4.64 * m * m / (1 + 7.36 * m * m) * bi, 0) AS vi FROM b),
t AS (SELECT *, 1 + v * (pow(sqrt(vr * vr + vi * vi), 1.0 / 3) * cos(atan2(vi, vr) / 3) - 1) AS tr, v * pow(sqrt(vr * vr + vi * vi), 1.0 / 3) * sin(atan2(vi, vr) / 3) AS ti FROM e),
c AS (SELECT *, tr * tr * tr - 3 * tr * ti * ti AS cr, 3 * tr * tr * ti - ti * ti * ti AS ci FROM t),
d AS (SELECT *, 4 * pi() * h / (299792458.0 / hz) * (-sqrt(sqrt(cr * cr + ci * ci)) * sin(atan2(ci, cr) / 2)) AS base FROM c),
eta AS (SELECT band, median(vod_obs / base) AS eta FROM d WHERE split = 'train' AND base > 1e-8 GROUP BY band),
p AS (SELECT d.*, greatest(greatest(eta.eta, 1e-6) * base, 0) AS vod_hat FROM d LEFT JOIN eta USING (band))"""


@query(
    "ml10_physics_fit_and_errors",
    f"""WITH {_CHAIN} SELECT split, band, count(*) AS n, round(avg(abs(vod_hat - vod_obs)), 4) AS MAE, round(sqrt(avg((vod_hat - vod_obs) * (vod_hat - vod_obs))), 4) AS RMSE, round(corr(vod_obs, vod_hat), 6) AS R
        FROM p GROUP BY split, band""",
    ["fx_points", "fx_grid_daily", "fx_static"],
)
def _(x):
    k = F.col("sample_id")
    split = F.when(k % 5 == 0, "test").when(k % 5 == 1, "val").otherwise("train")
    long = _long(x).withColumns({"vegf": (k % 9 + 1) / 10, "split": split})
    made = calibration.fit_and_score(long)
    return made.withColumns({"MAE": F.round("MAE", 4), "RMSE": F.round("RMSE", 4), "R": F.round("R", 6)})


# Tree counts are arguments; the queries fit few so that a run takes seconds.
_TREES = {"iterations": 5, "rate": 0.3, "depth": 4}
_FINAL_ROWS = f"""{twins.base(names.CORE_FEATURES_LITE)}, k AS (SELECT *, {twins.BLOCK} AS block_id FROM base WHERE igbp_to_lc_dom = lc_dom), {twins.split_of('k', 's')},
    final AS (SELECT * FROM k JOIN s_blocks USING (block_id))"""
_FINAL_MASK = "LAI IS NOT NULL AND LST IS NOT NULL AND Hveg IS NOT NULL AND lc_dom IS NOT NULL"
_SCORED = f"""SELECT sample_id, {_FINAL_MASK} AS scored FROM (SELECT *, CASE WHEN {twins.total(names.VEGETATION_CLASSES)} > 0 THEN {twins.argmax(names.VEGETATION_CLASSES)} END AS lc_dom FROM fx_predictors)"""


def _final(x):
    return frames.final_frame(x.fx_predictors)


_NUMERIC = names.BANDS + names.CORE_FEATURES_LITE + names.SEASON_FEATURES


def _against_constant(scored, target: str, constant: float, loss):
    """Per split: rows, and whether the model's mean loss is below that of one constant."""
    return scored.groupBy("split").agg(
        F.count("lfmc_pred").alias("n"),
        (F.avg(loss(F.col(target) - F.col("lfmc_pred"))) < F.avg(loss(F.col(target) - F.lit(constant)))).alias("better"),
    )


@query("ml6_absolute_loss_trees", f"WITH {_FINAL_ROWS} SELECT split, count(*) AS n, true AS better FROM final GROUP BY split", ["fx_predictors"])
def _(x):
    """Boosted trees with absolute loss, weights and early stopping against the training median."""
    frame = _final(x).withColumn("sample_weight", F.col("lat_norm") * 0 + 1)
    model = modeling.fit_trees(frame, _NUMERIC, "lc_dom", weight="sample_weight", **_TREES)
    middle = frame.where("split = 'train'").agg(F.percentile("lfmc_pct", F.lit(0.5))).first()[0]
    return _against_constant(model.transform(modeling.fill_bands(frame)), "lfmc_pct", middle, F.abs)


@query(
    "ml6_best_prefix_of_trees",
    f"""WITH {_FINAL_ROWS} SELECT split, count(*) AS n, true AS lowest_error_kept, true AS waited, CASE WHEN split = 'val' THEN true END AS no_worse,
        true AS as_staged FROM final GROUP BY split""",
    ["fx_predictors"],
)
def _(x):
    """Boosting that waits three trees for a lower validation error and keeps the best number of trees.

    ``lowest_error_kept``: no other number of trees up to the stop has a lower error; ``waited``: the stop is as
    many trees after it as the patience, or the last tree; ``no_worse``: its error is not above that of all trees,
    on the rows it was chosen by; ``as_staged``: the shortened model's own error is the one it was chosen for.
    """
    frame = _final(x)
    patience, most = 3, 12
    fitted = modeling.fit_best_trees(frame, _NUMERIC, "lc_dom", iterations=most, patience=patience, depth=4, rate=0.3)
    errors = fitted.errors
    ready = modeling.fill_bands(frame)
    scored = fitted.model.transform(ready).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("lfmc_pct") - F.col("lfmc_pred"))).alias("mae"))
    validated = F.col("split") == "val"
    lowest = errors[fitted.trees - 1] == min(errors) and errors.index(min(errors)) == fitted.trees - 1
    waited = len(errors) - fitted.trees == patience or len(errors) == most
    return scored.select(
        "split", "n", F.lit(lowest).alias("lowest_error_kept"), F.lit(waited).alias("waited"),
        F.when(validated, F.col("mae") <= errors[-1] + 1e-9).alias("no_worse"),
        F.when(validated, F.abs(F.col("mae") - errors[fitted.trees - 1]) < 1e-9).otherwise(True).alias("as_staged"),
    )


@query(
    "ml7_squared_loss_trees",
    f"""WITH {_FINAL_ROWS} SELECT 'lfmc_pct' AS target, split, count(*) AS n, true AS better FROM final GROUP BY split
        UNION ALL SELECT 'vegf', split, count(*), CASE WHEN split = 'train' THEN true END FROM final GROUP BY split
        UNION ALL SELECT 'eta_target', split, count(*), CASE WHEN split = 'train' THEN true END FROM final WHERE VOD_Ku_Hpol_Asc IS NOT NULL AND Hveg > 0 GROUP BY split""",
    ["fx_predictors"],
)
def _(x):
    """Boosted trees with squared loss for moisture, vegetation cover and band scale, against the training mean.

    Cover and scale have nothing to do with the predictors here, so only their training rows are compared.
    """
    k = F.col("sample_id")
    frame = _final(x).withColumns({"vegf": (k % 9 + 1) / 10, "band": F.lit("Ku"), "vod_obs": F.col("VOD_Ku_Hpol_Asc"), "canopy_height": F.col("Hveg")})
    scaled = calibration.scale_targets(calibration.positive_height(frame.where(F.col("vod_obs").isNotNull()))).where(F.col("eta_target").isNotNull())
    out = None
    for target, rows in (("lfmc_pct", frame), ("vegf", frame), ("eta_target", scaled)):
        model = modeling.fit_trees(rows, _NUMERIC, None, loss="squared", label=target, **_TREES)
        mean = rows.where("split = 'train'").agg(F.avg(target)).first()[0]
        made = _against_constant(model.transform(modeling.fill_bands(rows)), target, mean, lambda e: e * e).withColumn("target", F.lit(target))
        if target != "lfmc_pct":
            made = made.withColumn("better", F.when(F.col("split") == "train", F.col("better")))
        out = made if out is None else out.unionByName(made)
    return out


def _mask():
    return F.col("LAI").isNotNull() & F.col("LST").isNotNull() & F.col("Hveg").isNotNull() & F.col("lc_dom").isNotNull()


@query("ml8_batch_scoring", _SCORED, ["fx_predictors"])
def _(x):
    """Predictions on every predictor row that passes the mask, NULL on the others."""
    model = modeling.fit_trees(_final(x), _NUMERIC, "lc_dom", **_TREES)
    ready = frames.aligned_for_scoring(x.fx_predictors)
    return modeling.score(model, ready, _mask()).select("sample_id", F.col("lfmc_pred").isNotNull().alias("scored"))


@query("ml11_saved_model_scoring", f"SELECT sample_id, scored, true AS as_fresh, 'lc_dom' AS category FROM ({_SCORED})", ["fx_predictors"])
def _(x):
    """A saved and reloaded model against the one just fitted."""
    path = scratch_path(x.spark, "model")
    fresh = modeling.fit_trees(_final(x), _NUMERIC, "lc_dom", **_TREES)
    modeling.save_artifact(fresh, path, "trees", _NUMERIC, "lc_dom")
    model, about = modeling.load_artifact(x.spark, path, "trees")
    ready = frames.aligned_for_scoring(x.fx_predictors)
    first = modeling.score(fresh, ready, _mask()).select("sample_id", F.col("lfmc_pred").alias("fresh_pred"))
    again = modeling.score(model, ready, _mask()).join(first, "sample_id")
    return again.select(
        "sample_id", F.col("lfmc_pred").isNotNull().alias("scored"), F.col("lfmc_pred").eqNullSafe(F.col("fresh_pred")).alias("as_fresh"),
        F.lit(about["category"]).alias("category"),
    )


# Days of the table, leaf area between the composites around a day, and cells that pass the mask.
_PRODUCT_MASK = f"""WITH days AS (SELECT DISTINCT date FROM fx_grid_daily), cls AS (
      SELECT row, col, CASE WHEN {twins.total(names.VEGETATION_CLASSES)} > 0 THEN {twins.argmax(names.VEGETATION_CLASSES)} END AS lc_dom,
             coalesce(BAR, 0) + coalesce(URB, 0) + coalesce(SNO, 0) + coalesce(Water, 0) AS bare FROM fx_classes),
    comp AS (SELECT DISTINCT index_date + 5 AS d FROM fx_lai8),
    br AS (SELECT date, max(CASE WHEN d <= date THEN d END) AS lo, min(CASE WHEN d >= date THEN d END) AS hi FROM days, comp GROUP BY date),
    la AS (SELECT br.date, a.row, a.col FROM br JOIN fx_lai8 a ON a.index_date + 5 = br.lo JOIN fx_lai8 b ON b.index_date + 5 = br.hi AND b.row = a.row AND b.col = a.col
           WHERE a.lai IS NOT NULL AND b.lai IS NOT NULL),
    complete AS (SELECT g.date, g.row, g.col, g.qc_raw FROM fx_grid_daily g JOIN la ON la.date = g.date AND la.row = g.row AND la.col = g.col WHERE g.tau_x_h IS NOT NULL),
    seen AS (SELECT *, count(*) OVER (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS n FROM complete),
    valid AS (SELECT v.* FROM seen v JOIN fx_static s ON s.row = v.row AND s.col = v.col JOIN cls c ON c.row = v.row AND c.col = v.col
              WHERE s.canopy_height IS NOT NULL AND c.lc_dom IS NOT NULL AND c.bare <= 0.7)"""


def _day_features(x):
    """Days of the table, and the features of their cells with a surface temperature, which both masks need."""
    grid = x.fx_grid_daily
    dates = grid.select("date").distinct()
    bands = [F.col("tau_ku_h").alias("VOD_Ku_Hpol_Asc"), F.col("tau_x_h").alias("VOD_X_Hpol_Asc"), F.col("tau_c_h").alias("VOD_C_Hpol_Asc")]
    warm = grid.select("date", "row", "col", F.col("tau_x_h").alias("LST"))
    made = product.daily_features(
        dates,
        grid.select("date", "row", "col", F.col("qc_raw").alias("VOD_QC"), *bands),
        x.fx_lai8.select(F.date_add("index_date", 5).alias("date"), "row", "col", F.col("lai").alias("LAI")),
        warm,
        grid.select("date", "row", "col", "rain"),
        x.fx_static.select("row", "col", F.col("canopy_height").alias("Hveg")),
        x.fx_classes.drop("cell").withColumn("year", F.col("year") + 1),
        bands=["VOD_Ku_Hpol_Asc", "VOD_X_Hpol_Asc", "VOD_C_Hpol_Asc"],
        observed=warm.where(F.col("LST").isNotNull()),
    )
    return dates, made


def _product_model(x):
    """The saved and reloaded model of the product."""
    path = scratch_path(x.spark, "product-model")
    modeling.save_artifact(modeling.fit_trees(_final(x), _PRODUCT_NUMERIC, "lc_dom", **_TREES), path, "trees", _PRODUCT_NUMERIC, "lc_dom")
    return modeling.load_artifact(x.spark, path, "trees")


_PRODUCT_NUMERIC = ["VOD_Ku_Hpol_Asc", "VOD_X_Hpol_Asc", "VOD_C_Hpol_Asc", "LAI", "Hveg", "LST", "doy_sin", "doy_cos", "lat_norm"]


@query(
    "cp8_daily_prediction_maps",
    f"{_PRODUCT_MASK} SELECT date, CAST((SELECT count(*) FROM range(1800), range(3600)) AS INT) AS n_cells, (SELECT count(*) FROM valid v WHERE v.date = days.date) AS n_predicted FROM days",
    ["fx_grid_daily", "fx_static", "fx_lai8", "fx_classes"],
)
def _(x):
    """All days of the table and a saved model to masked maps of the whole grid: cells and predictions of each day."""
    model, about = _product_model(x)
    dates, features = _day_features(x)
    maps = rasters.to_full_grid(dates, product.predict_days(model, features, about["numeric"], about["category"]))
    return maps.groupBy("date").agg(F.count(F.lit(1)).cast("int").alias("n_cells"), F.count("lfmc_pred").alias("n_predicted"))


@query(
    "cp8_windowed_prediction_maps",
    f"""{_PRODUCT_MASK} SELECT date, count(n) FILTER (WHERE n = 3) AS n_windows, count(*) FILTER (WHERE n = 3 AND qc_raw = 0 AND ok) AS n_predicted
        FROM days LEFT JOIN (SELECT s.*, v.row IS NOT NULL AS ok FROM seen s LEFT JOIN valid v ON v.date = s.date AND v.row = s.row AND v.col = s.col) USING (date) GROUP BY date""",
    ["fx_grid_daily", "fx_static", "fx_lai8", "fx_classes"],
)
def _(x):
    """The windowed product of all days: cells with three complete days, and those of good quality that the model predicts."""
    model, _ = _product_model(x)
    dates, days = _day_features(x)
    made = windows.day_windows(days, ["VOD_Ku_Hpol_Asc", "LAI", "LST"], 3, full_only=False, required=["LAI", "LST"])
    scored = modeling.score(model, frames.aligned_for_scoring(made, None), product.temporal_mask(3, ["Hveg"]))
    counted = scored.groupBy("date").agg(F.count(F.when(F.col("n_complete_days") == 3, 1)).alias("n_windows"), F.count("lfmc_pred").alias("n_predicted"))
    return dates.join(counted, "date", "left").fillna(0, ["n_windows", "n_predicted"])
