"""Lookups of raster values for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic.functions import cells
from fieldmosaic.operators import align, metrics, scale, splits

from . import twins
from .registry import query, rounded

_POINTS = ["sample_id", "date", "row", "col"]


def points(x):
    """Samples of which some lie on cells and days without raster values."""
    odd = F.col("sample_id") % 31 == 0
    return x.fx_points.select("sample_id", "date", "year", F.when(odd, F.col("row") + 1).otherwise(F.col("row")).alias("row"), "col")


_PTS = "pts AS (SELECT sample_id, date, year, CASE WHEN sample_id % 31 = 0 THEN row + 1 ELSE row END AS row, col FROM fx_points)"


@query(
    "jn1_daily_values",
    f"WITH {_PTS} SELECT p.sample_id, p.date, p.row, p.col, g.tau_ku_h, g.tau_x_h, g.rain FROM pts p LEFT JOIN fx_grid_daily g USING (date, row, col)",
    ["fx_points", "fx_grid_daily"],
)
def _(x):
    made = align.daily_values(points(x).drop("year"), x.fx_grid_daily, ["tau_ku_h", "tau_x_h", "rain"])
    return made.select(*_POINTS, "tau_ku_h", "tau_x_h", "rain")


@query(
    "jn2_static_values",
    f"WITH {_PTS} SELECT p.sample_id, s.canopy_height, s.agb FROM pts p LEFT JOIN fx_static s USING (row, col)",
    ["fx_points", "fx_static"],
)
def _(x):
    return align.static_values(points(x), x.fx_static).select("sample_id", "canopy_height", "agb")


@query(
    "jn3_eight_day_values",
    f"""WITH {_PTS}, st AS (SELECT *, CAST(date_trunc('year', date) AS DATE) + CAST((dayofyear(date) - 1) // 8 * 8 AS INT) AS start FROM pts)
        SELECT sample_id, l.lai, CASE WHEN start IN (SELECT index_date FROM fx_lai8) THEN start END AS lai_index_date
        FROM st LEFT JOIN fx_lai8 l ON l.index_date = start AND l.row = st.row AND l.col = st.col""",
    ["fx_points", "fx_lai8"],
)
def _(x):
    return align.eight_day_values(points(x), x.fx_lai8, "lai").select("sample_id", "lai", "lai_index_date")


_SHARES = "SELECT * REPLACE (CAST(2024 - cell % 2 AS INT) AS year) FROM fx_classes"


def annual(x):
    return x.fx_classes.withColumn("year", (F.lit(2024) - F.col("cell") % 2).cast("int"))


@query(
    "jn4_annual_values",
    f"WITH {_PTS}, shares AS ({_SHARES}) SELECT sample_id, GRA, SAV FROM pts LEFT JOIN shares USING (year, row, col)",
    ["fx_points", "fx_classes"],
)
def _(x):
    return align.annual_values(points(x), annual(x), ["GRA", "SAV"]).select("sample_id", "GRA", "SAV")


_TARGETS = "asked AS (SELECT sample_id, row, col, CAST(2019 + sample_id % 8 AS INT) AS year FROM fx_points)"
_YEARS = "kept AS (SELECT * REPLACE (CAST(2020 + cell % 3 * 2 AS INT) AS year) FROM fx_classes)"


@query(
    "jn5_as_of_year",
    f"""WITH {_TARGETS}, {_YEARS}, used AS (
          SELECT *, coalesce((SELECT max(k.year) FROM kept k WHERE k.year <= asked.year), (SELECT min(k.year) FROM kept k)) AS year_used FROM asked)
        SELECT u.sample_id, u.year, u.year_used, k.GRA, k.BAR FROM used u LEFT JOIN kept k ON k.year = u.year_used AND k.row = u.row AND k.col = u.col""",
    ["fx_points", "fx_classes"],
)
def _(x):
    asked = x.fx_points.select("sample_id", "row", "col", (F.lit(2019) + F.col("sample_id") % 8).cast("int").alias("year"))
    kept = x.fx_classes.withColumn("year", (F.lit(2020) + F.col("cell") % 3 * 2).cast("int"))
    return align.as_of_year(asked, kept, ["GRA", "BAR"]).select("sample_id", "year", "year_used", "GRA", "BAR")


@query(
    "jn6_as_of_date",
    """WITH lai AS (SELECT index_date AS date, row, col, lai FROM fx_lai8 WHERE index_date > (SELECT min(index_date) FROM fx_lai8)),
       days AS (SELECT DISTINCT date FROM lai)
       SELECT p.sample_id, p.date, p.date_used, l.lai FROM (
         SELECT f.*, coalesce((SELECT max(d.date) FROM days d WHERE d.date <= f.date), (SELECT min(d.date) FROM days d)) AS date_used FROM fx_points f) p
       LEFT JOIN lai l ON l.date = p.date_used AND l.row = p.row AND l.col = p.col""",
    ["fx_points", "fx_lai8"],
)
def _(x):
    lai = x.fx_lai8.withColumnRenamed("index_date", "date")
    later = lai.where(F.col("date") > F.lit(lai.agg(F.min("date")).first()[0]))
    return align.as_of_date(x.fx_points, later, ["lai"]).select("sample_id", "date", "date_used", "lai")


@query(
    "jn7_interpolated_values",
    """WITH days AS (SELECT DISTINCT index_date AS d FROM fx_lai8),
       br AS (SELECT date, (SELECT max(d) FROM days WHERE d <= date) AS lo, (SELECT min(d) FROM days WHERE d >= date) AS hi FROM (SELECT DISTINCT date FROM fx_points))
       SELECT p.sample_id, p.date, round(CASE WHEN lo = hi THEN a.lai ELSE a.lai * (1 - (p.date - lo) / (hi - lo)) + b.lai * ((p.date - lo) / (hi - lo)) END, 12) AS lai
       FROM fx_points p JOIN br USING (date) LEFT JOIN fx_lai8 a ON a.index_date = lo AND a.row = p.row AND a.col = p.col
       LEFT JOIN fx_lai8 b ON b.index_date = hi AND b.row = p.row AND b.col = p.col""",
    ["fx_points", "fx_lai8"],
)
def _(x):
    made = align.interpolated_values(x.fx_points, x.fx_lai8.withColumnRenamed("index_date", "date"), "lai")
    return rounded(made.select("sample_id", "date", "lai"), "lai", digits=12)


_FIRST = "f1 AS (SELECT date, row, col, rain FROM fx_grid_daily WHERE day(date) % 3 <> 0)"


@query(
    "jn8_preferred_source",
    f"""WITH {_FIRST} SELECT date, row, col, rain FROM f1 UNION ALL
        SELECT date, row, col, tau_x_h AS rain FROM fx_grid_daily WHERE date NOT IN (SELECT date FROM f1)""",
    ["fx_grid_daily"],
)
def _(x):
    grid = x.fx_grid_daily
    first = grid.where(F.dayofmonth("date") % 3 != 0).select("date", "row", "col", "rain")
    return align.preferred_by_date(first, grid.select("date", "row", "col", F.col("tau_x_h").alias("rain")))


@query(
    "jn9_reattached_attributes",
    """SELECT p.sample_id, a.country, a.state_region FROM fx_predictors p
       LEFT JOIN (SELECT DISTINCT date, lat, lon, country, state_region FROM fx_predictors) a USING (date, lat, lon)""",
    ["fx_predictors"],
)
def _(x):
    rows = x.fx_predictors
    made = align.reattach_attributes(rows.select("sample_id", "date", "lat", "lon"), rows, ["date", "lat", "lon"], ["country", "state_region"])
    return made.select("sample_id", "country", "state_region")


@query(
    "jn11_train_block_overlap",
    f"""WITH b AS (SELECT sample_id, {twins.BLOCK} AS block_id, day(date) <= 15 AND country <> 'Spain' AS past, day(date) > 15 AND country <> 'Spain' AS later FROM fx_predictors)
        SELECT sample_id, block_id, block_id IN (SELECT block_id FROM b WHERE past) AS seen FROM b WHERE later""",
    ["fx_predictors"],
)
def _(x):
    marked = x.fx_predictors.withColumn("block_id", cells.block_id("lat", "lon"))
    home = F.col("country") != "Spain"
    past = marked.where(home & (F.dayofmonth("date") <= 15)).select("block_id").distinct().withColumn("hit", F.lit(True))
    later = marked.where(home & (F.dayofmonth("date") > 15))
    return later.join(past, ["block_id"], "left").select("sample_id", "block_id", F.coalesce("hit", F.lit(False)).alias("seen"))


@query(
    "jn13_predictions_by_sample",
    """SELECT l.sample_id, l.band, l.vod_obs, p.lfmc_pct AS lfmc_hat FROM (
         SELECT event_id AS sample_id, 'C' AS band, value AS vod_obs FROM events UNION ALL SELECT event_id, 'Ku', value * 2 FROM events) l
       LEFT JOIN (SELECT * FROM fx_points WHERE sample_id % 4 <> 0) p USING (sample_id)""",
    ["fx_points"],
)
def _(x):
    wide = x.table("events").select(F.col("event_id").alias("sample_id"), F.col("value").alias("C"), (F.col("value") * 2).alias("Ku"))
    long = wide.unpivot(["sample_id"], ["C", "Ku"], "band", "vod_obs")
    kept = x.fx_points.where(F.col("sample_id") % 4 != 0).select("sample_id", F.col("lfmc_pct").alias("lfmc_hat"))
    return long.join(kept, ["sample_id"], "left")


@query(
    "jn14_summary_with_counts",
    """SELECT s.scheme, s.model, s.split, round(avg(rmse), 6) AS rmse_mean, max(repeat_no) AS n_samples, min(scheme || ' described') AS scheme_desc FROM fx_runs s GROUP BY ALL""",
    ["fx_runs"],
)
def _(x):
    raw = x.fx_runs.withColumn("scheme_desc", F.concat("scheme", F.lit(" described")))
    summary = metrics.repeat_summary(raw, measures=["rmse"]).drop("rmse_std")
    keys = ["scheme", "model", "split"]
    out = metrics.with_descriptions(metrics.with_counts(summary, raw, keys, "repeat_no"), raw, ["scheme", "model"], "scheme_desc")
    return rounded(out, "rmse_mean")


@query(
    "jn15_merged_aggregates",
    """SELECT user_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS mean_value, median(value) AS median_value, count(*) AS n, count(DISTINCT event_type) AS n_types,
              arg_min(props, event_id) AS first_props FROM events GROUP BY 1, 2""",
)
def _(x):
    """What takes several aggregates and merges elsewhere is one grouped aggregate here."""
    made = scale.group_quantiles(
        x.table("events").withColumn("date", F.to_date("ts")), ["user_id", "date"], {"median_value": ("value", 0.5)},
        [
            F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_types"),
            F.min_by("props", "event_id").alias("first_props"),
        ],
    )
    return rounded(made, "mean_value")


@query(
    "jn16_stacked_days",
    """SELECT t.target_date, g.date, g.row, g.col, CAST(3 - (t.target_date - g.date) AS INT) AS step, g.tau_x_h FROM fx_grid_daily g
       JOIN (SELECT DISTINCT date AS target_date FROM fx_grid_daily) t ON g.date BETWEEN t.target_date - 3 AND t.target_date""",
    ["fx_grid_daily"],
)
def _(x):
    grid = x.fx_grid_daily
    return align.stack_days(grid, grid.select("date"), 4).select("target_date", "date", "row", "col", "step", "tau_x_h")


_PRED_A = "a AS (SELECT date, row, col, tau_x_h AS p FROM fx_grid_daily WHERE cell % 3 <> 0)"
_PRED_B = "b AS (SELECT date, row, col, tau_ku_h AS p FROM fx_grid_daily WHERE cell % 4 <> 0)"


@query(
    "jn17_two_prediction_grids",
    f"WITH {_PRED_A}, {_PRED_B} SELECT date, row, col, round(coalesce((a.p + b.p) / 2, a.p, b.p), 9) AS lfmc_pred FROM a FULL JOIN b USING (date, row, col)",
    ["fx_grid_daily"],
)
def _(x):
    grid = x.fx_grid_daily
    a = grid.where(F.col("cell") % 3 != 0).select("date", "row", "col", F.col("tau_x_h").alias("lfmc_pred"))
    b = grid.where(F.col("cell") % 4 != 0).select("date", "row", "col", F.col("tau_ku_h").alias("lfmc_pred"))
    return rounded(align.mean_of_two(a, b), "lfmc_pred", digits=9)


@query(
    "jn18_all_auxiliaries",
    """WITH used AS (SELECT *, CAST(date_trunc('year', date) AS DATE) + CAST((dayofyear(date) - 1) // 8 * 8 AS INT) AS start FROM fx_points)
       SELECT u.sample_id, s.canopy_height, s.agb, c.GRA, g.tau_x_h, l.lai, CASE WHEN start IN (SELECT index_date FROM fx_lai8) THEN start END AS lai_index_date
       FROM used u LEFT JOIN fx_static s USING (row, col) LEFT JOIN fx_classes c ON c.row = u.row AND c.col = u.col
       LEFT JOIN fx_grid_daily g ON g.date = u.date AND g.row = u.row AND g.col = u.col
       LEFT JOIN fx_lai8 l ON l.index_date = start AND l.row = u.row AND l.col = u.col""",
    ["fx_points", "fx_static", "fx_classes", "fx_grid_daily", "fx_lai8"],
)
def _(x):
    """The only year of class shares is before the samples, so the as-of rule picks it."""
    made = align.all_auxiliaries(
        x.fx_points.drop("year"), x.fx_static, x.fx_classes.select("year", "row", "col", "GRA"),
        x.fx_grid_daily.select("date", "row", "col", "tau_x_h"), {"lai": x.fx_lai8},
    )
    return made.select("sample_id", "canopy_height", "agb", "GRA", "tau_x_h", "lai", "lai_index_date")


@query(
    "jn12_block_window_counts",
    f"""WITH b AS (SELECT sample_id, {twins.BLOCK} AS block_id, CAST(floor((lat + 90) / 0.5e0) AS INT) AS block_lat, CAST(floor((lon + 180) / 0.5e0) AS INT) AS block_lon FROM fx_predictors),
        {twins.split_of('b', 's')}, w AS (SELECT block_id, count(*) AS n_window_samples FROM b WHERE sample_id % 3 = 0 GROUP BY 1)
        SELECT DISTINCT b.block_id, b.block_lat, b.block_lon, s.split, w.n_window_samples, -90 + block_lat * 0.5e0 AS lat_min, -180 + block_lon * 0.5e0 AS lon_min
        FROM b JOIN s_blocks s USING (block_id) JOIN w USING (block_id)""",
    ["fx_predictors"],
)
def _(x):
    from fieldmosaic.plans.experiments import block_window_counts

    frame = splits.spatial_split(x.fx_predictors)
    made = block_window_counts(frame, frame.where(F.col("sample_id") % 3 == 0))
    return made.select("block_id", "block_lat", "block_lon", "split", "n_window_samples", "lat_min", "lon_min")


