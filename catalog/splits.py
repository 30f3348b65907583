"""Splits, samples, orderings, set operations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.functions import cells
from fieldmosaic.operators import calibration, metrics, rasters, scale, splits, windows
from fieldmosaic.plans import experiments, frames

from . import twins
from .registry import query, rounded

_B = f"b AS (SELECT *, {twins.BLOCK} AS block_id FROM fx_predictors)"


@query(
    "so1_sorted_summary",
    "SELECT scheme, model, split, count(*) AS n, round(avg(rmse), 6) AS rmse_mean FROM fx_runs GROUP BY ALL ORDER BY n DESC, scheme, model, split",
    ["fx_runs"],
)
def _(x):
    made = x.fx_runs.groupBy("scheme", "model", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rmse"), 6).alias("rmse_mean"))
    return made.orderBy(F.col("n").desc(), "scheme", "model", "split")


@query("so2_preview", "SELECT DISTINCT functional_type FROM fx_obs WHERE functional_type IS NOT NULL ORDER BY 1 LIMIT 3", ["fx_obs"])
def _(x):
    kinds = x.fx_obs.select("functional_type").where(F.col("functional_type").isNotNull()).distinct()
    return kinds.orderBy("functional_type").limit(3)


@query(
    "so3_seeded_sample",
    """SELECT split, grp, l_orderkey, l_linenumber FROM (
         SELECT *, row_number() OVER (PARTITION BY split, grp ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || y), l_orderkey, l_linenumber, y) AS rn
         FROM (SELECT DISTINCT split, grp, l_orderkey, l_linenumber, CAST(round(y * 100000) AS BIGINT) AS y FROM fx_pred)) WHERE rn <= 500""",
    ["fx_pred"],
)
def _(x):
    keyed = x.fx_pred.withColumn("y", F.round(F.col("y") * 100000).cast("bigint"))
    rows = keyed.select("split", "grp", "l_orderkey", "l_linenumber", "y")
    return splits.seeded_sample(rows, ["split", "grp"], ["l_orderkey", "l_linenumber", "y"], 500, unique=True).drop("y")


@query(
    "so4_spatial_split",
    f"WITH {_B}, {twins.split_of('b', 's')} SELECT sample_id, block_id, split FROM b JOIN s_blocks USING (block_id)",
    ["fx_predictors"],
)
def _(x):
    return splits.spatial_split(x.fx_predictors).select("sample_id", "block_id", "split")


@query(
    "so5_cell_split",
    f"""WITH p AS (SELECT sample_id, CAST(row // 5 AS VARCHAR) || '_' || CAST(col // 5 AS VARCHAR) AS block_id_05deg FROM fx_points), {twins.split_of('p', 's', 'block_id_05deg')}
        SELECT sample_id, block_id_05deg, split FROM p JOIN s_blocks USING (block_id_05deg)""",
    ["fx_points"],
)
def _(x):
    return splits.cell_split(x.fx_points).select("sample_id", "block_id_05deg", "split")


@query(
    "so6_independence",
    f"""WITH {_B}, {twins.split_of('b', 's')} SELECT count(DISTINCT block_id) AS n_blocks,
        CAST((SELECT count(*) FROM (SELECT block_id FROM b JOIN s_blocks USING (block_id) GROUP BY block_id HAVING count(DISTINCT split) > 1)) AS BIGINT) AS n_overlapping FROM s_blocks""",
    ["fx_predictors"],
)
def _(x):
    frame = splits.spatial_split(x.fx_predictors)
    per_block = frame.groupBy("block_id").agg(F.count_distinct("split").alias("n_splits"))
    return per_block.agg(F.count(F.lit(1)).alias("n_blocks"), F.count(F.when(F.col("n_splits") > 1, 1)).alias("n_overlapping"))


_YEARS = "SELECT * REPLACE (date - CAST(365 * (sample_id % 12) AS INT) AS date) FROM fx_predictors"


@query(
    "so7_transfer_split",
    f"""WITH d AS ({_YEARS}), m AS (
          SELECT sample_id, {twins.BLOCK} AS block_id, year(date) AS y,
                 lower(trim(country)) IN ('usa', 'united states') AND NOT contains(lower(state_region), 'hawai') AS home FROM d)
        SELECT sample_id, block_id, CASE WHEN home AND y BETWEEN 2002 AND 2018 THEN 'train_us'
               WHEN home AND y BETWEEN 2019 AND 2023 AND block_id IN (SELECT block_id FROM m WHERE home AND y BETWEEN 2002 AND 2018) THEN 'val_us_overlap'
               WHEN home AND y BETWEEN 2019 AND 2023 THEN 'val_us_nonoverlap' ELSE 'test_external' END AS split
        FROM m WHERE NOT home OR y BETWEEN 2002 AND 2023""",
    ["fx_predictors"],
)
def _(x):
    spread = x.fx_predictors.withColumn("date", F.date_sub("date", (F.col("sample_id") % 12 * 365).cast("int")))
    return splits.transfer_split(spread).select("sample_id", "block_id", "split")


@query(
    "st1_stacked_frames",
    "SELECT event_id, 'low' AS part, value, NULL AS props FROM events WHERE value < 20 UNION ALL SELECT event_id, 'high', value, props FROM events WHERE value >= 20",
)
def _(x):
    events = x.table("events")
    low = events.where("value < 20").select("event_id", F.lit("low").alias("part"), "value")
    high = events.where("value >= 20").select("event_id", F.lit("high").alias("part"), "value", "props")
    return low.unionByName(high, allowMissingColumns=True)


@query("st2_distinct_rows", "SELECT DISTINCT country, state_region, igbp_label FROM fx_obs", ["fx_obs"])
def _(x):
    return x.fx_obs.select("country", "state_region", "igbp_label").distinct()


@query(
    "st3_block_sets",
    f"""WITH {_B}, past AS (SELECT DISTINCT block_id FROM b WHERE value_day < 10), later AS (SELECT DISTINCT block_id FROM b WHERE value_day >= 10 AND lat > -50)
        SELECT block_id, 'both' AS side FROM (SELECT block_id FROM past INTERSECT SELECT block_id FROM later)
        UNION ALL SELECT block_id, 'past only' FROM (SELECT block_id FROM past EXCEPT SELECT block_id FROM later)""".replace("value_day", "day(date)"),
    ["fx_predictors"],
)
def _(x):
    placed = x.fx_predictors.withColumn("block_id", cells.block_id("lat", "lon"))
    past = placed.where(F.dayofmonth("date") < 10).select("block_id").distinct()
    later = placed.where((F.dayofmonth("date") >= 10) & (F.col("lat") > -50)).select("block_id").distinct()
    both = past.intersect(later).withColumn("side", F.lit("both"))
    return both.unionByName(past.exceptAll(later).withColumn("side", F.lit("past only")))


def _long(x):
    grid, static = x.fx_grid_daily, x.fx_static.select("row", "col", "canopy_height")
    samples = x.fx_points.select("sample_id", "date", "row", "col", F.when(F.col("sample_id") % 29 != 0, F.col("lfmc_pct")).alias("lfmc_pct"))
    joined = samples.join(grid, ["date", "row", "col"], "left").join(static, ["row", "col"], "left")
    return calibration.bands_to_long(joined, ["sample_id"])


@query(
    "st4_bands_to_long",
    """WITH j AS (SELECT p.sample_id, p.lfmc_pct, s.canopy_height, g.* FROM fx_points p LEFT JOIN fx_grid_daily g USING (date, row, col) LEFT JOIN fx_static s ON s.row = p.row AND s.col = p.col
                  WHERE p.sample_id % 29 <> 0 AND s.canopy_height IS NOT NULL)
       SELECT sample_id, lfmc_pct, canopy_height, 'C' AS band, tau_c_h AS vod_obs FROM j WHERE tau_c_h IS NOT NULL
       UNION ALL SELECT sample_id, lfmc_pct, canopy_height, 'X', tau_x_h FROM j WHERE tau_x_h IS NOT NULL
       UNION ALL SELECT sample_id, lfmc_pct, canopy_height, 'Ku', tau_ku_h FROM j WHERE tau_ku_h IS NOT NULL""",
    ["fx_points", "fx_grid_daily", "fx_static"],
)
def _(x):
    return _long(x)


_CELLS = f"""{_B}, {twins.split_of('b', 's')}, t AS (SELECT DISTINCT block_id, CAST(floor((lat + 90) / 0.5e0) AS INT) AS block_lat,
       CAST(floor((lon + 180) / 0.5e0) AS INT) AS block_lon FROM b)"""


@query(
    "st5_split_code_grid",
    f"""WITH {_CELLS} SELECT g.block_lat, g.block_lon, coalesce(CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 END, 0) AS split_code
        FROM (SELECT CAST(i // 720 AS INT) AS block_lat, CAST(i % 720 AS INT) AS block_lon FROM range(259200) r(i)) g
        LEFT JOIN (SELECT t.*, s.split FROM t JOIN s_blocks s USING (block_id)) USING (block_lat, block_lon)""",
    ["fx_predictors"],
)
def _(x):
    return splits.split_code_grid(splits.block_table(splits.spatial_split(x.fx_predictors)))


@query(
    "ag23_split_counts",
    f"WITH {_B}, {twins.split_of('b', 's')} SELECT split, count(*) AS n, count(DISTINCT block_id) AS n_blocks FROM b JOIN s_blocks USING (block_id) GROUP BY split",
    ["fx_predictors"],
)
def _(x):
    return metrics.split_counts(splits.spatial_split(x.fx_predictors))


@query(
    "ag23_block_table",
    f"""WITH {_CELLS} SELECT block_id, block_lat, block_lon, split, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS split_code,
        -90 + block_lat * 0.5e0 AS lat_min, -89.5 + block_lat * 0.5e0 AS lat_max, -180 + block_lon * 0.5e0 AS lon_min, -179.5 + block_lon * 0.5e0 AS lon_max,
        -89.75 + block_lat * 0.5e0 AS lat_center, -179.75 + block_lon * 0.5e0 AS lon_center FROM t JOIN s_blocks USING (block_id)""",
    ["fx_predictors"],
)
def _(x):
    return splits.block_table(splits.spatial_split(x.fx_predictors))


# --- windows ----------------------------------------------------------------
_SITE = "printf('%.6f', lat) || '_' || printf('%.6f', lon)"
_WN2 = f"""SELECT sample_id, site_key, date, lfmc_pct, dyn_seq FROM (
  SELECT *, list([VOD_Ku_Hpol_Asc, LST]) OVER (PARTITION BY site_key ORDER BY date, sample_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS dyn_seq
  FROM (SELECT *, {_SITE} AS site_key FROM fx_predictors)) WHERE len(dyn_seq) = 4"""


@query("wn2_observation_windows", _WN2, ["fx_predictors"])
def _(x):
    keyed = x.fx_predictors.withColumn("site_key", windows.site_key())
    made = windows.observation_windows(keyed, ["VOD_Ku_Hpol_Asc", "LST"], 4)
    return made.select("sample_id", "site_key", "date", "lfmc_pct", "dyn_seq")


@query("wn2_observation_windows_sliced", _WN2, ["fx_predictors"])
def _(x):
    """The same with every site above a hundred rows cut into ordered slices."""
    keyed = x.fx_predictors.select("sample_id", "date", "lat", "lon", "lfmc_pct", "VOD_Ku_Hpol_Asc", "LST").withColumn("site_key", windows.site_key())
    made = windows.observation_windows(keyed, ["VOD_Ku_Hpol_Asc", "LST"], 4, large_groups=True)
    return made.select("sample_id", "site_key", "date", "lfmc_pct", "dyn_seq")


@query(
    "wn3_calendar_windows",
    """SELECT date, row, col, dyn_seq, n_complete FROM (
         SELECT *, list([tau_x_h, tau_ku_h]) OVER w AS dyn_seq, count(*) OVER w AS n, count(tau_ku_h) OVER w AS n_complete FROM fx_grid_daily
         WINDOW w AS (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)) WHERE n = 4""",
    ["fx_grid_daily"],
)
def _(x):
    made = windows.day_windows(x.fx_grid_daily, ["tau_x_h", "tau_ku_h"], 4, required=["tau_ku_h"])
    return made.select("date", "row", "col", "dyn_seq", F.col("n_complete_days").alias("n_complete"))


@query(
    "wn4_trailing_rain",
    """SELECT date, row, col, round(sum(rain) OVER a, 6) AS rain_7day, count(rain) OVER a AS rain_7day_valid_days, round(sum(rain) OVER b, 6) AS rain_before, count(rain) OVER b AS rain_before_valid_days
       FROM fx_grid_daily WINDOW a AS (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
                                 b AS (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    ["fx_grid_daily"],
)
def _(x):
    made = windows.trailing_sum(x.fx_grid_daily, "rain")
    made = windows.trailing_sum(made, "rain", include_current=False, out="rain_before")
    picked = made.select("date", "row", "col", "rain_7day", "rain_7day_valid_days", "rain_before", "rain_before_valid_days")
    return rounded(picked, "rain_7day", "rain_before")


@query("wn7_row_index", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, l_shipdate) - 1 AS sample_id FROM lineitem")
def _(x):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate"]
    return scale.row_index(x.table("lineitem").select(*order), order).select("l_orderkey", "l_linenumber", "l_partkey", "sample_id")


@query(
    "wn8_first_file_per_date",
    "SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderpriority || '_' || CAST(o_orderkey AS VARCHAR)) AS file_name FROM orders GROUP BY 1",
)
def _(x):
    files = x.table("orders").select(
        F.to_date("o_orderdate").alias("date"), F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("file_name")
    )
    return windows.first_file_per_date(files)


@query(
    "cp11_temporal_coverage",
    f"""WITH {twins.base(names.CORE_FEATURES_LITE)}, f AS (SELECT *, {twins.BLOCK} AS block_id, {_SITE} AS site_key FROM base WHERE igbp_to_lc_dom = lc_dom),
        {twins.split_of('f', 's')}, w AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY date, sample_id) AS rn FROM f)
        SELECT split, count(*) AS n_window_samples, count(DISTINCT site_key) AS n_sites, count(DISTINCT block_id) AS n_blocks FROM w JOIN s_blocks USING (block_id) WHERE rn >= 4 GROUP BY split""",
    ["fx_predictors"],
)
def _(x):
    return experiments.temporal_coverage(experiments.temporal_samples(frames.final_frame(x.fx_predictors)))


@query(
    "cp11_samples_per_site",
    f"""WITH {twins.base(names.CORE_FEATURES_LITE)}, f AS (SELECT *, {twins.BLOCK} AS block_id, {_SITE} AS site_key FROM base WHERE igbp_to_lc_dom = lc_dom),
        {twins.split_of('f', 's')} SELECT site_key, split, count(*) - 3 AS n_samples FROM f JOIN s_blocks USING (block_id) GROUP BY site_key, split HAVING count(*) > 3""",
    ["fx_predictors"],
)
def _(x):
    return experiments.samples_per_site(experiments.temporal_samples(frames.final_frame(x.fx_predictors)))


@query(
    "st6_full_grid_scatter",
    """WITH d AS (SELECT DISTINCT date FROM fx_grid_daily), g AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range(1800) a(r), range(3600) b(c))
       SELECT d.date, CAST(g.row // 100 AS INT) AS band, count(*) AS n_cells, count(p.tau_x_h) AS n_predicted, round(sum(p.tau_x_h), 4) AS total
       FROM d CROSS JOIN g LEFT JOIN fx_grid_daily p ON p.date = d.date AND p.row = g.row AND p.col = g.col GROUP BY 1, 2""",
    ["fx_grid_daily"],
)
def _(x):
    """Every day on the whole grid, counted per day and strip of a hundred rows."""
    grid = x.fx_grid_daily
    whole = rasters.to_full_grid(grid.select("date").distinct(), grid.select("date", "row", "col", F.col("tau_x_h").alias("lfmc_pred")))
    return whole.groupBy("date", F.floor(F.col("row") / 100).cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("lfmc_pred").alias("n_predicted"), F.round(F.sum("lfmc_pred"), 4).alias("total")
    )
