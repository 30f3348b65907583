"""Readers, writers, schema helpers, scaffolds and inference masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic import names
from fieldmosaic.operators import cleaning, metrics, modeling, rasters, windows
from fieldmosaic.plans import product
from fieldmosaic.session import scratch_path
from fieldmosaic.sources import chunks, rasters as grids
from fieldmosaic.sources import sinks, tables

from . import twins
from .registry import query, rounded


@query("src1_raw_sample_reader", "SELECT CAST(sorting_id AS VARCHAR) AS sorting_id, site_name, date_raw, lfmc_raw, functional_type, protocol FROM fx_obs", ["fx_obs"])
def _(x):
    path = scratch_path(x.spark, "samples") + ".csv"
    kept = x.fx_obs.select("sorting_id", "site_name", "date_raw", "lfmc_raw", "functional_type", "protocol")
    kept.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_samples(x.spark, path)


@query("src2_predictor_reader", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, FT, LAI, LST FROM fx_predictors", ["fx_predictors"])
def _(x):
    path = scratch_path(x.spark, "predictors") + ".csv"
    x.fx_predictors.select("sample_id", "FT", F.col("LAI").alias(" LAI "), F.col("LST").alias("﻿LST")).write.option("header", True).csv(path)
    return tables.read_predictors(x.spark, path, ["sample_id", "FT", "LAI", "LST"], ["LAI", "LST"])


@query("src3_read_by_suffix", "SELECT 'csv' AS form, count(*) AS n, round(sum(y), 6) AS total FROM fx_pred UNION ALL SELECT 'parquet', count(*), round(sum(y), 6) FROM fx_pred", ["fx_pred"])
def _(x):
    base = scratch_path(x.spark, "pairs")
    x.fx_pred.write.option("header", True).csv(f"{base}.csv")
    x.fx_pred.write.parquet(f"{base}.parquet")
    out = None
    for form in ("csv", "parquet"):
        part = tables.read_table(x.spark, f"{base}.{form}").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("y").cast("double")), 6).alias("total"))
        part = part.select(F.lit(form).alias("form"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


def _stored(x):
    path = scratch_path(x.spark, "grid")
    grids.write_grid(x.fx_grid_daily, path)
    return path


@query(
    "src4_daily_lookup",
    "SELECT date, row, col, tau_x_h, qc_raw FROM fx_grid_daily WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'",
    ["fx_grid_daily"],
)
def _(x):
    """A day range from a date-partitioned table: the range prunes partitions."""
    return grids.read_days(x.spark, _stored(x), "2024-01-05", "2024-01-19").select("date", "row", "col", "tau_x_h", "qc_raw")


@query(
    "src4_ordered_sources",
    """SELECT date, row, col, tau_x_h, CASE WHEN day(date) % 3 = 0 THEN 0 WHEN day(date) % 2 = 0 THEN 1 ELSE 2 END AS source FROM fx_grid_daily
       WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'""",
    ["fx_grid_daily"],
)
def _(x):
    """Three sources in order of preference, each without some days."""
    days = grids.read_days(x.spark, _stored(x), "2024-01-05", "2024-01-19").select("date", "row", "col", "tau_x_h")
    return grids.first_available([days.where(F.dayofmonth("date") % 3 == 0), days.where(F.dayofmonth("date") % 2 == 0), days])


@query("src5_available_days", "SELECT DISTINCT date FROM fx_grid_daily ORDER BY date", ["fx_grid_daily"])
def _(x):
    return grids.available_days(x.fx_grid_daily)


@query("src5_days_in_file_names", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY 1")
def _(x):
    files = x.table("orders").select(F.concat(F.lit("MCCA_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".h5")).alias("file_name"))
    return grids.days_in_file_names(files)


@query("src6_available_years", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders ORDER BY 1")
def _(x):
    return grids.available_years(x.table("orders").select(F.year("o_orderdate").alias("year")))


@query("src7_alias_resolution", 'SELECT cell, SNO AS "SNO", BAR AS "BAR", URB AS "URB", "Water", CAST(NULL AS DOUBLE) AS "Rock" FROM fx_classes', ["fx_classes"])
def _(x):
    odd = x.fx_classes.select("cell", F.col("SNO").alias("SnowIce"), F.col("BAR").alias("bar"), F.col("URB").alias("Urban"), F.col("Water").alias("WAT"))
    return tables.coalesce_columns(odd, {**names.CLASS_ALIASES, "Rock": ["Rock", "ROC"]})


@query(
    "src8_full_grid_scaffold",
    """SELECT d.date, r.row // 300 AS band, count(*) AS n, round(avg(90 - (r.row + 0.5) * 0.1e0), 6) AS mean_lat, round(avg(-180 + (c.col + 0.5) * 0.1e0), 6) AS mean_lon
       FROM (SELECT DISTINCT date FROM fx_grid_daily) d, range(1800) r(row), range(3600) c(col) GROUP BY 1, 2""",
    ["fx_grid_daily"],
)
def _(x):
    """Every cell of every grid day, counted per strip."""
    dates = x.fx_grid_daily.select("date").distinct()
    grid = rasters.scaffold(dates)
    made = grid.groupBy("date", F.floor(F.col("row") / 300).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon")
    )
    return rounded(made, "mean_lat", "mean_lon")


@query(
    "src9_incremental_days",
    """SELECT date, row, col, tau_ku_h, CASE WHEN tau_ku_h IS NULL THEN 'quarantine' ELSE 'new' END AS target FROM fx_grid_daily
       WHERE date NOT IN (SELECT DISTINCT date FROM fx_grid_daily WHERE day(date) % 4 = 0)""",
    ["fx_grid_daily"],
)
def _(x):
    grid = x.fx_grid_daily
    fresh = grids.new_days(grid, grid.where(F.dayofmonth("date") % 4 == 0))
    good, bad = grids.quarantine(fresh, F.col("tau_ku_h").isNotNull())
    both = good.withColumn("target", F.lit("new")).unionByName(bad.withColumn("target", F.lit("quarantine")))
    return both.select("date", "row", "col", "tau_ku_h", "target")


@query(
    "src10_sensor_by_year",
    """SELECT date, arg_min(sensor, CASE WHEN (year(date) < 1996) = (sensor = 'A') THEN 0 ELSE 1 END) AS sensor FROM (
         SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS sensor FROM orders) GROUP BY date""",
)
def _(x):
    files = x.table("orders").select(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("sensor")).distinct()
    return windows.best_source_per_date(files, change_year=1996)


@query(
    "snk1_sample_export",
    "SELECT sorting_id, regexp_replace(lower(trim(protocol)), '\\.0$', '') AS protocol, TRY_CAST(lfmc_raw AS DOUBLE) AS \"Slope (%)\", date_raw AS sampling_time_raw FROM fx_obs",
    ["fx_obs"],
)
def _(x):
    path = scratch_path(x.spark, "export")
    mixed = x.fx_obs.select("sorting_id", "protocol", F.col("lfmc_raw").alias("Slope (%)"), F.col("date_raw").alias("sampling_time_raw"))
    sinks.write_samples(mixed, path)
    return x.spark.read.parquet(path)


@query("snk2_report_export", "WITH " + twins.STD + " SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, min(lfmc_pct) AS lfmc_min, max(lfmc_pct) AS lfmc_max FROM std", ["fx_obs"])
def _(x):
    from .cleaning import standard

    path = scratch_path(x.spark, "report")
    sinks.write_report(cleaning.summarise(standard(x)), path)
    return x.spark.read.schema("n_rows bigint, n_sites bigint, lfmc_min double, lfmc_max double").json(path)


_PREDICTED = "SELECT date, row, col, CASE WHEN qc_raw = 0 THEN tau_x_h END AS lfmc_pred FROM fx_grid_daily"


def _predicted(x):
    return x.fx_grid_daily.select("date", "row", "col", F.when(F.col("qc_raw") == 0, F.col("tau_x_h")).alias("lfmc_pred"))


@query("snk3_prediction_table", _PREDICTED, ["fx_grid_daily"])
def _(x):
    path = scratch_path(x.spark, "table")
    sinks.write_prediction_table(_predicted(x), path, "csv")
    return x.spark.read.schema("date date, row int, col int, lfmc_pred double").option("header", True).csv(path)


@query("snk4_prediction_grid", "SELECT date, row, col, tau_x_h AS lfmc_pred FROM fx_grid_daily WHERE qc_raw = 0 AND tau_x_h IS NOT NULL", ["fx_grid_daily"])
def _(x):
    path = scratch_path(x.spark, "product")
    sinks.write_prediction_grid(_predicted(x), path)
    return x.spark.read.parquet(f"{path}/cells").select("date", "row", "col", "lfmc_pred")


@query(
    "snk4_chunked_grid",
    """SELECT date, 100 AS n_chunks, count(*) AS n_cells, count(tau_ku_h) AS n_ku, round(sum(tau_x_h), 6) AS sum_x, CAST(sum(row * 3600 + col) AS BIGINT) AS places,
              round(sum(tau_ku_h * (row + 2 * col)), 3) AS sum_ku FROM fx_grid_daily GROUP BY date""",
    ["fx_grid_daily"],
)
def _(x):
    """All days written as chunks and read back cell by cell."""
    path, columns = scratch_path(x.spark, "chunks"), ["tau_x_h", "tau_ku_h"]
    chunks.write_chunks(x.fx_grid_daily.select("date", "row", "col", *columns), path, columns)
    read = x.spark.read.parquet(path)
    cells = chunks.cells_of_chunks(read, columns).groupBy("date").agg(
        F.count("*").alias("n_cells"), F.count("tau_ku_h").alias("n_ku"), F.round(F.sum("tau_x_h"), 6).alias("sum_x"),
        F.sum((F.col("row") * 3600 + F.col("col")).cast("long")).alias("places"), F.round(F.sum(F.col("tau_ku_h") * (F.col("row") + 2 * F.col("col"))), 3).alias("sum_ku"),
    )
    return read.groupBy("date").agg(F.count("*").cast("int").alias("n_chunks")).join(cells, "date")


@query("snk5_result_tables", "SELECT scheme, model, split, round(avg(rmse), 4) AS rmse_mean FROM fx_runs GROUP BY ALL", ["fx_runs"])
def _(x):
    path = scratch_path(x.spark, "results")
    summary = metrics.repeat_summary(x.fx_runs, measures=["rmse"]).drop("rmse_std")
    sinks.write_results(x.fx_runs, summary, path, "trial")
    read = x.spark.read.schema("scheme string, model string, split string, rmse_mean double").option("header", True).csv(f"{path}/trial_summary")
    return rounded(read, "rmse_mean", digits=4)


@query("snk6_split_tables", "SELECT split, grp, count(*) AS n, round(sum(y), 6) AS total FROM fx_pred GROUP BY ALL", ["fx_pred"])
def _(x):
    path = scratch_path(x.spark, "splits")
    sinks.write_splits(x.fx_pred, path, order=["l_orderkey"])
    made = x.spark.read.parquet(path).groupBy("split", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    return rounded(made, "total", digits=6)


@query("sch2_required_columns", "SELECT sample_id, LAI FROM fx_predictors", ["fx_predictors"])
def _(x):
    return tables.require_columns(x.fx_predictors, [*names.BANDS, "LAI"]).select("sample_id", "LAI")


@query("sch3_feature_columns", "SELECT cell, tau_ku_h, tau_x_h, tau_c_h, qc_raw, rain FROM fx_grid_daily", ["fx_grid_daily"])
def _(x):
    return x.fx_grid_daily.select(*tables.feature_columns(x.fx_grid_daily))


@query(
    "sch4_column_profile",
    """SELECT 'o_custkey' AS column_name, 'bigint' AS data_type, count(o_custkey) AS n_present, CAST(min(o_custkey) AS VARCHAR) AS min_text, CAST(max(o_custkey) AS VARCHAR) AS max_text,
              count(DISTINCT o_custkey) AS n_distinct, (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT o_custkey AS v FROM orders ORDER BY v LIMIT 3)) AS preview FROM orders
       UNION ALL SELECT 'cents', 'bigint', count(*), CAST(min(v) AS VARCHAR), CAST(max(v) AS VARCHAR), count(DISTINCT v),
              (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT CAST(round(o_totalprice * 100, 0) AS BIGINT) - 20000000 AS v FROM orders ORDER BY v LIMIT 3))
              FROM (SELECT CAST(round(o_totalprice * 100, 0) AS BIGINT) - 20000000 AS v FROM orders)
       UNION ALL SELECT 'day', 'date', count(*), CAST(min(v) AS VARCHAR), CAST(max(v) AS VARCHAR), count(DISTINCT v),
              (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS v FROM orders ORDER BY v LIMIT 3)) FROM (SELECT CAST(o_orderdate AS DATE) AS v FROM orders)
       UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), min(o_orderpriority), max(o_orderpriority), count(DISTINCT o_orderpriority),
              (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY v LIMIT 3)) FROM orders
       UNION ALL SELECT 'half', 'string', count(v), min(v), max(v), count(DISTINCT v) + 1, 'F' FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' END AS v FROM orders)""",
)
def _(x):
    """Numbers below zero and with different digit counts, dates, texts, and a column with missing values."""
    orders = x.table("orders").withColumns(
        {
            "cents": F.round(F.col("o_totalprice") * 100, 0).cast("bigint") - 20000000, "day": F.to_date("o_orderdate"),
            "half": F.when(F.col("o_orderstatus") == "F", "F"),
        }
    )
    return metrics.column_profile(orders, ["o_custkey", "cents", "day", "o_orderpriority", "half"], count_missing=True)


def _px(x):
    return x.fx_grid_daily.withColumns(
        {
            "VOD_X_Hpol_Asc": F.when(F.col("cell") % 2 == 0, F.col("tau_x_h")), "LAI": F.col("tau_ku_h"), "LST": F.col("rain"),
            "row": F.when(F.col("cell") % 9 == 0, -1).otherwise(F.col("row")),
        }
    )


@query(
    "fl10_validity_flags",
    """SELECT date, cell, CASE WHEN cell % 9 = 0 THEN 0 ELSE 1 END AS predictor_valid,
       CASE WHEN cell % 9 <> 0 AND (cell % 2 = 0 OR tau_ku_h IS NOT NULL OR rain IS NOT NULL) THEN 1 ELSE 0 END AS valid_for_inference FROM fx_grid_daily""",
    ["fx_grid_daily"],
)
def _(x):
    return _px(x).select(
        "date", "cell", rasters.predictor_valid().alias("predictor_valid"), rasters.valid_for_inference(["VOD_X_Hpol_Asc"]).alias("valid_for_inference")
    )


@query(
    "fl11_inference_mask",
    """SELECT date, cell, cell % 9 <> 0 AND (cell % 2 = 0 OR tau_ku_h IS NOT NULL OR rain IS NOT NULL) AND NOT coalesce(cell % 7 = 0 AND cell % 3 <> 0, false)
       AND tau_ku_h IS NOT NULL AND cell % 11 <> 0 AS usable FROM fx_grid_daily""",
    ["fx_grid_daily"],
)
def _(x):
    ready = _px(x).withColumns(
        {
            "valid_for_inference": rasters.valid_for_inference(["VOD_X_Hpol_Asc"]),
            "nonveg_frac": F.when(F.col("cell") % 3 != 0, F.when(F.col("cell") % 7 == 0, 0.9).otherwise(0.1)),
            "lc_dom": F.when(F.col("cell") % 11 != 0, "GRA"),
        }
    )
    return ready.select("date", "cell", product.inference_mask(["LAI", "VOD_X_Hpol_Asc"]).alias("usable"))


@query(
    "fl12_temporal_inference_mask",
    """SELECT date, row, col, n = 4 AND k = 4 AND qc_raw = 0 AND NOT (cell % 7 = 0) AS usable FROM (
         SELECT *, count(*) OVER w AS n, count(tau_ku_h) OVER w AS k FROM fx_grid_daily
         WINDOW w AS (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW))""",
    ["fx_grid_daily"],
)
def _(x):
    made = windows.day_windows(x.fx_grid_daily, ["tau_x_h", "tau_ku_h"], 4, full_only=False, required=["tau_ku_h"])
    made = made.withColumns(
        {
            "valid_for_inference": F.lit(1), "lc_dom": F.lit("GRA"), "VOD_QC": F.col("qc_raw"),
            "nonveg_frac": F.when(F.col("cell") % 7 == 0, 0.9).otherwise(0.1),
        }
    )
    return made.select("date", "row", "col", product.temporal_mask(4, ["tau_x_h"]).alias("usable"))


@query(
    "fl15_non_finite_guard",
    "SELECT column_name, CAST(n_bad AS BIGINT) AS n_bad FROM (SELECT count(*) - count(tau_ku_h) AS tau_ku_h, count(*) - count(rain) AS rain, count(*) FILTER (tau_x_h > 200) AS tau_x_h FROM fx_grid_daily) UNPIVOT (n_bad FOR column_name IN (tau_ku_h, rain, tau_x_h))",
    ["fx_grid_daily"],
)
def _(x):
    odd = x.fx_grid_daily.withColumn("tau_x_h", F.when(F.col("tau_x_h") > 200, F.lit(float("nan"))).otherwise(F.col("tau_x_h")))
    return modeling.non_finite_cells(odd, ["tau_ku_h", "rain", "tau_x_h"])
