"""Streams over arriving files; each result is compared with a batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic.functions import values
from fieldmosaic.session import scratch_path
from fieldmosaic.streaming import daily, trailing

from .registry import query, rounded


def _landed(x, df, order: str, files_per_batch: int | None = None):
    """The rows as a folder of files, so that a stream can pick them up in several batches."""
    path = scratch_path(x.spark, "landing")
    df.repartitionByRange(4, order).write.parquet(path)
    return daily.watch_folder(x.spark, path, df.schema, files_per_batch=files_per_batch)


@query(
    "str1_daily_ingest",
    "SELECT date, row, col, tau_x_h, tau_ku_h FROM fx_grid_daily WHERE tau_ku_h IS NOT NULL",
    ["fx_grid_daily"],
)
def _(x):
    """Files are cut by column, so every day arrives in parts, one file a batch."""
    stream = _landed(x, x.fx_grid_daily.select("date", "row", "col", "tau_x_h", "tau_ku_h"), "col", files_per_batch=1)
    path = scratch_path(x.spark, "ingest")
    daily.ingest_daily(stream, f"{path}/days", f"{path}/rejected", f"{path}/checkpoint", F.col("tau_ku_h").isNotNull()).awaitTermination()
    return daily.read_ingested(x.spark, f"{path}/days").select("date", "row", "col", "tau_x_h", "tau_ku_h")


@query(
    "str1_compacted_ingest",
    """SELECT date, row, col, tau_x_h, tau_ku_h, CAST((SELECT count(DISTINCT date) FROM fx_grid_daily WHERE tau_ku_h IS NOT NULL) AS BIGINT) AS first_days, CAST(0 AS BIGINT) AS again_days
       FROM fx_grid_daily WHERE tau_ku_h IS NOT NULL""",
    ["fx_grid_daily"],
)
def _(x):
    """All days ingested in parts and compacted, read without merging; a second compaction finds nothing to do."""
    stream = _landed(x, x.fx_grid_daily.select("date", "row", "col", "tau_x_h", "tau_ku_h"), "col", files_per_batch=1)
    path = scratch_path(x.spark, "ingest")
    daily.ingest_daily(stream, f"{path}/days", f"{path}/rejected", f"{path}/checkpoint", F.col("tau_ku_h").isNotNull()).awaitTermination()
    counts = [daily.compact_ingested(x.spark, f"{path}/days", f"{path}/compacted") for _ in range(2)]
    read = daily.read_compacted(x.spark, f"{path}/days", f"{path}/compacted")
    return read.select("date", "row", "col", "tau_x_h", "tau_ku_h", F.lit(counts[0]).cast("long").alias("first_days"), F.lit(counts[1]).cast("long").alias("again_days"))


@query(
    "str2_sliding_rain",
    """SELECT day AS date, row, col, round(sum(rain), 6) AS rain_7day, count(rain) AS rain_7day_valid_days
       FROM (SELECT row, col, rain, unnest(range(7)) AS k, date FROM fx_grid_daily) t, LATERAL (SELECT CAST(t.date + CAST(t.k AS INT) AS DATE) AS day) d
       WHERE day + 1 <= (SELECT max(date) FROM fx_grid_daily) - 3 GROUP BY day, row, col""",
    ["fx_grid_daily"],
)
def _(x):
    """Windows that can no longer change: those that end three days before the newest tile."""
    stream = _landed(x, x.fx_grid_daily.select("date", "row", "col", "rain"), "date")
    path = scratch_path(x.spark, "sliding")
    summed = daily.sliding_sum(stream, "rain", late="3 days")
    daily.write_available(summed, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return rounded(x.spark.read.schema(summed.schema).parquet(f"{path}/table"), "rain_7day")


@query(
    "str2_late_tiles",
    """SELECT date, row, col, round(sum(rain) OVER w, 6) AS rain_7day, count(rain) OVER w AS rain_7day_valid_days FROM fx_grid_daily
       WINDOW w AS (PARTITION BY row, col ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
    ["fx_grid_daily"],
)
def _(x):
    """Every third day comes after all others, beyond any watermark; the sums are refreshed after each arrival."""
    tiles = x.fx_grid_daily.select("date", "row", "col", "rain")
    path, late = scratch_path(x.spark, "late"), F.day("date") % 3 == 0
    for arrival in (tiles.where(~late), tiles.where(late)):
        arrival.write.mode("append").parquet(f"{path}/landing")
        stream = daily.watch_folder(x.spark, f"{path}/landing", tiles.schema)
        daily.ingest_daily(stream, f"{path}/days", f"{path}/rejected", f"{path}/checkpoint", F.lit(True)).awaitTermination()
        trailing.refresh_trailing(x.spark, f"{path}/days", f"{path}/sums", "rain")
    made = trailing.read_trailing(x.spark, f"{path}/sums")
    return rounded(made.select("date", "row", "col", "rain_7day", "rain_7day_valid_days"), "rain_7day")


@query(
    "str3_arriving_site_days",
    """WITH s AS (SELECT ts, CAST(CAST(round_even(lat / 1e-4, 0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(round_even(lon / 1e-4, 0) AS BIGINT) AS VARCHAR) AS site_loc_id,
                         CASE WHEN trim(lower(functional_type)) = 'graminoid' THEN 'Grass' WHEN functional_type = 'large shrub' THEN 'Shrub' WHEN functional_type = 'Small tree' THEN 'Tree' ELSE 'Unknown' END AS veg_type,
                         TRY_CAST(lfmc_raw AS DOUBLE) AS v FROM fx_obs)
       SELECT site_loc_id, CAST(ts AS DATE) AS date, veg_type, round(avg(v), 6) AS lfmc_pct, count(*) AS n_obs FROM s
       WHERE CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= date_trunc('millisecond', (SELECT max(ts) FROM s)) - INTERVAL 2 DAYS GROUP BY 1, 2, 3""",
    ["fx_obs"],
)
def _(x):
    """Every sample arrives twice; days that can no longer change are written."""
    samples = x.fx_obs.select(
        "sorting_id", "lat", "lon", "functional_type", F.col("ts").cast("timestamp").alias("ts"), values.to_number("lfmc_raw").alias("lfmc_pct")
    )
    stream = _landed(x, samples.unionByName(samples), "ts")
    path = scratch_path(x.spark, "arrivals")
    made = daily.arriving_site_days(stream)
    daily.write_available(made, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return rounded(x.spark.read.schema(made.schema).parquet(f"{path}/table"), "lfmc_pct")
