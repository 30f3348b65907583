from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from catalog import ENTRIES
from catalog.registry import Inputs
from fieldmosaic.operators import align, cleaning, dedup, metrics, modeling, rasters, scale, splits, windows
from fieldmosaic.plans import frames
from fieldmosaic.sources import rasters as grids
from fieldmosaic.sources import tables
from fieldmosaic.streaming import daily


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def skewed(spark, n=4000):
    """One group holds most rows."""
    k = F.col("id")
    return spark.range(n).select(k, F.when(k % 7 == 0, k % 50).otherwise(0).alias("g"), ((k * 7919) % 613 / 10).alias("v"))


def test_sliced_quantiles_equal_plain_ones(spark):
    df = skewed(spark)
    wanted = {"lo": ("v", 0.1), "mid": ("v", 0.5), "hi": ("v", 0.99)}
    plain = {tuple(r) for r in scale.group_quantiles(df, ["g"], wanted).collect()}
    sliced = {tuple(r) for r in scale.group_quantiles(df, ["g"], wanted, large_groups=True).collect()}
    assert plain == sliced and len(plain) == 50


@pytest.mark.parametrize("name", ["ag1_site_day_median", "ag22_band_scale", "ag26_describe", "wn2_observation_windows", "cp1_clean_grid_day", "cp11_temporal_coverage"])
def test_plans_are_built_without_jobs(spark, name):
    context = spark.sparkContext
    query = next(item.run for key, item in ENTRIES.items() if key.startswith(name.partition("_")[0] + "_"))
    query(spark, "/root/testdata/sf0.001")  # file listing and schemas
    context.setJobGroup("plan", name)
    query(spark, "/root/testdata/sf0.001")
    jobs = [j for j in context.statusTracker().getJobIdsForGroup("plan")]
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
    assert all("parquet" in (context.statusTracker().getStageInfo(s).name or "") for s in stages if context.statusTracker().getStageInfo(s))


def test_global_quantiles_of_a_large_table(spark):
    df = skewed(spark)
    values = [r.v for r in df.collect()]
    row = scale.group_quantiles(df, [], {"mid": ("v", 0.5)}, [F.count(F.lit(1)).alias("n")], large_groups=True).first()
    assert row.mid == pytest.approx(statistics.median(values)) and row.n == len(values)


def test_row_index_is_dense(spark):
    made = scale.row_index(skewed(spark), ["v", "id"]).collect()
    expected = {r.id: i for i, r in enumerate(sorted(made, key=lambda r: (r.v, r.id)))}
    assert all(r.sample_id == expected[r.id] for r in made)


def test_smallest_mode(rows):
    df = rows("g int, s string", [(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (2, "a")])
    got = {tuple(r) for r in scale.smallest_mode(df, ["g"], "s", "m", "n").collect()}
    assert got == {(1, "a", 2), (2, "z", 2)}


def test_lowest_n_over_salts(spark):
    df = skewed(spark)
    got = scale.lowest_n(df, ["g"], [F.col("v"), F.col("id")], 5, salts=4).collect()
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.g, []).append((r.v, r.id))
    want = {(g, v, i) for g, items in by_group.items() for v, i in sorted(items)[:5]}
    assert {(r.g, r.v, r.id) for r in got} == want


@pytest.mark.parametrize("steps", [1, 2, 4])
def test_sliced_observation_windows(spark, steps):
    df = skewed(spark, 1500).withColumnRenamed("g", "site_key").withColumn("date", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int")))
    df = df.withColumnRenamed("id", "sample_id")
    plain = {(r.sample_id, str(r.dyn_seq)) for r in windows.observation_windows(df, ["v"], steps).collect()}
    sliced = {(r.sample_id, str(r.dyn_seq)) for r in windows.observation_windows(df, ["v"], steps, large_groups=True, slices=16).collect()}
    assert plain == sliced and plain


def test_only_full_windows(rows):
    data = [("a", day(d), i) for i, d in enumerate([0, 1, 31])] + [("b", day(d), 10 + d) for d in range(4)] + [("c", day(d), 20 + d) for d in (0, 1, 2, 3, 3, 40)]
    df = rows("site_key string, date date, sample_id int", data).withColumn("v", F.col("sample_id").cast("double"))
    made = windows.observation_windows(df, ["v"], 4).groupBy("site_key").count()
    assert {tuple(r) for r in made.collect()} == {("b", 1), ("c", 3)}


def test_trailing_sum_over_chunk_borders(rows):
    data = [(0, 0, day(d), None if d % 5 == 0 else float(d)) for d in range(0, 150) if d % 11 != 3]
    df = rows("row int, col int, date date, rain double", data)
    got = {r.date: (r.rain_7day, r.rain_7day_valid_days) for r in windows.trailing_sum(df, "rain").collect()}
    by_day = {d: v for _, _, d, v in data}
    for d in by_day:
        seen = [by_day.get(d - dt.timedelta(days=k)) for k in range(7)]
        seen = [v for v in seen if v is not None]
        assert got[d] == (sum(seen) if seen else None, len(seen))


def test_as_of_year(rows):
    samples = rows("id int, row int, col int, year int", [(1, 0, 0, 2000), (2, 0, 0, 2001), (3, 0, 0, 2004), (4, 0, 0, 2010), (5, 9, 9, 2004)])
    grid = rows("year int, row int, col int, v double", [(2001, 0, 0, 1.0), (2003, 0, 0, 3.0), (2005, 0, 0, 5.0)])
    got = {r.id: (r.year_used, r.v) for r in align.as_of_year(samples, grid).collect()}
    assert got == {1: (2001, 1.0), 2: (2001, 1.0), 3: (2003, 3.0), 4: (2005, 5.0), 5: (2003, None)}


def test_interpolation(rows):
    grid = rows("date date, row int, col int, lai double", [(day(0), 0, 0, 1.0), (day(8), 0, 0, 3.0), (day(16), 0, 0, None)])
    samples = rows("id int, date date, row int, col int", [(1, day(-1), 0, 0), (2, day(0), 0, 0), (3, day(2), 0, 0), (4, day(12), 0, 0), (5, day(17), 0, 0)])
    got = {r.id: r.lai for r in align.interpolated_values(samples, grid, "lai").collect()}
    assert got == {1: None, 2: 1.0, 3: 1.5, 4: None, 5: None}


def test_lookups_do_not_multiply_rows(rows):
    grid = rows("index_date date, row int, col int, lai double", [(day(0), 0, 0, 1.0), (day(8), 1, 0, 2.0)])
    samples = rows("id int, date date, row int, col int", [(1, day(3), 0, 0), (2, day(9), 0, 0), (3, day(20), 0, 0)])
    got = {r.id: (r.lai, r.lai_index_date) for r in align.eight_day_values(samples, grid, "lai").collect()}
    assert got == {1: (1.0, day(0)), 2: (None, day(8)), 3: (None, None)}


def test_source_preference_is_per_day(rows):
    first = rows("date date, row int, col int, rain double", [(day(0), 0, 0, None)])
    second = rows("date date, row int, col int, rain double", [(day(0), 0, 0, 5.0), (day(1), 0, 0, 6.0)])
    assert {(r.date, r.rain) for r in align.preferred_by_date(first, second).collect()} == {(day(0), None), (day(1), 6.0)}


def test_split_counts_round_half_to_even(spark):
    blocks = spark.range(605).select(F.col("id").cast("string").alias("block_id"))
    got = {r.split: r["count"] for r in splits.assign_blocks(blocks).groupBy("split").count().collect()}
    assert got == {"train": 484, "val": 60, "test": 61}


def test_no_block_in_two_splits(spark):
    k = F.col("id")
    df = spark.range(3000).select((k % 170 - 85).cast("double").alias("lat"), (k * 7 % 360 - 180).cast("double").alias("lon"))
    assert splits.split_overlaps(splits.spatial_split(df)).isEmpty()


def test_mosaic_first_tile_last_pixel(rows):
    data = [(2, 1, 10.01, 20.01, 9.0), (1, 1, 10.01, 20.01, 5.0), (1, 2, 10.02, 20.02, 6.0), (3, 1, 50.0, 20.0, None)]
    df = rows("tile int, pixel_no int, lat double, lon double, h double", data)
    assert {r.h for r in rasters.mosaic(df, ["h"]).collect()} == {6.0, None}


def test_block_mean_drops_odd_edge_and_missing(rows):
    df = rows("row int, col int, v double", [(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (2, 0, 7.0), (0, 2, None), (1, 3, None)])
    got = {(r.row, r.col): r.v for r in rasters.block_mean(df, ["v"], 2, size=(3, 4)).collect()}
    assert got == {(0, 0): 2.0, (0, 1): None}


def test_metrics_of_small_groups(rows):
    df = rows("g string, y double, y_hat double", [("one", 1.0, 2.0), ("const", 3.0, 2.0), ("const", 3.0, 4.0), ("gap", 1.0, None)])
    got = {r.g: r for r in metrics.regression_metrics(df, ["g"], measures=["n", "MAE", "RMSE", "R", "R2"]).collect()}
    assert (got["one"].n, got["one"].MAE, got["one"].R, got["one"].R2) == (1, 1.0, None, None)
    assert (got["const"].RMSE, got["const"].R2) == (1.0, None) and got["gap"].n == 0 and got["gap"].MAE is None


# Three repeats of one experiment and their published mean and deviation (test split).
REPEATS = [(18.09509939869453, 25.63672016920385), (17.82156353206176, 25.157253646776795), (18.100612040543066, 25.512474593997457)]


def test_repeat_summary_golden(rows):
    df = rows("scheme string, model string, split string, MAE double, RMSE double", [("A0", "m", "test", *r) for r in REPEATS])
    row = metrics.repeat_summary(df, measures=["MAE", "RMSE"]).first()
    assert row.MAE_mean == pytest.approx(18.005758323766454, rel=1e-12) and row.MAE_std == pytest.approx(0.15954118049390514, rel=1e-9)
    assert row.RMSE_mean == pytest.approx(25.435482803326035, rel=1e-12) and row.RMSE_std == pytest.approx(0.24883295281205864, rel=1e-9)


def test_single_repeat_has_no_deviation(rows):
    df = rows("scheme string, model string, split string, MAE double", [("A0", "m", "test", 1.0)])
    assert metrics.repeat_summary(df, measures=["MAE"]).first().MAE_std is None


def test_conflicts_ignore_missing_names(rows):
    data = [("a", 1.0, 2.0), ("a", 1.5, 2.0), ("b", 3.0, 4.0), ("c", 3.0, 4.0), (None, 1.0, 2.0), ("d", 95.0, 2.0), ("d", 5.0, 2.0)]
    df = rows("site_name string, lat double, lon double", data).withColumns({"date": F.current_date(), "lfmc_pct": F.lit(1.0)})
    got = {(r.site_name, r.lat): (r.site_coord_conflict, r.coord_site_conflict) for r in cleaning.add_flags(df).collect()}
    assert got[("a", 1.0)] == (1, 0) and got[("b", 3.0)] == (0, 1) and got[("d", 5.0)] == (0, 0) and got[(None, 1.0)] == (0, 0)


def test_headers_with_spaces_and_config(rows):
    df = rows("`Latitude\xa0` string, Longitude string, `Sampling date ` string, `my value` string, other string", [("1", "2", "20240101", "80", "x")])
    row = cleaning.standardise(df, {"lfmc_pct": "my value"}).first()
    assert (row.lat, row.lon, row.date, row.lfmc_pct, row.other) == (1.0, 2.0, day(0), 80.0, "x")
    with pytest.raises(KeyError):
        cleaning.standardise(rows("a string", [("x",)]))


def test_site_day_rejects_missing_columns(rows):
    with pytest.raises(ValueError):
        dedup.site_day(rows("lat double", [(1.0,)]))


def test_scaling_fills_bands_only(rows):
    df = rows("VOD_X_Hpol_Asc double, LAI double", [(1.0, 2.0), (3.0, 2.0), (None, 2.0)])
    columns = ["VOD_X_Hpol_Asc", "LAI"]
    made = modeling.standardise(df, columns, modeling.feature_statistics(df, columns)).collect()
    assert made[2]["VOD_X_Hpol_Asc"] == 0.0 and [r.LAI for r in made] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        modeling.require_finite(rows("LAI double", [(None,)]), ["LAI"])


def test_unknown_labels_get_the_last_id(rows):
    train = rows("k string", [("b",), ("a",), ("b",)])
    ids = modeling.label_ids(train, "k")
    got = {r.k: r.label_id for r in modeling.encode_labels(rows("k string", [("a",), ("b",), ("z",), (None,)]), "k", ids).collect()}
    assert got == {"a": 0, "b": 1, "z": 2, None: 2}


def test_partition_pruning_reaches_the_scan(spark, rows, tmp_path):
    grids.write_grid(rows("date date, row int, col int, v double", [(day(d), 1, 1, 1.0) for d in range(5)]), str(tmp_path / "g"))
    df = grids.read_days(spark, str(tmp_path / "g"), "2024-01-02", "2024-01-03").select("v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 2 and "PartitionFilters: [isnotnull(date" in plan and "ReadSchema: struct<v:double>" in plan


def test_readers_refuse_other_files(spark):
    for path in ("/x/a.xlsx", "/x/a"):
        with pytest.raises(ValueError):
            tables.read_table(spark, path)
        with pytest.raises(ValueError):
            tables.read_samples(spark, path)


def ingest(spark, folder, files, closed=None):
    """Files one batch each into ``folder``; returns the ingested rows."""
    schema = "date date, row int, col int, v double"
    for name, data in files.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/land/{name}")
    stream = daily.watch_folder(spark, f"{folder}/land/*", spark.createDataFrame([], schema).schema, files_per_batch=1)
    daily.ingest_daily(stream, f"{folder}/days", f"{folder}/bad", f"{folder}/check", F.col("v").isNotNull(), closed=closed).awaitTermination()
    return sorted(tuple(r) for r in daily.read_ingested(spark, f"{folder}/days").select("date", "row", "col", "v").collect())


def test_a_day_over_several_batches_keeps_all_rows(spark, tmp_path):
    first = [(day(0), 0, c, float(c)) for c in range(60)]
    second = [(day(0), 0, c, float(c)) for c in range(60, 100)] + [(day(1), 0, 0, 7.0), (day(1), 0, 1, None)]
    got = ingest(spark, str(tmp_path), {"a": first})
    assert got == first
    got = ingest(spark, str(tmp_path), {"b": second})
    assert got == first + [r for r in second if r[3] is not None]
    # the same cells again change nothing, whatever their values
    assert ingest(spark, str(tmp_path), {"c": [(day(0), 0, 5, -1.0)]}) == got


def test_a_batch_that_runs_again_gives_the_same_table(spark, tmp_path):
    rows_ = [(day(0), 0, c, float(c)) for c in range(20)]
    got = ingest(spark, str(tmp_path), {"a": rows_[:10], "b": rows_[10:]})
    # the last commit is forgotten, as after a failure before it
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in [commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:
        path.unlink(missing_ok=True)
    assert ingest(spark, str(tmp_path), {}) == got == rows_


def test_closed_days_are_skipped(spark, tmp_path):
    done = spark.createDataFrame([(day(0),)], "date date")
    got = ingest(spark, str(tmp_path), {"a": [(day(0), 0, 0, 1.0), (day(1), 0, 0, 2.0)]}, closed=lambda: done)
    assert got == [(day(1), 0, 0, 2.0)]


def test_profile_compares_numbers_as_numbers(rows):
    df = rows("a long, b double, c string, d date", [(i, i - 700.5, f"x{i}", day(i)) for i in range(1500)] + [(None, None, None, None)])
    got = {r.column_name: r for r in metrics.column_profile(df, df.columns, preview=2, count_missing=True).collect()}
    assert (got["a"].min_text, got["a"].max_text, got["a"].n_distinct, got["a"].n_present, got["a"].preview) == ("0", "1499", 1501, 1500, "0|1")
    assert (got["b"].min_text, got["b"].max_text, got["b"].preview) == ("-700.5", "798.5", "-700.5|-699.5")
    assert got["c"].max_text == "x999" and got["d"].max_text == str(day(1499)) and got["d"].data_type == "date"
    assert metrics.column_profile(df, ["a"]).first().n_distinct == 1500


def test_first_source_that_has_the_day(rows):
    make = lambda days, v: rows("date date, v int", [(day(d), v) for d in days])
    got = {(r.date, r.v, r.source) for r in grids.first_available([make([1, 4], 10), make([1, 2], 20), make([1, 2, 3], 30)]).collect()}
    assert got == {(day(1), 10, 0), (day(4), 10, 0), (day(2), 20, 1), (day(3), 30, 2)}


def test_scores_read_the_input_once(spark, rows):
    k = F.col("id")
    frame = spark.range(200).select(k.alias("sample_id"), (k % 7).cast("double").alias("a"), F.when(k % 2 == 0, "x").otherwise("y").alias("c"),
                                    (k % 7 * 2).cast("double").alias("lfmc_pct"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"))
    model = modeling.fit_trees(frame, ["a"], "c", iterations=2, rate=0.5, depth=2)
    asked = rows("sample_id int, a double, c string", [(1, 3.0, "x"), (2, None, "x"), (3, float("nan"), "y"), (4, 6.0, None), (5, 6.0, "new")])
    made = modeling.score(model, asked, F.col("a").isNotNull() & ~F.isnan("a") & F.col("c").isNotNull())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {r.sample_id: (r.a, r.c, r.lfmc_pred) for r in made.collect()}
    assert got[1][2] is not None and got[5][2] is not None and got[2] == (None, "x", None) and got[3][2] is None and got[4] == (6.0, None, None)


def test_proportions_without_a_number_count_as_zero(spark):
    view = Inputs(spark, "/root/testdata/sf0.001").fx_predictors
    mixed = view.withColumns({"IGBP_prop_Grasslands": F.lit(float("nan")), "IGBP_prop_Savannas": F.lit(2.0), "IGBP_prop_Barren": F.lit(9.0)})
    made = frames.training_base(mixed).select("igbp_dom", "igbp_dom_frac", "igbp_entropy", "igbp_weight").distinct().collect()
    assert [tuple(r) for r in made] == [("Savannas", 1.0, 0.0, 1.0)]
