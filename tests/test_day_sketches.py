from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic.operators import day_sketches as S

DISTINCT = {"sites": ["site"], "pairs": ["site", "place"]}


def samples(spark, n=60_000):
    row = F.xxhash64("id")
    return spark.range(n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("date"),
        F.when(F.col("id") % 50 != 0, F.pmod(row, F.lit(9000))).alias("site"),
        F.pmod(row, F.lit(7)).alias("place"), F.when(F.col("id") % 9 != 0, (F.col("id") % 100).cast("double")).alias("v"),
    )


def test_merged_days_within_the_stated_error(spark):
    df = samples(spark)
    days = S.day_sketches(df, DISTINCT, "v")
    for chosen in ("date >= '2024-01-01'", "date < '2024-01-06'"):
        rows = df.where(chosen)
        got = S.merged_report(days.where(chosen), ["sites", "pairs"]).first()
        want = rows.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.max("date").alias("d"), F.count_distinct("site").alias("s"), F.count_distinct("site", "place").alias("p")).first()
        assert got["n_rows"] == want["n"] and abs(got["mean_value"] - want["m"]) < 1e-9 and got["date_max"] == want["d"]
        assert abs(got["n_sites"] - want["s"]) <= S.RELATIVE_ERROR * want["s"] and abs(got["n_pairs"] - want["p"]) <= S.RELATIVE_ERROR * want["p"]


def test_a_new_day_is_merged_without_past_rows(spark, tmp_path):
    df, path = samples(spark, 5000), str(tmp_path / "days")
    S.day_sketches(df.where("date < '2024-01-15'"), DISTINCT, "v").write.parquet(path)
    S.day_sketches(df.where("date >= '2024-01-15'"), DISTINCT, "v").write.mode("append").parquet(path)
    stored = S.merged_report(spark.read.parquet(path), ["sites", "pairs"]).first().asDict()
    direct = S.merged_report(S.day_sketches(df, DISTINCT, "v"), ["sites", "pairs"]).first().asDict()
    exact = df.agg(F.count_distinct("site").alias("n_sites"), F.count_distinct("site", "place").alias("n_pairs")).first()
    for report in (stored, direct):  # the order of merging moves an estimate within the error
        for name in ("n_sites", "n_pairs"):
            assert abs(report.pop(name) - exact[name]) <= S.RELATIVE_ERROR * exact[name]
    assert stored == direct


def test_parts_stay_apart_and_empty_tables(spark):
    rows = [("2024-01-01", "a", "bc", 1.0), ("2024-01-01", "ab", "c", None), ("2024-01-01", None, "c", 2.0), (None, "a", "bc", 3.0)]
    df = spark.createDataFrame(rows, "date string, site string, place string, v double")
    made = S.merged_report(S.day_sketches(df, DISTINCT, "v"), ["sites", "pairs"]).first()
    assert (made["n_rows"], made["n_sites"], made["n_pairs"], made["mean_value"]) == (4, 2, 2, 2.0)
    none = S.merged_report(S.day_sketches(df.limit(0), DISTINCT, "v"), ["sites", "pairs"]).first()
    assert (none["n_rows"], none["n_sites"], none["mean_value"]) == (0, 0, None)
