"""A scheme may keep no row, or fewer rows than its category has values."""

from __future__ import annotations

import datetime
import threading
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from catalog import ENTRIES
from fieldmosaic.operators import modeling
from fieldmosaic.plans import experiments


def test_runs_of_a_scheme_without_rows_end_without_metric_rows(rows, spark, monkeypatch, tmp_path):
    called = []

    def frame_of(base, spec, seed):
        return base.where(F.lit(spec.code == "A"))

    def trainer(frame, numeric, category, seed):
        called.append(seed)
        return frame.withColumn("lfmc_pred", F.col("x") * 2 + 1)

    monkeypatch.setattr(experiments, "experiment_frame", frame_of)
    monkeypatch.setattr(experiments, "numeric_columns", lambda base, spec: ["x"])
    base = rows("x double, lfmc_pct double, split string", [(float(i), 2.0 * i, ("train", "test")[i % 2]) for i in range(8)])
    specs = [SimpleNamespace(code=c, description=f"about {c}", category="x") for c in "AB"]
    found = experiments.run_experiments(base, specs, {"m": trainer}, repeats=2, seed=42).collect()
    assert {(r.scheme, r.repeat, r.split, r.n) for r in found} == {("A", k, s, 4) for k in (1, 2) for s in ("train", "test")}
    assert sorted(called) == [42, 43]
    path = str(tmp_path / "out")
    assert experiments.run_resumable(base, specs, {"m": trainer}, path, repeats=2) == {}
    assert experiments.ended_runs(spark, path) == {(c, "m", k) for c in "AB" for k in (1, 2)}
    monkeypatch.setattr(experiments, "experiment_frame", None)  # a second call has nothing to do
    assert experiments.run_resumable(base, specs, {"m": trainer}, path, repeats=2) == {}


@pytest.mark.parametrize("name", ["cp9_experiment_runs", "cp9_resumed_runs"])
def test_cp9_with_no_row_for_the_last_scheme_equals_its_sql(name, rows, spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    event = [(i, at + datetime.timedelta(days=i % 9), i % 40, ("click", "view")[i % 2], 1.0 + i % 50, "{}") for i in range(600)]
    # in every cell a third of the class shares is no vegetation
    customer = [(25200 * k + c, "c", 15 if k % 3 else c % 3, 1.0, "BUILDING") for c in range(40) for k in range(12)]
    rows("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", event).write.parquet(f"{tmp_path}/events.parquet")
    rows("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", customer).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    wanted = con.sql(ENTRIES[name].sql).fetchall()
    assert {r[0] for r in wanted} >= {"S1_FT", "S6_LC_DOM_FE_W_CONS"} and "S7_LC_DOM_FE_W_CONS_NV" not in {r[0] for r in wanted}
    assert sorted(map(tuple, ENTRIES[name].run(spark, str(tmp_path)).collect())) == sorted(wanted)


@pytest.mark.parametrize("fit", [modeling.fit_trees, lambda df, *a, **o: modeling.fit_best_trees(df, *a, patience=2, **o).model])
@pytest.mark.parametrize("extra", [[], [(7.0, "q", 5.0, 1.0, "val")]])
def test_fewer_rows_than_values_of_the_category_can_be_learned(rows, fit, extra):
    schema = "x double, kind string, lfmc_pct double, w double, split string"
    df = rows(schema, [(1.0, "p", 10.0, 1.0, "train"), (2.0, "r", 30.0, 1.0, "train"), *extra])
    model = fit(df, ["x"], "kind", weight="w", iterations=1, rate=1.0, depth=1)
    found = model.transform(df.where("split = 'train'")).select("x", "lfmc_pred").collect()
    assert {(r.x, r.lfmc_pred) for r in found} == {(1.0, 10.0), (2.0, 30.0)}


def test_rows_repeated_for_the_category_keep_their_weight_and_val_rows_are_not_repeated(rows):
    df = rows("k string, s string", [("a", "train"), ("b", "train"), ("c", "val")])
    counts = {r.k: r["count"] for r in modeling.enough_rows(df, "k", F.col("s") == "train", 5).groupBy("k").count().collect()}
    assert counts == {"a": 3, "b": 3, "c": 1}
    assert modeling.enough_rows(df, None, F.col("s") == "train", 5) is df
    assert modeling.enough_rows(df.withColumn("k", F.lit("a")), "k", F.lit(True), 5).count() == 3


@pytest.mark.parametrize("shared,most", [(100, 3), (1, 1)])
def test_runs_over_a_large_base_are_done_one_at_a_time(rows, spark, monkeypatch, tmp_path, shared, most):
    running, seen, lock, together = [0], [], threading.Lock(), threading.Event()

    def trainer(frame, numeric, category, seed):
        with lock:
            running[0] += 1
            seen.append(running[0])
            if running[0] == 3:
                together.set()
        together.wait(5 if most > 1 else 0.2)
        with lock:
            running[0] -= 1
        return frame.withColumn("lfmc_pred", F.col("lfmc_pct"))

    monkeypatch.setattr(experiments, "SHARED_ROWS", shared)
    monkeypatch.setattr(experiments, "experiment_frame", lambda base, spec, seed: base)
    monkeypatch.setattr(experiments, "numeric_columns", lambda base, spec: ["x"])
    base = rows("x double, lfmc_pct double, split string", [(float(i), 2.0 * i, "train") for i in range(20)])
    specs = [SimpleNamespace(code=c, category="x") for c in "ABC"]
    assert experiments.run_resumable(base, specs, {"m": trainer}, str(tmp_path / "out"), at_once=3) == {}
    assert max(seen) == most and experiments.finished_runs(spark, str(tmp_path / "out")).count() == 3


def test_rows_that_the_caller_keeps_are_not_kept_twice(rows):
    df = rows("x double, split string", [(1.0, "train"), (2.0, "test")])
    with modeling.kept_rows(df) as used:
        assert used.storageLevel.useMemory and used.count() == 1
    assert not used.storageLevel.useMemory
    df.persist()
    with modeling.kept_rows(df) as used:
        assert not used.storageLevel.useMemory and used.count() == 1
    assert df.storageLevel.useMemory
    df.unpersist()
