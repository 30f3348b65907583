"""Frames of experiments are made once, and their rows need no shuffle to meet the split."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from fieldmosaic.functions import landcover
from fieldmosaic.plans import experiments


def test_a_frame_is_made_once_for_all_runs(rows, monkeypatch):
    made = []
    monkeypatch.setattr(experiments, "experiment_frame", lambda base, spec, seed: made.append(spec.code) or base.withColumn("code", F.lit(spec.code)))
    monkeypatch.setattr(experiments, "numeric_columns", lambda base, spec: ["x"])
    base = rows("x double, lfmc_pct double, split string", [(float(i), 2.0 * i, ("train", "test")[i % 2]) for i in range(8)])
    specs = [SimpleNamespace(code=c, description=f"about {c}", category="x") for c in "AB"]
    trainers = {"m": lambda frame, numeric, category, seed: frame.withColumn("lfmc_pred", F.col("x") * 2 + 1) if frame.storageLevel.useMemory else frame}
    found = experiments.run_experiments(base, specs, trainers, repeats=2).collect()
    assert sorted(made) == ["A", "B"] and not base.storageLevel.useMemory
    assert {(r.scheme, r.scheme_desc, r.repeat, r.split, r.n, r.MAE) for r in found} == {
        (c, f"about {c}", k, s, 4, 1.0) for c in "AB" for k in (1, 2) for s in ("train", "test")
    }


def test_sums_over_stored_shares_equal_the_written_out_ones(rows):
    df = rows("a double, b double, c double", [(0.1, 0.2, 0.7), (0.0, None, 0.0), (-1.0, 3.0, 0.3), (None, 0.25, 1e-5)])
    stored = df.withColumn("s", landcover.fractions(["a", "b", "c"]))
    for make in (landcover.dominant_share, landcover.entropy):
        got = stored.select(make(["a", "b", "c"], "s").alias("x"), make(["a", "b", "c"]).alias("y"))
        assert all(r.x == r.y for r in got.collect())
        assert "lambda" not in stored.select(make(["a", "b", "c"], "s"))._jdf.queryExecution().optimizedPlan().toString()
