from __future__ import annotations

import threading
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from fieldmosaic.plans import experiments


@dataclass(frozen=True)
class Spec:
    code: str
    category: str = "kind"


@pytest.fixture
def base(rows, monkeypatch):
    monkeypatch.setattr(experiments, "experiment_frame", lambda base, spec, seed: base.withColumn("code", F.lit(spec.code)))
    monkeypatch.setattr(experiments, "numeric_columns", lambda base, spec: ["x"])
    return rows("x double, kind string, lfmc_pct double, split string", [(float(i), "k", 2.0 * i, ("train", "val", "test")[i % 3]) for i in range(30)])


def test_only_missing_runs_are_done(spark, base, tmp_path):
    path, done, lock = str(tmp_path / "out"), [], threading.Lock()
    broken, most, running = {("B", 44)}, [0], [0]

    def trainer(frame, numeric, category, seed):
        code = frame.select("code").first()[0]
        with lock:
            done.append((code, seed))
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            if (code, seed) in broken:
                raise RuntimeError("out of luck")
            return frame.withColumn("lfmc_pred", F.col("x") * 2 + (seed - 42))
        finally:
            with lock:
                running[0] -= 1

    specs = [Spec(c) for c in "ABC"]
    assert experiments.finished_runs(spark, path).collect() == []
    failed = experiments.run_resumable(base, specs, {"m": trainer}, path, repeats=3, seed=42, at_once=2)
    assert list(failed) == [("B", "m", 3)] and "out of luck" in failed["B", "m", 3]
    assert len(done) == 9 and 1 <= most[0] <= 2
    read = experiments.finished_runs(spark, path)
    assert {(r.scheme, r.model, r.repeat) for r in read.collect()} == {(c, "m", k) for c in "ABC" for k in (1, 2, 3)} - {("B", "m", 3)}
    assert all(r.n == 10 and r.MAE == pytest.approx(r.repeat - 1) for r in read.collect())
    done.clear()
    broken.clear()
    assert experiments.run_resumable(base, specs, {"m": trainer}, path, repeats=3, seed=42) == {}
    assert done == [("B", 44)] and experiments.finished_runs(spark, path).count() == 27
    assert experiments.run_resumable(base, specs, {"m": trainer}, path, repeats=3, seed=42) == {} and len(done) == 1
