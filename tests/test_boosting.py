from __future__ import annotations

import random

import pytest

from fieldmosaic.operators import modeling

SCHEMA = "sample_id long, x double, z double, lfmc_pct double, split string"


@pytest.fixture
def steps(rows):
    """A target of two steps in x, alternating splits, and noise that only the training rows have."""
    rng = random.Random(7)
    data = []
    for i in range(240):
        x = (i % 60) / 60
        split = ("train", "train", "val", "test")[i // 60]
        noise = rng.gauss(0, 8) if split == "train" else 0.0
        data.append((i, x, rng.random(), 50.0 + 40 * (x > 0.3) + 60 * (x > 0.7) + noise, split))
    return rows(SCHEMA, data)


def test_best_prefix():
    assert modeling.best_prefix([5, 4, 3, 3, 3.5, 2], 2) == (3, 5)
    assert modeling.best_prefix([5, 4, 3, 3, 3.5, 2], 3) == (6, None)
    assert modeling.best_prefix([1, 2], 5) == (1, None)
    assert modeling.best_prefix([3], 1) == (1, None)


def test_staged_errors_and_first_trees_equal_sums_of_trees(steps):
    train = steps.where("split = 'train'")
    val = steps.where("split = 'val'")
    for loss in ("absolute", "squared"):
        model = modeling.tree_pipeline(["x", "z"], None, loss=loss, iterations=6, rate=0.3, depth=3).fit(train)
        trees = model.stages[-1]
        points = [(r.features, r.lfmc_pct) for r in model.transform(val).select("features", "lfmc_pct").collect()]
        errors = modeling.staged_errors(model, val, loss)
        for k in range(1, 7):
            sums = [sum(w * t.predict(f) for w, t in zip(trees.treeWeights[:k], trees.trees[:k])) for f, _ in points]
            apart = [abs(y - s) if loss == "absolute" else (y - s) ** 2 for (_, y), s in zip(points, sums)]
            assert errors[k - 1] == pytest.approx(sum(apart) / len(apart), rel=1e-9)
            cut = modeling.first_trees(model, k)
            assert cut.stages[-1].getNumTrees == k
            assert [r.lfmc_pred for r in cut.transform(val).select("lfmc_pred").collect()] == pytest.approx(sums)


def test_waiting_equals_one_long_fit(steps, tmp_path):
    """However often the number of trees was doubled, the model is the best prefix of the whole fit."""
    whole = modeling.tree_pipeline(["x", "z"], None, iterations=16, rate=0.5, depth=1).fit(steps.where("split = 'train'"))
    errors = modeling.staged_errors(whole, steps.where("split = 'val'"))
    for patience in (1, 3):
        best, stop = modeling.best_prefix(errors, patience)
        found = modeling.fit_best_trees(steps, ["x", "z"], iterations=16, patience=patience, rate=0.5, depth=1)
        assert found.trees == best and list(found.errors) == pytest.approx(errors[:stop])
        want = [r.lfmc_pred for r in modeling.first_trees(whole, best).transform(steps).orderBy("sample_id").select("lfmc_pred").collect()]
        got = [r.lfmc_pred for r in found.model.transform(steps).orderBy("sample_id").select("lfmc_pred").collect()]
        assert got == pytest.approx(want)
    # the steps are found: predictions rise with x, and their error falls from the first tree on
    test = found.model.transform(steps.where("split = 'test'")).select("x", "lfmc_pred").collect()
    mean = lambda low, high: sum(r.lfmc_pred for r in test if low < r.x <= high) / max(1, sum(low < r.x <= high for r in test))
    assert mean(-1, 0.25) + 5 < mean(0.35, 0.65) < mean(0.75, 1) - 5
    assert min(found.errors) < errors[0]
    path = str(tmp_path / "model")
    found.model.write().overwrite().save(path)
    again = modeling.PipelineModel.load(path)
    assert [r.lfmc_pred for r in again.transform(steps).orderBy("sample_id").select("lfmc_pred").collect()] == pytest.approx(got)


def test_without_validation_rows_all_trees_are_kept(steps):
    found = modeling.fit_best_trees(steps.where("split <> 'val'"), ["x"], iterations=3, patience=1, depth=2)
    assert found.trees == 3 and found.errors == () and found.model.stages[-1].getNumTrees == 3
