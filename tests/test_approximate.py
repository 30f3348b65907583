from __future__ import annotations

import random

import pytest

from fieldmosaic.operators import metrics

WANTED = {"low": 0.05, "mid": 0.5, "high": 0.99}


def off(values, found, p):
    below, up_to = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
    return max(0.0, below - p, p - up_to)


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_ranks_stay_within_the_stated_error(rows, error):
    rng = random.Random(6)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(6000)], "ties": [float(rng.randint(0, 3)) for _ in range(900)], "one": [4.0], None: [rng.random() for _ in range(50)]}
    data = [(g, v) for g, some in groups.items() for v in some] + [("hot", None), ("empty", None)]
    rng.shuffle(data)
    df = rows("g string, v double", data).repartition(6)
    found = metrics.approximate_quantiles(df, "v", WANTED, ["g"], error)
    errors = {r.g: r for r in metrics.rank_errors(df, "v", found, WANTED, ["g"]).collect()}
    for row in found.collect():
        if row.g == "empty":
            assert row.n == 0 and row.mid is None
            continue
        values = groups[row.g]
        assert row.n == len(values)
        for name, p in WANTED.items():
            assert row[name] in values and off(values, row[name], p) <= error
            assert errors[row.g][name] == pytest.approx(off(values, row[name], p), abs=1e-12)


def test_overall_and_empty(rows):
    df = rows("v double", [(float(i),) for i in range(1000)])
    found = metrics.approximate_quantiles(df, "v", WANTED)
    assert max(metrics.rank_errors(df, "v", found, WANTED).first()) <= 0.001
    assert metrics.approximate_quantiles(df.limit(0), "v", WANTED).first().n == 0


def test_a_wrong_value_is_seen(rows):
    df = rows("v double", [(float(i),) for i in range(100)])
    wrong = rows("low double, mid double, high double", [(5.0, 80.0, 99.0)])
    assert metrics.rank_errors(df, "v", wrong, WANTED).first().mid == pytest.approx(0.3)
