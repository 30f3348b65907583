"""Seeded samples rank only the lowest ranges of the hash."""

from __future__ import annotations

import hashlib

from fieldmosaic.operators import splits


def lowest(keys, n, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))[:n]


def test_groups_of_any_size_and_copies(spark):
    """Group 1 has 200 copies of each row in its low ranges, group 0 few rows, group NULL many."""
    groups = {0: range(3), 1: range(300), None: range(1000, 6000)}
    rows = [(g, k) for g, some in groups.items() for k in some for _ in range(200 if g == 1 else 1)]
    df = spark.createDataFrame(rows, "g int, k long")
    got = splits.seeded_sample(df, ["g"], ["k"], 20, unique=True).collect()
    for g, some in groups.items():
        assert sorted(r.k for r in got if r.g == g) == sorted(lowest(some, 20))
    unique = splits.seeded_sample(df.distinct(), ["g"], ["k"], 20).collect()
    assert sorted(map(str, unique)) == sorted(map(str, got))


def test_only_the_lowest_ranges_are_ranked(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS g", "id AS k")
    kept = splits.seeded_sample(df, ["g"], ["k"], 10, unique=True)
    stored = spark.read.parquet(*[f for f in kept.inputFiles() if "/sample-" in f])
    assert 20 <= stored.count() < 400
    assert sorted(r.k for r in kept.where("g = 0").collect()) == sorted(lowest(range(0, 200_000, 2), 10))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, k long")
    assert splits.seeded_sample(df, ["g"], ["k"], 10, unique=True).isEmpty() and splits.seeded_sample(df, ["g"], ["k"], 10).isEmpty()
