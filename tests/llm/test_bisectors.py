from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from fieldmosaic.llm import bisectors as B

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, vector int, place int"


@pytest.fixture
def vectors(rows):
    def make(pairs):
        return rows(SCHEMA, [(i, None if v is None else [None if x is None else float(x) for x in v], None, "c", "d", 1, None) for i, v in pairs])

    return make


def plain(pairs, clusters, rounds, seed, dimensions, scale=1024):
    """Every distance to every centroid, in whole numbers of any size."""
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in pairs
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    draw = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in draw[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine)]
    ended = [(i, *nearest(v)) for i, v in kept]
    whole = sum(d for _, d, _ in ended)
    part = {n: sum(d for _, d, a in ended if a == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, a, d, part[a], whole, digest[a]) for i, d, a in ended), key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in B.cluster_vectors(df, **how).collect()), key=repr)


def test_equals_all_distances(vectors):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    pairs = [(i, (centres[rng.integers(5)] + 0.3 * rng.normal(size=6)).tolist()) for i in range(400)]
    pairs += [(1000 + i, pairs[0][1]) for i in range(150)]  # a third of the table is one vector
    df = vectors(pairs).repartition(7)
    for clusters, rounds in ((8, 10), (3, 1), (1, 2), (5, 0)):
        assert found(df, clusters=clusters, rounds=rounds, dimensions=6) == plain(pairs, clusters, rounds, 3, 6)


def test_ties_take_the_smaller_number():
    field = B.Bisectors(np.array([[0, 0], [4, 0], [0, 0], [0, 4], [4, 4]]))
    points = np.array([[2, 0], [2, 2], [0, 2], [4, 2], [0, 0], [3, 3]])
    assert field.nearest(points).tolist() == [0, 0, 0, 1, 0, 4]
    assert field.distances(points, field.nearest(points)).tolist() == [4, 8, 4, 4, 0, 2]


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    for size in (1 << 21, 1 << 27):
        centroids = rng.integers(-size, size, (6, 64))
        points = np.concatenate([rng.integers(-size, size, (50, 64)), centroids, np.full((1, 64), size), np.full((1, 64), -size)])
        field = B.Bisectors(centroids)
        far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)) for c in centroids] for p in points]
        winner = field.nearest(points)
        assert winner.tolist() == [f.index(min(f)) for f in far]
        assert field.distances(points, winner).tolist() == [min(f) for f in far]
    assert B._exact_sum(np.array([(1 << 62), (1 << 62), -3, 1 << 62])) == 3 * (1 << 62) - 3


def test_odd_rows_are_left_out(vectors):
    nan, inf = float("nan"), float("inf")
    pairs = [
        (1, [0.5, -0.25]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 0.0]),
        (9, [None, 1.0]), (None, [0.1, -0.0001]), (1, [0.5, -0.25]), (10, [3.0, 3.0]), (None, [2.0, 2.5]),
    ]
    for clusters in (2, 4, 8):
        assert found(vectors(pairs), clusters=clusters, dimensions=2) == plain(pairs, clusters, 10, 3, 2)


def test_empty_tables(vectors):
    assert found(vectors([])) == []
    assert found(vectors([(1, None), (2, [])])) == []


def test_other_number_types(rows):
    pairs = [(i, [i % 5, -i]) for i in range(20)]
    for kind in ("array<int>", "array<double>", "array<decimal(10,2)>"):
        from decimal import Decimal

        data = [(i, [Decimal(x) if "decimal" in kind else float(x) if "double" in kind else x for x in v]) for i, v in pairs]
        df = rows(f"vec_id int, embedding {kind}", data)
        assert found(df, clusters=3, dimensions=2) == plain(pairs, 3, 10, 3, 2)


def test_beyond_the_largest_component():
    with pytest.raises(ValueError, match="beyond"):
        B.whole_vectors(pa.array([[1e9, 0.0]]), 2, 1024)
