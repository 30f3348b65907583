"""Exact integer k-means by a tournament of bisectors.

Vectors and centroids have integer components. For centroids a and b, a before b, the
hyperplane between them is precomputed as an integer normal ``2 (a - b)`` and threshold
``|a|^2 - |b|^2``: a vector is no nearer to b than to a where ``normal . x - threshold``
is not negative. Zero is a tie, which the smaller number wins. A vector's nearest of k
centroids is the winner of k - 1 such sign tests, one against each centroid in order of
number; only the winner's distance is computed.

A round is one pass over the input. Every task keeps counts and component sums of its own
vectors, k rows in all, and Spark adds them; the driver sees k x dimensions totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import arrow_map, batch, table
from .registry import query

CLUSTERS = 8
ROUNDS = 10
SEED = 3
DIMENSIONS = 64
SCALE = 1024
#: Largest size of a component: all sums of a sign test then stay below 2^63.
LARGEST = 1 << 27
#: Up to this size the sums stay below 2^53, where doubles are exact in any order of adding.
_EXACT_DOUBLE = 1 << 22
_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Bisectors:
    """Normals and thresholds of all pairs of some centroids, the smaller number first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        squares = (self.centroids**2).sum(axis=1)
        self.normals = 2 * (self.centroids[:, None, :] - self.centroids[None, :, :])
        self.thresholds = squares[:, None] - squares[None, :]
        self.largest = int(np.abs(self.centroids).max(initial=0))

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row; the smaller number where two are as near."""
        kind = np.float64 if max(self.largest, int(np.abs(vectors).max(initial=0))) <= _EXACT_DOUBLE else np.int64
        points, normals = vectors.astype(kind), self.normals.astype(kind)
        winner = np.zeros(len(vectors), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", points, normals[winner, rival]).astype(np.int64)
            winner[side < self.thresholds[winner, rival]] = rival
        return winner

    def distances(self, vectors: np.ndarray, winner: np.ndarray) -> np.ndarray:
        return ((vectors - self.centroids[winner]) ** 2).sum(axis=1)


def whole_vectors(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with exactly ``dimensions`` finite components, and these as ``floor(scale * x)``."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimensions)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    finite = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[finite] * scale)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}: squared distances would not fit 64 bits")
    return rows[finite], scaled.astype(np.int64)


def _read(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    kind = vectors.schema[vector_column].dataType
    column = F.col(vector_column)
    if kind.elementType.typeName() not in ("float", "double"):
        column = column.cast("array<double>")
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), column.alias("vector"))


def seeds(rows: DataFrame, clusters: int, seed: int, dimensions: int, scale: int) -> np.ndarray:
    """Vectors of the smallest sha256 of ``seed:id``: equal ids by components, ids that are null last."""
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    first = (
        rows.where((F.size("vector") == dimensions) & fit)
        .withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
        .orderBy(F.col("draw").asc_nulls_last(), "vector").limit(clusters).collect()
    )
    chosen = pa.array([r["vector"] for r in first], type=pa.list_(pa.float64()))
    return whole_vectors(chosen, dimensions, scale)[1]


def _totals(rows: DataFrame, field: Bisectors, dimensions: int, scale: int) -> dict[int, tuple[int, int, dict[int, int]]]:
    """Per centroid that has vectors: how many, the sum of their distances, and the sum of each component."""
    clusters = len(field.centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(clusters, dtype=np.int64)
        far = np.zeros(clusters, dtype=object)
        sums = np.zeros((clusters, dimensions), dtype=object)
        for some in batches:
            vectors = whole_vectors(some.column(1), dimensions, scale)[1]
            winner = field.nearest(vectors)
            distance = field.distances(vectors, winner)
            for number in np.unique(winner).tolist():
                mine = winner == number
                count[number] += int(mine.sum())
                # a batch's sums fit 64 bits unless its components are huge: then they are added in two halves
                far[number] += _exact_sum(distance[mine])
                sums[number] += _exact_sum(vectors[mine])
        used = np.flatnonzero(count)
        if len(used):
            number = np.repeat(used, dimensions)
            place = np.tile(np.arange(dimensions), len(used))
            total = pa.array([str(int(x)) for x in sums[used].reshape(-1)])
            yield batch({
                "cluster": number.astype(np.int32), "place": place.astype(np.int32), "total": total,
                "members": np.where(place == 0, count[number], 0), "far": [str(int(far[n])) if p == 0 else "0" for n, p in zip(number, place)],
            })

    partial = arrow_map(rows, work, "cluster int, place int, total string, members long, far string")
    wide = "decimal(38,0)"
    added = partial.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast(wide)).alias("total"), F.sum("members").alias("members"), F.sum(F.col("far").cast(wide)).alias("far")
    )
    found: dict[int, tuple[int, int, dict[int, int]]] = {}
    for row in added.collect():  # clusters x dimensions rows
        members, far, sums = found.get(row["cluster"], (0, 0, {}))
        sums[row["place"]] = int(row["total"])
        found[row["cluster"]] = (members + row["members"], far + int(row["far"]), sums)
    return found


def _exact_sum(values: np.ndarray) -> np.ndarray | int:
    """Sum over rows as whole numbers of any size: high and low halves are added apart."""
    high, low = values >> 31, values & ((1 << 31) - 1)
    return high.sum(axis=0).astype(object) * (1 << 31) + low.sum(axis=0).astype(object) if values.ndim > 1 else (int(high.sum()) << 31) + int(low.sum())


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    A vector is kept if it has exactly ``dimensions`` components, none null, NaN or infinite; null,
    empty, shorter and longer ones give no row. Ids may be null or repeated: every kept row is a vector
    of its own, and a null id seeds a centroid only after all others. With fewer kept vectors than
    ``clusters`` each is a centroid; without any, or with an empty table, there are no rows. Centroids
    without vectors stay where they are. Further columns are not read. A finite component beyond
    2^27 / ``scale`` raises, as its squared distances would not fit.
    """
    rows = _read(vectors, id_column, vector_column)
    field = Bisectors(seeds(rows, clusters, seed, dimensions, scale).reshape(-1, dimensions))
    if not len(field.centroids):
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    for _ in range(rounds):
        centroids = field.centroids.copy()
        for number, (members, _, sums) in _totals(rows, field, dimensions, scale).items():
            centroids[number] = [sums[i] // members for i in range(dimensions)]
        if (centroids == field.centroids).all():
            break  # further rounds would give the same again
        field = Bisectors(centroids)
    ended = _totals(rows, field, dimensions, scale)
    far = [ended[c][1] if c in ended else 0 for c in range(len(field.centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in field.centroids.tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            kept, vectors = whole_vectors(some.column(1), dimensions, scale)
            winner = field.nearest(vectors)
            yield batch({
                "vec_id": some.column(0).take(pa.array(kept)), "cluster": winner.astype(np.int32), "distance": field.distances(vectors, winner),
                "cluster_inertia": np.array(far, dtype=np.int64)[winner], "inertia": np.full(len(kept), sum(far), dtype=np.int64),
                "centroid_sha256": pa.array(digests).take(pa.array(winner)),
            })

    return arrow_map(rows, work, _SCHEMA)


def _oracle() -> str:
    """Rounds written out one after another; every difference is squared and added as a whole number."""
    square = "list_sum(list_transform(list_zip(k.v, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    nearest = f"SELECT k.row_no, min(struct_pack(d := {square}, c := c.c)) AS hit FROM kept k, {{0}} c GROUP BY k.row_no"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS w FROM kept QUALIFY c < {CLUSTERS})""",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(f'c{i}')})")
        parts.append(
            f"""m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS w FROM (
    SELECT a.hit.c AS c, place, sum(v[place]) AS s, count(*) AS n FROM a{i} a JOIN kept USING (row_no), range(1, {DIMENSIONS + 1}) r(place) GROUP BY 1, 2) GROUP BY c)"""
        )
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN m{i} m USING (c))")
    parts.append(f"ended AS MATERIALIZED ({nearest.format(f'c{ROUNDS}')})")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, hit.c::INT AS cluster, hit.d AS distance, sum(hit.d) OVER (PARTITION BY hit.c)::BIGINT AS cluster_inertia,
       sum(hit.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM ended JOIN kept USING (row_no) JOIN c{ROUNDS} f ON f.c = hit.c"""
    )


@query("op11_bisector_clusters", _oracle())
def op11_bisector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Ten rounds over all vectors of ``embeddings``; no rows for an empty table, see ``cluster_vectors``."""
    return cluster_vectors(table(spark, folder, "embeddings"))
