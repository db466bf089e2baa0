"""Centroid clustering in exact integers, with distances screened in float32.

Vectors become integers (floor(256 * x) of each component) and Lloyd's rounds run on them. A batch of vectors meets all
centroids in one float32 matrix product. What it may be wrong by is bounded (`screened`), so every distance lies in an
interval; a centroid whose interval starts beyond the least upper end cannot be the nearest. Where one centroid is left it
is the nearest, and where several are, their distances are computed in 64-bit integers and the smallest number wins ties.
So the assignment is that of exact arithmetic, whatever order the product sums in.

Each task sums its vectors by centroid; Spark adds those sums, and only the centroids (NUMBER x WIDTH numbers) are on the
driver. Vectors stay where they are: no round shuffles or stores them, and a lost task reads its part again.

Defined cases: vectors that are null, have another length than WIDTH, or a component that is null, not finite or not
below LARGEST after scaling (a squared distance of such might not fit a long) are left out; repeated ids and vectors each count; a
null vec_id is kept and comes last in the order of starts, equal hashes are ordered by components; with fewer kept vectors
than NUMBER there are fewer centroids; an empty table gives an empty result; columns other than vec_id and embedding are
not read; an inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, NUMBER, ROUNDS = 64, 40, 5
#: What a component is multiplied by before it is floored, and what it must stay below then, so that a squared distance fits a long.
SCALE, LARGEST = 256, 1 << 27
#: Vectors that a task works on at a time.
ROWS = 8192

UNIT32, UNIT64 = 2.0**-24, 2.0**-53


# --- exact assignment by screening --------------------------------------------------------------------------------


def screened(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for integer vectors (n x width) and centroids (k x width).

    The product is taken in float32. Rounding a component to float32 adds a relative error of u = 2^-24, and a sum of
    width products in any order, fused or not, one of g = width * u / (1 - width * u) of the sum of absolute products,
    which is at most |x| |c|. Both together are under (width + 4) u / (1 - (width + 4) u) * |x| |c|. |c|^2 and the last
    subtraction are float64; their errors, and those of the bound itself, are covered by a factor of 1 + 2^-40 and
    2^-50 of the magnitudes.
    """
    width = vectors.shape[1]
    product = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids.astype(np.int64) ** 2).sum(axis=1).astype(np.float64)
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)[None, :] * (1 + 2.0**-40)
    relative = (width + 4) * UNIT32 / (1 - (width + 4) * UNIT32)
    middle = squares[None, :] - 2 * product
    wrong = (2 * relative * norms + 2.0**-50 * (squares[None, :] + 2 * norms)) * (1 + 2.0**-40)
    return middle - wrong, middle + wrong


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, squared distance to it, and how many vectors were left to exact integers."""
    low, high = screened(vectors, centroids)
    possible = low <= high.min(axis=1)[:, None]
    nearest = possible.argmax(axis=1)
    open_rows = np.flatnonzero(possible.sum(axis=1) > 1)
    if len(open_rows):
        rows, numbers = np.nonzero(possible[open_rows])  # by row, numbers ascending within it
        exact = ((vectors[open_rows[rows]] - centroids[numbers]) ** 2).sum(axis=1)
        order = np.lexsort((numbers, exact, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        nearest[open_rows] = numbers[first]
    return nearest, ((vectors - centroids[nearest]) ** 2).sum(axis=1), len(open_rows)


# --- over tables --------------------------------------------------------------------------------------------------


def kept(table: DataFrame) -> DataFrame:
    """(vec_id, vector): integer vectors of the usable rows, as arrays of long, by functions of the JVM alone."""
    usable = (F.size("embedding") == WIDTH) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < LARGEST))  # false for NaN
    return table.select("vec_id", "embedding").filter(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vector"))


def starts(vectors: DataFrame) -> np.ndarray:
    """The vectors of the NUMBER smallest hashes of `2:<vec_id>`."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "vector").limit(NUMBER).select("vector").collect()
    return np.array([r["vector"] for r in first], np.int64).reshape(-1, WIDTH)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int | None, list[int]]]:
    """For each centroid with vectors: their number, the sum of their squared distances, the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, distance, total = np.zeros(len(centroids), np.int64), [0] * len(centroids), np.zeros((len(centroids), WIDTH), np.int64)
        for batch in _pieces(batches):
            own = _matrix(batch.column("vector"))
            nearest, away, _ = assign(own, centroids)
            number += np.bincount(nearest, minlength=len(centroids))
            np.add.at(total, nearest, own)
            for c in np.unique(nearest):
                distance[c] += sum(away[nearest == c].tolist())
        own = np.flatnonzero(number)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own.astype(np.int32)), "n": number[own], "distance": pa.array([str(distance[c]) for c in own], pa.string()), "total": pa.array(total[own].tolist(), pa.list_(pa.int64()))})

    parts = vectors.select("vector").mapInArrow(run, "cluster int, n long, distance string, total array<long>")
    wide = "decimal(38,0)"
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("distance").cast(wide)).alias("distance"), F.array(*(F.sum(F.get("total", F.lit(i)).cast(wide)) for i in range(WIDTH))).alias("total"))
    return {r["cluster"]: (r["n"], int(r["distance"]), [int(v) for v in r["total"]]) for r in added.collect()}


def fit(vectors: DataFrame) -> np.ndarray:
    """The centroids after ROUNDS rounds; an empty one stays where it was."""
    centroids = starts(vectors)
    for _ in range(ROUNDS if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, _, total) in sums(vectors, centroids).items():
            centroids[c] = [t // n for t in total]
    return centroids


def cluster(table: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    vectors = kept(table)
    centroids = fit(vectors)
    found = sums(vectors, centroids) if len(centroids) else {}
    fits = lambda n: n if n < 1 << 63 else None
    inertia = [fits(found[c][1]) if c in found else 0 for c in range(len(centroids))]
    whole = fits(sum(x[1] for x in found.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = pa.array(inertia, pa.int64()), pa.array(digests, pa.string())
        for batch in _pieces(batches):
            if not batch.num_rows:
                continue
            nearest, away, _ = assign(_matrix(batch.column("vector")), centroids)
            at = pa.array(nearest.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), at, pa.array(away), own.take(at), pa.array([whole] * batch.num_rows, pa.int64()), names.take(at)], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
