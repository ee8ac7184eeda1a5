"""Exact k-means over integer vectors; every vector finds its centroid by Orchard's search.

Each centroid holds the list of the others, nearest first. The search for a vector stands at a current centroid and walks its
list: a centroid not met before is marked visited and measured; if it is closer (or equally close with a smaller number) the
search jumps to it and starts on its list. It stops at the first entry whose distance from the current centroid is strictly
beyond twice the vector's distance: by the triangle inequality that one and all after it are farther from the vector.
A search may start anywhere; here it starts at the centroid nearest by the few components that tell the centroids best apart.

All arithmetic is exact: squared distances in doubles while they stay below 2^53, in 64-bit integers below 2^62, in Python's
integers beyond. A round sends one sum per task and centroid; only the k sums come to the driver.

Defined results: a vector that is null, of another length, or with a null or non-finite component is left out. Each
row counts, also a repeated one. Rows with equal (or null) ids are told apart by their components when centroids are drawn, and
equal rows may both be drawn; the later centroid then stays empty and as it is. With fewer kept vectors than k
there are as many centroids. Components are clipped to 64 bits, distances and inertia to 2^63 - 1. Other columns are ignored,
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.session import saved

DIMENSIONS, CENTROIDS, ROUNDS = 64, 40, 5
SCALE = 256
SALT = "2:"
#: Components that choose a search's first centroid.
_HINT = 6
#: Vectors that search in lock-step.
_TOGETHER = 8192
_MOST = (1 << 63) - 1


def kept_vectors(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of `dimensions` finite components, each component x as floor(scale * x)."""
    e = F.col("embedding")

    def unfit(x: Column) -> Column:
        d = x.cast("double")
        return d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(y >= 2.0**63, _MOST).when(y <= -(2.0**63), -_MOST).otherwise(F.floor(y)).cast("bigint")

    fit = (F.size(e) == dimensions) & ~F.exists(e, unfit)
    return table.select("vec_id", "embedding").where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform(e, whole).alias("v"))


def drawn(kept: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> list[list[int]]:
    """The k vectors with the smallest digests of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.select(digest.alias("_digest"), "v").orderBy("_digest", "v").limit(k).collect()]


def _squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=1)


class Orchard:
    """Centroids with their neighbour lists, ready to search for batches of vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.largest = max((abs(x) for c in centroids for x in c), default=0)
        self._ready: dict[type, tuple] = {}
        spread = np.array(centroids, dtype=float)
        self.hint = np.argsort(-spread.var(axis=0), kind="stable")[:_HINT]
        self.hint_centroids = spread[:, self.hint]

    def _lists(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroids, neighbours of each nearest first, their squared distances) in one arithmetic."""
        if kind not in self._ready:
            c = np.array(self.centroids, dtype=object).astype(kind)
            gaps = np.array([_squared(c - c[i]) for i in range(len(c))], dtype=kind)
            near = np.array([sorted((j for j in range(len(c)) if j != i), key=lambda j: (gaps[i, j], j)) for i in range(len(c))], dtype=np.int64).reshape(len(c), -1)
            self._ready[kind] = (c, near, np.take_along_axis(gaps, near, axis=1))
        return self._ready[kind]

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row of an integer array, and how many distances were measured."""
        most = max(self.largest, int(np.abs(vectors.astype(float)).max(initial=0)))
        width = max(1, vectors.shape[1])
        kind = float if width * (2 * most) ** 2 < 1 << 52 else np.int64 if width * (2 * most) ** 2 < 1 << 60 else object
        centroids, near, gaps = self._lists(kind)
        points = vectors.astype(kind)
        n, others = len(points), near.shape[1]
        hint = vectors[:, self.hint].astype(float)
        current = np.argmin((hint * hint).sum(axis=1)[:, None] - 2 * hint @ self.hint_centroids.T + (self.hint_centroids**2).sum(axis=1)[None, :], axis=1)
        best = _squared(points - centroids[current])
        visited = np.zeros((n, others + 1), bool)
        visited[np.arange(n), current] = True
        at = np.zeros(n, np.int64)
        walking, measured = np.arange(n), n
        while others and walking.size:
            walking = walking[at[walking] < others]
            here = current[walking]
            walking = walking[(gaps[here, at[walking]] <= 4 * best[walking]).astype(bool)]
            candidate = near[current[walking], at[walking]]
            at[walking] += 1
            new = ~visited[walking, candidate]
            rows, candidate = walking[new], candidate[new]
            visited[rows, candidate] = True
            measured += len(rows)
            found = _squared(points[rows] - centroids[candidate])
            closer = ((found < best[rows]) | ((found == best[rows]) & (candidate < current[rows]))).astype(bool)
            rows = rows[closer]
            current[rows], best[rows], at[rows] = candidate[closer], found[closer], 0
        return current, best, measured


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1)
    for start in range(0, len(rows), _TOGETHER):
        yield start, rows[start : start + _TOGETHER]


def _sums(centroids: list[list[int]]):
    """Per task and centroid: how many vectors and the sum of their components, as decimal text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, sums, counts = Orchard(centroids), {}, {}
        for batch in batches:
            for _, rows in _vectors(batch):
                cluster, _, _ = orchard.search(rows)
                order = np.argsort(cluster, kind="stable")
                numbers, first = np.unique(cluster[order], return_index=True)
                narrow = np.abs(rows.astype(float)).max(initial=0) < 2.0**48
                added = np.add.reduceat((rows if narrow else rows.astype(object))[order], first, axis=0).astype(object)
                for c, total, size in zip(numbers.tolist(), added, np.diff([*first, len(order)]).tolist()):
                    sums[c] = total + sums.get(c, 0)
                    counts[c] = size + counts.get(c, 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()), pa.array([counts[c] for c in sums], pa.int64()),
            pa.array([[str(x) for x in sums[c]] for c in sums], pa.list_(pa.string())),
        ], names=["cluster", "n", "total"])

    return run


def _assign(centroids: list[list[int]], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        for batch in batches:
            for start, rows in _vectors(batch):
                cluster, distance, _ = orchard.search(rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").slice(start, len(rows)).cast(id_type), pa.array(cluster, pa.int32()),
                    pa.array([min(int(d), _MOST) for d in distance], pa.int64()),
                ], names=["vec_id", "cluster", "distance"])

    return run


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: each centroid goes to the floor of its vectors' mean; one without vectors stays."""
    parts = kept.mapInArrow(_sums(centroids), "cluster int, n bigint, total array<string>")
    width = len(centroids[0])
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of each kept vector.

    The vectors are written once as integers and read again in each round.
    """
    spark = table.sparkSession
    kept = saved(kept_vectors(table, dimensions, scale))
    id_type = kept.schema["vec_id"].dataType.simpleString()
    centroids = drawn(kept, k, salt)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    assigned = saved(kept.mapInArrow(_assign(centroids, to_arrow_type(kept.schema["vec_id"].dataType)), f"vec_id {id_type}, cluster int, distance bigint"))
    totals = {r["cluster"]: int(r["t"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()}
    inertia = min(sum(totals.values()), _MOST)
    facts = spark.createDataFrame(
        [(c, min(totals[c], _MOST), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest(), centroids[c]) for c in sorted(totals)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")  # k rows

