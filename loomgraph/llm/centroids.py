"""Centroid clustering with exact integer distances: blocks of vectors against all centroids by one matrix product."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut
from loomgraph.llm.vectors import EXACT, LONG, as_longs, largest, numbered, scaled, whole

#: Vectors of a block, the unit of the matrix products. Levels of the tree in which blocks' sums are added up.
ROWS, DEPTH = 4096, 3


def blocks_of(df: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(ids, values, n): blocks of at most ROWS vectors of that many components; values are floor(scale * x), whole doubles."""
    kept = numbered(df, id_col, vector_col, F.coalesce(F.size(vector_col) == dims, F.lit(False)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = scaled(part.column(1).flatten().to_numpy(zero_copy_only=False), scale)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([values.tobytes()], pa.binary()), pa.array([part.num_rows])], ["ids", "values", "n"])

    return kept.select("vec_id", "x").mapInArrow(task, "ids array<long>, values binary, n long")


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of x, whole doubles; ties to the smaller number.

    |x|^2 - 2 x.c + |c|^2 in doubles, by one matrix product, if no sum in it can reach 2^53: then all are exact in any
    order of adding. Otherwise the same in Python's integers.
    """
    wide = max((abs(v) for c in centroids for v in c), default=0)
    if x.shape[1] * (int(largest(x)) + wide) ** 2 < EXACT:
        c = np.array(centroids, np.float64)
        d = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
    else:
        x, c = whole(x), np.array(centroids, object)
        d = (x * x).sum(1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(1)[None, :]
    cluster = d.argmin(1)
    return cluster, d[np.arange(len(x)), cluster]


def added(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the components of each cluster's rows, as Python's integers; how many rows)."""
    if largest(x) * len(x) < EXACT:
        order = np.argsort(cluster, kind="stable")
        own, first = np.unique(cluster[order], return_index=True)
        sums = np.zeros((k, x.shape[1]), object)
        if len(own):
            sums[own] = whole(np.add.reduceat(x[order], first, axis=0))
    else:
        sums = np.zeros((k, x.shape[1]), object)
        np.add.at(sums, cluster, whole(x))
    return sums, np.bincount(cluster, minlength=k)


def first_centroids(df: DataFrame, dims: int, scale: int, k: int, id_col: str, vector_col: str) -> list[list[int]]:
    """The k vectors with the smallest hash of 2:vec_id, in that order; null vec_ids last, rows alike by their components."""
    kept = numbered(df, id_col, vector_col, F.coalesce(F.size(vector_col) == dims, F.lit(False)))
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select("x", key.alias("key")).orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return [[int(v) for v in scaled(np.array(r["x"]), scale)] for r in rows]


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Those are the vectors with exactly `dims` components, none of them null or not finite; a component x counts as
    floor(scale * x). The vectors are written once as blocks. Each round sends the k centroids to the blocks and adds up,
    in a tree over the tasks, each cluster's sums and counts, k x dims integers whatever the number of vectors; a centroid
    becomes the exact floor of the mean, an empty one stays. So one cluster may hold nearly all vectors.

    Distances are exact integers; distances and inertias that a long can't hold come as the largest long. Ties go to the
    smaller cluster. Rows with a null vec_id take part, the last to be a first centroid; repeated rows are vectors of their
    own. Fewer than k vectors are as many centroids. Other columns are ignored; an empty table gives an empty result.
    """
    centroids = first_centroids(df, dims, scale, k, id_col, vector_col)
    kind = "vec_id long, cluster int, distance long"
    if not centroids:
        none = df.sparkSession.createDataFrame([], kind + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return none
    blocks = cut(blocks_of(df, dims, scale, id_col, vector_col))

    def unpacked(values: bytes) -> np.ndarray:
        return np.frombuffer(values, np.float64).reshape(-1, dims)

    for _ in range(rounds):
        now, n = centroids, len(centroids)

        def add(so_far: tuple, row, now=now, n=n) -> tuple:
            x = unpacked(row["values"])
            sums, counts = added(x, nearest(x, now)[0], n)
            return so_far[0] + sums, so_far[1] + counts

        zero = np.zeros((n, dims), object), np.zeros(n, np.int64)
        sums, counts = blocks.select("values").rdd.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), DEPTH)
        centroids = [[int(v) // int(m) for v in s] if m else c for s, m, c in zip(sums, counts, centroids, strict=True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values in zip(batch.column(0), batch.column(1), strict=True):
                cluster, distance = nearest(unpacked(values.as_py()), centroids)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(as_longs(distance))], ["vec_id", "cluster", "distance"])

    told = cut(blocks.select("ids", "values").mapInArrow(task, kind))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["total"]) for r in told.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows at most
    clipped = lambda v: F.lit(min(LONG, v)).cast("long")
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own: Column = F.element_at(F.array(*[clipped(sums.get(i, 0)) for i in range(len(centroids))]), F.col("cluster") + 1)
    sha = F.element_at(F.array(*map(F.lit, shas)), F.col("cluster") + 1)
    return told.withColumns({"cluster_inertia": own, "inertia": clipped(sum(sums.values())), "centroid_sha256": sha})
