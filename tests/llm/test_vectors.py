import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm.centroids import added, cluster_vectors, nearest
from loomgraph.llm.topk import Block, found, top_products

KIND = "vec_id long, embedding array<float>, label int, row string, x int, asks string, block int, cluster string, score long"
MORE = (1, "r", 2, "a", 3, "c", 4)


def products(rows, k, scale=64):
    """Each query's best rows, by the definition; rows are (vec_id, vector)."""
    x = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, (qid, a) in enumerate(x):
        if qid is not None and qid % 20 == 0:
            scored = sorted((-sum(p * r for p, r in zip(a, b, strict=False)), i is None, i or 0) for j, (i, b) in enumerate(x) if j != q)
            out += [(qid, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_top_products_of_odd_rows(spark):
    rows = [(0, [0.5, -0.25, 0.0]), (1, [0.5, -0.25, 0.0]), (2, None), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (20, []), (40, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 3.0]), (None, [3.0, 3.0, 3.0]), (None, [3.0, 3.0, 3.0]), (7, [0.001, 0.0, 0.0, 9.0]), (8, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, *MORE) for i, v in rows], KIND)
    for k in (1, 4, 20):
        assert told(top_products(df, F.col("vec_id") % 20 == 0, k)) == products(rows, k)
    assert told(top_products(df.where("false"), F.col("vec_id") % 20 == 0)) == []
    assert told(top_products(df.where("vec_id = 7"), F.col("vec_id") % 20 == 0)) == []


def test_top_products_in_several_blocks(spark, monkeypatch):
    from loomgraph.llm import topk

    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 64]) for i in range(200)] + [(1000 + i, [0.015625] * 6) for i in range(100)]
    df = spark.createDataFrame([(i, v, *MORE) for i, v in rows], KIND)
    assert told(top_products(df, F.col("vec_id") % 20 == 0, 20)) == products(rows, 20)


@pytest.mark.parametrize("size", [1.0, 1e4, 1e9, 1e17])
def test_products_of_large_numbers_are_exact(size):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(30, 5)) * size)
    table = pa.table({"row": np.arange(30), "vec_id": np.arange(30), "x": pa.array([list(v) for v in x], pa.list_(pa.float64()))})
    got = found(Block(table, 1), Block(table, 1), 7)
    want = {q: sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[r], strict=True)), r) for r in range(30) if r != q)[:7] for q in range(30)}
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    if size < 1e17:
        assert list(zip(got["query"].to_pylist(), got["vec_id"].to_pylist(), got["score"].to_pylist(), strict=True)) == [(q, r, -s) for q in range(30) for s, r in want[q]]
    else:
        assert got["score"].to_pylist() == [limit(-s) for q in range(30) for s, _ in want[q]]


def lloyd(rows, k, rounds, scale=256):
    x = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        home = [near(v)[1] for _, v in x]
        for j in range(len(centroids)):
            if own := [v for (_, v), h in zip(x, home, strict=True) if h == j]:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = [(i, *near(v)) for i, v in x]
    sums = {j: sum(d for _, d, h in at if h == j) for j in range(len(centroids))}
    limit = lambda v: min(v, (1 << 63) - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, limit(d), limit(sums[j]), limit(sum(sums.values())), sha[j]) for i, d, j in at), key=str)


def clustered(df, **kinds):
    return sorted(map(tuple, cluster_vectors(df, **kinds).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("size", [1.0, 1e10])
def test_clusters_by_the_definition(spark, size):
    rng = np.random.default_rng(3)
    vector = lambda: [float(np.float32(v)) for v in rng.normal(size=64) * size]
    same = vector()
    rows = [(i, vector()) for i in range(40)] + [(100 + i, same) for i in range(30)] + [(None, vector()), (None, same), (5, same), (6, None), (7, [1.0] * 63), (8, [None] * 64), (9, [float("nan")] * 64), (10, [float("inf")] + [0.0] * 63), (11, [])]
    df = spark.createDataFrame([(i, v, *MORE) for i, v in rows], KIND)
    assert clustered(df, k=6, rounds=3) == lloyd(rows, 6, 3)
    assert clustered(df.where("false")) == []
    few = rows[:3]
    assert clustered(spark.createDataFrame([(i, v, *MORE) for i, v in few], KIND)) == lloyd(few, 40, 5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(10**9), 10**9), min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(st.integers(-(10**9), 10**9), min_size=3, max_size=3), min_size=1, max_size=5))
def test_products_and_integers_agree(x, centroids):
    cluster, d = nearest(np.array(x, np.float64), centroids)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in x]
    assert [(int(a), int(b)) for a, b in zip(d, cluster, strict=True)] == want
    sums, counts = added(np.array(x, np.float64), cluster, len(centroids))
    for j in range(len(centroids)):
        own = [v for v, (_, h) in zip(x, want, strict=True) if h == j]
        assert counts[j] == len(own) and [int(s) for s in sums[j]] == [sum(c) for c in zip(*own, strict=True)] if own else counts[j] == 0


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from loomgraph.llm.queries import ORACLE_SQL, QUERIES

    base = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{base}/embeddings.parquet'")
    for name in ("op12_top_products", "op13_centroids"):
        want = db.sql(ORACLE_SQL[name])
        got = QUERIES[name](spark, base).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
