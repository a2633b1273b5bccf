import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tools.check import compare, connect
from wearline.llm import centroids, queries


def test_query_equals_sql(spark, sf_dir):
    name = "op11_centroid_clusters"
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.CHECKS[name]) == ""


@pytest.mark.parametrize("dim", [1, 2, 8, 64])
def test_transform_scales_squared_distances(dim):
    rng = np.random.default_rng(dim)
    x = rng.integers(-1000, 1000, (50, dim))
    order = centroids.coarse_first(dim)
    w = centroids.transform(x, order)
    assert ((w[:, :-1] - w[:, 1:]) ** 2).sum(axis=0).tolist() == (dim * ((x[:-1] - x[1:]) ** 2).sum(axis=1)).tolist()
    signs = centroids.transform(np.eye(dim, dtype=np.int64), order)
    assert (np.diff(signs, axis=1) != 0).sum(axis=1).tolist() == list(range(dim))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.sampled_from([1, 3, 200, 1 << 40]), st.integers(0, 99), st.sampled_from([4, 16, 64]))
def test_search_equals_comparing_all(n, k, spread, seed, dim):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (n, dim)).astype(object if spread > 1 << 20 else np.int64)
    c = x[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, dim))
    order = centroids.coarse_first(dim)
    number, total = centroids.nearest(centroids.transform(x, order), centroids.transform(c, order))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert number.tolist() == [row.index(min(row)) for row in d.tolist()]
    assert [int(t) // dim for t in total] == [min(row) for row in d.tolist()]


def plain(rows, dim, k, rounds, seed="3"):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by lists of Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted(kept, key=key)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        mine = [[] for _ in middle]
        for _, v in kept:
            mine[near(v)[1]].append(v)
        middle = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, middle)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in got if j == c) for c in range(len(middle))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for i, d, j in got), key=str)


@pytest.mark.parametrize("scale", [1.0, 0.002, 3e4])
def test_ties_repeats_and_bad_vectors(spark, scale, monkeypatch):
    monkeypatch.setattr(centroids, "PAIRS_AT_ONCE", 40)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies of one vector
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[11][1]), (7, [-0.0] * 8)]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [None] + [1.0] * 7), (304, [float("nan")] * 8), (305, [math.inf] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    df = df.withColumns({"cluster": F.lit("x"), "ids": F.lit(1), "x": F.lit(2)})
    got = centroids.assign(centroids.fit(df, dim=8, k=8, rounds=4)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 8, 8, 4)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.assign(centroids.fit(df, dim=2, k=8)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 2, 8, 10)
    assert centroids.assign(centroids.fit(df.limit(0), dim=2)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        centroids.fit(df, dim=3)


def test_components_beyond_exact_distances_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no exact integer distances"):
        centroids.fit(df, dim=2)
