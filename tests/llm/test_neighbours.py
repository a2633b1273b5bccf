import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tools.check import compare, connect
from wearline.llm import neighbours, queries


def test_query_equals_sql(spark, sf_dir):
    got = queries.QUERIES["op9_nearest_vectors"](spark, sf_dir)
    close = got.withColumn("score", F.round("score", 9)).withColumn("rank", F.col("rank").cast("long"))
    check = queries.CHECKS["op9_nearest_vectors"].replace("k::int rank, vec_id, score from r", "k rank, vec_id, round(score, 9) score from r")
    assert compare(close, connect(sf_dir), check) == ""


def dot(a, b):
    total = 0.0  # `sum` would compensate rounding errors
    for x, y in zip(a, b):
        total += x * y
    return total


def plain(rows, k):
    good = [
        (i, v)
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for q, a in good:
        if q % 20:
            continue
        scored = sorted((-dot(a, b), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 300.0])
def test_small_blocks_ties_and_bad_vectors(spark, scale, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # copies of one vector
    rows += [(300, [1e9] + [0.0] * 5), (320, [scale] * 3), (321, [scale, 0.0, 1.0])]
    rows += [(340, None), (341, []), (342, [0.0] * 6), (343, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(360, [float("nan")] * 6), (361, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(4)
    got = sorted(map(tuple, neighbours.search(df.where("vec_id % 20 = 0"), df, k=5).collect()))
    want = plain(rows, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]
    assert neighbours.search(df.limit(0), df).count() == neighbours.search(df, df.limit(0)).count() == 0


def test_bounds_that_are_not_finite(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([150, 153, 0])).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, neighbours.search(df.where("vec_id % 20 = 0"), df, k=5).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in plain(rows, 5)]


def test_repeated_query_rows_have_their_neighbours_once_each(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 4)
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, neighbours.search(df.where("vec_id % 5 = 0"), df, k=3).collect()))
    assert len(got) == 36 and len({g[:2] for g in got}) == 36
