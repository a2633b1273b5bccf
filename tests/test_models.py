import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import trees
from wearline.operators import models as md
from wearline.plans.catalog import QUERIES


def curve(rng, n):
    x = rng.normal(size=(n, 4))
    return x, 10 * np.sin(x[:, 0]) + 5 * (x[:, 1] > 0) * x[:, 2] + rng.normal(scale=0.3, size=n)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x, y = curve(rng, 3000)
    data = [(*map(float, a), float(b), i % 4 == 0) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "a double, b double, c double, d double, rul double, test boolean").repartition(5).cache()


def error(df, label="rul", pred="pred"):
    return df.agg(F.sqrt(F.avg((F.col(label) - F.col(pred)) ** 2))).first()[0]


def test_small_models_beat_the_constant_and_repeat(rows):
    train, test = rows.where("not test"), rows.where("test")
    spread = test.agg(F.stddev("rul")).first()[0]
    for fit, share in (
        (lambda t: md.fit_boosting(t, "abcd", rounds=80), 0.25),
        (lambda t: md.fit_forest(t, "abcd", size=16, depth=8), 0.5),
    ):
        free = fit(train)(test, 1e9)
        wide = free.withColumn("rul", F.greatest("rul", F.lit(0.0)))  # predictions are cut at zero
        assert error(wide) < share * spread
        again = fit(train.repartition(3))(test, 1e9)
        assert error(free.join(again.select("a", F.col("pred").alias("p")), "a"), "p") < 1e-9


def test_shards_train_on_all_rows_and_agree(rows):
    train, test = rows.where("not test"), rows.where("test")
    s = trees.Settings(rounds=80)
    one = trees.fit_boosting(train, "abcd", "rul", s)(test)
    many = trees.fit_boosting(train, "abcd", "rul", s, shard_rows=600)(test)
    sample = trees.fit_boosting(train, "abcd", "rul", s, shard_rows=300, most_shards=2)(test)
    spread = test.agg(F.stddev("rul")).first()[0]
    assert error(one) < 0.2 * spread and error(many) < 0.3 * spread and error(sample) < 0.5 * spread


def test_undefined_features_and_labels(spark, rows):
    odd = [(None, 1.0, 1.0, 1.0, 3.0, True), (1.0, float("nan"), 1.0, 1.0, 3.0, True), (1.0, 1.0, 1.0, 1.0, None, False)]
    more = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    got = trees.fit_boosting(more.where("not test"), "abcd", "rul", trees.Settings(rounds=5))(more.where("test"))
    assert got.where("pred is null").count() == 2 and got.count() == rows.where("test").count() + 2
    with pytest.raises(ValueError, match="no rows"):
        trees.fit_boosting(rows.limit(0), "abcd", "rul")


def plain_tree(codes, residual, depth, used):
    """Leaf value of every row by trying every split of every node."""
    s = trees.Settings()

    def value(rows):
        return residual[rows].sum() ** 2 / (len(rows) + s.penalty)

    def split(rows, level):
        best, cut = value(rows) + 1e-12, None
        if level < depth:
            for f in used:
                for b in range(trees.BINS):
                    low = rows[codes[rows, f] <= b]
                    if 0 < len(low) < len(rows):
                        gain = value(low) + value(rows[codes[rows, f] > b])
                        if gain > best + 1e-9:
                            best, cut = gain, (f, b)
        if cut is None:
            out[rows] = s.rate * residual[rows].sum() / (len(rows) + s.penalty)
            return
        side = codes[rows, cut[0]] <= cut[1]
        split(rows[side], level + 1)
        split(rows[~side], level + 1)

    out = np.zeros(len(codes))
    split(np.arange(len(codes)), 0)
    return out


def test_a_tree_equals_trying_every_split():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 4):
        codes = rng.integers(0, 20, (60, 3)).astype(np.uint8)
        residual = rng.normal(size=60)
        used = np.array([0, 2])
        s = trees.Settings(depth=depth)
        f, b, leaf = trees.grow(codes, residual, np.ones(60), used, s)
        got = trees.Trees(0.0, f[None], b[None], leaf[None]).predict(codes)
        assert np.allclose(got, plain_tree(codes, residual, depth, used))


def test_a_forest_tree_is_the_mean_of_its_bootstrap():
    rng = np.random.default_rng(4)
    codes, label = rng.integers(0, 30, (200, 3)).astype(np.uint8), rng.normal(size=200)
    one = trees.bag(codes, label, [7], trees.FOREST)
    weight = np.bincount(np.random.default_rng([42, 7]).integers(0, 200, 200), minlength=200)
    got = one.predict(codes)
    for value in np.unique(got):
        mine = (got == value) & (weight > 0)
        assert np.isclose(np.average(label[mine], weights=weight[mine]), value)
    assert len(np.unique(got)) > 60


def test_forests_of_many_shards(rows):
    train, test = rows.where("not test"), rows.where("test")
    s = replace(trees.FOREST, rounds=24, depth=9)
    spread = test.agg(F.stddev("rul")).first()[0]
    one = trees.fit_forest(train, "abcd", "rul", s)(test)
    many = trees.fit_forest(train, "abcd", "rul", s, shard_rows=500)(test)
    assert error(one) < 0.3 * spread and error(many) < 0.45 * spread


def test_trees_grow_in_few_bytes_a_row():
    rng = np.random.default_rng(6)
    n = 50_000
    codes, label = np.asfortranarray(rng.integers(0, trees.BINS, (n, 12)).astype(np.uint8)), rng.normal(size=n)
    for s in (trees.Settings(columns=1.0), trees.FOREST):
        tracemalloc.start()
        trees.grow(codes, label, np.ones(n), np.arange(12), s)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # beside the rows, a feature's histograms of all nodes of a level
        assert peak < 90 * n + 10 * min(n, 2 ** (s.depth - 1)) * trees.BINS * 8


def test_rows_that_come_many_times_meet_in_a_shard_as_one(spark, rows):
    hot = spark.range(50_000).selectExpr("1.0 a", "2.0 b", "3.0 c", "4.0 d", "5.0 rul", "false test")
    train = rows.where("not test").unionByName(hot)
    held, n = [], train.count()

    def grown(codes, label, *more):
        copies = more[0] if len(more) == 3 and more[0] is not None else np.ones(len(codes))
        return trees.Trees(float(len(codes)), copies.sum(keepdims=True), np.zeros(0), np.zeros(0))

    def weight(models):
        held.extend((int(base), int(total[0])) for base, total, _, _ in models)
        return 1.0

    trees._fit(train, "abcd", "rul", grown, 1, 1000, 64, weight)
    assert max(total for _, total in held) >= 50_000 and max(different for different, _ in held) <= 2000
    assert sum(total for _, total in held) == n
    test = rows.where("test")
    got = trees.fit_boosting(train, "abcd", "rul", trees.Settings(rounds=80), shard_rows=30_000)(test)
    assert error(got) < 0.5 * test.agg(F.stddev("rul")).first()[0]


def test_counted_copies_train_like_listed_ones():
    rng = np.random.default_rng(8)
    codes, label, copies = rng.integers(0, 30, (400, 3)).astype(np.uint8), rng.normal(size=400), rng.integers(1, 9, 400)
    label += codes[:, 0]
    listed = codes.repeat(copies, axis=0), label.repeat(copies)
    every = trees.Settings(rounds=30, depth=4, rows=1.0, columns=1.0)
    one = trees.boost(codes, label, every, copies).predict(codes)
    assert np.allclose(one, trees.boost(*listed, every).predict(codes))
    some = replace(every, rows=0.8)
    one = trees.boost(codes, label, some, copies).predict(codes)
    assert np.std(one - trees.boost(*listed, some).predict(codes)) < 0.1 * label.std()
    # the means of bootstrap samples have the mean and the spread of those of listed rows
    whole = replace(trees.FOREST, depth=0)
    means = trees.bag(codes, label, list(range(400)), whole, copies).leaf[:, 0]
    error = listed[1].std() / len(listed[1]) ** 0.5
    assert abs(means.mean() - listed[1].mean()) < 0.25 * error and 0.8 < means.std() / error < 1.2


def test_bin_edges_are_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(9)
    x = np.stack([rng.normal(size=3000), rng.integers(-3, 3, 3000), rng.lognormal(0, 50, 3000), np.full(3000, -0.0)], axis=1)
    x[:5, 0] = 1e300, -1e300, 5e-324, -5e-324, 0.0
    df = spark.createDataFrame([(0.0, *map(float, r)) for r in x], "c0 double, c1 double, c2 double, c3 double, c4 double")
    listed = trees.bin_edges(df, 3000)
    scanned = trees.bin_edges(df.repartition(7), 3000, most=0)
    for a, b, values in zip(listed, scanned, x.T, strict=True):
        assert np.array_equal(a, b) and np.allclose(a, np.unique(np.quantile(values, np.arange(1, 64) / 64)), rtol=1e-9)
    # more rows than Spark's percentile takes: no sample of them
    many = spark.range(120_001).selectExpr("0D c0", "cast(id as double) c1")
    assert np.array_equal(trees.bin_edges(many, 120_001)[0], np.arange(1, 64) * 1875.0)


def test_every_row_is_dealt_however_few_shards(rows):
    held = []

    def grown(codes, label, copies, *more):
        return trees.Trees(float(len(codes) if copies is None else copies.sum()), *[np.zeros(0)] * 3)

    def weight(models):
        held.extend(base for base, *_ in models)
        return 1.0

    trees._fit(rows, "abcd", "rul", grown, 1, 300, 2, weight)
    assert len(held) == 2 and sum(held) == 3000


def test_boosting_is_one_model_of_all_rows(rows, monkeypatch):
    monkeypatch.setattr(trees, "FORGET", 2)
    hot = rows.limit(1).crossJoin(rows.sparkSession.range(700)).drop("id")
    train, s = rows.unionByName(hot), trees.Settings(rounds=4, rows=1.0, columns=1.0)
    kinds = {"plain": {}, "blocks": {"shard_rows": 300, "most_shards": 2}, "jobs": {"shard_rows": 300, "most_shards": 2, "alone_rows": 0}}
    got = {k: trees.fit_boosting(train, "abcd", "rul", s, **more)(rows).select("pred").toPandas()["pred"].to_numpy() for k, more in kinds.items()}
    assert np.allclose(got["plain"], got["blocks"], atol=1e-6) and np.array_equal(got["blocks"], got["jobs"])
    some = replace(s, rows=0.8, columns=0.8)
    a = trees.fit_boosting(train, "abcd", "rul", some, shard_rows=300)(rows)
    b = trees.fit_boosting(train.repartition(3), "abcd", "rul", some, shard_rows=300, alone_rows=0)(rows)
    assert a.exceptAll(b).count() == 0


def test_model_scores_compute_shared_tables_once(spark, sf_dir, monkeypatch):
    from wearline.plans import q_metrics

    asked = []

    def once(s, d, made=q_metrics.b.trajectories):
        asked.append(d)
        return made(s, d)

    monkeypatch.setattr(q_metrics.b, "trajectories", once)
    got = q_metrics.model_predictions(spark, sf_dir, "one", lambda train, names: lambda df, cap: df.withColumn("pred", F.lit(1.0)))
    kept = [line for line in got._jdf.queryExecution().withCachedData().toString().splitlines() if "InMemoryRelation" in line]
    assert len(asked) == 1 and kept


def test_registered_models_have_the_reference_sizes(spark, sf_dir, monkeypatch):
    sizes = []

    def fit(train, features, label, s):
        sizes.append((s.rounds, s.depth, s.rate, s.rows, s.columns))
        return lambda df, out: df.withColumn(out, F.lit(1.0))

    monkeypatch.setattr(trees, "fit_boosting", fit)
    monkeypatch.setattr(trees, "fit_forest", fit)
    QUERIES["K1_forest"](spark, sf_dir)
    QUERIES["K2_boosting"](spark, sf_dir)
    assert sizes == [(200, 12, 1.0, 1.0, 1.0), (600, 6, 0.05, 0.8, 0.8)]
