"""Replicates against plain resampling: their weights, their sums, and the intervals and p-values on top."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.functions.numeric import ratio
from wearline.operators import replicates as rp
from wearline.operators import resample as rs


def listed(kind, key, size, labels, b, first=0, last=None):
    got = dict(rp.weights(kind, key, size, labels, b, first, size if last is None else last))
    return np.array([got[i] for i in sorted(got)])


@pytest.mark.parametrize("size", [1, 2, 7, 64, 333])
def test_weights_are_whole_replicates(size):
    drawn = listed(rp.DRAWN, 9, size, 0, 4000)
    assert drawn.shape == (size, 4000) and (drawn.sum(axis=0) == size).all() and drawn.min() >= 0
    if size > 1:
        assert abs(drawn.mean(axis=1) - 1).max() < 0.1
        assert abs(drawn.var(axis=1) - (1 - 1 / size)).max() < 0.2
    labels = size // 3
    marked = listed(rp.LABELLED, 9, size, labels, 4000)
    assert (marked.sum(axis=0) == labels).all() and set(np.unique(marked)) <= {0, 1}
    assert abs(marked.mean(axis=1) - labels / size).max() < 0.05
    signs = listed(rp.SIGNED, 9, size, 0, 4000)
    assert set(np.unique(signs)) == {-1, 1} and abs(signs.mean(axis=1)).max() < 0.1


def test_every_range_finds_the_same_weights():
    for kind in (rp.DRAWN, rp.LABELLED, rp.SIGNED):
        whole = listed(kind, -5, 100, 31, 50)
        parts = [listed(kind, -5, 100, 31, 50, lo, min(100, lo + 13)) for lo in range(0, 100, 13)]
        assert (np.concatenate(parts) == whole).all()
    assert (listed(rp.DRAWN, 1, 100, 0, 50) != listed(rp.DRAWN, 2, 100, 0, 50)).any()


def test_counts_of_two_clusters_are_multinomial():
    """Of three clusters, the joint counts have the multinomial's probabilities."""
    w = listed(rp.DRAWN, 3, 3, 0, 60_000)
    seen = {tuple(c): n / 60_000 for c, n in zip(*np.unique(w.T, axis=0, return_counts=True), strict=True)}
    assert abs(seen[1, 1, 1] - 6 / 27) < 0.01 and abs(seen[3, 0, 0] - 1 / 27) < 0.005 and abs(seen[0, 1, 2] - 3 / 27) < 0.007


def test_sums_over_many_ranges_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(rp, "RANGE", 7)
    monkeypatch.setattr(rp, "HELD", 3)
    rng = np.random.default_rng(1)
    rows = [(g, u if u else None, c, float(rng.integers(0, 9))) for g in ("a", None) for u in range(40) for c in ("x", None)]
    df = spark.createDataFrame(rows, "g string, u int, c string, v double").repartition(5)
    got = {(r.g, r.c, r.b): r.v for r in rp.replicate_sums(df, ["g"], ["u"], ["v"], 20, "s", cells=["c"]).collect()}
    assert len(got) == 2 * 2 * 20
    again = rp.replicate_sums(df.repartition(2), ["g"], ["u"], ["v"], 20, "s", cells=["c"]).collect()
    assert {(r.g, r.c, r.b): r.v for r in again} == got
    ones = df.where("c = 'x'").withColumn("v", F.lit(1.0))
    assert {r.v for r in rp.replicate_sums(ones, ["g"], ["u"], ["v"], 20, "s").collect()} == {40.0}
    whole = rp.replicate_sums(ones, [], ["g", "u"], ["v"], 20, "s").collect()
    assert sorted(r.b for r in whole) == list(range(1, 21)) and {r.v for r in whole} == {80.0}
    assert rp.replicate_sums(df.limit(0), ["g"], ["u"], ["v"], 20, "s").count() == 0


def near(got, values, slack=0.12):
    lo, hi = np.quantile(values, [0.025, 0.975])
    return abs(got.lo - lo) < slack * (hi - lo) and abs(got.hi - hi) < slack * (hi - lo)


def test_intervals_equal_plain_resampling(spark):
    rng = np.random.default_rng(4)
    n, h = rng.integers(1, 20, 60), rng.random(60)
    hits = np.rint(n * h)
    x, y = rng.normal(size=60), np.rint(rng.normal(size=60) * 2)
    y = y + np.rint(2 * x)
    rows = [(i, float(n[i]), float(hits[i]), float(x[i]), float(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "u int, n double, h double, x double, y double").withColumn("g", F.lit("a"))
    picks = rng.integers(0, 60, (10_000, 60))
    got = rs.cluster_bootstrap(df, ["g"], ["u"], ["n", "h"], ratio("h", "n")).first()
    assert got.replicates == 10_000 and near(got, hits[picks].sum(axis=1) / n[picks].sum(axis=1))

    def r(a, b):
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))

    def ranks(v):
        return (v[:, :, None] > v[:, None, :]).sum(axis=2) + ((v[:, :, None] == v[:, None, :]).sum(axis=2) + 1) / 2

    assert near(rs.bootstrap_pearson_ci(df, ["g"], ["u"], "x", "y").first(), r(x[picks], y[picks]))
    rho = np.concatenate([r(ranks(x[p]), ranks(y[p])) for p in np.split(picks[:5000], 10)])
    assert near(rs.bootstrap_rank_ci(df, ["g"], ["u"], "x", "y").first(), rho)


def test_ranks_of_large_groups_as_tables(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 6)), float(rng.integers(0, 6)), "a" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "u int, x double, y double, g string")
    arrays = {r.g: r for r in rs.bootstrap_rank_ci(df, ["g"], ["u"], "x", "y", 400).collect()}
    monkeypatch.setattr(rs, "CELLS", 3)
    tables = {r.g: r for r in rs.bootstrap_rank_ci(df, ["g"], ["u"], "x", "y", 400).collect()}
    for g in ("a", None):
        wide = arrays[g].hi - arrays[g].lo
        assert abs(arrays[g].lo - tables[g].lo) < 0.3 * wide and abs(arrays[g].hi - tables[g].hi) < 0.3 * wide


def test_rank_replicates_equal_ranking_every_sample():
    x, y = np.array([1.0, 1.0, 2.0, 3.0, 3.0]), np.array([5.0, 6.0, 5.0, 1.0, 6.0])
    n = np.array([3, 1, 2, 2, 1])
    got = rs.rank_replicates(x, y, n, np.random.default_rng(3), 500)
    w = np.random.default_rng(3).multinomial(9, n / 9, 500)
    for value, counts in zip(got, w, strict=True):
        a, b = np.repeat(x, counts), np.repeat(y, counts)
        rank = lambda v: np.array([(v < z).sum() + ((v == z).sum() + 1) / 2 for z in v])
        p, q = rank(a) - 5, rank(b) - 5
        both = (p * p).sum() * (q * q).sum()
        assert np.isclose(value, (p * q).sum() / np.sqrt(both) if both else 0.0)


def test_permuted_labels_and_signs_equal_plain_permutation(spark):
    rng = np.random.default_rng(8)
    items = [(i, i % 3 == 0, float(rng.random() < 0.4 + 0.25 * (i % 3 == 0))) for i in range(30) for _ in range(rng.integers(1, 9))]
    df = spark.createDataFrame(items, "i int, lab boolean, hit double").withColumn("g", F.lit("a"))
    n, h, lab = np.zeros(30), np.zeros(30), np.arange(30) % 3 == 0
    for i, _, x in items:
        n[i], h[i] = n[i] + 1, h[i] + x
    gap = lambda m: h[m].sum() / n[m].sum() - h[~m].sum() / n[~m].sum()
    plain = np.array([gap(rng.permutation(lab)) for _ in range(10_000)])
    got = rs.permute_labels(df, ["g"], "i", "lab", "hit").first()
    assert got.permutations == 10_000 and np.isclose(got.observed, gap(lab))
    assert abs(got.p - (abs(plain) >= abs(gap(lab)) - 1e-12).mean()) < 0.03
    diff = [(i, float(rng.normal(0.4))) for i in range(25) for _ in range(2)]
    sums = np.bincount([i for i, _ in diff], [v for _, v in diff])
    flips = (rng.integers(0, 2, (10_000, 25)) * 2 - 1) @ sums / 50
    flipped = rs.sign_flip(spark.createDataFrame(diff, "u int, d double").withColumn("g", F.lit(1)), ["g"], ["u"], "d").first()
    assert np.isclose(flipped.observed, sums.sum() / 50)
    assert abs(flipped.p - (abs(flips) >= abs(sums.sum() / 50) - 1e-12).mean()) < 0.02


def test_permuted_units_equal_plain_permutation(spark, monkeypatch):
    rng = np.random.default_rng(9)
    shown = {(u, n): "ud"[rng.integers(0, 2)] for u in range(24) for n in (5, 9)}
    claims = [("D", u, n, "s", s if rng.random() < 0.55 else "ud"[rng.integers(0, 2)]) for (u, n), s in shown.items() for _ in range(2)]
    full = spark.createDataFrame([("D", u, n, "s", s) for (u, n), s in shown.items()], "dataset string, unit int, n int, sensor string, actual string")
    said = spark.createDataFrame(claims, "dataset string, unit int, n int, sensor string, claimed string")
    said = said.join(full, ["dataset", "unit", "n", "sensor"])

    def v(order):
        t = np.zeros((2, 2))
        for _, u, n, _, c in claims:
            t["ud".index(c), "ud".index(shown[order[u], n])] += 1
        e = t.sum(axis=1)[:, None] * t.sum(axis=0) / t.sum()
        return np.sqrt(((t - e) ** 2 / e).sum() / t.sum())

    plain = np.array([v(rng.permutation(24)) for _ in range(4000)])
    args = (["n", "sensor"], ["sensor"], "claimed", "actual")
    got = rs.permute_units(said, full, *args).first()
    assert got.permutations == 10_000 and np.isclose(got.observed, v(range(24)))
    assert abs(got.p - (plain >= v(range(24)) - 1e-12).mean()) < 0.03
    monkeypatch.setattr(rs, "CELLS", 3)
    tables = rs.permute_units(said, full, *args, b=300).first()
    assert tables.permutations == 300 and abs(tables.p - got.p) < 0.1


def test_association_of_resampled_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(u, "ab"[x], "pq"[x if rng.random() < 0.7 else 1 - x]) for u in range(20) for x in rng.integers(0, 2, 6)]
    df = spark.createDataFrame(rows, "u int, said string, shown string").withColumn("g", F.lit("a"))
    t = np.zeros((20, 2, 2))
    for u, a, c in rows:
        t[u, "ab".index(a), "pq".index(c)] += 1
    picks = t[rng.integers(0, 20, (10_000, 20))].sum(axis=1)
    e = picks.sum(axis=2, keepdims=True) * picks.sum(axis=1, keepdims=True) / picks.sum(axis=(1, 2), keepdims=True)
    v = np.sqrt(((picks - e) ** 2 / e).sum(axis=(1, 2)) / picks.sum(axis=(1, 2)))
    assert near(rs.bootstrap_association(df, ["g"], ["u"], "said", "shown").first(), v)


@pytest.mark.parametrize("kind", [rp.DRAWN, rp.LABELLED])
def test_small_nodes_of_large_groups_deal_whole_replicates(kind):
    """Nodes of at most seven positions deal their draws at once: the same weights for every range, and plain resampling's moments."""
    size, labels, b, leaf = 40, 13, 4000, 7

    def listed_by_node(first, last):
        w = np.full((size, b), -1)
        for lo, hi, held, draw in rp.nodes(kind, 5, size, labels, b, first, last, leaf):
            assert hi - lo <= leaf
            for replicates, some in rp.dealt(kind, draw, held, hi - lo):
                w[lo:hi, replicates] = some.T
        return w[first:last]

    whole = listed_by_node(0, size)
    assert (np.concatenate([listed_by_node(at, at + 10) for at in range(0, size, 10)]) == whole).all()
    if kind == rp.DRAWN:
        assert (whole.sum(axis=0) == size).all() and whole.min() >= 0
        assert abs(whole.mean(axis=1) - 1).max() < 0.1 and abs(whole.var(axis=1) - (1 - 1 / size)).max() < 0.2
    else:
        assert (whole.sum(axis=0) == labels).all() and set(np.unique(whole)) == {0, 1}
        assert abs(whole.mean(axis=1) - labels / size).max() < 0.05
    assert abs(np.corrcoef(whole) + 1 / (size - 1))[~np.eye(size, dtype=bool)].max() < 0.08


def test_intervals_of_large_groups_equal_those_of_single_clusters(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(u, "pq"[rng.integers(0, 2)], "ab"[rng.integers(0, 2)], float(rng.integers(0, 5))) for u in range(200) for _ in range(3)]
    df = spark.createDataFrame(rows, "u int, said string, shown string, v double").withColumns({"g": F.lit("a"), "n": F.lit(1.0)})
    both = []
    for leaf in (1024, 16):
        monkeypatch.setattr(rp, "LEAF", leaf)
        ci = rs.cluster_bootstrap(df, ["g"], ["u"], ["n", "v"], ratio("v", "n"), 4000).first()
        both.append((ci, rs.bootstrap_association(df, ["g"], ["u"], "said", "shown", 4000).first()))
    for one, two in zip(*both, strict=True):
        wide = one.hi - one.lo
        assert one != two and abs(one.lo - two.lo) < 0.15 * wide and abs(one.hi - two.hi) < 0.15 * wide


def test_dealt_profiles_are_a_permutation():
    counts, b = np.array([9, 0, 4, 27]), 3000
    got = np.full((40, b), -1)
    before, rs.LEAF = rs.LEAF, 6
    try:
        for lo, hi, replicates, dealt in rs.deal_profiles(2, 40, counts, b, 0, 40):
            got[lo:hi, replicates] = dealt.T
    finally:
        rs.LEAF = before
    assert all((np.bincount(got[:, r], minlength=4) == counts).all() for r in range(b))
    for i, n in enumerate(counts):
        assert abs((got == i).mean(axis=1) - n / 40).max() < 0.05


def test_units_of_large_datasets_are_permuted_in_ranges(spark, monkeypatch):
    """Datasets beyond CELLS make no row per unit and replicate, and give the p-values of plain permutation."""
    rng = np.random.default_rng(21)
    shown = {(u, n, s): "ud"[rng.integers(0, 2)] for u in range(60) for n in (5, 9) for s in "xy" if (u + n) % 7}
    claims = [("D", *key, v if rng.random() < 0.56 else "ud"[rng.integers(0, 2)]) for key, v in shown.items()]
    full = spark.createDataFrame([("D", *key, v) for key, v in shown.items()], "dataset string, unit int, n int, sensor string, actual string")
    said = spark.createDataFrame(claims, "dataset string, unit int, n int, sensor string, claimed string")
    said = said.join(full, ["dataset", "unit", "n", "sensor"])
    args = (["n", "sensor"], ["sensor"], "claimed", "actual")
    small = {r.sensor: r for r in rs.permute_units(said, full, *args, b=3000).collect()}
    for name, value in (("CELLS", 3), ("LEAF", 8), ("RANGE", 20)):
        monkeypatch.setattr(rs, name, value)
    large = rs.permute_units(said, full, *args, b=3000)
    assert "Generate explode(sequence(1, 3000" not in large._jdf.queryExecution().optimizedPlan().toString()
    large = {r.sensor: r for r in large.collect()}
    assert set(small) == set(large) == {"x", "y"}
    for s, r in large.items():
        assert r.permutations == 3000 and np.isclose(r.observed, small[s].observed) and abs(r.p - small[s].p) < 0.04
    whole = rs.permute_units(said, full, ["n", "sensor"], [], "claimed", "actual", b=500).first()
    assert whole.permutations == 500
