"""Edge cases and brute-force comparisons of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.functions import numeric as nm
from wearline.functions import tails
from wearline.operators import claims as cl
from wearline.operators import frames as fr
from wearline.operators import metrics as m
from wearline.operators import ordering as od
from wearline.operators import rank as rk
from wearline.operators import resample as rs
from wearline.operators import sampling as sp
from wearline.operators import validate as va


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values are tied."""
    rng = random.Random(3)
    rows = [("hot" if i % 4 else f"g{i % 3}", i, rng.randrange(12), rng.randrange(9)) for i in range(400)]
    return spark.createDataFrame(rows, "g string, id int, x int, y int"), rows


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def mean_ranks(v):
    v = np.asarray(v, dtype=float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def tau_b(x, y):
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(list(zip(x, y)), 2):
        s += np.sign(a - c) * np.sign(b - d)
        tx += a == c
        ty += b == d
    n0 = len(x) * (len(x) - 1) / 2
    den = math.sqrt((n0 - tx) * (n0 - ty))
    return s / den if den else None


def test_positions_in_skewed_groups(skewed):
    df, rows = skewed
    got = od.value_positions(df, ["g"], "id", total="n").collect()
    for g, members in by_group(rows).items():
        assert sorted((r.id, r.pos, r.n) for r in got if r.g == g) == [(r[1], i + 1, len(members)) for i, r in enumerate(members)]


def test_hash_positions_do_not_depend_on_partitioning(skewed):
    df, _ = skewed
    one = {(r.id, r.pos) for r in od.hash_positions(df.repartition(1), ["g"], ["id"], 7).collect()}
    two = {(r.id, r.pos) for r in od.hash_positions(df.repartition(13), ["g"], ["id"], 7).collect()}
    assert one == two


def test_rank_correlations_match_brute_force(skewed):
    df, rows = skewed
    rho = {r.g: r for r in rk.spearman(df, ["g"], "x", "y").collect()}
    tau = {r.g: r for r in rk.kendall(df, ["g"], "x", "y").collect()}
    for g, members in by_group(rows).items():
        x, y = [r[2] for r in members], [r[3] for r in members]
        assert rho[g].n == tau[g].n == len(x)
        assert rho[g].rho == pytest.approx(np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1], abs=1e-12)
        assert tau[g].tau == pytest.approx(tau_b(x, y), abs=1e-12)


def test_rank_correlation_of_continuous_values(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = x + rng.normal(size=300)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    assert rk.kendall(df, ["g"], "x", "y").first().tau == pytest.approx(tau_b(x, y), abs=1e-12)
    assert rk.spearman(df, ["g"], "x", "y").first().rho == pytest.approx(np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1], abs=1e-12)


def test_constant_predictor_has_no_rank_correlation(spark):
    df = spark.createDataFrame([("a", 5.0, float(i)) for i in range(6)], "g string, pred double, truth double")
    assert rk.spearman(df, ["g"], "pred", "truth").first().rho is None
    assert rk.kendall(df, ["g"], "pred", "truth").first().tau is None
    assert rk.pearson(df, ["g"], "pred", "truth").first().r is None
    none = rs.bootstrap_pearson_ci(df, ["g"], ["truth"], "pred", "truth", 10).first()
    assert (none.replicates, none.lo) == (0, None)
    assert rs.bootstrap_rank_ci(df, ["g"], ["truth"], "pred", "truth", 10).first().lo == 0.0
    one = spark.createDataFrame([("a", 1, 2.0, 3.0)], "g string, k int, x double, y double")
    assert rk.leave_one_out(one, ["g"], "k", "x", "y").first().r is None
    assert m.is_degenerate(df, ["g"]).first().degenerate
    c = m.concentration(df, ["g"]).first()
    assert (c.distinct_values, c.modal_value, c.modal_share_pct, c.entropy_bits) == (1, 5.0, 100.0, 0.0)


def test_percentiles_interpolate(skewed):
    df, rows = skewed
    got = {r.g: r for r in od.exact_percentile(df, ["g"], "x", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()}
    for g, members in by_group(rows).items():
        want = np.percentile([r[2] for r in members], [2.5, 50, 97.5])
        assert [got[g].lo, got[g].mid, got[g].hi] == pytest.approx(list(want))


def test_mode_takes_the_smallest_of_tied_values(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 1.0, 2.0)], "pred double")
    r = m.concentration(df, []).first()
    assert (r.modal_value, r.distinct_values) == (1.0, 3)
    assert r.entropy_bits <= r.entropy_max


def test_leave_one_out_matches_recomputation(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(50, 3, 12), rng.normal(50, 3, 12)
    df = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(12)], "g string, k int, x double, y double")
    for r in rk.leave_one_out(df, ["g"], "k", "x", "y").collect():
        keep = np.arange(12) != r.k
        assert r.r == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1], abs=1e-9)


# ------------------------------------------------------------------ trajectories
@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(2)
    rows = [("D", u, c, float(rng.normal()), 1.0) for u, n in ((1, 50), (2, 7), (3, 31)) for c in range(1, n + 1)]
    return spark.createDataFrame(rows, "dataset string, unit int, cycle int, s1 double, s2 double"), rows


def test_sliding_features_do_not_depend_on_chunks(units):
    df, rows = units
    whole = {(r.unit, r.cycle): r for r in fr.sliding_features(df, ["s1"], 5).collect()}
    cut = {(r.unit, r.cycle): r for r in fr.sliding_features(df, ["s1"], 5, chunk=6).collect()}
    assert whole.keys() == cut.keys() and len(whole) == 46 + 3 + 27
    for k, r in cut.items():
        v = np.array([x[3] for x in rows if x[1] == k[0]])[k[1] - 5 : k[1]]
        assert (r.s1_mean, r.s1_sd, r.s1_net) == pytest.approx((v.mean(), v.std(), v[-1] - v[0]), abs=1e-9)


def test_short_units_are_padded_with_zeros(units):
    df, rows = units
    got = {r.unit: r for r in fr.tail_features(df, ["s1"], 30).collect()}
    v = np.array([x[3] for x in rows if x[1] == 2])
    p = np.concatenate([np.zeros(23), v])
    assert (got[2].s1_mean, got[2].s1_sd, got[2].s1_net) == pytest.approx((p.mean(), p.std(), p[-1] - p[0]), abs=1e-9)
    seq = {r.unit: r.sequence for r in fr.tail_sequences(df, ["s1", "s2"], 30).collect()}
    assert len(seq[2]) == 30 and seq[2][0] == [0.0, 0.0] and seq[2][-1][0] == pytest.approx(v[-1])


def test_lag_labels_start_at_n_even_for_short_windows(units):
    df, _ = units
    got = fr.lag_labels(fr.tail_window(df, 10), 10).where("unit = 2").orderBy("cycle").collect()
    assert [r.label for r in got] == [f"t-{k}" for k in (10, 9, 8, 7, 6, 5, 4)]


def test_directions_threshold_and_reversal(spark):
    vals = {"up": (0.0, 0.5), "flat": (0.5, 0.5094), "down": (0.9, 0.1)}
    rows = [("D", 1, c, *[v[c] for v in vals.values()]) for c in (0, 1)]
    df = spark.createDataFrame(rows, "dataset string, unit int, cycle int, up double, flat double, down double")
    tail = fr.tail_window(df, 2)
    get = lambda w: {r.sensor: r.actual for r in fr.window_direction(w, list(vals), ["dataset", "unit"]).collect()}
    assert get(tail) == {"up": "increase", "flat": "stable", "down": "decrease"}
    assert get(fr.reverse_window(tail)) == {"up": "decrease", "flat": "stable", "down": "increase"}


def test_scaling_of_constant_and_unseen_groups(spark):
    train = spark.createDataFrame([("A", 1.0, 4.0), ("A", 3.0, 4.0)], "dataset string, s1 double, s2 double")
    test = spark.createDataFrame([("A", 5.0, 4.0), ("B", 1.0, 1.0)], "dataset string, s1 double, s2 double")
    scaler = fr.fit_minmax(train, ["s1", "s2"])
    raw = {r.dataset: r for r in fr.apply_minmax(test, scaler, ["s1", "s2"]).collect()}
    assert (raw["A"].s1, raw["A"].s2, raw["B"].s1) == (2.0, 0.0, None)
    clipped = {r.dataset: r for r in fr.apply_minmax(test, scaler, ["s1", "s2"], clip=True).collect()}
    assert (clipped["A"].s1, clipped["B"].s1) == (1.0, None)


def test_bins_and_last_values(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 40.0, 40.5, 80.0, 81.0, 125.0, 126.0, -1.0)], "x double")
    assert [r[0] for r in df.select(nm.bin_rul("x")).collect()] == [0, 0, 1, 1, 2, 2, None, None]
    obs = spark.createDataFrame([("D", 1, 1, 2.0), ("D", 1, 2, None)], "dataset string, unit int, cycle int, s1 double")
    r = fr.last_observation(obs, ["s1"]).first()
    assert (r.cycle, r.s1) == (2, 2.0)


# ------------------------------------------------------------------ tails, multiplicity, tests
def test_tail_probabilities(spark):
    # tabulated values of the three distributions
    row = spark.range(1).select(
        tails.student_two_sided(F.lit(2.228138851964939), F.lit(10)).alias("t"),
        tails.chi_square_upper(F.lit(9.487729036781154), F.lit(4)).alias("c"),
        tails.normal_two_sided(F.lit(1.959963984540054)).alias("z"),
        tails.correlation_p(F.lit(1.0), F.lit(9)).alias("one"),
    ).first()
    assert (row.t, row.c, row.z, row.one) == pytest.approx((0.05, 0.05, 0.05, 0.0), abs=1e-9)


def test_adjusted_p_values_with_ties_and_nulls(spark):
    ps = [0.01, 0.04, 0.04, 0.2, None, 0.001]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double")
    got = {r.i: r for r in rs.adjust_pvalues(df, ["f"], "p").collect()}
    live = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    best, want = 1.0, {}
    for k in range(len(live), 0, -1):
        best = min(best, live[k - 1][0] * len(live) / k)
        want[live[k - 1][1]] = best
    assert {i: got[i].p_bh for i in want} == pytest.approx(want)
    assert got[4].p_bh is None and got[4].significant_bh is None
    assert got[5].p_bonferroni == pytest.approx(0.005)


# Published values of one family of 27 rank tests: raw p and its Benjamini-Hochberg adjustment.
FAMILY = {
    0.5836823417355845: 0.746272443972374, 0.7849377203569943: 0.821242860346693, 0.0352924165991962: 0.09635298529455423,
    0.4894638804002031: 0.6955539350216254, 0.1623865132726003: 0.31317398988287204, 0.7908264581116303: 0.821242860346693,
    0.0086539181263747: 0.05841394735302923, 0.0665148364666096: 0.16326368950895087, 0.6106052074296151: 0.746272443972374,
    0.588349253342412: 0.746272443972374, 0.0030251176307698: 0.037811059681104, 0.2543212151530428: 0.3868098151537128,
    0.0356862908498349: 0.09635298529455423, 0.0159934212702472: 0.08636447485933488, 0.0330072191932271: 0.09635298529455423,
    0.0285293992203836: 0.09635298529455423, 0.6357135633838742: 0.746272443972374, 0.2162993769077534: 0.36500519853183383,
    0.0015759440365498: 0.037811059681104, 0.9106797218748258: 0.9106797218748258, 0.2011106429193515: 0.3619991572548327,
    0.1131265998596685: 0.23495524586238842, 0.0826088111403939: 0.18586982506588626, 0.004201228853456: 0.037811059681104,
    0.2578732101024752: 0.3868098151537128, 0.7013934792010869: 0.7890676641012226, 0.021444643079813: 0.09635298529455423,
}


def test_published_family_of_p_values(spark):
    df = spark.createDataFrame([("f", p) for p in FAMILY], "f string, p double")
    got = rs.adjust_pvalues(df, ["f"], "p").collect()
    assert {r.p: r.p_bh for r in got} == pytest.approx(FAMILY)
    assert [sum(r[c] for r in got) for c in ("significant_raw", "significant_bh", "significant_bonferroni")] == [10, 3, 1]


def test_association_against_a_completed_table(spark):
    cells = {("i", "i"): 12, ("i", "d"): 3, ("d", "d"): 9, ("d", "s"): 4}
    rows = [("g", a, b) for (a, b), n in cells.items() for _ in range(n)] + [("one", "i", "d")] * 12 + [("few", "i", "d"), ("few", "d", "i")]
    df = spark.createDataFrame(rows, "g string, a string, b string")
    got = {r.g: r for r in m.association(df, ["g"], "a", "b").collect()}
    t = np.array([[12, 3, 0], [0, 9, 4]], dtype=float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    chi2 = ((t - e) ** 2 / e).sum()
    assert got["g"].chi2 == pytest.approx(chi2)
    assert got["g"].cramers_v == pytest.approx(math.sqrt(chi2 / t.sum()))
    assert got["one"].chi2 is None and "few" not in got


def test_yates_correction(spark):
    rows = [(True, True)] * 8 + [(True, False)] * 2 + [(False, True)] * 3 + [(False, False)] * 7
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    got = m.chi2_2x2(df, [], F.col("a"), F.col("b")).first()
    n, gap = 20, 8 * 7 - 2 * 3
    assert got.chi2 == pytest.approx(n * (gap - n / 2) ** 2 / (10 * 10 * 11 * 9))


def test_bootstrap_of_identical_clusters_is_a_point(spark):
    df = spark.createDataFrame([("c", u, 1.0, float(u % 1)) for u in range(9)], "g string, u int, n double, h double")
    r = rs.cluster_bootstrap(df, ["g"], ["u"], ["n", "h"], nm.ratio("h", "n"), 50).first()
    assert (r.replicates, r.lo, r.hi) == (50, 0.0, 0.0)


def test_unit_permutations_are_permutations_within_blocks(spark):
    df = spark.createDataFrame([("A" if u < 7 else "B", u) for u in range(12)], "dataset string, unit int")
    got = rs.unit_permutations(df, 6, "s").collect()
    for b in range(1, 7):
        for block, ids in (("A", set(range(7))), ("B", set(range(7, 12)))):
            pairs = [(r.unit, r.swapped) for r in got if r.b == b and r.dataset == block]
            assert {u for u, _ in pairs} == {s for _, s in pairs} == ids and len(pairs) == len(ids)
    assert any(r.unit != r.swapped for r in got)


def test_exact_sensor_permutation(spark):
    rows = [(s, float(h)) for s, hits in {"a": (1, 1), "b": (1, 0), "c": (0, 0), "d": (0, 1)}.items() for h in hits]
    df = spark.createDataFrame(rows, "sensor string, hit double")
    r = rs.permute_sensors(df, [], "sensor", ["a", "b"], ["a", "b", "c", "d"], "hit").first()
    # gaps of the six labellings: ±0.5 for {ab},{cd},{ad},{bc}; 0 for {ac},{bd}
    assert (r.observed, r.permutations, r.hits, r.p) == (0.5, 6, 4, pytest.approx(4 / 6))


# ------------------------------------------------------------------ samples and validation
def test_stratified_sample_meets_quotas(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "s int, id0 int")
    got = sp.stratified_sample(df, "s", ["id0"], {0: 5, 1: 100, 7: 3}).collect()
    assert sorted(r.id for r in got) == list(range(1, 26))
    assert sum(r.s == 0 for r in got) == 5 and sum(r.s == 1 for r in got) == 20


def test_group_split_keeps_units_whole(units):
    df, _ = units
    got = sp.group_split(df, 0.4).groupBy("unit").agg(F.count_distinct("validation").alias("k"), F.max("validation").alias("v")).collect()
    assert all(r.k == 1 for r in got) and sum(r.v for r in got) == 1


def test_confusion_has_every_cell(spark):
    df = spark.createDataFrame([("increase", "increase"), ("increase", "stable")], "e string, a string")
    got = {(r.e, r.a): r.n for r in va.confusion(df, "e", "a", va.LABELS).collect()}
    assert len(got) == 25 and got["increase", "increase"] == 1 and got["absent", "absent"] == 0
    scores = {r["class"]: r for r in va.class_scores(df, "e", "a", va.LABELS).collect()}
    assert scores["increase"].precision == 0.5 and scores["stable"].precision is None


def test_audit_statuses(spark):
    known = spark.createDataFrame([("a", 10.0), ("b", 1000.0)], "name string, value double")
    stated = spark.createDataFrame([("a", 10.05), ("b", 1003.0), ("c", 1.0)], "name string, stated double")
    assert {r.name: r.status for r in va.audit(stated, known).collect()} == {"a": "ok", "b": "mismatch", "c": "missing"}


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(va.upsert(old, new, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.k for r in va.pending(new, old, ["k"]).collect()] == [3]


def test_reversal_pairs(spark):
    rows = [
        ("repl", 1, "s1", "increase", "increase", "increase"),
        ("revdata", 1, "s1", "increase", "decrease", "increase"),
        ("repl", 2, "s1", "increase", "stable", "increase"),
        ("revdata", 2, "s1", "decrease", "stable", "increase"),
        ("repl", 3, "s1", "increase", "decrease", "increase"),
        ("revdata", 3, "s1", "decrease", "increase", "increase"),
        ("repl", 4, "s1", "absent", "decrease", "increase"),
        ("revdata", 4, "s1", "decrease", "increase", "increase"),
    ]
    df = spark.createDataFrame(rows, "arm string, engine int, sensor string, claimed string, actual string, expected string")
    rev = cl.trend_reversals(df)
    assert sorted((r.engine, r.changed) for r in rev.collect()) == [(1, False), (3, True)]
    assert [(r.sensor, r.engine) for r in cl.worked_example(rev).collect()] == [("s1", 1)]


def test_rank_sum_test_of_small_samples(spark):
    """Tabulated values, every alternative, and all orders of small samples."""
    assert tails.mann_whitney_counts(3, 2) == [1, 1, 2, 2, 2, 1, 1]
    for n1, n2 in ((1, 1), (4, 3), (2, 6)):
        us = [sum(a > b for a in first for b in set(range(n1 + n2)) - set(first)) for first in itertools.combinations(range(n1 + n2), n1)]
        assert tails.mann_whitney_counts(n1, n2) == [us.count(u) for u in range(n1 * n2 + 1)]
    # critical values of the 5 % tables: 2 for five against five, 13 for eight against eight (two-sided)
    assert tails.mann_whitney_exact(2, 5, 5, "two-sided") < 0.05 < tails.mann_whitney_exact(3, 5, 5, "two-sided")
    assert tails.mann_whitney_exact(13, 8, 8, "two-sided") < 0.05 < tails.mann_whitney_exact(14, 8, 8, "two-sided")
    assert abs(tails.mann_whitney_exact(4, 5, 5, "less") - 12 / 252) < 1e-12
    rows = [("s", "a", float(v)) for v in (1, 2, 4)] + [("s", "b", float(v)) for v in (3, 5, 6, 7)]
    rows += [("tied", "a", 1.0), ("tied", "a", 2.0), ("tied", "b", 2.0), ("tied", "b", 3.0), ("one", "a", 1.0)]
    df = spark.createDataFrame(rows, "g string, side string, v double")
    got = {x: {r.g: r for r in rk.mann_whitney(df, ["g"], "side", "v", "a", "b", x).collect()} for x in ("less", "greater", "two-sided")}
    assert got["less"]["s"].u == 1.0
    assert got["less"]["s"].p == pytest.approx(2 / 35) and got["two-sided"]["s"].p == pytest.approx(4 / 35)
    assert got["greater"]["s"].p == pytest.approx(34 / 35)
    # ties: normal with corrections; U = 0.5, mean 2, variance 4/12 * (5 - 6/12)
    z = (2 - 0.5 - 0.5) / math.sqrt(4 / 12 * (5 - 6 / 12))
    assert got["less"]["tied"].p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2)
    assert got["less"]["one"].p is None
    with pytest.raises(ValueError):
        rk.mann_whitney(df, ["g"], "side", "v", "a", "b", "lower")
