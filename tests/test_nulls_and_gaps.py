"""Null keys, gaps between cycles, large windows and quotas, and undefined values."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wearline.functions.tails import kendall_exact
from wearline.operators import claims, frames, metrics, ordering, rank, sampling, validate


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = [(g, i, float(rng.randint(0, 6)), float(rng.randint(0, 6))) for g in ("a", None) for i in range(40)]
    return spark.createDataFrame(rows, "g string, i long, x double, y double").repartition(3)


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def test_null_groups_stay(scored):
    assert set(by_group(rank.spearman(scored, ["g"], "x", "y"))) == {"a", None}
    tests = by_group(rank.rank_tests(scored, ["g"], "x", "y"))
    assert set(tests) == {"a", None} and all(r["tau_p"] is not None for r in tests.values())
    assert set(by_group(ordering.exact_percentile(scored, ["g"], "x", {"m": 0.5}))) == {"a", None}
    assert len(rank.leave_one_out(scored, ["g"], "i", "x", "y").collect()) == 80
    assert {r["g"] for r in rank.rank_sums(scored, ["g"], "i", "x").collect()} == {"a", None}
    models = scored.select("g", F.col("x").alias("pred"), F.col("y").alias("truth"))
    assert set(by_group(metrics.score_models(models, ["g"]))) == {"a", None}
    assert sampling.group_split(scored, unit=["g"]).count() == 80
    assert frames.with_life(scored, ["g"], "i").count() == 80


def tau_p(pairs):
    """Normal test of tau-b by counting pairs and ties."""
    n = len(pairs)
    sign = lambda v: (v > 0) - (v < 0)
    net = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(pairs) for b in pairs[:i])
    ties = []
    for k in (0, 1):
        counts = [[p[k] for p in pairs].count(v) for v in {p[k] for p in pairs}]
        ties.append((sum(t * (t - 1) / 2 for t in counts), sum(t * (t - 1) * (t - 2) for t in counts), sum(t * (t - 1) * (2 * t + 5) for t in counts)))
    (tx, ux, vx), (ty, uy, vy) = ties
    m = n * (n - 1)
    return net, net / ((m * (2 * n + 5) - vx - vy) / 18 + 2 * tx * ty / m + ux * uy / (9 * m * (n - 2))) ** 0.5


def test_kendall_with_ties_and_exact(spark, scored):
    got = by_group(rank.rank_tests(scored, ["g"], "x", "y"))
    for g in ("a", None):
        pairs = [(r["x"], r["y"]) for r in scored.collect() if r["g"] == g]
        assert got[g]["tau_z"] == pytest.approx(tau_p(pairs)[1])
    order = [3, 1, 2, 5, 4, 7, 6]
    few = spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate(order)], "g string, x double, y double")
    net = sum(1 if b > a else -1 for i, b in enumerate(order) for a in order[:i])
    assert by_group(rank.rank_tests(few, ["g"], "x", "y"))["a"]["tau_p"] == pytest.approx(kendall_exact(7, net))
    # all 24 orders of four: 1, 3, 5, 6, 5, 3, 1 by inversions
    assert [kendall_exact(4, n) for n in (6, 4, 2, 0)] == pytest.approx([2 / 24, 8 / 24, 18 / 24, 1.0])


def trajectory(spark, cycles, unit=1):
    rows = [("D", unit, c, float(i * i % 17)) for i, c in enumerate(cycles)]
    return spark.createDataFrame(rows, "dataset string, unit long, cycle long, s double").repartition(3)


@pytest.mark.parametrize(("n", "chunk"), [(5, 6), (20, 6), (5, 3)])
def test_windows_count_rows_where_cycles_have_gaps(spark, n, chunk):
    cycles = list(range(2, 82, 2))
    df = trajectory(spark, cycles)
    got = {r["cycle"]: r for r in frames.sliding_features(df, ["s"], n, chunk=chunk).collect()}
    values = [float(i * i % 17) for i in range(40)]
    assert sorted(got) == cycles[n - 1 :]
    for i, c in enumerate(cycles[n - 1 :], n - 1):
        assert got[c]["s_mean"] == pytest.approx(sum(values[i - n + 1 : i + 1]) / n)
        assert got[c]["s_net"] == values[i] - values[i - n + 1]
    assert frames.sequences(df, ["s"], n, chunk=chunk).count() == 41 - n
    assert frames.eligible_cuts(df, n).count() == 41 - n


def test_a_window_longer_than_a_chunk(spark):
    df = spark.range(1, 20_501).select(F.lit("D").alias("dataset"), F.lit(1).alias("unit"), F.col("id").alias("cycle"), (F.col("id") % 7).cast("double").alias("s"))
    got = frames.sliding_features(df, ["s"], 20_000)
    assert got.count() == 501
    assert got.where("cycle = 20000").first()["s_mean"] == pytest.approx(sum(i % 7 for i in range(1, 20_001)) / 20_000)


def test_shares_count_rows(spark):
    df = trajectory(spark, range(10, 250, 10)).withColumn("s", F.col("cycle").cast("double"))
    r = claims.share_rising(df, ["s"]).first()
    assert (r["units"], r["rising_life"], r["rising_15"], r["rising_30"]) == (1, 1.0, 1.0, None)


def test_a_quota_above_a_thousand(spark):
    df = spark.range(9_000).select((F.col("id") % 2).alias("g"), "id")
    got = sampling.stratified_sample(df, "g", ["id"], {0: 2_000, 1: 10}, shuffle_ids=False).groupBy("g").count()
    assert {r["g"]: r["count"] for r in got.collect()} == {0: 2_000, 1: 10}


def test_undefined_metrics_do_not_win(spark):
    runs = spark.createDataFrame([("D", "a", None, 1), ("D", "b", 0.5, 2), ("D", "c", 0.7, 3)], "dataset string, config string, rho double, k long")
    assert metrics.select_best(runs, ["dataset"], ["rho"], "config").first()["config"] == "b"
    spread = metrics.grid_spread(runs, ["dataset"], "k", [1, 2, 3], "rho").first()
    assert (spread["best"], spread["worst"]) == (2, 3)


def test_chance_agreement_on_shared_units(spark):
    rows = [("D", u, "a", float(v)) for u, v in enumerate((1, 1, 2, 2))] + [("D", u, "b", 1.0) for u in (0, 1)]
    df = spark.createDataFrame(rows, "dataset string, unit long, run string, pred double")
    r = metrics.run_agreement(df, ["a", "b"]).first()
    assert (r["units"], r["observed_pct"], r["chance_pct"], r["excess_pct"]) == (2, 100.0, 100.0, 0.0)


def test_strata_without_a_sample_are_reported(spark):
    corpus = spark.createDataFrame([("a",), ("b",), ("b",)], "s string")
    sample = spark.createDataFrame([("a", True)], "s string, ok boolean")
    weights = validate.stratum_weights(sample, corpus, "s")
    got = {r["s"]: r for r in validate.corpus_accuracy(sample, weights, "s", F.col("ok")).collect()}
    assert (got["ALL"]["corpus"], got["ALL"]["accuracy_pct"]) == (3, 100.0)
    assert (got["b"]["sampled"], got["b"]["corpus"], got["b"]["accuracy_pct"]) == (0, 2, None)


def test_phrases_by_their_rarest_word(spark):
    texts = ["the cat sat on the mat", "concatenate", "", None, "on the", "ab", "cat sat on"] * 3
    corpus = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    phrases = ["cat sat on", "sat", "at", "a", "the cat", "on the mat", "nowhere to be", "sat  on", "catena"]
    got = validate.phrase_audit(spark.createDataFrame([(p,) for p in phrases], "phrase string"), corpus, "i", "text")
    want = {p: sum(p in t for t in texts if t is not None) for p in phrases}
    assert {r["phrase"]: r["texts"] for r in got.collect()} == want


def test_phrases_in_one_long_text(spark):
    """Letter sequences of a text are cut in one scan: by position, a text of this length takes minutes."""
    text = "".join(chr(97 + i * i % 23) + ("😀" if i % 1000 == 0 else " " if i % 7 == 0 else "") for i in range(400_000)) + "zebra 7"
    corpus = spark.createDataFrame([(1, text), (2, "no 😀zeb"), (3, "")], "i long, text string")
    begin = time.monotonic()
    got = validate.phrase_audit(spark.createDataFrame([(p,) for p in ("bra 7", "zebra", "a😀", "q😀zeb", "😀zeb")], "phrase string"), corpus, "i", "text")
    want = {p: sum(p in t for t in (text, "no 😀zeb")) for p in ("bra 7", "zebra", "a😀", "q😀zeb", "😀zeb")}
    assert {r["phrase"]: r["texts"] for r in got.collect()} == want
    assert time.monotonic() - begin < 30
