"""Steps that must not grow faster than their tables: one shuffle for small groups, one search of a text, one parse of a record."""

import json
import random

from pyspark.sql import functions as F

from wearline.functions import text as tx
from wearline.operators import claims as cl
from wearline.operators import ordering, rank
from wearline.plans import q_resample
from wearline.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def readings(spark):
    rng = random.Random(7)
    rows = []
    for unit in [*range(30), None]:
        for _ in range(rng.choice([1, 2, 9, 60])):
            x = rng.choice([None, float("nan"), -0.0, 0.0, *[float(rng.randint(0, 9)) for _ in range(20)]])
            rows.append((unit, x, rng.choice([None, *range(12)])))
    rows += [(99, 5.0, i) for i in range(8)]  # constant
    return spark.createDataFrame(rows, "unit int, x double, y int")


def test_many_small_groups_are_ranked_as_from_counts(spark, monkeypatch):
    df = readings(spark)
    want = {r.unit: (r.n, r.rho and round(r.rho, 9)) for r in rank.spearman(df, ["unit"], "x", "y").collect()}
    for busy in (ordering.BUSY, 20, 0):
        monkeypatch.setattr(ordering, "BUSY", busy)
        got = {r.unit: (r.n, r.rho and round(r.rho, 9)) for r in rank.spearman_of_many(df, ["unit"], "x", "y").collect()}
        assert got == want and None in got and got[99] == (8, None)


def test_sensor_correlations_shuffle_their_rows_once(spark):
    long = readings(spark).select(F.lit("D").alias("dataset"), F.lit("s").alias("sensor"), "unit", F.col("x").alias("reading"), F.col("y").alias("rul"))
    assert plan(cl.sensor_rank_correlation(long, "rul")).split("InMemoryRelation")[0].count("Exchange hashpartitioning") == 1


def test_only_busy_groups_are_split(spark):
    rows = [(u, i, i // 3) for u, size in ((1, 4), (2, 50), (None, 7)) for i in range(size)]
    df = spark.createDataFrame(rows, "u int, at int, part int")
    cut = ordering.split_busy(df, ["u"], F.col("part"), 10)
    assert {r.u: r.k for r in cut.groupBy("u").agg(F.count_distinct("_bucket").alias("k")).collect()} == {1: 0, 2: 17, None: 0}
    got = ordering.positions(cut, ["u"], ["at"], F.col("_bucket"), "pos", "total").collect()
    sizes = {1: 4, 2: 50, None: 7}
    assert sorted((str(r.u), r.at, r.pos, r.total) for r in got) == sorted((str(u), i, i + 1, sizes[u]) for u, i, _ in rows)


def test_claims_and_clauses_come_from_one_search(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "The end is the start; and so on."), (-1, None), (-1, "")], docs.schema)
    docs, terms = docs.unionByName(odd), q_resample.b.TERMS
    both = cl.classify_with_clauses(docs, ["doc_id"], "text", terms, q_resample.b.LEXICON, q_resample.OFF_TREND)
    said = cl.classify(docs, ["doc_id"], "text", terms, q_resample.b.LEXICON)
    clauses = cl.matched_clauses(docs, ["doc_id"], "text", terms, q_resample.OFF_TREND)
    assert sorted(map(str, both.select(*said.columns).collect())) == sorted(map(str, said.collect()))
    assert sorted(map(str, both.select(*clauses.columns).collect())) == sorted(map(str, clauses.collect()))
    searches, search = [], tx.lefts_and_rights
    monkeypatch.setattr(tx, "lefts_and_rights", lambda *a: searches.append(a) or search(*a))
    q_resample._sets(spark, sf_dir)
    assert len(searches) == 1


def test_records_are_parsed_once_and_stay_where_they_are_read(spark, tmp_path):
    rows = [{"engine_id": i, "true_rul": 2.0 * i, "pred_rul": 1.0 * i, "reasoning": f'a "b" \\{"}" if i % 50 == 0 else "{"}'} for i in range(300)]
    (tmp_path / "traces_FD001_few_shot_k3_n15.json").write_text(json.dumps(rows))
    got = files.read_traces(spark, str(tmp_path)).select("k", "n_cycles", "unit", "pred", "truth", "text")
    shown = plan(got).split("InMemoryRelation")[0]
    assert plan(got).count("from_json(") == 1
    assert "Exchange" not in shown
    assert sorted((r.unit, r.truth, r.pred, r.text, r.k, r.n_cycles) for r in got.collect()) == [
        (r["engine_id"], r["true_rul"], r["pred_rul"], r["reasoning"], 3, 15) for r in rows
    ]
