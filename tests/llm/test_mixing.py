from math import comb

import pytest
from pyspark.sql import functions as F

from tools.check import compare, connect
from wearline.llm import mixing, queries


def test_query_equals_sql(spark, sf_dir):
    got = queries.QUERIES["op10_mix_sources"](spark, sf_dir).cache()
    assert compare(got, connect(sf_dir), queries.CHECKS["op10_mix_sources"]) == ""
    for r in got.collect():
        assert r["taken"] <= 3 * r["size"]


def filled(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess by weight until no target is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        left, weight = total - sum(capped.values()), sum(w[n] for n in free)
        aim = {n: left * w[n] / weight for n in free}
        over = [n for n in free if aim[n] > most * sizes[n]]
        if not over:
            return capped | aim
        capped |= {n: most * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40, "é": 7}, {"x": 0, "y": 3}, {"z": 9}, {"p": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_hypergeometric_is_exact(spark):
    everyone, marked, drawn, n = 23, 9, 11, 4000
    u = (F.col("id") + 0.5) / n
    got = spark.range(n).select(mixing.hypergeometric(u, *[F.lit(x).cast("long") for x in (everyone, marked, drawn)]).alias("x"))
    counts = {r["x"]: r["count"] for r in got.groupBy("x").count().collect()}
    for x in range(10):
        p = comb(marked, x) * comb(everyone - marked, drawn - x) / comb(everyone, drawn)
        assert abs(counts.get(x, 0) - p * n) <= 2


def test_quotas_are_split_exactly(spark):
    quotas = {1: 1000, 2: 0, 3: 37, 4: 250_000}
    df = spark.createDataFrame(list(quotas.items()), "s int, quota long")
    got = mixing.split_quotas(df, 3).collect()
    for s, q in quotas.items():
        assert sum(r["n"] for r in got if r["s"] == s) == q
    per = [sum(r["n"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(per) - min(per) <= 1
    big = [r["n"] for r in got if r["s"] == 4]
    assert min(r["n"] for r in got) >= 0 and max(big) < 1.01 * min(big)


def test_draws_are_disjoint_and_near_the_target(spark):
    rows = [(i, 1 + (i * 37) % 1500, None if i % 3 == 0 else f"s{i % 7 % 4}") for i in range(900)] + [(900, 0, "s1")]
    docs = spark.createDataFrame(rows, "id long, size long, source string").withColumn("words", F.lit(1)).repartition(4)
    draws, aims = mixing.mix(docs, "id", "size", "source", block_words=100)
    found = draws.collect()
    assert len({(r["row"], r["block"], r["pass"]) for r in found}) == len(found)
    source = {i: s for i, _, s in rows}
    for a in aims.collect():
        took = sum(r["words"] for r in found if source[r["row"]] == a["source"])
        assert abs(took - a["target"]) <= 100
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(7), "id", "size", "source", block_words=100)[0].collect()))
    shards = [sum(r["shard"] == k for r in found) for k in range(8)]
    assert sum(shards) == len(found) and max(shards) - min(shards) <= 1


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "w " * 300_000)])
    sized = docs.withColumn("size", mixing.words(F.col("text"))).withColumn("s", F.lit("x")).withColumn("tie", F.xxhash64("text"))
    draws, aims = mixing.mix(sized, "doc_id", "size", "source", tie="tie")
    assert sum(r["source_size"] for r in aims.collect()) == 300_005
    assert draws.count() > 500
    none, empty = mixing.mix(sized.limit(0), "doc_id", "size", "source")
    assert none.count() == 0 and empty.count() == 0
