import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tools.check import compare, connect
from wearline.llm import lines, queries


def plain(rows, min_sites):
    sites, texts = {}, {}
    for _, text, site in rows:
        for x in text.split("\n") if text is not None else []:
            if x.strip(" "):
                sites.setdefault(x, set()).add(site)
                texts.setdefault(x, set()).add(text)
    out = {x for x, s in sites.items() if len(s) >= min_sites and (len(texts[x]) > 1 or min_sites <= 1)}
    done = []
    for i, text, _ in rows:
        if text is None:
            done.append((i, None, 0))
            continue
        kept = [x for x in text.split("\n") if x not in out]
        done.append((i, "\n".join(kept), text.count("\n") + 1 - len(kept)))
    return sorted(done, key=repr)


def test_query_equals_sql(spark, sf_dir):
    got = queries.QUERIES["op8_line_dedup"](spark, sf_dir)
    assert compare(got, connect(sf_dir), queries.CHECKS["op8_line_dedup"]) == ""


def test_small_sketches_and_every_threshold(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(30)] + ["", "  ", "one", "two"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9))), f"s{rng.randint(0, 60)}") for i in range(300)]
    rows += [(7, None, "s1"), (None, "line 1\nmine", None), (8, "line 2", None), (8, "line 2", None), (9, "one\n" * 50_000, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(("h", "_doc", "_out", "_DOC_", "site", "copy", "line"))})
    for least, log_registers, zone in ((1, 11, 6.0), (2, 11, 6.0), (20, 4, 6.0), (38, 11, 3.0)):
        got = lines.without_boilerplate(
            docs, min_sites=least, removed="gone", log_registers=log_registers, zone=zone
        )
        assert got.columns == [*docs.columns, "gone"]
        found = sorted(((r["doc_id"], r["text"], r["gone"]) for r in got.collect()), key=repr)
        assert found == plain(rows, least)


def test_empty_table(spark, docs_of):
    docs = docs_of([(1, "a")])
    assert lines.without_boilerplate(docs.limit(0)).count() == 0
    assert lines.without_boilerplate(docs.withColumn("text", F.lit(None).cast("string"))).first()["text"] is None


MIRRORED = [(i, "one article\nfooter", s) for i, s in enumerate("abc")]
MIRRORED += [(i + 10, "another\nfooter", s) for i, s in enumerate("ade")]
MIRRORED += [(i + 20, "mirrored\nby many", s) for i, s in enumerate("abcdefg")]


def test_all_sites_of_mirrored_articles_count(spark):
    docs = spark.createDataFrame(MIRRORED, "doc_id long, text string, source string").repartition(3)
    got = lines.without_boilerplate(docs, removed="gone").collect()
    assert sorted(((r["doc_id"], r["text"], r["gone"]) for r in got), key=repr) == plain(MIRRORED, 5)
    assert {r["text"] for r in got} == {"one article", "another", "mirrored\nby many"}


def test_a_footer_of_articles_that_a_hot_site_mirrors(spark):
    """Every article is on its own site and on one whose name comes first."""
    rows = [(i, f"article {i}\nfooter", f"own{i}") for i in range(20)] + [(50 + i, f"article {i}\nfooter", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = lines.spread_lines(docs, min_sites=5).collect()
    assert [r["sites"] for r in found] == [21]
    assert {r["text"] for r in lines.without_boilerplate(docs).collect()} == {f"article {i}" for i in range(20)}


def test_all_sites_of_mirrored_articles_count_in_the_pipeline(spark):
    docs = spark.createDataFrame(MIRRORED, "doc_id long, text string, source string")
    docs = docs.selectExpr("doc_id", "text", "'en' lang", "source", "1L n_chars").repartition(3)
    got = {r["doc_id"]: r["text"] for r in pipeline.without_boilerplate(spark, docs, "").collect()}
    assert got == {i: t.removesuffix("\nfooter") for i, t, _ in MIRRORED}
