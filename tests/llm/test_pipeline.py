import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from wearline.llm import langid, mixing

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    bases = [made(rng, 150) for _ in range(25)]
    out = []
    for i, b in enumerate(bases * 3):
        words = b.split(" ")
        if i >= 25:
            words[rng.randrange(150)] = "changed"
        text = "\n".join([" ".join(words[:70]), "All rights reserved here", " ".join(words[70:])])
        out.append((i, text, "en", f"s{i % 6}", len(text)))
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "123 !?", None, "s2", 6)]
    out += [(103, "All rights reserved here", "en", "s3", 24), (104, made(rng, 60), None, None, 1), (None, made(rng, 50), "en", "s9", 1)]
    out += [(105, out[7][1], "en", "s1", 1), (105, out[7][1], "en", "s1", 1)]
    return out


def brute_force(rows):
    """Every stage by plain loops, from the operators' definitions."""
    samples = [("en", [r[1] for r in rows if r[2] == "en" and re.search("[a-z]", r[1])])]
    docs = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    assert set(langid.Model(samples).predict([r[1] for r in docs])[0]) == {"en"}
    docs = [(r[0], r[1], "en", r[3]) for r in docs]
    sites, texts = {}, {}
    for _, text, _, site in docs:
        for x in text.split("\n"):
            sites.setdefault(x, set()).add(site)
            texts.setdefault(x, set()).add(text)
    clean = []
    for i, text, lang, site in docs:
        kept = [x for x in text.split("\n") if len(sites[x]) < 5 or len(texts[x]) < 2]
        new = "\n".join(kept)
        if new == text or re.search(WORD, new):
            clean.append((i, new, lang, site))
    clean = sorted(set(clean), key=lambda r: (r[0] is None, r[0] or 0))
    words = [re.findall(WORD, r[1].lower()) for r in clean]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(clean)))
    for i in range(len(clean)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return [r for i, r in enumerate(clean) if group.index(group[i]) == i]


def test_stages_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("_id", F.lit("x"))
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, "").cache()
        assert sorted(docs.columns) == sorted(pipeline.COLUMNS)
    want = brute_force(rows)
    got = {(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()}
    assert got == set(want) and docs.count() == len(want) and len(want) < 40
    sizes = Counter()
    for _, text, _, source in want:
        sizes[source] += len(re.findall(WORD, text))
    mix = pipeline.mixed(spark, docs, "").cache()
    took, copies = Counter(), Counter()
    for r in mix.collect():
        took[r["source"]] += len(re.findall(WORD, r["text"]))
        copies[r["doc_id"]] += 1
    aims = mixing.targets(docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("source_size")))
    for a in aims.collect():
        assert a["source_size"] == sizes[a["source"]] and abs(took[a["source"]] - a["target"]) <= 150
    assert max(copies.values()) <= 3 and set(copies) <= {r[0] for r in want}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in want}
    last = pipeline.encoded(spark, mix, "").collect()
    assert len(last) == mix.count()
    for r in last:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_unknown_scripts_go_and_clean_texts_stay(spark):
    rows = [(i, f"plain words in number {i}", "en", "s", 1) for i in range(20)]
    rows += [(50, "日本語の文", "en", "s", 1), (51, "日本 words", None, "s", 1)]
    rows = rows[:-2] + [(50, "日本語の文", None, "s", 1), rows[-1]]
    got = pipeline.known_language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in got.collect()} == {*range(20), 51}


def test_rows_that_differ_in_other_columns_only(spark):
    """Reruns agree on which of them stays, and very long texts go through all stages."""
    long = "word " + " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "same text of five words", lang, s, 1) for lang in ("en", "fr") for s in ("a", "b", None)] + [(2, long, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for stage in (pipeline.one_of_each_group, pipeline.mixed):
        seen = [sorted(map(tuple, stage(spark, docs.repartition(n), "").collect()), key=repr) for n in (1, 3, 5)]
        assert seen[0] == seen[1] == seen[2]
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert {r["doc_id"]: r["n_tokens"] > 100_000 for r in docs.collect()}[2]


def test_whole_run(spark, sf_dir):
    got = pipeline.run(spark, sf_dir)
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert len(ids) > 50


def test_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
