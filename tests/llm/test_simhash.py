import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from wearline.llm import queries, simhash
from wearline.llm.common import table
from wearline.llm.components import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    ids = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and ids[i] != ids[j]:
                a, b = ids[i], ids[j]
                ids = [a if x == b else x for x in ids]
    return ids


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius in (1, 3, 5, 7, 9):
        tables = simhash.masks(list(range(64)), radius)
        for _ in range(2000):
            x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(x & m == 0 for m in tables)


def test_fingerprint_over_block_borders(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    for n in range(23):
        text = " ".join(f"W{i % 7}" for i in range(n))
        assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_simhash_near_dedup"](spark, sf_dir).collect()}
    prints = [plain_print(r["text"]) for r in rows]
    group = plain_components(prints)
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, 1 << 60), r["doc_id"])
    assert len(got) == len(rows)
    for r, p, g in zip(rows, prints, group, strict=True):
        assert got[r["doc_id"]]["fingerprint"] == f"{p:016x}"
        assert got[r["doc_id"]]["component_id"] == least[g]


@pytest.mark.parametrize(("radius", "bucket"), [(3, 8), (7, 60), (3, 2048)])
def test_full_buckets_are_split_and_stay_exact(spark, radius, bucket):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    prints = {s for s in seeds}
    while len(prints) < 200:
        x = rng.choice(seeds)
        for b in rng.sample(range(64), rng.randint(1, 9)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df, radius, bucket)).collect()}
    group = plain_components(prints, radius)
    for i, p in enumerate(prints):
        same = {q for j, q in enumerate(prints) if group[j] == group[i]}
        assert (len(same) == 1 and p not in roots) or {q for q in prints if roots.get(q, q) == roots[p]} == same


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b"), (5, "a b"), (5, "a b"), (6, "x " * 200_000)]
    docs = docs_of(rows).withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, False, 5), (1, True, 1), (2, True, 1), (3, True, 1), (5, False, 5), (5, False, 5), (6, False, 6)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_chain_is_one_component(spark):
    links = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 900)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1000] == got[900] == 900
