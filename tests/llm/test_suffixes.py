import glob
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import queries, suffixes
from wearline.llm.common import table


def plain(rows):
    """First occurrence of every 100-byte string in a dictionary, documents in the given order."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            h = data[s : s + 100]
            if h in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(h)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_plain(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.QUERIES["op2_suffix_dedup"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain([tuple(r) for r in rows])


def digest(df):
    columns = ["doc_id", "n_bytes", "n_removed", F.size("starts").alias("s"), F.sha2("kept", 256).alias("k")]
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def chunk_count(spark):
    """Chunks of the last run, from the folder that staged tables are in."""
    folder = max(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/wearline-llm/wearline_*"), key=os.path.getmtime)
    return spark.read.parquet(folder).count()


def repeating(rng, letters, own, n):
    passages = ["".join(rng.choices(letters, k=rng.randint(80, 260))) for _ in range(8)] + [letters[:2] * 120, letters[-1] * 300]
    texts = []
    for _ in range(n):
        mine = ["".join(rng.choices(own, k=rng.randint(0, 150))) for _ in range(3)]
        texts.append("".join(x for pair in zip(mine, rng.choices(passages, k=3)) for x in pair))
    return texts


def test_small_chunks(spark, docs_of):
    texts = repeating(random.Random(11), "abc de", "pqrst uv", 60)
    texts += [None, "", "a" * 99, "a" * 100, "a" * 101, "\x00" * 205, "é" * 90, texts[3], texts[3] + "tail"]
    rows = list(enumerate(texts))
    docs = docs_of(rows, 5).withColumn("chunk", F.lit("x")).withColumn("part", F.lit(1))
    got = digest(suffixes.without_repeats(docs, chunk_bytes=600, piece=257))
    assert chunk_count(spark) > 30
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wearline_")]
    assert got == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_zero_bytes_inside_between_and_behind_passages(spark, docs_of, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("ab\0", k=rng.randint(90, 180))) for _ in range(6)]
    texts = []
    for _ in range(120):
        fields = [rng.choice([*passages, "".join(rng.choices("abcd", k=rng.randint(0, 60)))]) for _ in range(3)]
        texts.append("".join(f[: rng.choice([len(f), 110])].ljust(rng.choice([0, 120, 200]), "\0") for f in fields))
    rows = list(enumerate(texts))
    got = digest(suffixes.without_repeats(docs_of(rows, 4), chunk_bytes=2_000))
    assert chunk_count(spark) > 20
    assert got == sorted(plain(rows), key=repr)


def test_odd_rows(spark, docs_of):
    text = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = [(1, text), (1, text), (None, text + "!"), (2, "word " * 250_000)]
    got = digest(suffixes.without_repeats(docs_of(rows)))
    assert [r[:4] for r in got] == [(1, 150, 0, 0), (1, 150, 150, 1), (2, 1_250_000, 1_250_000 - 5, 1), (None, 151, 150, 1)]
    assert suffixes.without_repeats(docs_of(rows).limit(0)).count() == 0


def test_merge_equals_sorting():
    rng = random.Random(5)
    for count in [1, 2, 3, 7] * 30:
        runs = [sorted("".join(rng.choices("\1\2", k=rng.randint(1, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(count)]
        coded = []
        for run in runs:
            rows = np.zeros((len(run), suffixes.LENGTH), np.uint8)
            for i, s in enumerate(run):
                rows[i, : len(s)] = list(s)
            sizes = np.array([len(s) for s in run], np.int64)
            coded.append([*suffixes._front_coded(rows, sizes)])
        at, merged = [0] * count, []
        for run, shared in suffixes.merge([suffixes._suffixes(c) for c in coded]):
            now = runs[run][at[run]].ljust(suffixes.LENGTH, b"\0")
            at[run] += 1
            if merged:
                assert all(now[i] == merged[-1][i] for i in range(shared))
                assert shared == suffixes.LENGTH or now[shared] != merged[-1][shared] or shared <= 12
            merged.append(now)
        assert merged == sorted(s.ljust(suffixes.LENGTH, b"\0") for run in runs for s in run)
