import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from wearline.llm import omh, queries
from wearline.llm.common import mixed, table


def mix(x):
    return int(mixed(np.array([x % (1 << 64)], np.uint64))[0])


def plain(text, k=omh.K):
    """The same definition with dictionaries and sorted lists."""
    codes = list(map(ord, text))
    if 0 < len(codes) < k:
        codes += [omh.FILLER] * (k - len(codes))
    seen, bins = {}, {}
    for i in range(len(codes) - k + 1):
        h = codes[i]
        for c in codes[i + 1 : i + k]:
            h = (h * 0x100000001B3 + c) % (1 << 64)
        kmer = mix(h) >> 32
        n = seen[kmer] = seen.get(kmer, -1) + 1
        f = mix((kmer << 31) + n * 0x9E3779B97F4A7C15)
        bins.setdefault(f % omh.BINS, []).append((f >> (64 - omh.VALUE_BITS), i, f))
    out = [0] * omh.BINS
    for b, found in bins.items():
        value = 0
        picked = [f for _, _, f in sorted(sorted(found)[: omh.TUPLE], key=lambda x: x[1])]
        for j, f in enumerate(picked + [0] * (omh.TUPLE - len(picked))):
            value = mix(value * 0x9FB21C651E98DF25 + f + j + 1)
        out[b] = value % 65535 + 1
    return "".join(f"{x:04x}" for x in out)


def test_signatures_equal_the_plain_definition():
    rng = random.Random(2)
    texts = ["", "a", "abcde", "abcdef", "ab" * 300, "é🙂日本語テキスト" * 9]
    texts += ["".join(rng.choices("abc d", k=rng.randint(0, 400))) for _ in range(30)]
    got = omh.spelled(omh.signatures([omh.code_points(t) for t in texts]))
    assert got == [plain(t) for t in texts]
    for t, g in zip(texts, got, strict=True):
        assert omh.spelled(omh.signatures([omh.code_points(t)])) == [g]


def test_order_matters_more_than_content():
    rng = random.Random(3)
    a, b = ("".join(rng.choices("abcdefgh ", k=2000)) for _ in range(2))
    swapped, typo = b + a, (a + b).replace("a", "x", 3)
    s = omh.signatures([omh.code_points(t) for t in (a + b, swapped, typo, b[::-1] + a[::-1])])
    near = [float(omh.likeness(s[:1], s[i : i + 1])[0]) for i in (1, 2, 3)]
    assert near[1] > 0.85 > near[0] > near[2] and near[2] < 0.1


def expected(rows):
    """Rows (id, text) by the contract; ids descending, null last, ties by a hash of the text."""
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        e = omh.edited(t, following)
        s = omh.signatures([omh.code_points(x) for x in (t, e, following)])
        like = [float(omh.likeness(s[:1], s[j : j + 1])[0]) for j in (1, 2)]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *omh.spelled(s[:2]), *like))
    return out


def test_query_equals_a_plain_walk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    want = expected([(r["doc_id"], r["text"] or "") for r in rows])
    got = queries.QUERIES["op4_order_minhash"](spark, sf_dir).orderBy(F.desc("doc_id")).collect()
    assert [tuple(r) for r in got] == want


def test_odd_rows(spark, docs_of):
    rows = [(9, "x" * 50), (9, "x" * 50), (7, None), (5, "long text " * 150_000), (3, ""), (2, "ab"), (None, "none of it")]
    docs = docs_of(rows, 2).withColumn("tie", F.lit("x")).withColumn("part", F.lit(1))
    got = sorted(map(tuple, omh.edit_test(docs).collect()), key=repr)
    assert got == sorted(expected([(i, t or "") for i, t in rows]), key=repr)
    one = omh.edit_test(docs.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert omh.edit_test(docs.limit(0)).count() == 0
    assert omh.fingerprints(docs).where("fingerprint is null").count() == 0
