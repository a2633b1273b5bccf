import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wearline.llm import ngrams, queries
from wearline.llm.common import table


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), " end"]


class Plain:
    """The same model with dictionaries of tuples."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [Counter() for _ in range(order)]
        for t in texts:
            words = words_of(t)
            for k in range(order):
                for i, w in enumerate(words):
                    self.grams[k][self.context(words, i, k) + (w,)] += 1
        self.n, self.v = sum(self.grams[0].values()), len(self.grams[0])
        self.d, self.total, self.types = [0.0], defaultdict(int), defaultdict(int)
        for k in range(1, order):
            once, twice = (sum(c == x for c in self.grams[k].values()) for x in (1, 2))
            self.d.append(once / (once + 2 * twice) if once and twice else 0.5)
            for g, c in self.grams[k].items():
                self.total[k, g[:-1]] += c
                self.types[k, g[:-1]] += 1

    @staticmethod
    def context(words, i, k):
        return tuple(([" start"] + words)[max(0, i - k + 1) : i + 1]) if k else ()

    def base(self, w):
        return (self.grams[0][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, words, i):
        p = self.base(words[i])
        for k in range(1, self.order):
            c = self.context(words, i, k)
            if self.total[k, c]:
                seen = self.grams[k][c + (words[i],)]
                p = (max(seen - self.d[k], 0) + self.d[k] * self.types[k, c] * p) / self.total[k, c]
        return p

    def row(self, text):
        words = words_of(text)
        known = sum(self.grams[0][(w,)] > 0 for w in words)
        base = sum(math.log10(self.base(w)) for w in words)
        return len(words), known, self.n, base, sum(math.log10(self.p(words, i)) for i in range(len(words)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_small_chunks_of_any_order(spark, order, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_WORDS", 40)
    texts = ["a b a b a c", "A B c", "", None, "b", "c c c c c", "new a b", "a b c d e f g", "d e f x"] * 4 + ["a b " * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") % 3 != 1
    plain = Plain([t for i, t in enumerate(texts) if i % 3 != 1], order)
    got = {r["doc_id"]: r for r in ngrams.score(docs.withColumn("part", F.lit(1)), "doc_id", "text", learn, order).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == pytest.approx(plain.row(t), abs=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a", "b c", "a"], 3)
    seen = [w for (w,) in plain.grams[0]] + [" unknown"]
    for before in ([], ["a"], ["a", "b"], ["x", "b"]):
        assert sum(plain.p([*before, w], len(before)) for w in seen) == pytest.approx(1)


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    plain = Plain([t for i, t in rows.items() if not held[i]], 2)
    got = queries.QUERIES["op5_ngram_scores"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == held[r["doc_id"]]
        assert tuple(r)[2:] == pytest.approx(plain.row(rows[r["doc_id"]]), abs=1e-6)


def test_odd_rows(spark, docs_of):
    docs = docs_of([(None, "a b"), (2, "a b"), (2, "a b"), (3, None), (4, "w " * 900_000)])
    got = ngrams.score(docs, "doc_id", "text", F.col("doc_id").isNotNull()).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3, 3, 900_001]
    assert ngrams.score(docs.limit(0), "doc_id", "text", F.lit(True)).count() == 0
    untrained = ngrams.score(docs.where("doc_id = 2"), "doc_id", "text", F.lit(False)).first()
    assert untrained["score"] == untrained["base_score"] == 0.0 and untrained["n_known"] == 0
