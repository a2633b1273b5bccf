import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from wearline.llm import langid, queries
from wearline.llm.common import table


def plain_phrases(text, training, block=langid.BLOCK):
    """Greedy longest matches against training text by plain substring search."""
    n = 0
    for s in range(0, len(text), block):
        part, i = text[s : s + block], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in training:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases_equal_substring_search():
    samples = [("a", ["the cat sat on the mat", "the bat"]), ("b", ["un chat noir et un rat"])]
    m = langid.Model(samples)
    folded = ["".join(map(chr, np.concatenate([langid.symbols(" " + t + " ") for t in x]))) for _, x in samples]
    for text in ("the cat", "un rat on a mat", "zzz", "mat the the et", "The  CAT!! sat" * 60, "x"):
        n, sizes, _ = m.phrases([text, "other"])
        plain = "".join(map(chr, langid.symbols(text)))
        assert sizes[0] == len(plain)
        assert n[0].tolist() == [plain_phrases(plain, f) for f in folded]


def scripts():
    """Words per language: eight alphabets of 20 to 35 letters, three scripts of 2,000 to 2,500, two of which share most."""
    rng = random.Random(8)
    letters = [c for c in map(chr, range(0x41, 0x600)) if c.isalpha() and c == c.lower()]
    alphabets = {f"a{i}": rng.sample(letters, rng.randint(20, 35)) for i in range(8)}
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    alphabets |= {"ja": signs[:1800] + [chr(c) for c in range(0x3041, 0x3097)], "zh": signs[500:3000]}
    alphabets["ko"] = [chr(c) for c in range(0xAC00, 0xAC00 + 2000)]
    words = {}
    for name, own in alphabets.items():
        weights = [1 / (i + 3) for i in range(len(own))]
        words[name] = ["".join(rng.choices(own, weights, k=rng.randint(2, 7))) for _ in range(4000)]
    return rng, alphabets, words


def test_eleven_scripts(spark):
    rng, alphabets, words = scripts()
    made = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    rows = [(i, made(name, 120), name) for i, name in enumerate(sorted(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = langid.sample(docs.where("doc_id % 3 > 0"))
    m = langid.Model(learned)
    for (name, parts), alphabet in zip(learned, m.alphabets, strict=True):
        letters = {c for t in parts for c in t.lower() if c.isalpha()}
        assert all(alphabet.first[ord(c)] for c in letters) and alphabet.width <= langid.WIDTH
        codes = {tuple(alphabet.code(np.array([ord(c)], np.uint32)).tolist()) for c in letters}
        assert len(codes) == len(letters) and max(map(max, codes)) <= alphabet.width
    got = langid.identify(docs.where("doc_id % 3 = 0"), learned, known="known").collect()
    for name in words:
        right = [r["lang_pred"] == name for r in got if r["lang"] == name]
        assert len(right) >= 15 and sum(right) / len(right) >= 0.97, name
    assert min(r["known"] for r in got) > 0.5


def test_a_larger_alphabet_than_two_symbols_reach(monkeypatch):
    monkeypatch.setattr(langid, "WIDTH", 3)
    points = np.arange(1000, 1900, dtype=np.uint32)
    alphabet = langid.Alphabet(points)
    codes = {tuple(alphabet.code(points[i : i + 1]).tolist()) for i in range(900)}
    assert len(codes) == 900 and max(map(max, codes)) <= alphabet.width and min(map(min, codes)) > 0
    assert alphabet.code(points).tolist() == [x for i in range(900) for x in alphabet.code(points[i : i + 1]).tolist()]
    assert alphabet.code(np.array([5], np.uint32)).tolist() == [0]


def test_long_rows_are_learned_and_the_sample_is_bounded(spark, monkeypatch):
    _, _, words = scripts()
    rows = [(i, " ".join(words["a0"][:3000]) + f" {i}", "long") for i in range(40)]
    rows += [(100 + i, " ".join(words["a1"][i * 9 : i * 9 + 9]), "short") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = dict(langid.sample(docs))
    assert set(learned) == {"long", "short"}
    assert all(len(t) <= langid.ROW_CHARS for parts in learned.values() for t in parts)
    assert sum(map(len, learned["long"])) <= langid.LANGUAGE_CHARS + langid.ROW_CHARS


def test_unknown_scripts_have_no_known_letters(spark, docs_of):
    samples = [("en", ["the quick brown fox"]), ("fr", ["le renard brun"])]
    docs = docs_of([(1, "日本語"), (2, "quick 日本"), (3, None), (4, "12")])
    got = {r["doc_id"]: r["known"] for r in langid.identify(docs, samples, known="known").collect()}
    assert got[1] == got[3] == got[4] == 0 and got[2] == 5 / 8


def test_query_on_held_out_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert len(right) > 10 and sum(right) / len(right) >= 0.97


def test_odd_rows(spark, docs_of):
    samples = [("en", ["the quick brown fox"]), ("fr", ["le renard brun"])]
    rows = [(1, None), (2, ""), (3, "12 !!"), (None, "brown fox"), (5, "le renard"), (5, "le renard"), (6, "the " * 300_000)]
    docs = docs_of(rows).withColumn("score", F.lit("mine"))
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in langid.identify(docs, samples).collect())
    assert got == [
        (0, "en", True), (1, "und", False), (2, "und", False), (3, "und", False),
        (5, "fr", True), (5, "fr", True), (6, "en", True),
    ]
    assert {r["lang_pred"] for r in langid.identify(docs, []).collect()} == {"und"}
    assert langid.identify(docs.limit(0), samples).count() == 0
    assert langid.sample(docs.where("false")) == []
    assert langid.sample(docs.withColumn("lang", F.lit(None).cast("string"))) == []
