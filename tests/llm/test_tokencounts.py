import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wearline.llm import bpe, queries, tokencounts, tokenizers
from wearline.llm.common import table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(tokenizers.content())


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("leaf", [1, 2, 48])
def test_random_edits_equal_counting_anew(library, vocab, leaf, monkeypatch):
    monkeypatch.setattr(tokencounts, "LEAF", leaf)
    rng = random.Random(leaf)
    alphabet = "ab c'ldsmtrve 12\n\t .,!é🙂  "
    for _ in range(120):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 120)))
        tree = tokencounts.whole(vocab, text)
        for _ in range(6):
            start, length = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 40, 500])
            insert = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 9, 60])))
            if rng.random() < 0.04:
                insert += "<|endoftext|>"
            want = text[:start] + insert + text[start + length :]
            text, tree, _ = tokencounts.edit(vocab, text, tree, start, length, insert)
            chars, tokens = tree.columns()
            assert text == want and sum(chars) == len(text)
            assert sum(tokens) == tree.tokens[1] == count(library, text)


def test_small_edits_read_little(vocab):
    text = "some words in a row and more " * 4000
    tree = tokencounts.whole(vocab, text)
    for start in (0, 50_000, len(text) - 1):
        text, tree, n = tokencounts.edit(vocab, text, tree, start, 3, "new")
        assert n < 1500


def test_query_equals_the_library(spark, sf_dir, library):
    rows = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    got = queries.QUERIES["op7_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        t, source = rows[r["doc_id"]]["text"] or "", rows[r["doc_id"]]["source"] or ""
        n = len(t)
        assert r["n_tokens_before"] == count(library, t)
        for start, length, insert in ((n // 3, 12, " revised "), (n * 2 // 3, 0, source), (max(n - 5, 0), 5, "")):
            t = t[:start] + insert + t[start + length :]
        assert r["n_tokens_after"] == count(library, t)


def test_odd_rows(spark, docs_of, library):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "a b"), (4, "a b"), (5, "word " * 300_000)]
    edit = "array(named_struct('start', 1L, 'length', 1L, 'insert', cast(null as string)), null)"
    docs = docs_of(rows).withColumn("n_tokens", F.lit("x")).withColumn("edits", F.expr(edit)).withColumn("leaf_chars", F.lit(1))
    got = tokencounts.apply_edits(tokencounts.trees(docs, tokenizers.content()), tokenizers.content()).collect()
    for r in got:
        assert r["n_tokens"] == count(library, r["text"]) == sum(r["leaf_tokens"])
    assert sorted(len(r["text"]) for r in got) == [0, 0, 2, 2, 2, 1_499_999]
    none = tokencounts.trees(docs.withColumn("edits", F.lit(None).cast(docs.schema["edits"].dataType)), tokenizers.content())
    assert tokencounts.apply_edits(none, tokenizers.content()).agg(F.sum("n_reread")).first()[0] == 0
    assert tokencounts.trees(docs.limit(0), tokenizers.content()).count() == 0
