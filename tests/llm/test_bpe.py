import hashlib

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wearline.llm import bpe, queries, tokenizers
from wearline.llm.common import table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(tokenizers.content())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ALPHABET = "aaabehtinos  '\n\t.,!?dlmrsvé1234ßØ日本🙂 ‍\x00"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=60), st.text(max_size=30)))
def test_equals_the_library(library, vocab, text):
    text = text.encode("utf-8", "replace").decode()
    want = library.encode(text, add_special_tokens=False).ids
    assert next(vocab.encode([text])) == want
    assert vocab.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize(
    "text",
    ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|>\n", "!!<|endoftext|>!! <|endof", "aaaa" * 5000, "x" * 9999],
)
def test_special_strings_and_long_words(library, vocab, text):
    assert next(vocab.encode([text])) == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    small = bpe.Vocabulary(tokenizers.content())
    for text in ("one two three", "four five six seven eight nine ten", "one ten"):
        assert next(small.encode([text])) == library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, sf_dir, library):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = queries.QUERIES["op6_bpe_encode_decode"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_odd_rows(spark, docs_of, library):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "a b"), (4, "a b"), (5, "word " * 300_000)]
    docs = docs_of(rows).withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(-1))
    got = bpe.encode(docs, tokenizers.content(), decoded="back")
    assert [c for c in docs.columns if c not in ("ids",)] == [c for c in got.columns if c not in ("ids", "back")]
    found = sorted((r["doc_id"] or 0, len(r["ids"]), r["back"]) for r in got.collect())
    long = "word " * 300_000
    size = len(library.encode(long, add_special_tokens=False).ids)
    assert found == [(0, 2, "a b"), (1, 0, ""), (2, 0, ""), (4, 2, "a b"), (4, 2, "a b"), (5, size, long)]
    assert bpe.digests(docs.limit(0), tokenizers.content()).count() == 0
