import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wearline.llm import pieces, queries
from wearline.llm.common import table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocab():
    return pieces.Pieces(pieces.content())


ALPHABET = "aaabehtinos   ▁'\n\t.,!?dlmrsvé1²34ßØ日本🙂‍\x00�̀"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=60), st.text(max_size=30)))
def test_equals_the_library(library, vocab, text):
    text = text.encode("utf-8", "replace").decode()
    want = library.encode(text, add_bos=True, add_eos=True)
    (got,) = vocab.encode([text])
    assert got.tolist() == want
    assert vocab.spell(got).decode() == vocab.decode(want) == library.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300), st.sampled_from([259, 28705, 200, 131, 2]))))
def test_any_ids_decode_as_in_the_library(library, vocab, ids):
    assert vocab.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 5_001, "<s></s><unk><0x0A>", "ab " * 9_999, "é" * 7_777 + "\n" * 999])
def test_long_segments_and_names_of_control_pieces(library, vocab, text, monkeypatch):
    monkeypatch.setattr(pieces, "IDS_AT_ONCE", 100)
    (got,) = vocab.encode([text])
    assert got.tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert vocab.spell(got).decode() == text


def test_whole_texts_and_coarser_segments_give_the_same(library, vocab):
    text = "one two,three\n\n  four.²five 66"
    want = library.encode(text)
    for cut in pieces.CUTS:
        assert [i for s in cut.findall("▁" + text.replace(" ", "▁")) for i in vocab.ids(s)] == want


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS_KEPT", 4)
    monkeypatch.setattr(pieces, "LONGEST_KEPT", 5)
    small = pieces.Pieces(pieces.content())
    for text in ("one two three", "four five six sevenfold eight nine ten", "one ten", "seventeen two"):
        (got,) = small.encode([text], begin=False, end=False)
        assert got.tolist() == library.encode(text)
        assert len(small.known) <= 12


def test_a_difference_from_the_library_is_an_error(monkeypatch):
    wrong = pieces.Pieces(pieces.content())
    monkeypatch.setattr(wrong, "merged", list)
    with pytest.raises(ValueError, match="differ"):
        list(wrong.encode(["there"]))


def model(kind=2, extra=b"", normal=b"\x18\x01\x20\x00"):
    def message(field, value):
        return bytes([field << 3 | 2, len(value)]) + value

    unknown = message(1, message(1, b"<unk>") + b"\x18\x02")
    letter = message(1, message(1, b"a") + b"\x15" + struct.pack("<f", -1.0))
    return unknown + letter + extra + message(2, bytes([3 << 3, kind])) + message(3, normal)


def test_other_models_are_refused():
    assert pieces.fields(model()) and model()
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Pieces(model(kind=1))
    with pytest.raises(ValueError, match="as it is"):
        pieces.Pieces(model(normal=b"\x20\x01"))
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Pieces(model(extra=b"\x0a\x05\x0a\x01b\x18\x04"))


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_query_equals_the_library(spark, sf_dir, library):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = queries.QUERIES["op13_sentencepiece_encode_decode"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == sha(library.decode(ids).encode())


def test_odd_rows(spark, docs_of, library):
    long = "wörd " * 100_000 + "x" * 50_000
    rows = [(1, None), (2, ""), (None, "a b"), (4, "a b"), (4, "a b"), (5, long)]
    docs = docs_of(rows).withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(-1)).withColumn("_of", F.lit(0))
    coded = pieces.encode(docs, pieces.content())
    assert [c for c in docs.columns if c != "ids"] + ["ids"] == coded.columns
    back = pieces.decode(coded.withColumn("decoded", F.lit(1)), pieces.content())
    found = sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in back.collect())
    size = len(library.encode(long)) + 2
    assert found == [(0, 4, "a b"), (1, 2, ""), (2, 2, ""), (4, 4, "a b"), (4, 4, "a b"), (5, size, long)]
    plain = pieces.encode(docs, pieces.content(), begin=False, end=False).where("doc_id < 3")
    assert [len(r["ids"]) for r in plain.collect()] == [0, 0]
    none = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert sorted((r["k"], r["decoded"]) for r in pieces.decode(none, pieces.content()).collect()) == [(1, None), (2, "")]
    assert pieces.digests(docs.limit(0), pieces.content()).count() == 0
