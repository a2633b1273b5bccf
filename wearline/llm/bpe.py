"""Byte-pair encoding by one traversal of a trie of distinct words, and decoding.

In byte-pair encoding the last token of a prefix fixes the rest of its encoding:
encode(p) is encode(p without its last token) followed by that token. The last
token of p is the one token t that ends p and that no merge can join with the last
token of the rest. So a trie node needs only its last token, found from the nodes
above it, and every prefix that words share is encoded once.

Distinct words in byte order are the trie in depth-first order: the path from the
root to the present node is the stack of last tokens of the present word, and the
next word keeps the part of the stack that belongs to their common prefix.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers_import_this

WORDS_KEPT = 400_000
PAIRS_KEPT = 1_000_000
NEVER = 1 << 60
# fixed value: the splitting pattern of the vocabulary's library
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a byte-level tokenizer file, and encoders for words and texts.

    Memory is bounded: at most `WORDS_KEPT` encoded words and `PAIRS_KEPT` judged
    token pairs are remembered; beyond that the memory starts anew.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        names = byte_names()
        spell = {t: bytes(names[c] for c in t) for t in spec["model"]["vocab"]}
        ids = {spell[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = dict(zip(ids.values(), ids.keys(), strict=True))
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        # all tokens that end at a position, the longest first
        self.ends = ahocorasick.Automaton()
        for token, i in ids.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = ids[spell[left]], ids[spell[right]]
            self.rank.setdefault((a, b), r)
            self.halves.setdefault(ids[spell[left] + spell[right]], (a, b, r))
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        top = max(self.bytes_of) + 1
        self.size_of = [len(self.bytes_of.get(i, b"")) for i in range(top)]
        self.edges = [[self._edge(i, right) for i in range(top)] for right in (False, True)]
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = {s: (i,) for s, i in self.special.items()}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens at one edge of `token` while it is built, with the rank that absorbs each."""
        found, absorbed = [], NEVER
        while True:
            found.append((token, absorbed))
            if token not in self.halves:
                return found[::-1]
            a, b, absorbed = self.halves[token]
            token = b if right else a

    def stay_apart(self, a: int, b: int) -> bool:
        """Does encoding a's bytes followed by b's bytes give exactly [a, b]?"""
        key = a << 32 | b
        hit = self.apart.get(key)
        if hit is not None:
            return hit
        left, right = self.edges[1][a], self.edges[0][b]
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            # of equal ranks the leftmost pair is merged first
            if across < x_gone and across <= y_gone and across < NEVER:
                hit = False
                break
            if x_gone == y_gone == NEVER:
                hit = True
                break
            if x_gone <= y_gone:
                i += 1
            if y_gone <= x_gone:
                j += 1
        if len(self.apart) >= PAIRS_KEPT:
            self.apart.clear()
        self.apart[key] = hit
        return hit

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Encodings of distinct words in byte order, in that order."""
        out, last, path = [], b"", []
        apart, ends, size_of = self.apart, self.ends.iter, self.size_of
        for word in words:
            same, most = 0, min(len(word), len(last))
            if word[:most] == last[:most]:
                same = most
            else:
                while word[same] == last[same]:
                    same += 1
            del path[same:]
            done = same - 1
            for end, (t, n) in ends(word.decode("latin-1")):
                if end > done:
                    if n <= end:
                        u = path[end - n]
                        free = apart.get(u << 32 | t)
                        if not (self.stay_apart(u, t) if free is None else free):
                            continue
                    path.append(t)
                    done = end
            last, ids, at = word, [], len(word)
            while at:
                t = path[at - 1]
                ids.append(t)
                at -= size_of[t]
            ids.reverse()
            out.append(tuple(ids))
        return out

    def learn(self, words: set[str]) -> None:
        """Remember the encodings of all given words; new ones go through the trie together."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > WORDS_KEPT:
            self._forget()
            new = [w for w in words if w not in self.known]
        spelt = sorted((w.encode(), w) for w in new)
        self.known.update(zip((w for _, w in spelt), self.encode_words([b for b, _ in spelt]), strict=True))

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; a special token is a piece of its own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text; the distinct words of all of them share one trie."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        for words in pieces:
            yield list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(content: str) -> Vocabulary:
    """One vocabulary per worker and tokenizer file."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def encode(
    docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """All columns of `docs`, with the token ids of the whole text and, if named, the text they decode to.

    `tokenizer` is the content of a tokenizer file (byte-level pairs, bounded by its
    vocabulary). A null text counts as empty and has no ids. New columns replace
    columns of the same name. Bytes that are no UTF-8 decode to U+FFFD.
    """

    def add(vocab: Vocabulary, texts: list[str]) -> dict[str, pa.Array]:
        lists = list(vocab.encode(texts))
        out = {ids: pa.array(lists, pa.list_(pa.int32()))}
        if decoded:
            out[decoded] = pa.array([vocab.decode(x).decode("utf-8", "replace") for x in lists], pa.string())
        return out

    kinds = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    return _with_columns(docs, tokenizer, text, kinds, add)


def digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """All columns of `docs` with n_tokens, ids_sha256 and decoded_sha256 of the encoded whole text.

    The ids stay inside the task, so very long texts need no wide rows.
    """

    def add(vocab: Vocabulary, texts: list[str]) -> dict[str, pa.Array]:
        n, a, b = [], [], []
        for found in vocab.encode(texts):
            n.append(len(found))
            a.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
            b.append(hashlib.sha256(vocab.decode(found).decode("utf-8", "replace").encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}

    return _with_columns(
        docs, tokenizer, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, add
    )


def _with_columns(docs: DataFrame, tokenizer: str, text: str, kinds: dict[str, str], add) -> DataFrame:
    workers_import_this(docs.sparkSession)
    kept = [c for c in docs.columns if c not in kinds]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    for c, kind in kinds.items():
        source = source.withColumn(c, F.lit(None).cast(kind))
    schema = source.schema
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                new = add(vocab, [t or "" for t in part.column(at).to_pylist()])
                columns = [part.column(i) for i in range(len(kept))] + [new[c] for c in kinds]
                yield pa.record_batch(columns, [*kept, *kinds])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
