"""Token counts that follow edits, on segment trees over the pre-tokens of each document.

A tree's leaves are short runs of pre-tokens with their characters and tokens; inner
nodes hold the sums. An edit descends to the leaves it touches, re-reads and
re-encodes those and as much context as can change with them, and updates the sums
on the way up. Everything else keeps its counts unread: a pre-token depends only on
the text from its own beginning to a few characters beyond its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, slices, vocabulary
from .common import workers_import_this

#: Pre-tokens of a leaf.
LEAF = 48
#: A pre-token's end depends on at most this many characters behind it.
AHEAD = 3


class CountTree:
    """Sums of (characters, tokens) over leaves; leaf i is node `size + i` of a complete binary tree."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = max(1, len(chars))
        self.size = 1
        while self.size < self.leaves:
            self.size *= 2
        self.chars = [0] * self.size + chars + [0] * (self.size - len(chars))
        self.tokens = [0] * self.size + tokens + [0] * (self.size - len(tokens))
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; the last leaf for the end."""
        if offset >= self.chars[1]:
            last = max((i for i in range(self.leaves) if self.chars[self.size + i]), default=0)
            return last, self.chars[1] - self.chars[self.size + last]
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if offset - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def columns(self) -> tuple[list[int], list[int]]:
        part = slice(self.size, self.size + self.leaves)
        return self.chars[part], self.tokens[part]


def leaves_of(vocab: Vocabulary, pieces: list[str]) -> tuple[list[int], list[int]]:
    """Characters and tokens of consecutive leaves; the pieces must have been learned."""
    known, chars, tokens = vocab.known, [], []
    for i in range(0, len(pieces), LEAF):
        part = pieces[i : i + LEAF]
        chars.append(sum(map(len, part)))
        tokens.append(sum(len(known[p]) for p in part))
    return chars, tokens


def whole(vocab: Vocabulary, text: str) -> CountTree:
    pieces = vocab.pieces(text)
    vocab.learn(set(pieces))
    return CountTree(*leaves_of(vocab, pieces))


def edit(vocab: Vocabulary, text: str, tree: CountTree, start: int, length: int, insert: str) -> tuple[str, CountTree, int]:
    """Replace `length` characters from `start`: the new text, its tree, and the characters re-encoded.

    Ranges beyond the text are cut to it. Where a special token is in the old or
    the new text, the text is counted anew, since such a token splits it first.
    """
    start = min(max(start, 0), len(text))
    length = min(max(length, 0), len(text) - start)
    changed = text[:start] + insert + text[start + length :]
    if any(s in text or s in changed for s in vocab.special):
        return changed, whole(vocab, changed), len(changed)
    # the first leaf whose beginning cannot move
    a, begin = tree.find(start)
    while a and start - begin < AHEAD:
        a, begin = tree.find(begin - 1)
    b, last = tree.find(max(start, start + length - 1))
    if b < a:
        b, last = a, begin
    grown = len(insert) - length
    while True:
        end = last + tree.chars[tree.size + b]
        following = end + AHEAD
        c = b
        while True:  # context behind the leaves: at least AHEAD characters and a whole leaf
            nxt, at = tree.find(end) if c == b else tree.find(beyond)
            beyond = at + tree.chars[tree.size + nxt] if end < len(text) else end
            if beyond >= min(following, len(text)) or nxt <= c:
                break
            c = nxt
        pieces = vocab.pattern.findall(changed[begin : beyond + grown])
        region, n = [], begin
        for p in pieces:
            if n >= end + grown:
                break
            region.append(p)
            n += len(p)
        if n == end + grown:
            break
        b, last = tree.find(end)
    vocab.learn(set(region))
    chars, tokens = leaves_of(vocab, region)
    if len(chars) <= b - a + 1:
        room = b - a + 1 - len(chars)
        for i, (x, y) in enumerate(zip(chars + [0] * room, tokens + [0] * room, strict=True)):
            tree.put(a + i, x, y)
    else:
        old = tree.columns()
        tree = CountTree(*(o[:a] + new + o[b + 1 :] for o, new in zip(old, (chars, tokens), strict=True)))
    return changed, tree, n - begin


_TREE = ("leaf_chars", "leaf_tokens", "n_tokens")


def trees(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """All columns of `docs` with the tree of the whole text: leaf_chars, leaf_tokens, n_tokens.

    Inner sums are cheap and rebuilt on reading. A null text counts as empty. New
    columns replace columns of the same name.
    """
    workers_import_this(docs.sparkSession)
    kept = [c for c in docs.columns if c not in _TREE]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    empty = F.array().cast("array<int>")
    schema = source.withColumns({"leaf_chars": empty, "leaf_tokens": empty, "n_tokens": F.lit(0).cast("long")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                pieces = [vocab.pieces(t or "") for t in part.column(at).to_pylist()]
                vocab.learn(set().union(*pieces))
                leaves = [leaves_of(vocab, p) for p in pieces]
                yield pa.record_batch(
                    [part.column(i) for i in range(len(kept))]
                    + [pa.array([x[i] for x in leaves], pa.list_(pa.int32())) for i in (0, 1)]
                    + [pa.array([sum(x[1]) for x in leaves], pa.int64())],
                    [*kept, *_TREE],
                )

    return source.mapInArrow(run, schema)


def apply_edits(grown: DataFrame, tokenizer: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Texts and trees after the edits of each row, and `n_reread`, the characters re-encoded for them.

    `edits` is an array of (start, length, insert), applied in order, each to the
    text as the earlier ones left it; a null array, field or text changes nothing
    or counts as zero or empty.
    """
    workers_import_this(grown.sparkSession)
    names = [c for c in grown.columns if c not in (*_TREE, text, "n_reread", edits)]
    source = grown.select(*[F.col(f"`{c}`") for c in names], text, *_TREE, edits)
    schema = source.drop(edits).withColumn("n_reread", F.lit(0).cast("long")).schema
    shared = grown.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            for part in slices(batch, len(names)):
                out = []
                columns = [part.column(i).to_pylist() for i in range(len(names), len(names) + 5)]
                for now, chars, tokens, _, wanted in zip(*columns, strict=True):
                    now, tree, reread = now or "", CountTree(chars or [], tokens or []), 0
                    for e in wanted or []:
                        if e is not None:
                            args = (e["start"] or 0, e["length"] or 0, e["insert"] or "")
                            now, tree, n = edit(vocab, now, tree, *args)
                            reread += n
                    out.append((now, *tree.columns(), tree.tokens[1], reread))
                text_, chars, tokens, n, reread = zip(*out, strict=True)
                yield pa.record_batch(
                    [part.column(i) for i in range(len(names))]
                    + [
                        pa.array(text_, pa.string()),
                        pa.array(chars, pa.list_(pa.int32())),
                        pa.array(tokens, pa.list_(pa.int32())),
                        pa.array(n, pa.int64()),
                        pa.array(reread, pa.int64()),
                    ],
                    [*names, text, *_TREE, "n_reread"],
                )

    return source.mapInArrow(run, schema)
