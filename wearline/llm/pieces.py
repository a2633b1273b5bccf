"""SentencePiece encoding and decoding for merge-type vocabularies.

A text starts as its characters. An agenda holds every adjacent pair of symbols
whose concatenation is a piece, the best score first and the leftmost of equal
scores; the best pair is merged, its new neighbours enter the agenda, and pairs
whose symbols have changed since are passed over. Characters without a piece
become their bytes.

A merge gives a piece, so between two characters that are neighbours in no piece
nothing is ever merged. A text is cut where no piece of the vocabulary has such
neighbours (before space marks, mostly also between letters and other characters;
verified when the file is read), every distinct segment goes through the agenda
once, and what a worker has learned in an Arrow batch is compared with the
sentencepiece library before it is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import workers_import_this

#: Segments a worker remembers, and the longest of them, in characters.
SEGMENTS_KEPT = 500_000
LONGEST_KEPT = 100
#: Ids that are decoded in one step.
IDS_AT_ONCE = 1 << 18

# Fixed values of the file format: kinds of pieces and of models, field numbers, the space mark.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_TEXT, SPACE_SUFFIX = 3, 35, 44, 24
CHARACTER_MAP, DUMMY_PREFIX, FEWER_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
SPACE = "▁"

#: Ways to cut a text into segments, the finest first. Where a cut falls depends on two
#: neighbouring characters only, so a vocabulary none of whose pieces is cut has no merge across one.
CUTS = [
    regex.compile(pattern, regex.DOTALL)
    for pattern in (r"▁*\p{L}+|▁*[^\p{L}▁]+|▁+", r"▁*[^▁]+|▁+", r".+")
]


def content(path: str | None = None) -> bytes:
    """Content of a model file on the driver; by default the public one of 32k pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; nested messages stay bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[at : at + size]
        at += size


class Pieces:
    """Pieces and scores of a model file, and encoders for segments and texts."""

    def __init__(self, model: bytes):
        self.names: list[str] = []
        self.kinds: list[int] = []
        self.cost: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        settings: dict[int, dict] = {TRAINER: {}, NORMALIZER: {}}
        for field, value in fields(model):
            if field == PIECES:
                self._add(dict(fields(value)))
            elif field in settings:
                settings[field] = dict(fields(value))
        self._refuse(settings[TRAINER], settings[NORMALIZER])
        self.prefix = SPACE if settings[NORMALIZER].get(DUMMY_PREFIX, 1) else ""
        self.fallback = bool(settings[TRAINER].get(BYTE_FALLBACK, 0))
        self.unknown = self.kinds.index(UNKNOWN)
        shown = settings[TRAINER].get(UNKNOWN_TEXT, " ⁇ ".encode())
        self.bytes_of = [
            b"" if kind == CONTROL
            else shown if kind == UNKNOWN
            else bytes([int(name[3:5], 16)]) if kind == BYTE
            else name.replace(SPACE, " ").encode()
            for name, kind in zip(self.names, self.kinds, strict=True)
        ]
        self.byte_ids = {self.bytes_of[i][0]: i for i, kind in enumerate(self.kinds) if kind == BYTE}
        self.begin, self.end = (self.names.index(x) if x in self.names else None for x in ("<s>", "</s>"))
        self.segment = next(cut for cut in CUTS if all(len(cut.findall(name)) == 1 for name in self.cost))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelt = b"".join(self.bytes_of)
        self.spelling = np.frombuffer(spelt, np.uint8)
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}

    def _add(self, piece: dict) -> None:
        name, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
        if kind in (USER_DEFINED, UNUSED):
            raise ValueError("user-defined and unused pieces are not supported")
        if kind == NORMAL:
            self.cost[name] = -unpack("<f", piece[2])[0] if 2 in piece else 0.0
            self.id_of[name] = len(self.names)
        self.names.append(name)
        self.kinds.append(kind)

    @staticmethod
    def _refuse(trainer: dict, normalizer: dict) -> None:
        if trainer.get(MODEL_TYPE, 1) != MERGES or trainer.get(SPACE_SUFFIX, 0):
            raise ValueError("only merge-type models with space marks in front are supported")
        if normalizer.get(CHARACTER_MAP) or normalizer.get(FEWER_SPACES, 1) or not normalizer.get(ESCAPE_SPACES, 1):
            raise ValueError("only models that leave the text as it is are supported")

    def merged(self, segment: str) -> list[str]:
        """The symbols that are left when no adjacent pair is a piece any more."""
        symbols, cost = list(segment), self.cost
        n = len(symbols)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        agenda = []
        for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])):
            if pair in cost:
                agenda.append((cost[pair], i, 2))
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j, a = after[i], symbols[i]
            if not a or j == n or len(a) + len(symbols[j]) != size:
                continue
            symbols[i] = a = a + symbols[j]
            symbols[j] = ""
            after[i] = j = after[j]
            before[j] = i
            if j < n:
                pair = a + symbols[j]
                if pair in cost:
                    heappush(agenda, (cost[pair], i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + a
                if pair in cost:
                    heappush(agenda, (cost[pair], h, len(pair)))
        return [s for s in symbols if s]

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merged(segment):
            if symbol in self.id_of:
                out.append(self.id_of[symbol])
            elif self.fallback:
                out += [self.byte_ids[b] for b in symbol.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """The ids of each segment as 32-bit integers; those that are new are found and checked together."""
        known = self.known
        new = [s for s in segments if s not in known]
        found = list(map(self.ids, new))
        self._check(new, found)
        fresh = {s: pack(f"<{len(x)}I", *x) for s, x in zip(new, found, strict=True)}
        if len(known) + len(new) > SEGMENTS_KEPT:
            fresh |= {s: known[s] for s in segments if s in known}
            self.known = known = {}
        lasting = {s: x for s, x in fresh.items() if len(s) <= LONGEST_KEPT}
        known.update(lasting)
        return known if len(lasting) == len(fresh) else {s: fresh.get(s) or known[s] for s in segments}

    def _check(self, segments: list[str], found: list[list[int]]) -> None:
        """The library must agree; it puts its prefix before each text, so it is asked for segments that begin with it."""
        n = len(self.prefix)
        asked = [(s, x) for s, x in zip(segments, found, strict=True) if s.startswith(self.prefix) and len(s) > n]
        theirs = self.library.encode([s[n:] for s, _ in asked], num_threads=1)
        for (s, x), y in zip(asked, theirs, strict=True):
            if x != y:
                raise ValueError(f"ids of {s[:80]!r} differ from the library's")

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> Iterator[np.ndarray]:
        """The ids of each text."""
        cut = [self.segments(t) for t in texts]
        ids_of = self.learn(set(chain.from_iterable(cut))).__getitem__
        head, tail = (pack("<I", i) if use and i is not None else b"" for i, use in ((self.begin, begin), (self.end, end)))
        for segments in cut:
            yield np.frombuffer(b"".join([head, *map(ids_of, segments), tail]), "<u4")

    def spell(self, ids: np.ndarray) -> bytes:
        """What the ids of a text decode to: the spellings of all pieces in a row, without the prefix."""
        parts = []
        for i in range(0, len(ids), IDS_AT_ONCE):
            some = ids[i : i + IDS_AT_ONCE]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.starts[some] - ends + sizes, sizes)
            parts.append(self.spelling[at].tobytes())
        plain = b"".join(parts)
        return plain[1:] if self.prefix else plain

    def decode(self, ids: list[int]) -> str:
        """The text of any ids. Bytes that are no UTF-8 become U+FFFD each; one leading space mark is dropped."""
        out: list[str] = []
        dropped = False
        for is_byte, run in groupby(ids, lambda i: self.kinds[i] == BYTE):
            for part in [list(run)] if is_byte else ([i] for i in run):
                text = b"".join(map(self.bytes_of.__getitem__, part)).decode("utf-8", "surrogateescape")
                marked = not is_byte and self.kinds[part[0]] == NORMAL and self.names[part[0]].startswith(SPACE)
                # of the marks that stand before any text, only the first goes
                if marked and self.prefix and not dropped and not any(out):
                    text, dropped = text[1:], True
                out.append(text)
        return "".join(out).translate(_BROKEN)


_BROKEN = {0xDC80 + i: "�" for i in range(128)}
_loaded: dict[str, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """One vocabulary per worker and model file."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode(
    docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", begin: bool = True, end: bool = True
) -> DataFrame:
    """All columns of `docs`, with the piece ids of the whole text.

    `model` is the content of a model file (bounded by its vocabulary). A null text
    counts as empty: it has the begin and end ids only. A column named as `ids` is
    replaced; rows are independent, so repeated rows and ids stay as they are.
    """

    def add(vocab: Pieces, texts: list[str]) -> list[pa.Array]:
        return [pa.array([x.astype(np.int32) for x in vocab.encode(texts, begin, end)], pa.list_(pa.int32()))]

    return _with_columns(docs, model, text, {ids: "array<int>"}, add)


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `df`, with the text of a column of ids; null ids give a null text."""

    def add(vocab: Pieces, rows: list) -> list[pa.Array]:
        return [pa.array([None if x is None else vocab.decode(x) for x in rows], pa.string())]

    return _with_columns(df, model, ids, {out: "string"}, add)


def digests(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """All columns of `docs` with n_tokens, ids_sha256 and decoded_sha256 of the whole text.

    Begin and end ids count. The ids stay inside the task, so very long texts need no
    wide rows. A null text counts as empty. New columns replace columns of the same name.
    """

    def add(vocab: Pieces, texts: list[str]) -> list[pa.Array]:
        found = [
            (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(vocab.spell(x)).hexdigest())
            for x in vocab.encode(texts)
        ]
        n, a, b = zip(*found, strict=True) if found else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _with_columns(docs, model, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, add)


def _with_columns(df: DataFrame, model: bytes, column: str, kinds: dict[str, str], add) -> DataFrame:
    """Columns `kinds`, computed from `column` in Arrow batches, after all others."""
    workers_import_this(df.sparkSession)
    kept = [c for c in df.columns if c not in kinds]
    # numbered, so that no name of the caller's can clash
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`")).toDF(*map(str, range(len(kept) + 1)))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema
    sent = df.sparkSession.sparkContext.broadcast(model)
    is_text = dict(df.dtypes)[column] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(sent.value)
        for batch in batches:
            at = batch.num_columns - 1
            for part in slices(batch, at) if is_text else [batch]:
                values = part.column(at).to_pylist()
                new = add(vocab, [x or "" for x in values] if is_text else values)
                yield pa.record_batch([part.column(i) for i in range(at)] + new, [*kept, *kinds])

    return source.mapInArrow(run, schema)
