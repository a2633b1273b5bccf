"""Language identification by cross-parsing entropy.

Labelled text of each language goes into a suffix automaton, whose states and
arcs recognise exactly the substrings of that text. An unknown text is parsed
against each language from left to right into longest matches; the fewer phrases
per character a language needs, the lower the cross-entropy, and the language
with the fewest normalised phrases wins.

The automata are dense tables, each over the alphabet of its own sample, and many
blocks of text walk through them together, one array operation per position. An
alphabet of up to WIDTH letters has one symbol per letter. In a larger one the most
frequent letters have one, and all others two, so that no script is too large for a
table and every letter of the sample is known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import release, workers_import_this

#: Bounds of the training sample: symbols for all languages and for one; characters of a row; rows looked at per language.
ALL_CHARS = 400_000
LANGUAGE_CHARS = 48_000
ROW_CHARS = 6_000
LANGUAGE_ROWS = 400
HASH_RANGE = 1 << 30
#: Symbols of a table, beside the one for letters that the sample does not have.
WIDTH = 127
UNKNOWN = "und"
#: A text is parsed in blocks of this many symbols, phrases ending at a block's end.
BLOCK = 256


def symbols(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of anything but letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _letters()
    points = np.where(letters[np.minimum(points, len(letters) - 1)], points, 32)
    gap = points == 32
    return points[~(gap & np.concatenate(([False], gap[:-1])))] if len(points) else points


_letter_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter_table[0]


class Alphabet:
    """Symbols (from 1) of the letters of a sample; symbol 0 stands for every other letter.

    With more than WIDTH letters the last symbols are prefixes: a letter behind the
    most frequent ones is a prefix and any second symbol. The width doubles where
    even that is too small, so every letter has its symbols.
    """

    def __init__(self, sample: np.ndarray):
        letters, counts = np.unique(sample, return_counts=True)
        letters = letters[np.argsort(-counts, kind="stable")]
        self.width = min(len(letters), WIDTH)
        while self.width * (self.width + 1) // 2 < len(letters):
            self.width = self.width * 2 + 1
        # p prefixes stand for p * width letters beside the width - p frequent ones
        prefixes = max(0, -(-(len(letters) - self.width) // max(1, self.width - 1)))
        single = self.width - prefixes
        self.first, self.second = np.zeros(0x110000, np.uint16), None
        self.first[letters[:single]] = np.arange(1, min(single, len(letters)) + 1)
        rest = np.arange(max(0, len(letters) - single))
        if len(rest):
            self.second = np.zeros(0x110000, np.uint16)
            self.first[letters[single:]] = single + 1 + rest // self.width
            self.second[letters[single:]] = 1 + rest % self.width

    def code(self, points: np.ndarray) -> np.ndarray:
        """The symbols of a sequence of code points."""
        first = self.first[points]
        if self.second is None:
            return first
        second = self.second[points]
        both = np.stack([first, second], axis=1).reshape(-1)
        return both[np.stack([np.ones(len(points), bool), second > 0], axis=1).reshape(-1)]


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of a symbol sequence (symbols from 1 to `width`) as a dense table.

    Cell (state, symbol) holds the next state, or -1 - s where the match cannot
    grow: a new phrase begins with this symbol, and s is the state after it.
    """
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p != -1:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and arcs[p].get(c) == q:
                    arcs[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    # the last row is the state between phrases, where unknown symbols lead too
    table = np.full((len(arcs) + 1, width + 1), -1 - len(arcs), np.int32)
    for c, s in arcs[0].items():
        table[:, c] = -1 - s
    for state, row in enumerate(arcs):
        if row:
            table[state, list(row.keys())] = list(row.values())
    return table.reshape(-1)


class Model:
    """The automata of all languages, from (language, training text) pairs."""

    def __init__(self, samples: list[tuple[str, list[str]]], most: int | None = None):
        self.names = [name for name, _ in samples]
        most = most or min(LANGUAGE_CHARS, ALL_CHARS // max(1, len(samples)))
        self.alphabets, self.tables = [], []
        for _, parts in samples:
            points = np.concatenate([symbols(" " + t + " ") for t in parts])
            alphabet = Alphabet(points)
            # letters of two symbols count as two, so that the bound is one on the table's size
            self.alphabets.append(alphabet)
            self.tables.append(automaton(alphabet.code(points)[:most], alphabet.width))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases needed by (text, language), symbols per text, and the most letters of it that a language knows."""
        points = [symbols(t) for t in texts]
        sizes = np.array([len(x) for x in points], np.int64)
        ends = np.cumsum(sizes)
        every = np.concatenate(points) if points else np.zeros(0, np.uint32)
        found = np.zeros((len(texts), len(self.names)), np.int64)
        known = np.zeros(len(texts), np.int64)
        for k, alphabet in enumerate(self.alphabets):
            coded = [alphabet.code(x) for x in points]
            found[:, k] = _walk(self.tables[k], alphabet.width + 1, coded)
            letters = np.concatenate(([0], np.cumsum((alphabet.first[every] > 0) & (every != 32))))
            known = np.maximum(known, letters[ends] - letters[ends - sizes])
        return found, sizes, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and share of known letters of each text.

        The score is the share of phrases that the winner saves against the next
        language (with one language, against one phrase per symbol). A text
        without letters is `und` with score 0. Ties go to the smaller name. The share
        is that of the language that knows most of the text's letters.
        """
        alpha = [t is not None and any(c.isalpha() for c in t) for t in texts]
        n, sizes, known = self.phrases([t if a else "" for t, a in zip(texts, alpha, strict=True)])
        best = n.argmin(axis=1)
        first = n.min(axis=1)
        second = np.partition(n, 1, axis=1)[:, 1] if n.shape[1] > 1 else np.maximum(sizes, first)
        score = np.where(alpha, 1.0 - first / np.maximum(second, 1), 0.0)
        names = [self.names[b] if a else UNKNOWN for b, a in zip(best, alpha, strict=True)]
        return names, np.clip(score, 0, 1), np.minimum(known / np.maximum(sizes, 1), 1.0)


def _walk(table: np.ndarray, width: int, coded: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text, all blocks of all texts walking through the table together."""
    sizes = np.array([len(x) for x in coded], np.int64)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(coded)), blocks)
    grid = np.zeros((len(owner), BLOCK), np.uint16)
    row = 0
    for x, n in zip(coded, blocks.tolist(), strict=True):
        grid[row : row + n].reshape(-1)[: len(x)] = x
        row += n
    last = np.full(len(owner), BLOCK)
    ends = np.cumsum(blocks)[blocks > 0] - 1
    last[ends] = sizes[blocks > 0] - (blocks[blocks > 0] - 1) * BLOCK
    order = np.argsort(-last, kind="stable")  # full blocks first: those still walking are a prefix
    columns = np.ascontiguousarray(grid[order].T)
    walking = np.searchsorted(-last[order], -np.arange(BLOCK), side="left")
    state = np.full(len(owner), len(table) // width - 1, np.int32)
    count = np.zeros(len(owner), np.int32)
    for i in range(BLOCK):
        m = walking[i]
        if not m:
            break
        to = table.take(state[:m] * np.int32(width) + columns[i, :m])
        ends_here = to < 0
        count[:m] += ends_here
        state[:m] = np.where(ends_here, ~to, to)
    return np.bincount(owner[order], count, minlength=len(coded)).astype(np.int64)


def held_out(doc_id: str, folds: int = 5, fold: int = 0) -> F.Column:
    """Is crc32 of the id's decimal text in the given fold? Rows without an id are in fold 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, list[str]]]:
    """The bounded training sample: passages of texts in hash order, per language.

    A text counts once, whatever number of copies it has. Of one longer than ROW_CHARS
    a passage of that many characters counts, from a place its hash gives. One
    aggregate estimates each language's texts and their mean length; hash ranges that
    hold about LANGUAGE_ROWS of them, or twice LANGUAGE_CHARS characters if that is less
    (ten texts at least), then reach the driver. LANGUAGE_CHARS symbols of a language
    are used, and ALL_CHARS of all languages.
    """
    h, long = F.xxhash64(text), F.length(text) > ROW_CHARS
    start = F.pmod(F.xxhash64(F.lit(1), F.col(text)), F.length(text) - ROW_CHARS + 1) + 1
    passage = F.when(long, F.substring(F.col(text), start, F.lit(ROW_CHARS))).otherwise(F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), passage.alias("text"), h.alias("h")).where(F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(
        F.approx_count_distinct("h").alias("n"), F.avg(F.length("text")).alias("size")
    ).collect()
    if not counts:
        return []
    bound = F.lit(0)
    for c in counts:
        wanted = min(LANGUAGE_ROWS, max(10, 2 * LANGUAGE_CHARS / c["size"]))
        bound = F.when(F.col("lang") == c["lang"], int(min(1.0, wanted / max(c["n"], 1)) * HASH_RANGE)).otherwise(bound)
    chosen = rows.where(F.pmod("h", F.lit(HASH_RANGE)) < bound).distinct().collect()
    chosen.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    parts: dict[str, list[str]] = {}
    for r in chosen:
        parts.setdefault(r["lang"], []).append(r["text"])
    most = min(LANGUAGE_CHARS, ALL_CHARS // max(1, len(parts)))
    found = []
    for name, texts in sorted(parts.items()):
        taken, n = [], 0
        for t in texts:
            if n < most:
                taken.append(t)
                n += len(t)
        found.append((name, taken))
    return found


_models: dict[str, Model] = {}


def model(samples: list[tuple[str, list[str]]]) -> Model:
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def identify(
    docs: DataFrame,
    samples: list[tuple[str, list[str]]],
    text: str = "text",
    out: str = "lang_pred",
    score: str = "score",
    known: str | None = None,
) -> DataFrame:
    """All columns of `docs` with the predicted language of the whole text and a score from 0 to 1.

    Null texts and texts without a letter are `und` with score 0, as is every text
    when nothing was learned. `known` names a column for the share of the text that is
    letters of the language that knows most of it: 0 in a script that no sample has.
    New columns replace columns of the same name.
    """
    workers_import_this(docs.sparkSession)
    new = [out, score, *([known] if known else [])]
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.withColumns({out: F.lit("")} | {c: F.lit(0.0) for c in new[1:]}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep="langid")
        learned = model(samples) if samples else None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                none = np.zeros(len(texts))
                names, *numbers = learned.predict(texts) if learned else ([UNKNOWN] * len(texts), none, none)
                columns = [part.column(i) for i in range(len(kept))] + [pa.array(names)]
                yield pa.record_batch(columns + [pa.array(x) for x in numbers[: len(new) - 1]], [*kept, *new])

    return source.mapInArrow(run, schema)
