"""Language-model scores with a weighted backoff automaton over the corpus's n-grams.

Contexts of n-grams are states. A state has an arc for every word that followed it
in training, with the smoothed probability, and a failure arc to the state of its
longest proper suffix with the weight left for unseen words. Reading a text is one
walk from left to right that carries the state: take the word's arc if there is
one, else pay the failure arc and try again; the root knows every word.

Probabilities are absolute discounting, interpolated down to the add-half unigram
model; the discount comes from the corpus's counts of counts. Counts cover all
training documents. They live hash-partitioned and are never in one place: every
chunk of documents asks for the counts of the n-grams it holds, and walks its own
part of the automaton.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, mixed, pack, pack_sorted, unpack, unpack_sorted, width, workers_import_this
from .exchange import by_owner, chunk_numbers, cuts, keep_bucketed, rows_of

#: Words of a chunk; a longer document is a chunk of its own.
CHUNK_WORDS = 400_000
#: Key ranges that one task counts in turn.
PARTS_PER_PARTITION = 4
SEED = 42
# no words, since they begin with a space
END, START = (np.uint64(xxhash.xxh64_intdigest(x, SEED)) for x in (b" end", b" start"))
STEP = np.uint64(0x9E3779B97F4A7C15)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, learn) rows to chunks of coded words."""
    numbers = chunk_numbers()
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__  # a new word gets the next number
    tokens: list[np.ndarray] = []
    ids, learn, total = [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal total
        # frequent words get small numbers, which pack well
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        known, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at[flat], minlength=len(known)) if len(flat) else np.zeros(len(known), np.int64)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known), dtype=np.int32)
        row = [
            pa.array([next(numbers)], pa.int64()),
            pa.array([ids[:]], pa.list_(pa.int64())),
            pa.array([pack(np.array(learn, np.uint8))], pa.binary()),
            pa.array([pack(np.array([len(t) for t in tokens], np.int64))], pa.binary()),
            pa.array([pack(place[at[flat]] if len(flat) else flat)], pa.binary()),
            pa.array([pack(known[order])], pa.binary()),
        ]
        words.clear(), tokens.clear(), ids.clear(), learn.clear()
        total = 0
        return pa.record_batch(row, ["chunk", "ids", "learn", "sizes", "tokens", "words"])

    for batch in batches:
        for doc, text, flag in zip(*(batch.column(i) for i in range(3)), strict=True):
            found = (text.as_py() or b"").lower().split()  # splits at \x20 and \x09 to \x0D
            if total and total + len(found) > CHUNK_WORDS:
                yield close()
            tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            ids.append(doc.as_py())
            learn.append(bool(flag.as_py()))
            total += len(found)
    if ids:
        yield close()


class Chunk:
    """The n-grams at every token of a chunk's documents, the end of each document included.

    `keys[n - 1]` are the chunk's distinct n-grams as sorted hashes, with the start
    symbol where they can be contexts; `at[n - 1][i]` is the one that ends at token
    i, and `before[n - 1][i]` the context of n - 1 tokens that it extends. Contexts
    reach over the start of a document with a start symbol, once.
    """

    def __init__(self, row: dict, order: int):
        self.sizes = unpack(row["sizes"]) + 1
        self.ids = row["ids"]
        self.learn = np.repeat(unpack(row["learn"]).astype(bool), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.order, n = order, int(self.sizes.sum())
        inside = np.ones(n, bool)
        inside[self.starts + self.sizes - 1] = False
        known = np.append(unpack(row["words"]), [END, START])
        local = np.full(n, len(known) - 2, np.int64)
        local[inside] = unpack(row["tokens"])
        sort = np.argsort(known)
        place = np.empty(len(known), np.int64)
        place[sort] = np.arange(len(known))
        self.keys, self.at, self.before = [known[sort]], [place[local]], [np.zeros(n, np.int64)]
        first = np.zeros(n, bool)
        first[self.starts] = True
        gram = known[local]
        for k in range(1, order):
            # the k tokens before: what ended at the token before, or the start symbol
            before = np.empty(n, np.int64)
            before[1:] = self.at[k - 1][:-1]
            before[first] = np.searchsorted(self.keys[k - 1], START)
            self.before.append(before)
            gram = mixed(self.keys[k - 1][before] * STEP + known[local])
            keys, at = np.unique(gram, return_inverse=True)
            if k + 1 < order:
                new = int(np.searchsorted(keys, START))
                keys, at = np.insert(keys, new, START), at + (at >= new)
            self.keys.append(keys)
            self.at.append(at)


def _ask(order: int, level: int, parts: int):
    """Requests of every chunk for its distinct n-grams of one order, with its own training counts.

    For orders under the highest, contexts bring along what this chunk was given to
    report about them: how many different words follow and how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row, order)
            keys = chunk.keys[level]
            sums = [np.bincount(chunk.at[level][chunk.learn], minlength=len(keys))]
            if level + 1 < order:
                sums += _reported(chunk, row, level)
            edge = cuts(keys, parts)
            for part in np.flatnonzero(np.diff(edge)).tolist():
                s = slice(edge[part], edge[part + 1])
                yield pa.record_batch(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([row["chunk"]], pa.int64()),
                        pa.array([pack_sorted(keys[s])], pa.binary()),
                        pa.array([[pack(_small(x[s])) for x in sums]], pa.list_(pa.binary())),
                    ],
                    ["part", "chunk", "keys", "sums"],
                )

    return run


def _small(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 256 else np.uint32 if most < 1 << 32 else np.uint64)


def _answers(row: dict, level: int) -> list[np.ndarray]:
    """Whose report a key is, its count, and for contexts the types and the total after it, in the order of the keys."""
    parts = sorted(row[f"answers{level}"], key=lambda a: a["part"])
    return [np.concatenate([unpack(a["cells"][i]).astype(np.int64) for a in parts]) for i in range(len(parts[0]["cells"]))]


def _reported(chunk: Chunk, row: dict, level: int) -> list[np.ndarray]:
    """The chunk's reports for its contexts of this order: types and total of the words after them."""
    own, seen, *_ = _answers(row, level + 1)
    context = np.zeros(len(own), np.int64)
    context[chunk.at[level + 1]] = chunk.before[level + 1]
    own = own > 0
    size = len(chunk.keys[level])
    return [
        np.bincount(context[own], minlength=size),
        np.bincount(context[own], weights=seen[own], minlength=size).astype(np.int64),
    ]


def _tally(part: int, rows: list[dict]) -> Iterator[tuple]:
    """Sum the counts of each key over all chunks and answer every chunk; one of them reports each key."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    at = at.astype(np.int32)
    sums, mine = [], np.zeros(len(at), np.uint8)
    for i in range(len(rows[0]["sums"])):
        own = np.concatenate([unpack(r["sums"][i]) for r in rows])
        sums.append(np.bincount(at, weights=own, minlength=len(every)).astype(np.int64))
        if not i:
            held = np.flatnonzero(own)
            first = np.empty(len(every), np.int64)
            first[at[held[::-1]]] = held[::-1]  # the last one written is the first that counted it
            mine[first[sums[0] > 0]] = 1
    count = sums[0]
    yield None, part, None, [int(x) for x in (count.sum(), (count > 0).sum(), (count == 1).sum(), (count == 2).sum())]
    sums, start = [_small(x) for x in sums], 0
    for r, k in zip(rows, keys, strict=True):
        s = slice(start, start + len(k))
        yield r["chunk"], part, [pack(mine[s]), *(pack(x[at[s]]) for x in sums)], None
        start += len(k)


class Automaton:
    """The part of the backoff automaton that a chunk's documents can reach.

    State 0 is the root; a state's depth is the length of its context. The arcs lie
    along the text: `seen[d][i]` tells whether the state of depth d before token i
    has an arc for the token, `weight[d][i]` is its log10 probability, and `to[d][i]`
    the state it leads to. The root has an arc for every word.
    """

    def __init__(self, chunk: Chunk, row: dict, model: dict):
        order, n = chunk.order, len(chunk.at[0])
        told = [_answers(row, k) for k in range(order)]
        back, depth = [np.zeros(1)], [np.zeros(1, np.int64)]
        number, states = [], 1
        for k in range(order - 1):
            _, _, types, total = told[k]
            live = total > 0
            number.append(np.where(live, np.cumsum(live) + states - 1, 0))
            states += int(live.sum())
            back.append(np.log10(model["d"][k + 1] * types[live] / total[live]))
            depth.append(np.full(int(live.sum()), k + 1))
        self.back, self.depth = np.concatenate(back).tolist(), np.concatenate(depth).tolist()
        fail = np.zeros(states, np.int64)
        for k in range(1, order - 1):
            # the suffix of a context is what stands at the same token one order lower
            fail[number[k][chunk.at[k]]] = number[k - 1][chunk.at[k - 1]]
            start = [number[j][np.searchsorted(chunk.keys[j], START)] for j in (k, k - 1)]
            fail[start[0]] = start[1]
        fail[0] = 0
        self.fail = fail.tolist()
        # by depth: the longest suffix of up to depth + 1 tokens that is a state
        to, here = [], np.zeros(n, np.int64)
        for k in range(order):
            if k < order - 1:
                longer = number[k][chunk.at[k]]
                here = np.where(longer > 0, longer, here)
            to.append(here)
        size = model["n"] + 0.5 * (model["v"] + 1)
        count = told[0][1][chunk.at[0]]
        self.known, p = count > 0, (count + 0.5) / size
        self.base = np.log10(p)
        seen, weight = [np.ones(n, bool)], [self.base]
        for k in range(1, order):
            types, total = (x[chunk.before[k]] for x in told[k - 1][2:])
            count, d = told[k][1][chunk.at[k]], model["d"][k]
            # interpolated at every token, from the order below up
            p = np.where(total > 0, (np.maximum(count - d, 0) + d * types * p) / np.maximum(total, 1), p)
            seen.append(count > 0)
            weight.append(np.log10(p))
        self.seen, self.weight, self.to = ([x.tolist() for x in y] for y in (seen, weight, to))
        starts = [int(number[k][np.searchsorted(chunk.keys[k], START)]) for k in range(order - 1)]
        self.start = next((x for x in reversed(starts) if x), 0)

    def walk(self, first: int, end: int) -> float:
        """log10 probability of the tokens first to end - 1, one document, read from left to right."""
        seen, weight, to, depth, back, fail = self.seen, self.weight, self.to, self.depth, self.back, self.fail
        state, score = self.start, 0.0
        for i in range(first, end):
            d = depth[state]
            while not seen[d][i]:
                score += back[state]
                state = fail[state]
                d = depth[state]
            score += weight[d][i]
            state = to[d][i]
        return score


def score(docs: DataFrame, doc_id: str, text: str, learn: Column, order: int = 2) -> DataFrame:
    """Scores of all texts under a model of the rows for which `learn` holds.

    (doc_id, n_tokens, n_known, train_tokens, base_score, score): one row per input
    row. Words are runs of anything but white space, A-Z lower-cased, and every
    text ends with an end token; a null text counts as empty. With nothing to learn
    from, every token has the probability of an unknown word.
    """
    spark = docs.sparkSession
    workers_import_this(spark)
    parts = PARTS_PER_PARTITION * width(spark)
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("binary"), F.coalesce(learn, F.lit(False))
    )
    chunks = keep_bucketed(
        rows.mapInArrow(_chunks, "chunk long, ids array<long>, learn binary, sizes binary, tokens binary, words binary"),
        "chunk",
    )
    met, model = chunks, {"d": [0.0] * order}
    told = "chunk long,part int,cells array<binary>,sums array<long>"
    for level in range(order - 1, -1, -1):
        asked = met.mapInArrow(_ask(order, level, parts), "part int, chunk long, keys binary, sums array<binary>")
        answers = keep(by_owner(asked, "part", _tally, told))
        sums = [F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(4)]
        n, v, once, twice = answers.where("chunk is null").agg(*sums).first()
        model["d"][level] = once / (once + 2 * twice) if once and twice else 0.5
        model |= {"n": n, "v": v}
        mine = answers.where("chunk is not null").groupBy("chunk").agg(
            F.collect_list(F.struct("part", "cells")).alias(f"answers{level}")
        )
        met = met.join(mine, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row, order)
            automaton = Automaton(chunk, row, model)
            ends = (chunk.starts + chunk.sizes).tolist()
            walked = [automaton.walk(s, e) for s, e in zip(chunk.starts.tolist(), ends, strict=True)]
            size = len(chunk.ids)
            yield pa.record_batch(
                [
                    pa.array(chunk.ids, pa.int64()),
                    pa.array(chunk.sizes, pa.int64()),
                    pa.array(np.add.reduceat(automaton.known.astype(np.int64), chunk.starts)),
                    pa.array(np.full(size, model["n"], np.int64)),
                    pa.array(np.add.reduceat(automaton.base, chunk.starts)),
                    pa.array(walked, pa.float64()),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return met.mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
