"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every string of `LENGTH` bytes has one anchor: the first of its k-grams with the
smallest hash. Equal strings have equal anchors at equal offsets, so it is enough
to sort the suffixes that begin at anchors, about one position in 35, each with
the bytes before it. The sort is a string merge sort that sends little:

1. Chunks of documents ask which of their anchors' k-grams occur elsewhere too
   (a distributed check of hashes). Suffixes with a unique k-gram need no sorting.
2. A chunk sorts the rest, settles repeats inside the chunk, and sends what is
   still open as sorted runs, cut at splitters and front-coded: the length of the
   prefix shared with the suffix before, and the rest.
3. A partition merges its runs with a loser tree whose nodes keep the length of
   the prefix that loser and winner share. Suffixes are compared from there on and
   no known prefix is read again; the merge yields the common-prefix lengths too.
4. At every offset, strings are equal if their suffixes share the bytes from the
   anchor on, and the reversed bytes before the anchor are equal likewise. All but
   the earliest are repeats; chunks get back which.

A passage repeated any number of times sends one suffix per chunk and anchor.

Bytes are sorted one higher than they are (UTF-8 has no byte 255), so that zero is
an end mark below every byte: what lies behind the end of a document or behind the
part of a suffix that is sent never equals a byte, U+0000 included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, mixed, pack, pack_sorted, squeeze, expand, unpack, unpack_sorted, width, workers_import_this
from .exchange import by_owner, chunk_numbers, cuts, keep_bucketed, rows_of

LENGTH = 100
GRAM = 32
#: Offsets an anchor can have in a string, 0 to SPAN - 1.
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES = 2 << 20
PIECE = 1 << 19
#: Bytes of a suffix that splitters look at, and positions of a chunk they are chosen from.
HEAD = 7
HEADS = 64
BASE = 0x9E3779B97F4A7C15
RAISED = bytes((b + 1) & 255 for b in range(256))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) rows to chunks of whole documents, of `most` bytes or one document."""
    numbers = chunk_numbers()
    ids, parts, total = [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal total
        text = b"".join(parts)
        at = np.linspace(0, max(len(text) - HEAD, 0), HEADS).astype(int)
        heads = [int.from_bytes(text[i : i + HEAD].translate(RAISED).ljust(HEAD, b"\0"), "big") for i in at.tolist()]
        ties = [int.from_bytes(hashlib.md5(p).digest()[:2], "big") for p in parts]
        row = [
            pa.array([next(numbers)], pa.int64()),
            pa.array([ids[:]], pa.list_(pa.int64())),
            pa.array([pack(np.array(ties, np.uint16))], pa.binary()),
            pa.array([pack(np.array([len(p) for p in parts], np.int64))], pa.binary()),
            pa.array([squeeze(text)], pa.binary()),
            pa.array([heads], pa.list_(pa.int64())),
        ]
        ids.clear(), parts.clear()
        total = 0
        return pa.record_batch(row, ["chunk", "ids", "ties", "sizes", "text", "heads"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            body = text.as_py() or b""
            if total and total + len(body) > most:
                yield close()
            ids.append(doc.as_py())
            parts.append(body)
            total += len(body)
    if ids:
        yield close()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the k-gram at every position: differences of a running polynomial."""
    size = max(PIECE, len(data)) + LENGTH + 1
    if size not in _powers:
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _powers[size]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    n = len(data) - GRAM + 1
    return mixed((sums[GRAM:] - sums[:n]) * down[:n])


class Anchors:
    """Anchors of a chunk: position, hash, document, and the range of string starts each one has."""

    def __init__(self, row: dict, piece: int = PIECE):
        self.piece = piece
        self.data = np.frombuffer(expand(row["text"]), np.uint8)
        self.sizes = unpack(row["sizes"])
        self.ids, self.ties = row["ids"], unpack(row["ties"])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        found = [self._piece(owner, at) for at in range(0, max(len(self.data) - LENGTH + 1, 0), piece)]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        self.at, self.hash, self.first, self.last = columns
        self.hash = self.hash.astype(np.uint64)
        self.doc = owner[self.at] if len(self.at) else np.zeros(0, np.int32)

    def _piece(self, owner: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
        data = self.data[begin : begin + self.piece + LENGTH - 1]
        hashes = _gram_hashes(data)
        value, place = hashes, np.arange(len(hashes), dtype=np.int32)
        wide = 1
        while wide * 2 <= SPAN:
            right = value[wide:] < value[:-wide]
            place = np.where(right, place[wide:], place[:-wide])
            value = np.where(right, value[wide:], value[:-wide])
            wide *= 2
        rest = SPAN - wide
        if rest:
            right = value[rest:] < value[:-rest]
            place = np.where(right, place[rest:], place[:-rest])
        start = np.arange(len(place))
        inside = owner[begin : begin + len(place)] == owner[begin + LENGTH - 1 : begin + LENGTH - 1 + len(place)]
        start, place = start[inside], place[inside]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start))[: len(first)] - 1
        at = place[first].astype(np.int64)
        return at + begin, hashes[at], start[first] + begin, start[last] + begin

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raised bytes from the chosen anchors on, and before them in reverse, end marks beyond the document."""
        at, doc = self.at[chosen, None], self.doc[chosen]
        right = at + np.arange(LENGTH)
        left = at - 1 - np.arange(SPAN - 1)
        padded = np.append(self.data + np.uint8(1), np.uint8(0))
        right = np.where(right < self.ends[doc, None], right, len(self.data))
        left = np.where(left >= self.starts[doc, None], left, len(self.data))
        return padded[right], padded[left]


def _sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the prefix length each shares with the row before in that order."""
    n, wide = rows.shape
    if not n or not wide:
        return np.arange(n), np.zeros(n, np.int64)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{wide}").reshape(-1), kind="stable")
    ranked = rows[order]
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = ranked[1:] != ranked[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return order, shared


def repeats(
    order: np.ndarray, shared: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, age: np.ndarray
) -> np.ndarray:
    """Which strings (row, offset) have an earlier equal one, as a boolean matrix.

    `order` sorts the rows by the bytes from the anchor on and `shared` holds the
    common-prefix lengths in that order; a row has strings at the offsets low to high.
    """
    n = len(order)
    out = np.zeros((n, SPAN), bool)
    if not n:
        return out
    left_order, left_shared = _sorted_rows(left)
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    right_rank[order] = left_rank[left_order] = np.arange(n)
    for o in range(SPAN):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        key = np.cumsum(shared < LENGTH - o)[right_rank[rows]] * (n + 1) + np.cumsum(left_shared < o)[left_rank[rows]]
        by = np.lexsort((age[rows], key))
        key = key[by]
        out[rows[by[1:][key[1:] == key[:-1]]], o] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of true cells."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _ask(parts: int, piece: int):
    """Every chunk's distinct k-gram hashes, to the partitions that own them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = np.unique(Anchors(row, piece).hash)
            edge = cuts(keys, parts)
            for part in np.flatnonzero(np.diff(edge)).tolist():
                blob = pack_sorted(keys[edge[part] : edge[part + 1]])
                yield pa.record_batch(
                    [pa.array([part], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([blob], pa.binary())],
                    ["part", "chunk", "keys"],
                )

    return run


def _shared(part: int, rows: list[dict]) -> Iterator[tuple]:
    """One bit per asked key: does another chunk have it too?"""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    _, at, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    twice, start = counts[at] > 1, 0
    for r, k in zip(rows, keys, strict=True):
        yield r["chunk"], part, pack(np.packbits(twice[start : start + len(k)])), len(k)
        start += len(k)


def _runs(splitters: list[int], parts: int, piece: int):
    """Sort a chunk's suffixes that may repeat; settle the chunk's own repeats; send the rest as runs.

    Rows (part, chunk, start, run) hold front-coded runs; a row with start -1 holds
    what the chunk knows by itself: its settled repeats and the anchors it sent.
    """
    borders = np.array(splitters, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            a = Anchors(row, piece)
            keys, at, counts = np.unique(a.hash, return_inverse=True, return_counts=True)
            bits = [np.unpackbits(unpack(x["bits"]))[: x["n"]] for x in sorted(row["answers"] or [], key=lambda x: x["part"])]
            again = (np.concatenate(bits) > 0) | (counts > 1) if bits else counts > 1
            chosen = np.flatnonzero(again[at]) if len(keys) else np.zeros(0, np.int64)
            right, left = a.rows(chosen)
            low, high = a.at[chosen] - a.last[chosen], a.at[chosen] - a.first[chosen]
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i in a.ids], np.int64)
            age = np.empty(len(chosen), np.int64)
            age[np.lexsort((a.at[chosen], a.ties[a.doc[chosen]], ids[a.doc[chosen]]))] = np.arange(len(chosen))
            order, shared = _sorted_rows(right)
            known = repeats(order, shared, left, low, high, age)
            r, first, last = _ranges(known)
            offsets = np.arange(SPAN)
            open_ = (offsets >= low[:, None]) & (offsets <= high[:, None]) & ~known
            some = open_.any(axis=1)
            low, high = open_.argmax(axis=1), SPAN - 1 - open_[:, ::-1].argmax(axis=1)
            # a suffix is sent as far as its open strings reach, and sorted as sent
            right[np.arange(LENGTH) >= (LENGTH - low)[:, None]] = 0
            sent = np.flatnonzero(some)
            sent = sent[_sorted_rows(right[sent])[0]]
            settled = [pack(x) for x in (a.at[chosen][r] - last, a.at[chosen][r] - first, a.at[chosen][sent])]
            yield _row(int(row["chunk"] % parts), row["chunk"], -1, settled)
            heads = np.zeros(len(sent), np.uint64)
            for j in range(HEAD):
                heads = (heads << np.uint64(8)) | right[sent, j]
            edge = np.concatenate(([0], np.searchsorted(heads, borders), [len(sent)]))
            for part in np.flatnonzero(np.diff(edge)).tolist():
                s = sent[edge[part] : edge[part + 1]]
                local = (a.at - a.starts[a.doc])[chosen[s]] if len(a.at) else s
                front = _front_coded(right[s], LENGTH - low[s])
                before = b"".join(left[i, : high[i]].tobytes() for i in s.tolist())
                run = [*front, squeeze(before)]
                run += [pack(x) for x in (low[s].astype(np.uint8), high[s].astype(np.uint8))]
                run += [pack(ids[a.doc[chosen[s]]]), pack(a.ties[a.doc[chosen[s]]]), pack(local.astype(np.int32)), pack(a.doc[chosen[s]])]
                yield _row(part, row["chunk"], int(edge[part]), run)

    return run


def _row(part: int, chunk: int, start: int, cells: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([start], pa.int64())]
    return pa.record_batch([*columns, pa.array([cells], pa.list_(pa.binary()))], ["part", "chunk", "start", "cells"])


def _front_coded(rows: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Shared prefix lengths and the remaining bytes of sorted rows, each cut to its size and its end mark."""
    sizes = np.minimum(sizes, (rows != 0).sum(axis=1))
    whole = [x[:n].tobytes() for x, n in zip(rows, sizes.tolist(), strict=True)]
    shared, before = [], b""
    for s in whole:
        n = min(len(s), len(before))
        if s[:n] != before[:n]:
            n = next(i for i in range(n) if s[i] != before[i])
        shared.append(n)
        before = s
    tails = b"".join(s[n:] for s, n in zip(whole, shared, strict=True))
    return [pack(np.array(shared, np.uint8)), pack(sizes.astype(np.uint8)), squeeze(tails)]


def _suffixes(cells: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a front-coded run, filled up with end marks, and what each shares with the one before."""
    shared, sizes, tails = unpack(cells[0]).tolist(), unpack(cells[1]).tolist(), expand(cells[2])
    at, before = 0, b""
    for n, size in zip(shared, sizes, strict=True):
        same = n == size == len(before)
        before = before[:n] + tails[at : at + size - n]
        at += size - n
        yield before.ljust(LENGTH, b"\0"), LENGTH if same else n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs: (run, prefix length shared with the suffix before), in sorted order.

    A loser tree over the runs. Every loser keeps the length of the prefix it shares
    with the winner it lost to. The next suffix of the last winner's run knows what
    it shares with the last winner, as do the losers on its path, so the longer
    shared prefix is the smaller suffix without a look at the bytes; only at equal
    lengths are bytes compared, from that length on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    end = (None, -1)  # behind every suffix
    head = [next(r, end) for r in runs] + [end] * (size - len(runs))
    current = [h[0] for h in head]
    losers: list[tuple[int, int]] = [(0, 0)] * size

    def first_difference(a: bytes, b: bytes, known: int) -> int:
        x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
        return LENGTH - (x.bit_length() + 7) // 8

    def play(a: int, b: int, known: int) -> tuple[int, int, int]:
        """Winner, loser and the prefix they share, given that they share `known`."""
        x, y = current[a], current[b]
        if y is None:
            return a, b, -1
        if x is None:
            return b, a, -1
        shared = first_difference(x, y, known)
        return (a, b, shared) if x <= y else (b, a, shared)

    up = list(range(size))
    while len(up) > 1:
        half = len(up) // 2
        level = []
        for i in range(half):
            won, lost, shared = play(up[2 * i], up[2 * i + 1], 0)
            losers[half + i] = (lost, shared)
            level.append(won)
        up = level
    winner, shared = up[0], 0
    while current[winner] is not None:
        yield winner, shared
        current[winner], shared = next(runs[winner], end)
        node = (winner + size) // 2
        while node:
            loser, known = losers[node]
            if known > shared:
                losers[node] = (winner, shared)
                winner, shared = loser, known
            elif known == shared and known >= 0:
                won, lost, common = play(winner, loser, known)
                losers[node] = (lost, common)
                winner = won
            node //= 2


def _merged(part: int, rows: list[dict]) -> Iterator[tuple]:
    """Merge a partition's runs and tell every chunk which of its strings have an earlier equal one."""
    runs = []
    for r in rows:
        if r["start"] < 0:
            yield r["chunk"], -1, r["cells"]
        else:
            runs.append(r)
    if not runs:
        return
    cells = [r["cells"] for r in runs]
    column = lambda i: np.concatenate([unpack(c[i]).astype(np.int64) for c in cells])
    low, high = column(4), column(5)
    ids, ties, place, doc = (column(i) for i in (6, 7, 8, 9))
    sizes = [len(unpack(c[0])) for c in cells]
    begin = np.cumsum([0, *sizes])
    of = np.repeat(np.array([r["chunk"] for r in runs]), sizes)
    left = np.zeros((len(low), SPAN - 1), np.uint8)
    left[np.arange(SPAN - 1) < high[:, None]] = np.frombuffer(b"".join(expand(c[3]) for c in cells), np.uint8)
    age = np.empty(len(low), np.int64)
    age[np.lexsort((place, doc, of, ties, ids))] = np.arange(len(low))
    taken = begin[:-1].tolist()
    order, shared = [], []
    for run, common in merge([_suffixes(c) for c in cells]):
        order.append(taken[run])
        taken[run] += 1
        shared.append(common)
    found = repeats(np.array(order), np.array(shared), left, low, high, age)
    for i, r in enumerate(runs):
        row, first, last = _ranges(found[begin[i] : begin[i + 1]])
        if len(row):
            yield r["chunk"], r["start"], [pack(row), pack(first.astype(np.uint8)), pack(last.astype(np.uint8))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the repeats out of a chunk's documents."""
    for row in rows_of(batches):
        data = np.frombuffer(expand(row["text"]), np.uint8)
        sizes = unpack(row["sizes"])
        told = row["answers"] or []
        settled = next((x["cells"] for x in told if x["start"] < 0), None)
        step = np.zeros(len(data) + 1, np.int64)
        if settled:
            begin, end, sent = (unpack(x).astype(np.int64) for x in settled)
            begin, end = [begin], [end]
            for x in told:
                if x["start"] >= 0:
                    at, first, last = (unpack(c).astype(np.int64) for c in x["cells"])
                    begin.append(sent[x["start"] + at] - last)
                    end.append(sent[x["start"] + at] - first)
            np.add.at(step, np.concatenate(begin), 1)
            np.add.at(step, np.concatenate(end) + LENGTH, -1)
        covered = np.cumsum(step[:-1]) > 0
        ends = np.cumsum(sizes)
        starts = ends - sizes
        removed, from_, to, kept = [], [], [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            part = covered[s:e]
            edge = np.diff(np.concatenate(([0], part.astype(np.int8), [0])))
            from_.append(np.flatnonzero(edge == 1).tolist())
            to.append(np.flatnonzero(edge == -1).tolist())
            removed.append(int(part.sum()))
            kept.append(data[s:e][~part].tobytes())
        yield pa.record_batch(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(from_, pa.list_(pa.int64())),
                pa.array(to, pa.list_(pa.int64())),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"],
        )


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, piece: int = PIECE
) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier.

    (doc_id, n_bytes, n_removed, starts, ends, kept): the removed spans as byte
    offsets, end exclusive, and the remaining bytes. Earlier means in a document
    with a smaller id, or further left in the same one; null ids come last, and
    rows of equal id are ordered by a hash of their text. A null text is empty.
    Strings are judged on the input and never cross documents. A chunk has
    `chunk_bytes` at most, or one document, and is hashed by `piece` bytes at once.
    """
    spark = docs.sparkSession
    workers_import_this(spark)
    parts = width(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("binary"))
    kind = "chunk long, ids array<long>, ties binary, sizes binary, text binary, heads array<long>"
    chunks = keep_bucketed(rows.mapInArrow(lambda b: _chunks(b, chunk_bytes), kind), "chunk")
    probs = [i / parts for i in range(1, parts)]
    heads = chunks.select(F.explode("heads").alias("head"))
    splitters = heads.agg(F.percentile_approx("head", probs or [0.5], 100 * parts)).first()[0] or []
    asked = chunks.mapInArrow(_ask(parts, piece), "part int, chunk long, keys binary")
    bits = by_owner(asked, "part", _shared, "chunk long,part int,bits binary,n long")
    answers = bits.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits", "n")).alias("answers"))
    runs = chunks.join(answers, "chunk", "left").mapInArrow(
        _runs(sorted(splitters), parts, piece), "part int, chunk long, start long, cells array<binary>"
    )
    told = keep(by_owner(runs, "part", _merged, "chunk long,start long,cells array<binary>"))
    mine = told.groupBy("chunk").agg(F.collect_list(F.struct("start", "cells")).alias("answers"))
    return chunks.join(mine, "chunk", "left").mapInArrow(
        _cut,
        "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary",
    )
