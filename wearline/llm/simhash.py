"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is a majority vote over hashed word shingles. Bit i is given
a non-zero vector c(i) over GF(2) of radius + 1 dimensions, and every non-zero
vector v of that space is a table whose mask keeps the bits with <c(i), v> = 1.
Up to `radius` differing bits span at most `radius` dimensions, so some v is
orthogonal to all of them: in that table the two masked fingerprints are equal.
No pair within the radius is missed, whatever the data.

Equal fingerprints are merged before any search. A bucket with more fingerprints
than one task should compare is split by covering the bits its mask left open in
the same way, which halves the open bits and keeps the guarantee; after three
levels a bucket can hold 2^8 fingerprints at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep, width, workers_import_this
from .components import components

WORD = re.compile(rb"[^" + SPACES + rb"]+")
BLOCK = 1 << 16
BUCKET = 2048


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over all shingles of `size` words, A-Z lower-cased.

    Fewer words than `size` are one shingle; without words the fingerprint is zero.
    """
    words = (m.group() for m in WORD.finditer(text.lower()))
    tail: list[bytes] = []
    votes, n = np.zeros(64, np.int64), 0
    while True:
        part = tail + list(islice(words, BLOCK))
        if len(part) < size:
            if n or not part:
                break
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        h = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(seed))), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
        tail = part[len(part) - size + 1 :] if len(part) >= size else part
        if len(part) < size:
            break
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def masks(open_bits: list[int], radius: int) -> list[int]:
    """The covering's masks over the given bit positions.

    A radius over three deals the bits into groups: of 4 g - 1 differing bits or
    fewer, one of g groups has three at most, and its own covering meets the pair.
    """
    groups = radius // 4 + 1
    found = []
    for g in range(groups):
        bits, near = open_bits[g::groups], radius // groups
        tables = 2 ** (near + 1)
        found += [
            sum(1 << bit for j, bit in enumerate(bits) if ((1 + j % (tables - 1)) & v).bit_count() & 1)
            for v in range(1, tables)
        ]
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _connect(path: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int, earlier: dict[int, list[int]]):
    """(a, b) that connect what the pairs within the radius of the same bucket connect.

    All buckets are compared together, at every distance between rows. Pairs that an
    earlier table has in one bucket too are left to it.
    """
    found = []
    for lag in range(1, len(fp)):
        same = np.flatnonzero((path[lag:] == path[:-lag]) & (key[lag:] == key[:-lag]))
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + lag]) <= radius]
        found.append(np.stack([near, near + lag]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    x, of = fp[pairs[0]] ^ fp[pairs[1]], path[pairs[0]]
    new = np.ones(len(x), bool)
    for p in np.unique(of).tolist():
        for mask in earlier[p]:
            new &= (of != p) | ((x & np.uint64(mask)) != 0)
    i, j = pairs[:, new]
    label = np.arange(len(fp))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    hung = np.flatnonzero(label != np.arange(len(fp)))
    return fp[hung], fp[label[hung]], path[hung]


def _search(earlier: dict[int, list[int]], radius: int, limit: int):
    """Scan rows sorted by (path, key): links of small buckets, members of large ones (b is null)."""

    def rows(a: np.ndarray, b: np.ndarray | None, path: np.ndarray) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.record_batch([pa.array(a.view(np.int64)), second, pa.array(path)], ["a", "b", "path"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        full = None  # the bucket under way, if it is known to be large
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            path, key, fp = (np.concatenate(x) for x in zip(held, new, strict=True))
            if full is not None:
                n = int(((path == full[0]) & (key == full[1])).sum())
                yield rows(fp[:n], None, path[:n])
                path, key, fp = path[n:], key[n:], fp[n:]
            if not len(fp):
                held = [path, key, fp]
                continue
            starts = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (key[1:] != key[:-1]))))
            sizes = np.diff(np.append(starts, len(fp)))
            large = np.repeat(sizes > limit, sizes)
            yield rows(fp[large], None, path[large])
            full = (path[-1], key[-1]) if sizes[-1] > limit else None
            # the last bucket may go on in the next batch
            done = np.arange(len(fp)) < starts[-1]
            yield rows(*_connect(path[done & ~large], key[done & ~large], fp[done & ~large], radius, earlier))
            rest = ~done & ~large
            held = [path[rest], key[rest], fp[rest]]
        if len(held[2]):
            yield rows(*_connect(*held, radius, earlier))

    return scan


def links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints (column `fp`) at most `radius` bits apart.

    The links connect exactly what all such pairs connect. A path numbers the masks
    taken on the way to a bucket.
    """
    spark = prints.sparkSession
    workers_import_this(spark)
    rows = prints.select("fp").where("fp is not null").distinct()
    level = dict(enumerate(masks(list(range(64)), radius), 1))
    step = len(level) + 1
    found = None
    keyed = rows.select(F.explode(F.array(*[_entry(p, m) for p, m in level.items()])).alias("t"), "fp")
    while True:
        earlier = {p: [m for q, m in level.items() if q < p and q // step == p // step] for p in level}
        dealt = keyed.select("t.path", "t.key", "fp").repartition(width(spark), "path", "key")
        hits = keep(
            dealt.sortWithinPartitions("path", "key", "fp").mapInArrow(
                _search(earlier, radius, bucket), "a long, b long, path long"
            )
        )
        good = hits.where("b is not null").select("a", "b")
        found = good if found is None else found.unionByName(good)
        large = hits.where("b is null")
        paths = [r["path"] for r in large.select("path").distinct().collect()]
        if not paths:
            return found
        deeper, entries = {}, None
        for p in paths:
            rest = [i for i in range(64) if not level[p] >> i & 1]
            own = {p * step + v: level[p] | sub for v, sub in enumerate(masks(rest, radius), 1)}
            deeper |= own
            one = F.array(*[_entry(q, m) for q, m in own.items()])
            entries = F.when(F.col("path") == p, one) if entries is None else entries.when(F.col("path") == p, one)
        level = deeper
        members = large.select("path", F.col("a").alias("fp"))
        keyed = members.select(F.explode(entries).alias("t"), "fp")


def _entry(path: int, mask: int):
    key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    return F.struct(F.lit(path).cast("long").alias("path"), key.alias("key"))


def fingerprints(docs: DataFrame, keys: list[str], text: str, size: int = 3) -> DataFrame:
    """(keys…, fp long) for every row; a null text counts as empty."""
    workers_import_this(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("_text_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(keys)
            prints = np.fromiter(
                (fingerprint(t.as_py() or b"", size) for t in batch.column(at)), np.uint64, batch.num_rows
            )
            yield pa.record_batch([*batch.columns[:at], pa.array(prints.view(np.int64))], [*keys, "fp"])

    return rows.mapInArrow(run, rows.drop("_text_bytes").withColumn("fp", F.lit(0).cast("long")).schema)


def groups(
    docs: DataFrame, keys: list[str], text: str = "text", size: int = 3, radius: int = 3, bucket: int = BUCKET
) -> DataFrame:
    """(keys…, fp, root) for every row: rows share a root if links of at most `radius` bits connect them."""
    prints = keep(fingerprints(docs, keys, text, size))
    roots = components(links(prints, radius, bucket)).withColumnRenamed("node", "fp")
    own = prints.select("fp").distinct().join(roots, "fp", "left")
    by_print = keep(own.select("fp", F.coalesce("root", "fp").alias("root")))
    return prints.join(by_print, "fp").select(*[F.col(f"`{k}`") for k in keys], "fp", "root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable by links of at most `radius` bits.

    One row per input row, repeated rows and ids included. Null and empty texts have
    fingerprint zero and are linked like any other. A null doc_id stays null and is
    never a component's id unless all of its documents have none.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = keep(groups(rows, ["doc_id"], "text", size, radius, bucket))
    named = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(named, "root").select("doc_id", "fp", "component_id")
