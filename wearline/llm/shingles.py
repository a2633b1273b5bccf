"""Near-duplicates by Jaccard similarity of word shingles, from SimHash links and MinHash bands.

Candidates come from three searches, and every one of them is decided by the exact
similarity of its shingle sets:

1. SimHash: covering masks link all fingerprints of shingle sets at most RADIUS bits
   apart. That reaches nearly all copies with little changed, but at the threshold
   fingerprints differ in ten of 64 bits on average, beyond what masks can cover.
2. MinHash: texts that share a band of minima. With BANDS bands of ROWS minima, two
   texts of similarity J share none with probability (1 - J^ROWS)^BANDS: 5e-6 at
   J = 0.8, less above. A bucket's members are compared with its first member, which
   connects a group of near copies by as many comparisons as it has members. What
   stays apart in a bucket of CROWD members at most is compared pair by pair, on the
   minima first: a pair far below the threshold there is not read again.
3. Prefixes: members of larger buckets that are still apart, such as a family that
   fills in one template, are joined on the rarest shingles of their sets. Two sets
   of similarity J or more share one among the first few, and where it stands bounds
   what they can share, so a family below the threshold yields no pairs at all,
   where comparing it pair by pair would read nearly all pairs.

Texts of equal shingle sets are merged first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, release, small_batches, width, workers_import_this
from .components import components
from .simhash import WORD, links as simhash_links

BANDS, ROWS = 40, 6
#: Standard errors below the threshold from which on the minima alone exclude a pair (1e-6 at the threshold).
SLACK = 4.8
BLOCK = 1 << 9
#: Differing bits of SimHash fingerprints that are searched, and members of a bucket that are compared pair by pair.
RADIUS = 7
CROWD = 64
#: Slack of size bounds against rounding.
ROUNDING = 1e-9
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Ascending distinct XXH64 of all shingles of `size` words, A-Z lower-cased.

    Fewer words than `size` are one shingle; without words there is none.
    """
    words = [m.group() for m in WORD.finditer(text.lower())]
    if len(words) < size:
        joined = iter([b" ".join(words)] if words else [])
    else:
        joined = map(b" ".join, zip(*(islice(words, i, None) for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def majority(hashes: np.ndarray) -> int:
    """SimHash fingerprint of a set: bits that are set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def prints(docs: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """(keys…, fp, n, bands, sig, sim): digest, size, bands, a byte of the minima, and SimHash of the shingle set."""
    workers_import_this(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("_text_bytes"))
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fp, n, bands, sig, sim = [], [], [], [], []
            for t in batch.column(at):
                found = shingles(t.as_py() or b"", size)
                least = minima(found)
                fp.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                sim.append(majority(found))
                parts = least.reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)])
                # minima are small, so their middle bits tell them apart
                sig.append((least >> np.uint64(16)).astype(np.uint8).tobytes())
            flat = np.array(bands, np.uint64).reshape(-1).view(np.int64)
            ends = np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)
            yield pa.record_batch(
                [
                    *batch.columns[:at],
                    pa.array(np.array(fp, np.uint64).view(np.int64)),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(sig, pa.binary()),
                    pa.array(sim, pa.int64()),
                ],
                [*keys, "fp", "n", "bands", "sig", "sim"],
            )

    empty = rows.drop("_text_bytes").withColumns({"fp": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    empty = empty.withColumns({"bands": F.array().cast("array<bigint>"), "sig": F.lit(None).cast("binary")})
    empty = empty.withColumn("sim", F.lit(0).cast("long"))
    return rows.mapInArrow(run, empty.schema)


def _alike(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the similarity `least`; texts are (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(32)(lambda text: shingles(text, size))
        for batch in batches:
            good = [
                jaccard(of(x.as_py() or b""), of(y.as_py() or b"")) >= least
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("fp").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    read = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return keep(read.mapInArrow(run, "a long, b long"))


def _across(least: float):
    """Scan rows sorted by key: pairs of a bucket with different roots that sizes and minima do not exclude."""
    floor = BANDS * ROWS * least - SLACK * (BANDS * ROWS * least * (1 - least)) ** 0.5

    def pairs(fp: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(len(fp) - 1):
            rest = slice(i + 1, None)
            small, large = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
            near = np.flatnonzero((root[rest] != root[i]) & (small >= least * large - ROUNDING)) + i + 1
            near = near[(sig[near] == sig[i]).sum(axis=1) >= floor]
            if len(near):
                a, b = np.minimum(fp[near], fp[i]), np.maximum(fp[near], fp[i])
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            fp, root, n = (np.array([r[i] for r in held], np.int64) for i in range(3))
            sig = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
            yield from pairs(fp, root, n, sig)

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and key != now:
                    yield from out()
                    held = []
                now = key
                held.append(tuple(row))
        if held:
            yield from out()

    return scan


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """(fp, root, n, token): all shingles of the sets of (fp, root, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text or b"", size).view(np.int64)
                repeated = [pa.array(np.full(len(found), x), pa.int64()) for x in own]
                yield pa.record_batch([*repeated, pa.array(found)], ["fp", "root", "n", "token"])

    return texts.select("fp", "root", "n", "text").mapInArrow(run, "fp long, root long, n long, token long")


def _at_least(share: Column) -> Column:
    """Smallest whole number that is not below, up to rounding errors."""
    return F.ceil(share - ROUNDING)


def prefix_pairs(texts: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): all pairs of sets with different roots that may have the similarity `least`; texts are (fp, root, n, text).

    Shingles are ordered by rarity: first those of one root only, then by the number of
    sets. Let x be the smaller of two sets of similarity t or more. They share
    2t / (1 + t) |x| elements at least, so the first that they share is among the first
    |x| - 2t / (1 + t) |x| + 1 of x, and among the first |y| - t |y| + 1 of y. After it,
    no more can be shared than either set has left.
    """
    rows = keep(_tokens(texts, size))
    often = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("sets"), (F.min("root") != F.max("root")).alias("across")
    )
    order = Window.partitionBy("fp").orderBy("across", "sets", "token")
    placed = rows.join(keep(often), "token").withColumn("at", F.row_number().over(order))
    n, t = F.col("n"), least
    probe = placed.where("across").where(F.col("at") <= n - _at_least(n * t) + 1).select("token", "fp", "root", "n", "at")
    probe = keep(probe)
    index = probe.where(F.col("at") <= n - _at_least(n * (2 * t / (1 + t))) + 1)
    x, y = (df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("fp", "root", "n", "at")]) for df, s in ((index, "x"), (probe, "y")))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("fp_x") < F.col("fp_y")))
    fits = F.col("n_x") >= _at_least(F.col("n_y") * t)
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) + 1
    enough = left >= _at_least((F.col("n_x") + F.col("n_y")) * (t / (1 + t)))
    found = x.join(y, "token").where((F.col("root_x") != F.col("root_y")) & smaller & fits & enough)
    return found.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct()


def groups(
    docs: DataFrame, keys: list[str], text: str = "text", size: int = 5, least: float = 0.8, crowd: int = CROWD, radius: int = RADIUS
) -> DataFrame:
    """(keys…, root) for every row: rows share a root if links of similarity `least` or more connect them.

    `keys` must determine the text. Null and empty texts have the empty set, which
    equals itself. Other columns take no part, whatever their names.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs, keys, text, size, least, crowd, radius)


def _groups(docs: DataFrame, keys: list[str], text: str, size: int, least: float, crowd: int, radius: int) -> DataFrame:
    spark = docs.sparkSession
    numbered = [f"k{i}" for i in range(len(keys))]
    docs = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, numbered, strict=True)], F.col(f"`{text}`").alias("text"))
    every = keep(prints(docs, numbered, "text", size))
    one = every.groupBy("fp").agg(F.min(F.struct(*numbered)).alias("_of"))
    sets = every.select("fp", "n", "sig", "sim", "bands").dropDuplicates(["fp"])
    members = sets.select("fp", "n", F.explode("bands").alias("key"))
    first = members.groupBy("key").agg(
        F.min(F.struct("fp", "n")).alias("lead"), F.max("fp").alias("last")
    ).where(F.col("lead.fp") < F.col("last"))
    met = keep(members.join(first, "key").select("key", "fp", "n", "lead"))
    near = keep(_simhash_pairs(sets, radius))
    held = met.select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct().join(one, "fp")
    same = reduce(lambda x, y: x & y, [docs[n].eqNullSafe(held[f"_of.{n}"]) for n in numbered])
    texts = keep(docs.join(held, same).select("fp", docs["text"].cast("binary").alias("text")).dropDuplicates(["fp"]))
    fits = F.least("n", "lead.n") >= least * F.greatest("n", "lead.n") - ROUNDING
    star = met.where((F.col("fp") != F.col("lead.fp")) & fits).select(F.col("lead.fp").alias("a"), F.col("fp").alias("b"))
    links = _alike(keep(star.unionByName(near).distinct()), texts, size, least)
    roots = components(links).withColumnRenamed("node", "fp")
    placed = met.select("key", "fp", "n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = keep(placed)
    apart = placed.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), (F.min("root") < F.max("root")).alias("_two")).where("_two")
    rest = keep(placed.join(apart.select("key", "_m"), "key"))
    few = rest.where(F.col("_m") <= crowd).join(sets.select("fp", "sig"), "fp")
    dealt = few.select("key", "fp", "root", "n", "sig").repartition(width(spark), "key").sortWithinPartitions("key")
    cross = dealt.mapInArrow(_across(least), "a long, b long")
    many = rest.where(F.col("_m") > crowd).select("fp", "root", "n").distinct()
    cross = keep(cross.unionByName(prefix_pairs(many.join(texts, "fp"), size, least)).distinct())
    links = links.unionByName(_alike(cross, texts, size, least))
    roots = components(links).withColumnRenamed("node", "fp")
    found = every.select(*numbered, "fp").join(roots, "fp", "left")
    named = [F.col(n).alias(k) for n, k in zip(numbered, keys, strict=True)]
    return found.withColumn("root", F.coalesce("root", "fp")).select(*named, "root")


def _simhash_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b): digests of sets whose fingerprints are equal, or linked by the covering masks."""
    first = sets.groupBy("sim").agg(F.min("fp").alias("first"))
    equal = sets.select("fp", "sim").join(first, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    linked = simhash_links(sets.select(F.col("sim").alias("fp")), radius).distinct()
    one, two = (first.select(F.col("sim").alias(c), F.col("first").alias(f"_{c}")) for c in ("a", "b"))
    return equal.unionByName(linked.join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
