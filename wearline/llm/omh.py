"""Document fingerprints by Order MinHash, sensitive to edit distance.

Every k-mer of a text is numbered by its occurrence, so repeats count. Random
hashes deal the numbered k-mers into bins; each bin selects its `TUPLE` smallest,
puts them back into text order, and hashes that tuple. Two texts agree in a bin
when they share the selected k-mers and have them in the same order, which
insertions, deletions and moved passages disturb; the share of agreeing bins is
the likeness of the fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import cut_points, with_bucket
from .bpe import slices
from .common import mixed, width, workers_import_this

K = 6
BINS = 64
TUPLE = 2
VALUE_BITS = 40
#: Bytes of text whose k-mers are sorted together.
TOGETHER = 1 << 20
#: Parts of the sorted order to a shuffle partition, so that hashing parts to partitions evens out.
PARTS_PER_PARTITION = 4
#: Fills texts shorter than k; no code point has this value.
FILLER = 0x110000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def signatures(texts: list[np.ndarray], k: int = K) -> np.ndarray:
    """One row of BINS 16-bit values per text of code points; 0 marks a bin without k-mers."""
    out = np.zeros((len(texts), BINS), np.uint16)
    sizes = np.array([max(len(t), k) if len(t) else 0 for t in texts], np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    codes = np.full(total, FILLER, np.uint64)
    starts = np.cumsum(sizes) - sizes
    for t, s in zip(texts, starts.tolist(), strict=True):
        codes[s : s + len(t)] = t
    h = codes[: total - k + 1].copy()
    for j in range(1, k):
        h *= np.uint64(0x100000001B3)
        h += codes[j : total - k + 1 + j]
    h = mixed(h)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = np.flatnonzero(owner[: len(h)] == owner[k - 1 :])
    # equal k-mers of a text side by side, in text order
    packed = (h[inside] & np.uint64(0xFFFFFFFF00000000)) | inside.astype(np.uint64)
    packed.sort()
    kmer, at = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = owner[at]
    index = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = (kmer[1:] != kmer[:-1]) | (doc[1:] != doc[:-1])
    occurrence = index - np.maximum.accumulate(np.where(new, index, 0))
    f = mixed((kmer << np.uint64(31)) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bins = doc.astype(np.uint64) * np.uint64(BINS) + (f & np.uint64(BINS - 1))
    order = np.argsort((bins << np.uint64(VALUE_BITS)) | (f >> np.uint64(64 - VALUE_BITS)))
    bins, f, at = bins[order], f[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    ends = np.append(first[1:], len(bins))
    chosen = np.minimum(first[:, None] + np.arange(TUPLE), len(bins) - 1)
    have = first[:, None] + np.arange(TUPLE) < ends[:, None]
    place = np.where(have, at[chosen], np.iinfo(np.int64).max)
    by_text = np.argsort(place, axis=1, kind="stable")
    picked = np.take_along_axis(np.where(have, f[chosen], np.uint64(0)), by_text, axis=1)
    value = np.zeros(len(first), np.uint64)
    for j in range(TUPLE):
        value = mixed(value * np.uint64(0x9FB21C651E98DF25) + picked[:, j] + np.uint64(j + 1))
    out.reshape(-1)[bins[first].astype(np.int64)] = (value % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing bins among those that either fingerprint fills; 1 for two empty ones."""
    filled = (a != 0) | (b != 0)
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def spelled(signature: np.ndarray) -> list[str]:
    width = 2 * BINS
    raw = signature.astype(">u2").tobytes()
    return [raw[i : i + width].hex() for i in range(0, len(raw), width)]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of `docs` with the whole text's fingerprint, 256 hex digits; null counts as empty."""
    workers_import_this(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at, TOGETHER):
                found = signatures([code_points(t or "") for t in part.column(at).to_pylist()])
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.record_batch([*columns, pa.array(spelled(found), pa.string())], [*kept, out])

    return source.mapInArrow(run, source.withColumn(out, F.lit("")).schema)


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, guest, doc_id, text): all rows in descending order of doc_id, cut into parts.

    A part is sorted within its partition and ends with a guest: a copy of the row
    that begins the next part (after the last part: the first). Only quantiles of
    the ids and the first row of every part pass through the driver, as a range
    partitioner's bounds do. Null ids come last; equal ids are ordered by a hash of
    the text.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = PARTS_PER_PARTITION * width(spark)
    cut = with_bucket(rows, "doc_id", cut_points(rows.select("doc_id"), "doc_id", parts), "part")
    cut = cut.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("part")).cast("int"))
    heads = cut.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("head")).collect()
    heads.sort(key=lambda r: -r["part"])
    goes = [(h["head"]["doc_id"], h["head"]["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    # one row per part, so a few times as many as there are shuffle partitions
    guests = F.broadcast(spark.createDataFrame(goes, "head_id long, head_tie long, host int"))
    met = cut.join(guests, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    home = F.struct("part", F.lit(False).alias("guest"))
    away = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    places = F.when(F.col("host").isNull(), F.array(home)).otherwise(F.array(home, away))
    dealt = met.select(F.explode(places).alias("p"), "doc_id", "tie", "text").select(
        "p.part", "p.guest", "doc_id", "tie", "text"
    )
    return (
        dealt.repartition(width(spark), "part")
        .sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
        .select("part", "guest", "doc_id", "text")
    )


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_test(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike text, edited text and next text are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next), one row per input row. A null text counts as empty.
    """
    workers_import_this(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last row, until the next one is known
        for batch in batches:
            for part in slices(batch, 3, TOGETHER):
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                first = [waiting] if waiting is not None else []
                yield from report(first + rows)
                waiting = rows[-1] if rows else waiting

    def report(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            return
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        plain = signatures([code_points(t) for t in texts])
        after = signatures([code_points(t) for t in changed])
        own, following = plain[pairs], plain[[i + 1 for i in pairs]]
        yield pa.record_batch(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(spelled(own)),
                pa.array(spelled(after)),
                pa.array(likeness(own, after)),
                pa.array(likeness(own, following)),
            ],
            names,
        )

    kinds = ["long", "long", "string", "string", "string", "double", "double"]
    return beside_next(docs, doc_id, text).mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
