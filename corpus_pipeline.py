"""From raw documents to an encoded mix: language, boilerplate, near-duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage
before kept. Its result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import bpe, langid, lines, mixing, shingles, tokenizers
from wearline.llm.common import keep, width

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NO_ID = -(1 << 63)


def _row_key() -> list[Column]:
    """Equal for rows of equal id and text only; null ids are equal."""
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text")]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, which becomes their `lang`.

    Null texts and texts without a letter go, and texts none of whose letters is in the
    sample of any language. The languages are those of the labels in `docs`; where
    there are none at all, nothing is rejected for its language.
    """
    learned = langid.sample(docs)
    named = langid.identify(docs.select(*COLUMNS), learned, out="_lang", score="_score", known="_known")
    if not learned:
        return docs.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    return named.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_known") > 0)).withColumn("lang", F.col("_lang")).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five sources or more share; those of nothing else go.

    The sources of exact copies all count; a line of one text only stays.
    """
    clean = lines.without_boilerplate(docs.select(*COLUMNS), removed="_removed")
    return (
        clean.where((F.col("_removed") == 0) | (mixing.words(F.col("text")) > 0))
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*COLUMNS)
    )


def _distinct(keyed: DataFrame) -> DataFrame:
    """One row per id and text, the least of those that differ in other columns."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    rows = keyed.groupBy("_id", "_text").agg(F.min(F.struct(*rest, "doc_id", "text")).alias("_row"))
    return rows.select("_id", "_text", *[F.col(f"_row.{c}").alias(c) for c in COLUMNS])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group.

    Links are pairs of texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, all decided on the sets themselves. Candidates are
    what the SimHash operator's covering masks link within seven bits, and, since
    fingerprints of similarity 0.8 mostly differ in more, texts with a common MinHash
    band. Rows of equal id are told apart by their text, repeated rows are one (of
    the least other columns), and null ids come after all others.
    """
    keyed = docs.select(*COLUMNS, *_row_key())
    found = keep(shingles.groups(keyed, ["_id", "_text"], size=5, least=0.8))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("_id") == NO_ID, "_id", "_text")).alias("first"))
    kept = first.select("first._id", "first._text")
    return _distinct(keyed.join(kept, ["_id", "_text"], "left_semi")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn until every source is near its target weight, up to three times each.

    One partition per shard of the splitting tree, in the shard's random order. A
    repeated row counts once. Of rows with equal id and text but another language or
    source, the least counts, in the sizes and in the mix.
    """
    keyed = docs.select(*COLUMNS, *_row_key())
    sized = keep(_distinct(keyed).select("_id", "_text", "source", mixing.words(F.col("text")).alias("size")))
    levels = max(1, (width(spark) - 1).bit_length())
    draws, _ = mixing.mix(sized, "_id", "size", "source", block_words=None, levels=levels, tie="_text")
    placed = draws.select(F.col("row").alias("_id"), F.col("tie").alias("_text"), "shard", "place")
    return (
        _distinct(keyed)
        .join(placed, ["_id", "_text"])
        .repartition(1 << levels, "shard")
        .sortWithinPartitions("shard", "place")
        .select(*COLUMNS)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the text they decode to."""
    coded = bpe.encode(docs.select(*COLUMNS), tokenizers.content(), decoded="decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", one_of_each_group),
    ("mix_sources", mixed),
    ("bpe_encode", encoded),
]

#: Near-duplicates and encodings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
