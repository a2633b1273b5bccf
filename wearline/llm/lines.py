"""Removal of boilerplate lines that many sites share, by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation, on the map side first. A line whose estimate is clearly above
or below the threshold is decided by it, and lines near the threshold get exact
distinct counts. Lines that cannot reach the threshold, because they occur fewer
times than that or on one site only, need no sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, unused

#: log2 of a sketch's registers; the standard error of an estimate is 0.83 / sqrt(registers).
LOG_REGISTERS = 11
#: Standard errors around the threshold within which lines are counted exactly.
ZONE = 6.0


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def spread_lines(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = 5,
    log_registers: int = LOG_REGISTERS,
    zone: float = ZONE,
) -> DataFrame:
    """(h, sites, exact): hashes of the non-blank lines on at least `min_sites` distinct sites.

    The sites of all copies of a document count. A document that many sites mirror is
    no boilerplate, so a line must also be in two different texts (unless one site is enough).

    `sites` is the exact count where `exact` is true and the sketch's estimate
    elsewhere. A line's hash is the 64-bit hash of its text. A null site is a site
    of its own; null texts have no lines.
    """
    own = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site}`").cast("string")), F.lit(""))
    cut = docs.select(
        F.explode(F.array_distinct(_lines(F.col(f"`{text}`")))).alias("line"),
        F.xxhash64(F.col(f"`{text}`")).alias("copy"),
        own.alias("site"),
    ).where(F.length(F.trim("line")) > 0)
    found = cut.select(F.xxhash64("line").alias("h"), "copy", "site")
    often = found.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("site").alias("first"),
        F.max("site").alias("last"),
        (F.min("copy") != F.max("copy")).alias("texts"),
    )
    several = F.lit(min_sites <= 1) | ((F.col("first") != F.col("last")) & F.col("texts"))
    could = keep(often.where((F.col("n") >= min_sites) & several).select("h"))
    pairs = found.join(could, "h", "left_semi")
    error = 0.83 / 2 ** (log_registers / 2)
    sketched = keep(
        pairs.groupBy("h")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_registers))).alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - zone * error) - 1)
    )
    near = F.col("sites") <= min_sites * (1 + zone * error) + 1
    exact = (
        found.join(sketched.where(near).select("h"), "h", "left_semi")
        .select("h", "site")
        .distinct()
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    sure = sketched.where(~near).withColumn("exact", F.lit(False))
    return keep(sure.unionByName(exact.withColumn("exact", F.lit(True))))


def without_boilerplate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = 5,
    removed: str | None = None,
    **sketch,
) -> DataFrame:
    """All columns of `docs`, the text without every line that is on `min_sites` sites or more.

    Blank lines stay, as do all bytes of the lines that stay; null texts stay null.
    `removed` names a column for the number of lines taken out. Repeated rows and
    ids are treated alike, since a line's fate depends on the line alone.
    """
    wide = keep(spread_lines(docs, text, site, min_sites, **sketch).select("h"))
    own, gone = unused("_doc", docs), unused("_out", docs)
    line_hashes = F.transform(_lines(F.col(f"`{text}`")), lambda x: F.xxhash64(x))
    held = docs.select(F.col(f"`{doc_id}`").alias(own), F.explode(F.array_distinct(line_hashes)).alias("h")).join(wide, "h")
    per_doc = held.distinct().groupBy(own).agg(F.collect_list("h").alias(gone))
    out = F.coalesce(F.col(gone), F.array().cast("array<bigint>"))
    stay = F.filter(_lines(F.col(f"`{text}`")), lambda x: ~F.array_contains(out, F.xxhash64(x)))
    joined = docs.join(per_doc, docs[f"`{doc_id}`"].eqNullSafe(per_doc[own]), "left")
    touched = F.col(gone).isNotNull() & F.col(f"`{text}`").isNotNull()
    columns = [
        (F.when(touched, F.array_join(stay, "\n")).otherwise(docs[f"`{c}`"]) if c == text else docs[f"`{c}`"]).alias(c)
        for c in docs.columns
        if c != removed
    ]
    if removed:
        count = F.size(_lines(F.col(f"`{text}`"))) - F.size(stay)
        columns.append(F.when(touched, count).otherwise(0).cast("long").alias(removed))
    return joined.select(*columns)
