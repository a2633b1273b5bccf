"""Checks of an extractor against readers, of labels, and of stated numbers against recomputed ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_directional, mean_flag, percent, ratio
from ..functions.text import is_percent, number_in
from .ordering import match

LABELS = ("increase", "decrease", "stable", "unspecified", "absent")
# Tolerances of stated numbers, of printed table cells and of printed percentages.
AUDIT_ABS, AUDIT_REL = 0.051, 0.002
CELL_TOLERANCE, PERCENT_TOLERANCE = 0.011, 0.51
#: Letters by which phrases without an inner word are looked up.
GRAM = 3


# ------------------------------------------------------------------ confusion
def confusion(df: DataFrame, pred: str, ref: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Counts for every pair of classes, zero included, as conditional counts of one pass."""
    cells = [
        F.struct(F.lit(a).alias(pred), F.lit(b).alias(ref), F.count_if((F.col(pred) == a) & (F.col(ref) == b)).alias("n"))
        for a in classes
        for b in classes
    ]
    one = df.groupBy(*by).agg(F.array(*cells).alias("_cells"))
    return one.select(*by, F.inline("_cells"))


def class_scores(df: DataFrame, pred: str, ref: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per class."""
    cells = []
    for c in classes:
        p, r = F.col(pred) == c, F.col(ref) == c
        tp, called, real = F.count_if(p & r), F.count_if(p), F.count_if(r)
        cells.append(
            F.struct(
                F.lit(c).alias("class"),
                tp.alias("hits"),
                called.alias("called"),
                real.alias("labelled"),
                ratio(tp, called).alias("precision"),
                ratio(tp, real).alias("recall"),
            )
        )
    return df.groupBy(*by).agg(F.array(*cells).alias("_c")).select(*by, F.inline("_c"))


def pooled_scores(df: DataFrame, pred: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """Increase and decrease taken together as 'a directional claim', and how often the sign is right."""
    p, r = is_directional(pred), is_directional(ref)
    tp = F.count_if(p & r)
    sign = F.count_if(p & r & (F.col(pred) == F.col(ref)))
    return df.groupBy(*by).agg(
        tp.alias("hits"),
        ratio(tp, F.count_if(p)).alias("precision"),
        ratio(tp, F.count_if(r)).alias("recall"),
        sign.alias("sign_ok"),
        percent(sign, tp).alias("sign_pct"),
    )


# ------------------------------------------------------------------ reweighting
def stratum_weights(sample: DataFrame, corpus: DataFrame, stratum: str) -> DataFrame:
    """Corpus count over sampled count per stratum. A stratum of the corpus without sampled rows stays, with no weight."""
    taken = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"))
    total = corpus.groupBy(stratum).agg(F.count(F.lit(1)).alias("corpus"))
    both = match(total, taken, [stratum], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0).cast("long")))
    return both.withColumn("weight", ratio("corpus", "sampled"))


def reweight(sample: DataFrame, weights: DataFrame, stratum: str) -> DataFrame:
    return match(sample, weights.select(stratum, "weight"), [stratum])


def corpus_accuracy(sample: DataFrame, weights: DataFrame, stratum: str, ok: Column) -> DataFrame:
    """Agreement per stratum, and over the corpus by weighting each stratum with its corpus count.

    Strata without sampled rows are listed with an unknown accuracy and count in the
    corpus; the accuracy of all is that of the strata that were sampled.
    """
    per = sample.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(ok).alias("agree"), mean_flag(ok).alias("_acc")
    )
    per = match(weights.select(stratum, "corpus"), per, [stratum], "left").fillna(0, ["sampled", "agree"])
    known = F.when(F.col("sampled") > 0, F.col("corpus"))
    out = per.rollup(stratum).agg(
        F.grouping(stratum).alias("_g"),
        F.sum("sampled").alias("sampled"),
        F.sum("agree").alias("agree"),
        F.sum("corpus").alias("corpus"),
        percent(F.sum(F.col("_acc") * F.col("corpus")), F.sum(known)).alias("accuracy_pct"),
    )
    return out.withColumn(stratum, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(stratum).cast("string"))).drop("_g")


def claim_figures(label: str) -> dict[str, tuple[Column, Column | None]]:
    """Corpus figures of a reading: which claims count, and out of which (None: a plain total).

    Expects columns expected, actual, measured, attested, conflict.
    """
    said, stated = F.col(label), is_directional(label)
    agrees = lambda other: stated & (said == F.col(other))
    return {
        "stated_claims": (stated, None),
        "base_rate_pct": (stated & (F.col("expected") == F.col("actual")), stated),
        "input_pct": (agrees("actual"), stated),
        "reference_pct": (agrees("expected"), stated),
        "conflict_reference_pct": (agrees("expected") & F.col("conflict"), stated & F.col("conflict")),
        "measured_pct": (agrees("measured") & F.col("attested"), stated & F.col("attested")),
    }


class WeightedFigures:
    """Figures as ratios of weighted sums, for several readings of the same rows.

    `columns` are the row values to sum, and `values` the figures from their sums;
    whoever sums them, a plain aggregate or a resampling, gets the same figures.
    """

    def __init__(self, readings: dict[str, str], weight: str = "weight"):
        self.columns: dict[str, Column] = {}
        self.values: dict[str, dict[str, Column]] = {}
        for reading, label in readings.items():
            own: dict[str, Column] = {}
            for name, (top, bottom) in claim_figures(label).items():
                sums = []
                for part, condition in (("over", top), ("of", bottom)):
                    if condition is not None:
                        column = f"{reading}_{name}_{part}"
                        self.columns[column] = F.when(condition, F.col(weight)).otherwise(0.0)
                        sums.append(F.col(column))
                own[name] = sums[0] if bottom is None else percent(*sums)
            own["input_over_base_pct"] = own["input_pct"] - own["base_rate_pct"]
            self.values[reading] = own

    def differences(self, first: str, second: str) -> dict[str, Column]:
        return {k: self.values[second][k] - v for k, v in self.values[first].items()}


def reweighted_figures(sample: DataFrame, extractor: str, reader: str) -> DataFrame:
    """Every corpus figure under the extractor's and under the reader's labels."""
    figures = WeightedFigures({"extractor": extractor, "reader": reader})
    sums = sample.withColumns(figures.columns).agg(*[F.sum(c).alias(c) for c in figures.columns])
    gaps = figures.differences("extractor", "reader")
    cells = [
        F.struct(
            F.lit(k).alias("figure"), v.alias("extractor"), figures.values["reader"][k].alias("reader"), gaps[k].alias("difference")
        )
        for k, v in figures.values["extractor"].items()
    ]
    return sums.select(F.inline(F.array(*cells)))


def extraction_errors(sample: DataFrame, extractor: str, reader: str, weights: DataFrame) -> DataFrame:
    """Missed claims, extra calls and wrong signs per stratum, scaled to the corpus stratum by stratum.

    A stratum without sampled rows has no estimate: `corpus_unseen` is how many corpus rows such strata hold.
    """
    e, r = is_directional(extractor), is_directional(reader)
    kinds = {
        "missed": ~e & r,
        "extra": e & ~r,
        "wrong_sign": e & r & (F.col(extractor) != F.col(reader)),
    }
    lab = {"missed": reader, "extra": extractor, "wrong_sign": reader}
    cells = []
    for name, cond in kinds.items():
        said = F.col(lab[name])
        cells.append(
            F.struct(
                F.lit(name).alias("error"),
                F.count_if(cond).alias("cases"),
                F.count_if(cond & (said == F.col("expected"))).alias("on_reference"),
                F.count_if(cond & (said == F.col("actual"))).alias("on_window"),
            )
        )
    per = sample.groupBy(extractor).agg(F.count(F.lit(1)).alias("sampled"), F.array(*cells).alias("_c"))
    flat = match(per.select(extractor, "sampled", F.inline("_c")), weights.select(extractor, "corpus"), [extractor])
    unseen = weights.agg(F.coalesce(F.sum(F.when(F.col("sampled") == 0, F.col("corpus"))), F.lit(0)).alias("corpus_unseen"))
    errors = flat.groupBy("error").agg(
        F.sum("cases").alias("cases"),
        F.sum("on_reference").alias("on_reference"),
        F.sum("on_window").alias("on_window"),
        F.sum(F.col("cases") / F.col("sampled") * F.col("corpus")).alias("corpus_estimate"),
    )
    return match(errors.withColumn("_one", F.lit(1)), unseen.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")


# ------------------------------------------------------------------ data quality
def label_violations(labels: DataFrame, key: DataFrame, id_col: str, label: str, domain: Sequence) -> DataFrame:
    """Counts of duplicate, unlisted, missing and out-of-domain labels; a clean set gives zeros."""
    per_id = labels.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(F.col(label).isin(*domain), F.lit(False))).alias("_bad")
    ).withColumn("_has", F.lit(True))
    joined = key.select(id_col).distinct().withColumn("_key", F.lit(True)).join(per_id, id_col, "full_outer")
    checks = {
        "duplicate": F.count_if(F.col("_n") > 1),
        "missing": F.count_if(F.col("_has").isNull()),
        "unlisted": F.count_if(F.col("_key").isNull()),
        "outside_domain": F.coalesce(F.sum("_bad"), F.lit(0)),
    }
    cells = [F.struct(F.lit(k).alias("check"), v.cast("long").alias("violations")) for k, v in checks.items()]
    return joined.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def join_labels(key: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    return key.join(labels, list(on), "left")


def lookup_unique(sample: DataFrame, claims: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Look up exactly one claim per sample row; `matches` tells where that failed."""
    found = claims.join(sample.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.min(value).alias(value)
    )
    out = sample.join(found, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return out.withColumn(value, F.when(F.col("matches") == 1, F.col(value)))


def rederived_differences(stored: DataFrame, derived: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows whose stored value is not what the text gives today."""
    both = stored.select(*keys, F.col(value).alias("stored")).join(
        derived.select(*keys, F.col(value).alias("derived")), list(keys), "full_outer"
    )
    return both.where(~F.col("stored").eqNullSafe(F.col("derived")))


# ------------------------------------------------------------------ stated numbers
def facts(*tables: tuple[DataFrame, Sequence[str], Sequence[str]]) -> DataFrame:
    """(name, value) of every number in summary tables: table, its key columns, its value columns."""
    parts = []
    for df, keys, values in tables:
        cells = [
            F.struct(
                F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(v)).alias("name"),
                F.col(v).cast("double").alias("value"),
            )
            for v in values
        ]
        parts.append(df.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def audit(stated: DataFrame, known: DataFrame) -> DataFrame:
    """Does each stated number agree with the recomputed fact of the same name?"""
    joined = stated.join(known.select("name", F.col("value").alias("fact")), "name", "left")
    gap = F.abs(F.col("stated") - F.col("fact"))
    near = gap < F.greatest(F.lit(AUDIT_ABS), F.abs("fact") * AUDIT_REL)
    return joined.withColumn("status", F.when(F.col("fact").isNull(), "missing").when(near, "ok").otherwise("mismatch"))


def verify_cells(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Printed table cells against facts, with the tolerance of their printed precision."""
    joined = cells.join(known.select("name", F.col("value").alias("fact")), "name", "left").withColumn("shown", number_in("cell"))
    tolerance = F.when(is_percent("cell"), F.lit(PERCENT_TOLERANCE)).otherwise(F.lit(CELL_TOLERANCE))
    near = F.abs(F.col("shown") - F.col("fact")) <= F.greatest(tolerance, F.abs("fact") * AUDIT_REL)
    status = F.when(F.col("shown").isNull(), "missing").when(F.coalesce(near, F.lit(False)), "ok").otherwise("mismatch")
    return joined.withColumn("status", status)


def phrase_audit(phrases: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """In how many texts does each required phrase occur?

    An inner word of a phrase (space before and after it in the phrase) is a whole
    word of every text that holds the phrase, so texts and phrases meet on each
    phrase's rarest inner word, and only those pairs are compared. Phrases without
    an inner word meet on an inner letter sequence, all GRAM-grams of a text, in
    the same way; those shorter than GRAM meet on all strings of a text that are as short.
    """
    listed = phrases.select("phrase").where("phrase is not null").distinct()
    texts = corpus.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    words = F.array_distinct(F.split("_text", " "))
    inner = F.filter(F.split("phrase", " "), lambda w, i: (i > 0) & (i < F.size(F.split("phrase", " ")) - 1) & (w != ""))
    # one scan of the text: a substring by its position walks there from the text's start
    grams = lambda c, n=GRAM: F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), 1))
    wordy = listed.where(F.size(inner) > 0).withColumn("_k", F.explode(F.array_distinct(inner)))
    gramy = listed.where((F.size(inner) == 0) & (F.length("phrase") >= GRAM)).withColumn("_k", F.explode(grams("phrase")))
    short = listed.where((F.size(inner) == 0) & (F.length("phrase") < GRAM))
    parts = []
    for keyed, own in ((wordy, words), (gramy, F.when(F.length("_text") >= GRAM, grams("_text")))):
        at = texts.select("_id", F.explode(own).alias("_k"))
        wanted = keyed.select("_k").distinct()
        often = at.join(wanted, "_k", "left_semi").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        rarest = match(keyed, often, ["_k"], "left").groupBy("phrase").agg(
            F.min_by("_k", F.coalesce("_n", F.lit(0).cast("long"))).alias("_k")
        )
        near = at.join(rarest, "_k").select("phrase", "_id")
        parts.append(near.join(texts, "_id").where(F.contains("_text", F.col("phrase"))).select("phrase", "_id").distinct())
    pieces = [F.array(F.lit(""))] + [F.when(F.length("_text") >= n, grams("_text", n)).otherwise(F.array(F.lit(""))) for n in range(1, GRAM)]
    tiny = texts.select("_id", F.explode(F.array_distinct(F.concat(*pieces))).alias("phrase"))
    parts.append(tiny.join(short, "phrase").select("phrase", "_id").distinct())
    counts = reduce(DataFrame.unionByName, parts).groupBy("phrase").agg(F.count(F.lit(1)).alias("texts"))
    found = listed.join(counts, "phrase", "left").withColumn("texts", F.coalesce("texts", F.lit(0).cast("long")))
    return found.withColumn("present", F.col("texts") > 0)


def keyword_screen(df: DataFrame, columns: Sequence[str], pattern: str, by: Sequence[str] = ()) -> DataFrame:
    """Records, and records whose joined text fields match a pattern."""
    text = F.lower(F.concat_ws(" ", *columns))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if(text.rlike(pattern)).alias("matching"))


# ------------------------------------------------------------------ incremental work
def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert(summary: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary with the rows of `new` in place of those with the same key."""
    return pending(summary, new, keys).unionByName(new, allowMissingColumns=True)


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only one of two tables has, with the side that has them; empty when the sets are equal."""
    left = a.distinct().exceptAll(b.distinct()).withColumn("only_in", F.lit("a"))
    return left.unionByName(b.distinct().exceptAll(a.distinct()).withColumn("only_in", F.lit("b")))


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def sort_configs(df: DataFrame, *order: str) -> DataFrame:
    """Rows in the order of several keys: a range-partitioned sort."""
    return df.orderBy(*order)
