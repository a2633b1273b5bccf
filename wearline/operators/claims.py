"""From explanations to scored claims: what a text says about each sensor, against three references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import direction_of, is_directional, mean_flag, opposite, percent, ratio
from ..session import shared
from .frames import row_positions
from .ordering import exact_percentile, match


def _literal_map(values: Mapping[str, str]) -> Column:
    """Lookup in a fixed, parameter-sized map; stays inside the projection, no join."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# ------------------------------------------------------------------ text to verdicts
def _with_mentions(df: DataFrame, keys: Sequence[str], text: str, terms: Mapping[str, str], before: int, after: int) -> DataFrame:
    """The keys and `_m`, the contexts of all mentions of all terms; the text itself is dropped."""
    lefts, rights = tx.lefts_and_rights(text, list(terms.values()), before, after)
    return df.select(*keys, lefts.alias("_l"), rights.alias("_r")).select(*keys, tx.mentions("_l", "_r").alias("_m"))


def _per_term(df, keys, terms: Mapping[str, str], make) -> DataFrame:
    cells = [F.struct(F.lit(s).alias("sensor"), *make(i, t)) for i, (s, t) in enumerate(terms.items())]
    return df.select(*keys, F.inline(F.array(*cells)))


def classify(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    terms: Mapping[str, str],
    lexicon: Mapping[str, Sequence[str]] = tx.DIRECTION_WORDS,
    before: int = tx.BEFORE,
    after: int = tx.AFTER,
) -> DataFrame:
    """One row per (text, sensor): the direction the text states, with its number of mentions.

    The terms are a fixed list, so each text yields a fixed number of rows in a
    projection: no join, no shuffle, and the text itself is dropped at once.
    """
    cut = _with_mentions(df, keys, text, terms, before, after)
    own = [tx.own_mentions("_m", t).alias(f"_o{i}") for i, t in enumerate(terms.values())]
    return _per_term(cut.select(*keys, *own), keys, terms, _verdict(lexicon, before, after))


def _verdict(lexicon: Mapping[str, Sequence[str]], before: int, after: int):
    """Makes the columns of `classify` from the i-th term's own mentions."""
    return lambda i, t: (
        tx.strongest(f"_o{i}", tx.in_context(t, before, after, lambda b, m, a, _l, _r: tx.clause(b, m, a)), lexicon).alias("claimed"),
        F.size(f"_o{i}").cast("long").alias("mentions"),
    )


def _clauses(own: str, term: str, before: int, after: int) -> Column:
    found = F.transform(own, tx.in_context(term, before, after, lambda b, m, a, _l, _r: tx.clause(b, m, a)))
    return F.array_join(found, " || ").alias("clause")


def matched_clauses(
    df: DataFrame, keys: Sequence[str], text: str, terms: Mapping[str, str], off_trend: str = tx.OFF_TREND
) -> DataFrame:
    """The clause around every mention, joined by ' || ', and whether it talks of levels rather than trends."""
    cut = _with_mentions(df, keys, text, terms, tx.BEFORE, tx.AFTER)
    own = [tx.own_mentions("_m", t).alias(f"_o{i}") for i, t in enumerate(terms.values())]
    make = lambda i, t: (_clauses(f"_o{i}", t, tx.BEFORE, tx.AFTER),)
    return _per_term(cut.select(*keys, *own), keys, terms, make).withColumn("off_trend", F.col("clause").rlike(off_trend))


def classify_with_clauses(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    terms: Mapping[str, str],
    lexicon: Mapping[str, Sequence[str]] = tx.DIRECTION_WORDS,
    off_trend: str = tx.OFF_TREND,
) -> DataFrame:
    """`classify` and `matched_clauses` side by side, from one search for the mentions."""
    cut = _with_mentions(df, keys, text, terms, tx.BEFORE, tx.AFTER)
    own = [tx.own_mentions("_m", t).alias(f"_o{i}") for i, t in enumerate(terms.values())]
    verdict = _verdict(lexicon, tx.BEFORE, tx.AFTER)
    make = lambda i, t: (*verdict(i, t), _clauses(f"_o{i}", t, tx.BEFORE, tx.AFTER))
    return _per_term(cut.select(*keys, *own), keys, terms, make).withColumn("off_trend", F.col("clause").rlike(off_trend))


def reader_contexts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    terms: Mapping[str, str],
    before: int = tx.READER_BEFORE,
    after: int = tx.READER_AFTER,
    cap: int | None = None,
) -> DataFrame:
    """What a human reader is shown: wider contexts with ellipses, line breaks as spaces, and the mention count.

    Whole contexts, unless `cap` asks for a number of characters (the original sheet had tx.READER_CAP).
    """

    def shown(b, m, a, more_left, more_right):
        body = F.translate(F.concat(b, m, a), "\n", " ")
        return F.concat(F.when(more_left, "...").otherwise(""), body, F.when(more_right, "...").otherwise(""))

    cut = _with_mentions(df, keys, text, terms, before, after)
    shown_to_reader = [tx.per_mention("_m", t, before, after, shown).alias(f"_c{i}") for i, t in enumerate(terms.values())]

    def make(i, _t):
        joined = F.array_join(f"_c{i}", " || ")
        return (
            F.size(f"_c{i}").cast("long").alias("mentions"),
            (F.left(joined, F.lit(cap)) if cap else joined).alias("context"),
        )

    return _per_term(cut.select(*keys, *shown_to_reader), keys, terms, make)


# ------------------------------------------------------------------ references and flags
def with_reference(df: DataFrame, asserted: Mapping[str, str], cued: Sequence[str]) -> DataFrame:
    """Asserted direction and cue flag per sensor."""
    return df.withColumn("expected", F.element_at(_literal_map(asserted), F.col("sensor"))).withColumn(
        "cued", F.col("sensor").isin(*cued)
    )


def cue_direction(arm="arm", cued="cued", expected="expected", none=("nocue",), inverted=("invcue",)) -> Column:
    """Direction this arm's prompt tells the reader to expect, null where it gives no cue."""
    no_cue = F.col(arm).isin(*none) | ~F.col(cued)
    return F.when(~no_cue, F.when(F.col(arm).isin(*inverted), opposite(expected)).otherwise(F.col(expected)))


def with_cue(df: DataFrame) -> DataFrame:
    return df.withColumn("cue_says", cue_direction())


def score_claims(df: DataFrame) -> DataFrame:
    """Hit flags; a pair without a directional claim keeps its row with directional = false."""
    out = df.withColumns(
        {
            "directional": is_directional("claimed"),
            "reference_hit": F.col("claimed") == F.col("expected"),
            "input_hit": F.col("claimed") == F.col("actual"),
            "base_hit": F.col("expected") == F.col("actual"),
        }
    )
    if "cue_says" in df.columns:
        out = out.withColumn("cue_hit", F.col("claimed") == F.col("cue_says"))
    return out


def directional(claims: DataFrame) -> DataFrame:
    return claims.where(is_directional("claimed"))


def with_directions(claims: DataFrame, directions: DataFrame) -> DataFrame:
    """Measured direction of the claim's (dataset, sensor); Spark's size threshold picks the join."""
    return claims.join(directions, ["dataset", "sensor"])


# ------------------------------------------------------------------ faithfulness
def _block() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("claims"),
        (mean_flag("reference_hit") * 100).alias("reference_pct"),
        (mean_flag("input_hit") * 100).alias("input_pct"),
        (mean_flag("base_hit") * 100).alias("base_pct"),
    ]


def faithfulness(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Agreement with the reference, with the shown window, and the base rate on the same claims."""
    return directional(claims).groupBy(*by).agg(*_block())


def faithfulness_breakdown(claims: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same block for several groupings in one pass; `level` names the grouping."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    d = directional(claims)
    grouped = d.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    out = grouped.agg(F.grouping_id().alias("_gid"), *_block())
    names = {}
    for s in sets:
        gid = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s)
        names[gid] = "+".join(s) or "all"
    level = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("_gid").cast("int"))
    return out.withColumn("level", level).drop("_gid")


def threshold_sweep(claims: DataFrame, eps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Input faithfulness and base rate when the 'stable' threshold moves.

    Claims are first counted by (claimed, expected, net), so the sweep multiplies counts, not claims.
    """
    cells = directional(claims).groupBy(*by, "claimed", "expected", "net").agg(F.count(F.lit(1)).alias("n"))
    swept = cells.withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in eps])))
    swept = swept.withColumn("shown", direction_of("net", F.col("eps")))
    hit = lambda c: percent(F.sum(F.when(F.col(c) == F.col("shown"), F.col("n")).otherwise(0)), F.sum("n"))
    return swept.groupBy(*by, "eps").agg(
        F.sum("n").alias("claims"),
        percent(F.sum(F.when(F.col("shown") == "stable", F.col("n")).otherwise(0)), F.sum("n")).alias("stable_pct"),
        hit("claimed").alias("input_pct"),
        hit("expected").alias("base_pct"),
    )


def direction_counts(claims: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """Stated against shown directions, wide."""
    outs = []
    for name in ("increase", "decrease"):
        outs.append(F.count_if(F.col("claimed") == name).alias(f"claimed_{name}"))
    for name in ("increase", "decrease", "stable"):
        outs.append(F.count_if(F.col("actual") == name).alias(f"actual_{name}"))
    return directional(claims).groupBy(*by).agg(*outs)


def tally_mentions(claims: DataFrame) -> DataFrame:
    """Per sensor and in total: how often the text is right, wrong, stable, unspecified or silent."""
    right = F.col("claimed") == F.col("expected")
    kinds = {
        "correct": right,
        "wrong": is_directional("claimed") & ~right,
        "stable": F.col("claimed") == "stable",
        "unspecified": F.col("claimed") == "unspecified",
        "absent": F.col("claimed") == "absent",
    }
    counts = [F.count_if(cond).alias(name) for name, cond in kinds.items()]
    out = claims.rollup("sensor").agg(F.grouping("sensor").alias("_g"), F.count(F.lit(1)).alias("texts"), *counts)
    said = F.col("texts") - F.col("absent")
    return out.select(
        F.when(F.col("_g") == 1, "ALL").otherwise(F.col("sensor")).alias("sensor"),
        "texts",
        *kinds,
        percent(said, "texts").alias("mention_pct"),
        percent("correct", said).alias("correct_pct"),
        percent("wrong", said).alias("wrong_pct"),
    )


def follow_rates(claims: DataFrame, directions: DataFrame) -> DataFrame:
    """How often claims follow the prompt, the measured direction and the window.

    Rows: all claims, attested only, conflict only, and every (dataset, sensor).
    """
    d = with_directions(directional(claims), directions)
    scopes = F.filter(
        F.array(
            F.struct(F.lit("all").alias("scope"), F.lit("").alias("part")),
            F.when(F.col("attested"), F.struct(F.lit("attested").alias("scope"), F.lit("").alias("part"))),
            F.when(F.col("conflict"), F.struct(F.lit("conflict").alias("scope"), F.lit("").alias("part"))),
            F.struct(F.lit("sensor").alias("scope"), F.concat_ws("/", "dataset", "sensor").alias("part")),
        ),
        lambda x: x.isNotNull(),
    )
    flags = d.select(
        F.explode(scopes).alias("s"), "claimed", "expected", "measured", "attested", "input_hit", "reference_hit", "base_hit"
    )
    measured_hit = F.when(F.col("attested"), F.col("claimed") == F.col("measured"))
    return flags.groupBy(F.col("s.scope").alias("scope"), F.col("s.part").alias("part")).agg(
        F.count(F.lit(1)).alias("claims"),
        (mean_flag("reference_hit") * 100).alias("prompt_pct"),
        (mean_flag(measured_hit) * 100).alias("data_pct"),
        (mean_flag("input_hit") * 100).alias("window_pct"),
        (mean_flag("base_hit") * 100).alias("base_pct"),
    )


# ------------------------------------------------------------------ arms
def pair_arms(claims: DataFrame, first: str, second: str, keys: Sequence[str], values: Sequence[str], arm: str = "arm") -> DataFrame:
    """Rows present in both arms side by side: `value_a`, `value_b`. One grouping, no self join."""
    two = claims.where(F.col(arm).isin(first, second))
    cells = []
    for v in values:
        cells += [
            F.max(F.when(F.col(arm) == first, F.col(v))).alias(f"{v}_a"),
            F.max(F.when(F.col(arm) == second, F.col(v))).alias(f"{v}_b"),
        ]
    wide = two.groupBy(*keys).agg(*cells)
    return wide.dropna(subset=[f"{v}_{s}" for v in values for s in ("a", "b")])


def arm_table(claims: DataFrame, baseline: str = "repl") -> DataFrame:
    """Cued claims per arm: how many, agreement with the reference and with this arm's cue, change in number."""
    cued = directional(claims).where("cued")
    per_arm = cued.groupBy("arm").agg(
        F.count(F.lit(1)).alias("claims"),
        (mean_flag("reference_hit") * 100).alias("reference_pct"),
        (mean_flag("cue_hit") * 100).alias("cue_pct"),
    )
    # One row per arm is left, so one small window holds them.
    base = F.max(F.when(F.col("arm") == baseline, F.col("claims"))).over(Window.partitionBy(F.lit(1)))
    return per_arm.withColumn("fewer_pct", (F.lit(1.0) - ratio("claims", base)) * 100)


def trend_reversals(claims: DataFrame, first: str = "repl", second: str = "revdata", keys=("engine", "sensor")) -> DataFrame:
    """Pairs with a claim in both arms whose shown trend reversed, and whether the claim changed."""
    pairs = pair_arms(directional(claims), first, second, keys, ["claimed", "actual"])
    return pairs.where(
        (F.col("actual_a") != F.col("actual_b")) & is_directional("actual_a") & is_directional("actual_b")
    ).withColumn("changed", F.col("claimed_a") != F.col("claimed_b"))


def reversal_summary(reversals: DataFrame) -> DataFrame:
    out = reversals.rollup("sensor").agg(
        F.grouping("sensor").alias("_g"), F.count(F.lit(1)).alias("pairs"), F.count_if("changed").alias("changed")
    )
    return out.select(
        F.when(F.col("_g") == 1, "ALL").otherwise(F.col("sensor")).alias("sensor"),
        "pairs",
        "changed",
        percent("changed", "pairs").alias("changed_pct"),
    )


def worked_example(reversals: DataFrame) -> DataFrame:
    """Per sensor, the lowest engine whose trend reversed while its claim stayed."""
    kept = reversals.where(~F.col("changed"))
    pick = F.min(F.struct("engine", "claimed_a", "actual_a", "actual_b")).alias("x")
    return kept.groupBy("sensor").agg(pick).select("sensor", "x.*")


# ------------------------------------------------------------------ measured directions
def sensor_rank_correlation(long: DataFrame, target: str, min_rows: int = 10, keys=("dataset", "sensor", "unit")) -> DataFrame:
    """Spearman correlation of each sensor with `target` inside each unit; short or constant units are left out."""
    from .rank import spearman_of_many

    rho = spearman_of_many(long, list(keys), "reading", target)
    return rho.where((F.col("n") >= min_rows) & F.col("rho").isNotNull())


def sensor_directions(long: DataFrame, target: str, min_rows: int = 10) -> DataFrame:
    """Measured direction per (dataset, sensor) and the share of units that agree with it.

    `target` is remaining life: a sensor that rises as life runs out correlates negatively.
    """
    per_unit = shared(sensor_rank_correlation(long, target, min_rows))
    median = exact_percentile(per_unit, ["dataset", "sensor"], "rho", {"median_rho": 0.5})
    joined = match(per_unit, median, ["dataset", "sensor"])
    agree = F.signum("rho") == F.signum("median_rho")
    return joined.groupBy("dataset", "sensor").agg(
        F.count(F.lit(1)).alias("units"),
        F.max("median_rho").alias("median_rho"),
        mean_flag(agree).alias("agree_share"),
    ).withColumn("measured", F.when(F.col("median_rho") < 0, "increase").otherwise("decrease"))


def share_rising(
    df: DataFrame, sensors: Sequence[str], head: int = 10, lengths: Sequence[int] = (30, 15, 5), cycle: str = "cycle"
) -> DataFrame:
    """Share of units whose sensor is higher at the end than at the start, over the life and over the last n rows.

    Rows are counted from either end by position, whatever gaps the cycles have.
    """
    placed = row_positions(df, ["dataset", "unit"], cycle)
    rows = match(placed, placed.groupBy("dataset", "unit").agg(F.max("_pos").alias("_rows")), ["dataset", "unit"])
    rows = rows.withColumn("_back", F.col("_rows") - F.col("_pos") + 1)
    rows = rows.where((F.col("_pos") <= head) | (F.col("_back") <= max(head, *lengths)))
    aggs = [F.max("_rows").alias("life")]
    for s in sensors:
        aggs += [
            F.avg(F.when(F.col("_pos") <= head, F.col(s))).alias(f"_{s}_start"),
            F.avg(F.when(F.col("_back") <= head, F.col(s))).alias(f"_{s}_end"),
            F.max(F.when(F.col("_back") == 1, F.col(s))).alias(f"_{s}_last"),
        ]
        aggs += [F.max(F.when(F.col("_back") == n, F.col(s))).alias(f"_{s}_{n}") for n in lengths]
    unit = rows.groupBy("dataset", "unit").agg(*aggs)
    cells = []
    for s in sensors:
        whole = F.when(F.col("life") >= 2 * head, F.col(f"_{s}_end") > F.col(f"_{s}_start"))
        cells.append(
            F.struct(
                F.lit(s).alias("sensor"),
                whole.alias("life_up"),
                *[(F.col(f"_{s}_last") > F.col(f"_{s}_{n}")).alias(f"up{n}") for n in lengths],
            )
        )
    flat = unit.select("dataset", F.inline(F.array(*cells)))
    return flat.groupBy("dataset", "sensor").agg(
        F.count("life_up").alias("units"),
        mean_flag("life_up").alias("rising_life"),
        *[mean_flag(f"up{n}").alias(f"rising_{n}") for n in lengths],
    )


# Fixed value: a direction is attested when this share of units shows it.
ATTESTED = 0.65


def attest(shares: DataFrame, asserted: Mapping[str, str], threshold: float = ATTESTED) -> DataFrame:
    """Measured direction, support, and whether the data attests it and the prompt agrees."""
    up = F.col("rising_life") > 0.5
    out = shares.withColumns(
        {
            "measured": F.when(up, "increase").otherwise("decrease"),
            "support": F.when(up, F.col("rising_life")).otherwise(F.lit(1.0) - F.col("rising_life")),
            "asserted": F.element_at(_literal_map(asserted), F.col("sensor")),
        }
    )
    out = out.withColumn("attested", F.col("support") >= threshold)
    same = F.col("measured") == F.col("asserted")
    return out.withColumn("conflict", F.col("attested") & ~same).withColumn(
        "grouping", F.when(~F.col("attested"), "unattested").when(same, "agree").otherwise("conflict")
    )


def attestation_groups(shares: DataFrame, asserted: Mapping[str, str], thresholds: Sequence[float]) -> DataFrame:
    """Sensors that agree, conflict or are unattested per dataset, at each threshold."""
    parts = [attest(shares, asserted, t).withColumn("threshold", F.lit(float(t))) for t in thresholds]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("threshold", "dataset", "grouping").agg(
        F.array_join(F.sort_array(F.collect_set("sensor")), ",").alias("sensors"), F.count(F.lit(1)).alias("n")
    )
