"""The operators' input tables, derived from the star-schema and text tables.

Every binding keeps all rows of its source. `events` gives trajectories,
`documents` gives responses and explanations, `lineitem` a large prediction table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..operators import claims as cl
from ..operators.frames import apply_minmax, fit_minmax, tail_windows, window_direction, with_life
from ..operators.ordering import positions, split_busy
from ..session import shared, spread

SENSORS = ("s1", "s2", "s3", "s4", "s5", "s6")
SCORED = ("s1", "s2", "s3", "s5", "s6")
SETTINGS = ("setting1", "setting2", "setting3")
CAP = 40
LENGTHS = (5, 15, 30)
QUANTA = (1, 10, 40)
# Word that stands for each scored sensor in the documents, and its asserted direction.
TERMS = {"s1": "the", "s2": "and", "s3": "is", "s5": "de", "s6": "la"}
ASSERTED = {"s1": "increase", "s2": "decrease", "s3": "increase", "s5": "decrease", "s6": "decrease"}
CUED = ("s1", "s2", "s5")
LEXICON = {
    "increase": ("onwh", "thor", "men", "blea"),
    "decrease": ("ndre", "stes", "que", "ound"),
    "stable": ("ting", "ion", "eau", "los"),
}
ARMS = ("repl", "nocue", "invcue", "revdata")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """One row per event: user = unit, event order = cycle, split by the hour for very active users; `life` is the last cycle."""
    e = table(spark, d, "events").select(
        F.when(F.col("user_id") % 2 == 0, "D0").otherwise("D1").alias("dataset"),
        F.col("user_id").alias("unit"),
        "ts",
        "event_id",
        (F.hour("ts") % 3).cast("double").alias("setting1"),
        (F.minute("ts") % 2).cast("double").alias("setting2"),
        F.lit(100.0).alias("setting3"),
        F.col("value").alias("s1"),
        F.get_json_object("props", "$.k").cast("double").alias("s2"),
        F.length("event_type").cast("double").alias("s3"),
        F.lit(1.0).alias("s4"),
    )
    cut = split_busy(e, ["dataset", "unit"], F.date_trunc("hour", "ts"))
    numbered = positions(cut, ["dataset", "unit"], ["ts", "event_id"], F.col("_bucket"), "cycle", "life")
    return numbered.select(
        "dataset",
        "unit",
        "cycle",
        "life",
        *SETTINGS,
        "s1",
        "s2",
        "s3",
        "s4",
        (F.col("cycle") * 0.5 + F.col("s2") * 0.2).alias("s5"),
        (F.col("cycle") * -0.4 + F.col("s1") * 0.1).alias("s6"),
    )


def observed(traj: DataFrame) -> DataFrame:
    """Test view of the units: every unit is seen up to 50–95 % of its life."""
    end = F.floor(F.col("life") * (uniform("censor", F.col("unit")) * 0.45 + 0.5))
    return with_life(traj).where(F.col("cycle") <= end)


def predictions(spark: SparkSession, d: str, traj: DataFrame | None = None) -> DataFrame:
    """Nine run configurations (window n × output quantum q) on every observed unit."""
    seen = observed(traj if traj is not None else trajectories(spark, d))
    tails = tail_windows(seen, LENGTHS)
    means = tails.groupBy("dataset", "unit", "n").agg(
        F.avg("s2").alias("m"), F.first("life").alias("life"), F.max("cycle").alias("last")
    )
    return means.select(
        "dataset",
        "unit",
        "n",
        F.explode(F.array(*[F.lit(q).cast("long") for q in QUANTA])).alias("q"),
        "m",
        F.least(F.lit(CAP), F.col("life") - F.col("last")).cast("double").alias("truth"),
    ).select(
        "dataset", "unit", "n", "q", (F.floor(F.col("m") * 0.8 / F.col("q")) * F.col("q")).cast("double").alias("pred"), "truth"
    )


def replicate_runs(spark: SparkSession, d: str) -> DataFrame:
    """Four repeated runs of one configuration, with run-to-run noise from the draw hash."""
    tails = tail_windows(observed(trajectories(spark, d)), [15])
    means = tails.groupBy("dataset", "unit").agg(F.avg("s2").alias("m"))
    runs = F.explode(F.array(*[F.lit(r) for r in REPLICATES])).alias("run")
    noisy = means.select("dataset", "unit", runs, "m").withColumn("noise", uniform("run", F.col("run"), F.col("unit")) * 16 - 8)
    return noisy.select(
        "dataset", "unit", "run", (F.floor((F.col("m") + F.col("noise")) * 0.8 / 10) * 10).cast("double").alias("pred")
    )


REPLICATES = ("r1", "r2", "r3", "r4")


def line_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Large prediction table: six configurations over every line item."""
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("config"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit"),
        F.col("l_quantity").alias("truth"),
        F.round(F.col("l_discount") * 500, 6).alias("pred"),
    )


def unit_count(spark: SparkSession, d: str) -> int:
    """Number of trajectories the responses are spread over: one number."""
    return table(spark, d, "events").agg(F.max("user_id")).first()[0] + 1


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Explanations: every document is a response about one unit; dataset and source are the run configuration."""
    units = unit_count(spark, d)
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    unit = F.col("doc_id") % units
    dataset = F.when(unit % 2 == 0, "D0").otherwise("D1")
    return documents(spark, d).select(
        F.col("doc_id").alias("resp"),
        dataset.alias("dataset"),
        unit.alias("unit"),
        F.concat_ws("|", dataset, "source").alias("config"),
        F.when(number % 2 == 0, "zero_shot").otherwise("few_shot").alias("mode"),
        F.when(number % 3 == 0, 5).when(number % 3 == 1, 15).otherwise(30).cast("long").alias("n"),
        "text",
    )


def windows(traj: DataFrame) -> DataFrame:
    """Observed tails of every length, scaled with the ranges of the full trajectories."""
    traj = shared(traj)
    scaler = fit_minmax(traj, SENSORS)
    return tail_windows(apply_minmax(observed(traj), scaler, SENSORS), LENGTHS)


def window_directions(spark: SparkSession, d: str, eps: float = 0.01) -> DataFrame:
    return window_direction(windows(trajectories(spark, d)), SCORED, ["dataset", "unit", "n"], eps=eps)


RESPONSE = ("resp", "dataset", "unit", "config", "mode", "n")


def opportunities(spark: SparkSession, d: str, shown: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """Every (response, sensor) pair with the stated, the asserted and the shown direction."""
    said = said or cl.classify(responses(spark, d), list(RESPONSE), "text", TERMS, LEXICON)
    shown = shown or window_directions(spark, d)
    joined = said.join(shown, ["dataset", "unit", "n", "sensor"])
    return cl.score_claims(cl.with_reference(joined, ASSERTED, CUED))


def claims_table(spark: SparkSession, d: str, shown: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """The directional claims, shared by the several passes of an inference."""
    return shared(cl.directional(opportunities(spark, d, shown, said)))


def claims_and_levels(spark: SparkSession, d: str, off_trend: str) -> tuple[DataFrame, DataFrame]:
    """The directional claims, and whether the clauses of each (response, sensor) speak of levels, from one search of the texts."""
    both = cl.classify_with_clauses(responses(spark, d), list(RESPONSE), "text", TERMS, LEXICON, off_trend)
    both = shared(both.drop("clause"))
    return claims_table(spark, d, said=both.drop("off_trend")), both.select("resp", "sensor", "off_trend")


def arm_claims(spark: SparkSession, d: str) -> DataFrame:
    """Four control arms paired on (engine, sensor); one arm is shown its window backwards."""
    units = unit_count(spark, d)
    arm = F.element_at(F.array(*[F.lit(a) for a in ARMS]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = documents(spark, d).select(
        arm.alias("arm"), F.floor(F.col("doc_id") / 4).alias("engine"), "text"
    )
    said = cl.classify(docs, ["arm", "engine"], "text", TERMS, LEXICON)
    shown = window_directions(spark, d).where(F.col("n") == 30).select("unit", "sensor", "actual", "net")
    joined = said.withColumn("unit", F.col("engine") % units).join(shown, ["unit", "sensor"])
    flipped = F.when((F.col("arm") == "revdata") & (F.col("actual") != "stable"), F.when(F.col("actual") == "increase", "decrease").otherwise("increase"))
    joined = joined.withColumn("actual", F.coalesce(flipped, F.col("actual")))
    return cl.score_claims(cl.with_cue(cl.with_reference(joined, ASSERTED, CUED)))
