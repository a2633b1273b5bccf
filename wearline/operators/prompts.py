"""Prompts as tables: sensor blocks, example blocks and templates, rendered per unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import describe_rul
from .frames import UNIT, lag_labels


def render_block(window: DataFrame, sensors: Sequence[str], n: int, by: Sequence[str] = UNIT, back: str = "back") -> DataFrame:
    """One text block per window: a line per row, '  t-5: s2=0.123  s3=…', oldest first.

    A window holds at most n rows, so the collected lines are bounded.
    """
    cells = [F.format_string(f"{s}=%.3f", F.round(F.col(s), 3)) for s in sensors]
    line = F.concat(F.lit("  "), F.col("label"), F.lit(": "), F.concat_ws("  ", *cells))
    rows = lag_labels(window, n, by, back).select(*by, F.struct((-F.col("lag")).alias("o"), line.alias("line")).alias("r"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r")).select(
        *by, F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("block")
    )


def example_block(examples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Numbered few-shot examples joined into one text; needs columns slot, rul and block."""
    text = F.concat(
        F.lit("Example "), F.col("slot").cast("string"), F.lit(" — True RUL: "), F.col("rul").cast("string"),
        F.lit("\nSensor readings:\n"), F.col("block"), F.lit("\nPattern: "), describe_rul("rul"), F.lit("\n"),
    )
    rows = examples.select(*by, F.struct("slot", text.alias("t")).alias("r"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r")).select(
        *by, F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("examples")
    )


def fill(template, values: dict[str, Column]) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def arm_template(template: str, cue: str, arms: dict[str, str | None], arm: str = "arm") -> tuple[Column, Column]:
    """The template of each control arm, and whether its cue really is in it.

    `arms` maps an arm to the sentence that replaces the cue; None leaves the template alone.
    """
    out, present = F.lit(template), F.lit(True)
    for name, sentence in arms.items():
        text = template if sentence is None else template.replace(cue, sentence)
        out = F.when(F.col(arm) == name, F.lit(text)).otherwise(out)
        present = F.when(F.col(arm) == name, F.lit((cue if sentence is None else sentence) in text and cue in template)).otherwise(present)
    return out, present


def render_prompts(blocks: DataFrame, template: str, cue: str, arms: dict[str, str | None], n: int) -> DataFrame:
    """One prompt per (unit, arm) with a drift flag for a cue that is not in the template any more."""
    rows = blocks.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    text, present = arm_template(template, cue, arms)
    values = {"dataset": F.col("dataset"), "n": F.lit(str(n)), "sensor_block": F.col("block")}
    return rows.select("dataset", "unit", "arm", fill(text, values).alias("prompt"), present.alias("cue_present"))
