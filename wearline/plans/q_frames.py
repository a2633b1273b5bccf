"""Queries on trajectories: labels, scaling, windows, features (survey ids B, E and the parts of A, C they need)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import claims as cl
from ..operators import frames as fr
from ..operators import prompts as pr
from ..operators import sampling as sp
from ..operators.ordering import match, value_positions
from ..session import staging_path
from ..sources import files
from . import bindings as b
from .oracle import RANGES, d6, h, long, sql
from .registry import query

S4 = ("s1", "s2", "s3", "s4")


@query(
    "A2_terminal_labels",
    sql(
        "obs",
        """select dataset, unit, last, cast(pos as bigint) as pos, cast(rul as double) as rul from (
        select dataset, unit, last, life, row_number() over (partition by dataset order by unit) as pos from (
          select dataset, unit, max(cycle) as last, max(life) as life from obs group by all))
        left join (select dataset, pos, rul from (select dataset, life-last as rul,
          row_number() over (partition by dataset order by unit) as pos from (
          select dataset, unit, max(cycle) as last, max(life) as life from obs group by all))) using (dataset, pos)""",
    ),
)
def terminal_labels(spark, d):
    """The label list of a dataset, written one label to a line, read back and joined to the units in ascending id."""
    obs = b.observed(b.trajectories(spark, d))
    last = obs.groupBy("dataset", "unit").agg(F.max("cycle").alias("last"), F.max("life").alias("life"))
    lines = value_positions(last, ["dataset"], "unit").select(
        "dataset", "pos", (F.col("life") - F.col("last")).cast("double").alias("rul")
    )
    path = staging_path(spark)
    files.write_label_lines(lines, path)
    labels = files.read_terminal_labels(spark, path)
    return fr.attach_terminal_labels(last.drop("life"), labels).select("dataset", "unit", "last", "pos", "rul")


@query("B1_rul_label", sql("train", "select dataset, unit, cycle, cast(rul as bigint) as rul from train"))
def rul_label(spark, d):
    return fr.with_rul(b.trajectories(spark, d), b.CAP).select("dataset", "unit", "cycle", "rul")


@query(
    "B2_last_observation",
    sql(
        "traj",
        f"""select dataset, unit, max(cycle) as cycle, {d6('arg_max(s1,cycle)', 's1')}, {d6('arg_max(s2,cycle)', 's2')},
        {d6("arg_max(case when s3<>5 then s3 end, case when s3<>5 then cycle end)", 's3')} from traj group by all""",
    ),
)
def last_observation(spark, d):
    """Last non-null value per column: s3 is made null in part of the rows."""
    holes = b.trajectories(spark, d).withColumn("s3", F.when(F.col("s3") != 5, F.col("s3")))
    return fr.last_observation(holes, ["s1", "s2", "s3"])


@query(
    "B3_minmax_scaling",
    sql(
        "obs",
        "select dataset, unit, cycle, "
        + ", ".join(
            d6(f"({s}-{s}_min)/(case when {s}_max={s}_min then 1e0 else {s}_max-{s}_min end)", s) for s in b.SENSORS
        )
        + f" from obs join (select dataset, {RANGES} from traj group by 1) using (dataset)",
    ),
)
def minmax_scaling(spark, d):
    """Fit on full trajectories, apply to the observed ones, no clipping; s4 is constant."""
    traj = b.trajectories(spark, d)
    scaled = fr.apply_minmax(b.observed(traj), fr.fit_minmax(traj, b.SENSORS), b.SENSORS)
    return scaled.select("dataset", "unit", "cycle", *b.SENSORS)


@query(
    "B5_minmax_by_regime",
    sql(
        "obs",
        f"""select dataset, unit, cycle, cast(setting1 as bigint) as regime,
        {', '.join(d6(f"case when {s}_max is null then null else greatest(0,least(1,({s}-{s}_min)/(case when {s}_max={s}_min then 1e0 else {s}_max-{s}_min end))) end", s) for s in S4)}
        from obs left join (select dataset, setting1, {RANGES} from traj where not (dataset='D1' and setting1=2) group by all)
        using (dataset, setting1)""",
    ),
)
def minmax_by_regime(spark, d):
    """Ranges per regime, clipped to [0, 1]; a regime without training rows stays null."""
    traj = b.trajectories(spark, d).withColumn("regime", F.col("setting1").cast("long"))
    known = traj.where(~((F.col("dataset") == "D1") & (F.col("regime") == 2)))
    obs = b.observed(b.trajectories(spark, d)).withColumn("regime", F.col("setting1").cast("long"))
    scaler = fr.fit_minmax(known, S4, ["dataset", "regime"])
    return fr.apply_minmax(obs, scaler, S4, ["dataset", "regime"], clip=True).select("dataset", "unit", "cycle", "regime", *S4)


@query(
    "B6_constant_columns",
    sql(
        "traj",
        """select dataset, array_to_string(list_sort(c),',') as constant,
        array_to_string(list_sort(list_filter(c, lambda x: not list_contains(['s3','s4'],x))),',') as not_listed,
        array_to_string(list_sort(list_filter(['s3','s4'], lambda x: not list_contains(c,x))),',') as not_constant
        from (select dataset, list_filter(["""
        + ",".join(f"case when count(distinct {c})<=1 then '{c}' end" for c in (*b.SETTINGS, *b.SENSORS))
        + """], lambda x: x is not null) as c from traj group by 1)""",
    ),
)
def constant_columns(spark, d):
    out = fr.constant_columns(b.trajectories(spark, d), [*b.SETTINGS, *b.SENSORS], ["s3", "s4"])
    return out.select("dataset", *[F.array_join(c, ",").alias(c) for c in ("constant", "not_listed", "not_constant")])


@query(
    "B7_tail_window",
    sql("tails", "select dataset, unit, cycle, cast(back as bigint) as back, round(s1,6) as s1 from tails where n=30"),
)
def tail_window(spark, d):
    obs = b.observed(b.trajectories(spark, d))
    return fr.tail_window(obs, 30).select("dataset", "unit", "cycle", "back", "s1")


@query(
    "B8_reverse_window",
    sql(
        "tails",
        """select dataset, unit, cycle, cast(max(back) over (partition by unit)+1-back as bigint) as back, round(s1,6) as s1
        from tails where n=15""",
    ),
)
def reverse_window(spark, d):
    obs = b.observed(b.trajectories(spark, d))
    return fr.reverse_window(fr.tail_window(obs, 15)).select("dataset", "unit", "cycle", "back", "s1")


@query("B9_window_direction", sql("wdir", "select dataset, unit, n, sensor, round(net,6) as net, actual from wdir"))
def window_direction(spark, d):
    return b.window_directions(spark, d)


@query(
    "B10_B11_B12_clip_bin_describe",
    sql(
        "",
        """select l_orderkey, l_linenumber::bigint as l_linenumber, greatest(0, least(125, x)) as clipped,
        case when y<=40 then 0 when y<=80 then 1 when y<=125 then 2 end::bigint as bin,
        case when y>80 then 'stable operation; sensors near baseline'
             when y>40 then 'progressive degradation; moderate drift in key sensors'
             else 'advanced wear; significant deviation in efficiency sensors' end as tier
        from (select *, round(l_discount*2000-50,6) as x, l_quantity*2.5e0 as y from lineitem)""",
    ),
)
def clip_bin_describe(spark, d):
    li = b.table(spark, d, "lineitem")
    x, y = F.round(F.col("l_discount") * 2000 - 50, 6), F.col("l_quantity") * 2.5
    return li.select(
        "l_orderkey", "l_linenumber", nm.clip(x, 0, 125).alias("clipped"), nm.bin_rul(y).alias("bin"), nm.describe_rul(y).alias("tier")
    )


@query(
    "B13_composite_keys",
    sql(
        "preds",
        """select dataset||'-'||unit as engine, dataset||'|zero_shot|k'||q||'|n'||n||'|run1' as config, pred from preds""",
    ),
)
def composite_keys(spark, d):
    p = b.predictions(spark, d).withColumn("mode", F.lit("zero_shot")).withColumn("run", F.lit("run1"))
    return p.select(fr.engine_key().alias("engine"), fr.config_key(k="q", n="n").alias("config"), "pred")


@query(
    "B14_cue_direction",
    sql("arms", "select arm, sensor, cued, expected, min(cue_says) as cue_says, count(*) as pairs from arms group by all"),
)
def cue_direction(spark, d):
    claims = b.arm_claims(spark, d)
    return claims.groupBy("arm", "sensor", "cued", "expected").agg(F.min("cue_says").alias("cue_says"), F.count(F.lit(1)).alias("pairs"))


@query(
    "B15_common_grid",
    sql("", "select config, value, count(*) as count from (select l_returnflag as config, round_even(l_quantity*0.5e0,0) as value from lineitem) group by all"),
)
def common_grid(spark, d):
    """Half-even rounding before values are counted."""
    li = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("config"), (F.col("l_quantity") * 0.5).alias("pred"))
    return li.groupBy("config", nm.to_grid("pred", 1.0).alias("value")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "B16_claim_flags",
    sql(
        "arms",
        "select arm, engine, sensor, claimed, directional, reference_hit, input_hit, base_hit, cue_hit from arms",
    ),
)
def claim_flags(spark, d):
    return b.arm_claims(spark, d).select(
        "arm", "engine", "sensor", "claimed", "directional", "reference_hit", "input_hit", "base_hit", "cue_hit"
    )


FEATURES = ("s1", "s2", "s5")


@query(
    "E1_sliding_features",
    sql(
        "train",
        "select dataset, unit, cycle, cast(rul as bigint) as rul, "
        + ", ".join(f"{d6(f'{c}_m', f'{c}_mean')}, {d6(f'{c}_d', f'{c}_sd')}, {d6(f'{c}_f', f'{c}_net')}" for c in FEATURES)
        + " from (select *, count(*) over w as k, "
        + ", ".join(f"avg({c}) over w as {c}_m, stddev_pop({c}) over w as {c}_d, {c}-first_value({c}) over w as {c}_f" for c in FEATURES)
        + " from train window w as (partition by unit order by cycle rows between 29 preceding and current row)) where k=30",
    ),
)
def sliding_features(spark, d):
    train = fr.with_rul(b.trajectories(spark, d), b.CAP)
    return fr.sliding_features(train, FEATURES, 30, keep=["rul"])


@query(
    "E2_tail_features",
    sql(
        "tails",
        "select dataset, unit, cast(r as bigint) as rows, "
        + ", ".join(
            f"{d6(f'm_{c}', f'{c}_mean')}, {d6(f'sqrt(greatest(0,q_{c}-m_{c}*m_{c}))', f'{c}_sd')}, {d6(f'l_{c}-case when r<30 then 0 else f_{c} end', f'{c}_net')}"
            for c in FEATURES
        )
        + " from (select dataset, unit, count(*) as r, "
        + ", ".join(
            f"sum({c})/30e0 as m_{c}, sum({c}*{c})/30e0 as q_{c}, arg_min({c},back) as l_{c}, arg_max({c},back) as f_{c}" for c in FEATURES
        )
        + " from tails where n=30 group by all)",
    ),
)
def tail_features(spark, d):
    """Short units are padded with zero rows, as the predictors were fed."""
    return fr.tail_features(b.observed(b.trajectories(spark, d)), FEATURES, 30)


@query(
    "E3_sequences",
    sql(
        "train",
        """select dataset, unit, cycle, cast(rul as bigint) as rul, array_to_string(list_transform(list(round(s2,3)) over w, lambda x: cast(x as bigint)),',') as s2_path
        from train window w as (partition by unit order by cycle rows between 29 preceding and current row)
        qualify count(*) over w = 30""",
    ),
)
def sequences(spark, d):
    train = fr.with_rul(b.trajectories(spark, d), b.CAP)
    seq = fr.sequences(train, ["s2", "s3"], 30, keep=["rul"])
    path = F.array_join(F.transform("sequence", lambda r: r[0].cast("long").cast("string")), ",")
    return seq.select("dataset", "unit", "cycle", "rul", path.alias("s2_path"))


@query(
    "E3_padded_test_sequences",
    sql(
        "tails",
        """select dataset, unit, array_to_string(list_concat(list_transform(range(0, 30-count(*)), lambda x: 0::bigint),
        list(cast(s2 as bigint) order by cycle)),',') as s2_path from tails where n=30 group by all""",
    ),
)
def padded_sequences(spark, d):
    seq = fr.tail_sequences(b.observed(b.trajectories(spark, d)), ["s2", "s3"], 30)
    path = F.array_join(F.transform("sequence", lambda r: r[0].cast("long").cast("string")), ",")
    return seq.select("dataset", "unit", path.alias("s2_path"))


@query("E4_eligible_cuts", sql("train", "select dataset, unit, count(*) as cuts, cast(min(rul) as bigint) as low, cast(max(rul) as bigint) as high from train where cycle>=30 group by all"))
def eligible_cuts(spark, d):
    train = fr.with_rul(b.trajectories(spark, d), b.CAP)
    return fr.eligible_cuts(train, 30).groupBy("dataset", "unit").agg(
        F.count(F.lit(1)).alias("cuts"), F.min("rul").alias("low"), F.max("rul").alias("high")
    )


@query(
    "E5_lag_labels",
    sql(
        "tails",
        """select dataset, unit, cycle, cast(30-(max(back) over (partition by unit)-back) as bigint) as lag,
        't-'||(30-(max(back) over (partition by unit)-back)) as label from tails where n=30""",
    ),
)
def lag_labels(spark, d):
    tail = fr.tail_window(b.observed(b.trajectories(spark, d)), 30)
    return fr.lag_labels(tail, 30).select("dataset", "unit", "cycle", "lag", "label")


@query(
    "C1_windows_of_responses",
    sql(
        "resp wdir",
        "select resp, r.dataset, r.unit, r.config, r.n, sensor, actual, round(net,6) as net from resp r join wdir w on r.dataset=w.dataset and r.unit=w.unit and r.n=w.n",
    ),
)
def windows_of_responses(spark, d):
    """Each response with the directions of the window it was shown: windows once per (unit, n), then one join."""
    shown = b.window_directions(spark, d)
    return b.responses(spark, d).drop("text").join(shown, ["dataset", "unit", "n"]).select(
        "resp", "dataset", "unit", "config", "n", "sensor", "actual", "net"
    )


BLOCK = """select dataset, unit, string_agg('  t-'||lag||': s1='||printf('%.3f',round(s1,3))||'  s2='||printf('%.3f',round(s2,3)), chr(10) order by cycle) as block
        from (select *, {n}-(max(back) over (partition by unit)-back) as lag from tails where n={n}) group by all"""


@query("I6_sensor_block", sql("tails", BLOCK.format(n=15)))
def sensor_block(spark, d):
    return pr.render_block(fr.tail_window(b.observed(b.trajectories(spark, d)), 15), ["s1", "s2"], 15)


TEMPLATE = "Dataset {dataset}, last {n} cycles. Worn units show rising s1.\n{sensor_block}\nGive RUL_ESTIMATE and REASONING."
CUE = "Worn units show rising s1."
PROMPT_ARMS = {"repl": None, "nocue": "", "invcue": "Worn units show falling s1."}


@query(
    "I7_prompts",
    sql(
        "tails",
        "select dataset, unit, arm, 'Dataset '||dataset||', last 15 cycles. '||cue||chr(10)||block||chr(10)||'Give RUL_ESTIMATE and REASONING.' as prompt, true as cue_present"
        f" from ({BLOCK.format(n=15)}), (values ('repl','{CUE}'),('nocue',''),('invcue','Worn units show falling s1.')) a(arm,cue)",
    ),
)
def prompts(spark, d):
    blocks = pr.render_block(fr.tail_window(b.observed(b.trajectories(spark, d)), 15), ["s1", "s2"], 15)
    return pr.render_prompts(blocks, TEMPLATE, CUE, PROMPT_ARMS, 15)


SHOTS, SHOT_EDGES = 5, (0, 13, 26, 40)
SHOT_TEMPLATE = "Dataset {dataset}, last {n} cycles.\n{examples}\n{sensor_block}\nGive RUL_ESTIMATE and REASONING."
SHOT_BIN = "case when rul<=13 then 0 when rul<=26 then 1 else 2 end"
SHOT_TIER = f"case when rul>80 then '{nm.TIER_HEALTHY}' when rul>40 then '{nm.TIER_MIDDLE}' else '{nm.TIER_WORN}' end"


@query(
    "I7_few_shot_prompts",
    sql(
        "train tails",
        f"""select dataset, unit, md5('Dataset '||dataset||', last 15 cycles.'||chr(10)||examples||chr(10)||block||chr(10)||'Give RUL_ESTIMATE and REASONING.') as prompt_md5
        from ({BLOCK.format(n=15)}) join (
        select dataset, string_agg('Example '||slot||' — True RUL: '||rul||chr(10)||'Sensor readings:'||chr(10)||block||chr(10)||'Pattern: '||{SHOT_TIER}||chr(10), chr(10) order by slot) as examples from (
        select s.dataset, slot, s.rul, string_agg('  t-'||(s.cycle-t.cycle+1)||': s1='||printf('%.3f',round(t.s1,3))||'  s2='||printf('%.3f',round(t.s2,3)), chr(10) order by t.cycle) as block
        from shots s join train t on t.dataset=s.dataset and t.unit=s.unit and t.cycle between s.cycle-14 and s.cycle group by all) group by 1) using (dataset)""",
        shots=f"""select *, row_number() over (partition by dataset order by bin, unit, cycle, drawn_cycle) as slot from (
        select d.dataset, d.unit, cast(d.rul as bigint) as rul, bin, d.cycle as drawn_cycle, m.cycle from (
        select *, row_number() over (partition by dataset, bin order by {h('examples', 'dataset', 'unit', 'cycle')}, dataset, unit, cycle) as r from (select *, {SHOT_BIN} as bin from train where cycle>=15)) d
        join (select dataset, unit, rul, max(cycle) as cycle from train where cycle>=15 group by all) m using (dataset, unit, rul) where r<=case when bin<2 then 2 else 1 end)""",
    ),
)
def few_shot_prompts(spark, d):
    """Prompts with five worked examples, drawn evenly over the label range of the unit's dataset."""
    traj = b.trajectories(spark, d)
    train = fr.with_rul(traj, b.CAP).select("dataset", "unit", "cycle", "rul", "s1", "s2")
    picks = sp.stratified_examples(train.select("dataset", "unit", "cycle", "rul"), SHOTS, 15, edges=SHOT_EDGES)
    order = Window.partitionBy("dataset").orderBy("bin", "unit", "cycle", "drawn_cycle")  # a handful of rows each
    shots = picks.withColumn("slot", F.row_number().over(order)).select("dataset", "unit", "slot", "rul", F.col("cycle").alias("until"))
    rows = match(train.drop("rul"), shots, ["dataset", "unit"]).withColumn("back", F.col("until") - F.col("cycle") + 1)
    shown = rows.where((F.col("back") >= 1) & (F.col("back") <= 15))
    blocks = pr.render_block(shown, ["s1", "s2"], 15, ["dataset", "slot", "rul"])
    examples = pr.example_block(blocks, ["dataset"])
    own = pr.render_block(fr.tail_window(b.observed(traj), 15), ["s1", "s2"], 15)
    values = {"dataset": F.col("dataset"), "n": F.lit("15"), "examples": F.col("examples"), "sensor_block": F.col("block")}
    return match(own, examples, ["dataset"]).select("dataset", "unit", F.md5(pr.fill(SHOT_TEMPLATE, values)).alias("prompt_md5"))


@query(
    "D27_sensor_directions",
    sql(
        "train",
        f"""select dataset, sensor, count(*) as units, {d6('max(med)', 'median_rho')}, {d6('avg(cast(sign(rho)=sign(med) as int))', 'agree_share')}, case when max(med)<0 then 'increase' else 'decrease' end as measured from (
        select *, median(rho) over (partition by dataset, sensor) as med from (
        select dataset, sensor, unit, corr(rx, ry) as rho from (
        select *, rank() over (partition by unit, sensor order by reading)+(count(*) over (partition by unit, sensor, reading)-1)/2e0 as rx,
        rank() over (partition by unit, sensor order by rul)+(count(*) over (partition by unit, sensor, rul)-1)/2e0 as ry
        from ({long('train', 'dataset, unit, rul', b.SCORED)})) group by all having count(*)>=10 and count(distinct rx)>1 and count(distinct ry)>1)) group by all""",
    ),
)
def sensor_directions(spark, d):
    train = fr.with_rul(b.trajectories(spark, d), b.CAP)
    return cl.sensor_directions(fr.long_sensors(train, ["dataset", "unit", "rul"], b.SCORED), "rul")


SHARES = f"""select dataset, sensor, count(life_up) as units, avg(life_up::int) as rising_life, avg(up30::int) as rising_30,
        avg(up15::int) as rising_15, avg(up5::int) as rising_5 from (
        select dataset, sensor, unit, case when max(life)>=20 then avg(reading) filter (where back<=10) > avg(reading) filter (where cycle<=10) end as life_up,
        max(reading) filter (where back=1) > max(reading) filter (where back=30) as up30,
        max(reading) filter (where back=1) > max(reading) filter (where back=15) as up15,
        max(reading) filter (where back=1) > max(reading) filter (where back=5) as up5
        from (select *, life-cycle+1 as back from (select *, max(cycle) over (partition by unit) as life from
        ({long('traj', 'dataset, unit, cycle', b.SCORED)}))) group by all) group by all"""


@query(
    "D28_share_rising",
    sql("traj", f"select dataset, sensor, units, {d6('rising_life','rising_life')}, {d6('rising_30','rising_30')}, {d6('rising_15','rising_15')}, {d6('rising_5','rising_5')} from ({SHARES})"),
)
def share_rising(spark, d):
    return cl.share_rising(b.trajectories(spark, d), b.SCORED)


def attested_sql(threshold: str = "0.65e0") -> str:
    asserted = "case sensor " + " ".join(f"when '{k}' then '{v}'" for k, v in b.ASSERTED.items()) + " end"
    return f"""select *, attested and measured<>asserted as conflict,
        case when not attested then 'unattested' when measured=asserted then 'agree' else 'conflict' end as grouping from (
        select *, support>={threshold} as attested from (select dataset, sensor, rising_life,
        case when rising_life>0.5 then 'increase' else 'decrease' end as measured,
        case when rising_life>0.5 then rising_life else 1-rising_life end as support, {asserted} as asserted from ({SHARES})))"""


@query(
    "D29_attestation",
    sql(
        "traj",
        " union all ".join(
            f"select {t}e0 as threshold, dataset, grouping, string_agg(sensor, ',' order by sensor) as sensors, count(*) as n from ({attested_sql(t + 'e0')}) group by all"
            for t in ("0.6", "0.65", "0.7")
        ),
    ),
)
def attestation(spark, d):
    return cl.attestation_groups(cl.share_rising(b.trajectories(spark, d), b.SCORED), b.ASSERTED, [0.6, 0.65, 0.7])
