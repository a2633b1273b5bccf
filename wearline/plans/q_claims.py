"""Queries on scored claims: faithfulness, arms, what claims follow (survey ids C2–C6, D16–D19, D23, D30–D32, D44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import metrics as m
from ..operators import validate as va
from ..session import shared
from . import bindings as b
from .oracle import d6, direction, sql
from .q_frames import attested_sql
from .registry import query

P = "100e0*avg(cast({} as int))"
BLOCK = f"count(*) as claims, {d6(P.format('reference_hit'),'reference_pct')}, {d6(P.format('input_hit'),'input_pct')}, {d6(P.format('base_hit'),'base_pct')}"


@query(
    "C2_opportunities",
    sql("opps", "select config, sensor, cued, count(*) as pairs, count(*) filter (where directional) as directional from opps group by all"),
)
def opportunities(spark, d):
    """Every response meets every sensor; how many of the pairs carry a directional claim."""
    return b.opportunities(spark, d).groupBy("config", "sensor", "cued").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("directional").alias("directional")
    )


@query("D16_faithfulness", sql("claims", f"select dataset, mode, {BLOCK} from claims group by all"))
def faithfulness(spark, d):
    return cl.faithfulness(b.opportunities(spark, d), ["dataset", "mode"])


SETS = [[], ["cued"], ["mode"], ["sensor"], ["n"], ["dataset", "config"]]


@query(
    "D17_faithfulness_breakdown",
    sql(
        "claims",
        f"""select case grouping(cued)*32+grouping(mode)*16+grouping(sensor)*8+grouping(n)*4+grouping(dataset)*2+grouping(config)
        when 63 then 'all' when 31 then 'cued' when 47 then 'mode' when 55 then 'sensor' when 59 then 'n' else 'dataset+config' end as level,
        cued, mode, sensor, n, dataset, config, {BLOCK} from claims group by grouping sets ((),(cued),(mode),(sensor),(n),(dataset,config))""",
    ),
)
def faithfulness_breakdown(spark, d):
    return cl.faithfulness_breakdown(b.opportunities(spark, d), SETS)


EPS = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1)


@query(
    "D18_threshold_sweep",
    sql(
        "claims",
        f"""select mode, eps, count(*) as claims, {d6(P.format("(shown='stable')"),'stable_pct')}, {d6(P.format('(claimed=shown)'),'input_pct')}, {d6(P.format('(expected=shown)'),'base_pct')}
        from (select *, {direction('net','eps')} as shown from claims, (select cast(unnest([{','.join(map(str, EPS))}]) as double) as eps)) group by all""",
    ),
)
def threshold_sweep(spark, d):
    return cl.threshold_sweep(b.opportunities(spark, d), EPS, ["mode"])


@query(
    "D19_direction_counts",
    sql(
        "claims",
        "select sensor, "
        + ", ".join(
            f"count(*) filter (where {c}='{v}') as {c}_{v}"
            for c, v in (("claimed", "increase"), ("claimed", "decrease"), ("actual", "increase"), ("actual", "decrease"), ("actual", "stable"))
        )
        + " from claims group by all",
    ),
)
def direction_counts(spark, d):
    return cl.direction_counts(b.opportunities(spark, d))


@query(
    "D23_mention_tally",
    sql(
        "opps",
        """select *, round(100e0*(texts-absent)/texts,6) as mention_pct, round(100e0*correct/nullif(texts-absent,0),6) as correct_pct, round(100e0*wrong/nullif(texts-absent,0),6) as wrong_pct from (
        select coalesce(sensor,'ALL') as sensor, count(*) as texts, count(*) filter (where claimed=expected) as correct, count(*) filter (where directional and claimed<>expected) as wrong,
        count(*) filter (where claimed='stable') as stable, count(*) filter (where claimed='unspecified') as unspecified, count(*) filter (where claimed='absent') as absent
        from opps group by rollup(sensor))""",
    ),
)
def mention_tally(spark, d):
    return cl.tally_mentions(b.opportunities(spark, d))


MEASURED = attested_sql()


def _directions(spark, d):
    shares = cl.share_rising(b.trajectories(spark, d), b.SCORED)
    return cl.attest(shares, b.ASSERTED).select("dataset", "sensor", "measured", "attested", "conflict")


@query(
    "C3_claims_with_directions",
    sql("claims traj", "select resp, c.dataset, c.sensor, claimed, measured, attested, conflict from claims c join dirs d on c.dataset=d.dataset and c.sensor=d.sensor", dirs=MEASURED),
)
def claims_with_directions(spark, d):
    claims = cl.directional(b.opportunities(spark, d))
    return cl.with_directions(claims, _directions(spark, d)).select(
        "resp", "dataset", "sensor", "claimed", "measured", "attested", "conflict"
    )


FOLLOW = f"count(*) as claims, {d6(P.format('reference_hit'),'prompt_pct')}, {d6('100e0*avg(case when attested then cast(claimed=measured as int) end)','data_pct')}, {d6(P.format('input_hit'),'window_pct')}, {d6(P.format('base_hit'),'base_pct')}"


@query(
    "D30_follow_rates",
    sql(
        "claims traj",
        f"""select 'all' as scope, '' as part, {FOLLOW} from m union all select 'attested', '', {FOLLOW} from m where attested
        union all select 'conflict', '', {FOLLOW} from m where conflict union all select 'sensor', dataset||'/'||sensor, {FOLLOW} from m group by dataset, sensor""",
        dirs=MEASURED,
        m="select c.*, measured, attested, conflict from claims c join dirs d on c.dataset=d.dataset and c.sensor=d.sensor",
    ),
)
def follow_rates(spark, d):
    return cl.follow_rates(b.opportunities(spark, d), _directions(spark, d))


@query(
    "D31_arm_table",
    sql(
        "arms",
        f"""select *, round(100e0*(1-claims/(max(claims) filter (where arm='repl') over ())),6) as fewer_pct from (
        select arm, count(*) as claims, {d6(P.format('reference_hit'),'reference_pct')}, {d6(P.format('cue_hit'),'cue_pct')} from arms where directional and cued group by 1)""",
    ),
)
def arm_table(spark, d):
    return cl.arm_table(b.arm_claims(spark, d))


WIDE = """select a.engine, a.sensor, a.claimed as claimed_a, b.claimed as claimed_b, a.actual as actual_a, b.actual as actual_b
        from arms a join arms b on a.arm='repl' and b.arm='revdata' and a.engine=b.engine and a.sensor=b.sensor where a.directional and b.directional"""
REV = f"select *, claimed_a<>claimed_b as changed from ({WIDE}) where actual_a<>actual_b and actual_a<>'stable' and actual_b<>'stable'"


@query("C4_pair_arms", sql("arms", WIDE))
def pair_arms(spark, d):
    a = cl.directional(b.arm_claims(spark, d))
    return cl.pair_arms(a, "repl", "revdata", ["engine", "sensor"], ["claimed", "actual"])


@query(
    "D32_trend_reversals",
    sql("arms", f"select coalesce(sensor,'ALL') as sensor, count(*) as pairs, count(*) filter (where changed) as changed, round(100e0*count(*) filter (where changed)/count(*),6) as changed_pct from ({REV}) group by rollup(sensor)"),
)
def trend_reversals(spark, d):
    return cl.reversal_summary(cl.trend_reversals(b.arm_claims(spark, d)))


@query(
    "D44_worked_example",
    sql("arms", f"select sensor, engine, claimed_a, actual_a, actual_b from ({REV}) where not changed qualify row_number() over (partition by sensor order by engine)=1"),
)
def worked_example(spark, d):
    return cl.worked_example(cl.trend_reversals(b.arm_claims(spark, d)))


@query(
    "D21_arms_chi2",
    sql(
        "arms",
        """select sensor, a as n11, b as n10, c as n01, dd as n00, round(n*g*g/nullif((a+b)::double*(c+dd)*(a+c)*(b+dd),0),6) as chi2 from (
        select *, abs(a::double*dd-b::double*c)-least(n/2, abs(a::double*dd-b::double*c)) as g from (
        select sensor, count(*) filter (where arm='repl' and reference_hit) as a, count(*) filter (where arm='repl' and not reference_hit) as b, count(*) filter (where arm='invcue' and reference_hit) as c,
        count(*) filter (where arm='invcue' and not reference_hit) as dd, count(*)::double as n from arms where directional and arm in ('repl','invcue') group by 1))""",
    ),
)
def arms_chi2(spark, d):
    two = cl.directional(b.arm_claims(spark, d)).where(F.col("arm").isin("repl", "invcue"))
    return m.chi2_2x2(two, ["sensor"], F.col("arm") == "repl", F.col("reference_hit")).drop("p")


@query("C9_lookup_unique", sql("opps", "select dataset, config, unit, sensor, count(*) as matches, case when count(*)=1 then min(claimed) end as claimed from opps group by all"))
def lookup_unique(spark, d):
    """Every (config, unit, sensor) looked up in the claims; only exact single matches give a value."""
    keys = ["dataset", "config", "unit", "sensor"]
    claims = shared(b.opportunities(spark, d).select(*keys, "claimed"))
    return va.lookup_unique(claims.select(*keys).distinct(), claims, keys, "claimed")


@query("C5_pending_work", sql("", "select o_orderkey, o_custkey from orders anti join (select distinct l_orderkey from lineitem where l_returnflag='R') on o_orderkey=l_orderkey"))
def pending_work(spark, d):
    done = b.table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return va.pending(b.table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("C6_join_labels", sql("", "select d.doc_id, source, quality::bigint as quality, toxic::bigint as toxic from documents d left join labels l on d.doc_id=l.doc_id"))
def join_labels(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "source")
    return va.join_labels(docs, b.table(spark, d, "labels"), ["doc_id"])
