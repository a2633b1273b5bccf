"""Queries on resampling inference and sampling (survey ids F, G, D45). Replicates are a parameter, 10,000 as in the reference.

Replicates come from generators seeded by group and cluster, which SQL cannot follow: tests hold those queries
against plain resampling. Exact tests and everything else have check SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators import claims as cl
from ..operators import frames as fr
from ..operators import resample as rs
from ..operators import sampling as sp
from ..operators.ordering import match
from ..session import shared
from . import bindings as b
from .oracle import CTX, h, mentions, sql
from .registry import query

B = rs.REPLICATES
SUMS = ("n1", "h1", "n0", "h0")


def _sided(claims):
    c = F.col("cued")
    hit = F.col("reference_hit")
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    return claims.withColumns({"n1": one(c), "h1": one(c & hit), "n0": one(~c), "h0": one(~c & hit)})


def gap_column():
    return ratio("h1", "n1") - ratio("h0", "n0")


@query("F2_cluster_bootstrap_unit")
def cluster_bootstrap_unit(spark, d):
    """Cued minus uncued agreement per template, resampling units."""
    claims = _sided(b.claims_table(spark, d))
    return rs.cluster_bootstrap(claims, ["mode"], ["unit"], SUMS, gap_column(), B)


@query("F2_widest_interval")
def widest_interval(spark, d):
    """Input faithfulness minus base rate, clustered on unit and on configuration; the wider interval."""
    claims = b.claims_table(spark, d).withColumns(
        {"n": F.lit(1.0), "h": F.col("input_hit").cast("double"), "g": F.col("base_hit").cast("double")}
    )
    stat = ratio(F.col("h") - F.col("g"), "n")
    one, two = (rs.cluster_bootstrap(claims, ["sensor"], [key], ["n", "h", "g"], stat, B) for key in ("unit", "config"))
    return rs.widest(one, two, ["sensor"])


@query("F3_bootstrap_association")
def bootstrap_association(spark, d):
    claims = b.claims_table(spark, d)
    return rs.bootstrap_association(claims, ["sensor"], ["config"], "claimed", "actual", B)


@query(
    "F4_permute_sensors",
    sql(
        "claims",
        f"""select mode, round(max(obs),6) as observed, count(v) as permutations, count(*) filter (where abs(v)>=abs(obs)-1e-12) as hits, round(count(*) filter (where abs(v)>=abs(obs)-1e-12)/count(v)::double,6) as p, round(0.1e0,6) as floor_p from (
        select mode, x.s1, x.s2, x.s3, avg(cast(reference_hit as double)) filter (where sensor in (x.s1,x.s2,x.s3)) - avg(cast(reference_hit as double)) filter (where sensor not in (x.s1,x.s2,x.s3)) as v,
        avg(cast(reference_hit as double)) filter (where cued) - avg(cast(reference_hit as double)) filter (where not cued) as obs
        from claims, (select a.s as s1, b.s as s2, c.s as s3 from sen a, sen b, sen c where a.s<b.s and b.s<c.s) x group by all) group by 1""",
        sen="select unnest(['s1','s2','s3','s5','s6']) as s",
    ),
)
def permute_sensors(spark, d):
    """All relabellings of which sensors are cued: exact p instead of random ones."""
    claims = b.claims_table(spark, d)
    return rs.permute_sensors(claims, ["mode"], "sensor", b.CUED, b.SCORED, "reference_hit")


@query("F5_permute_templates")
def permute_templates(spark, d):
    claims = b.claims_table(spark, d).withColumn("zs", F.col("mode") == "zero_shot")
    return rs.permute_labels(claims, ["dataset"], "config", "zs", "reference_hit", B)


@query("F6_permute_units")
def permute_units(spark, d):
    """Units trade windows within their dataset; every lookup hits because directions exist for all opportunities."""
    shown = shared(b.window_directions(spark, d))
    return rs.permute_units(b.claims_table(spark, d, shown), shown, ["n", "sensor"], ["sensor"], "claimed", "actual", B)


@query(
    "J6_permutation_table_holes",
    sql(
        "claims",
        """select dataset, count(*) as needed, count(*) filter (where w.unit is null) as missing from (
        select c.*, u.unit from (select distinct dataset, n, sensor from claims) c join (select distinct dataset, unit from wdir) u using (dataset)) x
        left join wdir w using (dataset, unit, n, sensor) group by 1""",
    ),
)
def permutation_table_holes(spark, d):
    """Cells a permutation may look up, and how many of them the full table lacks."""
    full = shared(b.window_directions(spark, d))
    claims = b.claims_table(spark, d, full)
    needed = claims.select("dataset", "n", "sensor").distinct().join(full.select("dataset", "unit").distinct(), "dataset")
    holes = rs.missing_cells(claims, full, ["n", "sensor"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("missing"))
    return needed.groupBy("dataset").agg(F.count(F.lit(1)).alias("needed")).join(holes, "dataset", "left").fillna(0, ["missing"])


def _differences(spark, d):
    pairs = cl.pair_arms(cl.directional(b.arm_claims(spark, d)), "repl", "invcue", ["engine", "sensor"], ["reference_hit"])
    return pairs.withColumn("diff", F.col("reference_hit_b").cast("double") - F.col("reference_hit_a").cast("double"))


@query("F7_F10_sign_flip")
def sign_flip(spark, d):
    return rs.sign_flip(_differences(spark, d), ["sensor"], ["engine"], "diff", B)


@query("F7_paired_interval")
def paired_interval(spark, d):
    pairs = _differences(spark, d).withColumn("n", F.lit(1.0))
    return rs.cluster_bootstrap(pairs, ["sensor"], ["engine"], ["n", "diff"], ratio("diff", "n"), B)


@query("F1_bootstrap_rank")
def bootstrap_rank(spark, d):
    p = b.predictions(spark, d).withColumnRenamed("n", "w")
    return rs.bootstrap_rank_ci(p, ["dataset", "w", "q"], ["unit"], "pred", "truth", B)


@query("F9_bootstrap_pearson")
def bootstrap_pearson(spark, d):
    p = b.predictions(spark, d).withColumnRenamed("n", "w")
    return rs.bootstrap_pearson_ci(p, ["dataset", "w", "q"], ["unit"], "pred", "truth", B)


@query(
    "F11_multiplicity",
    sql(
        "",
        """select family, name, round(p,6) as p, round(case when p is not null then least(1, min(q) over (partition by family, p is null order by p range between current row and unbounded following)) end,6) as p_bh,
        round(case when p is not null then least(1, p*m) end,6) as p_bonferroni, p<0.05 as significant_raw,
        case when p is not null then least(1, min(q) over (partition by family, p is null order by p range between current row and unbounded following)) end<0.05 as significant_bh,
        case when p is not null then least(1, p*m) end<0.05 as significant_bonferroni
        from (select *, p*m/(rank() over (partition by family, p is null order by p)+count(*) over (partition by family, p)-1) as q from (
        select *, count(p) over (partition by family) as m from (select p_brand as family, p_partkey as name, case when p_size%7=0 then null else p_size*p_size/20000e0 end as p from part)))""",
    ),
)
def multiplicity(spark, d):
    """Families of p-values with ties and undefined members."""
    p = b.table(spark, d, "part").select(
        F.col("p_brand").alias("family"),
        F.col("p_partkey").alias("name"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") * F.col("p_size") / 20000.0).alias("p"),
    )
    return rs.adjust_pvalues(p, ["family"], "p")


OFF_TREND = "blest|therr|eurs"
SETS = {
    "docs": "select doc_id as resp, text from documents",
    "off": f"""select resp, sensor from (select resp, sensor, string_agg({CTX}, ' || ' order by i) as clause
        from {mentions('docs', 'resp', 60, 80)} group by all) where regexp_matches(clause, '{OFF_TREND}')""",
    "sets": "select 'all' as set, * from claims union all select 'unflagged', * from claims anti join off using (resp, sensor)",
}


def _sets(spark, d):
    """Every claim, and those whose clause speaks of a trend and not of levels, side by side."""
    claims, clauses = b.claims_and_levels(spark, d, OFF_TREND)
    return rs.with_and_without(match(claims, clauses, ["resp", "sensor"], "left").fillna(False, ["off_trend"]), "off_trend")


@query("F12_sensitivity")
def sensitivity(spark, d):
    """Gap between window faithfulness and base rate, with and without claims about levels, from one pass."""
    sets = _sets(spark, d).withColumns(
        {"n": F.lit(1.0), "hh": F.col("input_hit").cast("double"), "g": F.col("base_hit").cast("double")}
    )
    stat = ratio(F.col("hh") - F.col("g"), "n")
    by = ["set", "sensor"]
    ci = rs.cluster_bootstrap(sets, by, ["unit"], ["n", "hh", "g"], stat, B).drop("replicates")
    gap = F.avg("hh") - F.avg("g")
    return sets.groupBy(*by).agg(F.count(F.lit(1)).alias("claims"), gap.alias("gap")).join(ci, by)


@query("F12_cue_gap")
def sensitivity_cue_gap(spark, d):
    """Cued minus uncued agreement in both sets, resampling units."""
    return rs.cluster_bootstrap(_sided(_sets(spark, d)), ["set"], ["unit"], SUMS, gap_column(), B)


@query(
    "F12_relabelled_sensors",
    sql(
        "claims",
        f"""select set, round(max(obs),6) as observed, count(v) as permutations, count(*) filter (where abs(v)>=abs(obs)-1e-12) as hits, round(count(*) filter (where abs(v)>=abs(obs)-1e-12)/count(v)::double,6) as p, round(0.1e0,6) as floor_p from (
        select set, x.s1, x.s2, x.s3, avg(cast(reference_hit as double)) filter (where sensor in (x.s1,x.s2,x.s3)) - avg(cast(reference_hit as double)) filter (where sensor not in (x.s1,x.s2,x.s3)) as v,
        avg(cast(reference_hit as double)) filter (where cued) - avg(cast(reference_hit as double)) filter (where not cued) as obs
        from sets, (select a.s as s1, b.s as s2, c.s as s3 from sen a, sen b, sen c where a.s<b.s and b.s<c.s) x group by all) group by 1""",
        **SETS,
        sen="select unnest(['s1','s2','s3','s5','s6']) as s",
    ),
)
def sensitivity_sensors(spark, d):
    """All relabellings of the cued sensors in both sets."""
    return rs.permute_sensors(_sets(spark, d), ["set"], "sensor", b.CUED, b.SCORED, "reference_hit")


@query("F12_relabelled_templates")
def sensitivity_templates(spark, d):
    """Template labels shuffled over configurations in both sets."""
    sets = _sets(spark, d).withColumn("zs", F.col("mode") == "zero_shot")
    return rs.permute_labels(sets, ["set", "dataset"], "config", "zs", "reference_hit", B)


# ------------------------------------------------------------------ sampling
QUOTA = {"increase": 40, "decrease": 40, "stable": 9, "unspecified": 30, "absent": 20}
QUOTA_CASE = "case claimed " + " ".join(f"when '{k}' then {v}" for k, v in QUOTA.items()) + " end"


@query(
    "G1_stratified_sample",
    sql(
        "opps",
        f"""select row_number() over (order by {h('sample-order', 'claimed', 'resp', 'sensor')}, claimed, resp, sensor) as id, claimed, resp, sensor from (
        select *, row_number() over (partition by claimed order by {h('sample', 'resp', 'sensor')}, resp, sensor) as r from opps) where r<={QUOTA_CASE}""",
    ),
)
def stratified_sample(spark, d):
    pairs = b.opportunities(spark, d).select("claimed", "resp", "sensor")
    return sp.stratified_sample(pairs, "claimed", ["resp", "sensor"], QUOTA)


EDGES = (0, 13, 26, 40)
BIN = "case when rul<=13 then 0 when rul<=26 then 1 else 2 end"


@query(
    "G2_stratified_examples",
    sql(
        "train",
        f"""select d.dataset, d.unit, cast(d.rul as bigint) as rul, cast(bin as bigint) as bin, d.cycle as drawn_cycle, m.cycle from (
        select *, row_number() over (partition by dataset, bin order by {h('examples', 'dataset', 'unit', 'cycle')}, dataset, unit, cycle) as r from (select *, {BIN} as bin from train where cycle>=30)) d
        join (select dataset, unit, rul, max(cycle) as cycle from train where cycle>=30 group by all) m using (dataset, unit, rul) where r<=case when bin<2 then 2 else 1 end""",
    ),
)
def stratified_examples(spark, d):
    train = fr.with_rul(b.trajectories(spark, d), b.CAP).select("dataset", "unit", "cycle", "rul")
    return sp.stratified_examples(train, 5, 30, edges=EDGES)


@query(
    "G3_random_examples",
    sql("train", f"select dataset, unit, cycle, cast(rul as bigint) as rul from train where cycle>=30 order by {h('examples', 'dataset', 'unit', 'cycle')}, dataset, unit, cycle limit 5"),
)
def random_examples(spark, d):
    train = fr.with_rul(b.trajectories(spark, d), b.CAP).select("dataset", "unit", "cycle", "rul")
    return sp.random_examples(train, 5, ["dataset", "unit", "cycle"], 30)


def _pool(spark, d):
    seen = b.observed(b.trajectories(spark, d))
    left = F.least(F.lit(b.CAP).cast("long"), F.col("life") - F.max("cycle"))
    ends = seen.groupBy("dataset", "unit", "life").agg(F.max("cycle").alias("cycle"), left.alias("rul"))
    return sp.last_cycle_pool(ends, EDGES)


POOL = "select dataset, unit, cycle, rul, {bin} as bin from (select dataset, unit, max(cycle) as cycle, least(40, max(life)-max(cycle)) as rul from obs group by all)".format(bin=BIN)


@query(
    "G4_first_per_bin",
    sql(
        "obs",
        """select dataset, unit, cycle, cast(rul as bigint) as rul, cast(bin as bigint) as bin, slot from (select *, row_number() over (partition by dataset order by bin, r) as slot from (
        select *, row_number() over (partition by dataset, bin order by unit) as r from pool) where r<=3) where slot<=10""",
        pool=POOL,
    ),
)
def first_per_bin(spark, d):
    return sp.first_per_bin(_pool(spark, d), 10)


@query(
    "D45_effective_examples",
    sql(
        "obs",
        """select dataset, k, least(max(k), count(*)) as examples, cast(max(rul) as bigint) as largest_rul from (select *, row_number() over (partition by dataset, bin order by unit) as r from pool),
        (select cast(unnest([3,5,10]) as bigint) as k) where r<=greatest(1, k//3) group by dataset, k""",
        pool=POOL,
    ),
)
def effective_examples(spark, d):
    return sp.effective_examples(_pool(spark, d), [3, 5, 10])


@query(
    "G5_group_split",
    sql(
        "traj",
        f"""select dataset, unit, cycle, pos<=greatest(1, floor(units*0.15e0)) as validation from traj join (select *, row_number() over (order by {h('split', 'dataset', 'unit')}, dataset, unit) as pos,
        count(*) over () as units from (select distinct dataset, unit from traj)) using (dataset, unit)""",
    ),
)
def group_split(spark, d):
    return sp.group_split(b.trajectories(spark, d)).select("dataset", "unit", "cycle", "validation")


@query("G6_first_units", sql("traj", "select dataset, unit, count(*) as rows from traj where (dataset, unit) in (select (dataset, unit) from (select distinct dataset, unit from traj order by 1,2 limit 10)) group by all"))
def first_units(spark, d):
    return sp.first_units(b.trajectories(spark, d), 10).groupBy("dataset", "unit").agg(F.count(F.lit(1)).alias("rows"))
