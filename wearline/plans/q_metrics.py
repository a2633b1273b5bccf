"""Queries on prediction tables: errors, baselines, concentration, ranks, agreement, models (survey ids D1–D15, D20–D22, D33–D43, C, H, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import tails as tl
from ..operators import frames as fr
from ..operators import metrics as m
from ..operators import models as md
from ..operators import rank as rk
from ..operators import sampling as sp
from ..operators import validate as va
from ..session import shared
from . import bindings as b
from .noskill import baselines, beats_a_constant, labels
from .oracle import d6, sql, u
from .registry import query

E_ = "(pred-truth)"
PENALTY = f"sum(case when {E_}<0 then exp(-{E_}/13e0)-1 else exp({E_}/10e0)-1 end)"
ERR = f"sqrt(avg({E_}*{E_}))", f"avg(abs({E_}))", PENALTY
ERRS = f"{d6(ERR[0],'rmse')}, {d6(ERR[1],'mae')}, {d6(ERR[2],'score')}"
CONST = f"""select dataset, baseline, constant, count(*) as n, sqrt(avg((constant-truth)*(constant-truth))) as rmse, avg(abs(constant-truth)) as mae,
        sum(case when constant<truth then exp((truth-constant)/13e0)-1 else exp((constant-truth)/10e0)-1 end) as score
        from test join (select dataset, unnest(['train_mean','train_median','fixed','half_cap']) as baseline,
            unnest([avg(rul), median(rul), 50e0, {b.CAP / 2}]) as constant from train group by 1
          union all select dataset, unnest(['test_mean','test_median']), unnest([avg(truth), median(truth)]) from test group by 1) c using (dataset) group by all"""
TEST = "select distinct dataset, unit, truth from preds"


@query("D1_D2_errors", sql("lpreds", f"select config, count(*) as n, {ERRS} from lpreds group by all"))
def errors(spark, d):
    return m.error_metrics(b.line_predictions(spark, d), ["config"])


@query("D1_D2_errors_by_run", sql("preds", f"select dataset, n, q, {ERRS} from preds group by all"))
def errors_by_run(spark, d):
    return m.error_metrics(b.predictions(spark, d).withColumnRenamed("n", "_n"), ["dataset", "_n", "q"]).drop("n").withColumnRenamed("_n", "n")


@query(
    "D3_constant_baselines",
    sql("train preds", f"select dataset, baseline, {d6('constant','constant')}, n, {d6('rmse','rmse')}, {d6('mae','mae')}, {d6('score','score')} from ({CONST})", test=TEST),
)
def constant_baselines(spark, d):
    return baselines(spark, d)


@query(
    "D4_best_constant",
    sql(
        "preds",
        f"""select dataset, metric, constant, round(value,6) as value from (select *, row_number() over (partition by dataset, metric order by value, constant) as r from (
        select dataset, c::double as constant, unnest(['rmse','mae','score']) as metric, unnest([sqrt(avg((c-truth)*(c-truth))), avg(abs(c-truth)),
        sum(case when c<truth then exp((truth-c)/13e0)-1 else exp((c-truth)/10e0)-1 end)]) as value
        from test, (select unnest(range(0,{b.CAP + 1})) as c) group by dataset, c)) where r=1""",
        test=TEST,
    ),
)
def best_constant(spark, d):
    test = labels(b.predictions(spark, d))
    parts = [m.best_constant(test, name, b.CAP).withColumn("metric", F.lit(name)) for name in ("rmse", "mae", "score")]
    return m.compare_models(*parts)


@query(
    "D5_random_baseline",
    sql(
        "preds",
        f"""select dataset, count(*) as draws, {d6('avg(rmse)','rmse')}, {d6('avg(mae)','mae')}, {d6('avg(score)','score')} from (
        select dataset, draw, {ERR[0]} as rmse, {ERR[1]} as mae, {ERR[2]} as score from (
        select *, floor({u('random','draw','unit')}*{b.CAP + 1}) as pred from test, (select unnest(range(1,1001)) as draw)) group by all) group by 1""",
        test=TEST,
    ),
)
def random_baseline(spark, d):
    return m.random_baseline(labels(b.predictions(spark, d)), ["unit"], 1000, b.CAP)


CONC = """select {by}, cast(sum(c) as bigint) as n, count(*) as distinct_values, round(arg_min(v, struct_pack(a := -c, b := v)),6) as modal_value,
        round(100e0*max(c)/sum(c),6) as modal_share_pct,
        round(abs(sum(case when c=t then 0e0 else -(c/t)*log2(c/t) end)),6) as entropy_bits,
        round(log2(sum(c)),6) as entropy_max, round(abs(sum(case when c=t then 0e0 else -(c/t)*log2(c/t) end))/log2(sum(c)),6) as entropy_ratio
        from (select *, cast(sum(c) over (partition by {by}) as double) as t from (select {by}, {v} as v, count(*) as c from {t} group by all)) group by all"""


@query("D6_concentration", sql("preds", CONC.format(by="dataset, w, q", v="pred", t="(select *, n as w from preds)")))
def concentration(spark, d):
    return m.concentration(b.predictions(spark, d).withColumnRenamed("n", "w"), ["dataset", "w", "q"])


@query("D6_concentration_large", sql("lpreds", CONC.format(by="config", v="round_even(pred,0)", t="lpreds")))
def concentration_large(spark, d):
    return m.concentration(b.line_predictions(spark, d), ["config"], grid=1.0)


@query(
    "D7_dispersion",
    sql(
        "lpreds",
        f"select config, {d6('avg(pred)','pred_mean')}, {d6('stddev_samp(pred)','pred_sd')}, {d6('avg(truth)','truth_mean')}, {d6('stddev_samp(truth)','truth_sd')}, {d6('stddev_samp(pred)/stddev_samp(truth)','sd_ratio')} from lpreds group by 1",
    ),
)
def dispersion(spark, d):
    return m.dispersion(b.line_predictions(spark, d), ["config"])


@query(
    "D8_beats_constant",
    sql(
        "train preds",
        f"""select p.*, round(c.rmse,6) as constant_rmse, p.rmse_raw<c.rmse as beats_constant from (select dataset, n as w, q, count(*) as n, {ERRS}, {ERR[0]} as rmse_raw from preds group by all) p
        join ({CONST}) c on c.dataset=p.dataset and c.baseline='train_mean'""".replace("select p.*,", "select p.dataset, p.w, p.q, p.n, p.rmse, p.mae, p.score,"),
        test=TEST,
    ),
)
def beats_constant(spark, d):
    return beats_a_constant(spark, d)


@query(
    "D9_degenerate",
    sql(
        "preds",
        """select dataset, n, q, round(max(pred)-min(pred),6) as range, max(pred)-min(pred)<1e-3 as degenerate from preds group by all
        union all select dataset, n, cast(0 as bigint), 0e0, true from preds group by all""",
    ),
)
def degenerate(spark, d):
    """With a predictor that always says the same (q = 0)."""
    p = b.predictions(spark, d)
    flat = p.withColumns({"q": F.lit(0).cast("long"), "pred": F.lit(7.0)})
    return m.is_degenerate(p.unionByName(flat), ["dataset", "n", "q"])


RANKED = """select *, rank() over (partition by {by} order by {x})+(count(*) over (partition by {by}, {x})-1)/2e0 as rx,
        rank() over (partition by {by} order by {y})+(count(*) over (partition by {by}, {y})-1)/2e0 as ry from {t}"""


@query(
    "D10_spearman",
    sql("preds", f"select dataset, w, q, count(*) as n, round(corr(rx,ry),6) as rho from ({RANKED.format(by='dataset,w,q', x='pred', y='truth', t='(select * exclude (n), n as w from preds)')}) group by all"),
)
def spearman(spark, d):
    return rk.spearman(b.predictions(spark, d).withColumnRenamed("n", "w"), ["dataset", "w", "q"], "pred", "truth")


@query(
    "D10_spearman_large",
    f"select config, count(*) as n, round(corr(rx,ry),6) as rho from ({RANKED.format(by='config', x='l_extendedprice', y='l_quantity', t='(select l_returnflag as config, * from lineitem)')}) group by all",
)
def spearman_large(spark, d):
    """Nearly continuous values: ranks come from running totals over value buckets."""
    li = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("config"), "l_extendedprice", "l_quantity")
    return rk.spearman(li, ["config"], "l_extendedprice", "l_quantity")


TAU = """select {by}, cast(max(nn) as bigint) as n, round(cast(sum(sign(a.x-b.x)*sign(a.y-b.y)*a.c*b.c) as double)/2 /
        (sqrt(max(nn*(nn-1)/2e0-tx))*sqrt(max(nn*(nn-1)/2e0-ty))),6) as tau
        from cells a join cells b using ({by}) join (select {by}, sum(c)::double as nn from cells group by all) using ({by})
        join (select {by}, sum(k*(k-1)/2e0) as tx from (select {by}, x, sum(c)::double as k from cells group by all) group by all) using ({by})
        join (select {by}, sum(k*(k-1)/2e0) as ty from (select {by}, y, sum(c)::double as k from cells group by all) group by all) using ({by}) group by all"""


@query("D11_kendall", sql("lpreds", TAU.format(by="config"), cells="select config, pred as x, truth as y, count(*) as c from lpreds group by all"))
def kendall(spark, d):
    """Exact tau-b over every line item; the check forms pairs of value cells, the query does not."""
    return rk.kendall(b.line_predictions(spark, d), ["config"], "pred", "truth")


@query("D12_pearson", sql("lpreds", "select config, count(*) as n, round(corr(pred,truth),6) as r from lpreds group by 1"))
def pearson(spark, d):
    return rk.pearson(b.line_predictions(spark, d), ["config"], "pred", "truth")


@query("D13_rank_tests")
def rank_tests(spark, d):
    """p-values come from tail functions SQL does not have; the statistics are checked in the next query."""
    return rk.rank_tests(b.predictions(spark, d).withColumnRenamed("n", "w"), ["dataset", "w", "q"], "pred", "truth")


@query(
    "D13_test_statistics",
    sql(
        "preds",
        f"""select dataset, w, q, n, round(rho*sqrt((n-2)/(1-rho*rho)),6) as rho_t, round(r*sqrt((n-2)/(1-r*r)),6) as r_t from (
        select dataset, w, q, count(*) as n, corr(rx,ry) as rho, corr(pred,truth) as r from
        ({RANKED.format(by='dataset,w,q', x='pred', y='truth', t='(select * exclude (n), n as w from preds)')}) group by all)""",
    ),
)
def test_statistics(spark, d):
    p = b.predictions(spark, d).withColumnRenamed("n", "w")
    by = ["dataset", "w", "q"]
    both = rk.spearman(p, by, "pred", "truth").join(rk.pearson(p, by, "pred", "truth").select(*by, "r"), by)
    n = F.col("n")
    return both.select(*by, "n", tl.correlation_t(F.col("rho"), n).alias("rho_t"), tl.correlation_t(F.col("r"), n).alias("r_t"))


@query(
    "D14_linear_fit",
    sql("lpreds", f"select config, count(*) as n, {d6('regr_slope(truth,pred)','slope')}, {d6('regr_intercept(truth,pred)','intercept')} from lpreds group by 1"),
)
def linear_fit(spark, d):
    return rk.linear_fit(b.line_predictions(spark, d), ["config"], "pred", "truth")


@query(
    "D15_leave_one_out",
    sql(
        "preds",
        """select a.dataset, a.n as w, a.q, a.unit, count(*) as n, round(corr(p.pred,p.truth),6) as r from preds a join preds p on a.dataset=p.dataset and a.unit<>p.unit and p.n=a.n and p.q=a.q
        group by a.dataset, a.n, a.q, a.unit""",
    ),
)
def leave_one_out(spark, d):
    p = b.predictions(spark, d).withColumnRenamed("n", "w")
    return rk.leave_one_out(p, ["dataset", "w", "q"], "unit", "pred", "truth")


ASSOC = """select {by}, cast(max(t) as bigint) as n, count(distinct a) as rows, count(distinct b) as cols, round(case when {ok} then sum(case when c is null then e else (c-e)*(c-e)/e end) end,6) as chi2,
        round(case when {ok} then sqrt(sum(case when c is null then e else (c-e)*(c-e)/e end)/(max(t)*(least(count(distinct a),count(distinct b))-1))) end,6) as cramers_v,
        round(case when {ok} then sum(case when c>0 then c/t*log2(c/e) else 0 end) end,6) as mi_bits
        from (select r.{by}, r.a, k.b, x.c, r.c*k.c/t.c as e, t.c as t from (select {by}, a, sum(c)::double as c from cells group by all) r
        join (select {by}, b, sum(c)::double as c from cells group by all) k using ({by})
        join (select {by}, sum(c)::double as c from cells group by all) t using ({by})
        left join cells x on x.{by}=r.{by} and x.a=r.a and x.b=k.b) group by {by} having max(t)>=10""".replace(
    "{ok}", "count(distinct a)>1 and count(distinct b)>1"
)


@query("D20_association", sql("claims", ASSOC.format(by="sensor"), cells="select sensor, claimed as a, actual as b, count(*)::double as c from claims group by all"))
def association(spark, d):
    claims = b.opportunities(spark, d).where("directional")
    return m.association(claims, ["sensor"], "claimed", "actual").drop("p")


@query("D20_association_large", sql("lpreds", ASSOC.format(by="config"), cells="select config, pred as a, truth as b, count(*)::double as c from lpreds group by all"))
def association_large(spark, d):
    return m.association(b.line_predictions(spark, d), ["config"], "pred", "truth").drop("p")


@query(
    "D21_chi2_yates",
    sql(
        "",
        """select returnflag, a as n11, b as n10, c as n01, dd as n00, round(n*g*g/((a+b)*(c+dd)*(a+c)*(b+dd)),6) as chi2 from (
        select *, abs(a::double*dd-b::double*c)-least(n/2, abs(a::double*dd-b::double*c)) as g from (
        select l_returnflag as returnflag, count(*) filter (where p and q) as a, count(*) filter (where p and not q) as b, count(*) filter (where not p and q) as c,
        count(*) filter (where not p and not q) as dd, count(*)::double as n from (select *, l_linestatus='O' as p, l_quantity>25 as q from lineitem) group by 1))""".replace(
            "/((a+b)*(c+dd)*(a+c)*(b+dd))", "/((a+b)::double*(c+dd)*(a+c)*(b+dd))"
        ),
    ),
)
def chi2_yates(spark, d):
    li = b.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "returnflag")
    return m.chi2_2x2(li, ["returnflag"], F.col("l_linestatus") == "O", F.col("l_quantity") > 25).drop("p")


RSUM = """select {by}, {g} as g, count(*)::double as n, sum(rk)::double as rs, max(total)::double as total, max(tt) as tt from (
        select *, sum(case when first then k*k*k-k else 0 end) over (partition by {by}) as tt from (
        select *, rank() over (partition by {by} order by {v})+(count(*) over (partition by {by}, {v})-1)/2e0 as rk, count(*) over (partition by {by}) as total,
        count(*) over (partition by {by}, {v})::double as k, row_number() over (partition by {by}, {v})=1 as first from {t})) group by all"""


def u_sql(by: str, group: str, value: str, table: str, first: str, second: str, towards: str) -> str:
    """U of the first sample and its score towards the alternative."""
    n = lambda g: f"max(n) filter (where g={g})"
    return f"""select {by}, n1, n2, u, round(({towards}-n1*n2/2-0.5)/nullif(sqrt(n1*n2/12*((n1+n2+1)-tt/((n1+n2)*(n1+n2-1)))),0),6) as z from (
        select {by}, {n(first)} as n1, {n(second)} as n2, max(tt) as tt, max(rs) filter (where g={first})-{n(first)}*({n(first)}+1)/2 as u
        from ({RSUM.format(by=by, g=group, v=value, t=table)}) group by 1)"""


LINES = "(select *, l_returnflag as flag from lineitem)"


@query("D22_mann_whitney", sql("", u_sql("flag", "l_linestatus", "l_quantity", LINES, "'F'", "'O'", "greatest(u,n1*n2-u)")))
def mann_whitney(spark, d):
    li = b.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rk.mann_whitney(li, ["flag"], "l_linestatus", "l_quantity", "F", "O").drop("p")


@query("D22_mann_whitney_less", sql("", u_sql("flag", "l_linestatus", "l_extendedprice", LINES, "'F'", "'O'", "n1*n2-u")))
def mann_whitney_less(spark, d):
    """One-sided: are prices of the first status smaller?"""
    li = b.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rk.mann_whitney(li, ["flag"], "l_linestatus", "l_extendedprice", "F", "O", "less").drop("p")


RUN_ERRORS = "(select dataset, w, q, sqrt(avg((pred-truth)*(pred-truth))) as rmse from (select dataset, n as w, q, pred, truth from preds) group by all)"


def _p_exact_sql(n: int) -> str:
    """P(U <= u) of two untied samples of n rows each, by listing which ranks the first may have."""
    ranks = ", ".join(f"(select unnest(range(1,{2 * n + 1})) as r{i}) t{i}" for i in range(n))
    order = " and ".join(f"r{i}<r{i + 1}" for i in range(n - 1))
    return f"(select {'+'.join(f'r{i}' for i in range(n))}-{n * (n + 1) // 2} as v from {ranks} where {order})"


@query(
    "D22_exact_less",
    sql(
        "preds",
        f"""select dataset, n1, n2, u, case when untied then round((select count(*) from {_p_exact_sql(3)} where v<=u)/20e0,6) end as p from (
        select dataset, count(*) filter (where q=1)::double as n1, count(*) filter (where q=40)::double as n2, count(distinct rmse)=count(*) as untied,
        (select count(*) from {RUN_ERRORS} x, {RUN_ERRORS} y where x.dataset=r.dataset and y.dataset=r.dataset and x.q=1 and y.q=40 and y.rmse<x.rmse)::double as u
        from {RUN_ERRORS} r where q in (1,40) group by dataset)""",
    ),
)
def exact_less(spark, d):
    """Do fine quanta have smaller errors than coarse ones? Three runs each, so the null distribution is exact."""
    runs = _run_metrics(spark, d)
    return rk.mann_whitney(runs, ["dataset"], "q", "rmse", 1, 40, "less").select("dataset", "n1", "n2", "u", "p")


@query(
    "D22_kruskal_wallis",
    sql(
        "",
        f"""select status, count(*) as samples, cast(sum(n) as bigint) as n, round((12/(sum(n)*(sum(n)+1))*sum(rs*rs/n)-3*(sum(n)+1))/(1-max(tt)/(sum(n)*sum(n)*sum(n)-sum(n))),6) as h
        from ({RSUM.format(by='status', g='l_returnflag', v='l_quantity', t='(select *, l_linestatus as status from lineitem)')}) group by 1""",
    ),
)
def kruskal_wallis(spark, d):
    li = b.table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "status")
    return rk.kruskal_wallis(li, ["status"], "l_returnflag", "l_quantity").drop("p")


# ------------------------------------------------------------------ runs
def _run_metrics(spark, d):
    p = b.predictions(spark, d).withColumnRenamed("n", "w")
    return m.error_metrics(p, ["dataset", "w", "q"])


@query(
    "D33_replicate_pooling",
    sql(
        "preds",
        f"""select dataset, q, count(*) as runs, {', '.join(f"{d6(f'{a}({c})', f'{c}_{s}')}" for c in ('rmse', 'mae') for a, s in (('avg', 'mean'), ('min', 'min'), ('max', 'max')))}
        from (select dataset, n, q, {ERR[0]} as rmse, {ERR[1]} as mae from preds group by all) group by all""",
    ),
)
def replicate_pooling(spark, d):
    return m.pool_replicates(_run_metrics(spark, d), ["dataset", "q"], ["rmse", "mae"])


@query(
    "D34_grid_spread",
    sql(
        "preds",
        f"""select dataset, w, {', '.join(d6(f'max(rmse) filter (where q={q})', f'q{q}') for q in b.QUANTA)}, round(max(rmse)-min(rmse),6) as spread,
        arg_min(q, rmse) as best, arg_max(q, rmse) as worst from (select dataset, n as w, q, {ERR[0]} as rmse from preds group by all) group by all""",
    ),
)
def grid_spread(spark, d):
    return m.grid_spread(_run_metrics(spark, d), ["dataset", "w"], "q", b.QUANTA)


@query(
    "D35_condition_variability",
    sql(
        "preds",
        f"""select dataset, q, count(*) as seeds, {d6('avg(rmse)','mean')}, {d6('stddev_samp(rmse)','sd')}, {d6('max(rmse)-min(rmse)','range')},
        array_to_string(list_sort(list(distinct cast(modal as bigint))),',') as modal_values from (
        select dataset, n, q, {ERR[0]} as rmse from preds group by all) join (select dataset, n, q, arg_min(pred, struct_pack(a := -c, b := pred)) as modal
        from (select dataset, n, q, pred, count(*) as c from preds group by all) group by all) using (dataset, n, q) group by all""",
    ),
)
def condition_variability(spark, d):
    p = b.predictions(spark, d).withColumnRenamed("n", "w")
    by = ["dataset", "w", "q"]
    runs = m.error_metrics(p, by).join(m.concentration(p, by).select(*by, "modal_value"), by)
    return m.condition_variability(runs, ["dataset", "q"], "rmse", "modal_value")


PAIRS = """select a.dataset, a.run as run_a, b.run as run_b, count(*) as units, count(*) filter (where a.pred=b.pred) as same
        from runs a join runs b on a.unit=b.unit and a.run<b.run group by all"""
AGREE = f"""select dataset, run_a, run_b, units, 100e0*same/units as observed_pct, 100e0*coalesce(chance,0) as chance_pct, 100e0*same/units-100e0*coalesce(chance,0) as excess_pct
        from ({PAIRS}) left join (select a.dataset, a.run as run_a, b.run as run_b, sum(a.p*b.p) as chance from marg a join marg b on a.dataset=b.dataset and a.pred=b.pred and a.run<b.run group by all)
        using (dataset, run_a, run_b)"""
MARG = "select dataset, run, pred, c/cast(sum(c) over (partition by dataset, run) as double) as p from (select dataset, run, pred, count(*) as c from runs group by all)"


@query(
    "C7_pair_runs",
    sql("runs", "select a.dataset, a.unit, a.pred as pred_a, b.pred as pred_b from runs a join runs b on a.unit=b.unit and a.run='r1' and b.run='r2'"),
)
def pair_runs(spark, d):
    r = b.replicate_runs(spark, d)
    return m.pair_runs(r.where(F.col("run") == "r1"), r.where(F.col("run") == "r2"))


@query("C8_run_pairs", sql("runs", PAIRS))
def run_pairs(spark, d):
    return m.run_pairs(b.replicate_runs(spark, d), b.REPLICATES)


@query(
    "D36_run_agreement",
    sql("runs", f"select dataset, run_a, run_b, units, {d6('observed_pct','observed_pct')}, {d6('chance_pct','chance_pct')}, {d6('excess_pct','excess_pct')} from ({AGREE})", marg=MARG),
)
def run_agreement(spark, d):
    return m.run_agreement(b.replicate_runs(spark, d), b.REPLICATES)


@query(
    "D36_mean_agreement",
    sql("runs", f"select dataset, count(*) as pairs, {d6('avg(observed_pct)','observed_pct')}, {d6('avg(chance_pct)','chance_pct')}, {d6('avg(excess_pct)','excess_pct')} from ({AGREE}) group by 1", marg=MARG),
)
def mean_agreement(spark, d):
    return m.mean_agreement(m.run_agreement(b.replicate_runs(spark, d), b.REPLICATES))


@query(
    "D37_wilson",
    sql(
        "",
        """select l_returnflag as flag, n, k, round((p+z*z/(2*n))/(1+z*z/n)-z*sqrt(p*(1-p)/n+z*z/(4e0*n*n))/(1+z*z/n),6) as lo,
        round((p+z*z/(2*n))/(1+z*z/n)+z*sqrt(p*(1-p)/n+z*z/(4e0*n*n))/(1+z*z/n),6) as hi from (
        select l_returnflag, count(*) as n, count(*) filter (where l_discount>0.05e0) as k, count(*) filter (where l_discount>0.05e0)/count(*)::double as p, 1.959963985e0 as z from lineitem group by 1)""",
    ),
)
def wilson(spark, d):
    g = b.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k")
    )
    lo, hi = nm.wilson("k", "n")
    return g.select("flag", "n", "k", lo.alias("lo"), hi.alias("hi"))


@query(
    "D38_histogram",
    sql(
        "",
        """select l_returnflag as flag, cast(least(floor(v/10),12)*10 as double) as bin_start, count(*) filter (where s='a') as n_truth, count(*) filter (where s='b') as n_pred from (
        select l_returnflag, unnest(['a','b']) as s, unnest([l_quantity*2.6e0, round(l_discount*1300,6)]) as v from lineitem) where v between 0 and 130 group by all""",
    ),
)
def histogram(spark, d):
    li = b.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_quantity") * 2.6).alias("truth"), F.round(F.col("l_discount") * 1300, 6).alias("pred")
    )
    return m.histogram(li, ["truth", "pred"], by=["flag"])


def _texted(spark, d):
    """Responses with a predicted number: text length stands for the estimate, n_chars for the truth."""
    docs = b.table(spark, d, "documents")
    return docs.select(
        "lang",
        "source",
        "doc_id",
        (F.length("text") % 41).cast("double").alias("pred"),
        F.least(F.lit(40), F.floor(F.col("n_chars") / 100)).cast("double").alias("truth"),
        F.when(F.col("doc_id") % 10 == 3, " ").otherwise(F.col("text")).alias("text"),
    )


TEXTED = """select lang, source, doc_id, cast(length(text)%41 as double) as pred, cast(least(40, floor(n_chars/100)) as double) as truth,
        case when doc_id%10=3 then ' ' else text end as text from documents"""


@query(
    "D39_run_manifest",
    sql(
        "",
        f"""select * from (select source, {ERRS}, {d6('avg(pred)','pred_mean')}, {d6('avg(truth)','truth_mean')}, count(*) filter (where trim(text)='') as empty_texts,
        {d6('avg(length(text))','text_chars_mean')} from t group by 1) join ({CONC.format(by='source', v='pred', t='t')}) using (source)""",
        t=TEXTED,
    ),
)
def run_manifest(spark, d):
    return m.run_manifest(_texted(spark, d), ["source"], "text")


@query(
    "D39_manifest_totals",
    sql(
        "",
        """select coalesce(experiment,'ALL') as experiment, count(*) as runs, cast(sum(n) as bigint) as responses from (
        select source, case when cast(regexp_extract(source,'(\\d+)$',1) as int)<10 then 'first ten' else 'others' end as experiment, count(*) as n from documents group by all) group by rollup(experiment)""",
    ),
)
def manifest_totals(spark, d):
    runs = m.run_manifest(_texted(spark, d), ["source"], "text")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return m.manifest_totals(runs.withColumn("experiment", F.when(number < 10, "first ten").otherwise("others")), "experiment")


@query(
    "D41_select_best",
    sql(
        "preds",
        f"""select dataset, metric, config, round(value,6) as value, true as chosen_on_test from (select *, row_number() over (partition by dataset, metric order by value, config) as r from (
        select dataset, 'n'||n||'|q'||q as config, unnest(['rmse','mae','score']) as metric, unnest([{ERR[0]}, {ERR[1]}, {ERR[2]}]) as value from preds group by dataset, n, q)) where r=1""",
    ),
)
def select_best(spark, d):
    runs = _run_metrics(spark, d).withColumn("config", F.concat(F.lit("n"), "w", F.lit("|q"), "q"))
    return m.select_best(runs, ["dataset"], ["rmse", "mae", "score"], "config")


@query(
    "D42_error_parts",
    sql("lpreds", f"select config, {d6('var_pop(truth)','variance')}, {d6('(avg(truth)-30)*(avg(truth)-30)','bias2')}, {d6('avg((truth-30)*(truth-30))','mse')}, {d6('avg((truth-30)*(truth-30))','mse_direct')} from lpreds group by 1"),
)
def error_parts(spark, d):
    return m.constant_error_parts(b.line_predictions(spark, d), 30, ["config"])


@query(
    "D43_partial_runs",
    sql(
        "",
        """select dataset, config, n, expected, expected-n as missing from (select o_orderpriority as dataset, o_orderstatus as config, count(*) as n from orders group by all)
        join (select dataset, max(n) as expected from (select o_orderpriority as dataset, o_orderstatus, count(*) as n from orders group by all) group by 1) using (dataset) where n<expected""",
    ),
)
def partial_runs(spark, d):
    """Order states as runs over the orders of a priority: each covers another number of them."""
    orders = b.table(spark, d, "orders")
    runs = orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("config")).agg(F.count(F.lit(1)).alias("n"))
    return m.partial_runs(runs, runs.groupBy("dataset").agg(F.max("n").alias("expected")))


@query(
    "C11_pred_vs_true",
    sql(
        "train preds",
        f"""select dataset, unit, max(truth) as truth, {', '.join(f"max(pred) filter (where q={q} and n={n}) as n{n}_q{q}" for n in b.LENGTHS for q in b.QUANTA)}, max(c) as const_train_mean
        from preds join (select dataset, round(avg(rul),6) as c from train group by 1) using (dataset) group by all""",
    ),
)
def pred_vs_true(spark, d):
    p = b.predictions(spark, d).withColumn("config", F.format_string("n%d_q%d", "n", "q"))
    return m.pred_vs_true(p, baselines(spark, d), [f"n{n}_q{q}" for n in b.LENGTHS for q in b.QUANTA])


# ------------------------------------------------------------------ sorts, sets, unions
@query(
    "H1_sort_configs",
    sql("preds", f"select dataset, w, q, n, {ERRS} from (select * exclude (n), n as w from preds) group by dataset, w, q".replace("w, q, n, ", "w, q, count(*) as n, ")),
)
def sort_configs(spark, d):
    return va.sort_configs(_run_metrics(spark, d), "dataset", "q", "w")


@query(
    "H2_value_frequencies",
    sql("lpreds", "select config, value, count, rank from (select *, row_number() over (partition by config order by count desc, value) as rank from (select config, pred as value, count(*) as count from lpreds group by all)) where rank<=3"),
)
def value_frequencies(spark, d):
    return m.top_values(b.line_predictions(spark, d), ["config"], 3)


@query("H3_head_per", sql("preds", "select dataset, n, q, unit, pred from (select *, row_number() over (partition by dataset, n, q order by pred desc, unit) as r from preds) where r<=3"))
def head_per(spark, d):
    best = [F.col("pred").desc(), "unit"]
    return sp.head_per(b.predictions(spark, d), ["dataset", "n", "q"], best, 3).select("dataset", "n", "q", "unit", "pred")


@query(
    "H4_compare_models",
    sql(
        "train preds",
        f"""select dataset, 'n'||n||'|q'||q as model, {d6(ERR[0],'rmse')}, cast(null as double) as constant from preds group by dataset, n, q
        union all select dataset, baseline, round(rmse,6), round(constant,6) from ({CONST})""",
        test=TEST,
    ),
)
def compare_models(spark, d):
    runs = _run_metrics(spark, d).select("dataset", F.concat(F.lit("n"), "w", F.lit("|q"), "q").alias("model"), "rmse")
    consts = baselines(spark, d).select("dataset", F.col("baseline").alias("model"), "rmse", "constant")
    return m.compare_models(runs, consts)


@query(
    "H5_set_equal",
    sql("", "select v, 'a' as only_in from (select c_custkey as v from customer except select o_custkey from orders) union all select v, 'b' from (select o_custkey as v from orders except select c_custkey from customer)"),
)
def set_equal(spark, d):
    """Customers without orders, and customers of orders that are not listed."""
    listed = b.table(spark, d, "customer").select(F.col("c_custkey").alias("v"))
    return va.set_equal(listed, b.table(spark, d, "orders").select(F.col("o_custkey").alias("v")))


@query(
    "H6_common_keys",
    sql("arms", "select engine, sensor from arms where arm='repl' and directional intersect select engine, sensor from arms where arm='revdata' and directional"),
)
def common_keys(spark, d):
    a = shared(b.arm_claims(spark, d).where("directional").select("arm", "engine", "sensor"))
    return va.common_keys(a.where(F.col("arm") == "repl"), a.where(F.col("arm") == "revdata"), ["engine", "sensor"])


@query(
    "H7_distinct_list",
    sql("preds", "select distinct dataset, n, q, cast(pred as bigint) as value from preds"),
)
def distinct_list(spark, d):
    return m.distinct_list(b.predictions(spark, d).withColumn("pred", F.col("pred").cast("long")), ["dataset", "n", "q"], "pred")


# ------------------------------------------------------------------ models
FEATURE_SENSORS = ("s1", "s2", "s5", "s6")


def model_predictions(spark, d, name, fit):
    """A supervised reference and the constant, long form."""
    traj = shared(b.trajectories(spark, d))
    train = fr.sliding_features(fr.with_rul(traj, b.CAP), FEATURE_SENSORS, 30, keep=["rul"])
    obs = b.observed(traj)
    test = fr.tail_features(obs, FEATURE_SENSORS, 30)
    truth = obs.groupBy("dataset", "unit").agg(F.least(F.lit(b.CAP), F.max("life") - F.max("cycle")).cast("double").alias("truth"))
    predict = fit(train, md.feature_names(FEATURE_SENSORS))
    # all trees on few wide rows: a partition a core, and once for all scores
    known = test.join(truth, ["dataset", "unit"]).repartition(spark.sparkContext.defaultParallelism, "dataset", "unit")
    own = shared(predict(known, b.CAP).select("dataset", "unit", "pred", "truth"))
    consts = baselines(spark, d, traj).where(F.col("baseline") == "train_mean").select("dataset", F.col("constant").alias("pred"))
    flat = truth.join(consts, "dataset")
    parts = ((name, own), ("train_mean", flat))
    return m.compare_models(*[p.select("dataset", "unit", F.lit(n).alias("model"), "pred", "truth") for n, p in parts])


@query("K1_forest")
def forest(spark, d):
    """200 trees of depth 12 on all sliding windows, against the constant."""
    return m.score_models(model_predictions(spark, d, "forest", md.fit_forest))


@query("K2_boosting")
def boosted(spark, d):
    """600 rounds of depth 6 on all sliding windows, against the constant."""
    return m.score_models(model_predictions(spark, d, "boosting", md.fit_boosting))


@query(
    "K3_K4_score_models",
    sql(
        "lpreds",
        f"""select dataset, model, n, rmse, mae, score, range, distinct_3dp, case when range>=1e-3 then rho end as rho from (
        select dataset, model, count(*) as n, {ERRS}, round(max(pred)-min(pred),6) as range, count(distinct round(pred,3)) as distinct_3dp, round(corr(rx,ry),6) as rho
        from ({RANKED.format(by='dataset,model', x='pred', y='truth', t='longp')}) group by all)""",
        longp="select config as dataset, 'line' as model, pred, truth from lpreds union all select config, 'mean', avg(truth) over (partition by config), truth from lpreds",
    ),
)
def score_models(spark, d):
    """A predictor against the group's mean, which is degenerate and gets no rank correlation."""
    p = b.line_predictions(spark, d).withColumnRenamed("config", "dataset")
    means = p.groupBy("dataset").agg(F.avg("truth").alias("pred"))
    flat = p.select("dataset", "truth").join(means, "dataset").withColumn("model", F.lit("mean"))
    return m.score_models(m.compare_models(p.select("dataset", "truth", "pred", F.lit("line").alias("model")), flat))


@query("B4_operating_regimes", sql("traj", "select setting1, setting2, 1::bigint as regimes, count(*) as rows from traj group by all"))
def operating_regimes(spark, d):
    """Six k-means regimes on the settings, and how the rows spread over them."""
    traj = b.trajectories(spark, d)
    regimes = md.fit_regimes(traj, b.SETTINGS)(traj)
    return regimes.groupBy("setting1", "setting2").agg(F.count_distinct("regime").alias("regimes"), F.count(F.lit(1)).alias("rows"))
