"""Queries on validation and audits (survey ids D24–D26, F8, A8, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import resample as rs
from ..operators import validate as va
from ..session import staging_path
from ..sources import files
from . import bindings as b
from .oracle import d6, sql
from .q_metrics import ERRS
from .q_resample import B
from .registry import query

DIRN = ("increase", "decrease")


def _readings(spark, d):
    """Every line item of returned flags as a case: extractor from discount, reader from tax, references from price and size."""
    li = b.table(spark, d, "lineitem")
    names = F.array(*[F.lit(x) for x in va.LABELS])
    pick = lambda c: F.element_at(names, (F.pmod(c, F.lit(5)) + 1).cast("int"))
    two = lambda c: F.when(c, "increase").otherwise("decrease")
    disc, tax = F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
    extractor = pick(disc)
    df = li.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_returnflag").alias("flag"),
        extractor.alias("extractor"),
        F.when(tax > 2, extractor).otherwise(pick(disc + tax)).alias("reader"),
        two(F.col("l_quantity") > 25).alias("expected"),
        F.when(F.col("l_suppkey") % 3 == 0, "stable").otherwise(two(F.col("l_partkey") % 2 == 0)).alias("actual"),
        two(F.col("l_suppkey") % 2 == 0).alias("measured"),
        (F.col("l_linenumber") != 3).alias("attested"),
    )
    return df.withColumn("conflict", F.col("attested") & (F.col("measured") != F.col("expected")))


READ = """select *, attested and measured<>expected as conflict from (select l_orderkey, l_partkey, l_suppkey, line, flag, ex as extractor, case when tax>2 then ex else L[(disc+tax)%5+1] end as reader,
        case when l_quantity>25 then 'increase' else 'decrease' end as expected,
        case when l_suppkey%3=0 then 'stable' when l_partkey%2=0 then 'increase' else 'decrease' end as actual,
        case when l_suppkey%2=0 then 'increase' else 'decrease' end as measured, line<>3 as attested
        from (select *, L[disc%5+1] as ex from (select *, l_linenumber::bigint as line, l_returnflag as flag, round(l_discount*100)::bigint as disc, round(l_tax*100)::bigint as tax,
        ['increase','decrease','stable','unspecified','absent'] as L from lineitem)))"""
SAMPLE_Q = "select * from readings where flag='R'"
WEIGHTS = "select extractor, count(*) filter (where flag='R') as sampled, count(*) as corpus, count(*)/(count(*) filter (where flag='R'))::double as weight from readings group by 1"


def _sample(spark, d):
    """Returned items are the read sample, all items the corpus."""
    corpus = _readings(spark, d)
    sample = corpus.where(F.col("flag") == "R")
    weights = va.stratum_weights(sample, corpus, "extractor")
    return sample, weights


@query(
    "D24_confusion",
    sql("", "select a.x as extractor, b.x as reader, count(r.line) as n from (select unnest(['increase','decrease','stable','unspecified','absent']) as x) a, (select unnest(['increase','decrease','stable','unspecified','absent']) as x) b left join readings r on r.extractor=a.x and r.reader=b.x group by all", readings=READ),
)
def confusion(spark, d):
    return va.confusion(_readings(spark, d), "extractor", "reader", va.LABELS)


@query(
    "D24_class_scores",
    sql(
        "",
        """select x as class, count(*) filter (where extractor=x and reader=x) as hits, count(*) filter (where extractor=x) as called, count(*) filter (where reader=x) as labelled,
        round(count(*) filter (where extractor=x and reader=x)/(count(*) filter (where extractor=x))::double,6) as precision, round(count(*) filter (where extractor=x and reader=x)/(count(*) filter (where reader=x))::double,6) as recall
        from readings, (select unnest(['increase','decrease','stable','unspecified','absent']) as x) group by all""",
        readings=READ,
    ),
)
def class_scores(spark, d):
    return va.class_scores(_readings(spark, d), "extractor", "reader", va.LABELS)


D_ = "{} in ('increase','decrease')"


@query(
    "D24_pooled_scores",
    sql(
        "",
        """select flag, count(*) filter (where e and r) as hits, round(count(*) filter (where e and r)/(count(*) filter (where e))::double,6) as precision, round(count(*) filter (where e and r)/(count(*) filter (where r))::double,6) as recall,
        count(*) filter (where e and r and extractor=reader) as sign_ok, round(100e0*count(*) filter (where e and r and extractor=reader)/count(*) filter (where e and r),6) as sign_pct
        from (select *, extractor in ('increase','decrease') as e, reader in ('increase','decrease') as r from readings) group by 1""",
        readings=READ,
    ),
)
def pooled_scores(spark, d):
    return va.pooled_scores(_readings(spark, d), "extractor", "reader", ["flag"])


FIG = {
    "stated_claims": ("c", None),
    "reference_pct": ("c and lab=expected", "c"),
    "input_pct": ("c and lab=actual", "c"),
    "base_rate_pct": ("c and expected=actual", "c"),
    "input_over_base_pct": (None, "c"),
    "measured_pct": ("c and attested and lab=measured", "c and attested"),
    "conflict_reference_pct": ("c and conflict and lab=expected", "c and conflict"),
}


def figure_sql(lab: str, name: str) -> str:
    s = lambda cond: f"sum(case when {cond} then weight else 0 end)".replace("lab", lab).replace("c and", f"{lab} in ('increase','decrease') and") if cond != "c" else f"sum(case when {lab} in ('increase','decrease') then weight else 0 end)"
    num, den = FIG[name]
    if name == "stated_claims":
        return s("c")
    if name == "input_over_base_pct":
        return f"100e0*({s(FIG['input_pct'][0])}-{s(FIG['base_rate_pct'][0])})/{s('c')}"
    return f"100e0*{s(num)}/{s(den)}"


@query(
    "D25_reweighted_figures",
    sql(
        "",
        " union all ".join(
            f"select '{k}' as figure, {d6(figure_sql('extractor', k), 'extractor')}, {d6(figure_sql('reader', k), 'reader')}, {d6(figure_sql('reader', k) + '-' + figure_sql('extractor', k), 'difference')} from ws"
            for k in FIG
        ),
        readings=READ,
        ws=f"select s.*, weight from ({SAMPLE_Q}) s join ({WEIGHTS}) w using (extractor)",
    ),
)
def reweighted_figures(spark, d):
    sample, weights = _sample(spark, d)
    return va.reweighted_figures(va.reweight(sample, weights, "extractor"), "extractor", "reader")


@query(
    "D25_corpus_accuracy",
    sql(
        "",
        """select coalesce(extractor,'ALL') as extractor, cast(sum(sampled) as bigint) as sampled, cast(sum(agree) as bigint) as agree, cast(sum(corpus) as bigint) as corpus, round(100e0*sum(agree/sampled::double*corpus)/sum(corpus),6) as accuracy_pct from (
        select extractor, count(*) filter (where flag='R') as sampled, count(*) filter (where flag='R' and extractor=reader) as agree, count(*) as corpus from readings group by 1) group by rollup(extractor)""",
        readings=READ,
    ),
)
def corpus_accuracy(spark, d):
    sample, weights = _sample(spark, d)
    return va.corpus_accuracy(sample, weights, "extractor", F.col("extractor") == F.col("reader"))


ERR_SQL = """select '{n}' as error, cast(sum(cases) as bigint) as cases, cast(sum(a) as bigint) as on_reference, cast(sum(b) as bigint) as on_window, round(sum(cases/sampled::double*corpus),6) as corpus_estimate, 0::bigint as corpus_unseen from (
        select extractor, count(*) filter (where flag='R') as sampled, count(*) as corpus, count(*) filter (where flag='R' and {c}) as cases,
        count(*) filter (where flag='R' and {c} and {l}=expected) as a, count(*) filter (where flag='R' and {c} and {l}=actual) as b from readings group by 1)"""


@query(
    "D26_extraction_errors",
    sql(
        "",
        " union all ".join(
            ERR_SQL.format(n=n, c=c, l=l)
            for n, c, l in (
                ("missed", "extractor not in ('increase','decrease') and reader in ('increase','decrease')", "reader"),
                ("extra", "extractor in ('increase','decrease') and reader not in ('increase','decrease')", "extractor"),
                ("wrong_sign", "extractor in ('increase','decrease') and reader in ('increase','decrease') and extractor<>reader", "reader"),
            )
        ),
        readings=READ,
    ),
)
def extraction_errors(spark, d):
    sample, weights = _sample(spark, d)
    return va.extraction_errors(sample, "extractor", "reader", weights)


READERS = ("extractor", "reader")


@query("F8_stratified_bootstrap")
def stratified_bootstrap(spark, d):
    """All corpus figures of both readings and their differences, the sample resampled within strata."""
    sample, weights = _sample(spark, d)
    figures = va.WeightedFigures({r: r for r in READERS})
    rows = va.reweight(sample, weights, "extractor").withColumns(figures.columns)
    values = {f"{r}/{k}": v for r in READERS for k, v in figures.values[r].items()}
    values |= {f"difference/{k}": v for k, v in figures.differences(*READERS).items()}
    return rs.stratified_bootstrap(rows, "extractor", ["l_orderkey", "line", "l_partkey", "l_suppkey"], list(figures.columns), values, B)


@query(
    "J4_label_violations",
    sql(
        "",
        """select 'duplicate' as "check", (select count(*) from (select o_custkey from orders group by 1 having count(*)>1)) as violations
        union all select 'missing', (select count(*) from customer where c_custkey not in (select o_custkey from orders))
        union all select 'unlisted', (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer))
        union all select 'outside_domain', (select count(*) from orders where o_orderstatus not in ('O','F'))""",
    ),
)
def label_violations(spark, d):
    """Orders as labels of customers: duplicates, customers without one, unknown customers, foreign values."""
    key = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    labels = b.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return va.label_violations(labels, key, "id", "o_orderstatus", ["O", "F"])


STATED = "select config||'/'||f as name, v*(case f when 'rmse' then 1 when 'mae' then 1.01e0 else 1.001e0 end) as stated from (select config, unnest(['rmse','mae','score']) as f, unnest([rmse,mae,score]) as v from m) where not (config='AF' and f='mae')"
FACTS = "select config||'/'||f as name, v as value from (select config, unnest(['rmse','mae','score']) as f, unnest([rmse,mae,score]) as v from m)"
METRICS = f"select config, {ERRS} from lpreds group by 1"


def _facts(spark, d):
    runs = m.error_metrics(b.line_predictions(spark, d), ["config"])
    rounded = runs.select("config", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "score")])
    return va.facts((rounded, ["config"], ["rmse", "mae", "score"]))


@query("J7_facts", sql("lpreds", f"select name, value from ({FACTS})", m=METRICS))
def facts(spark, d):
    return _facts(spark, d)


@query(
    "J1_audit",
    sql(
        "lpreds",
        f"""select s.name, round(stated,4) as stated, fact, case when fact is null then 'missing' when abs(stated-fact)<greatest(0.051,abs(fact)*0.002) then 'ok' else 'mismatch' end as status
        from (select case when name='NO/mae' then 'NO/unknown' else name end as name, stated from ({STATED})) s left join (select name, value as fact from ({FACTS})) f using (name)""",
        m=METRICS,
    ),
)
def audit(spark, d):
    """Numbers off by nothing, 1 % and 0.1 %, and one without a fact."""
    known = _facts(spark, d)
    factor = F.when(F.col("name").endswith("mae"), 1.01).when(F.col("name").endswith("score"), 1.001).otherwise(1.0)
    stated = known.where(F.col("name") != "AF/mae").select(
        F.when(F.col("name") == "NO/mae", "NO/unknown").otherwise(F.col("name")).alias("name"), (F.col("value") * factor).alias("stated")
    )
    return va.audit(stated, known).withColumn("stated", F.round("stated", 4))


@query(
    "J2_verify_cells",
    sql(
        "",
        """select o_orderstatus||'/'||o_orderpriority as name, status, count(*) as cells from (select *, case when abs(shown-fact)<=greatest(case when pct then 0.51 else 0.011 end, abs(fact)*0.002) then 'ok' else 'mismatch' end as status from (
        select *, o_totalprice/1000 as fact, o_orderkey%2=0 as pct, round(o_totalprice/1000*(case when o_custkey%5=0 then 1.01e0 else 1e0 end),1) as shown from orders)) group by all""",
    ),
)
def verify_cells(spark, d):
    """Order totals printed with one decimal, some as percent, some wrong by 1 %."""
    o = b.table(spark, d, "orders")
    fact = F.col("o_totalprice") / 1000
    shown = F.round(fact * F.when(F.col("o_custkey") % 5 == 0, 1.01).otherwise(1.0), 1).cast("decimal(20,1)").cast("string")
    cells = o.select(
        F.col("o_orderkey").cast("string").alias("name"),
        F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("kind"),
        F.concat(shown, F.when(F.col("o_orderkey") % 2 == 0, " %").otherwise("")).alias("cell"),
    )
    known = o.select(F.col("o_orderkey").cast("string").alias("name"), fact.alias("value"))
    return va.verify_cells(cells, known).groupBy(F.col("kind").alias("name"), "status").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "J3_phrase_audit",
    sql(
        "",
        """select phrase, count(doc_id) as texts, count(doc_id)>0 as present from (select distinct text as phrase from benchmark where text is not null union select 'item '||item_id from benchmark) p
        left join documents d on contains(d.text, p.phrase) group by 1""",
    ),
)
def phrase_audit(spark, d):
    """Benchmark items and rebuilt labels, whole, searched in every document."""
    bench = b.table(spark, d, "benchmark")
    rebuilt = F.format_string("item %d", F.col("item_id"))
    phrases = bench.select(F.col("text").alias("phrase")).union(bench.select(rebuilt)).distinct()
    return va.phrase_audit(phrases, b.table(spark, d, "documents"), "doc_id", "text")


@query(
    "J5_rederived_claims",
    sql("", "select event_id, event_type as stored, case when value<=100 then event_type end as derived from events where value>100"),
)
def rederived_claims(spark, d):
    """A stored column re-derived from its source; some values cannot be derived and must show up."""
    ev = b.table(spark, d, "events").select("event_id", F.col("event_type").alias("v"), "value")
    derived = ev.withColumn("v", F.when(F.col("value") <= 100, F.col("v")))
    return va.rederived_differences(ev, derived, ["event_id"], "v")


@query(
    "A1_trajectory_files",
    sql("traj", "select dataset, unit, cycle, setting1, round(s1,6) as s1, round(s2,6) as s2, s3 from traj"),
)
def trajectory_files(spark, d):
    """All trajectories written as whitespace-separated text and read back; a column without readings is dropped."""
    path, columns = staging_path(spark), ["unit", "cycle", "setting1", "s1", "s2", "s3", "empty"]
    files.write_trajectories(b.trajectories(spark, d).withColumn("empty", F.lit(None).cast("double")), path, columns)
    return files.read_trajectories(spark, path, columns)


@query("A4_summary_files", sql("lpreds", f"select config, count(*) as n, {ERRS} from lpreds group by all"))
def summary_files(spark, d):
    """A run summary written as CSV and read back."""
    path = staging_path(spark)
    files.write_summary(m.error_metrics(b.line_predictions(spark, d), ["config"]), path)
    return files.read_summary(spark, path, "config string, n bigint, rmse double, mae double, score double")


@query(
    "A8_upsert",
    sql(
        "",
        """select o_orderpriority as key, count(*) as n, round(avg(o_totalprice),6) as mean from orders where o_orderpriority not in (select o_orderpriority from orders where o_orderstatus='F') group by 1
        union all select o_orderpriority, count(*), round(avg(o_totalprice),6) from orders where o_orderstatus='F' group by 1""",
    ),
)
def upsert(spark, d):
    """A summary over all orders, renewed by the keys of finished ones."""
    o = b.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "key")
    block = [F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")]
    return va.upsert(o.groupBy("key").agg(*block), o.where(F.col("o_orderstatus") == "F").groupBy("key").agg(*block), ["key"])


# ------------------------------------------------------------------ files
TRACED = """select *, 'traces_'||dataset||'1_'||mode||'_k'||k||'_n'||n||'.json' as file from (
        select dataset, mode, n, case mode when 'zero_shot' then 0 else 3 end as k, unit, resp, length(text)%126 as truth, resp%126 as pred, text from resp)"""


def _trace_files(spark, d, write=files.write_traces):
    """Responses written as trace files, one per dataset, mode and window length."""
    r = b.responses(spark, d)
    k = F.when(F.col("mode") == "zero_shot", 0).otherwise(3)
    name = F.concat(F.lit("traces_"), "dataset", F.lit("1_"), "mode", F.lit("_k"), k.cast("string"), F.lit("_n"), F.col("n").cast("string"), F.lit(".json"))
    rows = r.select(
        F.col("unit").alias("engine_id"),
        (F.length("text") % 126).cast("double").alias("true_rul"),
        (F.col("resp") % 126).cast("double").alias("pred_rul"),
        F.col("text").alias("reasoning"),
        name.alias("file"),
    )
    path = staging_path(spark)
    write(rows, path)
    return path


TRACE_KEYS = "dataset||'1' as dataset, mode, k::bigint as k, n as n_cycles"


TRACE_SCORES = sql(
    "resp", f"select {TRACE_KEYS}, count(*) as n, {ERRS} from (select *, n as w from traced) group by dataset, mode, k, n", traced=TRACED
)


@query("A3_trace_files", TRACE_SCORES)
def trace_files(spark, d):
    """Trace files read back with the configuration in their names, and scored."""
    traces = files.read_traces(spark, _trace_files(spark, d), array_files=False)
    return m.error_metrics(traces, ["dataset", "mode", "k", "n_cycles"])


@query("A3_array_files", TRACE_SCORES)
def array_files(spark, d):
    """The same from files of JSON arrays, read in byte ranges."""
    traces = files.read_traces(spark, _trace_files(spark, d, files.write_array_traces))
    return m.error_metrics(traces, ["dataset", "mode", "k", "n_cycles"])


@query(
    "A6_trace_manifest",
    sql(
        "resp",
        f"""select file, {TRACE_KEYS}, case when mode='zero_shot' then 'zero' else 'other' end as experiment, count(*) as responses,
        count(distinct pred) as distinct_values, true as hashed from traced group by all""",
        traced=TRACED,
    ),
)
def trace_manifest(spark, d):
    """One row per trace file: path, size, hash, class, configuration and run statistics."""
    found = files.trace_manifest(spark, _trace_files(spark, d), (("zero", "zero_shot"),), array_files=False)
    return found.select(
        "file",
        "dataset",
        "mode",
        "k",
        "n_cycles",
        "experiment",
        F.col("n").alias("responses"),
        "distinct_values",
        ((F.length("sha256") == 64) & (F.col("bytes") > 0) & F.col("path").endswith(F.col("file"))).alias("hashed"),
    )


#: Documents of a sheet, so that sheets grow in number and not in size.
SHEET_IDS = 5_000


@query(
    "A5_label_export",
    sql("", "select doc_id as \"case\", 's'||quality as sensor, case when toxic=1 then 'increase' else 'stable' end as label, toxic=1 as revealed from labels"),
)
def label_export(spark, d):
    """Labels written as exports of a reading tool, a list under either root key, wrapped or not, and imported."""
    lab = b.table(spark, d, "labels")
    one = F.struct(
        F.col("doc_id").alias("case"),
        F.concat(F.lit("s"), "quality").alias("sensor"),
        F.when(F.col("toxic") == 1, " Increase ").otherwise("STABLE").alias("first_label"),
        (F.col("toxic") == 1).alias("revealed"),
    )
    wrapped = F.struct(one.alias("data"))
    kinds = []
    for kind, (root, item) in enumerate((("readings", one), ("letture", one), ("readings", wrapped))):
        part = lab.where(F.col("doc_id") % 3 == kind).groupBy(F.floor(F.col("doc_id") / SHEET_IDS).alias("sheet"))
        kinds.append(part.agg(F.to_json(F.struct(F.collect_list(item).alias(root))).alias("value")))
    path = staging_path(spark)
    for i, export in enumerate(kinds):
        export.write.partitionBy("sheet").text(f"{path}/{i}")
    imported = [files.read_labels(spark, f"{path}/{i}") for i in range(len(kinds))]
    return m.compare_models(*imported).select("case", "sensor", "label", "revealed")
