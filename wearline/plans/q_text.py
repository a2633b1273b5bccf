"""Queries on texts: mentions, contexts, parsers, cells and names (survey ids I, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import text as tx
from ..operators import claims as cl
from ..operators import metrics as m
from ..operators import validate as va
from ..session import spread
from . import bindings as b
from .oracle import CTX, mentions, said, sql, values
from .registry import query

DOCS = "select doc_id as resp, text from documents"
TURNS = "select conv_id||':'||turn as resp, text from conversations"


@query("I1_classify_documents", sql("", "select resp, sensor, claimed, mentions from " + said("t", "resp"), t=DOCS))
def classify_documents(spark, d):
    docs = b.documents(spark, d).select(F.col("doc_id").alias("resp"), "text")
    return cl.classify(docs, ["resp"], "text", b.TERMS, b.LEXICON)


@query("I1_classify_conversations", sql("", "select resp, sensor, claimed, mentions from " + said("t", "resp"), t=TURNS))
def classify_conversations(spark, d):
    turns = spread(b.table(spark, d, "conversations")).select(F.concat_ws(":", "conv_id", "turn").alias("resp"), "text")
    return cl.classify(turns, ["resp"], "text", b.TERMS, b.LEXICON)


EVERY = f"(select s.resp, t.sensor from t s cross join {values('t', b.TERMS.items(), 'sensor', 'term')} t)"


@query(
    "I2_matched_clauses",
    sql(
        "",
        f"""select resp, sensor, md5(clause) as clause_md5, regexp_matches(clause, 'blest|therr|eurs') as off_trend from (
        select resp, sensor, coalesce(clause,'') as clause from {EVERY} left join (
        select resp, sensor, string_agg({CTX}, ' || ' order by i) as clause from {mentions('t', 'resp', 60, 80)} group by all) using (resp, sensor))""",
        t=DOCS,
    ),
)
def matched_clauses(spark, d):
    docs = b.documents(spark, d).select(F.col("doc_id").alias("resp"), "text")
    out = cl.matched_clauses(docs, ["resp"], "text", b.TERMS, "blest|therr|eurs")
    return out.select("resp", "sensor", F.md5("clause").alias("clause_md5"), "off_trend")


@query(
    "I3_reader_contexts",
    sql(
        "",
        f"""select resp, sensor, mentions, md5(context) as context_md5, length(context) as chars from (
        select resp, sensor, coalesce(context,'') as context, coalesce(mentions,0)::bigint as mentions from {EVERY} left join (
        select resp, sensor, max(mentions) as mentions, string_agg((case when more_left then '...' else '' end)||replace(before||token||after,chr(10),' ')||(case when more_right then '...' else '' end), ' || ' order by i) as context
        from {mentions('t', 'resp', 120, 160)} group by all) using (resp, sensor))""",
        t=DOCS,
    ),
)
def reader_contexts(spark, d):
    docs = b.documents(spark, d).select(F.col("doc_id").alias("resp"), "text")
    out = cl.reader_contexts(docs, ["resp"], "text", b.TERMS)
    return out.select("resp", "sensor", "mentions", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


# Replies of several shapes, built around whole documents: tagged, tagged twice, hidden
# thinking, bare number, out of range, nothing.
def _replies(spark, d):
    x = F.col("n_chars").cast("string")
    shape = F.col("doc_id") % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("RUL_ESTIMATE: "), x, F.lit("\nREASONING: "), F.col("text")))
        .when(shape == 1, F.concat(F.lit("RUL_ESTIMATE: 7\nRUL_ESTIMATE: about "), x, F.lit(" cycles\nREASONING:  "), F.col("text")))
        .when(shape == 2, F.concat(F.lit("<think>maybe 99\n"), F.col("text"), F.lit("</THINK> rul_estimate: "), x, F.lit("\nreasoning: two\n words")))
        .when(shape == 3, F.concat(F.col("text"), F.lit(" so "), (F.col("n_chars") % 200).cast("string"), F.lit(" or 12 left")))
        .when(shape == 4, F.concat(F.lit("RUL_ESTIMATE: none\n"), F.col("text")))
        .otherwise(F.col("text"))
    )
    return b.documents(spark, d).select("doc_id", text.alias("reply"))


REPLIES = """select doc_id, case doc_id%6 when 0 then 'RUL_ESTIMATE: '||n_chars||chr(10)||'REASONING: '||text
        when 1 then 'RUL_ESTIMATE: 7'||chr(10)||'RUL_ESTIMATE: about '||n_chars||' cycles'||chr(10)||'REASONING:  '||text
        when 2 then '<think>maybe 99'||chr(10)||text||'</THINK> rul_estimate: '||n_chars||chr(10)||'reasoning: two'||chr(10)||' words'
        when 3 then text||' so '||(n_chars%200)||' or 12 left' when 4 then 'RUL_ESTIMATE: none'||chr(10)||text else text end as reply from documents"""
# RE2 has no lookaround: words are taken whole and then filtered.
NUMS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[0-9]{{1,3}}'))"
LINES = r"regexp_split_to_array(reply, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]')"


@query(
    "I4_parse_strict",
    sql(
        "",
        f"""select doc_id, least(125, coalesce(nullif(regexp_extract(tagged[-1],'[0-9]+'),''), loose, '75')::double)::bigint as estimate,
        md5(coalesce(trim(replace(reasons[-1],'REASONING:','')),'')) as reasoning_md5 from (
        select doc_id, list_filter({LINES}, lambda l: starts_with(l,'RUL_ESTIMATE:') and regexp_matches(l,'[0-9]')) as tagged,
        list_filter({LINES}, lambda l: starts_with(l,'REASONING:')) as reasons, {NUMS.format('reply')}[1] as loose from t)""",
        t=REPLIES,
    ),
)
def parse_strict(spark, d):
    """The reference's strict reading, which falls back to 75."""
    value, reason = tx.parse_strict("reply", fallback=75)
    return _replies(spark, d).select("doc_id", value.alias("estimate"), F.md5(reason).alias("reasoning_md5"))


@query(
    "I5_parse_robust",
    sql(
        "",
        f"""select doc_id, coalesce(case when tag is not null then least(125, tag::double)::bigint end, list_filter({NUMS.format('clean')}, lambda w: w::int<=125)[1]::bigint) as estimate, tag is not null as parse_ok, reasoning_md5
        from (select doc_id, clean, nullif(regexp_extract(clean,'(?i)RUL_ESTIMATE:\\s*([0-9]+)',1),'') as tag,
        md5(trim(regexp_replace(regexp_extract(clean,'(?is)REASONING:\\s*(.+)',1),'\\s+',' ','g'))) as reasoning_md5 from (
        select doc_id, trim(regexp_replace(reply,'(?is)<think>.*?</think>',' ','g'), ' '||chr(10)) as clean from t))""",
        t=REPLIES,
    ),
)
def parse_robust(spark, d):
    value, reason, ok = tx.parse_robust("reply")
    return _replies(spark, d).select("doc_id", value.alias("estimate"), ok.alias("parse_ok"), F.md5(reason).alias("reasoning_md5"))


@query(
    "D40_parse_quality",
    sql(
        "",
        f"""select shape, count(*) as n, round(100e0*avg(cast(tag is not null as int)),6) as parse_ok_pct,
        count(*) filter (where tag is null and len(list_filter({NUMS.format('clean')}, lambda w: w::int<=125))=0) as unparsed
        from (select doc_id%6 as shape, clean, nullif(regexp_extract(clean,'(?i)RUL_ESTIMATE:\\s*([0-9]+)',1),'') as tag from (
        select doc_id, regexp_replace(reply,'(?is)<think>.*?</think>',' ','g') as clean from t)) group by 1""",
        t=REPLIES,
    ),
)
def parse_quality(spark, d):
    value, _, ok = tx.parse_robust("reply")
    parsed = _replies(spark, d).select((F.col("doc_id") % 6).alias("shape"), value.alias("pred"), ok.alias("parse_ok"))
    return m.parse_quality(parsed, ["shape"])


FILES = """select l_orderkey, l_linenumber::bigint as line, case l_linenumber%5
        when 3 then 'traces_p1_grid_FD001_fs_k'||l_suppkey||'_n15.json' when 4 then 'traces_p2_FD00'||(l_linenumber%4+1)||'_zs_n30.json'
        when 0 then 'traces_FD00'||(l_linenumber%4+1)||'_few_shot_k'||l_suppkey||'_n'||l_quantity::bigint||'_run'||l_linenumber||'.json'
        when 1 then 'traces_FD00'||(l_linenumber%4+1)||'_zero_shot_k0.json'
        else 'traces_p1_FD001_fs_k5_n30_'||lower(l_returnflag)||'_seed'||l_linenumber||'.json' end as file from lineitem"""


def _files(spark, d):
    n = F.col("l_linenumber")
    ds = (n % 4 + 1).cast("string")
    name = (
        F.when(n % 5 == 3, F.concat(F.lit("traces_p1_grid_FD001_fs_k"), F.col("l_suppkey").cast("string"), F.lit("_n15.json")))
        .when(n % 5 == 4, F.concat(F.lit("traces_p2_FD00"), ds, F.lit("_zs_n30.json")))
        .when(n % 5 == 0, F.concat(F.lit("traces_FD00"), ds, F.lit("_few_shot_k"), F.col("l_suppkey").cast("string"), F.lit("_n"), F.col("l_quantity").cast("long").cast("string"), F.lit("_run"), n.cast("string"), F.lit(".json")))
        .when(n % 5 == 1, F.concat(F.lit("traces_FD00"), ds, F.lit("_zero_shot_k0.json")))
        .otherwise(F.concat(F.lit("traces_p1_FD001_fs_k5_n30_"), F.lower("l_returnflag"), F.lit("_seed"), n.cast("string"), F.lit(".json")))
    )
    return b.table(spark, d, "lineitem").select("l_orderkey", n.cast("long").alias("line"), name.alias("file"))


@query(
    "I8_config_from_file",
    sql(
        "",
        """select l_orderkey, line, case when line%5 in (2,3) then 'FD001' else 'FD00'||(line%4+1) end as dataset, case when line%5 in (1,4) then 'zero_shot' else 'few_shot' end as mode,
        case line%5 when 0 then l_suppkey when 3 then l_suppkey when 2 then 5 else 0 end as k, case line%5 when 0 then l_quantity::bigint when 1 then 5 when 3 then 15 else 30 end as n_cycles,
        case line%5 when 0 then 'run'||line else 'run1' end as run, case line%5 when 2 then line end as seed,
        case line%5 when 2 then lower(l_returnflag)||'_seed'||line end as variant from (select *, l_linenumber::bigint as line from lineitem)""",
    ),
)
def config_from_file(spark, d):
    """Names are built from the table and taken apart again."""
    cols = tx.config_from_file("file")
    return _files(spark, d).select("l_orderkey", "line", *[c.alias(n) for n, c in cols.items()])


@query("I8_safe_name", sql("", "select p_partkey, regexp_replace(p_name||':'||p_type,'[^A-Za-z0-9._-]','_','g') as name from part"))
def safe_name(spark, d):
    return b.table(spark, d, "part").select("p_partkey", tx.safe_name(F.concat_ws(":", "p_name", "p_type")).alias("name"))


@query(
    "I9_display_tags",
    sql("", """select l_orderkey, l_linenumber::bigint as line, case when l_linestatus='O' then 'ZS' else 'FS k='||l_suppkey end||', n='||l_linenumber||case when l_returnflag='A' or l_linenumber=1 then '' else ' [run'||l_linenumber||']' end as tag from lineitem"""),
)
def display_tags(spark, d):
    li = b.table(spark, d, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_linestatus") == "O", "zero_shot").otherwise("few_shot").alias("mode"),
        F.col("l_suppkey").alias("k"),
        F.when(F.col("l_returnflag") == "A", "run1").otherwise(F.concat(F.lit("run"), "l_linenumber")).alias("run"),
    )
    return li.select("l_orderkey", "line", tx.display_tag(n="line").alias("tag"))


@query(
    "I10_numbers_in_cells",
    sql("", "select o_orderkey, round(case when o_orderkey%3=0 then -1 else 1 end*cast(o_totalprice*100 as bigint)/100e0,6) as number, o_orderkey%2=0 as is_percent from orders"),
)
def numbers_in_cells(spark, d):
    """Cells with thousands separators, a Unicode minus and percent signs."""
    cents = (F.col("o_totalprice") * 100).cast("decimal(20,0)") / 100
    text = F.format_number(cents.cast("decimal(20,2)"), 2)
    cell = F.concat(
        F.lit("about "), F.when(F.col("o_orderkey") % 3 == 0, "−").otherwise(""), text, F.when(F.col("o_orderkey") % 2 == 0, "%").otherwise("")
    )
    o = b.table(spark, d, "orders").select("o_orderkey", cell.alias("cell"))
    return o.select("o_orderkey", tx.number_in("cell").alias("number"), tx.is_percent("cell").alias("is_percent"))


@query("I11_lists_in_cells", sql("", "select l_orderkey, count(*) as items, round(avg(l_linenumber),6) as mean from lineitem group by 1"))
def lists_in_cells(spark, d):
    """An order's lines as a JSON list in one cell, read back."""
    cells = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_linenumber")).alias("cell"))
    xs = tx.int_list("cell")
    mean = F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(xs)
    return cells.select("l_orderkey", F.size(xs).alias("items"), mean.alias("mean"))


@query(
    "I12_math",
    sql(
        "",
        """select l_orderkey, l_linenumber::bigint as line, round(exp(l_discount),6) as e, round(log2(l_quantity),6) as l, round(sqrt(l_tax),6) as s, cast(sign(l_quantity-25) as double) as g,
        round_even(l_quantity/2,0) as r, round(factorial(7)/(factorial(l_linenumber)*factorial(7-l_linenumber))::double,6) as c from lineitem""",
    ),
)
def math(spark, d):
    li = b.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        F.col("l_linenumber").alias("line"),
        F.exp("l_discount").alias("e"),
        F.log2("l_quantity").alias("l"),
        F.sqrt("l_tax").alias("s"),
        F.signum(F.col("l_quantity") - 25).alias("g"),
        F.rint(F.col("l_quantity") / 2).alias("r"),
        nm.choose(F.lit(7), F.col("l_linenumber")).alias("c"),
    )


@query(
    "A7_keyword_screen",
    sql("", "select lang, count(*) as records, count(*) filter (where regexp_matches(lower(source||' '||text), 'whst|(tion){2}|src1 ')) as matching from documents group by 1"),
)
def keyword_screen(spark, d):
    return va.keyword_screen(b.documents(spark, d), ["source", "text"], "whst|(tion){2}|src1 ", ["lang"])
