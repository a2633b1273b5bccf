"""The bindings once more, as SQL text for an independent engine.

`sql(names, body)` puts the named common table expressions, with those they
need, in front of a query. Written from the definitions, not from the Spark code:
positions by plain windows, mentions by splitting on marked words, tau by pairs.
"""

from __future__ import annotations

from . import bindings as b

WORDS = r"([\p{L}\p{N}_]+)"
SPACES = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"
CUT = rf"(?s)(?:[;.](?:{SPACES}|\z)|,{SPACES}*s\p{{Nd}}).*"


def h(seed: str, *parts: str) -> str:
    text = "||':'||".join([f"'{seed}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"cast('0x'||substr(md5({text}),1,8) as bigint)"


def u(seed: str, *parts: str) -> str:
    return f"({h(seed, *parts)}/4294967296e0)"


def values(name: str, rows, *cols: str) -> str:
    cells = ",".join("(" + ",".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(select * from (values {cells}) as {name}({','.join(cols)}))"


def says(ctx: str, words) -> str:
    return "(" + " or ".join(f"contains({ctx},'{w}')" for w in words) + ")"


def verdict_rank(ctx: str, lexicon=b.LEXICON) -> str:
    cases = " ".join(f"when {says(ctx, w)} then {i}" for i, w in enumerate(lexicon.values()))
    return f"case {cases} else 3 end"


VERDICT = "coalesce(list_extract(['increase','decrease','stable','unspecified'], min(r)+1),'absent')"


def mentions(source: str, key: str, before: int, after: int) -> str:
    """All mentions of all terms in source(key, text): position, contexts."""
    return f"""
    (with terms as {values('t', b.TERMS.items(), 'sensor', 'term')},
    marked as (select {key}, regexp_replace(text, '{WORDS}', chr(1)||'\\1'||chr(2), 'g') as m from {source}),
    cut as (select {key}, sensor, term, string_split_regex(m, '(?i)'||chr(1)||term||chr(2)) as ps from marked, terms),
    lens as (select {key}, sensor, term, len(ps) as np, unnest(range(1, len(ps)+1)) as i,
                    unnest([length(replace(replace(p,chr(1),''),chr(2),'')) for p in ps]) as l from cut),
    pos as (select {key}, sensor, term, i, np,
                   sum(l) over (partition by {key}, sensor order by i) + (i-1)*length(term) as s from lens)
    select p.{key}, sensor, term, i, np-1 as mentions,
           substr(text, cast(greatest(s-{before},0)+1 as bigint), cast(least({before},s) as bigint)) as before,
           substr(text, cast(s+1 as bigint), length(term)) as token,
           substr(text, cast(s+length(term)+1 as bigint), {after}) as after,
           s > {before} as more_left, s+length(term)+{after} < length(text) as more_right
    from pos p join {source} t on p.{key}=t.{key} where i < np)"""


CTX = f"lower(before||token||regexp_replace(lower(after), '{CUT}', ''))"


def said(source: str, key: str) -> str:
    """Verdict of every (key, sensor), absent included."""
    return f"""
    (select s.{key}, t.sensor, {VERDICT} as claimed, coalesce(cast(count(r) as bigint),0) as mentions
     from {source} s cross join {values('t', b.TERMS.items(), 'sensor', 'term')} t
     left join (select {key}, sensor, {verdict_rank('c')} as r
                from (select {key}, sensor, {CTX} as c from {mentions(source, key, 60, 80)})) m
       on m.{key}=s.{key} and m.sensor=t.sensor
     group by all)"""


def sensor_case(mapping) -> str:
    return "case sensor " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


SCALED = ", ".join(
    f"({s}-{s}_min)/(case when {s}_max={s}_min then 1e0 else {s}_max-{s}_min end) as {s}" for s in b.SENSORS
)
RANGES = ", ".join(f"min({s}) as {s}_min, max({s}) as {s}_max" for s in b.SENSORS)
CUED = "(" + ",".join(repr(s) for s in b.CUED) + ")"
FLIP = "case {0} when 'increase' then 'decrease' when 'decrease' then 'increase' else {0} end"


def direction(net: str, eps: str = "0.01e0") -> str:
    return f"case when abs({net})<{eps} then 'stable' when {net}>0 then 'increase' else 'decrease' end"


def long(source: str, keys: str, sensors) -> str:
    return " union all ".join(f"select {keys}, '{s}' as sensor, cast({s} as double) as reading from {source}" for s in sensors)


PARTS = {
    "traj": f"""select dataset, unit, cycle, setting1, setting2, setting3, s1, s2, s3, s4,
        cycle*0.5e0+s2*0.2e0 as s5, cycle*-0.4e0+s1*0.1e0 as s6 from (
        select case when user_id%2=0 then 'D0' else 'D1' end as dataset, user_id as unit,
        row_number() over (partition by user_id order by ts, event_id) as cycle,
        cast(hour(ts)%3 as double) as setting1, cast(minute(ts)%2 as double) as setting2, 100e0 as setting3,
        value as s1, cast(json_extract_string(props,'$.k') as double) as s2,
        cast(length(event_type) as double) as s3, 1e0 as s4 from events)""",
    "train": f"select *, least({b.CAP}, max(cycle) over (partition by unit)-cycle) as rul from traj",
    "obs": f"""select * from (select *, max(cycle) over (partition by unit) as life from traj)
        where cycle <= floor(life*({u('censor', 'unit')}*0.45e0+0.5e0))""",
    "tails": """select o.*, n from (select *, row_number() over (partition by unit order by cycle desc) as back from obs) o,
        (select cast(unnest([5,15,30]) as bigint) as n) where back<=n""",
    "preds": f"""select dataset, unit, n, q, cast(floor(m*0.8e0/q)*q as double) as pred,
        cast(least({b.CAP}, life-last) as double) as truth from (
        select dataset, unit, n, avg(s2) as m, min(life) as life, max(cycle) as last from tails group by all),
        (select cast(unnest([1,10,40]) as bigint) as q)""",
    "runs": f"""select dataset, unit, run, floor((m+{u('run', 'run', 'unit')}*16-8)*0.8e0/10)*10 as pred from (
        select dataset, unit, avg(s2) as m from tails where n=15 group by all), (select unnest(['r1','r2','r3','r4']) as run)""",
    "lpreds": """select l_returnflag||l_linestatus as config, l_orderkey||'-'||l_linenumber as unit, l_quantity as truth,
        round(l_discount*500,6) as pred from lineitem""",
    "resp": """select doc_id as resp, case when unit%2=0 then 'D0' else 'D1' end as dataset, unit,
        (case when unit%2=0 then 'D0' else 'D1' end)||'|'||source as config,
        case when num%2=0 then 'zero_shot' else 'few_shot' end as mode,
        cast(case num%3 when 0 then 5 when 1 then 15 else 30 end as bigint) as n, text from (
        select doc_id, source, text, doc_id % (select max(user_id)+1 from events) as unit,
        cast(regexp_extract(source,'(\\d+)$',1) as int) as num from documents)""",
    "scaled": f"""select t.* exclude ({', '.join(b.SENSORS)}), {SCALED} from tails t
        join (select dataset, {RANGES} from traj group by 1) m using (dataset)""",
    "wdir": f"""select dataset, unit, n, sensor, net, {direction('net')} as actual from (
        select dataset, unit, n, sensor, arg_min(round(reading,3),back)-arg_max(round(reading,3),back) as net
        from ({long('scaled', 'dataset, unit, n, back', b.SCORED)}) group by all)""",
    "said": said("resp", "resp"),
    "opps": f"""select *, claimed in ('increase','decrease') as directional, claimed=expected as reference_hit,
        claimed=actual as input_hit, expected=actual as base_hit from (
        select r.resp, r.dataset, r.unit, r.config, r.mode, r.n, s.sensor, s.claimed, s.mentions, w.net, w.actual,
        {sensor_case(b.ASSERTED).replace('case sensor', 'case s.sensor')} as expected, s.sensor in {CUED} as cued
        from resp r join said s using (resp) join wdir w on w.dataset=r.dataset and w.unit=r.unit and w.n=r.n and w.sensor=s.sensor)""",
    "claims": "select * from opps where directional",
    "adocs": """select doc_id as resp, list_extract(['repl','nocue','invcue','revdata'], doc_id%4+1) as arm,
        doc_id//4 as engine, text from documents""",
    "asaid": said("adocs", "resp"),
    "arms": f"""select *, claimed in ('increase','decrease') as directional, claimed=expected as reference_hit, claimed=actual as input_hit,
        expected=actual as base_hit, claimed=cue_says as cue_hit from (
        select *, case when arm='nocue' or not cued then null when arm='invcue' then {FLIP.format('expected')} else expected end as cue_says from (
        select a.arm, a.engine, s.sensor, s.claimed, w.net, w.unit,
        case when a.arm='revdata' then {FLIP.format('w.actual')} else w.actual end as actual,
        {sensor_case(b.ASSERTED).replace('case sensor', 'case s.sensor')} as expected, s.sensor in {CUED} as cued
        from adocs a join asaid s using (resp)
        join wdir w on w.n=30 and w.sensor=s.sensor and w.unit=a.engine % (select max(user_id)+1 from events)))""",
}
NEEDS = {
    "train": ["traj"],
    "obs": ["traj"],
    "tails": ["obs"],
    "preds": ["tails"],
    "runs": ["tails"],
    "scaled": ["tails"],
    "wdir": ["scaled"],
    "said": ["resp"],
    "opps": ["said", "wdir"],
    "claims": ["opps"],
    "asaid": ["adocs"],
    "arms": ["asaid", "wdir"],
}


def sql(names: str, body: str, **extra: str) -> str:
    """`names`: space-separated parts; `extra`: further expressions local to the query, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} as materialized ({PARTS[n]})" for n in order] + [f"{n} as ({s})" for n, s in extra.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def d6(x: str, name: str) -> str:
    return f"round(cast({x} as double),6) as {name}"
