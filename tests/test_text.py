"""Mention contexts and response parsers on small adversarial texts, against a positional scan."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wearline.functions import text as tx
from wearline.operators import claims as cl

TERMS = {"a": "s11", "b": "s2"}


def contexts(text, term, before, after):
    for m in re.finditer(rf"\b{term}\b", text, re.IGNORECASE):
        yield text[max(0, m.start() - before) : m.start()], m.group(), text[m.end() : m.end() + after], m


def scan_clause(text, term):
    out = []
    for b, t, a, _ in contexts(text, term, 60, 80):
        a = a.lower()
        stop = re.search(r"[;.](\s|$)|,\s*s\d", a)
        out.append((b + t + (a[: stop.start()] if stop else a)).lower())
    return out


def scan_verdict(text, term):
    found = scan_clause(text, term)
    ranks = [
        next((label for label, words in tx.DIRECTION_WORDS.items() if any(w in c for w in words)), "unspecified") for c in found
    ]
    return next((x for x in ("increase", "decrease", "stable", "unspecified") if x in ranks), "absent")


def scan_reader(text, term, cap=None):
    out = []
    for b, t, a, m in contexts(text, term, 120, 160):
        left = "..." if m.start() > 120 else ""
        right = "..." if m.end() + 160 < len(text) else ""
        out.append(left + (b + t + a).replace("\n", " ") + right)
    return " || ".join(out)[:cap]


CASES = [
    "",
    None,
    "nothing here",
    "s11",
    "S11 rising",
    "xs11 rising, s11x falling, s11_ up",
    "s11 s11-s11 falls",
    "s2 is stable; s11 increasing. s2 falling",
    "s11 is flat, s2 rises",
    "s11 falling.",
    "s11 " + "x" * 90 + " rising",
    "rising " + "y" * 53 + " s11",
    "rising " + "y" * 54 + " s11",
    "s11 drops.5 and more, s 2 grows",
    "é s11é s11 increas ſ11 is flat",
    "trend 😀😀 s11 😀 rising " * 5,
    "s2 " * 60 + "elevated",
    "a\ns11\nb " * 40,
    "s11: lower values than normal",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "id int, text string")


def test_verdicts_match_a_positional_scan(texts):
    got = {(r.id, r.sensor): (r.claimed, r.mentions) for r in cl.classify(texts, ["id"], "text", TERMS).collect()}
    for i, text in enumerate(CASES):
        for sensor, term in TERMS.items():
            text = text or ""
            assert got[i, sensor] == (scan_verdict(text, term), len(scan_clause(text, term))), (text, term)


def test_clauses_and_reader_contexts(texts):
    clauses = {(r.id, r.sensor): r for r in cl.matched_clauses(texts, ["id"], "text", TERMS).collect()}
    reader = {(r.id, r.sensor): r for r in cl.reader_contexts(texts, ["id"], "text", TERMS).collect()}
    capped = {(r.id, r.sensor): r for r in cl.reader_contexts(texts, ["id"], "text", TERMS, cap=1200).collect()}
    for i, text in enumerate(CASES):
        for sensor, term in TERMS.items():
            text = text or ""
            want = " || ".join(scan_clause(text, term))
            assert clauses[i, sensor].clause == want
            assert clauses[i, sensor].off_trend == bool(re.search(tx.OFF_TREND, want))
            assert reader[i, sensor].context == scan_reader(text, term)
            assert capped[i, sensor].context == scan_reader(text, term, 1200)
            assert reader[i, sensor].mentions == len(scan_clause(text, term))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["s11", "S11", "s2", " ", ".", "; ", ", s3", "rising", "flat", "é", "_", "\n", "x" * 40]), max_size=40), min_size=8, max_size=8))
def test_random_texts(spark, parts):
    rows = [(i, "".join(p)) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {(r.id, r.sensor): r.clause for r in cl.matched_clauses(df, ["id"], "text", TERMS).collect()}
    for i, text in rows:
        for sensor, term in TERMS.items():
            assert got[i, sensor] == " || ".join(scan_clause(text, term))


REPLIES = [
    # text, strict, robust, parse_ok, strict reasoning
    ("RUL_ESTIMATE: 40\nREASONING: because ", 40, 40, True, "because"),
    ("RUL_ESTIMATE: 40\nRUL_ESTIMATE: 41 cycles", 41, 40, True, ""),
    ("RUL_ESTIMATE: 40\nRUL_ESTIMATE: none", 40, 40, True, ""),
    ("RUL_ESTIMATE: 900", 125, 125, True, ""),
    ("<think>RUL_ESTIMATE: 3</think>\nrul_estimate: 17", 3, 17, True, ""),
    ("I say 300 or 44", 125, 44, False, ""),
    ("no number", 75, None, False, ""),
    ("x12 and 1234", 75, None, False, ""),
    (None, 75, None, False, ""),
    ("  RUL_ESTIMATE: 9", 9, 9, True, ""),
]


def test_parsers(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "id int, reply string")
    value, reason = tx.parse_strict("reply", fallback=75)
    rv, rr, ok = tx.parse_robust("reply")
    got = df.select("id", value.alias("s"), reason.alias("sr"), rv.alias("r"), ok.alias("ok")).orderBy("id").collect()
    for row, (_, strict, robust, parse_ok, why) in zip(got, REPLIES):
        assert (row.s, row.r, row.ok, row.sr) == (strict, robust, parse_ok, why), row


def test_cells_and_names(spark):
    rows = ["1,234.5", "−0.42", "91.3%", "n/a", "about 7 of 9"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "id int, cell string").orderBy("id")
    assert [r[0] for r in df.select(tx.number_in("cell")).collect()] == [1234.5, -0.42, 91.3, None, 7.0]
    files = [
        "traces_FD001_zero_shot_k0.json",
        "traces_FD003_few_shot_k10_n30_run2.json",
        "traces_p0_FD001_zs_n30_invcue.json",
        "traces_p1_FD001_fs_k5_n30_strat_seed7.json",
    ]
    cols = tx.config_from_file("f")
    got = spark.createDataFrame([(f,) for f in files], "f string").select("f", *[c.alias(n) for n, c in cols.items()]).collect()
    by = {r.f: r for r in got}
    assert by[files[0]][1:7] == ("FD001", "zero_shot", 0, 5, "run1", None)
    assert by[files[1]][1:7] == ("FD003", "few_shot", 10, 30, "run2", None)
    assert (by[files[2]].mode, by[files[2]].variant, by[files[2]].n_cycles) == ("zero_shot", "invcue", 30)
    assert (by[files[3]].k, by[files[3]].seed, by[files[3]].variant) == (5, 7, "strat_seed7")
