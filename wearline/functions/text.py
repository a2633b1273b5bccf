"""Mentions of a term in a text, and what is said around them, as column expressions.

Two scans of a text, one of them backwards, capture the context of every mention
of any term on either side, of fixed width. The work is linear in the text,
whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings that count as a direction, tested in this order.
DIRECTION_WORDS = {
    "increase": (
        "increas", "rising", "rises", "rise", "growing", "grows", "grew", "ascending", "elevated", "higher",
        "uptrend", "upward", "trending up", "trend up", "going up",
    ),
    "decrease": (
        "decreas", "falling", "falls", "fell", "declin", "drops", "drop", "descending", "lower", "downtrend",
        "downward", "trending down", "trend down", "going down", "reducing", "reduces",
    ),
    "stable": (
        "stable", "constant", "unchang", "flat", "no change", "no significant change", "steady", "near baseline",
    ),
}
# Context widths of the classifier and of the human reader.
BEFORE, AFTER = 60, 80
READER_BEFORE, READER_AFTER, READER_CAP = 120, 160, 1200
# Fixed value: wordings that mention a level or a spread, not a trend.
OFF_TREND = "deviation|variance|fluctuat|than normal|lower values|higher values"

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"
# The clause ends at a sentence end, a semicolon, or a comma before the next sensor.
CLAUSE_END = rf"(?s)(?:[;.](?:{SPACE}|\z)|,{SPACE}*s\p{{Nd}}).*"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def any_case(term: str) -> str:
    """Pattern of the term in any case. Spelled out per letter, which Java matches faster than its case flags.

    The long s and the Kelvin sign count as s and k, as Unicode case folding has it.
    """
    extra = {"s": "\u017f", "k": "\u212a"}
    out = []
    for ch in term:
        low = ch.lower()
        if ch.isascii() and ch.isalpha():
            out.append(f"[{low}{low.upper()}{extra.get(low, '')}]")
        elif ch.isalpha():
            out.append(f"(?iu:{ch})")
        else:
            out.append(re.escape(ch))
    return "".join(out)


def lefts_and_rights(text, terms: Sequence[str], before: int, after: int) -> tuple[Column, Column]:
    """Arrays over all mentions of any term: the text before, reversed and last mention first, and the text from the mention on.

    Both hold one character more than a context needs, and both are captured ahead of the
    mention in one scan, the left ones in the reversed text.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words, turned = ("|".join(any_case(t[::step]) for t in terms) for step in (1, -1))
    right = rf"(?s)(?=(?:{words})(?!{WORD}))(?<!{WORD})(?=(.{{1,{max(map(len, terms)) + after + 1}}}))"
    left = rf"(?s)(?!{WORD})(?<=(?<!{WORD})(?:{turned}))(?=(.{{0,{before + 1}}}))"
    return F.regexp_extract_all(F.reverse(text), F.lit(left), 1), F.regexp_extract_all(text, F.lit(right), 1)


def mentions(lefts: str, rights: str) -> Column:
    """Array over all mentions in text order: `left` text (one character more than the context) and `right` text from the mention on."""
    return F.zip_with(F.reverse(lefts), rights, lambda x, y: F.struct(F.reverse(x).alias("left"), y.alias("right")))


def per_mention(found: str, term: str, before: int, after: int, use) -> Column:
    """Array of use(before, token, after, more_left, more_right) over the mentions of one term.

    The last two tell whether the text goes on beyond the context.
    """
    return F.transform(own_mentions(found, term), in_context(term, before, after, use))


def own_mentions(found: str, term: str) -> Column:
    return F.filter(found, lambda m: m["right"].rlike(rf"^{any_case(term)}(?!{WORD})"))


def in_context(term: str, before: int, after: int, use):
    """Function of a mention of the term: use(before, token, after, more_left, more_right)."""
    size = len(term)

    def one(m: Column) -> Column:
        left, right = m["left"], m["right"]
        return use(
            F.substr(left, F.lit(-before), F.lit(before)),
            F.left(right, F.lit(size)),
            F.substr(right, F.lit(size + 1), F.lit(after)),
            F.length(left) > before,
            F.length(right) > size + after,
        )

    return one


def clause(before: Column, token: Column, after: Column) -> Column:
    """Lower-cased context; the part after the mention stops where its clause ends."""
    return F.lower(F.concat(before, token, F.regexp_replace(F.lower(after), CLAUSE_END, "")))


def says_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def strongest(own: str, context, lexicon: dict[str, Sequence[str]]) -> Column:
    """Verdict over the mentions of a term: the first lexicon entry any context says, 'unspecified', or 'absent'.

    `context` makes a mention's context; none is made once the first entry is said.
    """
    labels = list(lexicon)

    def rank(ctx: Column) -> Column:
        out = F.lit(len(labels))
        for i in range(len(labels) - 1, -1, -1):
            out = F.when(says_any(ctx, lexicon[labels[i]]), F.lit(i)).otherwise(out)
        return out

    def least(best: Column, m: Column) -> Column:
        said = F.get(F.transform(F.array(context(m)), rank), F.lit(0))
        return F.when(best == 0, best).otherwise(F.least(best, said))

    best = F.aggregate(own, F.lit(len(labels)), least)
    names = F.array(*[F.lit(x) for x in [*labels, "unspecified"]])
    return F.when(F.size(own) > 0, F.get(names, best)).otherwise(F.lit("absent"))


# ------------------------------------------------------------------ responses
def parse_strict(text: str, cap: int = 125, fallback: int | None = None) -> tuple[Column, Column]:
    """(estimate, reasoning) from tagged lines: the last tagged line with a number wins.

    Without one, the first free-standing number of up to three digits, then `fallback`.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, LINE_END, -1)
    tagged = F.filter(lines, lambda x: x.startswith("RUL_ESTIMATE:") & x.rlike("[0-9]"))
    told = F.regexp_extract(F.try_element_at(tagged, F.lit(-1)), "[0-9]+", 0)
    loose = F.regexp_extract(t, rf"(?<!{WORD})[0-9]{{1,3}}(?!{WORD})", 0)
    number = F.coalesce(F.nullif(told, F.lit("")), F.nullif(loose, F.lit("")))
    value = _at_most(number, cap)
    if fallback is not None:
        value = F.coalesce(value, F.lit(fallback).cast("long"))
    reasons = F.filter(lines, lambda x: x.startswith("REASONING:"))
    reason = F.replace(F.try_element_at(reasons, F.lit(-1)), F.lit("REASONING:"), F.lit(""))
    return value, F.coalesce(_strip(reason), F.lit(""))


def parse_robust(text: str, cap: int = 125) -> tuple[Column, Column, Column]:
    """(estimate, reasoning, parse_ok); never invents a value.

    Hidden thinking is removed first. parse_ok is true only for a tagged estimate;
    otherwise the first free-standing number within range is taken.
    """
    clean = _strip(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?isu)<think>.*?</think>", " "))
    told = F.nullif(F.regexp_extract(clean, rf"(?iu)RUL_ESTIMATE:{SPACE}*([0-9]+)", 1), F.lit(""))
    loose = F.regexp_extract_all(clean, F.lit(rf"(?<!{WORD})([0-9]{{1,3}})(?!{WORD})"), 1)
    within = F.filter(F.transform(loose, lambda x: x.cast("long")), lambda x: x <= cap)
    value = F.coalesce(_at_most(told, cap), F.get(within, F.lit(0)))
    reason = F.regexp_extract(clean, rf"(?isu)REASONING:{SPACE}*(.+)", 1)
    return value, _strip(F.regexp_replace(reason, rf"{SPACE}+", " ")), told.isNotNull()


def _at_most(number: Column, cap: int) -> Column:
    """Digits as a long, at most cap; null stays null (least would skip it)."""
    return F.when(number.isNotNull(), F.least(F.lit(cap).cast("double"), number.cast("double")).cast("long"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


# ------------------------------------------------------------------ cells and names
def number_in(cell) -> Column:
    """First number in a free-text cell, with thousands separators and a Unicode minus."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    plain = F.translate(cell, "−,", "-")
    return F.nullif(F.regexp_extract(plain, r"[-+]?[0-9]+\.?[0-9]*", 0), F.lit("")).cast("double")


def is_percent(cell) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.coalesce(cell.contains("%"), F.lit(False))


def int_list(cell) -> Column:
    """A JSON list of integers stored in one cell."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.from_json(cell, "array<bigint>")


def safe_name(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def config_from_file(name) -> dict[str, Column]:
    """Run configuration carried in a trace file's name (both naming conventions)."""
    name = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.json$", "")

    def part(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, group), F.lit(""))

    mode = part(r"_(zero_shot|few_shot|zs|fs)_")
    return {
        "dataset": part(r"^traces_(?:p\d_)?(?:grid_)?([A-Za-z]+\d+)_"),
        "mode": F.when(mode.isin("zero_shot", "zs"), "zero_shot").when(mode.isin("few_shot", "fs"), "few_shot"),
        "k": F.coalesce(part(r"_k(\d+)").cast("long"), F.lit(0).cast("long")),
        "n_cycles": F.coalesce(part(r"_n(\d+)").cast("long"), F.lit(5).cast("long")),
        "run": F.coalesce(part(r"_(run\d+)(?:_|$)"), F.lit("run1")),
        "seed": part(r"_seed(\d+)").cast("long"),
        "variant": part(r"^traces_p\d_(?:grid_)?[A-Za-z]+\d+_(?:zs|fs)(?:_k\d+)?+(?:_n\d+)?+_(.+)$"),
    }


def display_tag(mode="mode", k="k", n="n_cycles", run="run") -> Column:
    """Short label of a configuration, e.g. 'FS k=3, n=15 [run2]'."""
    head = F.when(F.col(mode) == "zero_shot", F.lit("ZS")).otherwise(F.concat(F.lit("FS k="), F.col(k).cast("string")))
    tail = F.when(F.col(run) == "run1", F.lit("")).otherwise(F.concat(F.lit(" ["), F.col(run), F.lit("]")))
    return F.concat(head, F.lit(", n="), F.col(n).cast("string"), tail)
