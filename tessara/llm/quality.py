"""Quality rules, run as a short-circuit cascade."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.llm.common import SPACES, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document fails where `rejects` is true. It is SQL over the columns of add()."""

    name: str
    rejects: str


#: Few rules with wide margins: prose in any language with words apart by spaces passes them.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("shouting", "n_upper > 0 AND 10 * n_upper > 6 * word_chars"),
    Rule("exclamations", "10 * n_exclaims > 5 * n_words"),
)
BASE = ("too_short", "repeated_windows")


FULL = "coalesce(_text, '')"
#: Measures that are one SQL expression, which a rule can hold within itself.
SHORT = {
    "n_lines": (("_lines",), "CAST(size(_lines) AS BIGINT)"),
    "n_upper": ((), f"CAST(length({FULL}) - length(regexp_replace({FULL}, '[A-Z]+', '')) AS BIGINT)"),
    "n_exclaims": ((), f"CAST(length({FULL}) - length(replace({FULL}, '!', '')) AS BIGINT)"),
}
#: Characters that a step reads, for a text of n_chars characters and n_words words: what it costs, the same in every run.
WORK = {
    "_words": "n_chars", "_lines": "n_chars", "_windows": "3 * n_chars + 16 * n_words", "word_chars": "n_chars", "n_symbols": "n_chars", "n_dup_lines": "n_chars",
    "n_upper": "n_chars", "n_exclaims": "n_chars", "n_repeat_words": "40 * n_words",
}


def steps() -> dict[str, tuple[tuple[str, ...], Column]]:
    """What can be computed of column _text: the steps it needs, and how. Names with an underscore are on the way."""
    text = F.col("_text")
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    windows = """CASE WHEN size(_words) < 3 THEN CAST(array() AS ARRAY<BIGINT>)
        ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"""
    return {
        "_words": ((), words(text)),
        "_lines": ((), lines),
        "_windows": (("_words",), F.expr(windows)),
        "n_words": (("_words",), F.size("_words").cast("long")),
        "word_chars": (("_words",), F.length(F.array_join("_words", "")).cast("long")),
        "n_symbols": ((), F.regexp_count(full, F.lit(SYMBOLS)).cast("long")),
        "n_dup_lines": (("_lines",), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        "n_repeat_words": (("_windows",), repeat_words()),
    } | {name: (needs, F.expr(sql)) for name, (needs, sql) in SHORT.items()}


def add(df: DataFrame, names: set[str]) -> DataFrame:
    """df, which has _text, with the steps named and all that they need.

    Each level of steps is the one row of an inline(): a filter above can't be pushed below it, so what filters read
    is computed once, and neither is a former step put into each turn of a loop over an array."""
    known = steps()
    missing = set(names)
    while more := {n for m in missing for n in known[m][0]} - missing:
        missing |= more
    missing -= set(df.columns)
    while missing:
        level = sorted(m for m in missing if not set(known[m][0]) & missing)
        df = df.select("*", F.inline(F.array(F.struct(*[known[m][1].alias(m) for m in level]))))
        missing -= set(level)
    return df


def needed(rule: Rule) -> set[str]:
    return set(re.findall(r"\w+", rule.rejects)) & set(steps())


def repeat_words(hashes: str = "_windows") -> Column:
    """Words that lie in a 3-word window found twice or more, from the windows' hashes in order.

    Windows are sorted with their places; equal neighbours are repeats. The places of repeats in order are starts of
    stretches of three words, so each adds the gap to the next one, three at most. A text whose windows all differ,
    which a hash set tells, is not sorted.
    """
    s = f"sort_array(transform({hashes}, (h, i) -> struct(h, i)))"
    places = "sort_array(transform(filter({0}, (x, k) -> get({0}, k - 1).h <=> x.h OR get({0}, k + 1).h <=> x.h), x -> x.i))"
    total = "aggregate(transform({0}, (y, k) -> least(3, coalesce(get({0}, k + 1) - y, 3))), 0, (a, g) -> a + g)"
    # Each step is an array of its own in a one-element array, so that it is computed once.
    inner = f"transform(array({s}), s -> {places.format('s')})"
    whole = f"transform({inner}, p -> {total.format('p')})[0]"
    return F.expr(f"CAST(CASE WHEN size({hashes}) = size(array_distinct({hashes})) THEN 0 ELSE {whole} END AS BIGINT)")


def _all(docs: DataFrame) -> list[Column]:
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]


def with_needs(names: set[str]) -> set[str]:
    known, out = steps(), set(names)
    while more := {n for m in out for n in known[m][0]} - out:
        out |= more
    return out


def rank_rules(sample: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> list[dict]:
    """Each rule's rejected share and work on the sample, the best rejection per work first, ties by name.

    A rule's work is that of its own steps, in characters read, from the lengths of the sample's texts. It is counted and
    not timed, so the order is the same whenever the rows are."""
    judged = add(sample.select(F.col(text_col).alias("_text")), {n for r in rules for n in needed(r)} | {"n_words"})
    work = {r.name: " + ".join(sorted(WORK[n] for n in with_needs(needed(r)) if n in WORK)) or "0" for r in rules}
    judged = judged.withColumn("n_chars", F.expr(f"length({FULL})"))
    found = judged.agg(F.count(F.lit(1)).alias("n"), *[f for r in rules for f in (F.count_if(F.expr(r.rejects)).alias(f"r_{r.name}"), F.sum(F.expr(work[r.name])).cast("double").alias(f"w_{r.name}"))]).first()
    out = []
    for rule in rules:
        share, cost = found[f"r_{rule.name}"] / max(1, found["n"]), (found[f"w_{rule.name}"] or 0.0) / max(1, found["n"]) + 1
        out.append({"rule": rule, "rejected": share, "work": cost, "gain": share / cost})
    return sorted(out, key=lambda x: (-x["gain"], x["rule"].name))


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, sample_rows: int) -> list[Rule]:
    """The rules in the order of their rejection per work on about sample_rows rows of docs, taken by hash over the whole
    table (all rows of a table that has no more)."""
    n, scale = docs.count(), 1 << 30
    drawn = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(scale)) < int(scale * min(1.0, sample_rows / max(1, n)))
    return [x["rule"] for x in rank_rules(docs.where(drawn) if n > sample_rows else docs, rules, text_col)]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 1000, keep: list[Column] | None = None, report: tuple[str, ...] | None = None) -> DataFrame:
    """The measures in `report` (None: all) of each document, `kept`, and `failed_rule`, the first rule that rejects it in
    the cascade's order.

    A measure that isn't reported is worked out within its rule, and so only for documents that no rule before it
    rejects, if it is one of SHORT; others are worked out first.

    Other columns: those of `keep`, or all of docs as struct `row`, so that no names clash. Null texts have no words. Text
    of any length is measured whole. An empty table gives an empty result. The order sets which failed rule is named
    and the cost; never `kept`."""
    order = ordered(docs, rules, text_col, sample_rows)
    every = {n for n in steps() if n[0] != "_"}
    shown = every if report is None else set(report)
    inside = {n for r in rules for n in needed(r)} - shown
    late = inside & set(SHORT)
    first = shown | (inside - late) | {n for m in late for n in SHORT[m][0]}

    def test(rule: Rule) -> str:
        sql = rule.rejects
        for name in sorted(needed(rule) & late):
            sql = f"exists(array({SHORT[name][1]}), {name} -> {sql})"
        return sql

    failed = F.expr("CASE " + " ".join(f"WHEN {test(r)} THEN '{r.name}'" for r in order) + " END")
    df = add(docs.select(*(_all(docs) if keep is None else keep), F.col(text_col).alias("_text")), first)
    df = df.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())
    return df.drop("_text", "_words", "_lines", "_windows", *((inside - late) - shown))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The documents that no rule rejects, with the columns of docs.

    Rules follow each other in the order of their rejection per work, each a filter after the steps that only it needs;
    a rejected document goes no further, so later measures are computed for those that are left."""
    df = docs.select(*_all(docs), F.col(text_col).alias("_text"))
    for rule in ordered(docs, rules, text_col, sample_rows):
        df = add(df, needed(rule)).where(f"NOT ({rule.rejects})")
    return df.select("row.*")


#: What the digest reports, and cascade() need not leave out.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def digest(judged: DataFrame) -> DataFrame:
    """Columns doc_id, the base measures, base_failed and kept."""
    base = F.expr(" OR ".join(f"({r.rejects})" for r in RULES if r.name in BASE))
    return judged.select("doc_id", *REPORTED, base.alias("base_failed"), "kept")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
         len(regexp_extract_all(text, '!')) AS n_exclaims
  FROM t),
s AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM s) WHERE n > 1),
p AS (SELECT doc_id, CAST(count(DISTINCT j) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM r) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR (n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_upper > 0 AND 10 * n_upper > 6 * word_chars)
            OR 10 * n_exclaims > 5 * n_words) AS kept
FROM b
"""
