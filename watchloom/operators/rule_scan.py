"""Scan log text with regex rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import as_column, compact, explode_once
from watchloom.rules.detection import BUILTIN_RULES, DetectionRule

# Rules whose alternation is tried before each of them.
GROUP_RULES = 50


def log_lines(text: Column | str, max_length: int | None = None) -> Column:
    """Non-empty lines without a trailing carriage return, optionally cut to a length."""
    lines = F.transform(F.split(as_column(text), "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    if max_length is not None:
        lines = F.transform(lines, lambda x: F.left(x, F.lit(max_length)))
    return F.filter(lines, lambda x: x != "")


def _explode_lines(logs: DataFrame, text: str, max_line: int | None) -> DataFrame:
    others = [c for c in logs.columns if c != text]
    return logs.select(*others, F.posexplode_outer(log_lines(text, max_line)).alias("line_no", "_line")).filter("_line is not null")


def _hits(lines: DataFrame, rules: Sequence[DetectionRule]) -> DataFrame:
    """One projection for sets of any size: a line that a group's alternation misses tries none of its rules."""
    one = lambda i, r: F.when(
        F.col("_line").rlike(f"(?i){r.pattern}"),
        F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule_name"),
                 F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category")),
    )
    groups = []
    for at in range(0, len(rules), GROUP_RULES):
        group = list(enumerate(rules[at:at + GROUP_RULES], at))
        any_of = "|".join(f"(?:{r.pattern})" for _, r in group)
        groups.append(F.when(F.col("_line").rlike(f"(?i){any_of}"), compact(*[one(i, r) for i, r in group])))
    found = F.flatten(compact(*groups))
    others = [c for c in lines.columns if c != "_line"]
    return explode_once(lines, [*others, "_line"], found, "_hit").select(*others, "_hit.*", F.col("_line").alias("matched_text"))


def scan_rules(
    logs: DataFrame,
    rules: Sequence[DetectionRule] = tuple(BUILTIN_RULES),
    text: str = "raw_log",
    max_line: int | None = None,
) -> DataFrame:
    """One security event per (line, rule) hit; all rules are tried on every line.

    ``line_no`` and ``rule_no`` give the order of the hits of one chunk.

    Lines are scanned whole; pass ``max_line`` to cut them first. The rules are
    literals of the plan, compiled once per task.
    """
    return _hits(_explode_lines(logs, text, max_line), list(rules))


def scan_rule_table(logs: DataFrame, rules: DataFrame, text: str = "raw_log", max_line: int | None = None) -> DataFrame:
    """``scan_rules`` for a rule table read with ``load_rules``.

    A rule file is a hand-kept configuration of at most a few thousand lines,
    so its rows are read into the plan rather than joined per log line.
    """
    names = ["name", "severity", "category", "pattern"]
    return scan_rules(logs, [DetectionRule(*r) for r in rules.select(*names).collect()], text, max_line)
