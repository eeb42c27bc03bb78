"""Text helpers for the DuckDB twins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from watchloom.rules.detection import BUILTIN_RULES
from watchloom.rules.mitre import TECHNIQUES, UNKNOWN_TECHNIQUE


def quote(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) as (values {body})"


def case(key: str, mapping: Mapping[str, object], default: object) -> str:
    arms = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in mapping.items())
    return f"case {key} {arms} else {quote(default)} end"


RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"

RULES = values("rules", ["rule_no", "rule_name", "severity", "category", "pattern"],
               [(i, r.name, r.severity, r.category, r.pattern) for i, r in enumerate(BUILTIN_RULES)])


def stable(expr: str) -> str:
    """A double to single precision: equal on both sides however its last bits were summed."""
    return f"case when abs({expr}) < 1e-6 then 0.0 else cast(cast({expr} as float) as double) end"


def rule_hits(view: str, name: str = "hits", carry: str = "event_id, device_id, timestamp_ms, machine_ip") -> str:
    """CTEs ``rules`` and ``<name>``: one row per (line, rule) hit of a log view."""
    return (
        f"{RULES}, {name}_lines as (select {carry}, unnest(string_split(raw_log, chr(10))) as line from {view}), "
        f"{name} as (select {carry}, rule_no, rule_name, severity, category, line as matched_text "
        f"from {name}_lines join rules on regexp_matches(line, pattern, 'i') where line <> '')"
    )


MITRE = values("mitre", ["sub_type", "mitre_id", "mitre_name", "mitre_tactic"], [(k, *v) for k, v in TECHNIQUES.items()])
MITRE_COLUMNS = ", ".join(
    f"coalesce(mitre.{c}, {quote(d)}) as {c}"
    for c, d in zip(["mitre_id", "mitre_name", "mitre_tactic"], UNKNOWN_TECHNIQUE)
)
