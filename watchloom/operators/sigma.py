"""Sigma-style rules as Column predicates over a field map."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import compact, explode_once

# Logsource word -> event source it also stands for.
SOURCE_ALIASES = {
    "process_creation": "process",
    "dns": "dns",
    "authentication": "auth",
    "file_event": "fim",
    "network_connection": "network",
}


def event_field(name: str) -> Column:
    """A field of the event; an absent one reads as ''."""
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.lit(""))


@dataclass(frozen=True)
class Match:
    """One field test. Any value suffices unless ``all_values``; case matters only if ``cased``."""

    field: str
    values: tuple[str, ...]
    modifier: str = "exact"
    all_values: bool = False
    cased: bool = False

    def column(self) -> Column:
        if self.modifier not in ("exact", "contains", "startswith", "endswith", "re"):
            raise ValueError(f"unknown modifier {self.modifier!r}")
        if not self.values:
            return F.lit(False)
        actual = event_field(self.field)
        folded = actual if self.cased else F.lower(actual)

        def one(value: str) -> Column:
            needle = value if self.cased else value.lower()
            if self.modifier == "re":
                return actual.rlike(value if self.cased else f"(?i){value}")
            if self.modifier == "contains":
                return folded.contains(needle)
            if self.modifier == "startswith":
                return folded.startswith(needle)
            if self.modifier == "endswith":
                return folded.endswith(needle)
            return folded == needle

        tests = [one(v) for v in self.values]
        return reduce((lambda a, b: a & b) if self.all_values else (lambda a, b: a | b), tests)


def selection(matchers: Sequence[Match]) -> Column:
    """All matchers hold; an empty selection never does."""
    if not matchers:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [m.column() for m in matchers])


class Selections(dict[str, Column]):
    """Named selections of a rule, with the two ``of`` forms of a condition."""

    def _named(self, pattern: str) -> list[Column]:
        prefix = pattern.removesuffix("*")
        return [c for name, c in self.items() if name.startswith(prefix)]

    def one_of(self, pattern: str = "*") -> Column:
        return reduce(lambda a, b: a | b, self._named(pattern), F.lit(False))

    def all_of(self, pattern: str = "*") -> Column:
        named = self._named(pattern)
        return reduce(lambda a, b: a & b, named) if named else F.lit(False)


Condition = Callable[[Selections], Column]


@dataclass(frozen=True)
class SigmaRule:
    """A rule; ``condition`` combines selections with ``&``, ``|``, ``~``, ``one_of`` and ``all_of``.

    Without a condition any selection suffices.
    """

    id: str
    title: str
    selections: Mapping[str, Sequence[Match]]
    condition: Condition | None = None
    level: str = "medium"
    description: str = ""
    tags: tuple[str, ...] = ()
    category: str = ""
    product: str = ""
    service: str = ""
    enabled: bool = True

    @property
    def severity(self) -> str:
        return self.level or "medium"

    @property
    def mitre_id(self) -> str:
        """Technique of the last ``attack.tNNNN`` tag."""
        ids = [t[len("attack."):].upper() for t in self.tags if t.lower().startswith("attack.t")]
        return ids[-1] if ids else ""

    def applies(self) -> Column:
        def ok(word: str) -> Column:
            if not word:
                return F.lit(True)
            sources = [word] + ([SOURCE_ALIASES[word]] if word in SOURCE_ALIASES else [])
            return F.col("source").isin(*sources) | (F.col("category") == word)

        return ok(self.category) & ok(self.product) & ok(self.service)

    def hit(self) -> Column:
        """Struct of the hit, or null."""
        named = Selections({name: selection(ms) for name, ms in self.selections.items() if ms})
        holds = (self.condition or Selections.one_of)(named)
        # Context: first matcher of the first true selection, in name order.
        field_name, value = F.lit(""), F.lit("")
        for name in sorted(named, reverse=True):
            first = self.selections[name][0].field
            field_name = F.when(named[name], first).otherwise(field_name)
            value = F.when(named[name], event_field(first)).otherwise(value)
        return F.when(self.applies() & holds, F.struct(
            F.lit(self.id).alias("rule_id"), F.lit(self.title).alias("rule_title"),
            F.lit(self.severity).alias("severity"),
            F.array(*[F.lit(t) for t in self.tags]).cast("array<string>").alias("tags"),
            F.lit(self.mitre_id).alias("mitre_id"), F.lit(self.description).alias("description"),
            field_name.alias("matched_field"), value.alias("matched_value"),
        ))


def sigma_match(events: DataFrame, rules: Sequence[SigmaRule]) -> DataFrame:
    """One row per (event, rule) hit; all rules are one projection over the events."""
    others = [c for c in events.columns if c not in ("fields", "source", "category")]
    hits = compact(*[r.hit() for r in rules if r.enabled])
    return explode_once(events, others, hits, "_h").select(*others, "_h.*")


_EVENT = ["source", "category", "device_id", "timestamp_ms", "machine_ip", "fields"]


def _field_map(fields: Mapping[str, Column]) -> Column:
    pairs = []
    for name, value in fields.items():
        pairs += [F.lit(name), F.coalesce(value.cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def sigma_telemetry_events(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Telemetry with features and counts as events with 18 fields."""
    c = F.col
    have = set(rows.columns)
    text = lambda name: c(name) if name in have else F.lit("")
    whole = lambda name: c(name).cast("long")
    fields = {
        "Message": text("raw_log"), "User": text("os_user"), "Computer": text("machine_name"),
        "SourceIp": text("machine_ip"),
        "CpuPct": whole("cpu_pct"), "RamPct": whole("ram_pct"), "DiskFreePct": whole("disk_free_pct"),
        "RamTotalBytes": c("ram_total_bytes"), "RamAvailBytes": c("ram_avail_bytes"),
        "DiskTotalBytes": c("disk_total_bytes"), "DiskFreeBytes": c("disk_free_bytes"),
        "NetBytesIn": c("net_bytes_in"), "NetBytesOut": c("net_bytes_out"),
        "NetDeltaIn": c("net_in_delta"), "NetDeltaOut": c("net_out_delta"),
        "AuthFailures": c("auth_failures"), "EventCount": c("event_count"), "IntervalMs": c("interval_ms"),
    }
    return rows.select(*keep, F.lit("telemetry").alias("source"), F.lit("log").alias("category"),
                       "device_id", "timestamp_ms", text("machine_ip").alias("machine_ip"),
                       _field_map(fields).alias("fields"))


def sigma_process_events(processes: DataFrame) -> DataFrame:
    have = set(processes.columns)
    text = lambda name: F.col(name) if name in have else F.lit("")
    fields = {"Image": text("path"), "CommandLine": text("cmdline"), "ProcessName": text("name"), "User": text("user")}
    return processes.select(F.lit("process").alias("source"), F.lit("process_creation").alias("category"),
                            "device_id", "timestamp_ms", text("machine_ip").alias("machine_ip"),
                            _field_map(fields).alias("fields"))


def sigma_syslog_events(syslog: DataFrame, ts: str = "received_ms") -> DataFrame:
    c = F.col
    fields = {"Message": c("message"), "Computer": c("hostname"), "SourceIp": c("source_ip"), "Service": c("app_name")}
    return syslog.select(F.lit("syslog").alias("source"), c("app_name").alias("category"),
                         F.lit(0).cast("long").alias("device_id"), c(ts).alias("timestamp_ms"),
                         c("source_ip").alias("machine_ip"), _field_map(fields).alias("fields"))


def sigma_events(*parts: DataFrame) -> DataFrame:
    """One event table from telemetry, process and syslog events."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*_EVENT) for p in parts])
