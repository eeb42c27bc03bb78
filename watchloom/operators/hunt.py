"""Hunting: a small fluent query over the detection tables, and recent-row lists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Source -> (table, fields).
SOURCES = {
    "events": ("security_events", [
        "device_id", "timestamp_ms", "machine_ip", "rule_name", "severity", "category", "matched_text", "received_at"]),
    "threats": ("threat_detections", [
        "device_id", "timestamp_ms", "machine_ip", "category", "sub_type", "severity", "confidence", "mitre_id",
        "mitre_name", "mitre_tactic", "description", "received_at"]),
    "ioc": ("ioc_matches", [
        "device_id", "timestamp_ms", "machine_ip", "ioc_type", "ioc_value", "severity", "feed_source", "matched_in",
        "mitre_id", "description", "tags", "received_at"]),
    "fim": ("fim_events", [
        "device_id", "timestamp_ms", "machine_ip", "change_type", "file_path", "old_hash", "new_hash", "severity",
        "mitre_id", "description", "received_at"]),
    "correlations": ("correlations_view", [
        "incident_id", "rule_name", "severity", "mitre_tactic", "mitre_technique", "description", "first_seen_ms",
        "last_seen_ms"]),
    "audit": ("audit_log", ["username", "tenant_id", "action", "source_ip", "success", "timestamp_ms"]),
}
OPERATORS = ["=", "!=", ">", "<", ">=", "<=", "~"]
DEFAULT_LIMIT = 50

# Columns listed per table, newest rows first.
RECENT_COLUMNS = {
    "threat_detections": ["device_id", "timestamp_ms", "machine_ip", "category", "sub_type", "severity", "confidence",
                          "mitre_id", "mitre_name", "description"],
    "ioc_matches": ["device_id", "timestamp_ms", "machine_ip", "ioc_type", "ioc_value", "severity", "feed_source",
                    "matched_in", "mitre_id", "description", "tags"],
    "fim_events": ["device_id", "timestamp_ms", "machine_ip", "change_type", "file_path", "old_hash", "new_hash",
                   "old_size", "new_size", "severity", "mitre_id", "description"],
    "security_events": ["device_id", "timestamp_ms", "machine_ip", "rule_name", "category", "severity", "matched_text"],
}


class Hunt:
    """``Hunt(spark).search("threats").where("severity", "=", "critical").head(20).run()``.

    Fields are checked against the source when a step is added, before
    anything runs; the query itself is a plain DataFrame.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self._spark = spark
        self._tables = tables or {}
        self._source = ""
        self._predicates: list[tuple[str, Column]] = []
        self._fields: list[str] = []
        self._sort: tuple[str, bool] | None = None
        self._limit: int | None = None
        self._stats: tuple[str | None] | None = None

    def search(self, source: str) -> Hunt:
        if source not in SOURCES:
            raise ValueError(f"no source is called {source!r}; there are {sorted(SOURCES)}")
        self._source = source
        return self

    def _check(self, name: str) -> None:
        if not self._source:
            raise ValueError("choose a source with search() before this step")
        if name not in SOURCES[self._source][1]:
            raise ValueError(f"{self._source} has no field {name!r}")

    def _table(self) -> DataFrame:
        name = SOURCES[self._source][0]
        return self._tables[name] if name in self._tables else self._spark.table(name)

    def where(self, field: str, op: str, value: object, connector: str = "AND") -> Hunt:
        """Add a predicate to the flat list; AND binds tighter than OR."""
        self._check(field)
        if op not in OPERATORS:
            raise ValueError(f"{op!r} is none of {OPERATORS}")
        if connector not in ("AND", "OR"):
            raise ValueError("predicates are connected by AND or OR")
        column = F.col(field)
        if op == "~":
            # % and _ in the value keep their wildcard meaning; a backslash is a character like others.
            pattern = str(value).replace("\\", "\\\\")
            test = column.cast("string").ilike(f"%{pattern}%")
        else:
            literal = F.lit(value).cast(self._table().schema[field].dataType)
            test = {
                "=": column == literal, "!=": column != literal, ">": column > literal,
                "<": column < literal, ">=": column >= literal, "<=": column <= literal,
            }[op]
        self._predicates.append((connector, test))
        return self

    def sort(self, field: str, direction: str = "desc") -> Hunt:
        self._check(field)
        if direction not in ("asc", "desc"):
            raise ValueError("the direction is asc or desc")
        self._sort = (field, direction == "desc")
        return self

    def head(self, n: int) -> Hunt:
        """The number of rows to return; rows are 50 where none is asked for, groups all."""
        self._limit = max(1, int(n))
        return self

    limit = head

    def fields(self, *names: str) -> Hunt:
        for name in names:
            self._check(name)
        self._fields += names
        return self

    def stats_count(self, by: str | None = None) -> Hunt:
        if by is not None:
            self._check(by)
        self._stats = (by,)
        return self

    def _condition(self) -> Column | None:
        if not self._predicates:
            return None
        groups: list[Column] = []
        for connector, test in self._predicates:
            if groups and connector == "AND":
                groups[-1] = groups[-1] & test
            else:
                groups.append(test)
        return reduce(lambda a, b: a | b, groups)

    def run(self) -> DataFrame:
        df = self._table()
        condition = self._condition()
        if condition is not None:
            df = df.filter(condition)
        if self._stats is not None:
            by = self._stats[0]
            if by is None:
                return df.agg(F.count("*").alias("count"))
            counts = df.groupBy(by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), by)
            return counts if self._limit is None else counts.limit(self._limit)
        if self._sort is not None:
            field, descending = self._sort
            first = F.desc(field) if descending else F.asc(field)
        else:
            newest = next(c for c in ("received_at", "timestamp_ms", "first_seen_ms") if c in df.columns)
            first = F.desc(newest)
        # Equal keys fall back to the other fields, so that a limit is repeatable.
        rest = [c for c in SOURCES[self._source][1] if c in df.columns]
        df = df.orderBy(first, *rest).limit(self._limit or DEFAULT_LIMIT)
        return df.select(*self._fields) if self._fields else df


def recent(table: DataFrame, name: str, limit: int = 50, device_id: int | None = None) -> DataFrame:
    """Newest rows of a detection table, optionally of one device."""
    columns = RECENT_COLUMNS[name]
    df = table if device_id is None else table.filter(F.col("device_id") == device_id)
    order = [F.desc("received_at"), *columns]
    return df.orderBy(*order).limit(max(1, limit)).select(*columns)


def recent_anomalies(threats: DataFrame, limit: int = 50, device_id: int | None = None) -> DataFrame:
    columns = ["device_id", "timestamp_ms", "machine_ip", "detector", "score", "severity", "mitre_id", "description", "evidence"]
    df = threats.filter("category = 'ml_anomaly'")
    if device_id is not None:
        df = df.filter(F.col("device_id") == device_id)
    df = df.withColumnsRenamed({"sub_type": "detector", "confidence": "score"})
    return df.orderBy(F.desc("received_at"), *columns).limit(max(1, limit)).select(*columns)


def recent_audit(audit: DataFrame, n: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("timestamp_ms"), "username", "action", "tenant_id", "source_ip", "detail").limit(n)
