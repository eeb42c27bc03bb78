"""Severity words, numbers and anomaly tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from watchloom.functions.columns import as_column, case_of

# Rank, CEF severity and RFC 5424 severity of each word.
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
CEF_NUMBERS = {"critical": 10, "high": 7, "medium": 5, "low": 3}
SYSLOG_NUMBERS = {"critical": 2, "high": 3, "medium": 4}
SYSLOG_LEVELS = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]


def severity_rank(severity: Column | str) -> Column:
    return case_of(severity, RANKS, 0)


def cef_severity(severity: Column | str) -> Column:
    return case_of(severity, CEF_NUMBERS, 1)


def syslog_severity(severity: Column | str) -> Column:
    return case_of(severity, SYSLOG_NUMBERS, 5)


def syslog_level(number: Column | str) -> Column:
    """Name of a syslog severity; out-of-range numbers read as ``info``."""
    number = as_column(number)
    safe = F.when(number.between(0, 7), number).otherwise(6)
    return F.element_at(F.array(*[F.lit(x) for x in SYSLOG_LEVELS]), (safe + 1).cast("int"))


def z_severity(z: Column | str, low: float = 2.0, medium: float = 2.5, high: float = 3.0) -> Column:
    z = F.abs(as_column(z))
    return F.when(z >= high, "critical").when(z >= medium, "high").when(z >= low, "medium").otherwise("")


def z_confidence(z: Column | str, low: float = 2.0, high: float = 3.0) -> Column:
    """0 below ``low``, then linear from 0.3, 0.9 at ``high``, never above 0.95."""
    z = F.abs(as_column(z))
    return F.when(z < low, F.lit(0.0)).otherwise(F.least(F.lit(0.95), 0.3 + (z - low) / (high - low) * 0.6))


def at_least(severity: Column | str, minimum: str) -> Column:
    return severity_rank(severity) >= RANKS.get(minimum, 0)
