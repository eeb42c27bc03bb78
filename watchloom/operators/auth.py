"""Authentication events from log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import compact, explode_once
from watchloom.operators.rule_scan import log_lines

# Patterns for user and address.
FAILED_PATTERN = r"(?i)Failed password for (?:invalid user )?(\S+) from (\S+)"
ACCEPTED_PATTERN = r"(?i)Accepted \S+ for (\S+) from (\S+)"
SUDO_PATTERN = r"(\S+)\s*:\s*.*COMMAND=(.+)"


def _event(kind: str, session: str, detail: Column | str, user: Column | str = "", ip: Column | str = "") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("event_type"), lit(user).alias("username"), lit(ip).alias("source_ip"),
        F.lit(session).alias("session_type"), lit(detail).alias("detail"),
    )


def _explode(logs: DataFrame, text: str, *events: Column) -> DataFrame:
    """One event per line and kind; ``events`` read the line in column ``text``."""
    others = [c for c in logs.columns if c != text]
    lines = logs.select(*others, F.explode(log_lines(text)).alias(text))
    return explode_once(lines, others, compact(*events), "_e").select(*others, "_e.*")


def linux_auth_events(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    """Failed and accepted ssh logins, sudo commands and su sessions of a log chunk."""
    log = F.col(text)
    has = log.contains
    grab = lambda pattern, i: F.regexp_extract(log, pattern, i)
    command = grab(SUDO_PATTERN, 2)
    return _explode(
        logs, text,
        F.when(has("Failed password"), _event(
            "login_failed", "ssh", "SSH failed password", grab(FAILED_PATTERN, 1), grab(FAILED_PATTERN, 2))),
        F.when(has("Accepted") & (has("password") | has("publickey")), _event(
            "login_success", "ssh", "SSH login accepted", grab(ACCEPTED_PATTERN, 1), grab(ACCEPTED_PATTERN, 2))),
        F.when(has("sudo") & has("COMMAND"), _event(
            "priv_escalation", "sudo",
            F.when(command != "", F.concat(F.lit("sudo: "), command)).otherwise(""), grab(SUDO_PATTERN, 1))),
        F.when((has("su[") | has("su:")) & (has("Successful") | has("session opened")), _event(
            "priv_escalation", "su", "su session opened")),
    )


def windows_auth_events(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    has = F.col(text).contains
    return _explode(
        logs, text,
        F.when(has("4625") | has("failed"), _event(
            "login_failed", "", "Failed authentication attempt detected in event log")),
        F.when(has("4672") | has("special privileges"), _event(
            "priv_escalation", "", "Special privileges assigned (EventID 4672)")),
    )


def failed_logins(auth_events: DataFrame, on: tuple[str, ...] = ("device_id", "timestamp_ms")) -> DataFrame:
    """Failed logins per device and report."""
    return auth_events.groupBy(*on).agg(F.count_if(F.col("event_type") == "login_failed").alias("failed_logins"))
