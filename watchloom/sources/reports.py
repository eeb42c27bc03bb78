"""Inventory reports: one text payload per row, parsed into entry and change tables.

All kinds share a shape: a header line, entry lines, an optional marker line
with change lines after it, and an end line. A payload is at most one message
(1 MiB), so its lines are exploded in place and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import explode_once, held


@dataclass(frozen=True)
class ReportKind:
    header: str
    end: str
    entries: Sequence[tuple[str, str]]
    marker: str = ""
    changes: Sequence[tuple[str, str]] = ()
    extra_header: Sequence[tuple[str, str, int]] = ()
    # Whether the header's count says how many entry lines follow.
    counted: bool = True
    # A row with an unreadable number is dropped; otherwise the number reads 0.
    strict: bool = False


FIM = ReportKind(
    "FIM", "FIM_END",
    [("path", "string"), ("sha256", "string"), ("size_bytes", "bigint"), ("mtime_epoch", "bigint")],
    counted=False, strict=True,
)
PROCESS = ReportKind(
    "PROC", "PROC_END",
    [("pid", "bigint"), ("ppid", "bigint"), ("name", "string"), ("path", "string"), ("user", "string"),
     ("memory_bytes", "bigint"), ("is_elevated", "boolean"), ("cmdline", "string")],
    "PROC_CHANGES",
    [("change_type", "string"), ("pid", "bigint"), ("name", "string"), ("reason", "string")],
)
CONNECTION = ReportKind(
    "CONN", "CONN_END",
    [("protocol", "string"), ("local_addr", "string"), ("local_port", "int"), ("remote_addr", "string"),
     ("remote_port", "int"), ("state", "string"), ("owning_pid", "bigint"), ("process_name", "string")],
    "CONN_CHANGES",
    [("change_type", "string"), ("protocol", "string"), ("remote_addr", "string"), ("remote_port", "int"),
     ("reason", "string")],
)
SESSION = ReportKind(
    "SESS", "SESS_END",
    [("username", "string"), ("session_type", "string"), ("source_ip", "string"), ("terminal", "string"),
     ("login_time_ms", "bigint"), ("is_active", "boolean"), ("is_elevated", "boolean")],
    "SESS_AUTH",
    [("event_type", "string"), ("event_ms", "bigint"), ("username", "string"), ("source_ip", "string"),
     ("session_type", "string"), ("detail", "string")],
    extra_header=[("failed_logins", "bigint", 5)],
)
SOFTWARE = ReportKind(
    "SWRPT", "SW_END",
    [("name", "string"), ("version", "string"), ("publisher", "string"), ("install_date", "string"),
     ("size_bytes", "bigint")],
    "SW_CHANGES",
    [("change_type", "string"), ("name", "string"), ("version", "string"), ("old_version", "string")],
)
USB = ReportKind(
    "USB", "USB_END",
    [("vendor_id", "string"), ("product_id", "string"), ("manufacturer", "string"), ("product_name", "string"),
     ("serial", "string"), ("device_class", "string"), ("mount_point", "string"), ("capacity_bytes", "bigint"),
     ("is_removable", "boolean")],
    "USB_CHANGES",
    [("change_type", "string"), ("vendor_id", "string"), ("product_id", "string"), ("serial", "string"),
     ("product_name", "string"), ("reason", "string")],
)


def _typed(parts: Column, i: int, kind: str) -> Column:
    text = F.coalesce(F.get(parts, i), F.lit(""))
    if kind == "string":
        return text
    if kind == "boolean":
        return text == "1"
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def _with_lines(df: DataFrame, kind: ReportKind, payload: str) -> DataFrame:
    """Payloads with a valid header, split into lines, with the places of marker and end."""
    lines = F.transform(F.split(payload, "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    rows = held(held(df, _lines=lines), _head=F.split(F.get("_lines", 0), r"\|"))
    valid = (F.get("_head", 0) == kind.header) & F.get("_head", 1).try_cast("bigint").isNotNull() \
        & F.get("_head", 2).try_cast("bigint").isNotNull()
    if kind.strict:
        valid = valid & (F.size("_head") >= 4) & F.get("_head", 3).try_cast("bigint").isNotNull()
    rows = rows.filter(valid).withColumns({
        "device_id": F.get("_head", 1).try_cast("bigint"),
        "timestamp_ms": F.get("_head", 2).try_cast("bigint"),
        "_count": F.coalesce(F.get("_head", 3).try_cast("bigint"), F.lit(0).cast("bigint")),
        **{name: _typed(F.col("_head"), i, t) for name, t, i in kind.extra_header},
    })
    place = lambda test: F.coalesce(
        F.get(F.filter(F.transform("_lines", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), 0),
        F.size("_lines"))
    marker = place(lambda x: x.startswith(kind.marker)) if kind.marker else F.size("_lines")
    return held(rows, _marker=marker, _end=place(lambda x: x == kind.end))


def _rows(lines: DataFrame, fields: Sequence[tuple[str, str]], keep: Sequence[str], strict: bool) -> DataFrame:
    parts = F.split("_line", r"\|", -1)
    rows = held(lines, _parts=parts)
    if strict:
        numbers = [F.get("_parts", i).try_cast(t).isNotNull() for i, (_, t) in enumerate(fields) if t == "bigint"]
        ok = F.size("_parts") >= len(fields)
        for n in numbers:
            ok = ok & n
        rows = rows.filter(ok)
    return rows.select(*keep, *[_typed(F.col("_parts"), i, t).alias(n) for i, (n, t) in enumerate(fields)])


def parse_entries(df: DataFrame, kind: ReportKind, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Entry rows of every payload."""
    rows = _with_lines(df, kind, payload)
    last = F.least("_marker", "_end")
    if kind.counted:
        last = F.least(last, (F.col("_count") + 1).cast("int"))
    ids = [*keep, "device_id", "timestamp_ms", *[n for n, _, _ in kind.extra_header]]
    found = F.filter(F.slice("_lines", 2, F.greatest(F.lit(0), last - 1)), lambda x: x != "")
    lines = explode_once(rows, ids, found, "_line")
    return _rows(lines, kind.entries, ids, kind.strict)


def parse_changes(df: DataFrame, kind: ReportKind, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Change rows of every payload: the lines after the marker."""
    if not kind.marker:
        raise ValueError(f"{kind.header} reports carry no changes")
    rows = _with_lines(df, kind, payload)
    span = F.greatest(F.lit(0), F.col("_end") - F.col("_marker") - 1)
    found = F.filter(F.slice("_lines", F.col("_marker") + 2, span), lambda x: x != "")
    lines = explode_once(rows, [*keep, "device_id", "timestamp_ms"], found, "_line")
    return _rows(lines, kind.changes, [*keep, "device_id", "timestamp_ms"], False)


def _both(kind: ReportKind):
    def parse(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(entries, changes) of the payloads."""
        return parse_entries(df, kind, payload, keep), parse_changes(df, kind, payload, keep)

    return parse


def parse_fim_reports(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """File entries; a row with too few fields or an unreadable number is skipped."""
    return parse_entries(df, FIM, payload, keep)


def parse_fim_headers(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One row per readable report (device_id, timestamp_ms), also of a tree without files."""
    return _with_lines(df, FIM, payload).select(*keep, "device_id", "timestamp_ms")


parse_process_reports = _both(PROCESS)
parse_connection_reports = _both(CONNECTION)
parse_session_reports = _both(SESSION)
parse_software_reports = _both(SOFTWARE)
parse_usb_reports = _both(USB)
