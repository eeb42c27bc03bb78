"""Snapshot differences as outer, semi and anti joins.

The join keys always contain the item (path, pid, connection, …), so a device
with very many items is spread over the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchloom.functions.mitre import fim_mitre_id, fim_mitre_tactic
from watchloom.functions.text import path_severity
from watchloom.rules.reference_lists import SUSPICIOUS_PROCESS_NAMES, SUSPICIOUS_REMOTE_PORTS

_ENTRY = ["sha256", "size_bytes", "mtime_epoch"]


def _file_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a full outer join (structs ``old`` and ``new``) that are changes."""
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old.sha256") != F.col("new.sha256"), "modified")
    )
    side = lambda s, f, default: F.coalesce(F.col(f"{s}.{f}"), F.lit(default))
    return pairs.withColumn("change_type", change).filter(F.col("change_type").isNotNull()).select(
        *keys, "change_type",
        side("old", "sha256", "").alias("old_hash"), side("new", "sha256", "").alias("new_hash"),
        side("old", "size_bytes", 0).alias("old_size"), side("new", "size_bytes", 0).alias("new_size"),
        side("old", "mtime_epoch", 0).alias("old_mtime"), side("new", "mtime_epoch", 0).alias("new_mtime"),
    )


def _file_entry(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    if "mtime_epoch" not in df.columns:
        df = df.withColumn("mtime_epoch", F.lit(0).cast("long"))
    return df.select(*keys, F.struct(*_ENTRY).alias(name))


def fim_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Added, modified (hash differs) and deleted files by device and path."""
    keys = ["device_id", "path"]
    pairs = _file_entry(prev, "old", keys).join(_file_entry(cur, "new", keys), keys, "full_outer")
    return _file_changes(pairs, keys)


def describe_file_change() -> Column:
    head = F.concat(F.lit("File "), F.col("change_type"), F.lit(": "), F.col("path"))
    old, new = F.col("old_size").cast("string"), F.col("new_size").cast("string")
    return (
        F.when(F.col("change_type") == "modified",
               F.concat(head, F.lit(" (hash changed, size "), old, F.lit(" -> "), new, F.lit(")")))
        .when(F.col("change_type") == "added", F.concat(head, F.lit(" (new file, "), new, F.lit(" bytes)")))
        .otherwise(F.concat(head, F.lit(" (was "), old, F.lit(" bytes)")))
    )


def fim_alerts(
    snapshots: DataFrame,
    critical: Sequence[str] = (),
    high: Sequence[str] = (),
    default_severity: str = "medium",
    headers: DataFrame | None = None,
) -> DataFrame:
    """Alerts for every change between consecutive snapshots of a device.

    ``snapshots``: device_id, timestamp_ms, path, sha256, size_bytes[, mtime_epoch]. ``headers`` (device_id,
    timestamp_ms) lists all snapshots, also those without a file, in which everything was deleted.
    A device's first snapshot is its baseline. Only the list of snapshot times
    is windowed per device; the files join on (device, snapshot, path).
    """
    times = snapshots.select("device_id", "timestamp_ms")
    if headers is not None:
        times = times.unionByName(headers.select("device_id", "timestamp_ms"))
    times = times.distinct()
    per_device = Window.partitionBy("device_id").orderBy("timestamp_ms")
    nxt = times.withColumn("_next", F.lead("timestamp_ms").over(per_device)).filter("_next is not null")
    keys = ["device_id", "path", "timestamp_ms"]
    old = (
        snapshots.join(nxt, ["device_id", "timestamp_ms"])
        .withColumn("timestamp_ms", F.col("_next")).drop("_next")
    )
    # Snapshots that follow another one; a baseline has nothing to differ from.
    new = snapshots.join(
        nxt.select("device_id", F.col("_next").alias("timestamp_ms")), ["device_id", "timestamp_ms"], "left_semi"
    )
    pairs = _file_entry(old, "old", keys).join(_file_entry(new, "new", keys), keys, "full_outer")
    return (
        _file_changes(pairs, keys)
        .withColumn("severity", path_severity("path", critical, high, default_severity))
        .withColumn("mitre_id", fim_mitre_id("change_type", "severity"))
        .withColumn("mitre_tactic", fim_mitre_tactic("change_type", "severity"))
        .withColumn("description", describe_file_change())
    )


def tamper_check(baseline: DataFrame, cur: DataFrame, keys: Sequence[str] = ("device_id", "path")) -> DataFrame:
    """OK, CHANGED or MISSING per protected path; NOT_INITIALIZED for a device without baseline."""
    keys = list(keys)
    want = baseline.select(*keys, F.col("sha256").alias("expected_hash"))
    have = cur.select(*keys, F.col("sha256").alias("actual_hash"))
    checked = want.join(have, keys, "left").withColumn(
        "status",
        F.when(F.col("actual_hash").isNull(), "MISSING")
        .when(F.col("actual_hash") != F.col("expected_hash"), "CHANGED").otherwise("OK"),
    )
    if "device_id" not in keys:
        return checked
    bare = (
        cur.select("device_id").distinct().join(baseline.select("device_id").distinct(), "device_id", "left_anti")
        .select("device_id", *[F.lit(None).cast(t).alias(c) for c, t in checked.dtypes if c not in ("device_id", "status")],
                F.lit("NOT_INITIALIZED").alias("status"))
    )
    return checked.unionByName(bare)


def _two_way(prev: DataFrame, cur: DataFrame, keys: list[str], gained: str, lost: str) -> DataFrame:
    return (
        cur.join(prev, keys, "left_anti").withColumn("change_type", F.lit(gained))
        .unionByName(prev.join(cur, keys, "left_anti").withColumn("change_type", F.lit(lost)), allowMissingColumns=True)
    )


def process_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Processes that started or ended, by device and pid."""
    return _two_way(prev, cur, ["device_id", "pid"], "new", "terminated").withColumn(
        "reason", F.when(F.col("change_type") == "new", "New process started").otherwise("Process terminated")
    )


def suspicious_processes(cur: DataFrame, names: Sequence[str] = tuple(SUSPICIOUS_PROCESS_NAMES)) -> DataFrame:
    """Processes whose name holds a listed one; the first in the list is the reason."""
    lower = F.lower("name")
    hit = None
    for name in names:
        test = lower.contains(name.lower())
        hit = F.when(test, name) if hit is None else hit.when(test, name)
    return (
        cur.withColumn("_hit", hit).filter(F.col("_hit").isNotNull())
        .withColumn("reason", F.concat(F.lit("Matches suspicious name: "), F.col("_hit"))).drop("_hit")
    )


CONNECTION_KEY = ["device_id", "protocol", "local_addr", "local_port", "remote_addr", "remote_port"]


def connection_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Connections that appeared or closed; several rows of one key closing are one change."""
    new = cur.join(prev, CONNECTION_KEY, "left_anti").select(*CONNECTION_KEY, "state", F.lit("new").alias("change_type"))
    closed = (
        prev.join(cur, CONNECTION_KEY, "left_anti").select(*CONNECTION_KEY).distinct()
        .withColumn("state", F.lit("")).withColumn("change_type", F.lit("closed"))
    )
    return new.unionByName(closed).withColumn(
        "reason", F.when(F.col("change_type") == "new", "New connection").otherwise("Connection closed")
    )


def suspicious_connections(cur: DataFrame, ports: Sequence[int] = tuple(SUSPICIOUS_REMOTE_PORTS)) -> DataFrame:
    remote = F.col("remote_addr")
    return cur.filter(
        (F.col("state") != "LISTEN") & ~remote.isin("", "0.0.0.0", "::") & F.col("remote_port").isin(*ports)
    ).withColumn("reason", F.concat(F.lit("Suspicious remote port: "), F.col("remote_port").cast("string")))


def per_report(df: DataFrame) -> list[str]:
    """The key of one report: device and time, or the device where the rows carry no time."""
    return [c for c in ("device_id", "timestamp_ms") if c in df.columns]


def connection_summary(cur: DataFrame) -> DataFrame:
    """Counts of each report; rows without timestamp_ms are one report of their device."""
    return cur.groupBy(*per_report(cur)).agg(
        F.count_if(F.col("protocol").startswith("tcp")).alias("total_tcp"),
        F.count_if(F.col("protocol").startswith("udp")).alias("total_udp"),
        F.count_if(F.col("state") == "LISTEN").alias("listening_ports"),
    )


def software_dedupe(df: DataFrame, keys: Sequence[str] = ("device_id", "name", "version")) -> DataFrame:
    """One row per package version; the lowest remaining columns win, so reruns agree."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    return (
        df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r"))
        .select(*keys, "_r.*").select(*df.columns)
    )


def software_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Installed, updated (old version kept) and removed packages, by device and name.

    Of several entries of one name on a side the greatest version, then publisher, stands for the package.
    """
    keys = ["device_id", "name"]
    entry = lambda df, as_: df.groupBy(*keys).agg(F.max(F.struct("version", "publisher")).alias(as_))
    pairs = entry(prev, "old").join(entry(cur, "new"), keys, "full_outer")
    change = (
        F.when(F.col("old").isNull(), "installed")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.version") != F.col("new.version"), "updated")
    )
    shown = F.coalesce("new", "old")
    return pairs.withColumn("change_type", change).filter(F.col("change_type").isNotNull()).select(
        *keys, "change_type", shown["version"].alias("version"), shown["publisher"].alias("publisher"),
        F.when(F.col("change_type") == "updated", F.col("old.version")).otherwise("").alias("old_version"),
    )


USB_KEY = ["device_id", "vendor_id", "product_id", "serial"]


def usb_allowed(whitelist: Sequence[str]) -> Column:
    """Whether VID:PID or VID:PID:SERIAL is listed, in any case."""
    allowed = [w.upper() for w in whitelist]
    pair = F.concat_ws(":", "vendor_id", "product_id")
    return F.upper(pair).isin(allowed) | F.upper(F.concat_ws(":", pair, "serial")).isin(allowed)


def usb_diff(prev: DataFrame, cur: DataFrame, whitelist: Sequence[str] = ()) -> DataFrame:
    """Inserted and removed devices; inserted ones outside a non-empty whitelist are unauthorized too."""
    inserted = cur.join(prev, USB_KEY, "left_anti")
    removed = prev.join(cur, USB_KEY, "left_anti")
    out = (
        inserted.withColumn("change_type", F.lit("inserted")).withColumn("reason", F.lit("Device inserted"))
        .unionByName(removed.withColumn("change_type", F.lit("removed")).withColumn("reason", F.lit("Device removed")))
    )
    if not whitelist:
        return out
    pair = F.concat_ws(":", "vendor_id", "product_id")
    unauthorized = (
        inserted.filter(~usb_allowed(whitelist)).withColumn("change_type", F.lit("unauthorized"))
        .withColumn("reason", F.concat(F.lit("VID:PID not in whitelist: "), pair))
    )
    return out.unionByName(unauthorized)


def usb_severity(changes: DataFrame) -> DataFrame:
    change, storage = F.col("change_type"), F.col("device_class") == "storage"
    return changes.withColumn(
        "severity",
        F.when(change == "unauthorized", "high").when((change == "inserted") & storage, "medium").otherwise("low"),
    )
