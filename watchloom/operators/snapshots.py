"""Changes along any number of snapshots of a device: presence intervals per item.

The list of snapshots gives each one its predecessor and successor. An item's rows then meet in one window: it was
added where it isn't in the predecessor, has gone where it isn't in the successor, and has changed where it is in
the predecessor with other values. No snapshot is joined with another one, and the items of a device are spread over
the shuffle. The first snapshot of a device is its baseline and says nothing.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchloom.functions.mitre import fim_mitre_id, fim_mitre_tactic
from watchloom.functions.text import path_severity
from watchloom.operators.diffs import CONNECTION_KEY, USB_KEY, describe_file_change, usb_allowed


@dataclasses.dataclass(frozen=True)
class Inventory:
    """Which columns name an item of a device, which are carried, and which of these make a change."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    compare: tuple[str, ...] = ()


FILES = Inventory(("path",), ("sha256", "size_bytes", "mtime_epoch"), ("sha256",))
PROCESSES = Inventory(("pid",), ("name", "path", "user_name", "cmdline"))
CONNECTIONS = Inventory(tuple(CONNECTION_KEY[1:]), ("state",))
SOFTWARE = Inventory(("name",), ("version", "publisher"), ("version",))
USB = Inventory(tuple(USB_KEY[1:]), ("device_class", "product_name"))


def snapshot_times(snapshots: DataFrame, headers: DataFrame | None) -> DataFrame:
    """device_id, timestamp_ms, before and after (times of the neighbouring snapshots) of all snapshots."""
    times = snapshots.select("device_id", "timestamp_ms")
    if headers is not None:
        times = times.unionByName(headers.select("device_id", "timestamp_ms"))
    per_device = Window.partitionBy("device_id").orderBy("timestamp_ms")
    return times.distinct().select(
        "device_id", "timestamp_ms", F.lag("timestamp_ms").over(per_device).alias("before"), F.lead("timestamp_ms").over(per_device).alias("after"))


def snapshot_changes(snapshots: DataFrame, inventory: Inventory, headers: DataFrame | None = None) -> DataFrame:
    """device_id, timestamp_ms, the item's keys, change (added, changed, gone), and old_ and new_ values.

    ``headers`` (device_id, timestamp_ms) lists all snapshots, also those without an item, in which everything has
    gone. Of several rows of one item in a snapshot the one with the greatest values, as text, stands for it.
    """
    keys, values = list(inventory.keys), list(inventory.values)
    text = lambda v: F.col(v).cast("string")
    entry = F.struct(*[text(v).alias(f"_{v}") for v in values], *values)
    placed = snapshots.join(snapshot_times(snapshots, headers), ["device_id", "timestamp_ms"]).select(
        F.xxhash64("device_id", *keys).alias("_item"), "device_id", "timestamp_ms", "before", "after", *keys, entry.alias("entry"))
    # Sorted by a number first: comparing devices and texts is left to items whose numbers are equal.
    item = ["_item", "device_id", *keys]
    items = placed.repartition("_item").groupBy(*item, "timestamp_ms", "before", "after").agg(F.max("entry").alias("entry"))
    along = Window.partitionBy(*item).orderBy("timestamp_ms")
    seen = items.withColumns({
        "seen": F.lag("timestamp_ms").over(along), "old": F.lag("entry").over(along), "again": F.lead("timestamp_ms").over(along)})
    there = F.col("seen").eqNullSafe(F.col("before"))
    differs = reduce(lambda a, b: a | b, [~F.col(f"old.{c}").eqNullSafe(F.col(f"entry.{c}")) for c in inventory.compare], F.lit(False))
    none = F.lit(None).cast(items.schema["entry"].dataType)
    change = lambda kind, at, old, new: F.struct(F.lit(kind).alias("change"), F.col(at).alias("at"), old.alias("old"), new.alias("new"))
    found = F.array_compact(F.array(
        F.when(F.col("before").isNotNull() & ~there, change("added", "timestamp_ms", none, F.col("entry"))),
        F.when(F.col("before").isNotNull() & there & differs, change("changed", "timestamp_ms", F.col("old"), F.col("entry"))),
        F.when(F.col("after").isNotNull() & ~F.col("again").eqNullSafe(F.col("after")), change("gone", "after", F.col("entry"), none)),
    ))
    return seen.select("device_id", *keys, F.explode(found).alias("c")).select(
        "device_id", F.col("c.at").alias("timestamp_ms"), *keys, "c.change",
        *[F.col(f"c.{s}.{v}").alias(f"{s}_{v}") for s in ("old", "new") for v in values])


def _named(names: dict[str, str]) -> Column:
    arms = F
    for kind, name in names.items():
        arms = arms.when(F.col("change") == kind, name)
    return arms


def file_changes(changes: DataFrame, critical: Sequence[str] = (), high: Sequence[str] = (), default_severity: str = "medium") -> DataFrame:
    """Changes of ``FILES`` as alerts with severity, technique and description."""
    side = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    named = changes.select(
        "device_id", "path", "timestamp_ms", _named({"added": "added", "gone": "deleted", "changed": "modified"}).alias("change_type"),
        side("old_sha256", "").alias("old_hash"), side("new_sha256", "").alias("new_hash"),
        side("old_size_bytes", 0).alias("old_size"), side("new_size_bytes", 0).alias("new_size"),
        side("old_mtime_epoch", 0).alias("old_mtime"), side("new_mtime_epoch", 0).alias("new_mtime"))
    return (
        named.withColumn("severity", path_severity("path", critical, high, default_severity))
        .withColumn("mitre_id", fim_mitre_id("change_type", "severity")).withColumn("mitre_tactic", fim_mitre_tactic("change_type", "severity"))
        .withColumn("description", describe_file_change())
    )


def process_changes(changes: DataFrame) -> DataFrame:
    """Changes of ``PROCESSES``: started and ended ones."""
    return changes.select(
        "device_id", "timestamp_ms", "pid", F.coalesce("new_name", "old_name").alias("name"),
        _named({"added": "new", "gone": "terminated"}).alias("change_type"),
        _named({"added": "New process started", "gone": "Process terminated"}).alias("reason"))


def connection_changes(changes: DataFrame) -> DataFrame:
    """Changes of ``CONNECTIONS``; a closed one has no state."""
    return changes.select(
        "device_id", "timestamp_ms", *CONNECTION_KEY[1:], F.coalesce("new_state", F.lit("")).alias("state"),
        _named({"added": "new", "gone": "closed"}).alias("change_type"),
        _named({"added": "New connection", "gone": "Connection closed"}).alias("reason"))


def software_changes(changes: DataFrame) -> DataFrame:
    """Changes of ``SOFTWARE``; an updated package keeps its old version."""
    either = lambda v: F.when(F.col("change") == "gone", F.col(f"old_{v}")).otherwise(F.col(f"new_{v}")).alias(v)
    return changes.select(
        "device_id", "timestamp_ms", "name", _named({"added": "installed", "gone": "removed", "changed": "updated"}).alias("change_type"),
        either("version"), either("publisher"), F.when(F.col("change") == "changed", F.col("old_version")).otherwise("").alias("old_version"))


def usb_changes(changes: DataFrame, whitelist: Sequence[str] = ()) -> DataFrame:
    """Changes of ``USB``; an inserted device outside a non-empty whitelist is unauthorized too."""
    pair = F.concat_ws(":", "vendor_id", "product_id")
    kinds = [_named({"added": "inserted", "gone": "removed"})]
    if whitelist:
        kinds.append(F.when((F.col("change") == "added") & ~usb_allowed(whitelist), "unauthorized"))
    kind = F.explode(F.array_compact(F.array(*kinds)))
    return changes.select("device_id", "timestamp_ms", *USB_KEY[1:], F.coalesce("new_device_class", "old_device_class").alias("device_class"), kind.alias("change_type")).withColumn(
        "reason", F.when(F.col("change_type") == "inserted", "Device inserted").when(F.col("change_type") == "removed", "Device removed")
        .otherwise(F.concat(F.lit("VID:PID not in whitelist: "), pair)))
