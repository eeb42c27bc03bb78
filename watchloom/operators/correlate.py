"""Multi-stage correlation of detections into incidents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import case_of, div_floor, explode_once
from watchloom.functions.severity import at_least
from watchloom.operators.cooldown import cooldown
from watchloom.operators.windows import per_millisecond, trailing_chain, trailing_distinct, trailing_sums
from watchloom.rules.correlation import (
    CATEGORY_ALIASES, DEFAULT_CORRELATION_RULES, INCIDENT_COOLDOWN_SEC, CorrelationRule, Stage,
)
from watchloom.session import cut

CORR_COLUMNS = ["device_id", "timestamp_ms", "source", "category", "severity", "machine_ip",
                "target_user", "indicator", "detail"]


def _corr(df: DataFrame, source: str, **columns: Column | str) -> DataFrame:
    have = set(df.columns)
    pick = lambda name: columns[name] if name in columns else (name if name in have else F.lit(""))
    as_col = lambda v: F.col(v) if isinstance(v, str) else v
    return df.select(
        F.col("device_id").cast("long").alias("device_id"), F.col("timestamp_ms").cast("long").alias("timestamp_ms"),
        F.lit(source).alias("source"),
        *[as_col(pick(c)).cast("string").alias(c)
          for c in ["category", "severity", "machine_ip", "target_user", "indicator", "detail"]],
    )


def corr_events(
    *,
    threats: DataFrame | None = None,
    iocs: DataFrame | None = None,
    fim: DataFrame | None = None,
    network: DataFrame | None = None,
    processes: DataFrame | None = None,
    connections: DataFrame | None = None,
    auth: DataFrame | None = None,
    usb: DataFrame | None = None,
    sigma: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Detections of every family in one schema.

    Classifier categories are translated to the names the rules use;
    ``strict`` leaves them as they are.
    """
    parts = []
    if threats is not None:
        category = F.col("category") if strict else _alias(F.col("category"))
        parts.append(_corr(threats, "traffic", category=category, detail="description"))
    if iocs is not None:
        parts.append(_corr(iocs, "ioc", category=F.lit("ioc_match"), indicator="ioc_value", detail="description"))
    if fim is not None:
        parts.append(_corr(fim, "fim", category=F.concat(F.lit("fim_"), F.col("change_type")),
                           indicator="path", detail="description"))
    if network is not None:
        parts.append(_corr(network, "network_inspector", detail="description"))
    if processes is not None:
        parts.append(_corr(processes, "process", category=F.lit("suspicious"), severity=F.lit("high"),
                           indicator="name", detail="reason"))
    if connections is not None:
        parts.append(_corr(connections, "connection", category=F.lit("suspicious_connection"),
                           severity=F.lit("medium"), indicator="remote_addr", detail="reason"))
    if auth is not None:
        known = auth.filter(F.col("event_type").isin("login_failed", "priv_escalation", "login_success"))
        severity = case_of("event_type", {"login_failed": "medium", "priv_escalation": "high"}, "low")
        parts.append(_corr(known, "session", category="event_type", severity=severity,
                           target_user="username", indicator="source_ip"))
    if usb is not None:
        parts.append(_corr(usb, "usb", category="change_type",
                           indicator=F.concat_ws(":", "vendor_id", "product_id"), detail="reason"))
    if sigma is not None:
        parts.append(_corr(sigma, "sigma", category="rule_title", detail="description"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _alias(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CATEGORY_ALIASES.items())])
    return F.coalesce(F.try_element_at(table, category), category)


def _stage_test(stage: Stage) -> Column:
    tests = [F.lit(True)]
    if stage.source:
        tests.append(F.col("source") == stage.source)
    if stage.category:
        tests.append(F.col("category") == stage.category)
    if stage.min_severity:
        tests.append(at_least("severity", stage.min_severity))
    return reduce(lambda a, b: a & b, tests)


def _rule_value(rules: Sequence[CorrelationRule], attribute: str) -> Column:
    return case_of("rule_name", {r.name: getattr(r, attribute) for r in rules}, None)


def _stage_events(events: DataFrame, rules: Sequence[CorrelationRule], stages: int) -> DataFrame:
    """One row per (event, rule) that matches at least one stage, with a flag per stage.

    All rules are one projection over the events; no rule table is joined.
    """
    options = []
    for r in rules:
        flags = [_stage_test(s).cast("long") for s in r.stages]
        # A missing stage of a shorter rule is always satisfied but counts nothing.
        flags += [F.lit(0).cast("long")] * (stages - len(flags))
        scope = F.lit("global") if r.cross_device else F.col("device_id").cast("string")
        options.append(F.when(
            reduce(lambda a, b: a | b, [_stage_test(s) for s in r.stages]),
            F.struct(F.lit(r.name).alias("rule_name"), scope.alias("scope"),
                     *[f.alias(f"s{i}") for i, f in enumerate(flags)]),
        ))
    found = F.filter(F.array(*options), lambda x: x.isNotNull())
    return explode_once(events, [
        F.col("device_id").cast("long").alias("device_id"), F.col("timestamp_ms").cast("long").alias("timestamp_ms"),
        "source", "category",
    ], found, "_m").select("device_id", "timestamp_ms", "source", "category", "_m.*")


def _incident_id() -> Column:
    return F.concat_ws(":", "rule_name", "scope", F.col("first_seen_ms").cast("string"))


def _incident_pairs(fired: DataFrame, matched: DataFrame, rules: Sequence[CorrelationRule], stages: int) -> DataFrame:
    """Counts of the stage events in the window of each incident, by device, source and category.

    Events are first counted per millisecond, then meet the incidents of
    their own and the next time bucket.
    """
    width = (_rule_value(rules, "window_seconds") * 1000).cast("long")
    n = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(stages)])
    counted = (
        matched.groupBy("rule_name", "scope", "timestamp_ms", "device_id", "source", "category")
        .agg(F.sum(n).alias("matches"))
        .withColumn("_b", div_floor(F.col("timestamp_ms"), width))
        .select("*", F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_bucket")).drop("_b")
    )
    places = fired.select("rule_name", "scope", F.col("timestamp_ms").alias("first_seen_ms"),
                          div_floor(F.col("timestamp_ms"), width).alias("_bucket"))
    return (
        counted.join(places, ["rule_name", "scope", "_bucket"])
        .filter((F.col("timestamp_ms") <= F.col("first_seen_ms")) & (F.col("timestamp_ms") >= F.col("first_seen_ms") - width))
        .groupBy("rule_name", "scope", "first_seen_ms", "device_id", "source", "category")
        .agg(F.sum("matches").alias("matches"))
    )


def _fired(events: DataFrame, rules: Sequence[CorrelationRule]) -> tuple[DataFrame, DataFrame, int]:
    stages = max(len(r.stages) for r in rules)
    matched = _stage_events(events, rules, stages)
    columns = [f"s{i}" for i in range(stages)]
    keys = ["rule_name", "scope"]
    counted = per_millisecond(matched, keys, "timestamp_ms", {c: F.col(c) for c in columns})
    windowed = trailing_sums(
        counted, keys, "timestamp_ms", columns, (_rule_value(rules, "window_seconds") * 1000).cast("long")
    )
    wins = [F.col(f"{c}_win") for c in columns]
    needed = case_of("rule_name", {r.name: len(r.stages) for r in rules}, 0)
    complete = reduce(lambda a, b: a & b, [(w > 0) | (needed <= i) for i, w in enumerate(wins)])
    satisfied = windowed.withColumn("matches", reduce(lambda a, b: a + b, wins)).filter(
        complete & (F.col("matches") >= _rule_value(rules, "min_events"))
    ).select(*keys, "timestamp_ms", "matches", F.lit(0).cast("long").alias("_one"))
    width = (_rule_value(rules, "window_seconds") * 1000).cast("long")
    ordered = [r.name for r in rules if r.ordered]
    if ordered:
        chained = trailing_chain(counted.filter(F.col("rule_name").isin(ordered)), keys, "timestamp_ms", columns, needed, width)
        in_time = chained.filter(F.col("started") >= F.col("timestamp_ms") - width).select(*keys, "timestamp_ms")
        free = satisfied.filter(~F.col("rule_name").isin(ordered))
        satisfied = free.unionByName(satisfied.filter(F.col("rule_name").isin(ordered)).join(in_time, [*keys, "timestamp_ms"], "left_semi"))
    several = [r.name for r in rules if r.min_devices > 1]
    if several:
        devices = trailing_distinct(matched.filter(F.col("rule_name").isin(several)), keys, "device_id", "timestamp_ms", width, "devices")
        enough = devices.filter(F.col("devices") >= _rule_value(rules, "min_devices")).select(*keys, "timestamp_ms")
        free = satisfied.filter(~F.col("rule_name").isin(several))
        satisfied = free.unionByName(satisfied.filter(F.col("rule_name").isin(several)).join(enough, [*keys, "timestamp_ms"], "left_semi"))
    fired = cooldown(cut(satisfied), keys, INCIDENT_COOLDOWN_SEC, tiebreak="_one", compacted=True).drop("_one")
    # Incidents are few; both their description and their members start from them.
    return cut(fired), matched, stages


def correlate(events: DataFrame, rules: Sequence[CorrelationRule] = tuple(DEFAULT_CORRELATION_RULES)) -> DataFrame:
    """Incidents: every stage has an event and enough match within the window that ends at a stage event.

    Device rules look at one device, the others at the whole fleet; a rule and
    scope stays silent for 300 s after an incident. Stage order is not
    required unless the rule is ``ordered``, and an event counts once per stage
    it matches. A rule with ``min_devices`` needs events of that many devices.
    """
    fired, matched, stages = _fired(events, rules)
    involved = (
        _incident_pairs(fired, matched, rules, stages)
        .groupBy("rule_name", "scope", "first_seen_ms")
        .agg(F.count_distinct("device_id").alias("device_count"), F.min("device_id").alias("first_device"))
    )
    incidents = (
        fired.withColumnRenamed("timestamp_ms", "first_seen_ms")
        .join(involved, ["rule_name", "scope", "first_seen_ms"])
    )
    described = F.concat(
        _rule_value(rules, "description"), F.lit(" | "), F.col("device_count").cast("string"), F.lit(" device(s), "),
        F.col("matches").cast("string"), F.lit(" events in "),
        _rule_value(rules, "window_seconds").cast("string"), F.lit("s window"),
    )
    return incidents.select(
        _incident_id().alias("incident_id"), "rule_name", "scope",
        _rule_value(rules, "severity").alias("severity"),
        _rule_value(rules, "mitre_tactic").alias("mitre_tactic"),
        _rule_value(rules, "mitre_technique").alias("mitre_technique"),
        "first_seen_ms", F.col("first_seen_ms").alias("last_seen_ms"),
        F.col("matches").alias("event_count"), "device_count", "first_device",
        F.least(F.lit(1.0), 0.5 + F.col("matches") * 0.1).alias("confidence"),
        described.alias("description"), F.lit(True).alias("is_active"),
    )


def incident_members(events: DataFrame, rules: Sequence[CorrelationRule] = tuple(DEFAULT_CORRELATION_RULES)) -> DataFrame:
    """The events of each incident as rows (device, source, category, stage matches).

    A fleet-wide incident may involve any number of devices, so members are a
    table of their own and not an array in the incident.
    """
    fired, matched, stages = _fired(events, rules)
    return _incident_pairs(fired, matched, rules, stages).select(
        _incident_id().alias("incident_id"), "rule_name", "device_id", "source", "category", "matches",
        F.concat(F.col("source"), F.lit("/"), F.col("category"), F.lit(" from device "),
                 F.col("device_id").cast("string")).alias("event"),
    )


def recent_incidents(incidents: DataFrame, n: int = 50) -> DataFrame:
    return incidents.orderBy(F.desc("first_seen_ms"), "incident_id").limit(n)


def active_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter("is_active")


def incident_json(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Incident as JSON text with its device list (distinct ids, so at most the fleet)."""
    devices = members.groupBy("incident_id").agg(F.sort_array(F.collect_set("device_id")).alias("devices"))
    body = F.to_json(F.struct(
        "incident_id", "first_seen_ms", "last_seen_ms", "rule_name", "severity", "description", "mitre_tactic",
        "mitre_technique", "confidence", "is_active", "device_count", "event_count", "devices"))
    return incidents.join(devices, "incident_id").select("incident_id", body.alias("json"))
