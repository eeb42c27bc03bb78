"""Inputs that the derived tables don't hold: nulls, emptied trees, several versions, backslashes, long texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.text import byte_entropy, shannon_entropy
from watchloom.operators.anomaly import train_forest, tree_samples
from watchloom.operators.auth import failed_logins, linux_auth_events
from watchloom.operators.cooldown import cooldown
from watchloom.operators.diffs import fim_alerts, software_diff
from watchloom.operators.hunt import Hunt, recent
from watchloom.operators.intel import match_domain
from watchloom.operators.rule_scan import scan_rules
from watchloom.rules.detection import DetectionRule
from watchloom.sinks.tables import shape_table, write_table
from watchloom.sources.feeds import parse_feed_lines
from watchloom.sources.reports import parse_fim_headers, parse_fim_reports


def test_cooldown_keeps_null_keys(spark):
    rows = [(None, "x", 0, 1), (None, "x", 5_000, 2), (None, "x", 20_000, 3), (1, None, 0, 4), (1, "x", 0, 5), (None, None, 0, 6)]
    df = spark.createDataFrame(rows, "device_id long, category string, timestamp_ms long, event_id long")
    for fold_rows in (0, 100):
        got = cooldown(df, ["device_id", "category"], 20, fold_rows=fold_rows).collect()
        assert sorted(r.event_id for r in got) == [1, 3, 4, 5, 6]


def test_software_with_two_versions(spark):
    rows = [(1, "a", "8", "p"), (1, "a", "11", "p"), (1, "b", "1", "q"), (1, "b", "1", "q")]
    both = spark.createDataFrame(rows, "device_id long, name string, version string, publisher string")
    assert software_diff(both, both).count() == 0
    later = both.filter("name = 'a'").withColumn("version", F.concat("version", F.lit(".1")))
    assert sorted((r.name, r.change_type, r.version, r.old_version) for r in software_diff(both, later).collect()) == [
        ("a", "updated", "8.1", "8"), ("b", "removed", "1", "")]


def test_emptied_tree_raises_alerts(spark):
    payloads = spark.createDataFrame([("FIM|7|1000|1\n/etc/x|aa|3|4\nFIM_END",), ("FIM|7|2000|0\nFIM_END",)], "payload string")
    files, headers = parse_fim_reports(payloads), parse_fim_headers(payloads)
    got = fim_alerts(files, headers=headers).collect()
    assert [(r.device_id, r.timestamp_ms, r.path, r.change_type) for r in got] == [(7, 2000, "/etc/x", "deleted")]


def test_hunting_takes_any_text_number_and_table(spark):
    rows = spark.createDataFrame([(i, r"C:\Windows\x" if i % 2 else "C:/Windows", i % 700) for i in range(30_000)], "device_id long, description string, received_at long")
    hunt = lambda: Hunt(spark, {"threat_detections": rows}).search("threats")
    assert hunt().where("description", "~", r"c:\windows\X").head(20_000).run().count() == 15_000
    assert hunt().head(25_000).run().count() == 25_000 and hunt().run().count() == 50
    assert hunt().stats_count("received_at").run().count() == 700 and hunt().stats_count("received_at").head(3).run().count() == 3
    wide = rows.selectExpr("device_id", "device_id as timestamp_ms", "'' as machine_ip", "'' as category", "'' as sub_type", "'' as severity", "0.5 as confidence", "'' as mitre_id", "'' as mitre_name", "description", "received_at")
    assert recent(wide, "threat_detections", 5_000).count() == 5_000


def test_every_failed_line_counts(spark):
    text = "sshd: Failed password for a from 1.1.1.1 port 2\n" * 9 + "sshd: Failed password for b from 2.2.2.2 port 2\nsudo: c : x ; COMMAND=/bin/ls"
    logs = spark.createDataFrame([(1, 5, text)], "device_id long, timestamp_ms long, raw_log string")
    events = linux_auth_events(logs)
    assert failed_logins(events).first().failed_logins == 10
    assert {r.username for r in events.collect()} == {"a", "b", "sudo"}


def test_whole_texts(spark):
    line = "x" * 5_000 + " secret " + "y" * 9_000
    hits = scan_rules(spark.createDataFrame([(line,)], "raw_log string"), [DetectionRule("r", "low", "c", "secret")])
    assert hits.first().matched_text == line
    rules = [DetectionRule(f"r{i}", "low", "c", f"key{i}\\b") for i in range(400)]
    assert sorted(r.rule_name for r in scan_rules(spark.createDataFrame([("key7 key399 key",)], "raw_log string"), rules).collect()) == ["r399", "r7"]
    feed = spark.createDataFrame([("f", 1, "url|http://h/" + "a" * 20_000)], "feed_source string, line_no int, line string")
    assert len(parse_feed_lines(feed).first().value) == 20_009
    assert len(shape_table(feed.select(F.col("line").alias("ioc_value")), "ioc_matches").first().ioc_value) == 20_013
    assert len(shape_table(feed.select(F.col("line").alias("ioc_value")), "ioc_matches", max_chars=9).first().ioc_value) == 9


def test_entropy_of_any_text(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("a\nb\n",), ("\U0001F600\U0001F601",), (None,)], "s string")
    assert [round(r.h, 6) if r.h is not None else None for r in rows.select(shannon_entropy("s").alias("h")).collect()] == [0.0, 0.0, 1.0, 1.5, 1.0, None]
    assert round(spark.sql("select unhex('00ff00ff01') as b").select(byte_entropy("b").alias("h")).first().h, 6) == 1.521928


def test_trees_draw_from_all_rows(spark):
    rows = spark.range(20_000).selectExpr("id as timestamp_ms", "id as event_id", "array(double(id), double(id % 7)) as features")
    drawn = tree_samples(rows, 8, 64, 3).groupBy("tree_id").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).collect()
    assert len(drawn) == 8 and all(r.n == 64 and r.lo < 4_000 and r.hi > 16_000 for r in drawn)
    few = train_forest(rows.limit(5), trees=3, subsample=64)
    assert few.filter("node_id = 0 and rows = 5").count() == 3 and train_forest(rows.limit(0), trees=3).count() == 0


def test_a_batch_tried_again_is_stored_once(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as device_id", "id * 86400000 as timestamp_ms", "'r' as rule_name")
    for batch, times in ((0, 2), (1, 3)):
        for _ in range(times):
            write_table(rows, "security_events", str(tmp_path), batch=batch)
    back = spark.read.parquet(str(tmp_path / "security_events"))
    assert back.count() == 100 and {"batch", "date", "received_at"} <= set(back.columns)
    audit = rows.selectExpr("timestamp_ms", "'u' as username", "true as success")
    write_table(audit, "audit_log", str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "audit_log")).count() == 50
    incidents = rows.selectExpr("string(device_id) as incident_id", "timestamp_ms as first_seen_ms")
    write_table(incidents, "correlations_view", str(tmp_path))
    assert Hunt(spark, {"correlations_view": spark.read.parquet(str(tmp_path / "correlations_view"))}).search("correlations").run().count() == 50


def test_late_event_counts_what_lies_before_it(monkeypatch):
    import pandas as pd

    from watchloom.streaming.processors import ThresholdAlerts

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

    alerts = ThresholdAlerts({"c": (3, 100, 0)}, ["event_id"], ["timestamp_ms", "event_id"])
    alerts.state = Value()
    feed = lambda *ms: [r for f in alerts.handleInputRows(("k",), iter([pd.DataFrame({"category": "c", "timestamp_ms": ms, "event_id": ms})]), None) for r in f["event_id"]]
    assert feed(1_000, 1_050) == [] and feed(1_010) == [] and feed(1_060) == [1_060]


def test_equal_domain_entries_take_the_earlier_loaded(spark):
    """A feed that names a domain twice answers with the first entry, however its rows are dealt to tasks."""
    feed = spark.createDataFrame(
        [("domain", "bad.org", "high", "second", 7), ("domain", "bad.org", "low", "first", 2), ("domain", "org", "low", "wide", 1)],
        "type string, value string, severity string, feed_source string, load_order long",
    )
    names = spark.createDataFrame([("domain", "www.bad.org"), ("domain", "bad.org"), ("domain", "good.org"), ("domain", "org.net")], "type string, value string")
    for parts in (1, 3):
        got = {r.value: r.feed_source for r in match_domain(names, feed.repartition(parts)).collect()}
        assert got == {"www.bad.org": "first", "bad.org": "first", "good.org": "wide"}
