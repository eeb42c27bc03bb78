"""Hand-written rows at the boundaries of each rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from watchloom.functions.network import cidr_bounds, ipv4_long
from watchloom.functions.severity import z_confidence, z_severity
from watchloom.operators.anomaly import beacon_score, score_forest, train_forest
from watchloom.operators.correlate import correlate
from watchloom.operators.diffs import fim_alerts, fim_diff, tamper_check
from watchloom.operators.hunt import Hunt
from watchloom.operators.intel import match_cidr, match_domain, match_indicators
from watchloom.operators.respond import blocklist, plan_actions
from watchloom.operators.rule_scan import scan_rules
from watchloom.operators.sigma import Match, SigmaRule, sigma_match
from watchloom.operators.telemetry import Metric, ewma_baseline, telemetry_features
from watchloom.rules.detection import DetectionRule
from watchloom.sources.feeds import load_ioc_feeds, load_rules
from watchloom.sources.files import fim_snapshot
from watchloom.sources.telemetry import read_telemetry
from watchloom.sinks.tables import write_table, write_telemetry_csv
from watchloom.sinks.formats import format_cef, write_lines


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_z_tiers(spark):
    assert [_one(spark, z_severity(F.lit(z))) for z in (1.99, 2.0, -2.5, 3.0)] == ["", "medium", "high", "critical"]
    assert [round(_one(spark, z_confidence(F.lit(z))), 6) for z in (1.99, 2.0, 3.0, 9.0)] == [0.0, 0.3, 0.9, 0.95]


@pytest.mark.parametrize("text,want", [
    ("10.0.0.0/8", (8, 167772160, 184549375)), ("1.2.3.4", (32, 16909060, 16909060)), ("1.2.3.4/x", (32, 16909060, 16909060)),
    ("1.2.3.4/40", (32, 16909060, 16909060)), ("1.2.3.4/0", (0, 0, 4294967295)),
])
def test_cidr(spark, text, want):
    assert tuple(_one(spark, cidr_bounds(F.lit(text)))) == want


def test_ipv4(spark):
    assert [_one(spark, ipv4_long(F.lit(x))) for x in ("0.0.0.1", "1.2.3", "a.b.c.d")] == [1, 0, 0]


def _feed(spark, rows):
    return spark.createDataFrame(rows, "type string, value string, severity string, feed_source string, load_order int")


def test_exact_beats_range_and_order_decides(spark):
    feed = _feed(spark, [("cidr", "10.1.0.0/16", "low", "b", 2), ("cidr", "10.0.0.0/8", "high", "a", 1), ("ip", "10.1.1.1", "critical", "c", 0)])
    found = spark.createDataFrame([("ip", "10.1.1.1"), ("ip", "10.1.1.2"), ("ip", "11.0.0.1")], "type string, value string")
    assert [(r.value, r.ioc_value) for r in match_cidr(found, feed).collect()] == [("10.1.1.2", "10.0.0.0/8")]
    assert {(r.value, r.ioc_value) for r in match_indicators(found, feed).collect()} == {("10.1.1.1", "10.1.1.1"), ("10.1.1.2", "10.0.0.0/8")}


def test_domain_suffix_needs_a_dot(spark):
    feed = _feed(spark, [("domain", "evil.com", "high", "a", 0), ("domain", "deep.evil.com", "high", "a", 1)])
    names = spark.createDataFrame([("domain", n) for n in ("evil.com", "sub.evil.com", "notevil.com", "x.deep.evil.com")], "type string, value string")
    got = {(r.value, r.ioc_value) for r in match_domain(names, feed).collect()}
    assert got == {("evil.com", "evil.com"), ("sub.evil.com", "evil.com"), ("x.deep.evil.com", "deep.evil.com")}
    assert got == {(r.value, r.ioc_value) for r in match_indicators(names, feed).collect()}


def test_baseline_warm_up_and_constant_series(spark):
    rows = [(1, i, 1e9) for i in range(1, 31)] + [(2, i, 100.0 if i == 20 else float(i % 2)) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "device_id long, seq long, v double")
    out = {(r.device_id, r.seq): r for r in ewma_baseline(df, [Metric("v", F.col("v"), skip=0)]).collect()}
    assert out[1, 30].v_z == 0.0 and out[1, 30].v_sd == 0.0 and out[1, 30].v_mean == 1e9
    assert not out[2, 19].v_ready and out[2, 19].v_z == 0.0
    assert out[2, 20].v_ready and 4 < out[2, 20].v_z < 4.36


def test_baseline_equals_recurrence_beyond_one_block(spark):
    xs = [(i * 7919 % 1000) + (5000 if i % 500 == 0 else 0) for i in range(1, 2001)]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs, 1)], "device_id long, seq long, v double")
    got = {r.seq: (r.v_mean, r.v_sd) for r in ewma_baseline(df, [Metric("v", F.col("v"), skip=0)]).collect()}
    mean, var = float(xs[0]), 0.0
    for i, x in enumerate(xs[1:], 2):
        d = x - mean
        mean, var = mean + 0.05 * d, 0.95 * (var + 0.05 * d * d)
        assert abs(got[i][0] - mean) < 1e-9 * max(1, mean) and abs(got[i][1] - var ** 0.5) < 1e-8 * var ** 0.5


def test_first_report_and_counter_wrap(spark):
    cols = "device_id long, timestamp_ms long, cpu_user_ticks long, cpu_kernel_ticks long, cpu_idle_ticks long, net_bytes_in long, net_bytes_out long, ram_total_bytes long, ram_avail_bytes long, disk_total_bytes long, disk_free_bytes long"
    rows = [(1, 0, 0, 0, 0, 100, 100, 10, 5, 10, 1), (1, 10, 30, 0, 10, 50, 150, 10, 5, 10, 1), (1, 20, 30, 0, 10, 60, 150, 0, 0, 0, 0)]
    a, b, c = telemetry_features(spark.createDataFrame(rows, cols)).orderBy("seq").collect()
    assert (a.cpu_pct, a.net_in_delta, a.interval_ms, a.ram_pct) == (0.0, None, None, 50.0)
    assert (b.cpu_pct, b.net_in_delta, b.net_out_delta, b.interval_ms) == (75.0, 0, 50, 10)
    assert (c.cpu_pct, c.ram_pct, c.disk_free_pct) == (0.0, 0.0, 0.0)


def test_large_rule_sets_find_the_same(spark, folder):
    text = spark.createDataFrame([(1, "alpha 7\r\n\nbeta 399 x\ngamma")], "id long, raw_log string")
    rules = [DetectionRule(f"r{i}", "low", "c", rf"\b(alpha|beta) {i}\b") for i in range(450)]
    got = {(r.rule_name, r.matched_text, r.line_no) for r in scan_rules(text, rules).collect()}
    assert got == {("r7", "alpha 7", 0), ("r399", "beta 399 x", 1)}


def test_size_only_change_is_no_change(spark):
    row = lambda *r: spark.createDataFrame([r], "device_id long, path string, sha256 string, size_bytes long, mtime_epoch long")
    assert fim_diff(row(1, "/a", "h", 1, 1), row(1, "/a", "h", 2, 2)).count() == 0


def test_diff_of_itself_is_empty_and_inverts(spark, folder):
    from watchloom.plans.views import view
    a, b = view(spark, folder, "snap_a"), view(spark, folder, "snap_b")
    assert fim_diff(a, a).count() == 0
    swap = {"added": "deleted", "deleted": "added", "modified": "modified"}
    forth = {(r.device_id, r.path, r.change_type) for r in fim_diff(a, b).collect()}
    back = {(r.device_id, r.path, swap[r.change_type]) for r in fim_diff(b, a).collect()}
    assert forth == back


def test_first_snapshot_is_a_baseline(spark):
    rows = [(1, 10, "/etc/passwd", "a", 1), (2, 10, "/x", "a", 1), (2, 20, "/y", "b", 2)]
    df = spark.createDataFrame(rows, "device_id long, timestamp_ms long, path string, sha256 string, size_bytes long")
    got = {(r.device_id, r.timestamp_ms, r.path, r.change_type) for r in fim_alerts(df).collect()}
    assert got == {(2, 20, "/x", "deleted"), (2, 20, "/y", "added")}


def test_tamper_check_without_baseline(spark):
    make = lambda rows: spark.createDataFrame(rows, "device_id long, path string, sha256 string")
    got = {(r.device_id, r.status) for r in tamper_check(make([(1, "/a", "h"), (1, "/b", "h")]), make([(1, "/a", "x"), (3, "/a", "x")])).collect()}
    assert got == {(1, "CHANGED"), (1, "MISSING"), (3, "NOT_INITIALIZED")}


def test_sigma_conditions(spark):
    events = spark.createDataFrame([(1, 0, "process", "x", "ip", {"Image": "/bin/SH"}), (2, 0, "dns", "x", "ip", {})],
                                   "device_id long, timestamp_ms long, source string, category string, machine_ip string, fields map<string,string>")
    rule = lambda cond, **kw: SigmaRule("r", "t", {"a": [Match("Image", ("sh",), "endswith", **kw)], "b": [Match("Nope", ("zz",))]}, cond)
    hits = lambda r: [x.device_id for x in sigma_match(events, [r]).orderBy("device_id").collect()]
    assert hits(rule(lambda s: s["a"])) == [1]
    assert hits(rule(lambda s: s["a"], cased=True)) == []
    assert hits(rule(lambda s: ~(s["a"] | s["b"]))) == [2]
    assert hits(rule(lambda s: s.all_of("none*"))) == []
    assert hits(SigmaRule("r", "t", {"a": [Match("Image", ("",), "contains")]}, category="process_creation")) == [1]


def _corr(spark, rows):
    return spark.createDataFrame(rows, "device_id long, timestamp_ms long, source string, category string, severity string")


def test_stages_must_meet_on_one_device(spark):
    ioc, out = ("ioc", "ioc_match", "high"), ("traffic", "data_exfiltration", "high")
    got = correlate(_corr(spark, [(1, 0, *ioc), (1, 900_000, *out), (2, 0, *ioc), (3, 0, *out), (4, 0, *ioc), (4, 900_001, *out)]))
    assert [(r.rule_name, r.scope, r.event_count, round(r.confidence, 6)) for r in got.filter("scope <> 'global'").collect()] == [("ioc_then_exfil", "1", 2, 0.7)]


def test_equal_stages_count_an_event_twice_and_cooldown_edges(spark):
    rows = [(d, t, "x", "y", "critical") for t in (0, 1000, 299_999, 301_000) for d in (1,)]
    got = correlate(_corr(spark, rows)).orderBy("first_seen_ms").collect()
    assert [(r.first_seen_ms, r.event_count, r.confidence) for r in got] == [(1000, 4, 0.9), (301_000, 6, 1.0)]


def test_block_expiry(spark):
    cols = "event_id long, device_id long, timestamp_ms long, machine_ip string, source string, category string, severity string, description string, ioc_value string"
    inc = spark.createDataFrame([(1, 1, 1000, "1.1.1.1", "s", "c", "critical", "d", ""), (2, 2, 1000, "2.2.2.2", "s", "c", "low", "d", "")], cols)
    actions = plan_actions(inc)
    assert sorted({r.playbook for r in actions.collect()}) == ["critical_response", "general_log"]
    assert [r.active for r in blocklist(actions, 3_601_000).collect()] == [True]
    assert [r.active for r in blocklist(actions, 3_601_001).collect()] == [False]


@pytest.mark.parametrize("values,found", [
    ([60_000 + 500 * i for i in range(12)], True), ([60_000 + 500 * i for i in range(11)], False),
    ([60_000] * 20, False), ([60_000, 61_000] * 10, False),
])
def test_beacon(spark, values, found):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "device_id long, event_id long, interval_ms long")
    assert (beacon_score(df, order=["event_id"], segment=5).filter(F.col("samples") == len(values)).count() > 0) == found


def test_forest_does_not_depend_on_partitions(spark):
    rows = spark.range(600).select(
        F.lit(1).alias("device_id"), F.col("id").alias("timestamp_ms"), F.col("id").alias("event_id"),
        F.array(*[F.when(F.col("id") == 599, 1e4).otherwise(F.pmod(F.hash("id", F.lit(i)), F.lit(100)).cast("double")) for i in range(7)]).alias("features"))
    one = score_forest(rows.coalesce(1), train_forest(rows.coalesce(1), trees=16))
    two = score_forest(rows.repartition(7), train_forest(rows.repartition(7), trees=16))
    a, b = ({r.event_id: r.score for r in x.collect()} for x in (one, two))
    assert a == b and max(a, key=a.get) == 599 and 0 < min(a.values()) and max(a.values()) <= 1


def test_hunt_rejects_unknown_names(spark):
    with pytest.raises(ValueError, match="no source is called"):
        Hunt(spark).search("nothing")
    with pytest.raises(ValueError, match="has no field"):
        Hunt(spark).search("ioc").sort("confidence")


def test_rule_file_overrides(spark, tmp_path):
    (tmp_path / "rules.conf").write_text("# c\n segfault | low | crash | a|b \nnew|high|x|p\nbad|none|x|p\nnew|low|x|q\n")
    rules = {r["name"]: r for r in load_rules(spark, str(tmp_path / "rules.conf")).collect()}
    assert len(rules) == 19 and rules["segfault"].pattern == "a|b" and rules["new"].pattern == "q" and not rules["new"].is_builtin


def test_feeds_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text("ip|1.1.1.1\nfqdn|EVIL.com|low|d|T1|a,b # note\n\n# c\ncidr|10.0.0.0/8\n")
    (tmp_path / "two.CSV").write_text("ip|1.1.1.1|critical\nonly\n")
    (tmp_path / "three.txt").write_text("ip|9.9.9.9\n")
    got = {(r.type, r.value, r.severity, r.feed_source) for r in load_ioc_feeds(spark, str(tmp_path)).collect()}
    assert got == {("ip", "1.1.1.1", "critical", "two"), ("domain", "evil.com", "low", "one"), ("cidr", "10.0.0.0/8", "high", "one")}


def test_file_snapshot(spark, tmp_path):
    for name, text in {"a/x.txt": "abc", "a/skip.log": "abc", ".hidden/y": "z", "a/big": "0123456789"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = fim_snapshot(spark, str(tmp_path), exclude_ext=[".log"], max_size=5).collect()
    assert [(r.path, r.sha256[:8], r.size_bytes, r.status) for r in rows] == [(str(tmp_path / "a/x.txt"), "ba7816bf", 3, "hashed")]
    rows = fim_snapshot(spark, str(tmp_path), exclude_ext=[".log"], hashable=5).collect()
    assert {(r.size_bytes, r.sha256 is None, r.status) for r in rows} == {(3, False, "hashed"), (10, True, "too_large")}


def test_tables_and_text_sinks(spark, folder, tmp_path):
    from watchloom.plans.views import view
    events = scan_rules(view(spark, folder, "sec_log"))
    write_table(events, "security_events", str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "security_events"))
    assert back.count() == events.count() and back.exceptAll(back.filter("matched_text is not null")).isEmpty()
    rows = view(spark, folder, "det").withColumn("sub_type", F.lit("s"))
    write_lines(format_cef(rows), str(tmp_path / "cef"))
    assert spark.read.text(str(tmp_path / "cef")).count() == rows.count()
    features = telemetry_features(view(spark, folder, "tel"), "event_id").withColumn("auth_failures", F.lit(2))
    write_telemetry_csv(features, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv")).count() == features.count()
    view(spark, folder, "tel").write.parquet(str(tmp_path / "tel"))
    assert read_telemetry(spark, str(tmp_path / "tel")).count() == features.count()
    assert read_telemetry(spark, str(tmp_path / "tel"), stream=True).isStreaming
