"""Work per task and per row stays bounded as tables grow."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from watchloom import session
from watchloom.operators.traffic import NEEDLES, SIGNATURES, WORD_BOUNDED_RESET, classify_logs


def test_a_long_row_group_among_many_splits_is_spread(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": list(range(600_000)), "s": [str(i * 7919) for i in range(600_000)]}), path, row_group_size=600_000)
    for key, value in (("spark.sql.files.maxPartitionBytes", "100k"), ("spark.sql.files.openCostInBytes", "1k")):
        spark.conf.set(key, value)
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 8
        parts = session.spread(df).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == 600_000 and max(r["count"] for r in parts) <= 80_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# A match of each alternative of each signature.
MATCHES = {
    "syn_flood": ["SYN flood", "syncookies", "possible SYN flooding", "TCP: out of backlog"],
    "conn_table_full": ["connection table full", "nf_conntrack: table full", "Too many open"],
    "amplification": ["Amplification", "reflected big attack", "DNS amplif", "ntp monlist", "ssdp reflect"],
    "conn_refused": ["connection refused", "refused connect", "ECONNREFUSED"],
    "conn_reset": ["connection reset by peer", "RST", "reset by 1.2"],
    "scan_tool": ["nmap", "masscan", "zmap", "port scan detected", "portscan"],
    "service_probe": ["service probe", "banner grab", "version detection", "fingerprint"],
    "cobalt_strike": ["Cobalt  Strike", "beacon.dll", "cobaltstrike"],
    "meterpreter": ["meterpreter", "reverse tcp shell", "reverse_tcp", "reverse_https"],
    "beacon_pattern": ["callback at interval", "beacon did sleep", "heartbeat to c2", "check-in at interval"],
    "dns_txt_query": ["dns for txt query", "type65", "iodine", "dnscat", "dns2tcp"],
    "internal_scan": ["scanning 10.", "scanning 172.16.", "scanning 192.168.", "internal scan", "subnet  scan"],
    "pass_the_hash": ["pass-the-hash", "pth attack", "ntlm relay", "sekurlsa", "mimikatz hash"],
    "pass_the_ticket": ["pass.the.ticket", "kerberos ticket export", "golden ticket", "silver ticket"],
    "smb_lateral": ["smb lateral", "ADMIN$", "ipc$ lateral", "psexec smb", "smbexec"],
    "rdp_lateral": ["rdp lateral", "mstsc internal", "remote desktop 10."],
    "wmi_exec": ["wmic", "wmiexec", "win32_process create", "wmiprvse spawn"],
    "psexec": ["psexec", "paexec", "remcom", "smbexec"],
    "dns_tunnel": ["dns tunnel", "iodine", "dnscat", "dns2tcp", "unusual dns length", "encoded subdomain"],
    "credential_stuffing": ["credential stuff", "multiple account failed", "bulk login attempt"],
    "password_spray": ["password spray", "single password multiple account", "spray attack"],
}


def _alternatives(pattern):
    depth, at, out = 0, 0, []
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


@pytest.mark.parametrize("name", SIGNATURES)
def test_every_alternative_holds_a_needle(name):
    alternatives = [*_alternatives(SIGNATURES[name]), *(_alternatives(WORD_BOUNDED_RESET) if name == "conn_reset" else [])]
    for a in alternatives:
        found = [m.group(0) for text in MATCHES[name] for t in (text, text.upper()) if (m := re.fullmatch(a, t, re.I))]
        assert found, a
        assert all(any(n in f.lower() for n in NEEDLES[name]) for f in found), a


def test_patterns_are_tried_only_on_texts_with_a_needle(spark):
    logs = spark.createDataFrame([(1, 0, "ip", "PSEXEC x; Admin$ y; psexec"), (2, 0, "ip", None), (3, 0, "ip", "quiet")],
                                 "device_id long, timestamp_ms long, machine_ip string, raw_log string")
    found = classify_logs(logs)
    assert [(r.device_id, r.sub_type, r.evidence) for r in found.collect()] == [(1, "lateral_smb", "Admin$ PSEXEC")]
    assert "Contains(_small" in found._jdf.queryExecution().optimizedPlan().toString()


def test_entropy_of_characters_counts_code_points(spark, monkeypatch):
    from collections import Counter
    from math import log2

    from watchloom.functions import text

    texts = ["", None, "aab", "a\nbéé", "\U0001f600\U0001f600x中", "\x00\x00z", "abc" * 5000, "".join(map(chr, range(300, 3000)))]
    bits = lambda t: None if t is None else -sum(n / len(t) * log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    shown = df.select("i", text.shannon_entropy("s").alias("h"))
    # One table of counts per batch, no interpreted fold over the characters.
    assert "aggregate(" not in shown._jdf.queryExecution().optimizedPlan().toString()
    assert [r.h for r in shown.orderBy("i").collect()] == [None if t is None else pytest.approx(bits(t)) for t in texts]
    monkeypatch.setattr(text, "COUNTS", 5)
    got = text._char_entropies([t if t is None else t.encode() for t in texts])
    assert [float(g) for g in got if g == g] == pytest.approx([bits(t) for t in texts if t is not None])


def test_feed_lines_are_split_once(spark):
    from watchloom.sources.feeds import parse_feed_lines

    lines = spark.createDataFrame(
        [("f", 1, "IPv4|1.2.3.4| |d|T1|a,b # tail"), ("f", 2, " FQDN |Bad.example|low"), ("f", 3, "# note"), ("f", 4, "odd|"), ("f", 5, None), ("f", 6, "odd|x")],
        "feed_source string, line_no int, line string")
    feed = parse_feed_lines(lines)
    assert [tuple(r) for r in feed.orderBy("line_no").collect()] == [
        ("ip", "1.2.3.4", "high", "f", "d", "T1", "a,b", 1), ("domain", "bad.example", "low", "f", "", "", "", 2), ("ip", "x", "high", "f", "", "", "", 6)]
    assert feed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_rows_digest_is_computed_once_for_all_trees(spark):
    from watchloom.operators.anomaly import tree_samples

    rows = spark.range(2_000).selectExpr("id as timestamp_ms", "id as event_id", "array(double(id)) as features")
    drawn = tree_samples(rows, 8, 64, 3)
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert drawn.groupBy("tree_id").count().filter("count = 64").count() == 8


def test_leaves_keep_rows_of_unequal_depths():
    import numpy as np

    from watchloom.operators.anomaly import _path_lengths, average_path

    # Root 0 with leaf 1 (4 rows) and node 2 with leaves 3 (1 row) and 4 (9 rows).
    tree = {"left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]), "rows": np.array([14, 4, 10, 1, 9]),
            "intercept": np.array([0.0, 0, 5, 0, 0]), "normal": np.array([[1.0], [0], [1], [0], [0]])}
    x = np.array([[-1.0], [2], [7], [np.nan]])
    assert _path_lengths(x, tree).tolist() == [1 + average_path(4), 2 + average_path(1), 2 + average_path(9), 2 + average_path(9)]
    leaf = {k: v[1:2] for k, v in tree.items()}
    assert _path_lengths(x, leaf).tolist() == [float(average_path(4))] * 4


def test_segments_stay_in_arrow_and_carry_only_what_they_need(spark):
    from watchloom.operators.cooldown import cooldown

    df = spark.range(3_000).selectExpr("if(id % 3 = 0, null, id % 3) as k", "id * 10 as timestamp_ms", "id as event_id")
    kept = cooldown(df, ["k"], 1, fold_rows=0, segment_rows=200)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and plan.count("FlatMapGroupsInPandas") == 1
    # Each key has an event every 30 ms, so the next one after a second is 34 events on.
    got = kept.groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {None: 30, 1: 30, 2: 30}


def test_an_items_rows_are_sorted_by_a_number_first(spark):
    from watchloom.operators.snapshots import CONNECTIONS, snapshot_changes

    row = lambda ms, port, state: (1, ms, "tcp", "a", 1, None, port, state)
    rows = spark.createDataFrame([row(1, 80, "x"), row(2, 80, "x"), row(2, 81, "y"), row(2, 81, "z")], "device_id long, timestamp_ms long, "
                                 "protocol string, local_addr string, local_port int, remote_addr string, remote_port int, state string")
    changes = snapshot_changes(rows, CONNECTIONS)
    assert [(r.timestamp_ms, r.remote_port, r.change, r.new_state) for r in changes.collect()] == [(2, 81, "added", "z")]
    assert "Sort [_item#" in changes._jdf.queryExecution().executedPlan().toString()
