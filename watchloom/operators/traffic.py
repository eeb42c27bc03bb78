"""Traffic classifier: one row per detection, all in one projection.

Input is a telemetry row with its baselines (``ewma_baseline``) and its log
chunk. Every detector is an optional struct; the array of the present ones is
exploded and tagged, so the whole family costs one narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import compact, explode_once, fixed, held
from watchloom.functions.mitre import mitre_tag
from watchloom.functions.severity import z_confidence
from watchloom.functions.text import match_count

# Log signatures, matched case-insensitively.
SIGNATURES = {
    "syn_flood": r"syn flood|syncookies|possible syn flooding|tcp.*backlog",
    "conn_table_full": r"connection table full|nf_conntrack.*table full|too many open",
    "amplification": r"amplification|reflected.*attack|dns.*amplif|ntp.*monlist|ssdp.*reflect",
    "conn_refused": r"connection refused|refused connect|ECONNREFUSED",
    "conn_reset": r"connection reset by peer|RST|reset by [\d.]+",
    "scan_tool": r"nmap|masscan|zmap|port scan detected|portscan",
    "service_probe": r"service probe|banner grab|version detection|fingerprint",
    "cobalt_strike": r"cobalt\s*strike|beacon\.dll|cobaltstrike",
    "meterpreter": r"meterpreter|reverse.*shell|reverse_tcp|reverse_https",
    "beacon_pattern": r"callback.*interval|beacon.*sleep|heartbeat.*c2|check.in.*interval",
    "dns_txt_query": r"dns.*txt\s*query|type65|iodine|dnscat|dns2tcp",
    "internal_scan": r"scanning\s+(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.)|internal\s+scan|subnet\s+scan",
    "pass_the_hash": r"pass.the.hash|pth\s+attack|ntlm\s+relay|sekurlsa|mimikatz.*hash",
    "pass_the_ticket": r"pass.the.ticket|kerberos.*ticket.*export|golden\s+ticket|silver\s+ticket",
    "smb_lateral": r"smb.*lateral|admin\$|ipc\$.*lateral|psexec.*smb|smbexec",
    "rdp_lateral": r"rdp.*lateral|mstsc.*internal|remote desktop.*(10\.|172\.|192\.168)",
    "wmi_exec": r"wmi(c|exec)|win32_process.*create|wmiprvse.*spawn",
    "psexec": r"psexec|paexec|remcom|smbexec",
    "dns_tunnel": r"dns\s*tunnel|iodine|dnscat|dns2tcp|unusual\s+dns.*length|encoded.*subdomain",
    "credential_stuffing": r"credential\s*stuff|multiple\s+accounts?\s+failed|bulk\s+login\s+attempt",
    "password_spray": r"password\s*spray|single\s+password.*multiple\s+account|spray\s+attack",
}

# Texts of which one, in small letters, is in every match of the signature.
NEEDLES = {
    "syn_flood": ("syn", "backlog"),
    "conn_table_full": ("table full", "too many open"),
    "amplification": ("amplif", "reflect", "monlist"),
    "conn_refused": ("refused",),
    "conn_reset": ("reset by", "rst"),
    "scan_tool": ("map", "scan"),
    "service_probe": ("service probe", "banner grab", "version detection", "fingerprint"),
    "cobalt_strike": ("cobalt", "beacon.dll"),
    "meterpreter": ("meterpreter", "reverse"),
    "beacon_pattern": ("interval", "beacon", "heartbeat"),
    "dns_txt_query": ("dns", "type65", "iodine"),
    "internal_scan": ("scan",),
    "pass_the_hash": ("hash", "pth", "ntlm", "sekurlsa"),
    "pass_the_ticket": ("ticket",),
    "smb_lateral": ("smb", "admin$", "ipc$"),
    "rdp_lateral": ("rdp", "mstsc", "remote desktop"),
    "wmi_exec": ("wmi", "win32_process"),
    "psexec": ("exec", "remcom"),
    "dns_tunnel": ("dns", "iodine", "encoded"),
    "credential_stuffing": ("credential", "multiple", "bulk"),
    "password_spray": ("spray", "single"),
}

# Optional stricter reset signature: RST only as a word of its own.
WORD_BOUNDED_RESET = r"connection reset by peer|\bRST\b|reset by [\d.]+"


@dataclass(frozen=True)
class TrafficLimits:
    """Default limits of the detectors."""

    inbound_z: float = 3.0
    inbound_bytes: float = 100e6
    cpu_spike_z: float = 2.5
    refused_min: int = 10
    reset_min: int = 8
    auth_failures_min: int = 5
    spray_users: int = 3
    auth_z: float = 2.5
    outbound_z: float = 3.0
    outbound_bytes: float = 50e6
    ratio_z: float = 2.5
    beacon_jitter: float = 0.15
    beacon_samples: int = 10
    internal_scan_min: int = 5
    smb_min: int = 3
    reset_pattern: str = SIGNATURES["conn_reset"]


# Signatures that need one match.
# (signature, category, sub_type, severity, confidence, description)
ONE_MATCH = [
    ("syn_flood", "ddos", "ddos_syn_flood", "critical", 0.85, "SYN flood indicators detected in system logs"),
    ("conn_table_full", "ddos", "ddos_application_layer", "high", 0.75,
     "Connection table exhaustion -- possible application-layer DDoS"),
    ("amplification", "ddos", "ddos_amplification", "critical", 0.8,
     "Amplification/reflection attack indicators in logs"),
    ("scan_tool", "portscan", "portscan_sequential", "high", 0.9,
     "Port scanning tool signature detected (nmap/masscan/zmap)"),
    ("service_probe", "portscan", "portscan_service_enum", "medium", 0.7,
     "Service enumeration / banner grabbing detected"),
    ("dns_tunnel", "exfiltration", "exfil_dns_tunneling", "critical", 0.85,
     "DNS tunneling tool or pattern detected in logs"),
    ("cobalt_strike", "c2_beaconing", "c2_known_framework", "critical", 0.9,
     "Cobalt Strike beacon signature detected"),
    ("meterpreter", "c2_beaconing", "c2_known_framework", "critical", 0.9,
     "Meterpreter / reverse shell signature detected"),
    ("beacon_pattern", "c2_beaconing", "c2_http_beacon", "high", 0.7, "C2 beacon communication pattern in logs"),
    ("dns_txt_query", "c2_beaconing", "c2_dns_beacon", "high", 0.8,
     "DNS-based C2 channel indicators (TXT queries / tunneling tool)"),
    ("pass_the_hash", "lateral_movement", "lateral_pass_the_hash", "critical", 0.85,
     "Pass-the-Hash attack indicators (NTLM relay / mimikatz)"),
    ("pass_the_ticket", "lateral_movement", "lateral_pass_the_ticket", "critical", 0.85,
     "Pass-the-Ticket / Golden Ticket attack indicators"),
    ("rdp_lateral", "lateral_movement", "lateral_rdp", "medium", 0.6,
     "RDP connection to internal host detected"),
    ("wmi_exec", "lateral_movement", "lateral_wmi", "high", 0.75, "WMI remote execution detected"),
]


def _threat(category: str, sub_type: Column | str, severity: Column | str, confidence: Column | float,
            description: Column | str, evidence: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), lit(confidence).cast("double")))
    return F.struct(
        F.lit(category).alias("category"), lit(sub_type).alias("sub_type"), lit(severity).alias("severity"),
        bounded.alias("confidence"), lit(description).alias("description"),
        F.coalesce(evidence, F.lit("")).alias("evidence"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _may(name: str) -> Column:
    """Whether the text can match at all: a search for fixed texts is far cheaper than the pattern."""
    return reduce(lambda a, b: a | b, [F.col("_small").contains(n) for n in NEEDLES[name]])


def _count(text: str, name: str, pattern: str | None = None) -> Column:
    return F.when(_may(name), match_count(text, pattern or SIGNATURES[name])).otherwise(0)


def _with_small(rows: DataFrame, text: str) -> DataFrame:
    return held(rows, _small=F.lower(text))


def log_detectors(text: str = "raw_log", limits: TrafficLimits = TrafficLimits()) -> list[Column]:
    """Detectors that need only the log chunk (and, as ``_small``, the same in small letters)."""
    log = F.col(text)
    matched = lambda name: F.regexp_extract(log, f"(?i){SIGNATURES[name]}", 0)
    out = [
        F.when(F.coalesce(_may(name) & log.rlike(f"(?i){SIGNATURES[name]}"), F.lit(False)),
               _threat(category, sub, sev, conf, desc, matched(name)))
        for name, category, sub, sev, conf, desc in ONE_MATCH
    ]
    refused = _count(text, "conn_refused")
    out.append(F.when(refused >= limits.refused_min, _threat(
        "portscan", "portscan_sequential", "medium",
        F.least(F.lit(0.9), 0.5 + (refused - limits.refused_min) * 0.05),
        _text("High rate of refused connections (", refused, ") -- possible port scan"),
        _text("connection_refused_count=", refused))))
    known = limits.reset_pattern in (SIGNATURES["conn_reset"], WORD_BOUNDED_RESET)
    resets = _count(text, "conn_reset", limits.reset_pattern) if known else match_count(text, limits.reset_pattern)
    out.append(F.when(resets >= limits.reset_min, _threat(
        "portscan", "portscan_stealth", "medium",
        F.least(F.lit(0.85), 0.5 + (resets - limits.reset_min) * 0.05),
        _text("High RST rate (", resets, ") -- possible stealth scan"),
        _text("reset_count=", resets))))
    scans = _count(text, "internal_scan")
    out.append(F.when(scans >= limits.internal_scan_min, _threat(
        "lateral_movement", "lateral_internal_scan", "high",
        F.least(F.lit(0.9), 0.5 + scans * 0.08),
        _text("Internal subnet scanning detected (", scans, " indicators)"), matched("internal_scan"))))
    smb = _count(text, "smb_lateral") + _count(text, "psexec")
    out.append(F.when(smb >= limits.smb_min, _threat(
        "lateral_movement", "lateral_smb", "high", 0.75,
        "SMB-based lateral movement indicators (PsExec/admin shares)",
        F.concat_ws(" ", *[F.nullif(matched(n), F.lit("")) for n in ("smb_lateral", "psexec")]))))
    return out


def baseline_detectors(text: str = "raw_log", limits: TrafficLimits = TrafficLimits()) -> list[Column]:
    """Detectors on the adaptive baselines of ``ewma_baseline``."""
    c = F.col
    z_in, v_in = c("net_in_z"), c("net_in_delta").cast("double")
    in_abs = v_in >= limits.inbound_bytes
    conf = z_confidence(z_in)
    conf = F.when(in_abs, F.greatest(conf, F.lit(0.7))).otherwise(conf)
    conf = F.when(c("cpu_z") >= limits.cpu_spike_z, F.least(conf + 0.15, F.lit(0.95))).otherwise(conf)
    ddos = F.when(c("net_in_ready") & ((z_in >= limits.inbound_z) | in_abs), _threat(
        "ddos", "ddos_volumetric", F.when(conf >= 0.7, "critical").otherwise("high"), conf,
        "Anomalous inbound traffic volume -- possible volumetric DDoS",
        _text("inbound_delta=", fixed(v_in, 0), "B z=", fixed(z_in, 2), " mean=", fixed(c("net_in_mean"), 0),
              " cpu=", fixed(c("cpu_pct"), 1), "%")))

    z_out, v_out = c("net_out_z"), c("net_out_delta").cast("double")
    out_abs = v_out >= limits.outbound_bytes
    out_conf = z_confidence(z_out)
    out_conf = F.when(out_abs, F.greatest(out_conf, F.lit(0.65))).otherwise(out_conf)
    exfil = F.when(c("net_out_ready") & ((z_out >= limits.outbound_z) | out_abs), _threat(
        "exfiltration", "exfil_volume_anomaly", "high", out_conf,
        "Anomalous outbound data volume -- possible data exfiltration",
        _text("outbound_delta=", fixed(v_out, 0), "B z=", fixed(z_out, 2), " mean=", fixed(c("net_out_mean"), 0))))

    z_ratio = c("in_out_ratio_z")
    transfer = F.when(c("in_out_ratio_ready") & (z_ratio <= -limits.ratio_z), _threat(
        "exfiltration", "exfil_large_transfer", "medium", z_confidence(z_ratio),
        "Network in/out ratio anomaly -- outbound surge relative to inbound",
        _text("ratio_z=", fixed(z_ratio, 6))))

    fails, z_auth = c("auth_failures"), c("auth_failures_z")
    spray = (
        F.when(_count(text, "password_spray") > 0, "bruteforce_password_spray")
        .when(_count(text, "credential_stuffing") > 0, "bruteforce_credential_stuffing")
        .when(c("auth_users") >= limits.spray_users, "bruteforce_password_spray")
        .otherwise("bruteforce_standard")
    )
    brute = F.when(
        c("auth_failures_ready") & (z_auth >= limits.auth_z) & (fails >= limits.auth_failures_min),
        _threat(
            "bruteforce", spray,
            F.when(fails >= 2 * limits.auth_failures_min, "critical").otherwise("high"), z_confidence(z_auth),
            "Brute force attack detected -- auth failure rate anomaly",
            _text("auth_failures=", fails, " z=", fixed(z_auth, 2), " baseline_mean=",
                  fixed(c("auth_failures_mean"), 1))))
    brute_cold = F.when(~c("auth_failures_ready") & (fails >= limits.auth_failures_min), _threat(
        "bruteforce", "bruteforce_standard", "high", 0.6,
        _text("High auth failure count (", fails, ") -- possible brute force (baseline warming up)"),
        _text("auth_failures=", fails)))
    return [ddos, brute, brute_cold, exfil, transfer, beacon_detector(limits)]


def beacon_detector(limits: TrafficLimits = TrafficLimits(), prefix: str = "interval") -> Column:
    """Low-jitter periodic intervals; ``prefix`` names the tracked interval series."""
    c = F.col
    mean, sd = c(f"{prefix}_mean"), c(f"{prefix}_sd")
    cov = F.when(mean > 0, sd / mean)
    jitter = limits.beacon_jitter
    return F.when(
        c(f"{prefix}_ready") & (c(f"{prefix}_n") >= limits.beacon_samples) & (cov < jitter) & (cov > 0.001),
        _threat(
            "c2_beaconing", "c2_periodic_beacon", "high", 0.4 + (jitter - cov) / jitter * 0.4,
            "Periodic callback pattern detected -- low jitter interval (possible C2 beacon)",
            _text("interval_mean=", fixed(mean, 0), "ms stddev=", fixed(sd, 0), "ms CoV=", fixed(cov, 4))))


def classify(
    rows: DataFrame,
    detectors: list[Column],
    keep: tuple[str, ...] = ("device_id", "timestamp_ms", "machine_ip"),
) -> DataFrame:
    """Run detectors and tag the detections."""
    found = explode_once(rows, keep, compact(*detectors), "_t").select(*keep, "_t.*")
    return mitre_tag(found)


def classify_logs(rows: DataFrame, text: str = "raw_log", limits: TrafficLimits = TrafficLimits(),
                  keep: tuple[str, ...] = ("device_id", "timestamp_ms", "machine_ip")) -> DataFrame:
    return classify(_with_small(rows, text), log_detectors(text, limits), keep)


def classify_traffic(rows: DataFrame, text: str = "raw_log", limits: TrafficLimits = TrafficLimits(),
                     keep: tuple[str, ...] = ("device_id", "timestamp_ms", "machine_ip")) -> DataFrame:
    """The full classifier. A device's first report only seeds its baselines."""
    reports = rows.filter(F.col("seq") > 1)
    return classify(_with_small(reports, text), [*baseline_detectors(text, limits), *log_detectors(text, limits)], keep)
