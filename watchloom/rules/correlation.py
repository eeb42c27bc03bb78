"""Correlation rules: which stages, together within a window, make an incident."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    """Blank source, category or severity matches anything."""

    source: str = ""
    category: str = ""
    min_severity: str = ""


@dataclass(frozen=True)
class CorrelationRule:
    name: str
    description: str
    severity: str
    mitre_tactic: str
    mitre_technique: str
    window_seconds: int
    min_events: int
    cross_device: bool
    stages: tuple[Stage, ...]
    #: Whether the stages must come in order (several in one millisecond do).
    ordered: bool = False
    #: How many devices the matching events of the window must come from.
    min_devices: int = 0


# Fixed value: seconds between two incidents of one rule and scope.
INCIDENT_COOLDOWN_SEC = 300

# The default rules.
DEFAULT_CORRELATION_RULES = [
    CorrelationRule(
        "brute_force_then_login",
        "Brute force attack followed by successful authentication -- possible credential compromise",
        "critical", "Lateral Movement", "T1110", 600, 3, True,
        (Stage("traffic", "brute_force", "high"), Stage("session", "", "low")),
    ),
    CorrelationRule(
        "ioc_then_exfil",
        "Known threat indicator followed by data exfiltration pattern",
        "critical", "Exfiltration", "T1041", 900, 2, False,
        (Stage("ioc", "", "medium"), Stage("traffic", "data_exfiltration", "medium")),
    ),
    CorrelationRule(
        "fim_and_c2",
        "File system modification paired with C2 communication -- possible malware installation",
        "critical", "Command and Control", "T1071", 600, 2, False,
        (Stage("fim", "", "medium"), Stage("traffic", "c2_beacon", "medium")),
    ),
    CorrelationRule(
        "multi_device_campaign",
        "Multiple high-severity events across different devices -- possible coordinated attack",
        "critical", "Impact", "T1486", 300, 4, True,
        (Stage("", "", "high"), Stage("", "", "high")),
    ),
    CorrelationRule(
        "privesc_suspicious_proc",
        "Privilege escalation followed by suspicious process execution",
        "high", "Privilege Escalation", "T1078", 300, 2, False,
        (Stage("session", "priv_escalation", "medium"), Stage("process", "suspicious", "medium")),
    ),
    CorrelationRule(
        "scan_then_exploit",
        "Network reconnaissance followed by exploitation attempt",
        "high", "Initial Access", "T1190", 600, 2, True,
        (Stage("traffic", "port_scan", "medium"), Stage("traffic", "exploit_attempt", "medium")),
    ),
    CorrelationRule(
        "dns_tunnel_exfil",
        "DNS tunneling activity paired with data exfiltration",
        "critical", "Exfiltration", "T1048.001", 900, 2, False,
        (Stage("network_inspector", "dns_tunnel", "medium"), Stage("traffic", "data_exfiltration", "medium")),
    ),
]

# Classifier category -> the name rules and playbooks use.
CATEGORY_ALIASES = {
    "bruteforce": "brute_force",
    "c2_beaconing": "c2_beacon",
    "portscan": "port_scan",
    "exfiltration": "data_exfiltration",
}
