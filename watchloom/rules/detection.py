"""Line-matching detection rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionRule:
    name: str
    severity: str
    category: str
    pattern: str


# The built-in rules (name, severity, category, pattern).
# Patterns are matched case-insensitively anywhere in a line.
BUILTIN_RULES = [
    DetectionRule("ssh_failed_password", "high", "auth_failure", r"failed password for\s+\S+\s+from\s+[\d.]+"),
    DetectionRule("pam_auth_failure", "high", "auth_failure", r"pam_unix\(.*\):\s*authentication failure"),
    DetectionRule("sshd_invalid_user", "high", "auth_failure", r"invalid user\s+\S+\s+from\s+[\d.]+"),
    DetectionRule("win_logon_failure_4625", "high", "auth_failure", r"(<EventID>4625</EventID>|event\s*id[:\s]*4625)"),
    DetectionRule("win_logon_failure_generic", "medium", "auth_failure", r"audit failure.*logon"),
    DetectionRule("su_failed", "high", "auth_failure", r"su\[.*\]:\s*failed su for\s+\S+"),
    DetectionRule("sudo_failed", "critical", "privilege_escalation", r"sudo:.*NOT in sudoers"),
    DetectionRule("sudo_session_open", "low", "privilege_escalation", r"sudo:.*session opened for user root"),
    DetectionRule("win_priv_escalation_4672", "medium", "privilege_escalation", r"(<EventID>4672</EventID>|event\s*id[:\s]*4672)"),
    DetectionRule("service_start_failed", "medium", "service_failure", r"systemd\[.*\]:\s*\S+\.service.*failed"),
    DetectionRule("oom_killer", "critical", "resource_exhaustion", r"out of memory:?\s*kill process"),
    DetectionRule("segfault", "high", "crash", r"segfault at\s+[0-9a-fA-F]+"),
    DetectionRule("sshd_max_auth_exceeded", "critical", "brute_force", r"error:\s*maximum authentication attempts exceeded"),
    DetectionRule("sshd_connection_reset", "medium", "brute_force", r"connection (reset|closed) by\s+[\d.]+.*\[preauth\]"),
    DetectionRule("win_account_locked_4740", "high", "account_lockout", r"(<EventID>4740</EventID>|event\s*id[:\s]*4740)"),
    DetectionRule("win_password_changed_4723", "low", "account_change", r"(<EventID>4723</EventID>|event\s*id[:\s]*4723)"),
    DetectionRule("iptables_drop", "medium", "firewall", r"iptables.*DROP"),
    DetectionRule("ufw_block", "medium", "firewall", r"\[UFW BLOCK\]"),
]


@dataclass(frozen=True)
class Threshold:
    category: str
    count: int
    window_sec: int
    cooldown_sec: int


# Alert thresholds (category, events, window s, cooldown s).
DEFAULT_THRESHOLDS = [
    Threshold("auth_failure", 5, 300, 600),
    Threshold("brute_force", 3, 60, 300),
    Threshold("privilege_escalation", 2, 120, 600),
    Threshold("account_lockout", 1, 60, 900),
    Threshold("resource_exhaustion", 1, 60, 600),
    Threshold("crash", 2, 300, 600),
]
