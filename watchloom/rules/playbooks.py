"""Response playbooks: which incidents trigger which actions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Action:
    type: str
    target: str = ""
    params: str = ""
    duration_s: int = 0


@dataclass(frozen=True)
class Playbook:
    """Blank source or category matches anything."""

    name: str
    actions: tuple[Action, ...]
    source: str = ""
    category: str = ""
    min_severity: str = ""
    cooldown_seconds: int = 300
    enabled: bool = True


# The seven action types.
ACTION_TYPES = ["log", "block_ip", "quarantine", "webhook", "script", "rate_limit", "disable_user"]

# The default playbooks.
DEFAULT_PLAYBOOKS = [
    Playbook("critical_response", (Action("log"), Action("block_ip", duration_s=3600), Action("quarantine")),
             min_severity="critical", cooldown_seconds=600),
    Playbook("brute_force_block", (Action("log"), Action("block_ip", duration_s=1800)),
             category="brute_force", min_severity="high", cooldown_seconds=300),
    Playbook("c2_containment", (Action("log"), Action("block_ip", duration_s=7200), Action("quarantine")),
             category="c2_beacon", min_severity="high", cooldown_seconds=600),
    Playbook("exfil_throttle", (Action("log"), Action("rate_limit", duration_s=1800)),
             category="data_exfiltration", min_severity="high", cooldown_seconds=300),
    Playbook("ioc_critical_block", (Action("log"), Action("block_ip", duration_s=86400)),
             source="threat_intel", min_severity="critical", cooldown_seconds=600),
    Playbook("fim_critical_quarantine", (Action("log"), Action("quarantine")),
             source="fim", min_severity="critical", cooldown_seconds=600),
    Playbook("general_log", (Action("log"),), min_severity="medium", cooldown_seconds=60),
]
