"""MITRE ATT&CK techniques per detection sub-type (https://attack.mitre.org)."""

# sub_type -> (technique id, technique name, tactic).
TECHNIQUES = {
    "ddos_volumetric": ("T1498", "Network Denial of Service", "Impact"),
    "ddos_syn_flood": ("T1498.001", "Network Denial of Service: Direct Network Flood", "Impact"),
    "ddos_amplification": ("T1498.002", "Network Denial of Service: Reflection Amplification", "Impact"),
    "ddos_application_layer": ("T1499", "Endpoint Denial of Service", "Impact"),
    "portscan_sequential": ("T1046", "Network Service Scanning", "Discovery"),
    "portscan_stealth": ("T1046", "Network Service Scanning", "Discovery"),
    "portscan_service_enum": ("T1046", "Network Service Scanning", "Discovery"),
    "portscan_os_fingerprint": ("T1592.004", "Gather Victim Host Information: Client Configurations", "Reconnaissance"),
    "bruteforce_standard": ("T1110.001", "Brute Force: Password Guessing", "Credential Access"),
    "bruteforce_credential_stuffing": ("T1110.004", "Brute Force: Credential Stuffing", "Credential Access"),
    "bruteforce_password_spray": ("T1110.003", "Brute Force: Password Spraying", "Credential Access"),
    "exfil_volume_anomaly": ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration"),
    "exfil_dns_tunneling": (
        "T1048.001",
        "Exfiltration Over Alternative Protocol: Exfiltration Over Symmetric Encrypted Non-C2 Protocol",
        "Exfiltration",
    ),
    "exfil_large_transfer": ("T1030", "Data Transfer Size Limits", "Exfiltration"),
    "exfil_unusual_dest": ("T1567", "Exfiltration Over Web Service", "Exfiltration"),
    "c2_periodic_beacon": ("T1071", "Application Layer Protocol", "Command and Control"),
    "c2_dns_beacon": ("T1071.004", "Application Layer Protocol: DNS", "Command and Control"),
    "c2_http_beacon": ("T1071.001", "Application Layer Protocol: Web Protocols", "Command and Control"),
    "c2_known_framework": ("T1219", "Remote Access Software", "Command and Control"),
    "c2_encrypted_channel": ("T1573", "Encrypted Channel", "Command and Control"),
    "lateral_internal_scan": ("T1018", "Remote System Discovery", "Discovery"),
    "lateral_pass_the_hash": ("T1550.002", "Use Alternate Authentication Material: Pass the Hash", "Lateral Movement"),
    "lateral_pass_the_ticket": ("T1550.003", "Use Alternate Authentication Material: Pass the Ticket", "Lateral Movement"),
    "lateral_rdp": ("T1021.001", "Remote Services: Remote Desktop Protocol", "Lateral Movement"),
    "lateral_smb": ("T1021.002", "Remote Services: SMB/Windows Admin Shares", "Lateral Movement"),
    "lateral_ssh": ("T1021.004", "Remote Services: SSH", "Lateral Movement"),
    "lateral_wmi": ("T1047", "Windows Management Instrumentation", "Execution"),
}

# What an unknown sub_type maps to.
UNKNOWN_TECHNIQUE = ("N/A", "Unknown Technique", "Unknown")


def technique_url(technique_id: str) -> str:
    """Page of a technique; sub-techniques are path segments."""
    return f"https://attack.mitre.org/techniques/{technique_id.replace('.', '/')}/"
