"""Short fixed lists the detectors compare against."""

# Process names that are flagged, in order of precedence.
SUSPICIOUS_PROCESS_NAMES = [
    "mimikatz", "lazagne", "procdump", "psexec", "nc.exe", "ncat", "netcat", "nmap",
    "powershell_ise", "wscript", "cscript", "mshta", "certutil", "bitsadmin", "regsvr32", "rundll32",
    "whoami", "systeminfo", "tasklist", "net.exe", "cryptominer", "xmrig", "minerd", "cgminer",
]

# Remote ports of common reverse shells, IRC and alternative HTTPS.
SUSPICIOUS_REMOTE_PORTS = [4444, 5555, 6666, 7777, 8888, 9999, 1337, 31337, 6667, 6697, 4443, 8443]

# Path patterns whose changes are critical or high.
CRITICAL_PATHS = [
    r"/etc/passwd", r"/etc/shadow", r"/etc/sudoers", r"/etc/ssh/sshd_config", r"/etc/pam\.d/",
    r"/boot/", r"/usr/sbin/", r"/etc/crontab", r"/etc/cron\.d/",
    r"system32\\config\\", r"system32\\drivers\\", r"\\windows\\system32\\", r"\\windows\\syswow64\\",
    r"\\boot\\bcd", r"boot\.ini",
]
HIGH_PATHS = [
    r"/etc/nginx/", r"/etc/apache2/", r"/etc/httpd/", r"/etc/systemd/", r"/usr/lib/systemd/",
    r"/var/www/", r"/opt/", r"/etc/hosts", r"/etc/resolv\.conf",
    r"\\inetpub\\", r"\\program files\\", r"\\programdata\\", r"\\users\\.*\\appdata\\roaming\\",
]

# Top-level domains that are often abused.
SUSPICIOUS_TLDS = [
    "xyz", "top", "tk", "ml", "ga", "cf", "gq", "work", "click", "loan", "racing", "download",
]

# Compliance controls per framework.
FRAMEWORK_CONTROLS = {
    "pci": [
        "1. Install and maintain network security controls",
        "2. Apply secure configurations to all system components",
        "3. Protect stored account data",
        "5. Protect all systems from malicious software",
        "6. Develop and maintain secure systems",
        "7. Restrict access to system components by need-to-know",
        "8. Identify users and authenticate access",
        "10. Log and monitor all access",
        "11. Test security of systems and networks regularly",
        "12. Support information security with organisational policies",
    ],
    "hipaa": [
        "164.308(a)(1) -- Security management process",
        "164.308(a)(3) -- Workforce security",
        "164.308(a)(5) -- Security awareness & training",
        "164.308(a)(6) -- Security incident procedures",
        "164.310      -- Physical safeguards",
        "164.312(a)   -- Access control (technical)",
        "164.312(b)   -- Audit controls",
        "164.312(c)   -- Integrity",
        "164.312(e)   -- Transmission security",
    ],
    "soc2": [
        "CC6.1  -- Logical access controls",
        "CC6.6  -- Boundary protection",
        "CC7.1  -- Detection of security events",
        "CC7.2  -- System monitoring",
        "CC7.3  -- Incident response evaluation",
        "CC7.4  -- Incident response plan",
        "CC8.1  -- Change management",
    ],
    "iso27001": [
        "A.8 Asset management",
        "A.9 Access control",
        "A.12 Operations security -- logging & monitoring",
        "A.13 Communications security",
        "A.16 Information security incident management",
        "A.17 Business continuity",
    ],
}
