"""Line rules as data: family -> groups of (rule_id, pattern, severity, confidence).

In a `first` group the first pattern that matches a line gives the one finding of that group on the line; in an `all`
group every pattern does. `skip` is the expression of lines a family leaves out; `strip` families match the line
without its inline comment. A group named in `needs` is judged only in files that hold all of some words, or whose
path has a part.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Family:
    name: str
    languages: tuple[str, ...]
    groups: tuple[tuple[str, str, str, tuple[tuple[str, str, str, float], ...]], ...]  # (name, first or all, issue type, rules)
    skip: str = ""
    strip: bool = False
    only: str = ""
    needs: tuple[tuple[str, tuple[str, ...], str], ...] = ()  # (group, words, part of a path)


# The rules' patterns, severities and confidences.
SQL = Family(
    "sql",
    ("sql",),
    (
        ("injection", "first", "SQL_INJECTION_RISK", (
            ("SQL001", r"(?i)\bEXEC(?:UTE)?\s*\(\s*['\"]?\s*\+", "CRITICAL", 0.95),
            ("SQL002", r"(?i)\bEXEC(?:UTE)?\s+(?:sp_executesql|xp_cmdshell)", "HIGH", 0.88),
            ("SQL003", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|WHERE)\s+.*\|\|.*\$", "HIGH", 0.85),
            ("SQL004", r"(?i)(?:f['\"]|%s|%d|\{\}).*(?:SELECT|INSERT|UPDATE|DELETE)", "HIGH", 0.80),
        )),
        ("credentials", "first", "SQL_HARDCODED_CREDENTIALS", (
            ("SQL010", r"(?i)\bpassword\s*=\s*['\"][^'\"]{4,}['\"]", "CRITICAL", 0.92),
            ("SQL011", r"(?i)\bpwd\s*=\s*['\"][^'\"]{4,}['\"]", "CRITICAL", 0.90),
            ("SQL012", r"(?i)(?:mysql|postgres|sqlserver|oracle)://[^:]+:[^@]+@", "CRITICAL", 0.95),
        )),
        ("quality", "first", "SQL_SELECT_STAR", (
            ("SQL030", r"(?i)\bSELECT\s+\*\s+FROM\b", "LOW", 0.75),
            ("SQL031", r"(?i)\bSELECT\s+.*\bINTO\s+#", "LOW", 0.65),
        )),
        ("permissions", "first", "SQL_OVERLY_PERMISSIVE_GRANT", (
            ("SQL040", r"(?i)\bGRANT\s+ALL\s+(?:PRIVILEGES\s+)?ON\b", "HIGH", 0.88),
            ("SQL041", r"(?i)\bGRANT\s+.*\bTO\s+['\"]?public['\"]?", "HIGH", 0.90),
            ("SQL042", r"(?i)\bGRANT\s+.*\bWITH\s+GRANT\s+OPTION\b", "MEDIUM", 0.85),
        )),
    ),
    skip=r"^\s*(?:--|#|$)",
)
TERRAFORM = Family(
    "terraform",
    ("terraform",),
    (
        ("open_security_group", "first", "TF_OPEN_SECURITY_GROUP", (
            ("TF001", r"(?i)\bcidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"\s*\]", "CRITICAL", 0.95),
            ("TF001B", r"(?i)\bcidr_block\s*=\s*\"0\.0\.0\.0/0\"", "CRITICAL", 0.93),
            ("TF002", r"(?i)\bipv6_cidr_blocks\s*=\s*\[\s*\"::/0\"\s*\]", "CRITICAL", 0.95),
            ("TF002B", r"(?i)\bipv6_cidr_block\s*=\s*\"::/0\"", "CRITICAL", 0.93),
        )),
        ("secrets", "first", "TF_HARDCODED_SECRET", (
            ("TF010", r"\b(AKIA|ASIA|AIDA)[0-9A-Z]{16}\b", "CRITICAL", 0.98),
            ("TF011", r"(?i)\bpassword\s*=\s*\"[^\"]{4,}\"", "CRITICAL", 0.90),
            ("TF012", r"(?i)\bsecret\s*=\s*\"[^\"]{8,}\"", "CRITICAL", 0.88),
            ("TF013", r"(?i)\bapi_key\s*=\s*\"[^\"]{10,}\"", "CRITICAL", 0.88),
        )),
        ("encryption", "first", "TF_MISSING_ENCRYPTION", (
            ("TF020", r"(?i)\bencrypted\s*=\s*false\b", "HIGH", 0.95),
            ("TF021", r"(?i)\bstorage_encrypted\s*=\s*false\b", "HIGH", 0.95),
            ("TF022", r"(?i)\bkms_key_id\s*=\s*\"\"\b", "MEDIUM", 0.80),
        )),
        ("public_access", "first", "TF_PUBLIC_ACCESS", (
            ("TF030", r"(?i)\bpublicly_accessible\s*=\s*true\b", "HIGH", 0.92),
            ("TF031", r"(?i)\bblock_public_acls\s*=\s*false\b", "HIGH", 0.90),
            ("TF032", r"(?i)\bblock_public_policy\s*=\s*false\b", "HIGH", 0.90),
            ("TF033", r"(?i)\bignore_public_acls\s*=\s*false\b", "MEDIUM", 0.88),
        )),
        ("iam", "first", "TF_OVERLY_PERMISSIVE_IAM", (
            ("TF040", r"(?i)\"Action\"\s*:\s*\"\*\"", "CRITICAL", 0.95),
            ("TF041", r"(?i)\"Resource\"\s*:\s*\"\*\"", "HIGH", 0.85),
        )),
    ),
)
SHELL = Family(
    "shell",
    ("shell",),
    (
        ("remote_execution", "first", "SHELL_UNSAFE_COMMAND", (
            ("SH_RCE1", r"(?i)curl\s+[^|]*\|\s*(ba)?sh", "CRITICAL", 0.95),
            ("SH_RCE2", r"(?i)wget\s+[^|]*\|\s*(ba)?sh", "CRITICAL", 0.95),
            ("SH_RCE3", r"(?i)curl\s+[^|]*\|\s*sudo\s+(ba)?sh", "CRITICAL", 0.98),
            ("SH_RCE4", r"(?i)wget\s+[^|]*\|\s*sudo\s+(ba)?sh", "CRITICAL", 0.98),
        )),
        ("eval", "first", "SHELL_COMMAND_INJECTION", (
            ("SH_EVAL1", r"\beval\s+\"\$\([^)]+\)\"", "HIGH", 0.85),
            ("SH_EVAL2", r"\beval\s+\"\$\{?[A-Za-z_][A-Za-z0-9_]*\}?\"", "HIGH", 0.80),
            ("SH_EVAL3", r"\beval\s+\$[A-Za-z_]", "HIGH", 0.85),
        )),
        ("destructive", "first", "SHELL_UNSAFE_COMMAND", (
            ("SH_RM1", r"\brm\b(?=[^\n]*\s-[^\s]*r)(?=[^\n]*\s-[^\s]*f)[^\n]*\s+/(?:\s|$|;|&&|\|\|)", "CRITICAL", 0.98),
            ("SH_RM2", r"\brm\b(?=[^\n]*\s-[^\s]*r)(?=[^\n]*\s-[^\s]*f)[^\n]*\s+/\*", "CRITICAL", 0.95),
            ("SH_RM3", r"rm\s+-rf\s+\"\$\{?[^}]*:-/\}?\"", "HIGH", 0.90),
            ("SH_TRUNC", r":\s*>\s*/etc/passwd", "CRITICAL", 0.98),
            ("SH_MKFS", r"mkfs\s+/dev/sd[a-z]", "HIGH", 0.85),
            ("SH_DD", r"dd\s+.*of=/dev/sd[a-z]", "HIGH", 0.80),
        )),
        ("unquoted", "first", "SHELL_UNQUOTED_VARIABLE", (
            ("SH_TEST", r"\[\s+-[a-z]\s+\$[A-Za-z_]", "MEDIUM", 0.65),
            ("SH_RMVAR", r"rm\s+.*\$[A-Za-z_][A-Za-z0-9_]*[^\"'\s]", "MEDIUM", 0.65),
            ("SH_CDVAR", r"cd\s+\$[A-Za-z_][A-Za-z0-9_]*\s", "MEDIUM", 0.65),
        )),
    ),
    skip=r"^\s*#",
    strip=True,
)
DOCKERFILE = Family(
    "dockerfile",
    ("dockerfile",),
    (
        ("base_image", "first", "DOCKERFILE_LATEST_TAG", (
            ("DOCKER002", r"(?i)^\s*FROM\s+[^\s$]+:latest\b", "HIGH", 0.95),
            ("DOCKER003", r"(?i)^\s*FROM\s+(?!scratch(?:\s|$))(?:[^\s$:@/]+/)*[^\s$:@/]+(?:\s|$)", "MEDIUM", 0.85),
        )),
        ("remote_execution", "first", "DOCKERFILE_UNSAFE_COMMAND", (
            ("DOCKER010", r"(?i)^\s*RUN\s+.*\b(curl|wget)\b[^\n]*\|\s*(sh|bash)\b", "CRITICAL", 0.97),
            ("DOCKER011", r"(?i)^\s*RUN\s+.*\b(curl|wget)\b[^\n]*(sh\s+-c|bash\s+-c)\b", "HIGH", 0.90),
        )),
        ("add_remote", "first", "DOCKERFILE_UNSAFE_COMMAND", (("DOCKER012", r"(?i)^\s*ADD\s+https?://", "HIGH", 0.88),)),
        ("secrets", "first", "DOCKERFILE_SECRET_EXPOSURE", (
            ("DOCKER020", r"\b(AKIA|ASIA|AIDA)[0-9A-Z]{16}\b", "CRITICAL", 0.98),
            ("DOCKER021", r"\bghp_[A-Za-z0-9]{36}\b", "CRITICAL", 0.98),
            ("DOCKER022", r"\bsk-[A-Za-z0-9]{20,}\b", "CRITICAL", 0.95),
            ("DOCKER023", r"(?i)^\s*(ARG|ENV)\s+\w*(PASSWORD|SECRET|TOKEN|API_KEY|PRIVATE)\w*\b", "HIGH", 0.88),
            ("DOCKER024", r"(?i)^\s*COPY\s+.*\b(\.env|\.pem|\.key|id_rsa|id_ed25519|credentials|\.npmrc|\.pypirc|\.netrc)\b", "HIGH", 0.92),
        )),
        ("permissions", "first", "DOCKERFILE_WEAK_PERMISSIONS", (
            ("DOCKER030", r"(?i)^\s*RUN\s+.*\bchmod\b[^\n]*\b777\b", "HIGH", 0.95),
            ("DOCKER031", r"(?i)^\s*RUN\s+.*\bchmod\b[^\n]*\b666\b", "MEDIUM", 0.85),
        )),
    ),
    skip=r"^\s*(?:#|$)",
)
YAML = Family(
    "yaml",
    ("yaml",),
    (
        ("tab", "first", "YAML_INDENTATION", (("YML_TAB", r"\t", "MEDIUM", 0.9),)),
        ("secret_sure", "first", "YAML_SECRET_EXPOSURE", (
            ("YML_S1", r"\b(AKIA|ASIA|AIDA)[0-9A-Z]{16}\b", "CRITICAL", 0.95),
            ("YML_S2", r"\bghp_[a-zA-Z0-9]{36}\b", "CRITICAL", 0.95),
            ("YML_S3", r"\bsk-[a-zA-Z0-9]{48}\b", "CRITICAL", 0.95),
        )),
        ("secret_likely", "first", "YAML_SECRET_EXPOSURE", (
            ("YML_S4", r"(?i)password\s*[:=]\s*['\"][^'\"]{8,}['\"]", "HIGH", 0.75),
            ("YML_S5", r"(?i)api[_-]?key\s*[:=]\s*['\"][^'\"]{16,}['\"]", "HIGH", 0.75),
            ("YML_S6", r"(?i)secret[_-]?key\s*[:=]\s*['\"][^'\"]{16,}['\"]", "HIGH", 0.75),
            ("YML_S7", r"(?i)aws_secret_access_key\s*[:=]\s*['\"][^'\"]+['\"]", "HIGH", 0.75),
        )),
        ("secret_possible", "first", "YAML_SECRET_EXPOSURE", (
            ("YML_S8", r"(?i)token\s*[:=]\s*['\"][^'\"]{10,}['\"]", "MEDIUM", 0.5),
            ("YML_S9", r"(?i)secret\s*[:=]\s*['\"][^'\"]{8,}['\"]", "MEDIUM", 0.5),
        )),
        ("workflow", "all", "YAML_UNSAFE_COMMAND", (
            ("YML_GH1", r"pull_request_target:", "HIGH", 0.85),
            ("YML_GH2", r"permissions:\s*write-all", "HIGH", 0.85),
        )),
        ("cluster", "all", "YAML_UNSAFE_COMMAND", (
            ("YML_K1", r"privileged:\s*true", "HIGH", 0.9),
            ("YML_K2", r"hostNetwork:\s*true", "HIGH", 0.9),
            ("YML_K3", r"hostPID:\s*true", "HIGH", 0.9),
            ("YML_K4", r"allowPrivilegeEscalation:\s*true", "HIGH", 0.9),
        )),
    ),
    skip=r"^\s*#|\$\{|\{\{|\$\(",
    strip=True,
    needs=(("workflow", ("on:", "jobs:"), ".github/workflows"), ("cluster", ("apiVersion:", "kind:"), "")),
)
MAKEFILE = Family(
    "makefile",
    ("makefile",),
    (
        ("dynamic", "all", "MAKEFILE_UNSAFE", (
            ("MF001", r"(?i)\b(eval)\b\s+.*(\$\(|\$\{|\$[A-Za-z_][A-Za-z0-9_]*|`)", "HIGH", 0.88),
            ("MF001", r"(?i)\b(sh|bash|zsh)\b\s+-c\s+['\"].*(\$\(|\$\{|\$[A-Za-z_][A-Za-z0-9_]*|`).*['\"]", "HIGH", 0.86),
            ("MF001", r"(?i)\bxargs\b.*\b(sh|bash)\b\s+-c\b", "HIGH", 0.80),
            ("MF001", r"(?i)\$\(\s*shell\s+[^)]+\)", "HIGH", 0.84),
        )),
        ("remote_execution", "all", "MAKEFILE_UNSAFE", (
            ("MF002", r"(?i)\b(curl|wget)\b.*\|\s*(sh|bash|zsh)\b", "CRITICAL", 0.97),
            ("MF002", r"(?i)\b(curl|wget)\b.*\|\s*(sudo\s+)?(sh|bash|zsh)\b", "CRITICAL", 0.98),
        )),
        ("sudo", "all", "MAKEFILE_UNSAFE", (("MF003", r"(?i)(^|\s)sudo(\s|$)", "MEDIUM", 0.75),)),
        ("tls", "all", "MAKEFILE_UNSAFE", (
            ("MF004", r"(?i)\bcurl\b.*(\s-k\b|--insecure\b)", "HIGH", 0.92),
            ("MF004", r"(?i)\bwget\b.*--no-check-certificate\b", "HIGH", 0.92),
            ("MF004", r"(?i)\bgit\b.*-c\s+http\.sslVerify\s*=\s*false\b", "HIGH", 0.90),
            ("MF004", r"(?i)\b(GIT_SSL_NO_VERIFY|NODE_TLS_REJECT_UNAUTHORIZED)\s*=\s*(1|true|0)\b", "HIGH", 0.86),
        )),
        ("delete", "all", "MAKEFILE_UNSAFE", (
            ("MF005", r"(?i)\brm\b\s+-rf\s+/\s*($|;)", "CRITICAL", 0.99),
            ("MF005", r"(?i)\brm\b\s+-rf\s+/\*\s*($|;)", "CRITICAL", 0.99),
            ("MF005", r"(?i)\brm\b\s+-rf\s+(\$\(|\$\{|\$[A-Za-z_][A-Za-z0-9_]*|\*)", "HIGH", 0.82),
        )),
    ),
    only=r"^\t",
)
SECRETS = Family(
    "secrets",
    ("python", "javascript", "typescript", "java", "go", "rust", "csharp"),
    (
        ("secret", "all", "HARDCODED_SECRET", (
            ("SEC01A", r"(?i)api[_-]?key\s*=\s*['\"]([a-zA-Z0-9_\-]{20,})['\"]", "CRITICAL", 0.9),
            ("SEC01B", r"(?i)secret[_-]?key\s*=\s*['\"]([a-zA-Z0-9_\-]{20,})['\"]", "CRITICAL", 0.9),
            ("SEC01C", r"(?i)password\s*=\s*['\"]([^'\"]{8,})['\"]", "CRITICAL", 0.9),
            ("SEC01D", r"(?i)token\s*=\s*['\"]([a-zA-Z0-9_\-]{20,})['\"]", "CRITICAL", 0.9),
            ("SEC01E", r"(?i)sk-[a-zA-Z0-9]{20,}", "CRITICAL", 0.9),
            ("SEC01F", r"(?i)ghp_[a-zA-Z0-9]{36}", "CRITICAL", 0.9),
            ("SEC01G", r"AWS[A-Z0-9]{16,}", "CRITICAL", 0.9),
            ("SEC01H", r"AKIA[0-9A-Z]{16}", "CRITICAL", 0.9),
        )),
        ("command", "first", "COMMAND_INJECTION", (("SEC04", r"\b(?:os\.system|os\.popen)\s*\(\s*(?:f['\"]|['\"][^'\"]*['\"]\s*(?:%|\+|\.format)|[A-Za-z_]\w*\s*\+)", "HIGH", 0.9),)),
        ("marker", "first", "INCOMPLETE_TODO", (("SML06", r"(?i)(?://|#|/\*|\*)\s*(TODO|FIXME|XXX|HACK)\b", "LOW", 0.8),)),
    ),
)
FAMILIES = {f.name: f for f in (SQL, TERRAFORM, SHELL, DOCKERFILE, YAML, MAKEFILE, SECRETS)}

# Content rules, matched over the whole text, every match a finding.
POWERSHELL = (
    ("PS001", r"(?i)\bInvoke-Expression\b", "CRITICAL", 0.95),
    ("PS001", r"(?i)\biex\b", "CRITICAL", 0.92),
    ("PS002", r"(?is)(?:DownloadString|DownloadFile)\s*\([^)]+\).*?(?:Invoke-Expression|iex|\|)", "CRITICAL", 0.98),
    ("PS002", r"(?is)(?:Invoke-WebRequest|iwr|curl|wget)\s+.*?(?:\|\s*(?:Invoke-Expression|iex))", "CRITICAL", 0.97),
    ("PS002", r"(?is)New-Object\s+(?:Net\.)?WebClient.*?DownloadString", "HIGH", 0.85),
    ("PS003", r"(?i)Start-Process\s+.*?\$\w+", "HIGH", 0.80),
    ("PS003", r"(?i)Start-Process\s+.*?-ArgumentList\s+.*?\+", "HIGH", 0.85),
    ("PS004", r"(?i)\$(?:password|passwd|pwd|secret|api_?key|token|credential)\s*=\s*['\"][^'\"]+['\"]", "CRITICAL", 0.90),
    ("PS004", r"(?i)ConvertTo-SecureString\s+['\"][^'\"]+['\"]\s+-AsPlainText", "CRITICAL", 0.95),
    ("PS005", r"(?i)Set-ExecutionPolicy\s+(?:Bypass|Unrestricted)", "HIGH", 0.92),
    ("PS005", r"(?i)-ExecutionPolicy\s+(?:Bypass|Unrestricted)", "HIGH", 0.90),
    ("PS006", r"(?i)\[System\.Net\.ServicePointManager\]::ServerCertificateValidationCallback\s*=", "CRITICAL", 0.95),
    ("PS006", r"(?i)\[Net\.ServicePointManager\]::SecurityProtocol\s*=.*?Ssl3", "HIGH", 0.92),
    ("PS006", r"(?i)-SkipCertificateCheck", "HIGH", 0.90),
)
GROOVY = (
    ("GJ001", r"(?i)\b(sh|bat)\s*\(\s*[\"'].*\$\{[^}]+\}.*[\"']\s*\)", "HIGH", 0.90),
    ("GJ001", r"(?i)\b(sh|bat)\s+[\"'].*\$\{[^}]+\}.*[\"']", "HIGH", 0.88),
    ("GJ001", r"(?i)\b(sh|bat)\s*\(\s*\"[^\"]*\"\s*\+\s*\w+", "HIGH", 0.85),
    ("GJ002", r"(?i)\b(sh|bat)\s*[(\s]+[\"'].*(curl|wget)\b.*\|\s*(sh|bash|zsh)\b.*[\"']", "CRITICAL", 0.97),
    ("GJ002", r"(?i)(curl|wget)\b.*\|\s*(sh|bash|zsh)\b", "CRITICAL", 0.95),
    ("GJ003", r"(?i)\b(echo|println)\s*[(\s]+.*(\$?\{?(?:PASSWORD|TOKEN|SECRET|API_KEY|CREDENTIAL)[^}]*\}?)", "CRITICAL", 0.92),
    ("GJ003", r"(?i)\bsh\s*[\"'].*echo\s+\$\{?(?:PASSWORD|TOKEN|SECRET|API_KEY)", "CRITICAL", 0.90),
    ("GJ003", r"(?is)\bset\s+-x\b.*withCredentials", "HIGH", 0.88),
    ("GJ003", r"(?is)withCredentials.*\bset\s+-x\b", "HIGH", 0.88),
    ("GJ004", r"(?i)\bcurl\b.*(\s-k\b|--insecure\b)", "HIGH", 0.92),
    ("GJ004", r"(?i)\bwget\b.*--no-check-certificate\b", "HIGH", 0.92),
    ("GJ004", r"(?i)\bgit\b.*-c\s+http\.sslVerify\s*=\s*false\b", "HIGH", 0.90),
    ("GJ005", r"(?i)\bevaluate\s*\(\s*new\s+File\s*\([^)]+\)\.text\s*\)", "CRITICAL", 0.95),
    ("GJ005", r"(?i)\bGroovyShell\s*\(\s*\)\.evaluate\s*\(", "CRITICAL", 0.94),
    ("GJ005", r"(?i)\bload\s+['\"].*\.groovy['\"]", "MEDIUM", 0.75),
    ("GJ005", r"(?i)\bEval\s*\.\s*me\s*\(", "CRITICAL", 0.93),
)
CONTENT = {"powershell": POWERSHELL, "groovy": GROOVY}

# DuckDB has no look-around; these are conditions on a line `t` that say the same as the expressions of those rules.
SQL_CONDITIONS = {
    "SH_RM1": r"(regexp_matches(t, '\brm\b[^\n]*\s-[^\s]*r') AND regexp_matches(t, '\brm\b[^\n]*\s-[^\s]*f') AND regexp_matches(t, '\brm\b[^\n]*\s+/(?:\s|$|;|&&|\|\|)'))",
    "SH_RM2": r"(regexp_matches(t, '\brm\b[^\n]*\s-[^\s]*r') AND regexp_matches(t, '\brm\b[^\n]*\s-[^\s]*f') AND regexp_matches(t, '\brm\b[^\n]*\s+/\*'))",
    "DOCKER003": r"(regexp_matches(t, '(?i)^\s*FROM\s+(?:[^\s$:@/]+/)*[^\s$:@/]+(?:\s|$)') AND NOT regexp_matches(t, '(?i)^\s*FROM\s+scratch(?:\s|$)'))",
}
