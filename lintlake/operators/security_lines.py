"""Injection and eval rules over lines of code: SQL built in a function that executes it, shell commands built from strings, eval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import spread

# The rules' expressions.
SQL_SINK = re.compile(r"\.\s*(?:execute|executemany|executescript|run|raw|mogrify)\s*\(", re.I)
COMMAND_SINK = re.compile(r"\b(?:os\.system|os\.popen|subprocess\.call|subprocess\.Popen|subprocess\.run)\s*\(")
SHELL = re.compile(r"\bshell\s*=\s*True\b")
SQL_WORD = re.compile(r"""(?:f?(?:"{1,3}|'{1,3}))[^"']*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b""", re.I)
PERCENT = re.compile(r"""["']\s*%\s*(?!\s*[sdiouxXeEfFgGcrp%](?:\W|$))\S""")
EVALS = (re.compile(r"\beval\s*\("), re.compile(r"\bexec\s*\("))
FOUND = "path string, line int, rule_id string, issue_type string, severity string, name string"


def _dynamic(line: str) -> bool:
    return 'f"' in line or "f'" in line or bool(PERCENT.search(line)) or ".format(" in line or "+" in line and ('"' in line or "'" in line)


def scopes(lines: list[str]) -> list[tuple[int, int, bool]]:
    """(first line, last line, executes SQL) of outermost functions, by indentation."""
    out, i = [], 0
    while i < len(lines):
        body = lines[i].lstrip()
        if not body.startswith(("def ", "async def ")):
            i += 1
            continue
        indent, j = len(lines[i]) - len(body), i + 1
        while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > indent):
            j += 1
        out.append((i + 1, j, bool(SQL_SINK.search("\n".join(lines[i:j])))))
        i = j
    return out


def security_rows(path: str, language: str, text: str) -> list[tuple]:
    """SEC-02, SEC-04 and, but for Python, SEC-05 of one file."""
    lines = text.split("\n")
    within = {n for a, b, sink in (scopes(lines) if SQL_SINK.search(text) else []) if sink for n in range(a, b + 1)}
    out = []
    for n, line in enumerate(lines, 1):
        if language != "python":
            out += [(path, n, "SEC05", "EVAL_USAGE", "CRITICAL", name) for name, p in zip(("eval", "exec"), EVALS) if p.search(line)]
        if line.lstrip().startswith(("#", "//")):
            continue
        if n in within and SQL_WORD.search(line) and _dynamic(line):
            out.append((path, n, "SEC02", "SQL_INJECTION_RISK", "HIGH", ""))
        sink = COMMAND_SINK.search(line)
        if sink and _dynamic(line) and ("subprocess." not in sink[0] or SHELL.search(line)):
            out.append((path, n, "SEC04", "COMMAND_INJECTION", "HIGH", sink[0].rstrip("( \t")))
    return out


def security_findings(files: DataFrame) -> DataFrame:
    """(path, line, rule_id, issue_type, severity, name) of (path, content, language); Python's eval is a fact of its syntax tree."""
    asked = F.col("content").rlike(f"(?i){SQL_SINK.pattern}") | F.col("content").rlike(COMMAND_SINK.pattern) | F.col("content").rlike(r"\b(?:eval|exec)\s*\(")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, g, t in zip(batch["path"], batch["language"], batch["content"]) for r in security_rows(p, g, t)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in FOUND.split(",")])

    return spread(files.where(asked).select("path", "language", "content")).mapInPandas(look, FOUND)
