"""SQL files as statements, and the rules that need a whole statement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import spread

SCHEMA = "path string, stmt_no int, start_line int, start_col int, raw string, scan string"
_PART = re.compile(r"'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?|`[^`]*`?|(?:(?<=\s)|^)--[^\n]*|#[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|;", re.M)


def split(text: str) -> list[tuple[int, int, str, str]]:
    """(start_line, start_col, raw, scan) of the statements of a text.

    Semicolons in quotes or comments end nothing. The scan is the raw text with comments and the insides of single
    quotes blanked, line breaks and length kept.
    """
    scan, cuts = list(text), []
    for m in _PART.finditer(text):
        v = m.group()
        if v == ";":
            cuts.append(m.end())
        elif v[0] not in '"`':
            a, b = (m.start() + 1, m.end() - 1) if v[0] == "'" else m.span()
            scan[a:b] = ["\n" if c == "\n" else " " for c in text[a:b]]
    masked, out, at = "".join(scan), [], 0
    for end in [*cuts, len(text)]:
        raw, clean = text[at:end], masked[at:end]
        if clean.strip(" \t\r\n;"):
            first = at + len(clean) - len(clean.lstrip())
            out.append((text.count("\n", 0, first) + 1, first - text.rfind("\n", 0, first), raw.strip(), clean.strip()))
        at = end
    return out


def statements(files: DataFrame) -> DataFrame:
    """Statements of (path, content); null contents have none."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *s) for p, t in zip(batch["path"], batch["content"]) if t for i, s in enumerate(split(t))]
            yield pd.DataFrame(rows, columns=["path", "stmt_no", "start_line", "start_col", "raw", "scan"])

    return spread(files.select("path", "content")).mapInPandas(look, SCHEMA)


_NAME = r"(?:`[^`]+`|\"[^\"]+\"|\[[^\]]+\]|\w+)"
# Rule, what matches, what must not follow, severity and confidence.
RULES = [
    ("SQL020", r"(?is)\bDROP\s+(?:TABLE|DATABASE|SCHEMA)\b", r"(?is)\bDROP\s.*\bIF\s+EXISTS\b", "HIGH", 0.85),
    ("SQL021", r"(?is)\bTRUNCATE\s+TABLE\b", None, "HIGH", 0.88),
    ("SQL022", rf"(?is)\bDELETE\s+(?:\w+\s+)?FROM\s+{_NAME}(?:\s*\.\s*{_NAME})*(?:\s|;|$)", r"(?is)\bDELETE\s.*\bWHERE\b", "CRITICAL", 0.92),
    ("SQL023", rf"(?is)\bUPDATE\s+{_NAME}(?:\s*\.\s*{_NAME})*\s+SET\b", r"(?is)\bUPDATE\s.*\bWHERE\b", "CRITICAL", 0.90),
]


def statement_findings(rows: DataFrame) -> DataFrame:
    """(path, stmt_no, line, rule_id, severity, confidence): the first rule that a statement's scan breaks."""
    tests = []
    for rule_id, yes, no, severity, confidence in RULES:
        hit = F.col("scan").rlike(yes) & (~F.col("scan").rlike(no) if no else F.lit(True))
        tests.append(F.when(hit, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))))
    found = rows.select("path", "stmt_no", F.col("start_line").alias("line"), F.coalesce(*tests).alias("f")).where("f is not null")
    return found.select("path", "stmt_no", "line", "f.*")
