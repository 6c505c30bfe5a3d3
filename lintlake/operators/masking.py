"""Masking of personal data and secrets: patterns in order, each on the text the ones before have masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 12 * 1024
WINDOW = 20
PLACEHOLDER = "[REDACTED]"
# Names and patterns in the order they are applied.
PATTERNS = {
    "api_key": r"(?i)(api[_-]?key|apikey)\s*[:=]\s*['\"][A-Za-z0-9_\-\.]{16,}['\"]",
    "secret": r"(?i)(secret|token|access[_-]?token)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
    "password": r"(?i)(password|passwd|pwd)\s*[:=]\s*['\"][^'\"]{4,}['\"]",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "aws_key": r"\b(AKIA[0-9A-Z]{16})\b",
    "aws_secret": r"(?i)(aws[_-]?secret[_-]?access[_-]?key)\s*[:=]\s*['\"][A-Za-z0-9/+=]{40}['\"]",
    "jwt": r"\beyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\b",
    "private_key": r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:RSA |EC )?PRIVATE KEY-----",
    "github_token": r"\b(gh[ps]_[A-Za-z0-9]{36,})\b",
    "slack_token": r"\b(xox[baprs]-[A-Za-z0-9-]{10,})\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "bearer_token": r"\b[Bb]earer\s+[A-Za-z0-9\-._~+/]+=*\b",
    "basic_auth": r"\b[Bb]asic\s+[A-Za-z0-9+/]+=*\b",
}
# Parts of key names whose values are masked.
KEY_PARTS = "password passwd pwd secret token api_key apikey access_key private_key credential auth bearer session cookie ssn credit_card".split()


def masked(df: DataFrame, column: str, patterns: dict[str, str] = PATTERNS, placeholder: str = PLACEHOLDER) -> DataFrame:
    """The rows with masked_text, patterns_matched, redaction_count, hashes, size_bytes and truncated.

    A count is taken on the text as it stands when its pattern's turn comes. Null text stays null with no counts.
    """
    text, counts = F.col(column), []
    safe = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    df = df.withColumn("_m0", text)
    for k, (name, p) in enumerate(patterns.items()):
        counts.append((name, F.regexp_count(F.col(f"_m{k}"), F.lit(p))))
        df = df.withColumn(f"_m{k + 1}", F.regexp_replace(f"_m{k}", p, safe))
    last = F.col(f"_m{len(patterns)}")
    matched = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), c.alias("v")) for n, c in counts]), lambda x: x.v > 0))
    out = df.withColumn("patterns_matched", matched).withColumn("redaction_count", F.aggregate(F.map_values("patterns_matched"), F.lit(0), lambda a, b: a + b))
    out = out.withColumn("original_hash", F.sha2(text, 256)).withColumn("masked_hash", F.sha2(last, 256)).withColumn("original_md5", F.md5(text)).withColumn("masked_md5", F.md5(last)).withColumn("size_bytes", F.octet_length(last))
    out = out.withColumn("truncated", F.col("size_bytes") > MAX_BYTES).withColumn("masked_text", F.when(F.col("truncated"), F.substring(last, 1, MAX_BYTES)).otherwise(last))
    return out.drop(*[f"_m{k}" for k in range(len(patterns) + 1)])


def residual(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """The names of patterns that a text still matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def context_window(content: Column, line: Column, around: int = WINDOW) -> Column:
    """struct(text, start_line, end_line) of the lines around a line; null when the line is out of range."""
    parts = F.split(content, "\n")
    start = F.greatest(line - around, F.lit(1))
    end = F.least(line + around, F.size(parts))
    return F.when((line >= 1) & (line <= F.size(parts)), F.struct(F.array_join(F.slice(parts, start, end - start + 1), "\n").alias("text"), start.alias("start_line"), end.alias("end_line")))


def masked_map(values: Column, placeholder: str = PLACEHOLDER) -> Column:
    """A map with the values of keys that look secret replaced."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike("|".join(KEY_PARTS)), F.lit(placeholder)).otherwise(v))


def masked_leaves(kv: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Key paths (see `configs.key_values`) with the values below any key that looks secret replaced, at any depth."""
    return kv.withColumn("value_str", F.when(F.lower("key_path").rlike("|".join(KEY_PARTS)) & F.col("value_str").isNotNull(), F.lit(placeholder)).otherwise(F.col("value_str")))


def safe_context(df: DataFrame, content: str, line: str, around: int = WINDOW) -> DataFrame:
    """The rows with `context`: the masked lines around a line, where they begin and end, and what was masked in them."""
    cut = df.withColumn("_w", context_window(F.col(content), F.col(line), around)).withColumn("_t", F.col("_w.text"))
    rows = masked(cut, "_t")
    record = F.struct(F.col("masked_text").alias("text"), F.col("_w.start_line").alias("start_line"), F.col("_w.end_line").alias("end_line"), F.col("redaction_count").alias("redactions"), F.col("truncated").alias("truncated"))
    return rows.withColumn("context", F.when(F.col("_w").isNotNull(), record)).select(*df.columns, "context")
