"""Scalar functions on columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from the least to the gravest, and severities of the CI parity checks.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def trim_blank(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def severity_ord(severity: Column) -> Column:
    """0 for LOW to 3 for CRITICAL, null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(F.trim(severity))).cast("int") - 1, F.lit(-1))


def lines_of_code(content: Column) -> Column:
    """Lines that are not blank and do not begin with #, in any language."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^\s*[^\s#]")))


def strip_inline_comment(line: Column) -> Column:
    """A line up to the first # outside quotes."""
    return F.regexp_extract(line, r"""^((?:[^#'"]++|'[^']*+'?|"[^"]*+"?)*+)""", 1)


def normal_message(message: Column) -> Column:
    """Lower case, paths and whole numbers replaced, blanks collapsed."""
    m = F.lower(trim_blank(message))
    m = F.regexp_replace(m, r"(?:/[\w.\-]+)+", "<path>")
    m = F.regexp_replace(m, r"\b\d+\b", "<n>")
    return trim_blank(F.regexp_replace(m, r"\s+", " "))


def dedup_key(path: Column, line: Column, issue_type: Column, message: Column) -> Column:
    """`sha256:` and the digest of a finding's place, type and normal message; nulls count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (path, line, issue_type)] + [F.coalesce(normal_message(message), F.lit(""))]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def html_escape(c: Column) -> Column:
    """&, <, >, double and single quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def version_parts(version: Column) -> Column:
    """A dotted version as integers, null when a part is none."""
    parts = F.transform(F.split(F.regexp_replace(version, "^[vV]", ""), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)


def newer(a: Column, b: Column) -> Column:
    """Whether version a comes after version b, part by part."""
    return version_parts(a) > version_parts(b)


def distribution_name(c: Column) -> Column:
    """The normal form of a distribution's name."""
    return F.regexp_replace(F.lower(c), r"[-_.]+", "-")


def spec_name(requirement: Column) -> Column:
    """The name at the head of a requirement."""
    return F.regexp_extract(requirement, r"^\s*([A-Za-z0-9][A-Za-z0-9._\-]*)", 1)


def sanitised_args(args: Column) -> Column:
    """Words of a command line with paths, e-mail addresses and words that look secret replaced."""
    word = lambda w: (
        F.when(w.rlike(r"[/\\]"), F.lit("<path>"))
        .when(w.rlike(r"@.*\."), F.lit("<email>"))
        .when(w.rlike(r"(?i)(token|secret|password|key|credential)"), F.lit("<secret>"))
        .otherwise(w)
    )
    return F.array_join(F.transform(F.split(args, r"\s+"), word), " ")


def short_id(prefix: str) -> Column:
    """A prefix and twelve capital hexadecimal digits."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
