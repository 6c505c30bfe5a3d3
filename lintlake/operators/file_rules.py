"""Rules that need a whole file: safety flags of scripts, the user of an image, indentation, public networks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lintlake.operators.rules import lines
from lintlake.session import spread


def missing_safety_flags(files: DataFrame) -> DataFrame:
    """Scripts of more than ten lines with a shell's shebang and no `set -e`, `-u` or `-o` in their first twenty lines."""
    parts = F.split("content", "\n")
    flagged = F.exists(F.slice(parts, 1, 20), lambda x: x.rlike(r"^\s*set\s+-\w*[euo]"))
    rows = files.where((F.size(parts) > 10) & parts[0].rlike(r"^#!.*\b(?:ba)?sh\b") & ~flagged)
    return rows.select("path", F.lit(1).alias("line"), F.lit("SHELL_MISSING_SAFETY").alias("issue_type"), F.lit("MEDIUM").alias("severity"))


def image_users(files: DataFrame) -> DataFrame:
    """Dockerfiles that never leave the root user: no USER at all, or the last one root."""
    rows = lines(files)
    user = F.regexp_extract("text", r"(?i)^\s*USER\s+(\S+)", 1)
    found = rows.groupBy("path").agg(F.bool_or(F.col("text").rlike(r"(?i)^\s*FROM\s+\S+")).alias("is_image"), F.max_by(F.nullif(user, F.lit("")), F.when(user != "", F.col("line"))).alias("last_user"))
    root = F.lower(F.regexp_extract("last_user", r"^([^:]+)", 1)).isin("root", "0")
    kind = F.when(F.col("last_user").isNull(), F.struct(F.lit("DOCKER001").alias("rule_id"), F.lit("MEDIUM").alias("severity"))).when(root, F.struct(F.lit("DOCKER004").alias("rule_id"), F.lit("HIGH").alias("severity")))
    return found.where("is_image").withColumn("k", kind).where("k is not null").select("path", "k.*")


def uneven_indentation(files: DataFrame, most: int = 3) -> DataFrame:
    """Files with more than `most` widths of indentation, blank and comment lines aside."""
    rows = lines(files).where(F.col("text").rlike(r"^ +[^ #]"))
    width = F.length(F.regexp_extract("text", r"^( +)", 1))
    return rows.groupBy("path").agg(F.count_distinct(width).alias("widths")).where(F.col("widths") > most)


def yaml_errors(files: DataFrame) -> DataFrame:
    """(path, line) of YAML files that do not parse, with the line a parser names."""

    def look(batches):
        import yaml

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                try:
                    for _ in yaml.parse(text or ""):
                        pass
                except yaml.YAMLError as e:
                    mark = getattr(e, "problem_mark", None)
                    rows.append((path, mark.line + 1 if mark else 1))
            yield pd.DataFrame(rows, columns=["path", "line"])

    return spread(files.select("path", "content")).mapInPandas(look, "path string, line int")


@F.pandas_udf(BooleanType())
def public_network(cidr: pd.Series) -> pd.Series:
    """Whether a network, of either family, or one of the words for everything, is open to the world; false for what is none."""

    def one(c) -> bool:
        if c is None:
            return False
        if c.strip().lower() in ("*", "any", "internet", "0.0.0.0", "::"):
            return True
        try:
            n = ipaddress.ip_network(c.strip(), strict=False)
        except ValueError:
            return False
        return n.prefixlen == 0 or not (n.is_private or n.is_loopback or n.is_link_local or n.is_multicast or n.is_reserved)

    return cidr.map(one).astype(bool)


def memory_gate(work, threshold_kb: int = 50_000, rss_kb=None) -> dict:
    """Run `work` on the driver and compare the growth of its memory to a threshold, which may be reached."""
    import resource

    measure = rss_kb or (lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
    before = measure()
    result = work()
    after = measure()
    return {"before_kb": before, "after_kb": after, "threshold_kb": threshold_kb, "passed": after - before <= threshold_kb, "result": result}
