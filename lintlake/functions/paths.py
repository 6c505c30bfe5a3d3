"""Paths of files relative to their repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roots under which build agents check repositories out, as paths or as URLs; of other URLs two folders go.
AGENT_ROOTS = (
    r"/home/[^/]+/work/[^/]+/[^/]+/",
    r"/builds/[^/]+/",
    r"/(?:workspace|github/workspace|src|app|repo)/[^/]+/",
    r"/?[A-Za-z]:/agent/_work/\d+/s/",
)
URL = r"(?i:[a-z][a-z0-9+.-]*://(?:localhost)?)"
CHECKOUT_ROOT = rf"^(?:(?:{URL})?(?:{'|'.join(AGENT_ROOTS)})|{URL}/[^/]+/[^/]+/)"
BLANKS = " \t\r\n\u00a0"


def _resolved(path: Column) -> Column:
    """The path without `x/..`, however deep; a `..` that leads out of it stays."""

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        leaves = (part == "..") & F.coalesce((last != "..") & (last != "") & ~last.endswith(":"), F.lit(False))
        return F.when(leaves, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def with_canonical_path(rows: DataFrame, column: str = "file_path", out: str = "_path") -> DataFrame:
    """A path relative to its repository: one separator, no `.`, no `x/..`, no checkout root.

    Expressions that few paths need are tried only on paths that hold what they look for; every step is a column, so
    none is evaluated twice.
    """
    path, holds = F.col(out), lambda part: F.contains(F.col(out), F.lit(part))
    rows = rows.withColumn(out, F.translate(F.trim(column, F.lit(BLANKS)), "\\", "/"))
    steps = [(holds("//"), F.regexp_replace(path, r"(?<!/)(?<![A-Za-z0-9+.-]{2}:)/{2,}", "/")), (holds("./"), F.regexp_replace(path, r"(?:^|(?<=/))(?:\./)+", ""))]
    steps += [(holds("/../"), _resolved(path)), (path.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.regexp_replace(path, CHECKOUT_ROOT, ""))]
    for test, by in steps:
        rows = rows.withColumn(out, F.when(test, by).otherwise(path))
    return rows.withColumn(out, F.nullif(F.expr(f"trim(LEADING '/' FROM `{out}`)"), F.lit("")))
