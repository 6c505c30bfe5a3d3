"""Unified diffs as rows: (path, old_path, hunk, new_line, flags), by windows over the lines of a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, hunk, new_line) of every added line of (diff_id, body).

    Null and empty bodies have no row; binary and deleted files have none; a count left out of a hunk's head is 1.
    """
    rows = diffs.select("diff_id", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("text").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")
    is_file = F.col("text").startswith("diff --git ")
    rows = rows.withColumn("file_no", F.sum(is_file.cast("int")).over(order))
    rows = rows.withColumn("hunk", F.sum(head.cast("int")).over(Window.partitionBy("diff_id", "file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    in_hunk = F.col("hunk") > 0
    per_file = Window.partitionBy("diff_id", "file_no")
    new_path = F.when(F.col("text").startswith("+++ ") & ~in_hunk, F.regexp_replace(F.regexp_replace("text", r"^\+\+\+ (?:b/)?", ""), r"\t.*$", ""))
    rows = rows.withColumn("path", F.max(new_path).over(per_file))
    within = Window.partitionBy("diff_id", "file_no", "hunk")
    start = F.max(F.when(head, F.regexp_extract("text", r"\+(\d+)", 1).cast("int"))).over(within)
    step = (~head & (F.col("text").startswith("+") | F.col("text").startswith(" "))).cast("int")
    rows = rows.withColumn("start", start).withColumn("new_line", F.col("start") - 1 + F.sum(step).over(within.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(in_hunk & ~head & F.col("text").startswith("+") & (F.col("path") != "/dev/null")).select("diff_id", "path", F.col("hunk").cast("int").alias("hunk"), F.col("new_line").cast("int").alias("new_line"))


def diff_files(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, old_path, is_binary, is_new, is_deleted, hunks, added) per file of a diff."""
    rows = diffs.select("diff_id", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("file_no", F.sum(F.col("text").startswith("diff --git ").cast("int")).over(order)).where("file_no > 0")
    rows = rows.withColumn("hunk", F.sum(F.col("text").rlike(r"^@@ -\d").cast("int")).over(Window.partitionBy("diff_id", "file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    t, head = F.col("text"), F.col("hunk") == 0
    name = lambda mark: F.max(F.when(head & t.startswith(mark), F.regexp_replace(t, rf"^{mark.replace('+', chr(92) + '+')}(?:[ab]/)?", "")))
    git = F.max(F.when(t.startswith("diff --git "), F.regexp_extract(t, r"^diff --git a/(.*) b/(.*)$", 2)))
    return rows.groupBy("diff_id", "file_no").agg(
        F.coalesce(F.nullif(name("+++ "), F.lit("/dev/null")), git).alias("path"),
        name("--- ").alias("old_path"),
        F.bool_or(head & t.rlike(r"^Binary files |^GIT binary patch")).alias("is_binary"),
        F.bool_or(head & t.startswith("new file mode")).alias("is_new"),
        F.bool_or(head & t.startswith("deleted file mode")).alias("is_deleted"),
        F.max("hunk").cast("int").alias("hunks"),
        F.count_if(~head & t.startswith("+")).alias("added"),
    ).drop("file_no")
