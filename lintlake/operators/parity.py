"""Parity of what a project declares with what its checks and its code use: CI settings, imports and dependencies."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import distribution_name

# Distributions whose names differ from their modules', and folders that are no part of a package.
DISTRIBUTION_OF = {
    "yaml": "pyyaml", "PIL": "pillow", "cv2": "opencv-python", "sklearn": "scikit-learn", "bs4": "beautifulsoup4", "dateutil": "python-dateutil", "dotenv": "python-dotenv", "jose": "python-jose", "magic": "python-magic",
    "serial": "pyserial",
}
OUTSIDE = "tests test testing docs examples example build dist venv .venv .tox node_modules site-packages __pycache__ .git htmlcov .mypy_cache .pytest_cache .eggs".split()
TOOLS = ["flake8", "black", "isort", "pytest"]
LINE_LENGTH = "79"


def ci_python_versions(kv: DataFrame) -> DataFrame:
    """(path, version) of workflows: the matrix and setup steps."""
    matrix = F.col("key_path").rlike(r"^jobs\.[^.]+\.strategy\.matrix\.python-version(?:\[\d+\])?$")
    step = F.regexp_extract("key_path", r"^(jobs\.[^.]+\.steps\[\d+\])\.", 1)
    setups = kv.where(F.col("key_path").endswith(".uses") & F.contains(F.col("value_str"), F.lit("setup-python")) & (step != "")).select("path", step.alias("step"))
    given = kv.where(F.col("key_path").rlike(r"\.with\.python-version$") & (step != "")).select("path", step.alias("step"), F.col("value_str").alias("version")).join(setups, ["path", "step"], "left_semi")
    return kv.where(matrix).select("path", F.col("value_str").alias("version")).unionByName(given.select("path", "version")).distinct()


def _options(command: Column) -> dict[str, Column]:
    found = lambda pattern: F.nullif(F.regexp_extract(command, pattern, 1), F.lit(""))
    return {"max-line-length": found(r"--max-line-length[=\s]+(\d+)"), "extend-ignore": found(r"--extend-ignore[=\s]+([A-Z0-9,]+)"), "ignore": found(r"--ignore[=\s]+([A-Z0-9,]+)")}


def ci_flake8(kv: DataFrame) -> DataFrame:
    """(path, option, value) of flake8 as workflows run it; the last step that sets an option counts."""
    runs = kv.where(F.col("key_path").rlike(r"^jobs\.[^.]+\.steps\[\d+\]\.run$") & F.contains(F.col("value_str"), F.lit("flake8")))
    found = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("option"), v.alias("value"))) for k, v in _options(F.col("value_str")).items()])
    rows = runs.select("path", "ordinal", F.explode(F.array_compact(found)).alias("f")).select("path", "ordinal", "f.*")
    return rows.groupBy("path", "option").agg(F.max_by("value", "ordinal").alias("value"))


def local_flake8(files: DataFrame) -> DataFrame:
    """(root, option, value) of (root, path, content): `.flake8`, the section of `setup.cfg`, then `pyproject.toml`, later ones counting."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(name == ".flake8", 1).when(name == "setup.cfg", 2).when((name == "pyproject.toml") & F.contains(F.col("content"), F.lit("[tool.flake8]")), 3)
    rows = files.withColumn("rank", rank).where("rank is not null").withColumn("lines", F.split("content", "\n"))
    # The lines of a section: those after its head and before the next one.
    head = F.array_position(F.transform("lines", lambda x: F.trim(x)), "[flake8]")
    after = F.slice("lines", head.cast("int") + 1, F.size("lines"))
    end = F.array_position(F.transform(after, lambda x: F.trim(x).startswith("[")), True)
    section = F.when(head == 0, F.array().cast("array<string>")).when(end == 0, after).otherwise(F.slice(after, 1, F.greatest(end.cast("int") - 1, F.lit(0))))
    lines = rows.select("root", "rank", F.posexplode(F.when(F.col("rank") == 2, section).otherwise(F.col("lines"))).alias("pos", "line"))
    option = F.regexp_extract("line", r"^\s*(max-line-length|extend-ignore|ignore)\s*=", 1)
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"=\s*(.*?)\s*$", 1)), "^[\"']|[\"']$", "")
    set_ = lines.withColumns({"option": option, "value": value}).where("option <> '' and (rank < 3 or option = 'max-line-length')")
    return set_.groupBy("root", "option").agg(F.max_by("value", F.struct("rank", "pos")).alias("value"))


def python_version_parity(ci: DataFrame, local_version: str) -> DataFrame:
    """A row per workflow that names versions, but not the local one."""
    rows = ci.groupBy("path").agg(F.array_sort(F.collect_set("version")).alias("versions")).where(~F.array_contains("versions", local_version))
    return rows.select("path", F.lit("Python Version").alias("category"), F.lit("MEDIUM").alias("severity"), F.lit(local_version).alias("local_value"), F.array_join("versions", ", ").alias("ci_value"))


def tool_parity(workflows: DataFrame, installed: list[str], tools: list[str] = TOOLS) -> DataFrame:
    """A row per workflow and tool that is not among those installed here."""
    missing = F.array(*[F.lit(t) for t in tools if t not in installed]).cast("array<string>")
    rows = workflows.select("path", F.explode(missing).alias("tool"))
    return rows.select("path", F.lit("Tool Installation").alias("category"), F.lit("HIGH").alias("severity"), F.lit("Not installed").alias("local_value"), F.col("tool").alias("ci_value"))


def flake8_parity(ci: DataFrame, local: DataFrame) -> DataFrame:
    """Rows of workflows whose line length is another than the local one, or that ignore codes which are not ignored locally.

    `ci` is (root, path, option, value), `local` is (root, option, value). What is ignored is the extending option, else
    the plain one; the difference is one of sets.
    """
    pick = lambda o: F.max(F.when(F.col("option") == o, F.col("value")))
    wide = lambda df, *keys: df.groupBy(*keys).agg(pick("max-line-length").alias("length"), F.coalesce(pick("extend-ignore"), pick("ignore"), F.lit("")).alias("ignored"))
    here = wide(local, "root").select("root", F.col("length").alias("own_length"), F.col("ignored").alias("own_ignored"))
    rows = wide(ci, "root", "path").join(here, "root", "left").withColumns({"own_length": F.coalesce("own_length", F.lit(LINE_LENGTH)), "own_ignored": F.coalesce("own_ignored", F.lit(""))})
    codes = lambda c: F.split(F.regexp_replace(c, r"\s", ""), ",")
    less = F.array_sort(F.array_except(codes("ignored"), codes("own_ignored")))
    pair = lambda a, b: F.struct(a.alias("local_value"), b.alias("ci_value"))
    found = F.array(
        F.when(F.col("length") != F.col("own_length"), pair(F.concat(F.lit("max-line-length="), "own_length"), F.concat(F.lit("max-line-length="), "length"))),
        F.when((F.col("ignored") != "") & (F.size(less) > 0), pair(F.concat(F.lit("ignore="), F.coalesce(F.nullif("own_ignored", F.lit("")), F.lit("none"))), F.concat(F.lit("missing="), F.array_join(less, ",")))),
    )
    return rows.select("path", F.lit("Flake8 Config").alias("category"), F.lit("HIGH").alias("severity"), F.explode(F.array_compact(found)).alias("f")).select("path", "category", "severity", "f.*")


def by_gravity(issues: DataFrame) -> DataFrame:
    """Parity issues from the gravest to the least."""
    order = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return issues.orderBy(order, "path", "category", "ci_value")


def first_party(files: DataFrame) -> DataFrame:
    """(root, name): packages of a project, folders with an `__init__.py` outside those that belong to none."""
    parts = F.split("path", "/")
    inside = files.where(F.col("path").endswith("/__init__.py") & ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*OUTSIDE)))
    return inside.select("root", F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("name")).distinct()


def undeclared_imports(imports: DataFrame, declared: DataFrame, packages: DataFrame) -> DataFrame:
    """(root, name) of (root, name) imports that neither the standard library, the project nor a declared distribution has.

    A declared distribution of several words also answers for the namespace that is its first. A project that declares
    nothing is not judged.
    """
    alias = F.create_map(*[F.lit(x) for pair in DISTRIBUTION_OF.items() for x in pair])
    used = imports.where(~F.col("name").isin(*sys.stdlib_module_names)).select("root", "name").distinct().join(packages, ["root", "name"], "left_anti")
    judged = used.join(declared.select("root").distinct(), "root", "left_semi").withColumn("dist", distribution_name(F.coalesce(alias[F.col("name")], F.col("name"))))
    names = declared.select("root", distribution_name(F.col("name")).alias("dist"))
    spaces = names.where("dist like '%-%'").select("root", F.element_at(F.split("dist", "-"), 1).alias("name"))
    return judged.join(names.distinct(), ["root", "dist"], "left_anti").join(spaces.distinct(), ["root", "name"], "left_anti").select("root", "name")
