"""Files as rows: discovery, language detection, explicit lists, JSON lines, and a guard for paths."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import lines_of_code

# Parts of paths left out, and what decides a file's language: its name, its extension, its first line.
EXCLUDES = [".venv/", "venv/", ".tox/", "node_modules/", ".git/", "__pycache__/", "dist/", "build/", ".mypy_cache/", ".pytest_cache/", ".eggs/", ".egg-info/"]
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go", "rs": "rust", "cs": "csharp", "yml": "yaml",
    "yaml": "yaml", "tf": "terraform", "tfvars": "terraform", "sh": "shell", "bash": "shell", "sql": "sql", "cbl": "cobol", "cob": "cobol", "cpy": "cobol", "pco": "cobol", "json": "json", "toml": "toml", "ps1": "powershell",
    "groovy": "groovy", "mk": "makefile",
}
NAMES = {"dockerfile": "dockerfile", "jenkinsfile": "groovy", "makefile": "makefile", "gnumakefile": "makefile"}


def detect_language(path: Column, content: Column | None = None) -> Column:
    """By exact name, then name pattern, then extension, then the shebang; `unknown` otherwise and for a null path."""
    name = F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1))
    exact = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[name]
    pattern = F.when(name.rlike(r"^dockerfile\.|\.dockerfile$"), "dockerfile").when(name.endswith(".tf.json"), "terraform")
    extension = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.regexp_extract(name, r"\.([^.]+)$", 1)]
    tries = [exact, pattern, extension]
    if content is not None:
        first = F.substring_index(content, "\n", 1)
        tries.append(F.when(first.rlike(r"^#!.*\b(?:ba|da|z|k)?sh\b"), "shell").when(first.rlike(r"^#!.*\bpython"), "python"))
    return F.coalesce(*tries, F.lit("unknown"))


def excluded(path: Column, patterns: list[str] = EXCLUDES) -> Column:
    """Whether a path holds one of the patterns anywhere."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.contains(p)
    return hit


def scan(spark: SparkSession, root: str, exclude: list[str] = (), glob: str | None = None) -> DataFrame:
    """(path, content, language, loc) of all text files under a root; excluded ones are not read, empty ones have no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root).where(~excluded(F.col("path"), EXCLUDES + list(exclude)))
    text = rows.select("path", F.decode("content", "UTF-8").alias("content"))
    return text.withColumn("language", detect_language(F.col("path"), F.col("content"))).withColumn("loc", lines_of_code(F.col("content")))


def explicit(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files of a list; paths that are not there are skipped, no exclusion applies."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines under a schema; `bad` holds lines that are no object of it. Blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.from_json("value", f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def write_json_lines(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Append rows as JSON lines, a bounded number in a file."""
    rows.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def under_root(path: str, root: str) -> Path:
    """The resolved path, which must lie under the root."""
    whole, base = Path(os.path.realpath(path)), Path(os.path.realpath(root))
    if whole != base and base not in whole.parents:
        raise ValueError(f"{path} is not under {root}")
    return whole


def git_diff(repository: str, base: str, head: str) -> str:
    """The unified diff of two revisions, taken on the driver."""
    import subprocess

    return subprocess.run(["git", "diff", "--no-color", "--no-ext-diff", f"{base}...{head}"], cwd=repository, capture_output=True, text=True, check=True).stdout


# External linters a language may have, the higher priority first.
PROVIDERS = [("yaml", "yamllint", 100, True), ("terraform", "tflint", 100, True), ("terraform", "tfsec", 90, True), ("terraform", "checkov", 80, False), ("shell", "shellcheck", 100, True), ("dockerfile", "hadolint", 100, True), ("sql", "sqlfluff", 100, True)]


def providers(spark: SparkSession, mode: str = "auto", allow: list[str] = (), deny: list[str] = ()) -> DataFrame:
    """(language, provider, priority) of the providers that apply, by priority; none in mode `internal`."""
    rows = spark.createDataFrame(PROVIDERS, "language string, provider string, priority int, enabled boolean")
    kept = rows.where("false" if mode == "internal" else "enabled")
    if allow:
        kept = kept.where(F.col("provider").isin(list(allow)))
    if deny:
        kept = kept.where(~F.col("provider").isin(list(deny)))
    return kept.drop("enabled").orderBy("language", F.desc("priority"))
