"""Queries over source files and code snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.paths import with_canonical_path
from lintlake.functions.text import lines_of_code
from lintlake.operators import configs, file_rules, findings, masking, python_code, rules, security_lines, similarity, sql_statements
from lintlake.operators.catalog_rules import FAMILIES
from lintlake.session import stored, table
from lintlake.sources.files import EXTENSIONS, detect_language, excluded

SNIPPETS_SQL = "SELECT 'issue/' || issue_id AS path, code_snippet AS content FROM analysis_issues"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "analysis_issues").select(F.concat(F.lit("issue/"), "issue_id").alias("path"), F.col("code_snippet").alias("content"))


def sources(spark: SparkSession, sf_dir: str, *languages: str) -> DataFrame:
    """Source files as (path, content), each path with its file_id in front so that later scans differ; of all languages, and with the language, where none is named."""
    files = table(spark, sf_dir, "source_files")
    rows = files.select(F.concat_ws(":", "file_id", "file_path").alias("path"), "content", detect_language(F.col("file_path")).alias("language"))
    return rows.where(F.col("language").isin(*languages)).select("path", "content") if languages else rows


def _language_sql() -> str:
    name = "lower(regexp_extract(file_path, '([^/]*)$', 1))"
    ext = " ".join(f"WHEN regexp_extract({name}, '\\.([^.]+)$', 1) = '{e}' THEN '{v}'" for e, v in EXTENSIONS.items())
    return f"""CASE WHEN {name} = 'dockerfile' OR starts_with({name}, 'dockerfile.') OR ends_with({name}, '.dockerfile') THEN 'dockerfile' WHEN {name} = 'jenkinsfile' THEN 'groovy'
      WHEN {name} IN ('makefile', 'gnumakefile') THEN 'makefile' WHEN ends_with({name}, '.tf.json') THEN 'terraform' {ext} ELSE 'unknown' END"""


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and lines of code of every file."""
    files = table(spark, sf_dir, "source_files")
    return files.select("file_id", detect_language(F.col("file_path")).alias("language"), lines_of_code(F.col("content")).alias("loc"), excluded(F.col("file_path")).alias("excluded"))


def language_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = file_languages(spark, sf_dir)
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all line families: snippets by every family, source files by those of their language, in one pass each."""
    of_files = rules.findings_of(sources(spark, sf_dir), list(FAMILIES))
    return rules.findings_of(snippets(spark, sf_dir), list(FAMILIES)).unionByName(of_files)


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of findings on snippets and files by severity."""
    return findings.summary(all_findings(spark, sf_dir))


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_rule(all_findings(spark, sf_dir))


def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_cube(all_findings(spark, sf_dir)).withColumns({"issue_type": F.coalesce("issue_type", F.lit("*")), "severity": F.coalesce("severity", F.lit("*"))})


def gate_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.gate(all_findings(spark, sf_dir), "HIGH", ["sql_injection_risk"])


def _family(name: str, of_files: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sources(spark, sf_dir, *FAMILIES[name].languages) if of_files else snippets(spark, sf_dir)
        return rules.line_findings(rows, name)

    return query


def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PowerShell and Groovy rules over whole snippets and files of these languages."""
    found = [rules.content_findings(snippets(spark, sf_dir).unionByName(sources(spark, sf_dir, name)), name) for name in ("powershell", "groovy")]
    return found[0].unionByName(found[1])


def sql_statement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements without WHERE and other dangerous ones, in SQL files and snippets."""
    rows = sources(spark, sf_dir, "sql").unionByName(snippets(spark, sf_dir))
    return sql_statements.statement_findings(sql_statements.statements(rows))


def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of cloud findings masked: counts, digests and size."""
    rows = masking.masked(table(spark, sf_dir, "cloud_findings").select("finding_id", "evidence"), "evidence")
    return rows.select("finding_id", "redaction_count", "original_hash", "masked_hash", "size_bytes", "truncated")


def pii_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that evidence matches as it is, by how many rows."""
    rows = table(spark, sf_dir, "cloud_findings").select(F.explode(masking.residual(F.col("evidence"))).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def _masked_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    steps, last = ["WITH m0 AS (SELECT finding_id, evidence, evidence AS t, 0 AS c FROM cloud_findings)"], "m0"
    for k, p in enumerate(masking.PATTERNS.values(), 1):
        steps.append(f"m{k} AS (SELECT finding_id, evidence, regexp_replace(t, {quote(p)}, '[REDACTED]', 'g') AS t, c + len(regexp_extract_all(t, {quote(p)})) AS c FROM {last})")
        last = f"m{k}"
    return ",\n".join(steps) + f"""
SELECT finding_id, CAST(c AS INTEGER) AS redaction_count, sha256(evidence) AS original_hash, sha256(t) AS masked_hash, CAST(strlen(t) AS INTEGER) AS size_bytes, strlen(t) > 12288 AS truncated FROM {last}"""


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines around the middle line of every file; `issue_windows` cuts those of findings."""
    files = table(spark, sf_dir, "source_files").select("file_id", "content")
    lines = F.size(F.split("content", "\n"))
    w = masking.context_window(F.col("content"), F.greatest(F.floor(lines / 2).cast("int"), F.lit(1)), 5)
    return files.select("file_id", w.alias("w")).select("file_id", F.sha2("w.text", 256).alias("digest"), "w.start_line", "w.end_line")


def issue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lines around each issue's line in its file, a row per issue and file of its repository and canonical path.

    A file is split once for all lines that its issues name, equal lines are cut once. An issue without file, or whose line its
    file does not have, keeps a row without window.
    """
    key = ["repo", "_path"]
    issues = stored(with_canonical_path(table(spark, sf_dir, "analysis_issues").select("issue_id", "repo", "file_path", "line")).select("issue_id", *key, "line"), "issues")
    files = stored(with_canonical_path(table(spark, sf_dir, "source_files").select("file_id", "repo", "file_path", "content")).select("file_id", *key, "content"), "files")
    asked = issues.where("line >= 1").groupBy(*key).agg(F.collect_set("line").alias("lines"))
    parts = files.join(asked, key).select("file_id", *key, F.split("content", "\n").alias("parts"), "lines")
    start = lambda x: F.greatest(x - masking.WINDOW, F.lit(1))
    end = lambda x: F.least(x + masking.WINDOW, F.size("parts"))
    cut = lambda x: F.struct(x.alias("line"), F.sha2(F.array_join(F.slice("parts", start(x), end(x) - start(x) + 1), "\n"), 256).alias("digest"), start(x).alias("start_line"), end(x).alias("end_line"))
    windows = parts.select(*key, "file_id", F.explode(F.transform(F.filter("lines", lambda x: x <= F.size("parts")), cut)).alias("w")).select(*key, "file_id", "w.*")
    found = issues.join(files.select("file_id", *key), key, "left").join(windows, [*key, "file_id", "line"], "left")
    return found.select("issue_id", "file_id", "digest", "start_line", "end_line")


def python_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax-tree nodes of Python files by type."""
    nodes = python_code.ast_nodes(sources(spark, sf_dir, "python"))
    return nodes.groupBy("node_type", "raw_type").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


def python_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.complexity_findings(python_code.definitions(sources(spark, sf_dir, "python")))


def python_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.smell_findings(python_code.definitions(sources(spark, sf_dir, "python")), params_too=True)


def similar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Python files with near duplicates among all functions, with the class of equal ones and the number of links."""
    bodies = python_code.function_bodies(sources(spark, sf_dir, "python")).select(F.concat_ws(":", "path", "name", "line_start").alias("id"), "text")
    return similarity.similar_texts(bodies).withColumn("similarity", F.round("similarity", 6))


def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.fact_findings(python_code.facts(sources(spark, sf_dir, "python")))


def security_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL and shell injections and evals by line, in files of the languages of the secrets."""
    return security_lines.security_findings(sources(spark, sf_dir).where(F.col("language").isin(*FAMILIES["secrets"].languages)))


def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that Python files import, by number of files."""
    rows = python_code.facts(sources(spark, sf_dir, "python")).where("fact = 'import'")
    return rows.groupBy("name").agg(F.count_distinct("path").alias("files"))


def parser_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.parser_failures(python_code.quarantine(sources(spark, sf_dir, "python")))


def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the key paths of JSON, TOML and YAML files."""
    kv = [configs.key_values(sources(spark, sf_dir, kind), kind) for kind in ("json", "toml", "yaml")]
    return configs.config_findings(kv[0].unionByName(kv[1]).unionByName(kv[2]))


def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of TOML files by key and type."""
    kv = configs.key_values(sources(spark, sf_dir, "toml"), "toml")
    return kv.groupBy("key", "value_type").agg(F.count(F.lit(1)).alias("n"))


def workload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template rules over YAML files."""
    kv = configs.key_values(sources(spark, sf_dir, "yaml"), "yaml")
    return configs.template_findings(kv, "helm").unionByName(configs.template_findings(kv, "serverless")).unionByName(configs.template_findings(kv, "cloudformation"))


def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell scripts without safety flags."""
    return file_rules.missing_safety_flags(sources(spark, sf_dir, "shell"))


def image_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dockerfiles that never leave the root user."""
    return file_rules.image_users(sources(spark, sf_dir, "dockerfile"))


def indentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML files with more than three widths of indentation."""
    return file_rules.uneven_indentation(sources(spark, sf_dir, "yaml"))


def yaml_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML files that do not parse."""
    return file_rules.yaml_errors(sources(spark, sf_dir, "yaml"))


def _files_of(name: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in FAMILIES[name].languages)
    return f"SELECT path, content FROM ({_FILES_SQL}) WHERE language IN ({kinds})"


def _all_sql() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({rules.line_findings_sql(name, files)})" for name in FAMILIES for files in (SNIPPETS_SQL, _files_of(name)))


_FILES_SQL = f"SELECT file_id || ':' || file_path AS path, content, {_language_sql()} AS language FROM source_files"
QUERIES = {
    "file_languages": file_languages,
    "language_totals": language_totals,
    "findings_summary": findings_summary,
    "findings_by_rule": findings_by_rule,
    "findings_cube": findings_cube,
    "gate_high": gate_high,
    **{f"rules_{n}_snippets": _family(n, False) for n in FAMILIES},
    **{f"rules_{n}_files": _family(n, True) for n in FAMILIES},
    "rules_secrets_all_files": _family("secrets", True),
    "content_rules": content_rules,
    "sql_statement_rules": sql_statement_rules,
    "pii_masked": pii_masked,
    "pii_residual": pii_residual,
    "context_windows": context_windows,
    "issue_windows": issue_windows,
    "python_nodes": python_nodes,
    "python_complexity": python_complexity,
    "python_smells": python_smells,
    "python_facts": python_facts,
    "similar_functions": similar_functions,
    "security_files": security_files,
    "python_imports": python_imports,
    "parser_quarantine": parser_quarantine,
    "config_rules": config_rules,
    "config_keys": config_keys,
    "workload_rules": workload_rules,
    "safety_flags": safety_flags,
    "image_users": image_users,
    "indentation": indentation,
    "yaml_errors": yaml_errors,
}

_LOC_SQL = "CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*[^\\s#]'))) AS INTEGER)"
_EXCLUDED_SQL = " OR ".join(f"contains(file_path, '{p}')" for p in [".venv/", "venv/", ".tox/", "node_modules/", ".git/", "__pycache__/", "dist/", "build/", ".mypy_cache/", ".pytest_cache/", ".eggs/", ".egg-info/"])
SQL = {
    "file_languages": f"SELECT file_id, {_language_sql()} AS language, {_LOC_SQL} AS loc, {_EXCLUDED_SQL} AS excluded FROM source_files",
    "language_totals": f"SELECT language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT {_language_sql()} AS language, {_LOC_SQL} AS loc FROM source_files) GROUP BY 1",
    "findings_summary": f"""SELECT count(*) AS total_issues, count(*) FILTER (severity = 'CRITICAL') AS critical_issues, count(*) FILTER (severity = 'HIGH') AS high_issues, count(*) FILTER (severity = 'MEDIUM') AS medium_issues,
      count(*) FILTER (severity = 'LOW') AS low_issues, count(DISTINCT path) AS files_with_issues FROM ({_all_sql()})""",
    "findings_by_rule": f"SELECT rule_id, severity, count(*) AS n, min(line) AS first_line FROM ({_all_sql()}) GROUP BY 1, 2",
    "findings_cube": f"SELECT coalesce(issue_type, '*') AS issue_type, coalesce(severity, '*') AS severity, count(*) AS n FROM ({_all_sql()}) GROUP BY CUBE (issue_type, severity)",
    "gate_high": f"SELECT count(*) > 0 AS blocked, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM ({_all_sql()}) WHERE issue_type <> 'SQL_INJECTION_RISK' AND severity IN ('HIGH', 'CRITICAL')",
    **{f"rules_{n}_snippets": rules.line_findings_sql(n, SNIPPETS_SQL) for n in FAMILIES},
    **{f"rules_{n}_files": rules.line_findings_sql(n, _files_of(n)) for n in FAMILIES},
    "rules_secrets_all_files": rules.line_findings_sql("secrets", _files_of("secrets")),
    "pii_masked": _masked_sql(),
    "pii_residual": " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) AS n FROM cloud_findings WHERE regexp_matches(evidence, '{p.replace(chr(39), chr(39) * 2)}') HAVING count(*) > 0" for n, p in masking.PATTERNS.items()),
    "safety_flags": f"""SELECT path, 1 AS line, 'SHELL_MISSING_SAFETY' AS issue_type, 'MEDIUM' AS severity FROM (SELECT path, string_split(content, chr(10)) AS p FROM ({_FILES_SQL}) WHERE language = 'shell')
      WHERE len(p) > 10 AND regexp_matches(p[1], '^#!.*\\b(?:ba)?sh\\b') AND len(list_filter(p[1:20], lambda x: regexp_matches(x, '^\\s*set\\s+-\\w*[euo]'))) = 0""",
    "image_users": f"""WITH x AS (SELECT path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM ({_FILES_SQL}) WHERE language = 'dockerfile'),
      u AS (SELECT path, bool_or(regexp_matches(t, '(?i)^\\s*FROM\\s+\\S+')) AS f, max_by(regexp_extract(t, '(?i)^\\s*USER\\s+(\\S+)', 1), n) FILTER (regexp_matches(t, '(?i)^\\s*USER\\s+\\S+')) AS u FROM x GROUP BY path)
      SELECT path, CASE WHEN u IS NULL THEN 'DOCKER001' ELSE 'DOCKER004' END AS rule_id, CASE WHEN u IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM u WHERE f AND (u IS NULL OR lower(string_split(u, ':')[1]) IN ('root', '0'))""",
    "indentation": f"""WITH x AS (SELECT path, unnest(string_split(content, chr(10))) AS t FROM ({_FILES_SQL}) WHERE language = 'yaml')
      SELECT path, count(DISTINCT length(regexp_extract(t, '^( +)', 1))) AS widths FROM x WHERE regexp_matches(t, '^ +[^ #]') GROUP BY path HAVING count(DISTINCT length(regexp_extract(t, '^( +)', 1))) > 3""",
    "context_windows": """WITH s AS (SELECT file_id, string_split(content, chr(10)) AS p FROM source_files), m AS (SELECT file_id, p, greatest(len(p) // 2, 1) AS line FROM s),
      w AS (SELECT file_id, p, greatest(line - 5, 1) AS a, least(line + 5, len(p)) AS b FROM m)
      SELECT file_id, sha256(array_to_string(p[a:b], chr(10))) AS digest, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM w""",
}
