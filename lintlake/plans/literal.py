"""Queries of operators whose inputs the tables do not have, over small corpora written out here, with the expected rows as SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import cloud, cobol, configs, diffs, drift, findings, masking, parity, python_code, rules, security_lines
from lintlake.plans import analysis


def _ingress(proto: str, a, b, cidr: str) -> dict:
    return {"IpProtocol": proto, "FromPort": a, "ToPort": b, "CidrIp": cidr}


TEMPLATE = {
    "Parameters": {"DbPassword": {"Type": "String", "Default": "hunter2hunter2"}, "ApiToken": {"Type": "String", "NoEcho": True}, "Name": {"Type": "String"}},
    "Resources": {
        "Open": {"Type": "AWS::EC2::SecurityGroup", "Properties": {"SecurityGroupIngress": [_ingress("tcp", 20, 25, "8.8.8.0/24"), _ingress("tcp", 443, 443, "0.0.0.0/0"), _ingress("tcp", 22, 22, "10.0.0.0/8")]}},
        "World": {"Type": "AWS::EC2::SecurityGroupIngress", "Properties": {"IpProtocol": "-1", "CidrIpv6": "::/0"}},
        "Computed": {"Type": "AWS::EC2::SecurityGroup", "Properties": {"SecurityGroupIngress": [_ingress("tcp", {"Ref": "Port"}, 1, "10.0.0.0/8")]}},
        "Bare": {"Type": "AWS::S3::Bucket", "Properties": {"BucketName": "b"}},
        "Half": {"Type": "AWS::S3::Bucket", "Properties": {"PublicAccessBlockConfiguration": {"BlockPublicAcls": True, "IgnorePublicAcls": "true", "BlockPublicPolicy": False, "RestrictPublicBuckets": False}}},
        "Shut": {"Type": "AWS::S3::Bucket", "Properties": {"PublicAccessBlockConfiguration": {k: True for k in cloud.BUCKET_FLAGS}}},
        "Every": {"Type": "AWS::IAM::Policy", "Properties": {"PolicyDocument": {"Statement": [{"Effect": "Allow", "Action": ["s3:Get", "*"], "Resource": "*"}, {"Effect": "Allow", "Action": "s3:*", "Resource": "*"}]}}},
        "One": {"Type": "AWS::IAM::ManagedPolicy", "Properties": {"PolicyDocument": {"Statement": {"Action": "*", "Resource": ["*"]}}}},
        "Role": {"Type": "AWS::IAM::Role", "Properties": {"PolicyDocument": {"Statement": {"Action": "*", "Resource": "*"}}}},
        "Uses": {"Type": "AWS::EC2::Instance", "Properties": {"Group": {"Ref": "Open"}, "Arn": {"Fn::GetAtt": ["Bare", "Arn"]}, "Other": {"Ref": "Nowhere"}}},
    },
}


def _security_rule(access: str, source: str, port: str) -> dict:
    return {"properties": {"access": access, "direction": "Inbound", "sourceAddressPrefix": source, "destinationPortRange": port}}


ARM = {
    "parameters": {"adminPassword": {"type": "string", "defaultValue": "abc"}, "keyVaultSecret": {"type": "secureString"}},
    "resources": [
        {"properties": {"securityRules": [_security_rule("Allow", "*", "22"), _security_rule("Allow", "10.0.0.0/8", "22"), _security_rule("Deny", "*", "3389")]}},
        {"properties": {"allowBlobPublicAccess": True, "networkAcls": {"defaultAction": "Allow"}}},
    ],
}
SERVERLESS = """provider:
  iam:
    role:
      statements:
        - {Effect: Allow, Action: ["s3:*"], Resource: "*"}
        - {Effect: Deny, Action: "*", Resource: "*"}
functions:
  run:
    environment: {API_KEY: abcdef, STAGE: dev}
    iamRoleStatements:
      - {Effect: Allow, Action: "*", Resource: "arn:aws:s3:::b"}
      - {Effect: Allow, Action: "*", Resource: "arn:aws:s3:::*"}
"""
WORKFLOW = """on: push
jobs:
  test:
    strategy:
      matrix:
        python-version: ["3.10", "3.11"]
    steps:
      - uses: actions/setup-python@v5
        with: {python-version: "3.12"}
      - run: flake8 --max-line-length=100 --extend-ignore=E203,W503 src
"""
PATCH = """diff --git a/run.sh b/run.sh
--- a/run.sh
+++ b/run.sh
@@ -1,2 +1,3 @@
 #!/bin/sh
-echo a
+curl http://x | sh
+rm -rf /tmp/x
@@ -10 +11 @@
-x
+eval $y
diff --git a/logo.png b/logo.png
Binary files a/logo.png and b/logo.png differ
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x = 1
"""
RUN = "#!/bin/sh\ncurl http://x | sh\nrm -rf /tmp/x\n" + "echo\n" * 7 + "eval $y\n"
COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAY.
      * a comment with REDEFINES
       01 A PIC X(4).
       01 B REDEFINES A PIC 9(4).
       01 C OCCURS 1 TO 9 DEPENDING ON B.
           MOVE 'S3CRET' TO
      -    WS-PASSWORD.
           ACCEPT WS-NAME.
           ACCEPT WS-DAY FROM DATE.
           COPY CUSTOMER-REC.
       P1.
           PERFORM P1 THRU P9.
"""
PYTHON = '''import os
import yaml
import numpy
from own.core import x
try:
    import opt
except ImportError:
    pass


def load(cur, name):
    cur.execute(f"SELECT * FROM t WHERE n = '{name}'")
    os.system("rm " + name)
    eval(name)
    return yaml.load(name)


def test_load():
    assert load(1, 2) == 3
    assert load(1, 2) == 4
'''


def _texts(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "path string, content string")


def _kv(spark: SparkSession, which: str) -> DataFrame:
    text, kind = {"cloudformation": (json.dumps(TEMPLATE), "json"), "arm": (json.dumps(ARM), "json"), "serverless": (SERVERLESS, "yaml"), "workflow": (WORKFLOW, "yaml")}[which]
    return configs.key_values(_texts(spark, (which, text)), kind)


def insecure_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, policies, parameters, network rules and statements of one template of each kind."""
    out = cloud.insecure_defaults(_kv(spark, "cloudformation"), "cloudformation")
    return out.unionByName(cloud.insecure_defaults(_kv(spark, "arm"), "arm")).unionByName(cloud.insecure_defaults(_kv(spark, "serverless"), "serverless"))


def template_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [configs.template_findings(_kv(spark, kind), kind) for kind in ("cloudformation", "arm", "serverless")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def open_ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.open_ingress(_kv(spark, "cloudformation"))


def template_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.template_edges(_kv(spark, "cloudformation"))


def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against actual rules, and what could not be compared."""
    expected = cloud.expected_rules(_kv(spark, "cloudformation"))
    mapping = spark.createDataFrame([("cloudformation", "Open", "sg-1")], "path string, logical_id string, physical_id string")
    rows = [("Open", "tcp", 443, 443, "0.0.0.0/0", None, None), ("Open", "tcp", 20, 25, "8.8.8.0/24", None, None), ("Open", "tcp", 80, 80, "0.0.0.0/0", None, None)]
    actual = spark.createDataFrame(rows, "logical_id string, proto string, from_port int, to_port int, cidr4 string, cidr6 string, src_sg string")
    found = drift.rule_drift(expected.where("not partial"), actual)
    named = found.select(F.lit("cloudformation").alias("path"), F.concat(F.lit("DRIFT_"), "drift").alias("rule_id"), "severity", F.concat_ws(" ", "logical_id", "from_port", "cidr4").alias("detail"))
    return named.unionByName(cloud.drift_states(expected, True, mapping))


def drift_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = cloud.expected_rules(_kv(spark, "cloudformation"))
    states = cloud.drift_states(expected, False, None).unionByName(cloud.drift_states(expected, True, None))
    gate = cloud.drift_gate(states, "MEDIUM").select(F.lit("gate").alias("path"), F.col("exit_code").cast("string").alias("rule_id"), F.lit("").alias("severity"), F.lit("").alias("detail"))
    return states.unionByName(gate)


def ci_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, tools and flake8 settings of a workflow against those of its project."""
    kv = _kv(spark, "workflow")
    own = [(".", ".flake8", "[flake8]\nmax-line-length = 88\n"), (".", "setup.cfg", "[metadata]\nignore = X1\n[flake8]\nextend-ignore = E203\n[other]\nignore = Y1\n")]
    local = parity.local_flake8(spark.createDataFrame(own, "root string, path string, content string"))
    issues = parity.python_version_parity(parity.ci_python_versions(kv), "3.13")
    issues = issues.unionByName(parity.tool_parity(kv.select("path").distinct(), ["flake8", "black", "pytest"]))
    return parity.by_gravity(issues.unionByName(parity.flake8_parity(parity.ci_flake8(kv).withColumn("root", F.lit(".")), local)))


def undeclared_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = python_code.facts(_texts(spark, ("a.py", PYTHON))).where("fact = 'import'").select(F.lit(".").alias("root"), "name")
    packages = parity.first_party(spark.createDataFrame([(".", "own/core/__init__.py"), (".", "tests/numpy/__init__.py")], "root string, path string"))
    declared = drift.declared_requirements(_texts(spark, ("requirements.txt", "PyYAML>=6\nrequests\n"))).select(F.lit(".").alias("root"), "name")
    return parity.undeclared_imports(imports, declared, packages)


def _patch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, PATCH)], "diff_id int, body string")


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_lines(_patch(spark))


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_files(_patch(spark)).select("path", "is_binary", "is_deleted", "hunks", "added")


def review_of_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis of the files of a patch, findings on its lines."""
    rows = analysis.review(_texts(spark, ("run.sh", RUN), ("other.sh", RUN)), _patch(spark))
    return rows.select("file", "line", "rule_id", "severity", "in_hunk")


def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole analysis with one analyzer that fails and one of the project."""
    registry = analysis.standard()
    registry.register("broken", lambda files: files.select("no such column"))
    ends = lambda files: files.where(~F.col("content").endswith("\n") & (F.col("content") != ""))
    registry.register_project("ends", lambda files: ends(files).select("path", F.lit(1).alias("line"), F.lit("PRJ1").alias("rule_id"), F.lit("NO_END").alias("issue_type"), F.lit("LOW").alias("severity")))
    run = analysis.analyze(_texts(spark, ("run.sh", RUN), ("a.py", PYTHON), ("b.txt", "no end"), ("n.py", "")), registry)
    out = analysis.report(run, "CRITICAL")
    return out.select("total_issues", "critical_issues", "high_issues", "files_with_issues", "files_analyzed", "blocked", "exit_code", F.to_json("failures").alias("failures"))


def cobol_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cobol.findings(cobol.logical_lines(_texts(spark, ("pay.cbl", COBOL), ("x.cpy", COBOL)))).select("path", "line", "rule_id", "severity")


def cobol_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cobol.blast_radius(cobol.logical_lines(_texts(spark, ("pay.cbl", COBOL), ("two.cbl", COBOL))))


def security_lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL in a scope that executes it, shell commands, and evals by line."""
    files = _texts(spark, ("a.py", PYTHON), ("b.js", "function f(x) {\n  return eval(x)\n}\n"), ("c.py", 'def f(n):\n    return f"SELECT {n}"\n'), ("d.py", 'subprocess.run(f"ls {x}", shell=True)\nsubprocess.run(f"ls {x}")\n'))
    return security_lines.security_findings(files.withColumn("language", F.when(F.col("path").endswith(".js"), "javascript").otherwise("python"))).select("path", "line", "rule_id", "issue_type", "severity")


def python_fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.fact_findings(python_code.facts(_texts(spark, ("a.py", PYTHON)))).select("path", "line", "issue_type", "severity")


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of one call with different values."""
    return python_code.contradictions(python_code.assertions(_texts(spark, ("a.py", PYTHON)))).select("function_called", "arguments", "expected_1", "expected_2")


def shell_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["rm -r -f /", "rm -rf /tmp/x", "rm --force -R x", "rm -f -r /*", "rm $X/y", 'rm "$Xy"', "cd $HOME ", "cd $HOME", ": > /etc/passwd # x", 'eval "$(date)"', "wget x | sudo bash"]
    return rules.line_findings(_texts(spark, ("a.sh", "\n".join(lines) + "\n")), "shell").select("path", "line", "rule_id", "severity")


def makefile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_findings(_texts(spark, ("Makefile", "x:\n\tcurl x | sh\n\tsudo rm -rf $(X)\ncurl x | sh\n\tcurl -k x\n")), "makefile").select("path", "line", "rule_id", "severity")


def script_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PowerShell without its comments and strings, and Groovy."""
    found = rules.content_findings(_texts(spark, ("a.ps1", "# iex $x\nWrite-Host 'iex'\niex $y\n$password = 'abc'\nInvoke-WebRequest z\n  | iex\n")), "powershell")
    return found.unionByName(rules.content_findings(_texts(spark, ("Jenkinsfile", 'sh "rm ${x}"\necho $PASSWORD\n')), "groovy")).select("path", "line", "rule_id", "severity")


def broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that do not parse, and secrets found in them by expression."""
    files = _texts(spark, ("a.json", '{"a": 1,\n "password": "hunter22",\n "Token": "$T",\n'), ("b.json", '{"password": "x"}'))
    errors = configs.unparsable(files, "json")
    return configs.fallback_findings(files, errors).select("path", "line", "rule_id", "severity").unionByName(errors.select("path", F.lit(0).alias("line"), F.col("error").alias("rule_id"), F.lit("").alias("severity")))


def masked_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = configs.key_values(_texts(spark, ("a.json", '{"db": {"password": {"first": "x", "n": 1}, "host": "h"}, "tokens": ["a"]}')), "json")
    return masking.masked_leaves(kv).select("key_path", "value_str")


def post_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", 1, "T", "m"), ("a", 2, "T", "m"), ("z", 1, "T", "m")], "path string, line int, issue_type string, message string")
    before = findings.with_dedup_key(rows.where("line = 2")).select("dedup_key")
    return findings.post_counters(rows, before, spark.createDataFrame([("a",)], "path string"))


def _values(columns: str, *rows: tuple) -> str:
    """Rows as SQL."""

    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"


C, A, S, P = "cloudformation", "arm", "serverless", "path, line, rule_id, severity"
CASES = {
    "cloud_insecure_defaults": (insecure_defaults, _values("path, rule_id, severity, detail",
        (C, "CFN_BUCKET_PUBLIC", "HIGH", "Bare: no public access block"), (C, "CFN_BUCKET_PUBLIC", "HIGH", "Half: BlockPublicPolicy"), (C, "CFN_POLICY_OPEN", "CRITICAL", "Every: Statement[0]"), (C, "CFN_POLICY_OPEN", "CRITICAL", "One: Statement"),
        (C, "CFN_PARAM_ECHO", "MEDIUM", "DbPassword"), (A, "ARM_NETWORK_OPEN", "CRITICAL", "resources[0].properties.securityRules[0].properties:22"), (S, "SLS_STATEMENT_OPEN", "CRITICAL", "provider.iam.role.statements[0]"),
        (S, "SLS_STATEMENT_OPEN", "CRITICAL", "functions.run.iamRoleStatements[1]"))),
    "cloud_template_secrets": (template_secrets, _values("path, key_path, rule_id, severity",
        (C, "Parameters.DbPassword.Default", "CFN_PARAM_DEFAULT", "HIGH"), (A, "parameters.adminPassword.defaultValue", "ARM_PARAM_DEFAULT", "HIGH"), (A, "parameters.adminPassword.type", "ARM_PARAM_NOT_SECURE", "MEDIUM"),
        (A, "resources[1].properties.allowBlobPublicAccess", "ARM_PUBLIC_BLOB", "HIGH"), (A, "resources[1].properties.networkAcls.defaultAction", "ARM_OPEN_NETWORK", "MEDIUM"), (S, "functions.run.environment.API_KEY", "SLS_SECRET", "HIGH"))),
    "cloud_open_ingress": (open_ingress, _values("path, rule_path, severity", (C, "Resources.Open.Properties.SecurityGroupIngress[0]", "CRITICAL"), (C, "Resources.World.Properties", "CRITICAL"))),
    "cloud_template_edges": (template_edges, _values("template, src, dst, kind", (C, "Uses", "Open", "Ref"), (C, "Uses", "Bare", "GetAtt"))),
    "drift_check": (drift_check, _values("path, rule_id, severity, detail", (C, "DRIFT_MISSING", "HIGH", "Open 22 10.0.0.0/8"), (C, "DRIFT_UNEXPECTED", "CRITICAL", "Open 80 0.0.0.0/0"), (C, "DRIFT_PARTIAL", "MEDIUM", "Computed"))),
    "drift_skipped": (drift_skipped, _values("path, rule_id, severity, detail",
        (C, "DRIFT_PARTIAL", "MEDIUM", "Computed"), (C, "DRIFT_PARTIAL", "MEDIUM", "Computed"), (C, "DRIFT_AUTH_SKIPPED", "MEDIUM", "no credentials"), (C, "DRIFT_MAP_SKIPPED", "MEDIUM", "no mapping of ids"), ("gate", "2", "", ""))),
    "ci_parity": (ci_parity, _values("path, category, severity, local_value, ci_value",
        ("workflow", "Flake8 Config", "HIGH", "ignore=E203", "missing=W503"), ("workflow", "Flake8 Config", "HIGH", "max-line-length=88", "max-line-length=100"), ("workflow", "Tool Installation", "HIGH", "Not installed", "isort"),
        ("workflow", "Python Version", "MEDIUM", "3.13", "3.10, 3.11, 3.12"))),
    "undeclared_imports": (undeclared_imports, _values("root, name", (".", "numpy"))),
    "diff_rows": (diff_rows, _values("diff_id, path, hunk, new_line", (1, "run.sh", 1, 2), (1, "run.sh", 1, 3), (1, "run.sh", 2, 11))),
    "diff_files": (diff_files, _values("path, is_binary, is_deleted, hunks, added", ("run.sh", False, False, 2, 3), ("logo.png", True, False, 0, 0), ("gone.py", False, True, 1, 0))),
    "review_of_patch": (review_of_patch, _values("file, line, rule_id, severity, in_hunk", ("run.sh", 2, "SH_RCE1", "CRITICAL", True), ("run.sh", 11, "SH_EVAL3", "HIGH", True))),
    "analysis_report": (analysis_report, _values("total_issues, critical_issues, high_issues, files_with_issues, files_analyzed, blocked, exit_code, failures",
        (8, 2, 2, 3, 4, True, 1, '[{"analyzer":"broken","stage":"file","error":"AnalysisException"}]'))),
    "cobol_findings": (cobol_findings, _values(P,
        ("pay.cbl", 5, "COB004", "HIGH"), ("pay.cbl", 6, "COB005", "MEDIUM"), ("pay.cbl", 7, "COB002", "CRITICAL"), ("pay.cbl", 9, "COB003", "MEDIUM"), ("pay.cbl", 11, "COB007", "CRITICAL"), ("pay.cbl", 13, "COB006", "HIGH"))),
    "cobol_blast_radius": (cobol_blast_radius, _values("copybook, programs", ("CUSTOMER-REC", 2))),
    "security_lines": (security_lines_of, _values("path, line, rule_id, issue_type, severity",
        ("a.py", 12, "SEC02", "SQL_INJECTION_RISK", "HIGH"), ("a.py", 13, "SEC04", "COMMAND_INJECTION", "HIGH"), ("b.js", 2, "SEC05", "EVAL_USAGE", "CRITICAL"), ("d.py", 1, "SEC04", "COMMAND_INJECTION", "HIGH"))),
    "python_fact_rules": (python_fact_rules, _values("path, line, issue_type, severity", ("a.py", 14, "EVAL_USAGE", "CRITICAL"), ("a.py", 19, "ASSERT_IN_PRODUCTION", "MEDIUM"), ("a.py", 20, "ASSERT_IN_PRODUCTION", "MEDIUM"))),
    "expectations": (expectations, _values("function_called, arguments, expected_1, expected_2", ("load", "1, 2", "3", "4"))),
    "shell_rules": (shell_rules, _values(P,
        ("a.sh", 1, "SH_RM1", "CRITICAL"), ("a.sh", 4, "SH_RM2", "CRITICAL"), ("a.sh", 5, "SH_RMVAR", "MEDIUM"), ("a.sh", 6, "SH_RMVAR", "MEDIUM"), ("a.sh", 7, "SH_CDVAR", "MEDIUM"), ("a.sh", 9, "SH_TRUNC", "CRITICAL"), ("a.sh", 10, "SH_EVAL1", "HIGH"), ("a.sh", 11, "SH_RCE4", "CRITICAL"))),
    "makefile_rules": (makefile_rules, _values(P,
        ("Makefile", 2, "MF002", "CRITICAL"), ("Makefile", 2, "MF002", "CRITICAL"), ("Makefile", 3, "MF003", "MEDIUM"), ("Makefile", 3, "MF005", "HIGH"), ("Makefile", 5, "MF004", "HIGH"))),
    "script_rules": (script_rules, _values(P,
        ("a.ps1", 3, "PS001", "CRITICAL"), ("a.ps1", 4, "PS004", "CRITICAL"), ("a.ps1", 6, "PS001", "CRITICAL"), ("a.ps1", 5, "PS002", "CRITICAL"), ("Jenkinsfile", 1, "GJ001", "HIGH"), ("Jenkinsfile", 2, "GJ003", "CRITICAL"))),
    "broken_json": (broken_json, _values(P, ("a.json", 2, "J001", "CRITICAL"), ("a.json", 0, "JSONDecodeError", ""))),
    "masked_document": (masked_document, _values("key_path, value_str", ("db.password.first", "[REDACTED]"), ("db.password.n", "[REDACTED]"), ("db.host", "h"), ("tokens[0]", "[REDACTED]"))),
    "post_counters": (post_counters, _values("posted, failed, skipped", (1, 1, 1))),
}
QUERIES = {name: query for name, (query, _) in CASES.items()}
SQL = {name: sql for name, (_, sql) in CASES.items()}
