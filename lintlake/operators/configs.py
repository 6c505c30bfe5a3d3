"""Configuration documents as key paths, and the rules over them: JSON, TOML, YAML and infrastructure templates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import spread

KV = "path string, key string, key_path string, value_type string, value_str string, depth int, ordinal int"
# Parts of keys that hold secrets, keys that hold addresses, flags that are dangerous with a value.
SECRET_KEYS = "password passwd pwd secret api_key apikey api-key token access_token auth_token client_secret private_key credential auth bearer".split()
URL_KEYS = "url endpoint api_url base_url server host webhook callback repository source".split()
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
DANGEROUS_FLAGS = [
    ("insecure", "true"), ("skip_tls_verify", "true"), ("skipTlsVerify", "true"), ("verify", "false"), ("verify_ssl", "false"), ("ssl_verify", "false"), ("allow_insecure", "true"),
    ("allowInsecure", "true"), ("disable_ssl", "true"), ("disableSsl", "true"), ("NODE_TLS_REJECT_UNAUTHORIZED", "0"),
]
# Values that are secrets for sure, and parts of names that suggest one.
CRITICAL_VALUES = [("AWS Access Key ID", r"AKIA[0-9A-Z]{16}"), ("Private Key", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"), ("Slack Token", r"(?i)xox[baprs]-[0-9A-Za-z-]{10,}"), ("GitHub Token", r"(?i)ghp_[0-9A-Za-z]{30,}"), ("Google API Key", r"(?i)AIza[0-9A-Za-z\-_]{30,}")]
SUSPICIOUS_NAMES = "password passwd pwd secret secretkey secret_key token api_key apikey access_key accesskey private_key privatekey client_secret clientsecret masteruserpassword db_password dbpassword".split()
SENSITIVE_PORTS = (22, 23, 3389, 5432, 3306, 6379, 27017)
# Security settings of workloads that are bad with a value, and how bad.
WORKLOAD_FLAGS = [("hostPID", "true", "HIGH"), ("hostIPC", "true", "HIGH"), ("hostNetwork", "true", "HIGH"), ("privileged", "true", "CRITICAL"), ("allowPrivilegeEscalation", "true", "MEDIUM"), ("runAsUser", "0", "HIGH")]


def _walk(path: str, value, key: str, key_path: str, depth: int, out: list) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _walk(path, v, str(k), f"{key_path}.{k}" if key_path else str(k), depth + 1, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _walk(path, v, key, f"{key_path}[{i}]", depth + 1, out)
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        out.append((path, key, key_path, kind, text, depth, len(out)))


def load(text: str, kind: str):
    """A document parsed; ValueError when it is none. Intrinsic tags of templates become {tag: value}."""
    if kind == "json":
        return json.loads(text)
    if kind == "toml":
        import tomllib

        return tomllib.loads(text)
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def tagged(loader, suffix, node):
        value = loader.construct_scalar(node) if isinstance(node, yaml.ScalarNode) else loader.construct_sequence(node, True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, True)
        return {("Ref" if suffix == "Ref" else f"Fn::{suffix}"): value}

    Loader.add_multi_constructor("!", tagged)
    try:
        return yaml.load(text, Loader)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def key_values(files: DataFrame, kind: str) -> DataFrame:
    """A row per leaf of (path, content) documents; documents that do not parse, and null ones, have none."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list = []
            for path, text in zip(batch["path"], batch["content"]):
                own: list = []
                try:
                    _walk(path, load(text, kind) if text else None, "", "", 0, own)
                except (ValueError, RecursionError, TypeError):
                    continue
                rows += [r for r in own if r[1] or r[2]]
            yield pd.DataFrame(rows, columns=["path", "key", "key_path", "value_type", "value_str", "depth", "ordinal"])

    return spread(files.select("path", "content")).mapInPandas(look, KV)


def unparsable(files: DataFrame, kind: str) -> DataFrame:
    """(path, error) of documents that are not null and do not parse; nothing of a scan is lost without a row."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                try:
                    load(text, kind) if text else None
                except (ValueError, RecursionError, TypeError) as e:
                    rows.append((path, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return spread(files.select("path", "content")).mapInPandas(look, "path string, error string")


def fallback_findings(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity, confidence): secrets by expression in JSON documents that do not parse."""
    # The expression of a secret's key and value.
    pair = r'(?i)"(?:password|api_?key|token|secret|credential)"\s*:\s*"([^"]+)"'
    bad = files.join(errors.select("path").distinct(), "path", "left_semi").where(F.col("content").rlike(pair))
    whole = F.regexp_extract_all("content", F.lit(f"({pair})".replace("(?i)", "", 1).replace('("', '((?i)"', 1)), F.lit(1))
    between = F.transform(F.split("content", pair), lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))
    rows = bad.select("path", F.monotonically_increasing_id().alias("_file"), F.posexplode(F.arrays_zip(between.alias("b"), whole.alias("m"))).alias("nth", "x")).select("path", "_file", "nth", F.col("x.b").alias("before"), F.col("x.m").alias("m")).where("m is not null")
    own = F.length("m") - F.length(F.replace("m", F.lit("\n"), F.lit("")))
    upto = Window.partitionBy("_file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("own", own).withColumn("line", (F.sum(F.col("before") + F.col("own")).over(upto) - F.col("own") + 1).cast("int"))
    literal = ~F.regexp_extract("m", pair, 1).rlike(r"^[$<]")
    return placed.where(literal).select("path", "line", F.lit("J001").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit(0.7).alias("confidence"))


def unparsable(files: DataFrame, kind: str) -> DataFrame:
    """(path, error) of documents that are not null and do not parse; nothing of a scan is lost without a row."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                try:
                    load(text, kind) if text else None
                except (ValueError, RecursionError, TypeError) as e:
                    rows.append((path, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return spread(files.select("path", "content")).mapInPandas(look, "path string, error string")


# The expression of a secret's key and value in a document that does not parse.
FALLBACK = r'(?i)"(?:password|api_?key|token|secret|credential)"\s*:\s*"([^"]+)"'


def fallback_findings(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity, confidence): secrets by expression in documents that do not parse."""
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    bad = files.join(errors.select("path").distinct(), "path", "left_semi").where(F.col("content").rlike(FALLBACK))
    found = F.arrays_zip(F.split("content", FALLBACK).alias("before"), F.regexp_extract_all("content", F.lit(FALLBACK), F.lit(0)).alias("m"))
    rows = bad.select("path", F.monotonically_increasing_id().alias("_file"), F.posexplode(found).alias("nth", "x")).select("path", "_file", "nth", "x.before", "x.m").where("m is not null")
    upto = Window.partitionBy("_file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    line = F.sum(breaks(F.col("before")) + breaks(F.col("m"))).over(upto) - breaks(F.col("m")) + 1
    literal = ~F.regexp_extract("m", FALLBACK, 1).rlike(r"^[$<]")
    return rows.withColumn("line", line.cast("int")).where(literal).select("path", "line", F.lit("J001").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit(0.7).alias("confidence"))


def _any(c: Column, words) -> Column:
    return F.lower(c).rlike("|".join(w.replace("-", r"\-").lower() for w in words))


def hardcoded(value: Column) -> Column:
    """Whether a value is no reference or template."""
    return ~F.trim(value).rlike(r"^\$|\$\{|\{\{|^\[.*\]$|^!(?:Ref|Sub|Join|GetAtt)|^<.*>$") & (F.length(F.trim(value)) > 0)


def config_findings(kv: DataFrame) -> DataFrame:
    """(path, key_path, rule_id, severity, confidence): secrets under secret keys, plain addresses, dangerous flags, registry logins."""
    v, k = F.col("value_str"), F.col("key")
    text = F.col("value_type") == "string"
    flags = F.lit(False)
    for name, bad in DANGEROUS_FLAGS:
        flags = flags | ((k == name) & (F.lower(v) == bad))
    local = F.lit(False)
    for host in LOCAL_HOSTS:
        local = local | v.startswith(f"http://{host}")
    rule = lambda test, rule_id, severity, confidence: F.when(test, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    found = F.array(
        rule(text & _any(k, SECRET_KEYS) & (v != "") & ~v.rlike(r"^\$|^<.*>$|^\{\{.*\}\}$"), "CFG001", "CRITICAL", 0.90),
        rule(text & _any(k, URL_KEYS) & v.startswith("http://") & ~local, "CFG002", "MEDIUM", 0.85),
        rule(F.col("key_path").rlike(r"^auths\..*\.auth$") & text, "CFG004", "CRITICAL", 0.95),
        rule(flags, "CFG005", "HIGH", 0.92),
    )
    return kv.select("path", "key_path", F.explode(F.array_compact(found)).alias("f")).select("path", "key_path", "f.*")


def critical_values(value: Column) -> Column:
    """The kinds of secrets a value certainly holds."""
    return F.array_compact(F.array(*[F.when(value.rlike(p), F.lit(n)) for n, p in CRITICAL_VALUES]))


def template_findings(kv: DataFrame, platform: str) -> DataFrame:
    """(path, key_path, rule_id, severity) over key paths of infrastructure templates.

    platform: cloudformation, arm, helm or serverless. Where a critical value is found its key's rule is silent, but in
    cloudformation, where both report.
    """
    v, k, p = F.col("value_str"), F.col("key"), F.col("key_path")
    text = F.col("value_type") == "string"
    critical = text & (F.size(critical_values(v)) > 0)
    suspicious = _any(k, SUSPICIOUS_NAMES) & text & hardcoded(v)
    f = lambda test, rule_id, severity: F.when(test, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity")))
    if platform == "cloudformation":
        name = F.regexp_extract(p, r"^Parameters\.([^.]+)\.Default$", 1)
        found = [f((name != "") & text & _any(name, SUSPICIOUS_NAMES), "CFN_PARAM_DEFAULT", "HIGH"), f(p.startswith("Resources.") & suspicious, "CFN_PROPERTY_SECRET", "CRITICAL"), f(p.startswith("Resources.") & critical, "CFN_CRITICAL_VALUE", "CRITICAL")]
    elif platform == "arm":
        name = F.regexp_extract(p, r"^parameters\.([^.]+)\.defaultValue$", 1)
        kind = F.regexp_extract(p, r"^parameters\.([^.]+)\.type$", 1)
        found = [
            f((name != "") & _any(name, SUSPICIOUS_NAMES), "ARM_PARAM_DEFAULT", "HIGH"),
            f((kind != "") & _any(kind, SUSPICIOUS_NAMES) & (F.lower(v) == "string"), "ARM_PARAM_NOT_SECURE", "MEDIUM"),
            F.coalesce(f(p.startswith("resources") & critical, "ARM_CRITICAL_VALUE", "CRITICAL"), f(p.startswith("resources") & suspicious, "ARM_PROPERTY_SECRET", "CRITICAL")),
            f(p.startswith("resources") & (k == "allowBlobPublicAccess") & (v == "true"), "ARM_PUBLIC_BLOB", "HIGH"),
            f(p.rlike(r"networkAcls\.defaultAction$") & (v == "Allow"), "ARM_OPEN_NETWORK", "MEDIUM"),
        ]
    elif platform == "helm":
        found = [F.coalesce(f(critical, "HELM_CRITICAL_VALUE", "CRITICAL"), f(suspicious, "HELM_SECRET", "HIGH"))]
        found += [f((k == key) & (F.lower(v) == bad), f"HELM_{key.upper()}", severity) for key, bad, severity in WORKLOAD_FLAGS]
        found += [f(p.rlike(r"loadBalancerSourceRanges\[\d+\]$") & v.isin("0.0.0.0/0", "::/0"), "HELM_PUBLIC_RANGE", "HIGH")]
    else:
        env = p.rlike(r"^(?:provider|functions\.[^.]+)\.environment\.")
        found = [F.coalesce(f(env & critical, "SLS_CRITICAL_VALUE", "CRITICAL"), f(env & suspicious, "SLS_SECRET", "HIGH"))]
    return kv.select("path", "key_path", F.explode(F.array_compact(F.array(*found))).alias("f")).select("path", "key_path", "f.*")


def open_ingress(kv: DataFrame) -> DataFrame:
    """(path, rule_path, severity): ingress rules open to the world on a sensitive port or on all, one row per rule.

    Works on cloudformation key paths; ports that are no integers are never sensitive, protocol -1 is all ports.
    """
    rules = kv.withColumn("rule_path", F.regexp_extract("key_path", r"^(Resources\..*?(?:SecurityGroupIngress(?:\[\d+\])?|\.Properties))\.(?:IpProtocol|FromPort|ToPort|CidrIp|CidrIpv6)$", 1)).where("rule_path <> ''")
    pick = lambda name: F.max(F.when(F.col("key") == name, F.col("value_str")))
    rows = rules.groupBy("path", "rule_path").agg(pick("IpProtocol").alias("proto"), pick("FromPort").alias("a"), pick("ToPort").alias("b"), pick("CidrIp").alias("c4"), pick("CidrIpv6").alias("c6"))
    a, b = F.col("a").try_cast("int"), F.coalesce(F.col("b").try_cast("int"), F.col("a").try_cast("int"))
    sensitive = F.lit(False)
    for port in SENSITIVE_PORTS:
        sensitive = sensitive | ((a <= port) & (b >= port))
    from lintlake.operators.file_rules import public_network

    # Only rules with a bad port or protocol are left for the test of their networks.
    asked = rows.where((F.col("proto") == "-1") | sensitive).withColumns({"c4": F.coalesce("c4", F.lit("")), "c6": F.coalesce("c6", F.lit(""))})
    return asked.where(public_network("c4") | public_network("c6")).select("path", "rule_path", F.lit("CRITICAL").alias("severity"))


def template_edges(kv: DataFrame) -> DataFrame:
    """(template, src, dst, kind): references between resources of cloudformation templates, to known resources only."""
    src = F.regexp_extract("key_path", r"^Resources\.([^.]+)\.", 1)
    names = kv.select("path", src.alias("name")).where("name <> ''").distinct()
    ref = F.when(F.col("key") == "Ref", F.col("value_str"))
    att = F.when((F.col("key") == "Fn::GetAtt") & ~F.col("key_path").rlike(r"\[[1-9]\d*\]$"), F.regexp_extract("value_str", r"^([^.]+)", 1))
    edges = kv.select(F.col("path").alias("template"), src.alias("src"), F.coalesce(ref, att).alias("dst"), F.when(ref.isNotNull(), "Ref").otherwise("GetAtt").alias("kind")).where("src <> '' and dst is not null")
    return edges.join(names, (edges["template"] == names["path"]) & (edges["dst"] == names["name"]), "left_semi").distinct()
