"""Insecure settings of infrastructure templates, over key paths (see `configs.key_values`), and states of a drift check.

Rows are grouped by template and resource, or by template and statement or rule, which are small; templates are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.configs import SENSITIVE_PORTS, SUSPICIOUS_NAMES
from lintlake.operators.file_rules import public_network

# The settings that keep a bucket private, in the order they are looked at; types of policies; keys of rules.
BUCKET_FLAGS = ["BlockPublicAcls", "IgnorePublicAcls", "BlockPublicPolicy", "RestrictPublicBuckets"]
POLICY_TYPES = ["AWS::IAM::Policy", "AWS::IAM::ManagedPolicy"]
RULE_KEYS = ["IpProtocol", "FromPort", "ToPort", "CidrIp", "CidrIpv6", "SourceSecurityGroupId"]


def wildcard(value: Column) -> Column:
    """Whether a permission is `*` or ends in `:*`; null is none."""
    v = F.trim(value)
    return F.coalesce((v == "*") | v.endswith(":*"), F.lit(False))


def _pick(test: Column) -> Column:
    return F.max(F.when(test, F.col("value_str")))


def _found(rows: DataFrame, rule_id: str, severity: str, detail: Column) -> DataFrame:
    return rows.select("path", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), detail.alias("detail"))


def public_buckets(kv: DataFrame) -> DataFrame:
    """Buckets without a public access block, or with the first of its settings that is not true."""
    rows = kv.withColumns({"name": F.regexp_extract("key_path", r"^Resources\.([^.]+)\.", 1), "rest": F.regexp_extract("key_path", r"^Resources\.[^.]+\.(.*)$", 1)}).where("name <> ''")
    block = "Properties.PublicAccessBlockConfiguration"
    flags = [_pick(F.col("rest") == f"{block}.{k}").alias(k) for k in BUCKET_FLAGS]
    buckets = rows.groupBy("path", "name").agg(_pick(F.col("rest") == "Type").alias("type"), F.bool_or(F.col("rest").startswith(f"{block}.")).alias("has"), *flags).where("type = 'AWS::S3::Bucket'")
    off = F.coalesce(*[F.when(F.coalesce(F.lower(k), F.lit("")) != "true", F.lit(k)) for k in BUCKET_FLAGS])
    detail = F.when(~F.col("has"), F.concat("name", F.lit(": no public access block"))).when(off.isNotNull(), F.concat("name", F.lit(": "), off))
    return _found(buckets.withColumn("detail", detail).where("detail is not null"), "CFN_BUCKET_PUBLIC", "HIGH", F.col("detail"))


def open_policies(kv: DataFrame) -> DataFrame:
    """Statements of policies that allow every action on every resource; a statement may be a list's or the only one."""
    statement = r"^Resources\.([^.]+)\.Properties\.PolicyDocument\.(Statement(?:\[\d+\])?)\.(Action|Resource)(?:\[\d+\])?$"
    of = lambda k: F.regexp_extract("key_path", statement, k)
    types = kv.where(F.col("key_path").rlike(r"^Resources\.[^.]+\.Type$") & F.col("value_str").isin(POLICY_TYPES)).select("path", F.regexp_extract("key_path", r"^Resources\.([^.]+)\.", 1).alias("name"))
    stars = kv.where((F.col("value_str") == "*") & (of(1) != "")).groupBy("path", of(1).alias("name"), of(2).alias("statement")).agg(F.count_distinct(of(3)).alias("n")).where("n = 2")
    return _found(stars.join(types, ["path", "name"], "left_semi"), "CFN_POLICY_OPEN", "CRITICAL", F.concat_ws(": ", "name", "statement"))


def unmasked_parameters(kv: DataFrame) -> DataFrame:
    """Parameters whose names suggest a secret and that are not kept from output."""
    rows = kv.withColumn("name", F.regexp_extract("key_path", r"^Parameters\.([^.]+)\.", 1)).where("name <> ''").groupBy("path", "name").agg(_pick(F.col("key_path").rlike(r"^Parameters\.[^.]+\.NoEcho$")).alias("hidden"))
    suspicious = F.lower("name").rlike("|".join(SUSPICIOUS_NAMES))
    return _found(rows.where(suspicious & (F.coalesce(F.lower("hidden"), F.lit("")) != "true")), "CFN_PARAM_ECHO", "MEDIUM", F.col("name"))


def open_network_rules(kv: DataFrame) -> DataFrame:
    """Inbound rules of network security groups that let everybody in to a sensitive port."""
    rule = F.regexp_extract("key_path", r"^(resources.*securityRules\[\d+\]\.properties)\.\w+$", 1)
    rows = kv.withColumn("rule", rule).where("rule <> ''").groupBy("path", "rule").agg(*[_pick(F.col("key") == k).alias(k) for k in ("access", "direction", "sourceAddressPrefix", "destinationPortRange")])
    rows = rows.where((F.col("access") == "Allow") & (F.col("direction") == "Inbound") & F.col("destinationPortRange").try_cast("int").isin(*SENSITIVE_PORTS))
    return _found(rows.where(public_network("sourceAddressPrefix")), "ARM_NETWORK_OPEN", "CRITICAL", F.concat_ws(":", "rule", "destinationPortRange"))


def open_statements(kv: DataFrame) -> DataFrame:
    """Statements of serverless roles, of the provider or a function, that allow wildcard actions on wildcard resources."""
    place = r"^(provider\.iam\.role\.statements\[\d+\]|functions\.[^.]+\.iamRoleStatements\[\d+\])\.(Effect|Action|Resource)(?:\[\d+\])?$"
    of = lambda k: F.regexp_extract("key_path", place, k)
    broad = lambda k: F.bool_or((of(2) == k) & wildcard(F.col("value_str")))
    rows = kv.where(of(1) != "").groupBy("path", of(1).alias("statement")).agg(_pick(of(2) == "Effect").alias("effect"), broad("Action").alias("every_action"), broad("Resource").alias("every_resource"))
    return _found(rows.where("effect = 'Allow' and every_action and every_resource"), "SLS_STATEMENT_OPEN", "CRITICAL", F.col("statement"))


def insecure_defaults(kv: DataFrame, platform: str) -> DataFrame:
    """(path, rule_id, severity, detail) of all rules of a platform: cloudformation, arm or serverless."""
    rules = {"cloudformation": [public_buckets, open_policies, unmasked_parameters], "arm": [open_network_rules], "serverless": [open_statements]}[platform]
    out = rules[0](kv)
    for rule in rules[1:]:
        out = out.unionByName(rule(kv))
    return out


def expected_rules(kv: DataFrame) -> DataFrame:
    """(path, logical_id, proto, from_port, to_port, cidr4, cidr6, src_sg, partial) of declared ingress.

    A security group whose ingress uses functions or references can't be compared: it gives one row with `partial` true.
    """
    part = lambda pattern: F.regexp_extract("key_path", pattern, 1)
    rows = kv.where(F.col("key_path").rlike(r"^Resources\.[^.]+\.(?:Type$|Properties\.SecurityGroupIngress)")).withColumns(
        {"logical_id": part(r"^Resources\.([^.]+)\."), "entry": part(r"SecurityGroupIngress\[(\d+)\]"), "leaf": part(r"SecurityGroupIngress\[\d+\]\.(.+)$")}
    )
    groups = rows.where("key_path like '%.Type' and value_str = 'AWS::EC2::SecurityGroup'").select("path", "logical_id")
    entries = rows.where("key_path not like '%.Type'").join(groups, ["path", "logical_id"], "left_semi")
    computed = (F.col("entry") == "") | F.col("leaf").contains(".") | F.col("leaf").rlike(r"^(?:Ref|Fn::)")
    partial = entries.groupBy("path", "logical_id").agg(F.bool_or(computed).alias("partial"))
    plain = entries.join(partial.where("not partial"), ["path", "logical_id"], "left_semi").groupBy("path", "logical_id", "entry").agg(*[_pick(F.col("leaf") == k).alias(k) for k in RULE_KEYS])
    every = F.coalesce(F.col("IpProtocol"), F.lit("-1")) == "-1"
    port = lambda c: F.when(every, F.lit(-1)).otherwise(F.coalesce(F.col(c).try_cast("int"), F.lit(-1)))
    out = plain.select(
        "path", "logical_id", F.coalesce("IpProtocol", F.lit("-1")).alias("proto"), port("FromPort").alias("from_port"), port("ToPort").alias("to_port"),
        F.col("CidrIp").alias("cidr4"), F.col("CidrIpv6").alias("cidr6"), F.col("SourceSecurityGroupId").alias("src_sg"), F.lit(False).alias("partial"),
    )
    return out.distinct().unionByName(partial.where("partial"), allowMissingColumns=True)


def drift_states(expected: DataFrame, has_credentials: bool, mapping: DataFrame | None) -> DataFrame:
    """(path, rule_id, severity, detail): what of a drift check could not be done, and why.

    Without credentials, or without a mapping of ids, templates with a group that could be compared are skipped.
    """
    partial = _found(expected.where("partial"), "DRIFT_PARTIAL", "MEDIUM", F.col("logical_id"))
    whole = expected.where("not partial").select("path").distinct()
    if not has_credentials:
        return partial.unionByName(_found(whole, "DRIFT_AUTH_SKIPPED", "MEDIUM", F.lit("no credentials")))
    if mapping is None:
        return partial.unionByName(_found(whole, "DRIFT_MAP_SKIPPED", "MEDIUM", F.lit("no mapping of ids")))
    unmapped = whole.join(mapping.where("physical_id is not null").select("path").distinct(), "path", "left_anti")
    return partial.unionByName(_found(unmapped, "DRIFT_MAP_SKIPPED", "MEDIUM", F.lit("no mapping of ids")))


def drift_summary(mapping: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per template: resolved resources and findings."""
    resolved = mapping.where("physical_id is not null").groupBy("path").agg(F.count_distinct("logical_id").alias("resolved_resources"))
    counts = findings.groupBy("path").agg(F.count(F.lit(1)).alias("findings"))
    return resolved.join(counts, "path", "full_outer").select("path", F.coalesce("resolved_resources", F.lit(0)).alias("resolved_resources"), F.coalesce("findings", F.lit(0)).alias("findings"))


def drift_gate(findings: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """One row (blocked, exit_code): 2 where a drift finding is at or above `fail_on`."""
    from lintlake.operators.findings import gate

    return gate(findings.withColumn("issue_type", F.col("rule_id")), fail_on).select("blocked", F.when(F.col("blocked"), 2).otherwise(0).alias("exit_code"))
