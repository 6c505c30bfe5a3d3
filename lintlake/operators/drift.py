"""Differences between what is declared and what is there: rule tuples, name resolution, project parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import distribution_name, spec_name

RULE = ["logical_id", "proto", "from_port", "to_port", "cidr4", "cidr6", "src_sg"]


def normal_rules(rules: DataFrame) -> DataFrame:
    """Rule tuples in one form: all protocols means all ports, ports that are no integers are -1."""
    every = F.col("proto").isin("-1", "all")
    port = lambda c: F.when(every, F.lit(-1)).otherwise(F.coalesce(F.col(c).try_cast("int"), F.lit(-1)))
    return rules.withColumns({"proto": F.when(every, "-1").otherwise(F.lower("proto")), "from_port": port("from_port"), "to_port": port("to_port")}).select(*RULE)


def rule_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """MISSING rules of the declaration and UNEXPECTED ones of reality, nulls being equal to nulls."""
    missing = expected.select(*RULE).subtract(actual.select(*RULE)).withColumn("drift", F.lit("MISSING")).withColumn("severity", F.lit("HIGH"))
    world = (F.col("cidr4") == "0.0.0.0/0") | (F.col("cidr6") == "::/0")
    extra = actual.select(*RULE).subtract(expected.select(*RULE)).withColumn("drift", F.lit("UNEXPECTED")).withColumn("severity", F.when(F.coalesce(world, F.lit(False)), "CRITICAL").otherwise("HIGH"))
    return missing.unionByName(extra)


def not_found(mapping: DataFrame, actual_ids: DataFrame) -> DataFrame:
    """Mapped logical ids whose physical id is not there; ids without a mapping are left out."""
    return mapping.where("physical_id is not null").join(actual_ids.select("physical_id").distinct(), "physical_id", "left_anti").select("logical_id", "physical_id", F.lit("NOT_FOUND").alias("drift"), F.lit("HIGH").alias("severity"))


def resolve(stack: DataFrame, tag: DataFrame, name: DataFrame) -> DataFrame:
    """(logical_id, physical_id): the stack's answer, else the tag's, else the name's where that is the only one."""
    single = name.groupBy("logical_id").agg(F.count(F.lit(1)).alias("n"), F.min("physical_id").alias("p3")).where("n = 1").drop("n")
    one = lambda df, c: df.groupBy("logical_id").agg(F.min("physical_id").alias(c))
    return one(stack, "p1").join(one(tag, "p2"), "logical_id", "full_outer").join(single, "logical_id", "full_outer").select("logical_id", F.coalesce("p1", "p2", "p3").alias("physical_id"))


def undeclared(used: DataFrame, *known: DataFrame) -> DataFrame:
    """Names used and in none of the known tables."""
    for k in known:
        used = used.join(k.select("name").where("name is not null").distinct(), "name", "left_anti")
    return used.distinct()


def declared_requirements(files: DataFrame) -> DataFrame:
    """(path, name): normal names of the requirements in requirements files and project tables."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("text"))
    text = F.when(F.col("path").endswith(".toml"), F.regexp_extract("text", r"^\s*\"([A-Za-z0-9][^\"]*)\"\s*,?\s*$", 1)).otherwise(F.col("text"))
    return lines.where(~F.col("text").rlike(r"^\s*(?:#|-|$|\[)")).select("path", distribution_name(spec_name(text)).alias("name")).where("name <> ''").distinct()


def unmentioned(scripts: DataFrame, readme: DataFrame) -> DataFrame:
    """Entry points a README names in no fenced block and no inline code; a name counts as a whole word."""
    words = readme.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(```.*?```|`[^`\n]+`)"), F.lit(1))).alias("code")).select(F.explode(F.split("code", r"[^\w\-]+")).alias("name")).distinct()
    return scripts.join(words, "name", "left_anti")


def version_mismatches(texts: DataFrame, pattern: str, version: str) -> DataFrame:
    """(path, found): every version a pattern's group finds that is another than the project's."""
    return texts.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("found")).where(F.col("found") != version)


def unreferenced_inputs(inputs: DataFrame, script: DataFrame) -> DataFrame:
    """Inputs whose variable no word of the script is: an equal join on words, not a search per pair."""
    words = script.select(F.explode(F.split("content", r"\W+")).alias("variable")).distinct()
    return inputs.withColumn("variable", F.concat(F.lit("INPUT_"), F.upper(F.regexp_replace("name", "-", "_")))).join(words, "variable", "left_anti").select("name")


def missing_sources(dockerfile: DataFrame, files: DataFrame) -> DataFrame:
    """COPY sources that are no file or folder of the corpus; flags, globs, variables and paths outside are left out."""
    copies = dockerfile.select(F.explode(F.split("content", "\n")).alias("t")).where(F.col("t").rlike(r"(?i)^\s*COPY\s"))
    args = F.filter(F.split(F.trim(F.regexp_replace("t", r"(?i)^\s*COPY\s+", "")), r"\s+"), lambda x: ~x.startswith("--"))
    sources = copies.select(F.explode(F.slice(args, 1, F.greatest(F.size(args) - 1, F.lit(0)))).alias("source")).where(~F.col("source").rlike(r"[*?$]|^/|\.\.|^\.$"))
    sources = sources.withColumn("source", F.regexp_replace("source", r"^\./|/$", "")).distinct()
    parts = files.select(F.split("path", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice(F.col("p"), 1, i), "/"))).alias("source")).distinct()
    return sources.join(parts, "source", "left_anti")


def capability_parity(declared: DataFrame, discovered: DataFrame) -> DataFrame:
    """Kinds whose declared number is another than the number of modules found."""
    found = discovered.groupBy("kind").agg(F.count(F.lit(1)).alias("found"))
    rows = declared.join(found, "kind", "full_outer").select("kind", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found"))
    return rows.where("declared <> found")


def banned(lines: DataFrame, identifiers: list[str]) -> DataFrame:
    """Lines that hold a banned identifier; the list is a parameter and goes into the plan."""
    hit = F.array_compact(F.array(*[F.when(F.col("text").contains(i), F.lit(i)) for i in identifiers]))
    return lines.select("path", "line", F.explode(hit).alias("identifier"))


def first_workflow(files: DataFrame) -> DataFrame:
    """The CI workflow of a repository: tests, test, ci, main, else the first by name."""
    name = F.regexp_extract("path", r"\.github/workflows/([^/]+\.ya?ml)$", 1)
    order = F.array_position(F.array(*map(F.lit, ["tests.yml", "test.yml", "ci.yml", "main.yml"])), name)
    rows = files.where(name != "").withColumn("rank", F.struct(F.when(order > 0, order).otherwise(F.lit(99)).alias("o"), name.alias("n")))
    return rows.groupBy("repo").agg(F.min_by("path", "rank").alias("path"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key, ties going to the greatest of the further columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
