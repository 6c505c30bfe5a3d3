"""Problem 3: exact percentiles of very large numeric columns per group, in a form that can be combined.

Values are first counted per group and value with map-side aggregation (`value_counts`); such counts of separate days
or partitions are combined by adding them up (`combine`), so a percentile of any union is exact: its error bound is 0
and is reported as such. `from_counts` then sorts the counts over the cluster: a range partitioning by group and value
splits a hot group like any other, every partition counts its rows per group, running sums of those counts give the
offset of every (partition, group), and the target positions are located by offset plus the running count inside the
partition. Neighbouring order statistics are interpolated as in the usual continuous percentile.

Null values and NaN are left out; a group without values has no row. Null keys are groups of their own, ties are
counted, infinite values are ordered like others. An empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import materialise

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The combinable form: (keys, value, n)."""
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def combine(counts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The counts of a union of the counts' sources."""
    whole = reduce(DataFrame.unionByName, counts)
    return whole.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def from_counts(counts: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(keys, n_values, min_value, max_value, percentile, estimate, error_bound), a row per group and percentile."""
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (
        counts.repartitionByRange(parts, *keys, "value")
        .sortWithinPartitions(*keys, "value")
        .withColumn("part", F.spark_partition_id())
    )
    ordered = materialise(ordered)
    per_part = ordered.groupBy(*keys, "part").agg(F.sum("n").alias("part_n"), F.min("value").alias("low"), F.max("value").alias("high"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys,
        "part",
        F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("offset"),
        F.sum("part_n").over(group).alias("n_values"),
        F.min("low").over(group).alias("min_value"),
        F.max("high").over(group).alias("max_value"),
    )
    inside = Window.partitionBy("part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumn("upto", F.sum("n").over(inside))
    on = [ranked["part"] == offsets["part"]] + [ranked[k].eqNullSafe(offsets[k]) for k in keys]
    placed = ranked.join(offsets, on).select(
        *[ranked[k] for k in keys], "n_values", "min_value", "max_value", "value", (F.col("offset") + F.col("upto") - F.col("n")).alias("first"), (F.col("offset") + F.col("upto") - 1).alias("last")
    )
    wanted = F.array(*[F.lit(float(p)) for p in percentiles])
    target = lambda p: p * (F.col("n_values") - 1)
    touched = F.filter(wanted, lambda p: (F.floor(target(p)) <= F.col("last")) & (F.ceil(target(p)) >= F.col("first")))
    at = F.col("percentile") * (F.col("n_values") - 1)
    hits = placed.where(F.size(touched) > 0).withColumn("percentile", F.explode(touched))
    below = F.max(F.when((F.floor(at) >= F.col("first")) & (F.floor(at) <= F.col("last")), F.col("value").cast("double")))
    above = F.max(F.when((F.ceil(at) >= F.col("first")) & (F.ceil(at) <= F.col("last")), F.col("value").cast("double")))
    out = hits.groupBy(*keys, "n_values", "percentile").agg(below.alias("below"), above.alias("above"), F.first("min_value").alias("min_value"), F.first("max_value").alias("max_value"))
    share = at - F.floor(at)
    return out.select(
        *keys, "n_values", "min_value", "max_value", "percentile", F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * share).alias("estimate"), F.lit(0.0).alias("error_bound")
    )


def canonical_command(column: str):
    """A command name with its spellings made equal."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.col(column))), r"[_\s]+", "-"), F.lit(""))


def canonical_version(column: str):
    """A version number without its prefixes and build part."""
    return F.nullif(F.regexp_extract(F.col(column), r"(\d+(?:\.\d+)*)", 1), F.lit(""))
