"""Key and payload relations.  Every value is a function of the row number and a seed, so that
results do not depend on partitioning and a lost partition is made again as it was."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import relation_name, write_relation

R_SEED, S_SEED = 12345, 54321


def uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    hashed = F.xxhash64(F.lit(seed), *columns)
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A repeatable random order (a range-partitioned sort on a hash)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)


def primary_keys(spark: SparkSession, n: int, seed: int = R_SEED) -> DataFrame:
    """Keys 1..n, each once, in random order; payload is the key."""
    return shuffled(spark.range(1, n + 1).select(F.col("id").alias("key"), F.col("id").alias("payload")), seed)


def foreign_keys(spark: SparkSession, n: int, largest: int, seed: int = S_SEED) -> DataFrame:
    """n rows with keys 1..largest repeated in turn, in random order; payload is the row number."""
    return shuffled(spark.range(n).select((F.col("id") % largest + 1).alias("key"), F.col("id").alias("payload")), seed)


def replicated(relation: DataFrame, n: int, size: int, seed: int = S_SEED) -> DataFrame:
    """n rows from a relation of ``size`` rows, repeated whole as often as needed and then cut, in random order.

    The last copy is cut in order of a hash: by bucket, whole ones first, so that no task holds all of it.
    """
    copies = math.ceil(n / size)
    rows = relation.select("key", "payload", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    buckets = max(64, size // 100_000)
    whole = relation.select("key", "payload").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "payload"), F.lit(buckets)))
    sizes = whole.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "payload"))
    last = whole.withColumn("place", place).join(sizes, "bucket").filter(F.col("before") + F.col("place") <= n - size * (copies - 1))
    return shuffled(rows.filter(F.col("copy") < copies - 1).drop("copy").unionByName(last.select("key", "payload")), seed)


def nonunique_keys(spark: SparkSession, n: int, largest: int, seed: int = R_SEED) -> DataFrame:
    """Uniform keys in [0, largest); payload is the row number."""
    return spark.range(n).select(F.floor(uniform(seed, "id") * largest).alias("key"), F.col("id").alias("payload"))


def zipf_keys(spark: SparkSession, n: int, largest: int, exponent: float, seed: int = S_SEED) -> DataFrame:
    """n keys of 1..largest, rank r with weight r^-exponent, over a permuted alphabet; payload is the row number.

    Inverse transform over the exact table of cumulative weights: ranks and draws are dealt into buckets
    of the unit interval, and a window over each bucket gives every draw the last rank that begins before it.
    """
    if exponent == 0:
        return nonunique_keys(spark, n, largest, seed).select((F.col("key") + 1).alias("key"), "payload")
    buckets = max(1024, n // 100_000)
    ranks = spark.range(1, largest + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-float(exponent))).alias("weight"))
    block = F.floor((F.col("rank") - 1) / 4096)
    inside = Window.partitionBy("block").orderBy("rank")
    ranks = ranks.withColumn("block", block).withColumn("through", F.sum("weight").over(inside))
    sums = ranks.groupBy("block").agg(F.max("through").alias("total"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("base"), F.sum("total").over(everything).alias("all"))
    limits = ranks.join(sums, "block").select("rank", ((F.col("base") + F.col("through") - F.col("weight")) / F.col("all")).alias("low"), ((F.col("base") + F.col("through")) / F.col("all")).alias("high"))
    least = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("int")
    table = limits.withColumn("bucket", F.explode(F.sequence(least(F.col("low")), least(F.col("high")))))
    begins = table.select("bucket", F.col("low").alias("at"), "rank", F.lit(None).cast("long").alias("payload"))
    draws = spark.range(n).select(F.col("id").alias("payload"), uniform(seed, "id").alias("at"))
    draws = draws.select(least(F.col("at")).alias("bucket"), "at", F.lit(None).cast("long").alias("rank"), "payload")
    before = Window.partitionBy("bucket").orderBy("at", F.col("rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    best = begins.unionByName(draws).withColumn("rank", F.last("rank", ignorenulls=True).over(before)).filter(F.col("payload").isNotNull())
    step = _coprime(largest)
    return best.select((F.pmod(F.col("rank") * step + seed, F.lit(largest)) + 1).alias("key"), "payload")


def _coprime(n: int) -> int:
    """A multiplier near the golden section that permutes 0..n-1."""
    step = max(1, int(n * 0.6180339887))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def write_generated(spark: SparkSession, folder: str, side: str, n: int, largest: int | None = None, skew: float = 0.0, binary: bool = False) -> str:
    """Generates a relation and writes it under its name; gives the path.

    Side r: unique keys, or Zipf keys over 1..n if skewed.  Side s: keys of 1..largest, uniform in turn or Zipf.
    """
    if side == "r":
        rows = zipf_keys(spark, n, n, skew, R_SEED) if skew else primary_keys(spark, n)
    else:
        rows = zipf_keys(spark, n, largest or n, skew, S_SEED) if skew else foreign_keys(spark, n, largest or n)
    path = f"{folder}/{relation_name(side, skew, n, largest if side == 's' else None)}"
    write_relation(rows, path, binary)
    return path
