"""Scan, select, project, joins, aggregation and result operators.

Joins carry no broadcast hints for sides that grow with the data: the optimizer broadcasts a side
whose size it has checked, and adaptive execution splits skewed partitions of the others.  ``fixed_side``
broadcasts a table of constant size (regions, nations).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import all_of


def scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the used columns; the reader prunes the rest."""
    return df.select(*columns)


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    """Conjunction of predicates."""
    return df.filter(all_of(*conditions))


def project(df: DataFrame, **expressions: Column) -> DataFrame:
    return df.select(*(e.alias(n) for n, e in expressions.items()))


def fixed_side(df: DataFrame) -> DataFrame:
    """For tables whose size does not grow with the data."""
    return F.broadcast(df)


def hash_join(probe: DataFrame, build: DataFrame, probe_keys: Sequence[str], build_keys: Sequence[str] | None = None) -> DataFrame:
    """Inner equi-join on one or more keys; every match counts."""
    pairs = list(zip(probe_keys, build_keys or probe_keys))
    return probe.join(build, [probe[p] == build[b] for p, b in pairs], "inner")


def semi_join(probe: DataFrame, build: DataFrame, probe_keys: Sequence[str], build_keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``probe`` with at least one partner."""
    pairs = list(zip(probe_keys, build_keys or probe_keys))
    return probe.join(build, [probe[p] == build[b] for p, b in pairs], "left_semi")


def star_probe(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Fact rows that have a partner in every dimension (dimension, fact key, dimension key)."""
    return reduce(lambda rows, d: semi_join(rows, d[0].select(d[2]), [d[1]], [d[2]]), dimensions, fact)


def first_match(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in order (a lookup that drops later duplicates)."""
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("first")).select(key, "first.*")


def fixed_agg(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Global aggregates: one row, also over no rows."""
    return df.agg(*(a.alias(n) for n, a in aggregates.items()))


def count_rows(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def hash_group(df: DataFrame, keys: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """Partial aggregation, exchange by key, final aggregation."""
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))


def having(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def build_chains(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Key, number of payloads and their sum: what a hash-table build keeps per key, without collecting chains."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("chain_length"), F.sum(payload).alias("payload_sum"))


def multimap(df: DataFrame, key: str, payload: str, part_rows: int = 1 << 16) -> DataFrame:
    """key, part, payloads: a persisted key to many values index.  A frequent key spans many parts, so no row grows without bound."""
    dealt = df.select(key, payload).withColumn("salt", F.pmod(F.xxhash64(payload), F.lit(64)))
    place = F.row_number().over(Window.partitionBy(key, "salt").orderBy(payload)) - 1
    parts = dealt.withColumn("part", F.floor(place / part_rows) * 64 + F.col("salt"))
    return parts.groupBy(key, "part").agg(F.array_sort(F.collect_list(payload)).alias("payloads"))


def chain_histogram(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Number of hash buckets by number of entries."""
    chains = df.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("chain_length"))
    return chains.groupBy("chain_length").agg(F.count(F.lit(1)).alias("buckets"))


def cluster_by_key(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, next to each other."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def sort_relation(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Pass-through row counter: read ``observation.get["rows"]`` after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One dictionary over several text columns: value, id (0 .. n-1 in order of value).

    Ids come from two levels (a count per 2-byte prefix, a rank inside it), so no task ranks all values.
    """
    values = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("value")) for c in columns]).filter(F.col("value").isNotNull()).distinct()
    values = values.withColumn("bucket", F.substring("value", 1, 2))
    bases = values.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    return values.join(bases, "bucket").select("value", (F.col("base") + rank - 1).cast("int").alias("id"))


def encode(df: DataFrame, words: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces text columns by dictionary ids; an unknown value becomes null."""
    for c in columns:
        ids = words.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id"))
        df = df.join(ids, c, "left").drop(c)
    return df
