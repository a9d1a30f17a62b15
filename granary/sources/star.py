"""The star schema: its own tables where they exist, else derived from the order tables, as DataFrames and as SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import fixed_side
from .tables import has_table, table


def _yyyymmdd(x) -> F.Column:
    return (F.year(x) * 10000 + F.month(x) * 100 + F.day(x)).cast("int")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nationkey, nation, region: 25 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(fixed_side(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def is_star(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the folder holds the star schema itself."""
    return has_table(spark, sf_dir, "lineorder")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first order to the last: a row a day, so of bounded size."""
    if is_star(spark, sf_dir):
        return table(spark, sf_dir, "date")
    day = F.col("o_orderdate").cast("date")
    span = table(spark, sf_dir, "orders").agg(F.min(day).alias("first"), F.max(day).alias("last")).filter(F.col("first").isNotNull())
    days = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    return days.select(
        _yyyymmdd("day").alias("d_datekey"),
        F.year("day").cast("int").alias("d_year"),
        (F.year("day") * 100 + F.month("day")).cast("int").alias("d_yearmonthnum"),
        F.weekofyear("day").cast("int").alias("d_weeknuminyear"),
        F.date_format("day", "MMMyyyy").alias("d_yearmonth"),
    )


def _side(spark: SparkSession, sf_dir: str, name: str, p: str, key: str) -> DataFrame:
    rows = table(spark, sf_dir, name)
    if is_star(spark, sf_dir):
        return rows.select(key, f"{p}_city", f"{p}_nation", f"{p}_region")
    rows = rows.join(fixed_side(places(spark, sf_dir)), rows[f"{p}_nationkey"] == F.col("n_nationkey"))
    city = F.concat_ws("_", "n_name", (F.col(key) % 10).cast("string"))
    return rows.select(key, city.alias(f"{p}_city"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(spark, sf_dir, "supplier", "s", "s_suppkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(spark, sf_dir, "customer", "c", "c_custkey")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    if is_star(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", "p_mfgr", "p_category", "p_brand1")
    number = F.substring("p_brand", 7, 9).cast("int") - 1
    mfgr = F.concat(F.lit("MFGR#"), (number % 5 + 1).cast("string"))
    category = F.concat(mfgr, (F.floor(number / 5) + 1).cast("string"))
    brand = F.concat(category, (F.col("p_partkey") % 40 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand1"))


def lineorders(spark: SparkSession, sf_dir: str, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """Line orders, with the columns of ``dimensions`` (rows, own key, dimension key) of parts and suppliers.

    In the derived schema these meet the line items before the orders do, so that a filter on them shortens that join.
    """
    if is_star(spark, sf_dir):
        rows = table(spark, sf_dir, "lineorder")
    else:
        rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_partkey": "lo_partkey", "l_suppkey": "lo_suppkey"})
    extra = []
    for side, own, key in dimensions:
        rows = rows.join(side, rows[own] == side[key])
        extra += side.columns
    if is_star(spark, sf_dir):
        return rows
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    price = money("l_extendedprice")
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("lo_custkey"),
        "lo_partkey",
        "lo_suppkey",
        _yyyymmdd("o_orderdate").alias("lo_orderdate"),
        F.col("l_quantity").cast("int").alias("lo_quantity"),
        price.alias("lo_extendedprice"),
        (F.col("l_discount") * 100).cast("decimal(12,2)").alias("lo_discount"),
        (price * (1 - money("l_discount"))).cast("decimal(18,2)").alias("lo_revenue"),
        (price * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(18,2)").alias("lo_supplycost"),
        *extra,
    )


_KEY = "CAST(EXTRACT(YEAR FROM {0}) * 10000 + EXTRACT(MONTH FROM {0}) * 100 + EXTRACT(DAY FROM {0}) AS INT)"
SQL = f"""
WITH place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
ddate AS (SELECT DISTINCT {_KEY.format('o_orderdate')} AS d_datekey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS d_year,
  CAST(EXTRACT(YEAR FROM o_orderdate) * 100 + EXTRACT(MONTH FROM o_orderdate) AS INT) AS d_yearmonthnum,
  CAST(EXTRACT(WEEK FROM o_orderdate) AS INT) AS d_weeknuminyear, strftime(o_orderdate, '%b%Y') AS d_yearmonth FROM orders),
sup AS (SELECT s_suppkey, n_name || '_' || CAST(s_suppkey % 10 AS VARCHAR) AS s_city, n_name AS s_nation, r_name AS s_region FROM supplier JOIN place ON s_nationkey = n_nationkey),
cus AS (SELECT c_custkey, n_name || '_' || CAST(c_custkey % 10 AS VARCHAR) AS c_city, n_name AS c_nation, r_name AS c_region FROM customer JOIN place ON c_nationkey = n_nationkey),
brand AS (SELECT p_partkey, CAST(substr(p_brand, 7) AS INT) - 1 AS b FROM part),
par AS (SELECT p_partkey, 'MFGR#' || CAST(b % 5 + 1 AS VARCHAR) AS p_mfgr, 'MFGR#' || CAST(b % 5 + 1 AS VARCHAR) || CAST(CAST(FLOOR(b / 5) AS INT) + 1 AS VARCHAR) AS p_category,
  'MFGR#' || CAST(b % 5 + 1 AS VARCHAR) || CAST(CAST(FLOOR(b / 5) AS INT) + 1 AS VARCHAR) || CAST(p_partkey % 40 + 1 AS VARCHAR) AS p_brand1 FROM brand),
lo AS (SELECT o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey, {_KEY.format('o_orderdate')} AS lo_orderdate, CAST(l_quantity AS INT) AS lo_quantity,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS lo_extendedprice, CAST(l_discount * 100 AS DECIMAL(12,2)) AS lo_discount,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS lo_revenue,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
