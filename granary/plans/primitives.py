"""The scalar primitive matrix: comparisons, arithmetic, strings, dates, aggregates, each as a query over the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic, between, compare, compare_either, contains_in_order, divide_keeping_scale, ends_with, first_char, from_julian_day, julian_day, money, negate, prefix, rescale, row_hash, starts_with, trimmed
from ..operators import cluster_by_key, fixed_agg, hash_group, select
from ..sources.tables import table

_SIGNS = {"eq": "=", "ge": ">=", "gt": ">", "le": "<=", "lt": "<"}


def _counts(conditions):
    """One row: how many line items satisfy each condition, in one scan.  ``conditions`` makes them, with a session at hand."""
    return lambda spark, sf_dir: fixed_agg(table(spark, sf_dir, "lineitem"), **{n: F.count(F.when(c, 1)) for n, c in conditions().items()})


def _counts_sql(conditions):
    return "SELECT " + ", ".join(f"COUNT(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in conditions.items()) + " FROM lineitem"


_TYPES = {"long": ("l_partkey", 700, 900), "int": ("l_linenumber", 3, 5), "double": ("l_quantity", 17.0, 30.0), "text": ("l_returnflag", "N", "R")}


def _constant(x):
    return F.lit(x) if isinstance(x, str) else x


def _quoted(x):
    return f"'{x}'" if isinstance(x, str) else str(x)


def _matrix():
    queries, sql = {}, {}
    col_val = lambda: {f"{op}_{t}": compare(op, c, _constant(v)) for op in _SIGNS for t, (c, v, _) in _TYPES.items()}
    queries["prim_compare_col_val"] = _counts(col_val)
    sql["prim_compare_col_val"] = _counts_sql({f"{op}_{t}": f"{c} {s} {_quoted(v)}" for op, s in _SIGNS.items() for t, (c, v, _) in _TYPES.items()})
    pairs = {"long": ("l_partkey", "l_suppkey"), "double": ("l_quantity", "l_linenumber"), "text": ("l_returnflag", "l_linestatus"), "date": ("l_shipdate", "l_shipdate")}
    queries["prim_compare_col_col"] = _counts(lambda: {f"{op}_{t}": compare(op, a, b) for op in _SIGNS for t, (a, b) in pairs.items()})
    sql["prim_compare_col_col"] = _counts_sql({f"{op}_{t}": f"{a} {s} {b}" for op, s in _SIGNS.items() for t, (a, b) in pairs.items()})
    queries["prim_compare_val_or_val"] = _counts(lambda: {f"{op}_{t}": compare_either(op, c, _constant(v), _constant(w)) for op in _SIGNS for t, (c, v, w) in _TYPES.items()})
    sql["prim_compare_val_or_val"] = _counts_sql({f"{op}_{t}": f"({c} {s} {_quoted(v)} OR {c} {s} {_quoted(w)})" for op, s in _SIGNS.items() for t, (c, v, w) in _TYPES.items()})
    chained = lambda: {f"{op}_{t}": compare(op, c, _constant(v)) & compare("ge", "l_linenumber", 2) & between("l_quantity", 5.0, 45.0) for op in _SIGNS for t, (c, v, _) in _TYPES.items()}
    queries["prim_compare_chained"] = _counts(chained)
    sql["prim_compare_chained"] = _counts_sql({f"{op}_{t}": f"{c} {s} {_quoted(v)} AND l_linenumber >= 2 AND l_quantity BETWEEN 5 AND 45" for op, s in _SIGNS.items() for t, (c, v, _) in _TYPES.items()})
    return queries, sql


QUERIES, ORACLE_SQL = _matrix()
#: Narrow integers, fixed-width text and days, each with the constant it is compared with.
_NARROW = {
    "byte": ("CAST(l_linenumber AS TINYINT)", "CAST(3 AS TINYINT)"),
    "short": ("CAST(l_quantity * 100 AS SMALLINT)", "CAST(1700 AS SMALLINT)"),
    "char": ("rpad(l_returnflag, 10, ' ')", "rpad('N', 10, ' ')"),
    "day": ("CAST(l_shipdate AS DATE)", "DATE '1998-03-15'"),
}
QUERIES["prim_compare_narrow"] = _counts(lambda: {f"{op}_{t}": compare(op, F.expr(c), F.expr(v)) for op in _SIGNS for t, (c, v) in _NARROW.items()})
ORACLE_SQL["prim_compare_narrow"] = _counts_sql({f"{op}_{t}": f"{c} {s} {v}" for op, s in _SIGNS.items() for t, (c, v) in _NARROW.items()})
_KEYS = ["l_orderkey", "l_linenumber"]
_OPS = {"plus": "+", "minus": "-", "multiplies": "*", "divides": "//", "modulus": "%"}


def _arithmetic(left, right):
    return lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select(*_KEYS, *(arithmetic(op, F.expr(left), F.expr(right)).cast("long").alias(f"r_{op}") for op in _OPS))


def _arithmetic_sql(left, right):
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({left} {s} {right} AS BIGINT) AS r_{op}" for op, s in _OPS.items()) + " FROM lineitem"


QUERIES["prim_arithmetic_col_col"], ORACLE_SQL["prim_arithmetic_col_col"] = _arithmetic("l_partkey - 1000", "l_linenumber"), _arithmetic_sql("(l_partkey - 1000)", "l_linenumber")
QUERIES["prim_arithmetic_col_val"], ORACLE_SQL["prim_arithmetic_col_val"] = _arithmetic("l_partkey - 1000", "7"), _arithmetic_sql("(l_partkey - 1000)", "7")
QUERIES["prim_arithmetic_val_col"], ORACLE_SQL["prim_arithmetic_val_col"] = _arithmetic("-1000", "l_linenumber"), _arithmetic_sql("(-1000)", "l_linenumber")


def arithmetic_after_selection(spark, sf_dir):
    rows = select(table(spark, sf_dir, "lineitem"), compare("lt", "l_quantity", 10.0))
    return rows.select(*_KEYS, arithmetic("multiplies", money("l_extendedprice"), money("l_discount")).cast("double").alias("product"), negate("l_linenumber").alias("negated"))


def decimals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    price = money("o_totalprice")
    return orders.select("o_orderkey", rescale(price, 18, 4).cast("double").alias("wide"), divide_keeping_scale(price, F.lit(7)).cast("double").alias("seventh"))


def strings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        prefix("p_name", 4).alias("name_prefix"),
        first_char("p_brand").alias("brand_first"),
        starts_with("p_name", "re").alias("starts"),
        ends_with("p_name", "et").alias("ends"),
        contains_in_order("p_name", "e", "e").alias("ordered"),
        (F.col("p_name") == "red widget").alias("same"),
        trimmed(F.concat(F.lit("  "), "p_type")).alias("trimmed"),
    )


def days(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    julian = julian_day("o_orderdate")
    return orders.select("o_orderkey", julian.alias("julian"), from_julian_day(julian + 30).alias("later"))


def products(spark, sf_dir):
    """Product, sum and count by order, over every order: products of small integers are exact in doubles."""
    return _products(table(spark, sf_dir, "lineitem"))


def products_all(spark, sf_dir):
    """The same, once more under its first name for whole tables."""
    return _products(table(spark, sf_dir, "lineitem"))


def _products(line):
    return hash_group(line, ["l_orderkey"], product=F.product(F.col("l_linenumber").cast("double")), sum=F.sum("l_linenumber"), count=F.count(F.lit(1)))


def product_of_table(spark, sf_dir):
    """Product over the whole table: of signs, exact in doubles at any size."""
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return fixed_agg(table(spark, sf_dir, "lineitem"), product=F.product(sign), count=F.count(F.lit(1)))


def hashed_keys(spark, sf_dir):
    """Hashes of key pairs by lines and by pairs that share one: above one pair only where 64-bit hashes collide (from some 10^9 pairs on)."""
    pairs = hash_group(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], lines=F.count(F.lit(1)))
    hashes = hash_group(pairs, [row_hash("l_partkey", "l_suppkey").alias("hash")], lines=F.sum("lines"), pairs=F.count(F.lit(1)))
    return hash_group(hashes, ["lines", "pairs"], hashes=F.count(F.lit(1)))


def partition_by_key(spark, sf_dir):
    """Rows dealt by key: every key in one partition."""
    dealt = cluster_by_key(table(spark, sf_dir, "lineitem").select("l_suppkey"), 16, "l_suppkey").select("l_suppkey", F.spark_partition_id().alias("part"))
    return dealt.groupBy("l_suppkey").agg(F.count_distinct("part").alias("partitions"), F.count(F.lit(1)).alias("count"))


def selectivities(spark, sf_dir):
    """How many rows a less-than selection keeps at 0, 1, 5, 10, 30, 50, 65, 80 and 100 percent of the quantity range."""
    shares = (0, 1, 5, 10, 30, 50, 65, 80, 100)
    return fixed_agg(table(spark, sf_dir, "lineitem"), **{f"kept_{s}": F.count(F.when(F.col("l_partkey") % 100 < s, 1)) for s in shares})


_SHARES = (0, 1, 5, 10, 30, 50, 65, 80, 100)


def selections(spark, sf_dir):
    """Filters that keep 0 to 100 percent of the quantity range (1 to 50); each reaches the scan of its own branch."""
    line = table(spark, sf_dir, "lineitem")
    kept = [fixed_agg(select(line, compare("lt", "l_quantity", 1 + s / 2)), share=F.lit(s), kept=F.count(F.lit(1)), sum=F.sum("l_linenumber")) for s in _SHARES]
    return reduce(DataFrame.unionByName, kept)


QUERIES |= {"prim_product_of_table": product_of_table, "prim_hashed_keys": hashed_keys, "prim_selections": selections}
ORACLE_SQL |= {
    "prim_product_of_table": "SELECT product(CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS product, COUNT(*) AS count FROM lineitem",
    "prim_hashed_keys": "SELECT lines, CAST(1 AS BIGINT) AS pairs, COUNT(*) AS hashes FROM (SELECT COUNT(*) AS lines FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1",
    "prim_selections": " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS share, COUNT(*) AS kept, CAST(SUM(l_linenumber) AS BIGINT) AS sum FROM lineitem WHERE l_quantity < {1 + s / 2}" for s in _SHARES),
}
QUERIES |= {"prim_arithmetic_selected": arithmetic_after_selection, "prim_decimals": decimals, "prim_strings": strings, "prim_days": days, "prim_products": products, "prim_products_all": products_all, "prim_partition_by_key": partition_by_key, "prim_selectivities": selectivities}
ORACLE_SQL |= {
    "prim_arithmetic_selected": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2)) AS DOUBLE) AS product, -l_linenumber AS negated FROM lineitem WHERE l_quantity < 10",
    "prim_decimals": "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS DOUBLE) AS wide, CAST(CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) // 7 AS DECIMAL(18,2)) / 100 AS DOUBLE) AS seventh FROM orders",
    "prim_strings": "SELECT p_partkey, substr(p_name, 1, 4) AS name_prefix, substr(p_brand, 1, 1) AS brand_first, starts_with(p_name, 're') AS starts, suffix(p_name, 'et') AS ends, p_name LIKE '%e%e%' AS ordered, p_name = 'red widget' AS same, ltrim('  ' || p_type) AS trimmed FROM part",
    "prim_days": "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS INT) AS julian, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS later FROM orders",
    "prim_products": "SELECT l_orderkey, product(CAST(l_linenumber AS DOUBLE)) AS product, CAST(SUM(l_linenumber) AS BIGINT) AS sum, COUNT(*) AS count FROM lineitem GROUP BY 1",
    "prim_products_all": "SELECT l_orderkey, product(CAST(l_linenumber AS DOUBLE)) AS product, CAST(SUM(l_linenumber) AS BIGINT) AS sum, COUNT(*) AS count FROM lineitem GROUP BY 1",
    "prim_partition_by_key": "SELECT l_suppkey, CAST(1 AS BIGINT) AS partitions, COUNT(*) AS count FROM lineitem GROUP BY 1",
    "prim_selectivities": "SELECT " + ", ".join(f"COUNT(CASE WHEN l_partkey % 100 < {s} THEN 1 END) AS kept_{s}" for s in (0, 1, 5, 10, 30, 50, 65, 80, 100)) + " FROM lineitem",
}
