"""Order queries: pricing summary (1), shipping priority (3), local supplier volume (5), revenue forecast (6),
product profit (9), large orders (18) and the variants without filters or joins.

Results are sets: nothing is sorted or cut.  Money is exact inside, as whole hundredths or decimals, and double in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cents, contains, exact_sum, money, moment, year
from ..operators import fixed_agg, fixed_side, hash_group, hash_join, having, select, semi_join
from ..sources.tables import has_table, table
from .params import Orders

P = Orders()


def _double(x) -> F.Column:
    return x.cast("double")


def _disc_price() -> F.Column:
    """In units of 10^-4, as a whole number."""
    return cents("l_extendedprice") * (100 - cents("l_discount"))


def _summary(line: DataFrame, averages: bool = False) -> DataFrame:
    charge = _disc_price() * (100 + cents("l_tax"))
    sums = {
        "sum_qty": exact_sum(cents("l_quantity"), 2),
        "sum_base_price": exact_sum(cents("l_extendedprice"), 2),
        "sum_disc_price": exact_sum(_disc_price(), 4),
        "sum_charge": exact_sum(charge, 6),
        "count_order": F.count(F.lit(1)),
    }
    if averages:
        for name, c in (("avg_qty", "l_quantity"), ("avg_price", "l_extendedprice"), ("avg_disc", "l_discount")):
            sums[name] = exact_sum(cents(c), 2) / F.count(F.lit(1))
    return hash_group(line, ["l_returnflag", "l_linestatus"], **sums)


def q1(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    return _summary(select(table(spark, sf_dir, "lineitem"), F.col("l_shipdate") <= moment(p.q1_ship_until)))


def q1_nofilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(table(spark, sf_dir, "lineitem"))


def q1_avg(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    return _summary(select(table(spark, sf_dir, "lineitem"), F.col("l_shipdate") <= moment(p.q1_ship_until)), averages=True)


def q3(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    customers = select(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == p.q3_segment)
    orders = semi_join(select(table(spark, sf_dir, "orders"), F.col("o_orderdate") < moment(p.q3_date)), customers, ["o_custkey"], ["c_custkey"])
    line = select(table(spark, sf_dir, "lineitem"), F.col("l_shipdate") > moment(p.q3_date))
    priority = F.col("o_shippriority") if "o_shippriority" in orders.columns else F.lit(0).alias("o_shippriority")
    joined = hash_join(line, orders.select("o_orderkey", "o_orderdate", priority), ["l_orderkey"], ["o_orderkey"])
    keys = ["l_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_shippriority"]
    return hash_group(joined, keys, revenue=exact_sum(_disc_price(), 4)).select("revenue", "l_orderkey", "o_orderdate", "o_shippriority")


def _supplied(spark: SparkSession, sf_dir: str, orders: DataFrame, nations: DataFrame) -> DataFrame:
    """Line items whose supplier and customer are of the same of ``nations``."""
    customers = table(spark, sf_dir, "customer").join(fixed_side(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    bought = hash_join(orders, customers, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_nationkey", "n_name")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return hash_join(hash_join(line, bought, ["l_orderkey"], ["o_orderkey"]), suppliers, ["l_suppkey", "c_nationkey"], ["s_suppkey", "s_nationkey"])


def q5(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    region = select(table(spark, sf_dir, "region"), F.col("r_name") == p.q5_region)
    nations = semi_join(table(spark, sf_dir, "nation"), fixed_side(region), ["n_regionkey"], ["r_regionkey"])
    when = (F.col("o_orderdate") >= moment(p.year_from)) & (F.col("o_orderdate") < moment(p.year_to))
    return hash_group(_supplied(spark, sf_dir, select(table(spark, sf_dir, "orders"), when), nations), ["n_name"], revenue=exact_sum(_disc_price(), 4))


def q5_nosel(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nations = semi_join(table(spark, sf_dir, "nation"), fixed_side(region), ["n_regionkey"], ["r_regionkey"])
    joined = _supplied(spark, sf_dir, table(spark, sf_dir, "orders"), nations)
    return fixed_agg(joined, revenue=exact_sum(cents("l_extendedprice") * cents("l_discount"), 4), count=F.count(F.lit(1)))


def q6(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    low, high = (float(x) for x in p.q6_discount)
    rows = select(
        table(spark, sf_dir, "lineitem"),
        F.col("l_shipdate") >= moment(p.year_from),
        F.col("l_shipdate") < moment(p.year_to),
        F.col("l_quantity") < float(p.q6_quantity),
        F.col("l_discount").between(low - 0.006, high + 0.006),  # a wider bound, which the scan can use
        cents("l_discount").between(round(low * 100), round(high * 100)),
    )
    return fixed_agg(rows, revenue=exact_sum(cents("l_extendedprice") * cents("l_discount"), 4))


def supply_cost() -> F.Column:
    """Stand-in for a table of supply costs, which the data lack: a function of part and supplier."""
    return (1 + (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 1000).cast("decimal(12,2)")


def part_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ps_partkey, ps_suppkey, ps_supplycost, from ``partsupp`` where it exists, else a stand-in."""
    if has_table(spark, sf_dir, "partsupp"):
        return table(spark, sf_dir, "partsupp").select("ps_partkey", "ps_suppkey", "ps_supplycost")
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"), supply_cost().alias("ps_supplycost"))


def q9(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    parts = select(table(spark, sf_dir, "part"), contains("p_name", p.q9_name)).select("p_partkey")
    line = semi_join(table(spark, sf_dir, "lineitem"), parts, ["l_partkey"], ["p_partkey"])
    line = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    costs = semi_join(part_suppliers(spark, sf_dir), parts, ["ps_partkey"], ["p_partkey"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").join(fixed_side(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "nation")
    joined = hash_join(line, costs, ["l_partkey", "l_suppkey"], ["ps_partkey", "ps_suppkey"])
    joined = hash_join(joined, suppliers, ["l_suppkey"], ["s_suppkey"])
    joined = hash_join(joined, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["l_orderkey"], ["o_orderkey"])
    amount = _disc_price() - cents("ps_supplycost") * cents("l_quantity")
    return hash_group(joined, ["nation", year("o_orderdate").alias("o_year")], sum_profit=exact_sum(amount, 4))


def _large(spark: SparkSession, sf_dir: str, p: Orders) -> DataFrame:
    quantities = hash_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], quantity=F.sum(money("l_quantity")))
    return having(quantities, F.col("quantity") > p.q18_quantity)


def q18_group(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    return _large(spark, sf_dir, p).select("l_orderkey", _double(F.col("quantity")).alias("sum_quantity"))


def q18(spark: SparkSession, sf_dir: str, p: Orders = P) -> DataFrame:
    """The quantity of an order is summed once: the filtered groups already hold what the outer query sums again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    joined = hash_join(orders, _large(spark, sf_dir, p), ["o_orderkey"], ["l_orderkey"])
    joined = hash_join(joined, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"])
    keys = ["c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), _double(money("o_totalprice")).alias("o_totalprice")]
    return hash_group(joined, keys, sum_quantity=_double(F.sum("quantity")))


_DEC = {c: f"CAST({c} AS DECIMAL(12,2))" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice")}
_DISC = f"{_DEC['l_extendedprice']} * (1 - {_DEC['l_discount']})"
_SUMMARY = f"""l_returnflag, l_linestatus, CAST(SUM({_DEC['l_quantity']}) AS DOUBLE) AS sum_qty, CAST(SUM({_DEC['l_extendedprice']}) AS DOUBLE) AS sum_base_price,
CAST(SUM({_DISC}) AS DOUBLE) AS sum_disc_price, CAST(SUM({_DISC} * (1 + {_DEC['l_tax']})) AS DOUBLE) AS sum_charge, COUNT(*) AS count_order"""
_PS = "ps AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(1 + (l_partkey * 7 + l_suppkey * 13) % 1000 AS DECIMAL(12,2)) AS ps_supplycost FROM lineitem)"
_LARGE = f"(SELECT l_orderkey, SUM({_DEC['l_quantity']}) AS q FROM lineitem GROUP BY l_orderkey HAVING SUM({_DEC['l_quantity']}) > {P.q18_quantity})"
_FIVE = "customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

QUERIES = {"tpch_q1": q1, "tpch_q1_nofilter": q1_nofilter, "tpch_q1_avg": q1_avg, "tpch_q3": q3, "tpch_q5": q5, "tpch_q5_nosel": q5_nosel, "tpch_q6": q6, "tpch_q9": q9, "tpch_q18": q18, "tpch_q18_group": q18_group}
ORACLE_SQL = {
    "tpch_q1": f"SELECT {_SUMMARY} FROM lineitem WHERE l_shipdate <= TIMESTAMP '{P.q1_ship_until}' GROUP BY 1, 2",
    "tpch_q1_nofilter": f"SELECT {_SUMMARY} FROM lineitem GROUP BY 1, 2",
    "tpch_q1_avg": f"SELECT {_SUMMARY}, "
    + ", ".join(f"CAST(SUM({_DEC[c]}) AS DOUBLE) / COUNT(*) AS {n}" for n, c in (("avg_qty", "l_quantity"), ("avg_price", "l_extendedprice"), ("avg_disc", "l_discount")))
    + f" FROM lineitem WHERE l_shipdate <= TIMESTAMP '{P.q1_ship_until}' GROUP BY 1, 2",
    "tpch_q3": f"SELECT CAST(SUM({_DISC}) AS DOUBLE) AS revenue, l_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, 0 AS o_shippriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = '{P.q3_segment}' AND o_orderdate < TIMESTAMP '{P.q3_date}' AND l_shipdate > TIMESTAMP '{P.q3_date}' GROUP BY 2, 3, 4",
    "tpch_q5": f"SELECT n_name, CAST(SUM({_DISC}) AS DOUBLE) AS revenue FROM {_FIVE} WHERE r_name = '{P.q5_region}' AND o_orderdate >= TIMESTAMP '{P.year_from}' AND o_orderdate < TIMESTAMP '{P.year_to}' GROUP BY 1",
    "tpch_q5_nosel": f"SELECT CAST(SUM({_DEC['l_extendedprice']} * {_DEC['l_discount']}) AS DOUBLE) AS revenue, COUNT(*) AS count FROM {_FIVE}",
    "tpch_q6": f"SELECT CAST(SUM({_DEC['l_extendedprice']} * {_DEC['l_discount']}) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '{P.year_from}' AND l_shipdate < TIMESTAMP '{P.year_to}' AND {_DEC['l_discount']} BETWEEN {P.q6_discount[0]} AND {P.q6_discount[1]} AND l_quantity < {P.q6_quantity}",
    "tpch_q9": f"WITH {_PS} SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, CAST(SUM({_DISC} - ps_supplycost * {_DEC['l_quantity']}) AS DOUBLE) AS sum_profit FROM lineitem JOIN part ON p_partkey = l_partkey JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_name LIKE '%{P.q9_name}%' GROUP BY 1, 2",
    "tpch_q18": f"SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST({_DEC['o_totalprice']} AS DOUBLE) AS o_totalprice, CAST(SUM({_DEC['l_quantity']}) AS DOUBLE) AS sum_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM {_LARGE}) GROUP BY 1, 2, 3, 4, 5",
    "tpch_q18_group": f"SELECT l_orderkey, CAST(q AS DOUBLE) AS sum_quantity FROM {_LARGE}",
}
