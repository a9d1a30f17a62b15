"""Single-operator workloads: filtered semi-join count, join probe, build, key search, aggregation, and the relational operators one by one.

The relations of the join workloads are R = orders (key o_orderkey, payload o_custkey) and S = lineitem (key l_orderkey, payload l_linenumber).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare, compare_either, contains, money, moment, year
from ..operators import build_chains, chain_histogram, count_rows, dictionary, encode, first_match, fixed_agg, hash_group, hash_join, having, multimap, project, scan, select, semi_join, sort_relation
from ..sources import datagen, star
from ..sources.tables import table
from .params import Orders

P = Orders()


def relation_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("r_payload"))


def relation_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("s_payload"))


def _qa_sides(spark, sf_dir, p):
    line = select(table(spark, sf_dir, "lineitem"), compare("lt", "l_quantity", float(p.qa_quantity))).select("l_orderkey")
    orders = select(table(spark, sf_dir, "orders"), F.col("o_orderdate") < moment(p.qa_date)).select("o_orderkey")
    return line, orders


def qa_semi(spark, sf_dir, p: Orders = P):
    line, orders = _qa_sides(spark, sf_dir, p)
    return count_rows(semi_join(line, orders, ["l_orderkey"], ["o_orderkey"]))


def qa_inner(spark, sf_dir, p: Orders = P):
    line, orders = _qa_sides(spark, sf_dir, p)
    return count_rows(hash_join(line, orders, ["l_orderkey"], ["o_orderkey"]))


def npo_pairs(spark, sf_dir):
    return relation_s(spark, sf_dir).join(relation_r(spark, sf_dir), "key").select("r_payload", "s_payload")


def npo(spark, sf_dir):
    return count_rows(npo_pairs(spark, sf_dir))


def build_chain(spark, sf_dir):
    return build_chains(relation_s(spark, sf_dir), "key", "s_payload")


def build_index(spark, sf_dir):
    index = multimap(relation_s(spark, sf_dir), "key", "s_payload")
    return index.select("key", F.explode("payloads").alias("payload"))


def bts(spark, sf_dir):
    """Search tree over R by customer (repeated keys: the least order counts), searched with every line's part."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("payload"))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    return count_rows(s.join(first_match(r, "key", ["payload"]), "key"))


def agg(spark, sf_dir):
    return hash_group(relation_s(spark, sf_dir), ["key"], count=F.count(F.lit(1)))


def agg_groups(spark, sf_dir):
    return count_rows(relation_s(spark, sf_dir).select("key").distinct())


def _discounts(key):
    return lambda spark, sf_dir: hash_group(table(spark, sf_dir, "lineitem"), [key], sum_discount=F.sum(money("l_discount")).cast("double"))


def join_part(spark, sf_dir):
    """Lines of the upper half of the part numbers."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    half = part.agg((F.max("p_partkey") / 2).alias("half"))
    upper = part.join(F.broadcast(half), F.col("p_partkey") > F.col("half")).select("p_partkey")  # one row
    return count_rows(hash_join(table(spark, sf_dir, "lineitem").select("l_partkey"), upper, ["l_partkey"], ["p_partkey"]))


def join_orders(spark, sf_dir):
    orders = select(table(spark, sf_dir, "orders"), F.col("o_orderdate") >= moment(P.year_from)).select("o_orderkey")
    return count_rows(hash_join(table(spark, sf_dir, "lineitem").select("l_orderkey"), orders, ["l_orderkey"], ["o_orderkey"]))


def op_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


def op_select_and(spark, sf_dir):
    rows = select(table(spark, sf_dir, "lineitem"), compare("lt", "l_quantity", 24.0), compare("ge", "l_linenumber", 3), F.col("l_shipdate") < moment(P.q3_date))
    return rows.select("l_orderkey", "l_linenumber")


def op_select_or(spark, sf_dir):
    return select(table(spark, sf_dir, "lineitem"), compare_either("eq", "l_linenumber", 1, 4)).select("l_orderkey", "l_linenumber")


def op_select_colcol(spark, sf_dir):
    return select(table(spark, sf_dir, "lineitem"), compare("lt", "l_suppkey", "l_linenumber")).select("l_orderkey", "l_linenumber")


def op_contains(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), contains("p_name", "red")).select("p_partkey", "p_name")


def op_project_arith(spark, sf_dir):
    price = (money("l_extendedprice") * (1 - money("l_discount"))).cast("double")
    return project(table(spark, sf_dir, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), price=price)


def op_extract_year(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), o_orderkey=F.col("o_orderkey"), o_year=year("o_orderdate"))


def op_fixed_agg(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return fixed_agg(line, sum_qty=F.sum(money("l_quantity")).cast("double"), count=F.count(F.lit(1)))


def op_fixed_agg_empty(spark, sf_dir):
    line = select(table(spark, sf_dir, "lineitem"), compare("lt", "l_quantity", 0.0))
    return fixed_agg(line, sum_qty=F.sum(money("l_quantity")).cast("double"), count=F.count(F.lit(1)))


def op_count_star(spark, sf_dir):
    return count_rows(select(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == P.q3_segment))


def op_group_1key(spark, sf_dir):
    return hash_group(table(spark, sf_dir, "orders"), ["o_custkey"], count=F.count(F.lit(1)), total=F.sum(money("o_totalprice")).cast("double"))


def op_group_nkeys(spark, sf_dir):
    return hash_group(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber", "l_returnflag"], quantity=F.sum(money("l_quantity")).cast("double"))


def op_having(spark, sf_dir):
    return having(hash_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], quantity=F.sum(money("l_quantity")).cast("double")), F.col("quantity") > 15000)


def op_join_inner(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return hash_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customer, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_name")


def op_join_composite(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 25).cast("int").alias("nation"))
    return hash_join(line, supplier, ["l_suppkey", "nation"], ["s_suppkey", "s_nationkey"]).select("l_orderkey", "l_linenumber", "nation")


def op_join_probe_sel(spark, sf_dir):
    line = select(table(spark, sf_dir, "lineitem"), compare("lt", "l_quantity", 10.0)).select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return hash_join(line, orders, ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey")


def op_join_build_sel(spark, sf_dir):
    orders = select(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return hash_join(line, orders, ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey")


def op_semi_join(spark, sf_dir):
    orders = select(table(spark, sf_dir, "orders"), F.col("o_orderdate") >= moment(P.year_from)).select("o_custkey")
    return semi_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"], ["o_custkey"])


def op_dictionary(spark, sf_dir):
    """Ids of regions, nations and cities of customers and suppliers in one dictionary, and rows encoded with them."""
    cities = star.suppliers(spark, sf_dir)
    customers = star.customers(spark, sf_dir)
    both = cities.select("s_region", "s_nation", "s_city").toDF("region", "nation", "city").unionByName(customers.select("c_region", "c_nation", "c_city").toDF("region", "nation", "city"))
    words = dictionary(both, ["region", "nation", "city"])
    return encode(cities, words, ["s_region", "s_nation", "s_city"])


def op_hash_histogram(spark, sf_dir):
    return chain_histogram(relation_s(spark, sf_dir), "key", 4096)


def op_hash_histogram_totals(spark, sf_dir):
    """The histogram's totals over rows and over distinct keys; ``even``: used buckets are as many as a uniform hash fills, within six deviations."""
    rows, buckets = relation_s(spark, sf_dir), 4096
    sides = []
    for name, side in (("rows", rows), ("keys", rows.select("key").distinct())):
        total = fixed_agg(chain_histogram(side, "key", buckets), entries=F.sum(F.col("chain_length") * F.col("buckets")), used=F.sum("buckets"))
        filled = buckets * (1 - F.exp(-F.col("entries") / buckets))  # the variance of used buckets is below a quarter of all
        even = F.abs(F.col("used") - filled) <= 6 * (buckets / 4) ** 0.5 if name == "keys" else F.col("used") <= buckets
        sides.append(total.select(F.lit(name).alias("side"), "entries", even.alias("even")))
    return sides[0].unionByName(sides[1])


def op_sort_relation(spark, sf_dir):
    return sort_relation(relation_s(spark, sf_dir), "key", "s_payload")


def op_join_aggregate(spark, sf_dir):
    """Sum of discounts per order priority over the joined lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return hash_group(hash_join(line, orders, ["l_orderkey"], ["o_orderkey"]), ["o_orderpriority"], sum_discount=F.sum(money("l_discount")).cast("double"))


def gen_primary_keys(spark, sf_dir):
    return datagen.primary_keys(spark, 10_000)


def gen_foreign_keys(spark, sf_dir):
    return datagen.foreign_keys(spark, 25_000, 10_000)


def gen_nonunique_keys(spark, sf_dir):
    return datagen.nonunique_keys(spark, 25_000, 10_000)


def gen_zipf_keys(spark, sf_dir):
    return datagen.zipf_keys(spark, 25_000, 10_000, 1.0)


def gen_replicated(spark, sf_dir):
    return datagen.replicated(datagen.primary_keys(spark, 1000), 2500, 1000)


#: Generalised harmonic number of k for exponents one half and one, by its expansion.
_HARMONIC = {0.5: lambda k: 2 * math.sqrt(k) - 1.4603545 + 0.5 / math.sqrt(k), 1.0: lambda k: math.log(k) + 0.5772157 + 0.5 / k}


def gen_sizes(spark, sf_dir):
    """Every generator at the size of the tables: n rows as line items, k keys as orders.

    Per generator: rows, ``in_range`` (keys within bounds, payloads from 0 to n - 1 where they number rows) and ``shares`` (the
    most and, where all keys occur, the least frequent key as often as its distribution says, within eight deviations).
    """
    n, k = table(spark, sf_dir, "lineitem").count(), table(spark, sf_dir, "orders").count()
    mean = n / k
    bound = mean + 8 * math.sqrt(mean) + 16
    primary = datagen.primary_keys(spark, k)
    relations = [
        ("primary", primary, 1, k, 1, 1, 1),
        ("foreign", datagen.foreign_keys(spark, n, k), 1, k, 0, math.floor(mean), math.ceil(mean)),
        ("replicated", datagen.replicated(primary, n, k), 1, k, 1, math.floor(mean), math.ceil(mean)),
        ("nonunique", datagen.nonunique_keys(spark, n, k), 0, k - 1, 0, mean, bound),
        ("zipf 0", datagen.zipf_keys(spark, n, k, 0.0), 1, k, 0, mean, bound),
    ]
    for exponent, harmonic in _HARMONIC.items():
        head = n / harmonic(k)
        relations.append((f"zipf {exponent:g}", datagen.zipf_keys(spark, n, k, exponent), 1, k, 0, head - 8 * math.sqrt(head), head + 8 * math.sqrt(head)))
    parts = []
    for name, relation, low, high, first, least, most in relations:
        keys = hash_group(relation, ["key"], rows=F.count(F.lit(1)), low=F.min("payload"), high=F.max("payload"))
        last = k if first else n - 1
        in_range = (F.min("key") >= low) & (F.max("key") <= high) & (F.min("low") == first) & (F.max("high") == last)
        shares = F.max("rows").between(least, most) & (F.min("rows") >= (least if name in ("primary", "foreign", "replicated") else 1))
        parts.append(fixed_agg(keys, rows=F.sum("rows"), in_range=in_range, shares=shares).select(F.lit(name).alias("relation"), "rows", "in_range", "shares"))
    return reduce(DataFrame.unionByName, parts)


_M = "CAST({} AS DECIMAL(12,2))"
_QA = f"lineitem {{}} orders ON l_orderkey = o_orderkey WHERE l_quantity < {P.qa_quantity}"
_DICT = """p AS (SELECT s_region AS v FROM sup UNION SELECT s_nation FROM sup UNION SELECT s_city FROM sup UNION SELECT c_region FROM cus UNION SELECT c_nation FROM cus UNION SELECT c_city FROM cus),
words AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS id FROM p)"""

QUERIES = {
    "qa_semi": qa_semi,
    "qa_inner": qa_inner,
    "op_npo": npo,
    "op_npo_pairs": npo_pairs,
    "op_build_chain": build_chain,
    "op_build_index": build_index,
    "op_bts": bts,
    "op_agg": agg,
    "op_agg_groups": agg_groups,
    "op_agg_discount_orderkey": _discounts("l_orderkey"),
    "op_agg_discount_partkey": _discounts("l_partkey"),
    "op_agg_discount_returnflag": _discounts("l_returnflag"),
    "op_join_part_lineitem": join_part,
    "op_join_orders_lineitem": join_orders,
    "op_join_aggregate": op_join_aggregate,
    "op_scan": op_scan,
    "op_select_and": op_select_and,
    "op_select_or": op_select_or,
    "op_select_colcol": op_select_colcol,
    "op_contains": op_contains,
    "op_project_arith": op_project_arith,
    "op_extract_year": op_extract_year,
    "op_fixed_agg": op_fixed_agg,
    "op_fixed_agg_empty": op_fixed_agg_empty,
    "op_count_star": op_count_star,
    "op_group_1key": op_group_1key,
    "op_group_nkeys": op_group_nkeys,
    "op_having": op_having,
    "op_join_inner": op_join_inner,
    "op_join_composite": op_join_composite,
    "op_join_probe_sel": op_join_probe_sel,
    "op_join_build_sel": op_join_build_sel,
    "op_semi_join": op_semi_join,
    "op_dictionary": op_dictionary,
    "op_sort_relation": op_sort_relation,
    "op_hash_histogram": op_hash_histogram,
    "gen_primary_keys": gen_primary_keys,
    "gen_foreign_keys": gen_foreign_keys,
    "gen_nonunique_keys": gen_nonunique_keys,
    "gen_zipf_keys": gen_zipf_keys,
    "gen_replicated": gen_replicated,
    "gen_sizes": gen_sizes,
    "op_hash_histogram_totals": op_hash_histogram_totals,
}
_D = f"CAST(SUM({_M.format('l_discount')}) AS DOUBLE) AS sum_discount"
ORACLE_SQL = {
    "qa_semi": f"SELECT COUNT(*) AS count FROM lineitem WHERE l_quantity < {P.qa_quantity} AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{P.qa_date}')",
    "qa_inner": f"SELECT COUNT(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < {P.qa_quantity} AND o_orderdate < TIMESTAMP '{P.qa_date}'",
    "op_npo": "SELECT COUNT(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "op_npo_pairs": "SELECT o_custkey AS r_payload, l_linenumber AS s_payload FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "op_build_chain": "SELECT l_orderkey AS key, COUNT(*) AS chain_length, CAST(SUM(l_linenumber) AS BIGINT) AS payload_sum FROM lineitem GROUP BY 1",
    "op_build_index": "SELECT l_orderkey AS key, l_linenumber AS payload FROM lineitem",
    "op_bts": "SELECT COUNT(*) AS count FROM lineitem JOIN (SELECT DISTINCT o_custkey FROM orders) r ON l_partkey = o_custkey",
    "op_agg": "SELECT l_orderkey AS key, COUNT(*) AS count FROM lineitem GROUP BY 1",
    "op_agg_groups": "SELECT COUNT(DISTINCT l_orderkey) AS count FROM lineitem",
    "op_agg_discount_orderkey": f"SELECT l_orderkey, {_D} FROM lineitem GROUP BY 1",
    "op_agg_discount_partkey": f"SELECT l_partkey, {_D} FROM lineitem GROUP BY 1",
    "op_agg_discount_returnflag": f"SELECT l_returnflag, {_D} FROM lineitem GROUP BY 1",
    "op_join_part_lineitem": "SELECT COUNT(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey > (SELECT max(p_partkey) / 2 FROM part)",
    "op_join_orders_lineitem": f"SELECT COUNT(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '{P.year_from}'",
    "op_join_aggregate": f"SELECT o_orderpriority, {_D} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "op_scan": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "op_select_and": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 24 AND l_linenumber >= 3 AND l_shipdate < TIMESTAMP '{P.q3_date}'",
    "op_select_or": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR l_linenumber = 4",
    "op_select_colcol": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey < l_linenumber",
    "op_contains": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%'",
    "op_project_arith": f"SELECT l_orderkey, l_linenumber, CAST({_M.format('l_extendedprice')} * (1 - {_M.format('l_discount')}) AS DOUBLE) AS price FROM lineitem",
    "op_extract_year": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year FROM orders",
    "op_fixed_agg": f"SELECT CAST(SUM({_M.format('l_quantity')}) AS DOUBLE) AS sum_qty, COUNT(*) AS count FROM lineitem",
    "op_fixed_agg_empty": f"SELECT CAST(SUM({_M.format('l_quantity')}) AS DOUBLE) AS sum_qty, COUNT(*) AS count FROM lineitem WHERE l_quantity < 0",
    "op_count_star": f"SELECT COUNT(*) AS count FROM customer WHERE c_mktsegment = '{P.q3_segment}'",
    "op_group_1key": f"SELECT o_custkey, COUNT(*) AS count, CAST(SUM({_M.format('o_totalprice')}) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "op_group_nkeys": f"SELECT l_partkey, l_linenumber, l_returnflag, CAST(SUM({_M.format('l_quantity')}) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2, 3",
    "op_having": f"SELECT l_suppkey, CAST(SUM({_M.format('l_quantity')}) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1 HAVING SUM({_M.format('l_quantity')}) > 15000",
    "op_join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "op_join_composite": "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 25 AS INT) AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_partkey % 25 = s_nationkey",
    "op_join_probe_sel": "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 10",
    "op_join_build_sel": "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "op_semi_join": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{P.year_from}')",
    "op_dictionary": f"{star.SQL}, {_DICT} SELECT s_suppkey, r.id AS s_region_id, n.id AS s_nation_id, c.id AS s_city_id FROM sup JOIN words r ON s_region = r.v JOIN words n ON s_nation = n.v JOIN words c ON s_city = c.v",
    "op_sort_relation": "SELECT l_orderkey AS key, l_linenumber AS s_payload FROM lineitem ORDER BY 1, 2",
    "gen_primary_keys": "SELECT i AS key, i AS payload FROM range(1, 10001) t(i)",
    "op_hash_histogram_totals": "SELECT 'rows' AS side, COUNT(*) AS entries, TRUE AS even FROM lineitem UNION ALL SELECT 'keys', COUNT(DISTINCT l_orderkey), TRUE FROM lineitem",
    "gen_sizes": "SELECT 'primary' AS relation, COUNT(*) AS rows, TRUE AS in_range, TRUE AS shares FROM orders UNION ALL SELECT r, (SELECT COUNT(*) FROM lineitem), TRUE, TRUE FROM (VALUES ('foreign'), ('replicated'), ('nonunique'), ('zipf 0'), ('zipf 0.5'), ('zipf 1')) t(r)",
    "gen_foreign_keys": "SELECT i % 10000 + 1 AS key, i AS payload FROM range(25000) t(i)",
}
