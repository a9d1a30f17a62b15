"""Every query against its SQL on the same Parquet tables, and invariance under physical settings."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from granary import functions as fn
from granary.plans import registry
from granary.sources import star

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return connection


def rows_of(rows, order):
    def plain(x):
        if isinstance(x, (datetime.date, datetime.datetime)):
            return x.isoformat()
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def collected(df):
    names = sorted(df.columns)
    return rows_of(df.collect(), [df.columns.index(n) for n in names])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, oracle, name):
    df = registry.QUERIES[name](spark, sf_dir)
    result = oracle.execute(registry.ORACLE_SQL[name])
    names, kinds = [c[0] for c in result.description], [str(c[1]) for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert {n: KINDS[k] for n, k in zip(names, kinds)} == dict(df.dtypes)
    assert collected(df) == rows_of(result.fetchall(), [names.index(n) for n in sorted(names)])


SETTINGS = [
    {"spark.sql.autoBroadcastJoinThreshold": "-1"},
    {"spark.sql.adaptive.enabled": "false"},
    {"spark.sql.shuffle.partitions": "1"},
    {"spark.sql.codegen.wholeStage": "false"},
]


@pytest.mark.parametrize("name", ["tpch_q1", "tpch_q5", "tpch_q9", "tpch_q18", "qa_semi", "ssb_q21", "ssb_q43", "op_bts"])
@pytest.mark.parametrize("setting", SETTINGS, ids=lambda s: "".join(s))
def test_same_under_any_physical_setting(spark, sf_dir, name, setting):
    want = collected(registry.QUERIES[name](spark, sf_dir))
    before = {k: spark.conf.get(k) for k in setting}
    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        assert collected(registry.QUERIES[name](spark, sf_dir)) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_prune(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = plan(registry.QUERIES["tpch_q6"](spark, sf_dir))
    assert "LessThan(l_shipdate" in text and "l_orderkey" not in text
    text = plan(registry.QUERIES["qa_semi"](spark, sf_dir))
    assert "LeftSemi" in text and "LessThan(o_orderdate" in text
    for name, query in registry.QUERIES.items():
        text = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in text and "Python" not in text and "Arrow" not in text, name


@pytest.fixture(scope="module")
def star_dir(spark, sf_dir, tmp_path_factory):
    """The star schema as tables of its own."""
    root = str(tmp_path_factory.mktemp("star"))
    made = {"lineorder": star.lineorders(spark, sf_dir), "date": star.dates(spark, sf_dir), "part": star.parts(spark, sf_dir), "supplier": star.suppliers(spark, sf_dir), "customer": star.customers(spark, sf_dir)}
    for name, df in made.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.startswith("ssb_")))
def test_star_tables_of_their_own(spark, sf_dir, star_dir, name):
    got = registry.QUERIES[name](spark, star_dir)
    assert collected(got) == collected(registry.QUERIES[name](spark, sf_dir))
    assert "lineitem" not in plan(got)


def test_part_supplier_table_and_priority(spark, sf_dir, tmp_path):
    """Costs come from partsupp and priorities from orders where they exist."""
    for name in ("customer", "lineitem", "nation", "part", "region", "supplier", "orders"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.withColumn("o_shippriority", (F.col("o_orderkey") % 3).cast("int")) if name == "orders" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    pairs.withColumn("ps_supplycost", (F.col("ps_partkey") % 97 / 4).cast("decimal(12,2)")).write.parquet(f"{tmp_path}/partsupp.parquet")
    c = duckdb.connect()
    for path in glob.glob(f"{tmp_path}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}/*.parquet')")
    profit = "SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) - ps_supplycost * CAST(l_quantity AS DECIMAL(12,2)))"
    want = c.execute(f"SELECT n_name, CAST(year(o_orderdate) AS INT), CAST({profit} AS DOUBLE) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_name LIKE '%red%' GROUP BY 1, 2").fetchall()
    assert sorted(map(tuple, registry.QUERIES["tpch_q9"](spark, str(tmp_path)).select("nation", "o_year", "sum_profit").collect())) == sorted(want)
    shipped = registry.QUERIES["tpch_q3"](spark, str(tmp_path)).collect()
    assert shipped and all(r["o_shippriority"] == r["l_orderkey"] % 3 for r in shipped)


@pytest.mark.parametrize("scale", [2, 6])
def test_exact_sums(spark, scale):
    values = [10**12 * k + k for k in range(-40, 90)] * 3 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    total = sum(v for v in values if v is not None)
    assert df.agg(fn.exact_sum("x", scale)).first()[0] == float(decimal.Decimal(total).scaleb(-scale))
    assert df.filter("x is null").agg(fn.exact_sum("x", scale)).first()[0] is None
    money = [0.07, -0.0, 104949.5, 0.29, 1.15, 1e7 + 0.01]
    assert [r[0] for r in spark.createDataFrame([(m,) for m in money], "m double").select(fn.cents("m")).collect()] == [7, 0, 10494950, 29, 115, 10**9 + 1]


def test_sums_agree(spark, sf_dir):
    run = lambda n: registry.QUERIES[n](spark, sf_dir).collect()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert sum(r["count_order"] for r in run("tpch_q1_nofilter")) == lines
    assert sum(r["count"] for r in run("op_agg")) == lines
    assert sum(r["chain_length"] for r in run("op_build_chain")) == lines
    assert sum(r["chain_length"] * r["buckets"] for r in run("op_hash_histogram")) == lines
    assert run("qa_semi")[0]["count"] <= lines


def test_products_cover_every_order(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = registry.QUERIES["prim_products_all"](spark, sf_dir).collect()
    assert len(got) == lines.select("l_orderkey").distinct().count() and sum(r["count"] for r in got) == lines.count()


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
