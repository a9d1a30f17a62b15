"""Schemas of the order and star benchmarks' text files.  Fixed values: column names and types, in file order."""

from __future__ import annotations

_D, _S = "decimal(12,2)", "decimal(18,2)"

TPCH = {
    "part": f"p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice {_D}, p_comment string",
    "supplier": f"s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal {_D}, s_comment string",
    "partsupp": f"ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost {_D}, ps_comment string",
    "customer": f"c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal {_D}, c_mktsegment string, c_comment string",
    "orders": f"o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice {_D}, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": f"l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity {_D}, l_extendedprice {_D}, l_discount {_D}, l_tax {_D}, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}
SSB = {
    "lineorder": f"lo_orderkey int, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_orderdate int, lo_orderpriority string, lo_shippriority string, lo_quantity int, lo_extendedprice {_S}, lo_ordtotalprice {_S}, lo_discount {_S}, lo_revenue {_S}, lo_supplycost {_S}, lo_tax int, lo_commitdate int, lo_shopmode string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size int, p_container string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string",
    "customer": "c_custkey int, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string",
    "date": "d_datekey int, d_date string, d_dayofweek string, d_month string, d_year int, d_yearmonthnum int, d_yearmonth string, d_daynuminweek int, d_daynuminmonth int, d_daynuminyear int, d_monthnuminyear int, d_weeknuminyear int, d_sellingseasin string, d_lastdayinweekfl int, d_lastdayinmonthfl int, d_holidayfl int, d_weekdayfl int",
}
#: The star schema whose part hierarchy is integers.
SSB_INTEGER_PARTS = {**SSB, "part": "p_partkey int, p_name string, p_mfgr int, p_category int, p_brand1 int, p_color string, p_type string, p_size int, p_container string"}
#: Text columns that share one dictionary.
SSB_DICTIONARY_COLUMNS = ("c_region", "c_city", "c_nation", "s_region", "s_city", "s_nation")
