"""Star queries 1.1 to 4.3 and the star probe.  Results are sets; sums are exact inside, double in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import between
from ..operators import count_rows, fixed_agg, hash_group, hash_join, select, semi_join, star_probe
from ..sources import star
from .params import Star

P = Star()


def _c(name: str) -> F.Column:
    return F.col(name)


def _revenue(spark: SparkSession, sf_dir: str, dates: F.Column, discount: tuple[int, int], quantity: F.Column) -> DataFrame:
    days = select(star.dates(spark, sf_dir), dates)
    rows = select(star.lineorders(spark, sf_dir), between("lo_discount", *discount), quantity)
    rows = semi_join(rows, days, ["lo_orderdate"], ["d_datekey"])
    return fixed_agg(rows, revenue=F.sum(_c("lo_extendedprice") * _c("lo_discount")).cast("double"))


def q11(spark, sf_dir, p: Star = P):
    return _revenue(spark, sf_dir, _c("d_year") == p.first_year, (1, 3), _c("lo_quantity") < 25)


def q12(spark, sf_dir, p: Star = P):
    return _revenue(spark, sf_dir, _c("d_yearmonthnum") == p.month, (4, 6), between("lo_quantity", 26, 35))


def q13(spark, sf_dir, p: Star = P):
    return _revenue(spark, sf_dir, (_c("d_year") == p.week[0]) & (_c("d_weeknuminyear") == p.week[1]), (5, 7), between("lo_quantity", 26, 35))


def _joined(spark, sf_dir, dates=None, suppliers=None, customers=None, parts=None) -> DataFrame:
    """Line orders with the dimensions asked for, parts and suppliers first; a condition of True keeps a whole dimension."""

    def side(make, condition):
        return select(make(spark, sf_dir), *([] if condition is True else [condition]))

    first = [(star.parts, parts, "lo_partkey", "p_partkey"), (star.suppliers, suppliers, "lo_suppkey", "s_suppkey")]
    rows = star.lineorders(spark, sf_dir, *((side(make, condition), key, own) for make, condition, key, own in first if condition is not None))
    for make, condition, key, own in ((star.customers, customers, "lo_custkey", "c_custkey"), (star.dates, dates, "lo_orderdate", "d_datekey")):
        if condition is not None:
            rows = hash_join(rows, side(make, condition), [key], [own])
    return rows


def _by_brand(spark, sf_dir, parts, region):
    rows = _joined(spark, sf_dir, dates=True, suppliers=_c("s_region") == region, parts=parts)
    return hash_group(rows, ["d_year", "p_brand1"], revenue=F.sum("lo_revenue").cast("double"))


def q21(spark, sf_dir):
    return _by_brand(spark, sf_dir, _c("p_category") == "MFGR#12", "AMERICA")


def q22(spark, sf_dir):
    return _by_brand(spark, sf_dir, between("p_brand1", F.lit("MFGR#2221"), F.lit("MFGR#2228")), "ASIA")


def q23(spark, sf_dir):
    return _by_brand(spark, sf_dir, _c("p_brand1") == "MFGR#2221", "EUROPE")


def _by_places(spark, sf_dir, customers, suppliers, dates, level):
    rows = _joined(spark, sf_dir, dates=dates, suppliers=suppliers, customers=customers)
    return hash_group(rows, [f"c_{level}", f"s_{level}", "d_year"], revenue=F.sum("lo_revenue").cast("double"))


def q31(spark, sf_dir, p: Star = P):
    return _by_places(spark, sf_dir, _c("c_region") == "ASIA", _c("s_region") == "ASIA", between("d_year", *p.years), "nation")


def q32(spark, sf_dir, p: Star = P):
    return _by_places(spark, sf_dir, _c("c_nation") == p.nation, _c("s_nation") == p.nation, between("d_year", *p.years), "city")


def q33(spark, sf_dir, p: Star = P):
    return _by_places(spark, sf_dir, _c("c_city").isin(*p.cities), _c("s_city").isin(*p.cities), between("d_year", *p.years), "city")


def q34(spark, sf_dir, p: Star = P):
    return _by_places(spark, sf_dir, _c("c_city").isin(*p.cities), _c("s_city").isin(*p.cities), _c("d_yearmonth") == p.yearmonth, "city")


def _profit(spark, sf_dir, keys, **conditions):
    rows = _joined(spark, sf_dir, **conditions)
    return hash_group(rows, keys, profit=F.sum(_c("lo_revenue") - _c("lo_supplycost")).cast("double"))


_MAKERS = ("MFGR#1", "MFGR#2")


def q41(spark, sf_dir):
    return _profit(spark, sf_dir, ["d_year", "c_nation"], dates=True, customers=_c("c_region") == "AMERICA", suppliers=_c("s_region") == "AMERICA", parts=_c("p_mfgr").isin(*_MAKERS))


def q42(spark, sf_dir, p: Star = P):
    return _profit(spark, sf_dir, ["d_year", "s_nation", "p_category"], dates=_c("d_year").isin(*p.late_years), customers=_c("c_region") == "AMERICA", suppliers=_c("s_region") == "AMERICA", parts=_c("p_mfgr").isin(*_MAKERS))


def q43(spark, sf_dir, p: Star = P):
    return _profit(spark, sf_dir, ["d_year", "s_city", "p_brand1"], dates=_c("d_year").isin(*p.late_years), customers=_c("c_region") == "AMERICA", suppliers=_c("s_nation") == p.nation, parts=_c("p_category") == "MFGR#14")


def _star(spark, sf_dir, suppliers=(), parts=()):
    """Keys of parts and suppliers are unique, so a join with their keys keeps each line once, as a semi-join does."""
    first = [(select(star.parts(spark, sf_dir), *parts).select("p_partkey"), "lo_partkey", "p_partkey"), (select(star.suppliers(spark, sf_dir), *suppliers).select("s_suppkey"), "lo_suppkey", "s_suppkey")]
    return count_rows(star_probe(star.lineorders(spark, sf_dir, *first), [(star.dates(spark, sf_dir), "lo_orderdate", "d_datekey")]))


def probe(spark, sf_dir):
    return _star(spark, sf_dir)


def probe_filtered(spark, sf_dir):
    return _star(spark, sf_dir, [_c("s_region") == "AMERICA"], [_c("p_category") == "MFGR#12"])


def _sql(out: str, where: str, tables: str, group: str = "") -> str:
    joins = {"d": "JOIN ddate ON lo_orderdate = d_datekey", "s": "JOIN sup ON lo_suppkey = s_suppkey", "c": "JOIN cus ON lo_custkey = c_custkey", "p": "JOIN par ON lo_partkey = p_partkey"}
    return f"{star.SQL} SELECT {out} FROM lo {' '.join(joins[t] for t in tables)} WHERE {where}" + f" GROUP BY {group}" * bool(group)


_REV1, _REV, _PROFIT = "CAST(SUM(lo_extendedprice * lo_discount) AS DOUBLE) AS revenue", "CAST(SUM(lo_revenue) AS DOUBLE) AS revenue", "CAST(SUM(lo_revenue - lo_supplycost) AS DOUBLE) AS profit"
_YEARS = f"d_year BETWEEN {P.years[0]} AND {P.years[1]}"
_CITIES = f"c_city IN {P.cities} AND s_city IN {P.cities}"
_AMERICA = "c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_mfgr IN ('MFGR#1', 'MFGR#2')"

QUERIES = {"ssb_q11": q11, "ssb_q12": q12, "ssb_q13": q13, "ssb_q21": q21, "ssb_q22": q22, "ssb_q23": q23, "ssb_q31": q31, "ssb_q32": q32, "ssb_q33": q33, "ssb_q34": q34, "ssb_q41": q41, "ssb_q42": q42, "ssb_q43": q43, "ssb_star_probe": probe, "ssb_star_probe_filtered": probe_filtered}
ORACLE_SQL = {
    "ssb_q11": _sql(_REV1, f"d_year = {P.first_year} AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25", "d"),
    "ssb_q12": _sql(_REV1, f"d_yearmonthnum = {P.month} AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35", "d"),
    "ssb_q13": _sql(_REV1, f"d_year = {P.week[0]} AND d_weeknuminyear = {P.week[1]} AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35", "d"),
    "ssb_q21": _sql(f"d_year, p_brand1, {_REV}", "p_category = 'MFGR#12' AND s_region = 'AMERICA'", "dsp", "1, 2"),
    "ssb_q22": _sql(f"d_year, p_brand1, {_REV}", "p_brand1 BETWEEN 'MFGR#2221' AND 'MFGR#2228' AND s_region = 'ASIA'", "dsp", "1, 2"),
    "ssb_q23": _sql(f"d_year, p_brand1, {_REV}", "p_brand1 = 'MFGR#2221' AND s_region = 'EUROPE'", "dsp", "1, 2"),
    "ssb_q31": _sql(f"c_nation, s_nation, d_year, {_REV}", f"c_region = 'ASIA' AND s_region = 'ASIA' AND {_YEARS}", "dsc", "1, 2, 3"),
    "ssb_q32": _sql(f"c_city, s_city, d_year, {_REV}", f"c_nation = '{P.nation}' AND s_nation = '{P.nation}' AND {_YEARS}", "dsc", "1, 2, 3"),
    "ssb_q33": _sql(f"c_city, s_city, d_year, {_REV}", f"{_CITIES} AND {_YEARS}", "dsc", "1, 2, 3"),
    "ssb_q34": _sql(f"c_city, s_city, d_year, {_REV}", f"{_CITIES} AND d_yearmonth = '{P.yearmonth}'", "dsc", "1, 2, 3"),
    "ssb_q41": _sql(f"d_year, c_nation, {_PROFIT}", _AMERICA, "dscp", "1, 2"),
    "ssb_q42": _sql(f"d_year, s_nation, p_category, {_PROFIT}", f"{_AMERICA} AND d_year IN {P.late_years}", "dscp", "1, 2, 3"),
    "ssb_q43": _sql(f"d_year, s_city, p_brand1, {_PROFIT}", f"c_region = 'AMERICA' AND s_nation = '{P.nation}' AND p_category = 'MFGR#14' AND d_year IN {P.late_years}", "dscp", "1, 2, 3"),
    "ssb_star_probe": _sql("COUNT(*) AS count", "TRUE", "dsp"),
    "ssb_star_probe_filtered": _sql("COUNT(*) AS count", "s_region = 'AMERICA' AND p_category = 'MFGR#12'", "dsp"),
}
