"""Operators, functions, sources and generators: rows from seeded generators against plain Python."""

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary import functions as fn
from granary import operators as op
from granary.sources import datagen, schemas, tables


def made(seed, rows, *largest):
    """Rows of random integers, column i from 0 to largest[i]."""
    rng = random.Random(seed)
    return [tuple(rng.randrange(top + 1) for top in largest) for _ in range(rows)]


def table_of(spark, rows, *names, kind="long"):
    return spark.createDataFrame(rows, ", ".join(f"{n} {kind}" for n in names))


def bag(df):
    return Counter(map(tuple, df.collect()))


def longs(spark, name, values):
    return table_of(spark, [(v,) for v in values], name)


def pairs(spark, keys, values):
    return table_of(spark, list(zip(keys, values)), "k", "v")


@pytest.mark.parametrize("op_name", ["eq", "ge", "gt", "le", "lt"])
def test_select_dates(spark, op_name):
    start = datetime.date(1996, 2, 20)
    rows = [(i, start + datetime.timedelta(days=d)) for i, (d,) in enumerate(made(3, 60, 15))]
    limit = start + datetime.timedelta(days=8)
    days = spark.createDataFrame(rows, "i int, d date")
    want = [i for i, d in rows if fn.exprs.COMPARATORS[op_name](d, limit)]
    assert want and sorted(r["i"] for r in op.select(days, fn.compare(op_name, "d", limit)).collect()) == want
    assert op.select(days).count() == len(rows)


@pytest.mark.parametrize("build_keys,probe_keys", [(400, 900), (30, 40), (5, 9)])  # hardly, often and always repeated
def test_joins(spark, build_keys, probe_keys):
    left, right = made(build_keys, 250, probe_keys, 50), made(probe_keys, 120, build_keys, 1000)
    probe, build = table_of(spark, left, "b", "w"), table_of(spark, right, "k", "v")

    def inner(probes, builds):
        return Counter((b, w, k, v) for b, w in probes for k, v in builds if b == k)

    assert bag(op.hash_join(probe, build, ["b"], ["k"])) == inner(left, right)
    held = {k for k, _ in right}
    assert bag(op.semi_join(probe, build, ["b"], ["k"])) == Counter(r for r in left if r[0] in held)
    upper = op.select(build, fn.compare("gt", "v", 600))
    assert bag(op.hash_join(probe, upper, ["b"], ["k"])) == inner(left, [r for r in right if r[1] > 600])
    few = op.select(probe, fn.compare("lt", "w", 20))
    assert bag(op.hash_join(few, build, ["b"], ["k"])) == inner([r for r in left if r[1] < 20], right)
    both = Counter((b, w, k, v) for b, w in left for k, v in right if b == k and w == v % 51)
    assert bag(op.hash_join(probe, build.withColumn("m", F.col("v") % 51), ["b", "w"], ["k", "m"]).drop("m")) == both
    assert op.hash_join(probe, build.limit(0), ["b"], ["k"]).count() == 0


def test_first_match_and_star_probe(spark):
    build = pairs(spark, [1, 1, 2], [7, 5, 9])
    assert {(r["k"], r["v"]) for r in op.first_match(build, "k", ["v"]).collect()} == {(1, 5), (2, 9)}
    fact = spark.createDataFrame([(1, 2), (1, 9), (5, 2)], "a long, b long")
    assert op.star_probe(fact, [(longs(spark, "k", [1, 1]), "a", "k"), (longs(spark, "k", [2, 3]), "b", "k")]).count() == 1


def test_groups(spark):
    rows = made(11, 300, 6, 3, 90)

    def sums(some):
        out = Counter()
        for a, b, v in some:
            out[a, b] += v
        return dict(out)

    def grouped(df):
        return {(r["k1"], r["k2"]): r["s"] for r in df.collect()}

    df = spark.createDataFrame(rows, "k1 long, k2 int, v long")
    groups = op.hash_group(df, ["k1", "k2"], s=F.sum("v"))
    assert grouped(groups) == sums(rows)
    kept = op.select(df, fn.compare("lt", "v", 25))
    assert grouped(op.hash_group(kept, ["k1", "k2"], s=F.sum("v"))) == sums(r for r in rows if r[2] < 25)
    assert grouped(op.having(groups, F.col("s") > 500)) == {k: v for k, v in sums(rows).items() if v > 500}


def test_fixed_aggregate_of_nothing_is_one_row(spark):
    row = op.fixed_agg(longs(spark, "x", []), s=F.sum("x"), n=F.count(F.lit(1))).collect()
    assert len(row) == 1 and row[0]["s"] is None and row[0]["n"] == 0


def test_cluster_by_key(spark):
    keys = [k for k, in made(17, 200, 23)]
    dealt = op.cluster_by_key(longs(spark, "k", keys), 5, "k").withColumn("p", F.spark_partition_id()).collect()
    assert Counter(r["k"] for r in dealt) == Counter(keys)
    assert all(len({r["p"] for r in dealt if r["k"] == k}) == 1 for k in set(keys))
    assert all(a["k"] <= b["k"] for a, b in zip(dealt, dealt[1:]) if a["p"] == b["p"])


def test_multimap_splits_frequent_keys(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("long").alias("k"), F.col("id").alias("v"))
    index = op.multimap(df, "k", "v", part_rows=10).collect()
    assert max(len(r["payloads"]) for r in index) <= 10
    assert sorted(x for r in index for x in r["payloads"]) == list(range(5000))


def test_counted(spark):
    df, seen = op.counted(spark.range(7), "rows passed")
    assert df.count() == 7 and seen.get["rows"] == 7


def test_dictionary(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "aa")], "p string, q string")
    words = {r["value"]: r["id"] for r in op.dictionary(df, ["p", "q"]).collect()}
    assert words == {"a": 0, "aa": 1, "b": 2, "x": 3}
    coded = op.encode(df, op.dictionary(df, ["p"]), ["p", "q"]).collect()
    assert sorted((r["p_id"], r["q_id"]) for r in coded if r["q_id"] is None) == [(0, None), (1, None), (1, None)]


@pytest.mark.parametrize("a,b", [(-7, 2), (7, -2), (7, 2), (-8, 4)])
def test_integer_arithmetic_truncates(spark, a, b):
    row = spark.range(1).select(*(fn.arithmetic(o, F.lit(a), F.lit(b)).alias(o) for o in ("plus", "minus", "multiplies", "divides", "modulus"))).first()
    q = int(a / b)
    assert tuple(row) == (a + b, a - b, a * b, q, a - b * q)


def test_scalars(spark):
    row = spark.range(1).select(
        fn.divide_keeping_scale(F.lit("-10.00"), F.lit(3)).alias("d"),
        fn.contains_in_order(F.lit("green tea"), "ee", "te").alias("c1"),
        fn.contains_in_order(F.lit("aba"), "ab", "ba").alias("c2"),
        fn.julian_day(F.lit("2000-01-01")).alias("j"),
        fn.from_julian_day(F.lit(2451545)).alias("f"),
        fn.year(F.lit("1998-09-02").cast("date")).alias("y"),
        fn.money(F.lit(-0.0)).alias("m"),
        fn.trimmed(F.lit("  x ")).alias("t"),
        fn.first_char(F.lit("xyz")).alias("p"),
        fn.between(F.lit(3), 3, 5).alias("b"),
    ).first()
    assert tuple(row) == (Decimal("-3.33"), True, False, 2451545, datetime.date(2000, 1, 1), 1998, Decimal("0.00"), "x ", "x", True)


def test_tbl_files(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA| lar deposits|\n1|AMERICA|hs use\n")
    got = tables.read_tbl(spark, f"{tmp_path}/region.tbl", schemas.TPCH["region"]).collect()
    assert [tuple(r) for r in got] == [(0, "AFRICA", "lar deposits"), (1, "AMERICA", "hs use")]
    (tmp_path / "bad.tbl").write_text("x|AFRICA|c|\n")
    with pytest.raises(Exception):
        tables.read_tbl(spark, f"{tmp_path}/bad.tbl", schemas.TPCH["region"]).collect()


def test_tbl_schemas_and_conversion(spark, tmp_path):
    def line(schema):
        values = {"int": "7", "string": "MFGR#12", "date": "1994-06-12"}
        return "|".join(values.get(c.split()[1], "123.45") for c in schema.replace("decimal(12,2)", "decimal").replace("decimal(18,2)", "decimal").split(", ")) + "|\n"

    for name, sets in (("tpch", schemas.TPCH), ("ssb", schemas.SSB), ("ints", schemas.SSB_INTEGER_PARTS)):
        (tmp_path / name).mkdir()
        for t, schema in sets.items():
            (tmp_path / name / f"{t}.tbl").write_text(line(schema) * 2)
    assert {t: df.count() for t, df in tables.import_tpch(spark, f"{tmp_path}/tpch", f"{tmp_path}/out1").items()} == dict.fromkeys(schemas.TPCH, 2)
    assert tables.import_ssb(spark, f"{tmp_path}/ssb", f"{tmp_path}/out2")["lineorder"].first()["lo_discount"] == Decimal("123.45")
    (tmp_path / "ssb" / "part.tbl").unlink()
    assert tables.import_ssb(spark, f"{tmp_path}/ssb", f"{tmp_path}/out2")["part"].count() == 2  # converted before
    ints = tables.import_ssb_integer_parts(spark, f"{tmp_path}/ints", f"{tmp_path}/out3")
    assert ints["part"].first()["p_brand1"] == 7 and ints["customer"].first()["c_city_id"] == 0


def test_relations(spark, tmp_path):
    df = spark.createDataFrame([(3, 30), (1, 10)], "key long, payload long")
    for binary in (False, True):
        path = f"{tmp_path}/r{binary}"
        tables.write_relation(df, path, binary)
        assert sorted(map(tuple, tables.read_relation(spark, path, binary).collect())) == [(1, 10), (3, 30)]
    (tmp_path / "text").write_text("#KEY, VAL\n1,2\n3 4\n5\n")
    assert sorted(map(tuple, tables.read_relation(spark, f"{tmp_path}/text").collect())) == [(1, 2), (3, 4), (5, None)]
    assert tables.relation_name("R", 0.5, 1000) == "r_skew=0.5_size=1000" and tables.relation_name("s", 1, 50, 9) == "s_skew=1_size=50_max=9"


def test_written_relations(spark, tmp_path):
    r = datagen.write_generated(spark, str(tmp_path), "r", 50)
    s = datagen.write_generated(spark, str(tmp_path), "s", 120, 50, 1.0, binary=True)
    assert r.endswith("r_skew=0_size=50") and s.endswith("s_skew=1_size=120_max=50")
    assert sorted(x["key"] for x in tables.read_relation(spark, r).collect()) == list(range(1, 51))
    assert tables.read_relation(spark, s, binary=True).filter("key between 1 and 50").count() == 120


def test_generators(spark):
    keys = [r["key"] for r in datagen.primary_keys(spark, 500).collect()]
    assert sorted(keys) == list(range(1, 501)) and keys != sorted(keys)
    assert keys == [r["key"] for r in datagen.primary_keys(spark, 500).collect()]
    assert Counter(Counter(r["key"] for r in datagen.foreign_keys(spark, 1050, 100).collect()).values()) == {11: 50, 10: 50}
    copies = datagen.replicated(datagen.primary_keys(spark, 40), 100, 40)
    assert Counter(Counter(r["key"] for r in copies.collect()).values()) == {3: 20, 2: 20}
    some = datagen.nonunique_keys(spark, 4000, 10).toPandas()
    assert set(some["key"]) == set(range(10)) and sorted(some["payload"]) == list(range(4000))


@pytest.mark.parametrize("exponent", [0.0, 0.5, 1.0])
def test_zipf(spark, exponent):
    n, largest = 40_000, 200
    got = datagen.zipf_keys(spark, n, largest, exponent).toPandas()
    assert sorted(got["payload"]) == list(range(n)) and got["key"].between(1, largest).all()
    counts = sorted(Counter(got["key"]).values(), reverse=True)
    weights = [r**-exponent for r in range(1, largest + 1)]
    expected = n * weights[0] / sum(weights)
    assert abs(counts[0] - expected) < 6 * expected**0.5 + 40 * (exponent == 0)
    assert len(counts) == largest
    again = datagen.zipf_keys(spark.newSession(), n, largest, exponent).toPandas()
    assert dict(zip(again["payload"], again["key"])) == dict(zip(got["payload"], got["key"]))
