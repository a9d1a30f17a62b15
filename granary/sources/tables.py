"""Tables from Parquet and pipe-separated text; key and payload relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-separated text without header, with or without a trailing pipe; text loses leading blanks; a bad field fails the read."""
    line = F.regexp_replace("value", r"\|$", "")
    options = {"sep": "|", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "quote": ""}
    return spark.read.text(path).filter(F.col("value") != "").select(F.from_csv(line, schema, options).alias("row")).select("row.*")


def convert(spark: SparkSession, source: str, target: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Text files ``source/<table>.tbl`` to Parquet under ``target``, once; later reads use Parquet."""
    out = {}
    for name, schema in tables.items():
        path = f"{target}/{name}.parquet"
        if not has_table(spark, target, name):
            read_tbl(spark, f"{source}/{name}.tbl", schema).write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def import_tpch(spark: SparkSession, source: str, target: str) -> dict[str, DataFrame]:
    return convert(spark, source, target, schemas.TPCH)


def import_ssb(spark: SparkSession, source: str, target: str) -> dict[str, DataFrame]:
    return convert(spark, source, target, schemas.SSB)


def import_ssb_integer_parts(spark: SparkSession, source: str, target: str) -> dict[str, DataFrame]:
    """The star schema with integer part hierarchy and dictionary ids for regions, nations and cities."""
    from ..operators import dictionary, encode

    tables = convert(spark, source, target, schemas.SSB_INTEGER_PARTS)
    sides = {"customer": "c_", "supplier": "s_"}
    places = [tables[t].select(*(F.col(c).alias("value") for c in [c])) for t, p in sides.items() for c in schemas.SSB_DICTIONARY_COLUMNS if c.startswith(p)]
    every = places[0]
    for more in places[1:]:
        every = every.unionByName(more)
    words = dictionary(every, ["value"])
    for t, p in sides.items():
        tables[t] = encode(tables[t], words, [c for c in schemas.SSB_DICTIONARY_COLUMNS if c.startswith(p)])
    return {**tables, "dictionary": words}


def write_relation(df: DataFrame, path: str, binary: bool = False) -> None:
    """Key and payload: text with a header line, or Parquet."""
    rows = df.select(F.col("key").cast("long"), F.col("payload").cast("long"))
    if binary:
        rows.write.mode("overwrite").parquet(path)
    else:
        header = df.sparkSession.range(1).select(F.lit("#KEY, VAL").alias("value"))
        header.unionByName(rows.select(F.concat_ws(" ", "key", "payload").alias("value"))).write.mode("overwrite").text(path)


def read_relation(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """Key and payload from Parquet, or from text lines ``key payload``, ``key,payload`` or ``key`` (payload null); header lines start with #."""
    if binary:
        return spark.read.parquet(path).select("key", "payload")
    parts = F.split(F.trim(F.col("value")), r"[ ,]+")
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.get(parts, F.lit(0)).cast("long").alias("key"), F.get(parts, F.lit(1)).cast("long").alias("payload"))


def relation_name(side: str, skew: float, size: int, largest: int | None = None) -> str:
    """File name of a generated relation: side, skew, size and, for foreign keys, the largest key."""
    name = f"{re.sub('[^rs]', '', side.lower())}_skew={skew:g}_size={size}"
    return name if largest is None else f"{name}_max={largest}"
