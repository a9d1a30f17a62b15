"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

Rows that any stage may meet: a null or empty text scores the share of good labels, has no lines and no shingles, is similar to
nothing and packs as one end id; null ids are kept, never joined with one another's texts; repeated rows score alike, lose
the same lines, and one of them is kept by the similarity stage if its text has words; of several texts of one
id each is a document; a very long text goes through whole; ties go by id, then by text or its hash; an empty table gives an
empty table; extra columns pass through all stages but the last, which returns the pieces alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import jaccard_join, line_dedup, packing, quality
from granary.llm.common import read_table, stage, staging


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled rows among them, predicts as good."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeats of runs of lines; one that loses all its text goes, one that loses none stays as it is."""
    own = "lines_deleted" in docs.columns  # a column of the documents stays as it is
    left = line_dedup.dedup_lines(docs.withColumnRenamed("lines_deleted", "own_lines_deleted") if own else docs)
    changed = F.col("lines_deleted") > 0
    kept = left.filter(~changed | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col("own_lines_deleted").alias(c) if own and c == "lines_deleted" else F.col(c) for c in docs.columns))


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that of least id (of repeated rows, one)."""
    return jaccard_join.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", similar_stage), ("best_fit_packing", packing_stage)]

#: Tokenization and scoring are out of reach of SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    root = staging(spark, "pipeline")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"{root}/{name}")
    return docs
