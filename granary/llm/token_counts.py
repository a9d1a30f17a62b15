"""Operator 2: token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram answer totals, quantiles
and truncated totals for every context limit without going back to the documents.

The histogram has at most one row per distinct length, whatever the number of documents; counts are
added up before the shuffle, so one frequent length is no hot key.  Suffix sums go in two levels
(within blocks of 4096 lengths, then over blocks), so no task holds the whole histogram.  Null texts
are empty (0 tokens); an empty table gives an empty histogram; clashing column names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, map_batches, pieces, read_table, ship_file, shipped, stage, staging
from .tokenization import default_path, word_encoder

BLOCK = 4096


def token_lengths(documents: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every document."""
    tokenizer = ship_file(documents.sparkSession, tokenizer_path or default_path("word_bpe_49k.json"))

    def run(batches):
        encoder = word_encoder(shipped(tokenizer))
        for batch in pieces(batches, 1500, 3 << 20):
            _, at = encoder.encode_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(doc_texts(documents, id_col, text_col), run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length with suffix sums.

    n_tokens; documents (of this length); documents_at_least, tokens_at_least (suffix sums);
    documents_share (of this length or less); tokens_truncated (all tokens, each document cut at n_tokens).
    A null length counts as 0.
    """
    hist = lengths.groupBy(F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n_tokens")).agg(F.count(F.lit(1)).alias("documents"))
    hist = stage(hist, staging(lengths.sparkSession, "lengths"))  # read twice below: texts are encoded once
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("documents")
    blocks = hist.groupBy("block").agg(F.sum("documents").alias("block_documents"), F.sum(tokens).alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # max length / 4096 rows
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_documents").over(later), F.lit(0)).alias("later_documents"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_documents").over(everything).alias("all_documents"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    at_least = F.sum("documents").over(within) + F.col("later_documents")
    tokens_at_least = F.sum(tokens).over(within) + F.col("later_tokens")
    return hist.join(blocks, "block").select(
        "n_tokens",
        "documents",
        at_least.alias("documents_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        ((F.col("all_documents") - at_least + F.col("documents")) / F.col("all_documents")).alias("documents_share"),
        (F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("tokens_truncated"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents longer than it, tokens kept and tokens cut off."""
    spark = histogram.sparkSession
    kept = [F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("documents")).alias(f"k{i}") for i, x in enumerate(limits)]
    over = [F.sum(F.when(F.col("n_tokens") > x, F.col("documents")).otherwise(0)).alias(f"o{i}") for i, x in enumerate(limits)]
    sums = histogram.agg(F.sum(F.col("n_tokens") * F.col("documents")).alias("total"), *kept, *over)
    if not limits:
        return spark.createDataFrame([], "context_limit long, documents_over long, tokens_kept long, tokens_cut long")
    rows = F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.coalesce(f"o{i}", F.lit(0)).alias("documents_over"), F.coalesce(f"k{i}", F.lit(0)).alias("tokens_kept"), F.coalesce(F.col("total") - F.col(f"k{i}"), F.lit(0)).alias("tokens_cut")) for i, x in enumerate(limits)]))
    return sums.select(rows.alias("r")).select("r.*")


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length such that this share of the documents is no longer."""
    picks = histogram.agg(*[F.min(F.when(F.col("documents_share") >= s - 1e-12, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)])
    return picks.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("r")).select("r.*")


def query(spark, sf_dir):
    return length_histogram(token_lengths(read_table(spark, sf_dir, "documents")))
