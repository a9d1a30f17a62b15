"""Operator 4: byte-level BPE encoding and decoding by merge ranks.

Method: a hierarchical-bitmap rank queue (``tokenization.RankQueue``).  Each merge rank has a bucket
of linked-list positions; find-first-set over three bitmap levels gives the next rank; entries whose
pair changed meanwhile are skipped.  Pre-tokens of a batch that no cache knows share one queue; a
pre-token over 64 bytes gets a queue of its own, so a very long one costs n log n.

A row-local map: no shuffle, no state but bounded caches.  Null texts are empty; repeated rows give
repeated rows; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts, map_batches, pieces, ship_file, shipped
from .tokenization import byte_codec, default_path

FIELDS = {"ids": ("binary", pa.binary()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(documents: DataFrame, ranks_path: str | None = None, pattern: str | None = None, columns: tuple[str, ...] = ("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the asked columns: ``ids`` (little-endian unsigned 32-bit), ``n_tokens``, the SHA-256 of ids, the SHA-256 of the decoded ids."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ranks = ship_file(documents.sparkSession, ranks_path or default_path("byte_bpe_50k.tiktoken"))
    names = ["doc_id", *columns]
    types = [pa.int64(), *(FIELDS[c][1] for c in columns)]

    def run(batches):
        codec = byte_codec(shipped(ranks), pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in pieces(batches, 4000):
            ids, at = codec.encode_column(batch.column(1))
            data = memoryview(ids.tobytes())
            each = [data[a * 4 : b * 4] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            made = {"ids": lambda: [x.tobytes() for x in each], "n_tokens": lambda: [len(x) // 4 for x in each], "ids_sha256": lambda: [sha(x) for x in each], "decoded_sha256": lambda: [sha(codec.decode(x)) for x in each]}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c](), t) for c, t in zip(columns, types[1:]))], names)

    return map_batches(doc_texts(documents, id_col, text_col), run, "doc_id long, " + ", ".join(f"{c} {FIELDS[c][0]}" for c in columns))


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and the text bytes of a table of doc_id and ``ids`` (null: empty)."""
    import public_tokenizers

    ranks = ship_file(encoded.sparkSession, ranks_path or default_path("byte_bpe_50k.tiktoken"))
    pattern = public_tokenizers.PATTERN

    def run(batches):
        codec = byte_codec(shipped(ranks), pattern)
        for batch in pieces(batches, 4000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def query(spark, sf_dir):
    from .common import read_table

    return encode(read_table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))
