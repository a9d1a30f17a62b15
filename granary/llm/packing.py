"""Operator 8: best-fit packing of token sequences by exact complements.

Method: pieces are planned by length alone.  From the longest length down, the gap it leaves is filled
exactly by one, two or three other lengths, found in an index of available lengths and their sums, and
consumed under the counts that are left; what has no exact complement is packed best-fit, longest first.

The plan works on a histogram of at most ``capacity`` counts, whatever the number of documents: that is
all the driver sees.  A plan is a list of slots; slot (length, ranks lo..hi) puts the piece of that length
with rank r into sequence base + r - lo at a fixed offset.  Each consumption uses up a length, so the
number of slots is bounded by a small multiple of ``capacity``, not by the data.

Ranks within a length come from a count per (length, input task) and a running sum over tasks: no
task or window holds all pieces of a frequent length.

Null texts are empty: one id.  Repeated rows are packed each; rows of equal id too, and null ids stay null.  Pieces of equal length
are interchangeable: which of them goes where follows the input task and the order in it.  A very long text is cut as it is encoded.
An empty table makes no sequence; other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, map_batches, pieces, read_table, ship_file, shipped, stage, staging
from .tokenization import default_path, word_encoder

CAPACITY = 2048


class Plan:
    """Fills sequences of ``capacity`` from counts by length; ``slots``: (length, lo, hi, base, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length}")
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self._exact()
        self._best_fit()

    def _put(self, length: int, n: int, base: int, offset: int) -> None:
        lo = int(self.used[length])
        self.slots.append((length, lo, lo + n, base, offset))
        self.used[length] += n
        self.left[length] -= n

    def _consume(self, lengths: list[int]) -> None:
        """As many sequences of exactly these lengths as the counts allow."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(self.left[x]) // k for x, k in need.items())
        offset = 0
        for length in lengths:
            self._put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _fits(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _complement(self, length: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly; the longest first part is preferred."""
        gap = self.capacity - length
        if gap == 0:
            return []
        if self._fits([length, gap]):
            return [gap]
        have = self.left > 0
        for first in self._pairs(have, gap):
            if self._fits([length, first, gap - first]):
                return [first, gap - first]
        for first in np.flatnonzero(have[:gap])[::-1].tolist():
            rest = gap - first
            for second in self._pairs(have, rest):
                if second <= first and self._fits([length, first, second, rest - second]):
                    return [first, second, rest - second]
            if first * 3 < gap:  # the longest of three parts is a third of the gap at least
                break
        return None

    @staticmethod
    def _pairs(have: np.ndarray, total: int) -> list[int]:
        """The longer parts of available pairs with this sum, longest last part first."""
        if total < 2:
            return []
        both = have[1:total] & have[total - 1 : 0 : -1]
        longer = np.flatnonzero(both) + 1
        return longer[longer * 2 >= total].tolist()

    def _exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                rest = self._complement(length)
                if rest is None:
                    break
                self._consume([length, *rest])

    def _best_fit(self) -> None:
        """Longest first, each into the open sequence with the least sufficient gap."""
        gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
        space = np.zeros(self.capacity + 1, bool)
        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                room = np.flatnonzero(space[length:])
                if len(room):
                    gap = length + int(room[0])
                    first, m = gaps[gap].pop()
                    if m > n:
                        gaps[gap].append((first + n, m - n))
                        m = n
                    space[gap] = bool(gaps[gap])
                else:
                    gap, first = self.capacity, self.sequences
                    # each new sequence takes as many of this length as it holds
                    k = min(self.capacity // length, n)
                    m = n // k
                    for i in range(k):
                        self._put(length, m, first, i * length)
                    self.sequences += m
                    rest = self.capacity - k * length
                    if rest:
                        gaps.setdefault(rest, []).append((first, m))
                        space[rest] = True
                    continue
                self._put(length, m, first, self.capacity - gap)
                if gap > length:
                    gaps.setdefault(gap - length, []).append((first, m))
                    space[gap - length] = True


def cut_documents(documents: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, task and rank_in_task (among pieces of its length and task)."""
    tokenizer = ship_file(documents.sparkSession, tokenizer_path or default_path("word_bpe_49k.json"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder, task, ranks = word_encoder(shipped(tokenizer)), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in pieces(batches, 1500, 3 << 20):
            ids, at = encoder.encode_column(batch.column(1))
            rows = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[a:b].astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), task, ranks[len(part)]))
                    ranks[len(part)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return map_batches(doc_texts(documents, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank_in_task long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset.  ``cut`` must be a written table: ranks rely on its rows staying as they are."""
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = np.array(sorted(Plan(histogram, capacity).slots), np.int64).reshape(-1, 5)
    keys = slots[:, 0] << 40 | slots[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names)

    ranked = cut.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_in_task")).alias("rank"))
    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(spark, documents: DataFrame, **options) -> DataFrame:
    return pack(stage(cut_documents(documents, **options), staging(spark, "pieces")), options.get("capacity", CAPACITY))


def query(spark, sf_dir):
    return pack_documents(spark, read_table(spark, sf_dir, "documents"))
