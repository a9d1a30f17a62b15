"""Operator 7: quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are of three kinds: pairs of neighbouring bytes in 64 classes; hashed shapes of words (runs of capitals,
other letters and digits each become one sign, marks stay); and how many words ago a word occurred in its text, in
powers of two.  The terms of each kind share a third of a document's mass.  Square roots of the shares, weighted by inverse
document frequency and normalized, are projected on the leading right singular vectors of a sample of
labelled documents.  Every document is compared with every labelled vector by exact blocked cosine products;
the labels of the nearest ``neighbours`` vote with the weight similarity ** ``power`` (a small sample with few bad rows needs a high power).

The model is fitted in one task on at most ``sample`` labelled documents (those of least hash of the id: the same at any
layout); the driver sees the model alone, terms x rank and sample x rank numbers, and so does the broadcast.  Scoring covers every
row and is a row-local map: no shuffle.

Null and empty texts, and a sample without labels, score the share of label 1 in the sample (0.5
without any).  Repeated rows score alike; of the texts of one id, one teaches (that of least terms); labels of null
quality teach nothing, of several labels of an id the greatest counts; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, map_batches, pieces, read_table
from .tokenization import plain_texts

CLASSES = 64
PAIRS, SHAPES, RECENCY = CLASSES * CLASSES, 1024, 16
TERMS = PAIRS + SHAPES + RECENCY
SAMPLE, RANK, NEIGHBOURS, POWER, THRESHOLD = 4096, 48, 15, 16, 0.3
FOLDS, HELD_OUT = 5, 0


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i in range(26):
        table[97 + i] = 1 + i  # a-z
    table[65:91] = 27
    table[48:58] = 28
    for i, mark in enumerate(b" \n\t.,;:!?'\"|-_/\\*$#%&@+=<>()[]{}~"):
        table[mark] = 29 + i
    table[128:] = 62
    table[192:] = 63
    return table


CLASS_OF = _classes()
#: Signs of a shape: nothing for blanks, one each for lower-case or other letters, capitals and digits, marks as they are.
SHAPE_OF = np.where(CLASS_OF < 27, 1, CLASS_OF)
SHAPE_OF[[9, 10, 13, 32]] = 0
SHAPE_OF[128:] = 1
SHAPE_HASH = np.random.default_rng(7).integers(0, 1 << 32, (CLASSES, 16))


def _word_shapes(raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hashed shape of each word: a number for each sign and place in the word, added up."""
    kinds = SHAPE_OF[raw]
    before = np.concatenate(([0], np.where(owner[1:] == owner[:-1], kinds[:-1], 0)))
    runs = np.flatnonzero((kinds > 0) & (kinds != before))
    first = np.flatnonzero(before[runs] == 0)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(runs)) - np.repeat(first, np.diff(np.concatenate((first, [len(runs)]))))
    added = np.add.reduceat(SHAPE_HASH[kinds[runs], np.minimum(place, 15)], first)
    return owner[runs[first]], added % SHAPES


def _recency(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word how long ago it occurred in its text: 1 + the binary logarithm, 0 if never."""
    order = np.argsort(owner * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    same = (codes[order[1:]] == codes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    out = np.zeros(len(codes), np.int64)
    out[order[1:][same]] = 1 + np.log2((order[1:] - order[:-1])[same]).astype(np.int64)
    return np.minimum(out, RECENCY - 1)


def term_shares(column: pa.Array) -> np.ndarray:
    """Square roots of the share of each term among those of its kind, one row per text (null: empty)."""
    column = plain_texts(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: n + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    counts = np.zeros((n, TERMS), np.float32)

    def add(first: int, size: int, rows: np.ndarray, terms: np.ndarray) -> None:
        own = np.bincount(rows * size + terms, minlength=n * size).reshape(n, size)
        counts[:, first : first + size] = own / np.maximum(own.sum(1, keepdims=True), 1)

    if len(raw):
        kinds, owner = CLASS_OF[raw], np.repeat(np.arange(n), sizes)
        inside = owner[1:] == owner[:-1]
        add(0, PAIRS, owner[:-1][inside], (kinds[:-1] * CLASSES + kinds[1:])[inside])
        add(PAIRS, SHAPES, *_word_shapes(raw, owner))
    split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
    coded = pc.dictionary_encode(split.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(codes):
        owner = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
        words = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] > 0
        codes, owner = codes[words], owner[words]
        add(PAIRS + SHAPES, RECENCY, owner, _recency(codes, owner))
    return np.sqrt(counts)


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequencies
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray
    neighbours: int
    prior: float
    power: int = POWER

    def latent(self, shares: np.ndarray) -> np.ndarray:
        return _normal(_normal(shares * self.weights) @ self.axes)

    def score(self, shares: np.ndarray) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for at in range(0, len(shares), 256):
            latent = self.latent(shares[at : at + 256])
            near = latent @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1).astype(np.float64), 0) ** self.power
            total = weight.sum(1)
            some = total > 1e-9
            out[at : at + 256][some] = ((weight * self.labels[best]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def leading_axes(rows: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    start = np.random.default_rng(0).standard_normal((rows.shape[1], min(rank + 8, *rows.shape))).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :rank], np.float32)


def held_out(id_col) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def learn(shares: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, power: int = POWER) -> Model:
    """The model of labelled rows of term shares."""
    if not len(shares):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, 0.5, power)
    weights = (np.log((1 + len(shares)) / (1 + (shares > 0).sum(0))) + 1).astype(np.float32)
    weighted = _normal(shares * weights)
    axes = leading_axes(weighted, min(rank, *weighted.shape))
    return Model(weights, axes, _normal(weighted @ axes).astype(np.float32), labels.astype(np.float64), neighbours, float(labels.mean()), power)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, power: int = POWER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled documents that aren't held out, ``sample`` of them at most; one task does the algebra."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = doc_texts(documents, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows of two numbers

    def terms(batches):
        for batch in pieces(batches, 256):
            packed = []
            for row in term_shares(batch.column(1)):
                held = np.flatnonzero(row)
                packed.append(held.astype("<u2").tobytes() + row[held].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["doc_id", "terms", "quality"])

    def algebra(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "quality")))]
        shares = np.zeros((len(rows), TERMS), np.float32)
        for row, (_, data, _) in zip(shares, rows):
            n = len(data) // 6
            row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
        model = learn(shares, np.array([r[2] for r in rows], np.float64), rank, neighbours, power)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = map_batches(texts.select("doc_id", "text", "quality"), terms, "doc_id long, terms binary, quality int")
    one_each = rows.groupBy("doc_id", "quality").agg(F.min("terms").alias("terms"))  # ``sample`` rows of at most 6 bytes a term
    return pickle.loads(map_batches(one_each.coalesce(1).sortWithinPartitions("doc_id"), algebra, "model binary").first()["model"])


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, 512):
            scores = shared.value.score(term_shares(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_batches(doc_texts(documents, id_col, text_col), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores ``threshold`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, 512):
            scores = shared.value.score(term_shares(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(scores >= threshold))

    return map_batches(documents, run, documents.schema)


def query(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return score(documents, fit(documents, read_table(spark, sf_dir, "labels")))
