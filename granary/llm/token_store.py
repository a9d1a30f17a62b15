"""Operator 5: token ids in a content-addressed store.

Method: a rolling hash over the last 16 ids cuts each document's id stream into chunks; each distinct
chunk is stored once, in pack files; a document's recipe lists its chunk digests; a Merkle root over
the digests, and a root over the documents of each recipe file, verify every reconstruction.

Plan: one pass over the texts encodes, cuts and drops chunks repeated within the task, so that one
digest reaches the shuffle at most once per task however many copies there are; one shuffle by digest
carries the (compressed) chunks to the packs; recipes are range-partitioned by document id and
written in ascending order.  Reading back joins recipes with the chunk index (pointers only; a
digest in very many documents is split by the adaptive skew join) and reads ranges of the packs.

Null texts are empty: only the end id.  Repeated ids of documents keep their rows (in order of length, then
of a hash of the recipe); a null id sorts first.  An empty table makes an empty store.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, filesystem, map_batches, pieces, read_table, ship_file, shipped, stage, staging, write_atomically, RangeReader
from .tokenization import default_path, word_encoder

WINDOW = 16
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 128, 9, 4096  # ids
BASE = 0x9E3779B97F4A7C15  # odd
MAGIC = b"GRC1"
FILE_TOKENS, FILES = 2 << 20, 100_000  # ids behind a recipe file; recipe files at most (beyond, each has more)


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), base & (1 << 64) - 1, np.uint64))), dtype=np.uint64)


_INVERSE = pow(BASE, -1, 1 << 64)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: where the hash of the last 16 ids has its top bits zero.

    The hash of a window depends on its ids alone, so equal passages are cut at equal places.
    """
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(n, BASE), dtype=np.uint64)))
        windows = (sums[WINDOW:] - sums[:-WINDOW]) * _powers(n - WINDOW + 1, _INVERSE)
    marks = np.flatnonzero(windows >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
    ends, at = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if mark - at >= MIN_CHUNK or mark == n and mark > at:
            at = mark
            ends.append(at)
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over leaves; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _chunks(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Two kinds of rows: recipes (doc_id, n_tokens, digests) and chunks (digest, data)."""
    names = ["doc_id", "n_tokens", "digests", "digest", "data"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        import zstandard

        encoder, seen = word_encoder(shipped(tokenizer)), set()
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False).compress
        for batch in pieces(batches, 1500, 3 << 20):
            ids, at = encoder.encode_column(batch.column(1))
            rows = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[a:b], np.asarray(end_id, ids.dtype))
                data, begin, digests = own.tobytes(), 0, []
                for end in cut_points(own):
                    part = data[begin * own.itemsize : end * own.itemsize]
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    digests.append(digest)
                    if digest not in seen:
                        seen.add(digest)
                        rows.append((None, None, None, digest, pack(part)))
                    begin = end
                rows.append((doc_id, len(own), b"".join(digests), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return map_batches(documents, run, "doc_id long, n_tokens long, digests binary, digest binary, data binary")


def _pack(rows: DataFrame, root: str) -> DataFrame:
    """Writes each partition's distinct chunks to pack files; recipes pass; chunks become index rows."""
    names = ["doc_id", "n_tokens", "digests", "digest", "pack", "offset", "length"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        uri, index, size = f"{root}/chunks-{part:06d}.pack", [], 0
        system, path = filesystem(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        temporary = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
        out = system.open_output_stream(temporary)
        for batch in batches:
            keep = []
            for doc_id, n, digests, digest, data in zip(*(c.to_pylist() for c in batch.columns[:5])):
                if digest is None:
                    keep.append((doc_id, n, digests, None, None, None, None))
                elif digest != last:  # sorted by digest
                    last = digest
                    out.write(data)
                    index.append((None, None, None, digest, uri, size, len(data)))
                    size += len(data)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keep), types)], names)
        out.close()
        system.move(temporary, path) if size else system.delete_file(temporary)
        for at in range(0, len(index), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index[at : at + 8192]), types)], names)

    key = F.coalesce(F.col("digest"), F.unhex(F.sha1(F.col("doc_id").cast("string"))))
    dealt = rows.repartition(key).sortWithinPartitions("digest")
    return map_batches(dealt, run, "doc_id long, n_tokens long, digests binary, digest binary, pack string, offset long, length long")


def _write_recipes(recipes: DataFrame, root: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """One recipe file a range of documents, in ascending order: part, file, documents, tokens, root.

    There are as many files as the ids behind them ask for, since recipes themselves are small; a frequent id is cut by its recipes.

    File: magic, then per document its id, number of ids, number of chunks, Merkle root, digests.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        uri, roots, tokens = f"{root}/recipes-{part:06d}.bin", [], 0

        def body():
            nonlocal tokens
            yield MAGIC
            for batch in batches:
                for doc_id, n, digests in zip(*(c.to_pylist() for c in batch.columns[:3])):
                    own = merkle_root([digests[i : i + 16] for i in range(0, len(digests), 16)])
                    roots.append(own)
                    tokens += n
                    yield struct.pack("<?qqI", doc_id is not None, doc_id or 0, n, len(digests) // 16) + own + digests

        write_atomically(uri, body())
        yield pa.RecordBatch.from_pylist([{"part": part, "file": uri, "documents": len(roots), "tokens": tokens, "root": merkle_root(roots)}], pa.schema([("part", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())]))

    tokens = recipes.agg(F.sum("n_tokens")).first()[0] or 0  # ``recipes`` is a written table
    files, order = min(FILES, max(1, -(-int(tokens) // file_tokens))), ["doc_id", "n_tokens", "place"]
    ranged = recipes.select("doc_id", "n_tokens", "digests", F.xxhash64("digests").alias("place"))  # the driver sees a sample of the ranges' keys
    ordered = ranged.repartitionByRange(files, *order).sortWithinPartitions(*order, "digests")
    return map_batches(ordered, run, "part long, file string, documents long, tokens long, root binary")


def write_store(documents: DataFrame, root: str, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encodes and writes; the chunk index (digest, pack, offset, length) and the manifest of recipe files."""
    tokenizer = ship_file(documents.sparkSession, tokenizer_path or default_path("word_bpe_49k.json"))
    both = stage(_pack(_chunks(doc_texts(documents, id_col, text_col), tokenizer, end_id), f"{root}/packs"), f"{root}/index")
    index = both.filter(F.col("digest").isNotNull()).select("digest", "pack", "offset", "length")
    manifest = stage(_write_recipes(both.filter(F.col("digest").isNull()), f"{root}/recipes"), f"{root}/manifest")
    return index, manifest


def _files(manifest: DataFrame) -> int:
    return max(1, manifest.count())


def read_recipes(manifest: DataFrame) -> DataFrame:
    """part, place (of the document in its file), doc_id, n_tokens, root, at (of the chunk), digest; verifies each file's root."""
    names = ["part", "place", "doc_id", "n_tokens", "root", "at", "digest"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches):
        reader = RangeReader()
        for batch in batches:
            for entry in batch.to_pylist():
                system, path = filesystem(entry["file"])
                with system.open_input_stream(path, buffer_size=1 << 20) as file:
                    if file.read(4) != MAGIC:
                        raise ValueError(f"{entry['file']}: not a recipe file")
                    rows, roots = [], []
                    for place in range(entry["documents"]):
                        known, doc_id, n, k = struct.unpack("<?qqI", file.read(21))
                        own, digests = file.read(32), file.read(16 * k)
                        roots.append(own)
                        rows += [(entry["part"], place, doc_id if known else None, n, own, i, digests[16 * i : 16 * i + 16]) for i in range(k)]
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                if merkle_root(roots) != entry["root"]:
                    raise ValueError(f"{entry['file']}: root differs")
        reader.close()

    return map_batches(manifest.repartition(_files(manifest), "part"), run, "part long, place long, doc_id long, n_tokens long, root binary, at long, digest binary")


def read_store(index: DataFrame, manifest: DataFrame, id_bytes: int = 2, with_ids: bool = False) -> DataFrame:
    """Every document rebuilt and verified: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids) and, if asked, ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per recipe file: ``FILES`` at most
    bases = manifest.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    found = read_recipes(manifest).join(index, "digest", "left")
    dealt = found.repartition(_files(manifest), "part").sortWithinPartitions("part", "place", "at")
    names = ["part", "doc_id", "shift", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    kind = f"<u{id_bytes}"

    def run(batches):
        import zstandard

        unpack, reader = zstandard.ZstdDecompressor().decompress, RangeReader(256)
        state: dict = {"key": None}

        def finish():
            if merkle_root(state["digests"]) != state["root"] or state["n"] != state["want"]:
                raise ValueError(f"document {state['doc_id']}: reconstruction differs from its recipe")
            row = (state["key"][0], state["doc_id"], state["shift"], state["n"], state["crc"], *[b"".join(state["ids"])] * with_ids)
            state["shift"] += state["n"]
            return row

        for batch in batches:
            out = []
            for part, place, doc_id, n, root, digest, pack, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if state["key"] != (part, place):
                    if state["key"] is not None:
                        out.append(finish())
                    state.update(shift=state["shift"] if state["key"] and state["key"][0] == part else 0, key=(part, place), doc_id=doc_id, want=n, root=root, digests=[], n=0, crc=0, ids=[])
                data = unpack(reader.read(pack, offset, length))
                if hashlib.blake2b(data, digest_size=16).digest() != digest:
                    raise ValueError(f"{pack} at {offset}: damaged chunk")
                ids = np.frombuffer(data, kind).astype("<u4").tobytes()
                state["digests"].append(digest)
                state["n"] += len(ids) // 4
                state["crc"] = zlib.crc32(ids, state["crc"])
                if with_ids:
                    state["ids"].append(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if state["key"] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(finish(), types)], names)
        reader.close()

    wanted = dealt.select("part", "place", "doc_id", "n_tokens", "root", "digest", "pack", "offset", "length")
    rebuilt = map_batches(wanted, run, "part long, doc_id long, shift long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rebuilt.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def query(spark, sf_dir):
    return read_store(*write_store(read_table(spark, sf_dir, "documents"), staging(spark, "tokens")))
