"""Operator 1: media columns over content-addressed payloads in tar shards.

``store`` writes payloads as 8-bit greyscale PNG members of tar shards; a member's name is the SHA-256
of its payload, and a row carries digest, shard, offset and length.  ``header_columns`` fills metadata
by range reads of the headers alone; ``decoded_columns`` reads members back and computes features.

Each task writes the shards of its own input split, each payload of a split once; payloads are never
shuffled, so frequent copies make no hot key.  (A payload met by several tasks is stored once by each.)
Shards are written under a name of their own and moved to a name made from their contents; a retried
task makes the same file again.  Reading is dealt out by shard and range, not by digest, into tasks of about ``READ_BYTES`` stored bytes.

Null texts are empty; an empty text is one row of 64 zero bytes.  An empty table gives no rows.
Repeated rows each get a row; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, filesystem, map_batches, pieces, read_table, stage, staging, RangeReader

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR chunk
SPAN = 4 << 20  # bytes of a shard read at once
READ_BYTES, READ_TASKS = 16 << 20, 100_000  # stored bytes behind the rows of a reading task; tasks at most (beyond, each reads more)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: padded by zeros to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def encode_media(payload: bytes, level: int = 6) -> bytes:
    """PNG, 64 samples a row, 8-bit grey, filter 0."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_header(data: bytes) -> tuple[int, int, int]:
    """Width, height, bit depth from the first 33 bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def decode_media(data: bytes) -> bytes:
    """The samples of a PNG as ``encode_media`` writes it; checks every chunk's CRC."""
    width, height, depth = decode_header(data)
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Rows, sum of samples, distinct samples, most frequent sample and its count: all exact integers."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    return f"rows={len(samples) // WIDTH};sum={int(counts @ np.arange(256))};distinct={int((counts > 0).sum())};mode={int(counts.argmax())};mode_count={int(counts.max())}"


def store(documents: DataFrame, root: str, level: int = 6, shard_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards under ``root`` when run; rows: doc_id, n_bytes, digest, shard, offset, length."""
    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        part, system, folder = TaskContext.get().partitionId(), *filesystem(root)
        state: dict = {"out": None}

        def begin():
            system.create_dir(folder, recursive=True)
            state.update(tmp=f"{folder}/{uuid.uuid4().hex}.tmp", seen={}, rows=[], at=0, sum=hashlib.sha256())
            state["out"] = system.open_output_stream(state["tmp"])

        def finish():
            state["out"].write(b"\0" * 1024)
            state["out"].close()
            state["out"] = None
            name = f"shard-{part:06d}-{state['sum'].hexdigest()[:16]}.tar"
            system.move(state["tmp"], f"{folder}/{name}")
            uri = f"{root}/{name}"
            rows = state["rows"]
            for at in range(0, len(rows), 8192):
                columns = list(zip(*[(d, n, g, uri, *state["seen"][g]) for d, n, g in rows[at : at + 8192]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in pieces(batches, 2000):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if state["out"] is None:
                    begin()
                if digest not in state["seen"]:
                    media = encode_media(payload, level)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    state["out"].write(head + media + b"\0" * (-len(media) % 512))
                    state["seen"][digest] = (state["at"] + len(head), len(media))
                    state["at"] += len(head) + len(media) + -len(media) % 512
                    state["sum"].update(digest.encode())
                state["rows"].append((doc_id, n, digest))
                if state["at"] >= shard_bytes:
                    yield from finish()
        if state["out"] is not None:
            yield from finish()

    return map_batches(doc_texts(documents, id_col, text_col), run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def _dealt(media: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """The rows in as many tasks as the stored bytes behind them ask for: the rows themselves are small.  ``media`` is a written table."""
    stored = media.select("shard", "offset", "length").distinct().agg(F.sum("length")).first()[0] or 0
    tasks = min(READ_TASKS, max(1, -(-int(stored) // read_bytes)))
    return media.repartition(tasks, F.col("shard"), F.floor(F.col("offset") / SPAN)).sortWithinPartitions("shard", "offset")


def header_columns(media: DataFrame) -> DataFrame:
    """Adds width, height and bit_depth, read from the headers alone."""
    names = [f.name for f in media.schema.fields]

    def run(batches):
        reader, last = RangeReader(), (None, None)
        for batch in batches:
            rows = []
            for where in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist()):
                if where != last[0]:
                    last = where, decode_header(reader.read(*where, HEADER_BYTES))
                rows.append(last[1])
            extra = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "width", "height", "bit_depth"])
        reader.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return map_batches(media, run, schema + ", width long, height long, bit_depth long")


def decoded_columns(media: DataFrame) -> DataFrame:
    """Reads each member back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        reader = RangeReader()
        for batch in pieces(batches, 4000):
            rows = batch.to_pylist()
            out, block, span, last = [], b"", (None, 0, 0), (None, None)
            for k, row in enumerate(rows):
                where = row["shard"], row["offset"]
                if where != last[0]:
                    if span[0] != row["shard"] or row["offset"] + row["length"] > span[2]:
                        near = [r for r in rows[k : k + 4000] if r["shard"] == row["shard"] and r["offset"] < row["offset"] + SPAN // 2]
                        span = (row["shard"], row["offset"], max(r["offset"] + r["length"] for r in near))
                        block = reader.read(span[0], span[1], span[2] - span[1])
                    data = block[row["offset"] - span[1] :][: row["length"]]
                    samples = decode_media(data)
                    digest = hashlib.sha256(samples).hexdigest()
                    if digest != row["digest"]:
                        raise ValueError(f"{row['shard']} at {row['offset']}: the payload isn't the one named")
                    last = where, (len(samples), digest, zlib.crc32(samples[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(samples))
                out.append((row["doc_id"], row["n_bytes"], *last[1], row["width"], row["height"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        reader.close()

    return map_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def query(spark, sf_dir):
    root = staging(spark, "media")
    media = stage(store(read_table(spark, sf_dir, "documents"), f"{root}/shards"), f"{root}/rows")
    return decoded_columns(header_columns(_dealt(media)))
