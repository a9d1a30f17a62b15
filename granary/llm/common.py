"""Shared pieces: staging folders on shared storage, file access from tasks, row streams."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    folder = tempfile.mkdtemp(prefix="granary-package-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{name}-{uuid.uuid4().hex}", "zip", os.path.dirname(root), name))
    _SHIPPED.add(context.applicationId)


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to the executors, once per application; ``shipped`` finds it there by the name returned (contents and base name)."""
    context = spark.sparkContext
    with open(path, "rb") as file:
        name = f"{hashlib.sha256(file.read()).hexdigest()[:16]}-{os.path.basename(path)}"
    if f"{context.applicationId}/{name}" not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="granary-file-")  # on the driver, which serves it to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addFile(shutil.copyfile(path, f"{folder}/{name}"))
        _SHIPPED.add(f"{context.applicationId}/{name}")
    return name


def shipped(name: str) -> str:
    """Inside a task: where the file that ``ship_file`` sent lies on this machine."""
    return SparkFiles.get(name)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only a local session
    (one machine, as in tests) may lack that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="granary-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def staging(spark: SparkSession, label: str) -> str:
    """A new folder under the shared root; removed when the driver ends."""
    path = f"{shared_root(spark)}/granary-{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _drop_staged() -> None:
    from pyarrow import fs

    for spark, path in _STAGED:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone: without it
            try:
                system, folder = filesystem(path)
                if system.get_file_info(folder).type == fs.FileType.Directory:
                    system.delete_dir(folder)
            except Exception as error:  # noqa: BLE001 - the interpreter ends
                print(f"left behind: {path} ({error})", file=sys.stderr)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet to shared storage and reads it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works in a task on any executor."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, parts: Iterable[bytes]) -> int:
    """Writes under a name of its own, then moves it into place: a retried task replaces equal bytes."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(temporary, path)
    return size


class RangeReader:
    """Reads byte ranges of files by URI and keeps a few handles open."""

    def __init__(self, keep: int = 32):
        self._open: dict[str, object] = {}
        self._keep = keep

    def read(self, uri: str, offset: int, length: int) -> bytes:
        handle = self._open.pop(uri, None)
        if handle is None:
            system, path = filesystem(uri)
            handle = system.open_input_file(path)
            if len(self._open) >= self._keep:
                self._open.pop(next(iter(self._open))).close()
        self._open[uri] = handle
        data = handle.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{uri}: {length} bytes at {offset} wanted, {len(data)} found")
        return data

    def close(self) -> None:
        for handle in self._open.values():
            handle.close()
        self._open.clear()


def pieces(batches: Iterable[pa.RecordBatch], rows: int, byte_limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``byte_limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, n * byte_limit // max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def doc_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
