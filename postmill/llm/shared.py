"""Files that tasks write into the shared folder, outside Spark's own formats."""

from __future__ import annotations

import ctypes
import functools
import io
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from postmill.session import scratch_dir


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below ``spark.checkpoint.dir`` (see session.scratch_dir)."""
    return scratch_dir(spark, name)


#: Rows of an Arrow batch. Spark's default of 10,000 is meant for numbers; so many texts fill buffers on both sides of the pipe to Python.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batches_of_texts(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of BATCH_ROWS rows, if it still has Spark's default."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that ends by giving freed memory back. Spark keeps its workers between stages, and their memory counts beside the executor's heap."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), path


@contextmanager
def whole_file(path: str) -> Iterator[BinaryIO]:
    """A stream for a file of which readers see all or nothing.

    A task that runs twice (a lost executor, speculation) writes the same bytes; each attempt has a name of its own until the move.
    """
    system, at = filesystem(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    attempt = f"{at}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(attempt) as out:
        yield out
    system.move(attempt, at)


def put_array(path: str, values: np.ndarray) -> None:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(np.ascontiguousarray(values)))
    with whole_file(path) as out:
        out.write(head.getvalue())
        if values.size:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B"))


def map_array(path: str) -> np.ndarray:
    """A stored array, memory-mapped. From a store that has no local path it is copied once per worker into the worker's temporary folder."""
    system, at = filesystem(path)
    if not isinstance(system, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), f"postmill-{os.getpid()}-{urlsplit(path).path.replace('/', '_')}")
        if not os.path.exists(local):
            fs.copy_files(at, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        at = local
    return np.load(at, mmap_mode="r")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Extra ones don't reach the operator, even if their names clash with its own or differ from these in case alone."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"c{df.columns.index(n)}"].alias(n) for n in names])
