"""Files in the shared folder: texts in bounded pieces, and binary files.

A *chunk* is one Parquet file of a saved table, bounded in rows or, by
``save_texts``, in bytes (one longer text is a file of its own).
What a job has gathered for a chunk comes back keyed by the chunk, and the task
reads the chunk's file itself, so whole texts are never shuffled. A lost task
is simply run again: the files are complete before anything reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, scratch_path
from .words import SLICE_BYTES, slices

CHUNK_ROWS = 8192


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style address."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def attempt_name(folder: str, suffix: str) -> str:
    """A file name that no other attempt of this task uses.

    Only names that a finished task has returned are ever read, so the file of
    an attempt that was lost is never seen.
    """
    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


def new_folder(spark, label: str) -> str:
    """A new folder below the shared one; the first file written creates it."""
    return scratch_path(spark, label)


def open_output(uri: str) -> pa.NativeFile:
    fs, path = located(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def save_chunks(df: DataFrame, label: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Write a table in files of at most ``rows`` rows; returns its files as (chunk, path), saved.

    ``chunk`` is a hash of the path, for the rows that are gathered for a file.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    files = written.select(F.input_file_name().alias("path")).distinct()
    return saved(files.select(F.xxhash64("path").alias("chunk"), "path"), f"{label}-files")


def save_texts(df: DataFrame, label: str, size: int) -> DataFrame:
    """Write a table with a column ``text`` in files of about ``size`` bytes of text; returns (chunk, path), saved.

    Tasks write their rows as they come, so nothing is shuffled and a file holds
    few long texts or many short ones.
    """
    folder = scratch_path(df.sparkSession, label)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, writer, held, path = 0, None, None, 0, ""
        for batch in batches:
            for low, high in slices(batch["text"], min(size, SLICE_BYTES)):
                part = batch.slice(low, high - low)
                if writer is None:
                    path = attempt_name(folder, f"-{number}.parquet")
                    out = open_output(path)
                    writer = pq.ParquetWriter(out, part.schema, compression="zstd")
                writer.write_batch(part)
                held += part["text"].nbytes
                if held >= size:
                    writer.close()
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path]})
                    number, writer, held = number + 1, None, 0
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    written = saved(df.mapInArrow(write, "path string"), f"{label}-files")
    return written.select(F.xxhash64("path").alias("chunk"), "path")


def per_file(files: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(chunk, path)``, a generator of record batches, for every file, about one file to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, path in zip(batch["chunk"].to_pylist(), batch["path"].to_pylist(), strict=True):
                yield from fn(chunk, path)

    return files.repartition(max(1, files.count()), "chunk").mapInArrow(run, schema)


def per_chunk(files: DataFrame, gathered: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(chunk, path, columns)`` for every file with the rows (chunk, ...) gathered for it.

    ``columns`` holds numpy arrays of long columns; a file for which nothing was
    gathered gets empty ones. What is gathered for a file must be bounded by the
    file's size.
    """
    names = [c for c in gathered.columns if c != "chunk"]
    rows = gathered.select("chunk", *names, F.lit(None).cast("string").alias("path")).union(
        files.select("chunk", *[F.lit(None).cast("long").alias(c) for c in names], "path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, path, held = None, None, []
        for batch in batches:
            keys = batch["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if chunk is not None and keys[low] != chunk:
                    yield from fn(int(chunk), path, _columns(held, names))
                    path, held = None, []
                chunk, part = keys[low], batch.slice(low, high - low)
                marker = part.filter(part["path"].is_valid())
                if marker.num_rows:
                    path = marker["path"][0].as_py()
                    part = part.filter(part["path"].is_null())
                held.append(part)
        if chunk is not None:
            yield from fn(int(chunk), path, _columns(held, names))

    return rows.repartition(max(1, files.count()), "chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


def _columns(held: list[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c].to_numpy(zero_copy_only=False).astype(np.int64) for p in held]) if held else np.empty(0, np.int64) for c in names}


def read_chunk(uri: str, columns: list[str], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    fs, path = located(uri)
    with fs.open_input_file(path) as file:
        yield from pq.ParquetFile(file).iter_batches(batch_size=rows, columns=columns)
