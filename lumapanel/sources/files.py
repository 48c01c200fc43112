"""Files of any size by byte ranges, read on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
PIECE_BYTES = 1 << 20


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style address."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, length) of every file below a folder that isn't empty; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


def dealt(rows: DataFrame, number: int) -> DataFrame:
    """Rows of (path, block, ...) over as many tasks as there are blocks; left alone, Spark puts such short rows into one."""
    return rows.repartition(max(1, number), "path", "block")


def blocks(files: DataFrame, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(path, length, block, start, size) of every block of a saved (path, length), and how many there are."""
    last = F.ceil(F.col("length") / size).cast("long") - 1
    number = files.agg(F.sum(last + 1)).first()[0] or 0
    rows = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    rows = rows.withColumn("start", F.col("block") * size).withColumn("size", F.least(F.lit(size), F.col("length") - F.col("start")))
    return dealt(rows, number), number


def pieces(file: pa.NativeFile, start: int, size: int, step: int = PIECE_BYTES) -> Iterator[bytes]:
    """The bytes of a range, a little at a time."""
    file.seek(start)
    left = size
    while left > 0 and (data := file.read(min(step, left))):
        left -= len(data)
        yield data
