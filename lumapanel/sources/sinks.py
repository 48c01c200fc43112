"""Table and per-group file sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import district_key
from ..operators.ordering import numbered
from ..session import saved
from .files import located, pieces


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result table that later steps read again."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


ROWS_PER_FILE = 1_000_000


def in_sized_files(df: DataFrame, keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt to tasks so that each key gets files after its measured number of rows.

    A small key is one file, a large one as many as its rows need, by a hash of
    the row; equal rows stay together, and ``maxRecordsPerFile`` cuts those. Keys
    may be null.
    """
    keys = list(keys)
    sizes = saved(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")), "key-sizes")
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_files")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    dealt = df.join(named, same).withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    return dealt.repartition(*keys, "_file").select(*df.columns)


def census_outputs(rows: DataFrame, year: int, folder: str, keep: list[str]) -> dict[str, str]:
    """District totals, all district rows, one folder per district, and all towns."""
    paths = {
        "totals": f"{folder}/census_{year}_pca",
        "districts": f"{folder}/{year}/all_districts",
        "by_district": f"{folder}/{year}/by_district",
        "towns": f"{folder}/census_{year}_towns",
    }
    is_district = F.col("level") == "DISTRICT"
    write_table(rows.filter(is_district & (F.col("tru") == "Total")).select("district", *keep), paths["totals"], "csv")
    write_table(rows.filter(is_district), paths["districts"], "csv")
    by_district = in_sized_files(rows, ["district_code"]).write.mode("overwrite").partitionBy("district_code")
    by_district.option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(paths["by_district"])
    write_table(rows.filter(F.col("level") == "TOWN"), paths["towns"], "csv")
    return paths


def write_places(df: DataFrame, district: str, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One CSV folder per district, with the coordinates still to be found; large districts have several files."""
    out = df.withColumns(
        {"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "geocode_status": F.lit("pending"), "district_key": district_key(district)}
    )
    parts = in_sized_files(out, ["district_key"], rows_per_file).write.mode("overwrite").partitionBy("district_key")
    parts.option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_document(spark: SparkSession, pieces: Sequence[str | DataFrame], path: str, order: str = "rank", text: str = "value") -> None:
    """Write one text document, such as a JSON collection, as ordered part files.

    A piece is fixed text or a table of (``order``, ``text``): its texts follow in
    that order with commas between them. All pieces go to one job that cuts them
    at measured boundaries, so a part holds a stretch of the document, and header,
    rows and footer are committed together. The part files in the order of their
    names, one after the other, are the document; ``join_document`` makes one file
    of them.
    """
    lines = None
    for k, piece in enumerate(pieces):
        if isinstance(piece, str):
            rows = spark.range(1).select(F.lit(k).alias("_piece"), F.lit(0).cast("long").alias("_n"), F.lit(piece).alias("value"))
        else:
            placed = numbered(piece.select(order, text), [], [order, text], "_n")
            line = F.concat(F.when(F.col("_n") > 0, ",").otherwise(""), F.col(text))
            rows = placed.select(F.lit(k).alias("_piece"), F.col("_n").cast("long").alias("_n"), line.alias("value"))
        lines = rows if lines is None else lines.unionByName(rows)
    ordered = lines.repartitionByRange("_piece", "_n").sortWithinPartitions("_piece", "_n")
    ordered.select("value").write.mode("overwrite").text(path)


def join_document(spark: SparkSession, path: str, target: str) -> str:
    """Copy the part files of a document into one file, a little at a time; returns its address.

    One file has one writer; it holds a megabyte at once. The file appears under
    its name only when it is whole.
    """
    from pyspark import TaskContext

    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = located(target)
        part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for source, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                    theirs, at = located(source)
                    with theirs.open_input_file(at) as file:
                        for piece in pieces(file, 0, size):
                            out.write(piece)
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"target": [target]})

    return parts.coalesce(1).sortWithinPartitions("path").mapInArrow(copy, "target string").first()[0]
