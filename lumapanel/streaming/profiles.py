"""Monthly profiles kept up to date over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observations import monthly_sums
from ..session import scratch_path

COMPACT_EVERY = 20


class KeyedTable:
    """A table of the latest row per key, written batch by batch.

    A batch holds only the rows that it changed, in a folder named by its number,
    so writing it again replaces it by the same. Every ``compact_every`` batches
    the latest rows are written together, and readers start from there. Folders
    that aren't finished are never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.schema, self.keys, self.compact_every = spark, path, schema, list(keys), compact_every

    def _finished(self) -> dict[str, list[int]]:
        """Numbers of the finished folders of each kind."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = {"batch": [], "whole": []}
        for status in fs.listStatus(root) if fs.exists(root) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and fs.exists(jvm.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
        return found

    def read(self, upto: int | None = None) -> DataFrame:
        """The latest row of every key, as of batch ``upto`` or the last one."""
        done = self._finished()
        last = max(done["batch"] + done["whole"], default=-1) if upto is None else upto
        base = max((n for n in done["whole"] if n <= last), default=-1)
        paths = [(n, f"{self.path}/batch={n}") for n in sorted(done["batch"]) if base < n <= last]
        if base >= 0:
            paths.insert(0, (base, f"{self.path}/whole={base}"))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        names = [f.name for f in self.schema]
        # The number of a row's batch is in the name of its folder.
        rows = self.spark.read.schema(self.schema).parquet(*[p for _, p in paths])
        number = F.regexp_extract(F.col("_metadata.file_path"), "(?:batch|whole)=([0-9]+)/[^/]*$", 1).cast("long")
        others = [n for n in names if n not in self.keys]
        latest = rows.withColumn("_at", number).groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_at").alias("_row"))
        return latest.select(*self.keys, "_row.*").select(*names)

    def merge(self, changed: DataFrame, batch: int) -> None:
        """Take the changed rows of a batch; a repeated batch changes nothing."""
        changed.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if (batch + 1) % self.compact_every == 0:
            self.read(batch).write.mode("overwrite").parquet(f"{self.path}/whole={batch}")


def stream_monthly_sums(
    spark: SparkSession, folder: str, schema, keys: list[str], checkpoint: str | None = None, table: str = "monthly_sums",
    files_per_trigger: int = 1000, fmt: str = "parquet", prepare=None, compact_every: int = COMPACT_EVERY, **cols,
) -> DataFrame:
    """Running counts and sums per key over all files that have arrived.

    State is one row per key, which months and species bound. Takes what is
    there and stops; the checkpoint folder lets a later call continue, also when
    nothing new has arrived. A batch writes the keys whose sums it changed to a
    table beside the checkpoint; a repeated batch changes nothing there, and a
    broken one is never seen.
    """
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)
    sums = monthly_sums(prepare(rows) if prepare else rows, keys, **cols)
    result = KeyedTable(spark, f"{checkpoint}-{table}", sums.schema, keys, compact_every)
    query = (
        sums.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(result.merge)
        .start()
    )
    query.awaitTermination()
    return result.read()
