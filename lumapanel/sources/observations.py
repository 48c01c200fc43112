"""Observation scans and the partitioned split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number
from ..functions.names import state_key
from .sinks import ROWS_PER_FILE, in_sized_files

ERA_YEAR = 1991


def read_observations(spark: SparkSession, path: str, keys: DataFrame | None = None, spread: int | None = None) -> DataFrame:
    """Tab-separated observations with coordinates and month; only used columns are parsed.

    A gzip file is read by one task; ``spread`` deals its parsed rows to so many
    tasks before any other work.
    """
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    out = raw.select(
        F.col("speciesKey").alias("species_key"),
        F.col("scientificName").alias("scientific_name"),
        number("decimalLatitude").alias("lat"),
        number("decimalLongitude").alias("lon"),
        number("month").cast("int").alias("month"),
        number("year").cast("int").alias("year"),
        number("individualCount").alias("individuals"),
    ).dropna(subset=["lat", "lon", "month"])
    if spread:
        out = out.repartition(spread)
    if keys is not None:
        out = out.join(keys.select("species_key").distinct(), "species_key", "left_semi")
    return out


def read_second_source(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated observations: renamed, dated, located, from the modern era."""
    raw = spark.read.option("header", True).csv(path)
    seen = F.try_to_timestamp(F.col("observed_on"))
    out = raw.select(
        F.col("id").alias("row_id"),
        number("latitude").alias("lat"),
        number("longitude").alias("lon"),
        F.col("scientific_name"),
        F.col("common_name").alias("species"),
        seen.cast("date").alias("observed_on"),
        F.month(seen).alias("month"),
        F.year(seen).alias("year"),
    )
    return out.dropna(subset=["lat", "lon", "scientific_name", "observed_on"]).filter(F.col("year") >= ERA_YEAR)


def era_of(year: Column) -> Column:
    """'modern' from 1991 on; anything that is no year is 'archive'."""
    return F.when(F.coalesce(F.trim(year).try_cast("int"), F.lit(0)) >= ERA_YEAR, "modern").otherwise("archive")


def split_keys(rows: DataFrame, state: str, year: str) -> DataFrame:
    """Rows with their target file key; rows without a state are skipped."""
    ok = rows.filter(F.coalesce(F.length(F.trim(F.col(state))), F.lit(0)) > 0)
    return ok.withColumn("state_key", state_key(state)).withColumn("era", era_of(F.col(year).cast("string")))


def write_split(rows: DataFrame, state: str, year: str, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per (state, era), with as many files as the measured number of its rows needs."""
    parts = in_sized_files(split_keys(rows, state, year), ["state_key", "era"], rows_per_file).write.mode("overwrite")
    parts = parts.partitionBy("state_key", "era").option("maxRecordsPerFile", rows_per_file)
    parts = parts.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)  # values stay as they are
    parts.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def split_counts(rows: DataFrame, state: str, year: str) -> DataFrame:
    """Rows per target, and the skipped ones under 'skipped'."""
    blank = F.coalesce(F.length(F.trim(F.col(state))), F.lit(0)) == 0
    name = F.when(blank, "skipped").otherwise(F.concat(state_key(state), F.lit("_"), era_of(F.col(year).cast("string"))))
    return rows.groupBy(name.alias("file_key")).agg(F.count(F.lit(1)).alias("n"))
