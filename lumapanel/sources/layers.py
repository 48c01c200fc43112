"""Raster layers as tables: alignment and recognition of layer files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

CELL = ("yr", "r", "c")
LAYERS = ("median", "average", "cf_cvg", "lit_mask")


def read_pixels(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, year: str = "yr", box: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """Pixel table partitioned by year; only the asked partitions are read.

    ``box`` (first row, last row, first column, last column) skips the files and
    row groups that hold none of its rows.
    """
    px = nan_to_null(spark.read.parquet(path))
    if years is not None:
        px = px.filter(F.col(year).isin(list(years)))
    if box is not None:
        px = px.filter(F.col("r").between(box[0], box[1]) & F.col("c").between(box[2], box[3]))
    return px


def write_pixels(px: DataFrame, path: str, year: str = "yr") -> None:
    """Partition by year, sorted by cell so that box filters skip row groups."""
    px.repartition(year, F.floor(F.col("r") / 64)).sortWithinPartitions(year, "r", "c").write.mode("overwrite").partitionBy(
        year
    ).parquet(path)


def align_layers(layers: Mapping[str, DataFrame], years: Sequence[int] | None = None, cell=CELL) -> DataFrame:
    """One row per cell of the first layer with the other layers beside it.

    A layer that is not given simply adds no column, so filters on it do nothing.
    """
    names = list(layers)
    pick = (lambda df: df.filter(F.col(cell[0]).isin(list(years)))) if years is not None else (lambda df: df)
    out = pick(layers[names[0]])
    for name in names[1:]:
        out = out.join(pick(layers[name]).select(*cell, name), list(cell), "left")
    return nan_to_null(out)


def layer_of(name: Column) -> Column:
    """Layer of a file name, the most specific pattern first; unknown gives NULL."""
    low = F.lower(name)
    return (
        F.when(low.contains("median_masked"), "median")
        .when(low.contains("average_masked") | low.contains("avg_rade9h"), "average")
        .when(low.contains("cf_cvg"), "cf_cvg")
        .when(low.contains("lit_mask"), "lit_mask")
    )


def identify_layers(files: DataFrame, path: str = "path", group: str = "yr") -> DataFrame:
    """One file per (year, layer).

    Of several median files the ``vcmcfg`` composite wins over ``vcmslcfg``;
    otherwise the last path in order counts.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    known = files.withColumn("layer", layer_of(name)).filter(F.col("layer").isNotNull())
    clean = (F.col("layer") == "median") & F.lower(name).contains("vcmcfg")
    # Among plain median files the first seen stays, elsewhere the last one does.
    first_wins = (F.col("layer") == "median") & ~F.lower(name).contains("vcmcfg")
    w = Window.partitionBy(group, "layer").orderBy(
        clean.desc(), F.when(first_wins, F.col(path)).asc_nulls_first(), F.col(path).desc()
    )
    return known.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(group, "layer", path)


def missing_layers(present: DataFrame, years: Sequence[int], layers: Sequence[str] = LAYERS, year: str = "yr") -> DataFrame:
    """(year, layer) combinations that were asked for but are not there."""
    spark = present.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias(year)).withColumn(
        "layer", F.explode(F.array(*[F.lit(x) for x in layers]))
    )
    return asked.join(present.select(year, "layer"), [year, "layer"], "left_anti")
