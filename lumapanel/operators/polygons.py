"""Cell-in-polygon joins by row spans.

Polygons are turned, on the polygon side, into runs of cells per grid row:
the crossings of the edges with a row's centre line give the cells whose centre
lies inside, and the part of an edge within a row's band gives the cells the
edge touches. Runs of one zone are merged, so a cell meets a zone once. The
cells themselves then need one equi-join on (row, column block) with a range
test and no aggregation, whatever the number of vertices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


@dataclass(frozen=True)
class Grid:
    """North-up grid: left and top edge, cell width and height in degrees."""

    west: float
    north: float
    width: float
    height: float

    def row(self, lat: Column) -> Column:
        return F.floor((self.north - lat) / self.height).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - self.west) / self.width).cast("int")

    def centre_lat(self, r: Column) -> Column:
        return F.lit(self.north) - (r.cast("double") + 0.5) * self.height

    def centre_lon(self, c: Column) -> Column:
        return F.lit(self.west) + (c.cast("double") + 0.5) * self.width


def polygon_edges(zones: DataFrame, zone: str = "zone", vertices: str = "vertices") -> DataFrame:
    """Edges of closed rings: one row (zone, x1, y1, x2, y2) per side."""
    v = F.col(vertices)
    size = F.size(v)
    pairs = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            F.element_at(v, i).alias("a"), F.element_at(v, F.when(i == size, 1).otherwise(i + 1)).alias("b")
        ),
    )
    side = zones.filter(size >= 3).select(F.col(zone), F.explode(pairs).alias("e"))
    side = side.select(
        zone, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")
    )
    return side.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def zone_spans(edges: DataFrame, grid: Grid, zone: str = "zone", all_touched: bool = True) -> DataFrame:
    """Disjoint runs (zone, r, c0, c1) of the cells each zone covers.

    A cell counts if its centre is inside by the even-odd rule over all rings
    of the zone (so holes work), and with ``all_touched`` also if an edge
    passes through it.
    """
    x1, y1, x2, y2 = (F.col(n) for n in ("x1", "y1", "x2", "y2"))
    top, bottom = F.greatest(y1, y2), F.least(y1, y2)
    banded = edges.withColumn("r", F.explode(F.sequence(grid.row(top), grid.row(bottom))))
    mid = grid.centre_lat(F.col("r"))
    crossing = banded.filter((y1 > mid) != (y2 > mid)).select(
        zone, "r", (x1 + (mid - y1) * (x2 - x1) / (y2 - y1)).alias("x")
    )
    along = Window.partitionBy(zone, "r").orderBy("x")
    runs = (
        crossing.withColumn("k", F.row_number().over(along))
        .withColumn("to", F.lead("x").over(along))
        .filter((F.col("k") % 2 == 1) & F.col("to").isNotNull())
    )
    first = F.ceil((F.col("x") - grid.west) / grid.width - 0.5).cast("int")
    last = (F.ceil((F.col("to") - grid.west) / grid.width - 0.5) - 1).cast("int")
    spans = runs.select(zone, "r", first.alias("c0"), last.alias("c1")).filter(F.col("c0") <= F.col("c1"))
    if all_touched:
        hi = F.lit(grid.north) - F.col("r") * grid.height
        lo = hi - grid.height
        slope = F.try_divide(x2 - x1, y2 - y1)
        at = lambda y: F.when(y1 == y2, None).otherwise(x1 + (y - y1) * slope)
        xa = F.coalesce(at(F.least(hi, top)), F.least(x1, x2))
        xb = F.coalesce(at(F.greatest(lo, bottom)), F.greatest(x1, x2))
        touched = banded.select(
            zone, "r", grid.col(F.least(xa, xb)).alias("c0"), grid.col(F.greatest(xa, xb)).alias("c1")
        )
        spans = spans.unionByName(touched)
    line = Window.partitionBy(zone, "r").orderBy("c0", "c1")
    prior = line.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("c0") > F.coalesce(F.max("c1").over(prior), F.col("c0") - 2) + 1
    return (
        spans.withColumn("_new", starts.cast("int"))
        .withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(zone, "r", "_run")
        .agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
        .drop("_run")
    )


def join_cells(cells: DataFrame, spans: DataFrame, r: str = "r", c: str = "c") -> DataFrame:
    """Inner join of cells with the zones covering them."""
    blocked = spans.withColumn(
        "_blk", F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK)))
    ).withColumnRenamed("r", "_r")
    left = cells.withColumn("_cb", F.floor(F.col(c) / BLOCK))
    hit = (F.col(r) == F.col("_r")) & (F.col("_cb") == F.col("_blk")) & F.col(c).between(F.col("c0"), F.col("c1"))
    return left.join(blocked, hit).drop("_r", "_blk", "_cb", "c0", "c1")


def clip_cells(cells: DataFrame, spans: DataFrame, r: str = "r", c: str = "c") -> DataFrame:
    """Cells covered by any zone, each once."""
    blocked = spans.withColumn(
        "_blk", F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK)))
    ).withColumnRenamed("r", "_r")
    left = cells.withColumn("_cb", F.floor(F.col(c) / BLOCK))
    hit = (F.col(r) == F.col("_r")) & (F.col("_cb") == F.col("_blk")) & F.col(c).between(F.col("c0"), F.col("c1"))
    return left.join(blocked, hit, "left_semi").drop("_cb")
