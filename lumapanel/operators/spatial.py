"""Distance joins between points and locations.

Distances are great-circle distances of cell centres. Points and locations meet
through latitude/longitude buckets a quarter of a radius high, so each join is an
equi-join followed by the exact test. No side is forced into a broadcast: Spark
picks one where the size allows. Both sides are dealt to as many tasks as the
session has shuffle partitions: a join's output is far larger than either side, so
tasks cut after the size of its input would be too few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over
from ..functions.geo import DIRECTIONS, EARTH_RADIUS_KM, bearing_deg, compass8, haversine_km, wedge
from ..session import saved
from .polygons import Grid, join_cells, polygon_edges, zone_spans
from .ranking import summarise

RING_LIMITS_KM = (1.0, 5.0, 10.0, 20.0, 50.0)
CIRCLE_SIDES = 64
BUCKETS_PER_RADIUS = 4
KM_PER_DEG = math.pi * EARTH_RADIUS_KM / 180.0


def within_distance(
    points: DataFrame,
    locations: DataFrame,
    radius_km: float,
    lat: str = "lat",
    lon: str = "lon",
    loc_lat: str = "loc_lat",
    loc_lon: str = "loc_lon",
) -> DataFrame:
    """All (point, location) pairs at most ``radius_km`` apart, with ``distance_km``."""
    reach = radius_km / KM_PER_DEG
    strips = max(1, int(180.0 // (reach / BUCKETS_PER_RADIUS)))
    sectors = max(1, int(360.0 // (2.0 * reach / BUCKETS_PER_RADIUS)))
    tall, wide = 180.0 / strips, 360.0 / sectors

    def band(y: Column) -> Column:
        return F.least(F.greatest(F.floor((y + 90.0) / tall), F.lit(0)), F.lit(strips - 1)).cast("int")

    def sector(x: Column) -> Column:
        return F.floor((x + 180.0) / wide).cast("int")

    here = points.withColumn("_band", band(F.col(lat))).withColumn("_sector", F.pmod(sector(F.col(lon)), F.lit(sectors)))
    la, lo = F.col(loc_lat), F.col(loc_lon)
    # Half-width in longitude of a cap of this radius; all around near a pole.
    sine = math.sin(radius_km / EARTH_RADIUS_KM) / F.cos(F.radians(la))
    half = F.when((F.abs(la) + reach < 90.0) & (sine < 1.0), F.degrees(F.asin(sine))).otherwise(F.lit(180.0))
    # A hair wider than the cap so rounding cannot lose a bucket.
    half = half + 1e-9
    first, last = sector(lo - half), sector(lo + half)
    last = F.least(last, first + (sectors - 1))
    there = (
        locations.withColumn("_b", F.explode(F.sequence(band(la - reach - 1e-9), band(la + reach + 1e-9))))
        .withColumn("_s", F.explode(F.sequence(first, last)))
        .withColumn("_s", F.pmod(F.col("_s"), F.lit(sectors)))
    )
    km = haversine_km(F.col(lat), F.col(lon), la, lo)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here, there = here.repartition(tasks, "_band", "_sector"), there.repartition(tasks, "_b", "_s")
    joined = here.join(there, (F.col("_band") == F.col("_b")) & (F.col("_sector") == F.col("_s")))
    out = joined.drop("_band", "_sector", "_b", "_s").withColumn("distance_km", km)
    return out.filter(F.col("distance_km") <= radius_km)


def ring_of(distance: Column, limits: Sequence[float] = RING_LIMITS_KM) -> Column:
    """Outer radius of the annulus (inner, outer] holding the distance; the first is a full disc."""
    out = F.when(distance <= limits[0], F.lit(float(limits[0])))
    for limit in limits[1:]:
        out = out.when(distance <= limit, F.lit(float(limit)))
    return out


def ring_pairs(points, locations, limits: Sequence[float] = RING_LIMITS_KM, **names) -> DataFrame:
    pairs = within_distance(points, locations, float(limits[-1]), **names)
    return pairs.withColumn("ring_km", ring_of(F.col("distance_km"), limits))


def wedge_pairs(points, locations, radius_km: float, lat="lat", lon="lon", loc_lat="loc_lat", loc_lon="loc_lon"):
    """Points near each location with the quadrant they lie in."""
    pairs = within_distance(points, locations, radius_km, lat, lon, loc_lat, loc_lon)
    angle = bearing_deg(F.col(loc_lat), F.col(loc_lon), F.col(lat), F.col(lon))
    return pairs.withColumn("direction", wedge(angle))


def side_pairs(points, locations, radius_km: float, buffer_km: float, **names) -> DataFrame:
    """Points inside the radius, or in the band of ``buffer_km`` around it."""
    pairs = within_distance(points, locations, radius_km + buffer_km, **names)
    return pairs.withColumn("side", F.when(F.col("distance_km") <= radius_km, "inside").otherwise("outside"))


def circle(lat: Column, lon: Column, radius_km: Column | float, sides: int = CIRCLE_SIDES) -> Column:
    """Vertices (x: longitude, y: latitude) of a circle on the globe, clockwise from the north."""
    reach = radius_km / F.lit(EARTH_RADIUS_KM) if not isinstance(radius_km, float) else F.lit(radius_km / EARTH_RADIUS_KM)
    phi, lam = F.radians(lat), F.radians(lon)

    def vertex(i: Column) -> Column:
        angle = i * (2.0 * math.pi / sides)
        y = F.asin(F.sin(phi) * F.cos(reach) + F.cos(phi) * F.sin(reach) * F.cos(angle))
        x = lam + F.atan2(F.sin(angle) * F.sin(reach) * F.cos(phi), F.cos(reach) - F.sin(phi) * F.sin(y))
        return F.struct(F.degrees(x).alias("x"), F.degrees(y).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), vertex)


def ring_spans(
    locations: DataFrame, key: str, grid: Grid, limits: Sequence[float] = RING_LIMITS_KM, loc_lat: str = "loc_lat", loc_lon: str = "loc_lon",
    all_touched: bool = True, sides: int = CIRCLE_SIDES,
) -> DataFrame:
    """Disjoint runs (key, ring_km, r, c0, c1) of the cells of each location's annuli; the first is a full disc.

    With ``all_touched`` a cell belongs to every annulus that it shares any area
    with, so cells on a circle are in two. A disc far smaller than a cell still
    has the cells it touches. The runs come from the circles alone, whatever the
    number of cells; no cell is tested against a location. Locations without a
    position have none.
    """
    known = locations.filter(F.col(loc_lat).isNotNull() & F.col(loc_lon).isNotNull())
    inner = [None, *[float(v) for v in limits[:-1]]]
    # An annulus is its outer circle with the inner one as a hole.
    shapes = F.array(*[
        F.struct(F.lit(float(outer)).alias("ring_km"), F.lit(radius).alias("radius"))
        for outer, hole in zip(limits, inner, strict=True) for radius in (float(outer), hole) if radius
    ])
    rings = known.select(F.col(key), loc_lat, loc_lon, F.inline(shapes))
    rings = rings.select(F.struct(key, "ring_km").alias("zone"), circle(F.col(loc_lat), F.col(loc_lon), F.col("radius"), sides).alias("vertices"))
    spans = zone_spans(polygon_edges(rings), grid, all_touched=all_touched)
    return spans.select(F.col(f"zone.{key}").alias(key), F.col("zone.ring_km").alias("ring_km"), "r", "c0", "c1")


def touched_ring_pairs(cells: DataFrame, locations: DataFrame, key: str, grid: Grid, limits: Sequence[float] = RING_LIMITS_KM, **settings) -> DataFrame:
    """All (cell, location, ring) of cells (r, c, ...) that an annulus touches, by one equi-join on rows and column blocks."""
    return join_cells(cells, ring_spans(locations, key, grid, limits, **settings))


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def radial_profile(pairs: DataFrame, spine: DataFrame, key: str | Sequence[str], value: str, limits=RING_LIMITS_KM) -> DataFrame:
    """Statistics per (location, ring); rings without points stay with count 0.

    ``key`` may be several columns, such as location and year.
    """
    keys = _names(key)
    stats = summarise(
        pairs, [*keys, "ring_km"], value, {"median_value": 0.5}, mean="mean_value", std="std_value", count="pixel_count"
    )
    rings = spine.select(*keys).distinct().withColumn(
        "ring_km", F.explode(F.array(*[F.lit(float(x)) for x in limits]))
    )
    return rings.join(stats, [*keys, "ring_km"], "left").withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))


def inside_outside(pairs: DataFrame, spine: DataFrame, key: str | Sequence[str], value: str, buffer_km: float) -> DataFrame:
    """Mean and median of both sides, their ratio and the gradient per km."""
    keys = _names(key)
    stats = summarise(pairs, [*keys, "side"], value, {"med": 0.5}, mean="avg")
    pick = lambda side, what: F.max(F.when(F.col("side") == side, F.col(what)))
    wide = stats.groupBy(*keys).agg(
        pick("inside", "avg").alias("inside_mean"),
        pick("inside", "med").alias("inside_median"),
        pick("outside", "avg").alias("outside_mean"),
        pick("outside", "med").alias("outside_median"),
    )
    inner, outer = F.col("inside_median"), F.col("outside_median")
    out = spine.select(*keys).distinct().join(wide, keys, "left")
    return out.withColumn("ratio", F.when(inner > 0, outer / inner)).withColumn("gradient", (outer - inner) / buffer_km)


def directional(pairs: DataFrame, spine: DataFrame, key: str | Sequence[str], value: str) -> DataFrame:
    """Mean per quadrant, the brightest quadrant and the bright/dark ratio."""
    keys = _names(key)
    wide = pairs.groupBy(*keys).pivot("direction", DIRECTIONS).agg(F.avg(value))
    out = spine.select(*keys).distinct().join(wide, keys, "left")
    vals = [F.col(d) for d in DIRECTIONS]
    top, low = F.greatest(*vals), F.least(*vals)
    best = F.lit("N/A")
    for d in reversed(DIRECTIONS):
        best = F.when(F.col(d) == top, d.upper()).otherwise(best)
    out = out.withColumn("dominant_direction", best).withColumn("max_min_ratio", F.when(low > 0, over(top, low)))
    return out.select(
        *keys, *[F.col(d).alias(f"{d}_mean") for d in DIRECTIONS], "dominant_direction", "max_min_ratio"
    )


NEAREST_LEVELS_DEG = (0.5, 4.0, 30.0)


def nearest_location(
    sites: DataFrame,
    cities: DataFrame,
    site: str,
    city: str,
    ordinal: str,
    lat: str = "lat",
    lon: str = "lon",
    levels: Sequence[float] = NEAREST_LEVELS_DEG,
) -> DataFrame:
    """The closest city of every site, the earliest by ``ordinal`` on equal distance.

    Sites look at their own and the eight surrounding cells, first on a fine
    grid, then only the still open sites on coarser ones. A site is settled once
    its best city is nearer than anything outside those nine cells can be. Sites
    that stay open compare with all cities in the end, which needs every city to
    be more than about a third of the globe away. Cities sharing their
    coordinates are merged to the earliest one beforehand.
    """
    town = (
        cities.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .groupBy(F.col(lat).alias("_clat"), F.col(lon).alias("_clon"))
        .agg(F.min(F.struct(F.col(ordinal).alias("ord"), F.col(city).alias("id"))).alias("_who"))
    )
    none = F.lit(None).cast(
        f"struct<km:double,ord:{cities.schema[ordinal].dataType.simpleString()},"
        f"id:{cities.schema[city].dataType.simpleString()},clat:double,clon:double>"
    )
    state = sites.select(F.col(site), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).withColumn("_best", none)
    state = state.withColumn("_open", F.lit(True))
    for level in [*levels, 180.0]:
        whole = level >= 180.0
        rows, cols = (1, 1) if whole else (max(1, round(180.0 / level)), max(1, round(360.0 / level)))
        tall, wide = 180.0 / rows, 360.0 / cols
        band = lambda y: F.least(F.floor((y + 90.0) / tall), F.lit(rows - 1)).cast("int")  # noqa: B023,E731
        sector = lambda x: F.pmod(F.floor((x + 180.0) / wide).cast("int"), F.lit(cols))  # noqa: B023,E731
        # The last level is one cell for the whole globe, which only open sites enter.
        steps = (0,) if whole else (-1, 0, 1)
        b, s = band(F.col("_lat")), sector(F.col("_lon"))
        around = [F.struct((b + i).alias("b"), F.pmod(s + j, F.lit(cols)).alias("s")) for i in steps for j in steps]
        cells = F.array_distinct(F.array(*around))
        placed = town.withColumn("_b", band(F.col("_clat"))).withColumn("_s", sector(F.col("_clon")))
        # Settled sites don't join again.
        settled_before, state = state.filter(~F.col("_open")), state.filter(F.col("_open"))
        looking = state.withColumn("_cell", F.explode_outer(cells))
        looking = looking.withColumn("_cb", F.col("_cell.b")).withColumn("_cs", F.col("_cell.s")).drop("_cell")
        seen = looking.join(placed, (F.col("_cb") == F.col("_b")) & (F.col("_cs") == F.col("_s")), "left")
        found = F.when(
            F.col("_who").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull(),
            F.struct(
                haversine_km(F.col("_lat"), F.col("_lon"), F.col("_clat"), F.col("_clon")).alias("km"),
                F.col("_who.ord").alias("ord"),
                F.col("_who.id").alias("id"),
                F.col("_clat").alias("clat"),
                F.col("_clon").alias("clon"),
            ),
        )
        state = seen.groupBy(site, "_lat", "_lon").agg(
            F.min(F.least(found, F.col("_best"))).alias("_best"), F.max("_open").alias("_open")
        )
        if not whole:
            # Nothing outside the nine cells is nearer than one cell in either direction.
            edge = EARTH_RADIUS_KM * F.asin(
                F.cos(F.radians(F.col("_lat"))) * math.sin(math.radians(min(tall, wide, 90.0)))
            )
            settled = F.coalesce(F.col("_best.km") < F.greatest(edge, F.lit(0.0)), F.lit(False))
            state = state.withColumn("_open", F.col("_open") & ~settled)
        # Written once, as both parts of the next level read it.
        state = saved(state.unionByName(settled_before), "nearest")
    angle = bearing_deg(F.col("_lat"), F.col("_lon"), F.col("_best.clat"), F.col("_best.clon"))
    return state.select(
        F.col(site),
        F.col("_best.id").alias("nearest_city"),
        F.col("_best.km").alias("distance_km"),
        angle.alias("bearing_deg"),
        compass8(angle).alias("direction"),
    )
