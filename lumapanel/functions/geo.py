"""Great-circle expressions on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
DIRECTIONS = ["north", "east", "south", "west"]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    sa = F.sin((p2 - p1) / 2.0)
    sb = F.sin(F.radians(lon2 - lon1) / 2.0)
    h = sa * sa + F.cos(p1) * F.cos(p2) * sb * sb
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1.0 - h, F.lit(0.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2 in [0, 360)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def compass8(bearing: Column) -> Column:
    """Eight-point compass label; halves round to the even sector."""
    sector = F.pmod(F.bround(bearing / 45.0, 0).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), sector + 1)


def wedge(bearing: Column) -> Column:
    """Quadrant of a bearing: north is 315-45 and so on clockwise."""
    return (
        F.when((bearing >= 315) | (bearing < 45), "north")
        .when(bearing < 135, "east")
        .when(bearing < 225, "south")
        .otherwise("west")
    )


def in_box(lat: Column, lon: Column, box: dict[str, float], margin: float = 0.0) -> Column:
    """Inclusive bounding-box test."""
    return lat.between(box["south"] - margin, box["north"] + margin) & lon.between(
        box["west"] - margin, box["east"] + margin
    )
