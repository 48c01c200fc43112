import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumapanel.operators import polygons as P
from lumapanel.operators import spatial as X

GRID = P.Grid(0.0, 10.0, 0.5, 0.5)
SHAPES = {
    "box": [[(1.1, 1.1), (4.2, 1.1), (4.2, 3.9), (1.1, 3.9)]],
    "ell": [[(5.1, 1.1), (9.3, 1.1), (9.3, 3.2), (7.1, 3.2), (7.1, 6.3), (5.1, 6.3)]],
    "holed": [[(0.6, 5.2), (4.6, 5.2), (4.6, 9.4), (0.6, 9.4)], [(1.8, 6.4), (3.4, 6.4), (3.4, 8.1), (1.8, 8.1)]],
    "spike": [[(5.3, 7.1), (9.4, 8.25), (5.3, 9.7)]],
    "vertex_on_row_centre": [[(8.2, 4.25), (9.6, 5.25), (8.2, 6.25), (7.7, 5.25)]],
}


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def clips(x1, y1, x2, y2, west, south, east, north):
    """Does the segment meet the closed rectangle?"""
    t0, t1 = 0.0, 1.0
    for p, q in ((x1 - x2, x1 - west), (x2 - x1, east - x1), (y1 - y2, y1 - south), (y2 - y1, north - y1)):
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return t0 <= t1


def brute(touched):
    out = set()
    for zone, rings in SHAPES.items():
        for r in range(20):
            for c in range(20):
                w, n = c * 0.5, 10 - r * 0.5
                hit = inside(w + 0.25, n - 0.25, rings)
                if touched and not hit:
                    hit = any(
                        clips(*a, *b, w, n - 0.5, w + 0.5, n)
                        for ring in rings
                        for a, b in zip(ring, ring[1:] + ring[:1])
                    )
                if hit:
                    out.add((zone, r, c))
    return out


@pytest.mark.parametrize("touched", [True, False])
def test_cells_in_polygons_equal_brute_force(spark, touched):
    rows = [(z, 0, i, [(float(x), float(y)) for x, y in ring]) for z, rings in SHAPES.items() for i, ring in enumerate(rings)]
    zones = spark.createDataFrame(rows, "zone string, part int, ring int, vertices array<struct<x:double,y:double>>")
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"))
    spans = P.zone_spans(P.polygon_edges(zones), GRID, all_touched=touched)
    got = P.join_cells(cells, spans).collect()
    assert {(g.zone, g.r, g.c) for g in got} == brute(touched)
    assert len(got) == len({(g.zone, g.r, g.c) for g in got})
    clipped = {(g.r, g.c) for g in P.clip_cells(cells, spans).collect()}
    assert clipped == {(r, c) for _, r, c in brute(touched)}


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(88, 90, 30), rng.uniform(-5, 5, 60)])
    lon = np.concatenate([rng.uniform(-180, 180, 180), rng.choice([-179.9, 179.9, -180.0], 60)])
    return pd.DataFrame({"id": np.arange(240), "lat": lat, "lon": lon})


@pytest.mark.parametrize("radius", [300.0, 2500.0])
def test_within_distance_across_poles_and_date_line(spark, points, radius):
    locs = points.iloc[::6].rename(columns={"id": "loc", "lat": "loc_lat", "lon": "loc_lon"})
    got = X.within_distance(spark.createDataFrame(points), spark.createDataFrame(locs), radius).collect()
    want = {
        (p.id, q.loc) for p in points.itertuples() for q in locs.itertuples() if km(p.lat, p.lon, q.loc_lat, q.loc_lon) <= radius
    }
    assert {(g.id, g["loc"]) for g in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("n_cities", [3, 40])
def test_nearest_location_equals_brute_force(spark, points, n_cities):
    cities = points.iloc[:: 240 // n_cities].rename(columns={"id": "city"}).copy()
    twin = cities.iloc[[0]].assign(city=999)
    cities = pd.concat([twin, cities])
    got = X.nearest_location(spark.createDataFrame(points), spark.createDataFrame(cities), "id", "city", "city").collect()
    assert len(got) == len(points)
    for g in got:
        p = points.iloc[g.id]
        best = min((km(p.lat, p.lon, c.lat, c.lon), c.city) for c in cities.itertuples())
        assert g.distance_km == pytest.approx(best[0], abs=1e-6)
        assert g.nearest_city != 999


def test_rings_and_compass(spark):
    from lumapanel.functions.geo import compass8, wedge

    d = spark.createDataFrame([(0.0,), (1.0,), (1.01,), (50.0,)], "d double")
    assert [r[0] for r in d.select(X.ring_of(F.col("d"))).collect()] == [1.0, 1.0, 5.0, 50.0]
    b = spark.createDataFrame([(22.5,), (67.5,), (359.0,), (315.0,), (45.0,)], "b double")
    assert [tuple(r) for r in b.select(compass8(F.col("b")), wedge(F.col("b"))).collect()] == [
        ("N", "north"), ("E", "east"), ("N", "north"), ("NW", "north"), ("NE", "east"),
    ]


def test_cells_that_a_small_ring_touches(spark):
    grid = P.Grid(70.0, 20.0, 1.0, 1.0)  # cells about 110 km wide
    rows = [("middle", 15.5, 75.5), ("edge", 15.5, 76.0), ("corner", 15.0, 77.0), ("nowhere", None, 75.0)]
    places = spark.createDataFrame(rows, "name string, loc_lat double, loc_lon double")
    cells = spark.range(400).selectExpr("CAST(id DIV 20 AS INT) AS r", "CAST(id % 20 AS INT) AS c")
    got = {}
    for p in X.touched_ring_pairs(cells, places, "name", grid, (1.0, 5.0)).collect():
        got.setdefault((p["name"], p["ring_km"]), set()).add((p["r"], p["c"]))
    at = {"middle": {(4, 5)}, "edge": {(4, 5), (4, 6)}, "corner": {(4, 6), (4, 7), (5, 6), (5, 7)}}
    # Both the disc and the annulus around it touch these cells, though none of their centres lies in either.
    assert got == {(name, ring): found for name, found in at.items() for ring in (1.0, 5.0)} | {("middle", 1.0): {(4, 5)}}
    centres = X.ring_spans(places, "name", grid, (1.0, 5.0), all_touched=False)
    assert [(r["name"], r["ring_km"]) for r in centres.collect()] == [("middle", 1.0)]


def test_inner_cells_belong_to_the_disc_only(spark):
    grid = P.Grid(70.0, 20.0, 1 / 240, 1 / 240)
    places = spark.createDataFrame([(1, 15.5, 75.5)], "k int, loc_lat double, loc_lon double")
    cells = {ring: set() for ring in (5.0, 10.0)}
    for s in X.ring_spans(places, "k", grid, (5.0, 10.0)).collect():
        cells[s["ring_km"]] |= {(s["r"], c) for c in range(s["c0"], s["c1"] + 1)}
    both = cells[5.0] & cells[10.0]
    middle = (int((20 - 15.5) * 240), int(5.5 * 240))
    assert middle in cells[5.0] - both and 60 < len(both) < 140  # about the cells on the inner circle
    area = len(cells[5.0] | cells[10.0]) * (111.19 / 240) ** 2 * math.cos(math.radians(15.5))
    assert math.pi * 100 < area < math.pi * 100 * 1.12


def test_pairs_of_few_points_spread_over_all_tasks(spark):
    points = spark.range(1600).select((F.col("id") % 40 * 0.2 + 15).alias("lat"), (F.floor(F.col("id") / 40) * 0.2 + 72).alias("lon")).coalesce(1)
    places = spark.range(300).select("id", (F.col("id") % 17 * 0.4 + 15.3).alias("loc_lat"), (F.col("id") % 19 * 0.4 + 72.3).alias("loc_lon")).coalesce(1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in X.within_distance(points, places, 90.0).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) == tasks and max(sizes) < 2 * sum(sizes) / tasks
