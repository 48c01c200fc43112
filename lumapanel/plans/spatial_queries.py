"""Distance, ring, wedge and nearest-location queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.scalars import suitability
from ..operators import pixels as P
from ..operators import spatial as X
from ..functions.columns import literal_rows
from ..operators.domes import BACKGROUND, K_MAX, MIN_RINGS, NEGLIGIBLE, STEPS, light_domes
from ..operators.polygons import Grid, join_cells
from .pixel_queries import R6
from .registry import BOX, GRID, add_view, query, years_of

RADIUS = 60.0
BUFFER = 30.0
RINGS = (20.0, 40.0, 60.0, 80.0, 120.0)

HAV = """2 * 6371.0 * atan2(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) *
 pow(sin(radians({b}lon - {a}lon) / 2), 2)), sqrt(1 - (pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) *
 cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"""
BEAR = """fmod(degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) -
 sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon)))) + 360.0, 360.0)"""


def hav(a: str, b: str) -> str:
    return HAV.format(a=a + ".", b=b + ".")


def bear(a: str, b: str) -> str:
    return BEAR.format(a=a + ".", b=b + ".")


add_view(
    "near",
    "pixels sites",
    f"""SELECT p.*, s.site_id, {hav('p', 's')} AS km, {bear('s', 'p')} AS angle FROM pixels p, sites s""",
)
add_view("near_city", "pixels cities", f"SELECT p.*, s.city_id, {hav('p', 's')} AS km FROM pixels p, cities s")


def _loc(df, key):
    return df.select(key, F.col("lat").alias("loc_lat"), F.col("lon").alias("loc_lon"))


@query("p10_haversine", "sites cities", f"SELECT s.site_id, c.city_id, round({hav('s', 'c')}, 6) AS km FROM sites s JOIN cities c ON s.site_id % 25 = c.city_id")
def _(t):
    both = t.sites.withColumn("city_id", F.col("site_id") % 25).join(
        t.cities.select("city_id", F.col("lat").alias("b"), F.col("lon").alias("l")), "city_id"
    )
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("b"), F.col("l"))
    return both.select("site_id", "city_id", F.round(km, 6).alias("km"))


@query(
    "p11_bearing_compass",
    "sites cities",
    f"""WITH b AS (SELECT s.site_id, c.city_id, {bear('s', 'c')} AS a FROM sites s JOIN cities c ON s.site_id % 25 = c.city_id)
    SELECT site_id, city_id, round(a, 6) AS bearing, ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(round_even(a / 45, 0) AS INT) % 8] AS direction FROM b""",
)
def _(t):
    both = t.sites.withColumn("city_id", F.col("site_id") % 25).join(
        t.cities.select("city_id", F.col("lat").alias("b"), F.col("lon").alias("l")), "city_id"
    )
    a = G.bearing_deg(F.col("lat"), F.col("lon"), F.col("b"), F.col("l"))
    return both.select("site_id", "city_id", F.round(a, 6).alias("bearing"), G.compass8(a).alias("direction"))


@query(
    "p22_bounding_box",
    "sites",
    """SELECT site_id, NOT (lat BETWEEN 16.5 AND 21 AND lon BETWEEN 73.5 AND 79) AS outside,
     NOT (lat BETWEEN 16 AND 21.5 AND lon BETWEEN 73 AND 79.5) AS outside_with_margin FROM sites""",
)
def _(t):
    lat, lon = F.col("lat"), F.col("lon")
    return t.sites.select(
        "site_id",
        (~G.in_box(lat, lon, BOX)).alias("outside"),
        (~G.in_box(lat, lon, BOX, 0.5)).alias("outside_with_margin"),
    )


@query(
    "j02_buffer_join",
    "near",
    f"SELECT site_id, yr, count(*) AS n, round(sum(km), 4) AS km_sum, round(avg(med), 6) AS mean_value FROM near WHERE km <= {RADIUS} GROUP BY 1, 2",
)
def _(t):
    pairs = X.within_distance(t.pixels, _loc(t.sites, "site_id"), RADIUS)
    return pairs.groupBy("site_id", "yr").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("distance_km"), 4).alias("km_sum"), F.round(F.avg("med"), 6).alias("mean_value")
    )


@query(
    "j02_buffer_join_clipped",
    "near zone_pixels",
    f"""SELECT site_id, n.yr, count(*) AS n, round(avg(n.med), 6) AS mean_value FROM near n
    JOIN zone_pixels z ON n.yr = z.yr AND n.r = z.r AND n.c = z.c WHERE km <= {RADIUS} GROUP BY 1, 2""",
)
def _(t):
    pairs = X.within_distance(join_cells(t.pixels, t.spans).drop("zone"), _loc(t.sites, "site_id"), RADIUS)
    return pairs.groupBy("site_id", "yr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("med"), 6).alias("mean_value"))


RING_SQL = "CASE WHEN km <= 20 THEN 20.0 WHEN km <= 40 THEN 40.0 WHEN km <= 60 THEN 60.0 WHEN km <= 80 THEN 80.0 ELSE 120.0 END"


@query(
    "j03_ring_join",
    "near_city",
    f"SELECT city_id, CAST({RING_SQL} AS DOUBLE) AS ring_km, yr, count(*) AS n FROM near_city WHERE km <= 120 GROUP BY 1, 2, 3",
)
def _(t):
    pairs = X.ring_pairs(t.pixels, _loc(t.cities, "city_id"), RINGS)
    return pairs.groupBy("city_id", "ring_km", "yr").agg(F.count(F.lit(1)).alias("n"))


TOUCH_GRID = Grid(72.5, 22.1, 1 / 240, 1 / 240)
TOUCH_RINGS = (1.0, 5.0, 10.0)
# Oracle: every grid cell near a city against every side of its circles: a side that passes through the cell, or an odd
# number of sides to the west of the cell's centre.
TOUCH_CTES = f"""rings AS (SELECT city_id, lat, lon, unnest([1.0, 5.0, 5.0, 10.0, 10.0]) AS ring_km, unnest([1.0, 5.0, 1.0, 10.0, 5.0]) / 6371.0 AS d, unnest([1, 2, 3, 4, 5]) AS shape FROM cities),
  spots AS (SELECT *, i, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(i * (2 * pi() / 64))) AS yr FROM rings, (SELECT unnest(range(0, 65)) % 64 AS i, unnest(range(0, 65)) AS k)),
  verts AS (SELECT city_id, ring_km, shape, k, degrees(yr) AS y, degrees(radians(lon) + atan2(sin(i * (2 * pi() / 64)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(yr))) AS x FROM spots),
  sides AS (SELECT a.city_id, a.ring_km, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM verts a JOIN verts b ON a.city_id = b.city_id AND a.shape = b.shape AND b.k = a.k + 1),
  cells AS (SELECT city_id, CAST(floor((22.1 - lat) * 240) AS INT) + dr AS r, CAST(floor((lon - 72.5) * 240) AS INT) + dc AS c
    FROM cities, (SELECT unnest(range(-26, 27)) AS dr), (SELECT unnest(range(-28, 29)) AS dc)),
  boxes AS (SELECT *, 72.5 + c / 240.0 AS w, 72.5 + (c + 1) / 240.0 AS e, 22.1 - r / 240.0 AS n, 22.1 - (r + 1) / 240.0 AS s FROM cells),
  met AS (SELECT b.city_id, ring_km, r, c,
      greatest(0, CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN w AND e THEN 0 ELSE 2 END ELSE least((w - x1) / (x2 - x1), (e - x1) / (x2 - x1)) END,
        CASE WHEN y1 = y2 THEN CASE WHEN y1 BETWEEN s AND n THEN 0 ELSE 2 END ELSE least((s - y1) / (y2 - y1), (n - y1) / (y2 - y1)) END) AS t0,
      least(1, CASE WHEN x1 = x2 THEN 1 ELSE greatest((w - x1) / (x2 - x1), (e - x1) / (x2 - x1)) END,
        CASE WHEN y1 = y2 THEN 1 ELSE greatest((s - y1) / (y2 - y1), (n - y1) / (y2 - y1)) END) AS t1,
      (y1 > (n + s) / 2) <> (y2 > (n + s) / 2) AND x1 + ((n + s) / 2 - y1) * (x2 - x1) / (y2 - y1) < (w + e) / 2 AS crossed
    FROM boxes b JOIN sides USING (city_id)),
  touched AS (SELECT city_id, ring_km, r, c FROM met GROUP BY ALL HAVING bool_or(t0 <= t1) OR count(*) FILTER (WHERE crossed) % 2 = 1)"""


@query(
    "j03_touched_rings",
    "cities",
    f"""WITH {TOUCH_CTES} SELECT city_id, CAST(ring_km AS DOUBLE) AS ring_km, count(*) AS n, CAST(sum(r) AS BIGINT) AS r_sum, CAST(sum(c) AS BIGINT) AS c_sum FROM touched GROUP BY 1, 2""",
)
def _(t):
    """Cells of 1/240 degree that the rings of 1, 5 and 10 km around each city touch."""
    spans = X.ring_spans(_loc(t.cities, "city_id"), "city_id", TOUCH_GRID, TOUCH_RINGS)
    size = (F.col("c1") - F.col("c0") + 1).cast("long")
    cols = (F.col("c0") + F.col("c1")) * size / 2
    return spans.groupBy("city_id", "ring_km").agg(
        F.sum(size).alias("n"), F.sum(F.col("r") * size).alias("r_sum"), F.sum(cols).cast("long").alias("c_sum")
    )


@query(
    "j02_touched_buffers",
    "pixels cities",
    f"""WITH {TOUCH_CTES}, px AS (SELECT *, CAST(floor((22.1 - lat) * 240) AS INT) AS fr, CAST(floor((lon - 72.5) * 240) AS INT) AS fc FROM pixels)
    SELECT city_id, yr, count(*) AS n, round(avg(med), 6) AS mean_value FROM (SELECT DISTINCT city_id, r, c FROM touched) d JOIN px ON fr = d.r AND fc = d.c GROUP BY 1, 2""",
)
def _(t):
    """Pixels whose fine cell a disc of 10 km around each city touches."""
    px = t.pixels.withColumns({"r": TOUCH_GRID.row(F.col("lat")), "c": TOUCH_GRID.col(F.col("lon"))})
    pairs = X.touched_ring_pairs(px, _loc(t.cities, "city_id"), "city_id", TOUCH_GRID, (10.0,))
    return pairs.groupBy("city_id", "yr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("med"), 6).alias("mean_value"))


WEDGE_SQL = "CASE WHEN angle >= 315 OR angle < 45 THEN 'north' WHEN angle < 135 THEN 'east' WHEN angle < 225 THEN 'south' ELSE 'west' END"


@query("j04_wedge_join", "near", f"SELECT site_id, {WEDGE_SQL} AS direction, yr, count(*) AS n FROM near WHERE km <= {RADIUS} GROUP BY 1, 2, 3")
def _(t):
    pairs = X.wedge_pairs(t.pixels, _loc(t.sites, "site_id"), RADIUS)
    return pairs.groupBy("site_id", "direction", "yr").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j05_inside_outside_join",
    "near",
    f"""SELECT site_id, CASE WHEN km <= {RADIUS} THEN 'inside' ELSE 'outside' END AS side, yr, count(*) AS n
    FROM near WHERE km <= {RADIUS + BUFFER} GROUP BY 1, 2, 3""",
)
def _(t):
    pairs = X.side_pairs(t.pixels, _loc(t.sites, "site_id"), RADIUS, BUFFER)
    return pairs.groupBy("site_id", "side", "yr").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j06_nearest_city",
    "sites cities",
    f"""WITH d AS (SELECT s.site_id, c.name, {hav('s', 'c')} AS km, {bear('s', 'c')} AS a,
      row_number() OVER (PARTITION BY s.site_id ORDER BY {hav('s', 'c')}, c.city_id) AS rn FROM sites s, cities c)
    SELECT site_id, name AS nearest_city, round(km, 6) AS distance_km, round(a, 6) AS bearing_deg,
     ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(round_even(a / 45, 0) AS INT) % 8] AS direction FROM d WHERE rn = 1""",
)
def _(t):
    near = X.nearest_location(t.sites, t.cities, "site_id", "name", "city_id")
    return near.select("site_id", "nearest_city", *R6("distance_km", "bearing_deg"), "direction")


@query(
    "a11_radial_profile",
    "near_city cities",
    f"""WITH s AS (SELECT city_id, CAST({RING_SQL} AS DOUBLE) AS ring_km, yr, count(*) AS n, avg(med) AS mv, median(med) AS dv, stddev_pop(med) AS sv
       FROM near_city WHERE km <= 120 GROUP BY 1, 2, yr),
     k AS (SELECT city_id, yr, CAST(unnest([20, 40, 60, 80, 120]) AS DOUBLE) AS ring_km FROM cities, (SELECT DISTINCT yr FROM pixels))
    SELECT k.city_id, k.yr, k.ring_km, coalesce(n, 0) AS pixel_count, round(mv, 6) AS mean_value, round(dv, 6) AS median_value, round(sv, 6) AS std_value
    FROM k LEFT JOIN s ON k.city_id = s.city_id AND k.yr = s.yr AND k.ring_km = s.ring_km""",
)
def _(t):
    out = _profile(t)
    return out.select("city_id", "yr", "ring_km", "pixel_count", *R6("mean_value", "median_value", "std_value"))


def _profile(t):
    pairs = X.ring_pairs(t.pixels, _loc(t.cities, "city_id"), RINGS)
    return X.radial_profile(pairs, _by_year(t, t.cities.select("city_id")), ["city_id", "yr"], "med", RINGS)


def _by_year(t, locations):
    """Each location in each year of the pixels."""
    return literal_rows(locations, "yr", years_of(t.pixels))


@query(
    "a12_inside_outside",
    "near sites",
    f"""WITH s AS (SELECT site_id, yr, avg(med) FILTER (WHERE km <= {RADIUS}) AS im, median(med) FILTER (WHERE km <= {RADIUS}) AS id,
        avg(med) FILTER (WHERE km > {RADIUS}) AS om, median(med) FILTER (WHERE km > {RADIUS}) AS od
        FROM near WHERE km <= {RADIUS + BUFFER} GROUP BY 1, 2), y AS (SELECT site_id, yr FROM sites, (SELECT DISTINCT yr FROM pixels))
    SELECT y.site_id, y.yr, round(im, 6) AS inside_mean, round(id, 6) AS inside_median, round(om, 6) AS outside_mean,
      round(od, 6) AS outside_median, CASE WHEN id > 0 THEN round(od / id, 6) END AS ratio, round((od - id) / {BUFFER}, 6) AS gradient
    FROM y LEFT JOIN s ON s.site_id = y.site_id AND s.yr = y.yr""",
)
def _(t):
    pairs = X.side_pairs(t.pixels, _loc(t.sites, "site_id"), RADIUS, BUFFER)
    out = X.inside_outside(pairs, _by_year(t, t.sites.select("site_id")), ["site_id", "yr"], "med", BUFFER)
    return out.select("site_id", "yr", *R6(*[c for c in out.columns if c not in ("site_id", "yr")]))


DIR_SQL = f"""WITH y AS (SELECT site_id, yr FROM sites, (SELECT DISTINCT yr FROM pixels)),
 w AS (SELECT site_id, yr, {WEDGE_SQL} AS d, med FROM near WHERE km <= {RADIUS}),
 m AS (SELECT site_id, yr, avg(med) FILTER (WHERE d = 'north') AS n, avg(med) FILTER (WHERE d = 'east') AS e,
   avg(med) FILTER (WHERE d = 'south') AS s, avg(med) FILTER (WHERE d = 'west') AS w FROM w GROUP BY 1, 2),
 g AS (SELECT *, greatest(n, e, s, w) AS hi, least(n, e, s, w) AS lo FROM m)
"""
# Ratios of short sums can end in a 5; the nudge makes both sides round it up.
def _ratio():
    return F.round(F.col("max_min_ratio") + 1e-9, 6).alias("max_min_ratio")


DOMINANT = "CASE WHEN n = hi THEN 'NORTH' WHEN e = hi THEN 'EAST' WHEN s = hi THEN 'SOUTH' WHEN w = hi THEN 'WEST' ELSE 'N/A' END"


@query(
    "a13_directional",
    "near sites",
    DIR_SQL
    + f"""SELECT y.site_id, y.yr, round(n, 6) AS north_mean, round(e, 6) AS east_mean, round(s, 6) AS south_mean, round(w, 6) AS west_mean,
    {DOMINANT} AS dominant_direction, CASE WHEN lo > 0 THEN round(hi / lo + 1e-9, 6) END AS max_min_ratio
    FROM y LEFT JOIN g ON g.site_id = y.site_id AND g.yr = y.yr""",
)
def _(t):
    out = _directional(t)
    return out.select(
        "site_id", "yr", *R6("north_mean", "east_mean", "south_mean", "west_mean"), _ratio(), "dominant_direction"
    )


def _directional(t):
    pairs = X.wedge_pairs(t.pixels, _loc(t.sites, "site_id"), RADIUS)
    return X.directional(pairs, _by_year(t, t.sites.select("site_id")), ["site_id", "yr"], "med")


@query(
    "p27_site_suitability",
    "near sites",
    DIR_SQL
    + f""", v AS (SELECT site_id, yr, median(med) AS m FROM near WHERE km <= {RADIUS} AND lit > 0 AND cf >= 5 GROUP BY 1, 2)
    SELECT y.site_id, y.yr, round(m, 6) AS median_value, CASE WHEN m < 1 THEN 'SUITABLE' ELSE 'NOT SUITABLE' END AS suitability,
     {DOMINANT} AS dominant_direction, CASE WHEN lo > 0 THEN round(hi / lo + 1e-9, 6) END AS max_min_ratio
    FROM y LEFT JOIN g ON g.site_id = y.site_id AND g.yr = y.yr LEFT JOIN v ON v.site_id = y.site_id AND v.yr = y.yr""",
)
def _(t):
    good = P.site_quality_filter(t.pixels)
    near = X.within_distance(good, _loc(t.sites, "site_id"), RADIUS)
    stats = P.zonal_stats(near, ["site_id", "yr"], "med", _by_year(t, t.sites.select("site_id")))
    out = stats.join(_directional(t), ["site_id", "yr"], "left")
    return out.select(
        "site_id", "yr", *R6("median_value"), _ratio(), suitability("median_value").alias("suitability"), "dominant_direction"
    )


def _dome_options(name: str, rows: str) -> str:
    """Oracle: the best non-negative line in exp(-k d) for each tried rate ``k`` of (city_id, yr, d, v, k)."""
    return f"""{name}_s AS (SELECT city_id, yr, k, count(*) AS n, sum(exp(-k * d)) AS se, sum(exp(-k * d) * exp(-k * d)) AS see, sum(v) AS sy,
       sum(v * v) AS syy, sum(exp(-k * d) * v) AS sey FROM {rows} GROUP BY 1, 2, 3),
     {name}_p AS (SELECT *, CASE WHEN n * see - se * se > 1e-12 * n * see THEN (n * sey - se * sy) / (n * see - se * se) ELSE 0 END AS p FROM {name}_s),
     {name}_o AS (SELECT *, p AS peak, (sy - p * se) / n AS base FROM {name}_p WHERE p >= 0 AND (sy - p * se) / n >= 0
       UNION ALL SELECT *, greatest(CASE WHEN see <> 0 THEN sey / see ELSE 0 END, 0), 0 FROM {name}_p UNION ALL SELECT *, 0, greatest(sy / n, 0) FROM {name}_p),
     {name} AS (SELECT city_id, yr, k, peak, base, syy - 2 * (peak * sey + base * sy) + peak * peak * see + 2 * peak * base * se + base * base * n AS sse
       FROM {name}_o QUALIFY row_number() OVER (PARTITION BY city_id, yr ORDER BY sse, k, peak, base) = 1)"""


RATIO = f"(ln(CAST({K_MAX} AS DOUBLE) / CAST(1e-4 AS DOUBLE)) / {STEPS - 1})"


@query(
    "t15_light_domes",
    "near_city cities",
    f"""WITH every AS (SELECT city_id, yr FROM cities, (SELECT DISTINCT yr FROM pixels)),
     ring AS (SELECT city_id, yr, CAST({RING_SQL} AS DOUBLE) AS d, median(med) AS v FROM near_city WHERE km <= 120 GROUP BY 1, 2, 3),
     stat AS (SELECT city_id, yr, count(v) AS n, var_pop(v) AS var, list_sort(list(DISTINCT d) FILTER (WHERE v IS NOT NULL)) AS ds FROM ring GROUP BY 1, 2 HAVING count(v) >= {MIN_RINGS}),
     coarse AS (SELECT r.*, unnest(list_prepend(CAST(0 AS DOUBLE), list_transform(range(0, {STEPS}), lambda i: CAST(1e-4 AS DOUBLE) * exp(i * {RATIO})))) AS k
       FROM ring r JOIN stat USING (city_id, yr)),
     {_dome_options("first", "coarse")},
     bound AS (SELECT city_id, yr, k * exp(-{RATIO}) AS lo, CASE WHEN k = 0 THEN CAST(1e-4 AS DOUBLE) ELSE least(k * exp({RATIO}), CAST({K_MAX} AS DOUBLE)) END AS hi FROM first),
     fine AS (SELECT r.*, unnest(list_transform(range(0, {STEPS} + 1), lambda i: lo + (hi - lo) * i / {STEPS})) AS k FROM ring r JOIN bound USING (city_id, yr)),
     {_dome_options("best", "fine")},
     dome AS (SELECT b.*, CASE WHEN peak > {BACKGROUND} AND k > 0 AND base < {BACKGROUND} THEN greatest(-ln(({BACKGROUND} - base) / peak) / k, 0) END AS radius,
       CASE WHEN var > 0 THEN 1 - sse / (n * var) ELSE 0 END AS r2, base + peak * exp(-k * ds[1]) AS inner_v, k * (ds[2] - ds[1]) < -ln({NEGLIGIBLE}) AS known
       FROM best b JOIN stat USING (city_id, yr))
    SELECT e.city_id, e.yr, CASE WHEN known THEN round(peak, 3) END AS peak_radiance, CASE WHEN known THEN round(radius, 3) END AS dome_radius_km,
      CASE WHEN known THEN round(k, 4) END AS decay_rate, CASE WHEN known AND k > 0 THEN round(ln(2) / k, 3) END AS half_distance_km, round(r2, 4) AS model_r_squared,
      CASE WHEN known THEN round(pi() * radius * radius, 2) END AS effective_area_km2, round(base, 2) AS background_radiance, round(inner_v, 2) AS inner_radiance, known AS rate_determined
      FROM every e LEFT JOIN dome USING (city_id, yr)""",
)
def _(t):
    out = light_domes(_profile(t), ["city_id", "yr"], "ring_km", "median_value")
    digits = {"decay_rate": 4, "model_r_squared": 4, "effective_area_km2": 2, "background_radiance": 2, "inner_radiance": 2}
    plain = ("city_id", "yr", "rate_determined")
    return out.select(*plain, *[F.round(c, digits.get(c, 3)).alias(c) for c in out.columns if c not in plain])
