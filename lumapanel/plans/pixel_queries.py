"""Pixel-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.columns import literal_rows
from ..operators import pixels as P
from ..operators.polygons import clip_cells, join_cells, polygon_edges, zone_spans
from ..operators.ranking import summarise, top_k
from ..session import saved, scratch_path
from ..sources.layers import align_layers, read_pixels, write_pixels
from .registry import GRID, add_view, query, years_of

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

add_view("good", "zone_pixels", "SELECT * FROM zone_pixels WHERE med IS NOT NULL AND lit > 0 AND cf >= 5")
add_view("gpix", "pixels", "SELECT * FROM pixels WHERE med IS NOT NULL AND lit > 0 AND cf >= 5")


@query("s01_pixel_scan", "pixels", "SELECT yr, r, c, round(med, 6) AS med, lit, cf FROM pixels WHERE yr IN (1996, 1998)")
def _(t):
    """Each layer written by year and read back for two years only."""
    layers = {}
    for name in ("med", "lit", "cf"):
        path = scratch_path(t.spark, f"layer-{name}")
        write_pixels(t.pixels.select("yr", "r", "c", name), path)
        layers[name] = read_pixels(t.spark, path, [1996, 1998])
    return align_layers(layers).select("yr", "r", "c", F.round("med", 6).alias("med"), "lit", "cf")


@query(
    "p01_quality_filter",
    "pixels",
    "SELECT yr, r, c, round(greatest(med, 0), 6) AS med FROM pixels WHERE lit > 0 AND cf >= 5",
)
def _(t):
    return P.quality_filter(t.pixels).select("yr", "r", "c", F.round("med", 6).alias("med"))


@query("p02_site_quality_filter", "pixels", "SELECT yr, r, c, round(med, 6) AS med FROM pixels WHERE lit > 0 AND cf >= 5")
def _(t):
    return P.site_quality_filter(t.pixels).select("yr", "r", "c", F.round("med", 6).alias("med"))


@query(
    "p03_background_subtraction",
    "pixels",
    """WITH f AS (SELECT yr, quantile_cont(med, 0.01) AS flo FROM pixels WHERE med > 0 GROUP BY yr)
    SELECT p.yr, r, c, round(greatest(med - coalesce(flo, 0), 0), 6) AS med FROM pixels p LEFT JOIN f ON p.yr = f.yr""",
)
def _(t):
    return P.subtract_background(t.pixels).select("yr", "r", "c", F.round("med", 6).alias("med"))


@query(
    "p04_box_subset",
    "pixels",
    "SELECT yr, r, c, round(med, 6) AS med FROM pixels WHERE lon BETWEEN 74 AND 76.5 AND lat BETWEEN 17 AND 19.25",
)
def _(t):
    return P.box_subset(t.pixels, 74.0, 17.0, 76.5, 19.25).select("yr", "r", "c", F.round("med", 6).alias("med"))


@query(
    "p12_display_layers",
    "pixels",
    """WITH q AS (SELECT yr, quantile_cont(med, 0.995) AS top, quantile_cont(med, 0.01) AS lo, quantile_cont(med, 0.99) AS hi
                 FROM pixels GROUP BY yr),
    b AS (SELECT r, c, med AS base FROM pixels WHERE yr = (SELECT min(yr) FROM pixels)),
    d AS (SELECT p.yr, p.r, p.c, med, top, lo, hi, med - base AS diff FROM pixels p JOIN q ON p.yr = q.yr LEFT JOIN b ON p.r = b.r AND p.c = b.c)
    SELECT yr, r, c, round(log10(greatest(med, 0.01)), 6) AS log_value,
      round(pow(least(greatest(med / top, 0), 1), 0.35), 6) AS power_value,
      round(CASE WHEN diff IS NOT NULL THEN (least(greatest(diff, -5), 5) + 5) / 10 END, 6) AS change5,
      round(CASE WHEN diff IS NOT NULL THEN (least(greatest(diff, -2), 2) + 2) / 4 END, 6) AS change2,
      round(0.02 + 0.93 * pow(pow(least(greatest(med / top, 0), 1), 0.35), 0.6), 6) AS alpha_magnitude,
      round(CASE WHEN diff IS NOT NULL THEN 0.02 + 0.88 * pow(abs((least(greatest(diff, -5), 5) + 5) / 10 - 0.5) * 2, 0.55) END, 6) AS alpha_change,
      round(greatest(lo, 0.1), 6) AS range_low, round(hi, 6) AS range_high FROM d""",
)
def _(t):
    px = t.pixels
    q = saved(summarise(px, ["yr"], "med", {"top": 0.995, "lo": 0.01, "hi": 0.99}), "range")
    first = px.groupBy("r", "c").agg(
        F.min_by("med", "yr").alias("base"), F.min("yr").alias("first_yr")
    ).join(px.agg(F.min("yr").alias("first_yr")), "first_yr", "left_semi").drop("first_yr")
    d = px.join(q, "yr").join(first, ["r", "c"], "left").withColumn("diff", F.col("med") - F.col("base"))
    power, change = S.power_display("med", "top"), S.symmetric_display("diff", 5.0)
    out = {
        "log_value": S.log_display("med"),
        "power_value": power,
        "change5": change,
        "change2": S.symmetric_display("diff", 2.0),
        "alpha_magnitude": S.alpha(power, "magnitude", 0.02, 0.95, 0.6),
        "alpha_change": S.alpha(change, "diverging", 0.02, 0.90, 0.55),
        "range_low": F.greatest("lo", F.lit(0.1)),
        "range_high": F.col("hi"),
    }
    return d.select("yr", "r", "c", *[F.round(v, 6).alias(k) for k, v in out.items()])


STATS = """round(avg(med), 6) AS mean_value, round(median(med), 6) AS median_value, round(min(med), 6) AS min_value,
 round(max(med), 6) AS max_value, round(stddev_pop(med), 6) AS std_value"""


@query(
    "a01_zonal_stats",
    "good zones",
    f"""WITH g AS (SELECT zone, yr, greatest(med, 0) AS med FROM good),
    s AS (SELECT zone, yr, count(*) AS pixel_count, {STATS} FROM g GROUP BY zone, yr),
    y AS (SELECT zone, yr FROM zones, (SELECT DISTINCT yr FROM pixels))
    SELECT y.zone, y.yr, coalesce(pixel_count, 0) AS pixel_count, mean_value, median_value, min_value, max_value, std_value
    FROM y LEFT JOIN s ON y.zone = s.zone AND y.yr = s.yr""",
)
def _(t):
    spine = literal_rows(t.zones.select("zone"), "yr", years_of(t.pixels))
    out = P.zonal_stats(P.quality_filter(t.zone_pixels), ["zone", "yr"], "med", spine)
    return out.select("zone", "yr", "pixel_count", *R6("mean_value", "median_value", "min_value", "max_value", "std_value"))


@query(
    "a02_site_metrics",
    "good zone_pixels",
    f"""WITH tot AS (SELECT zone, yr, count(*) AS total_pixels FROM zone_pixels WHERE med IS NOT NULL GROUP BY zone, yr),
    s AS (SELECT zone, yr, count(*) AS valid_pixels, {STATS}, median(med) AS m FROM good GROUP BY zone, yr)
    SELECT tot.zone, tot.yr, total_pixels, coalesce(valid_pixels, 0) AS valid_pixels, mean_value, median_value, min_value,
      max_value, std_value, round(coalesce(valid_pixels, 0) / total_pixels * 100.0, 1) AS quality_pct,
      CASE WHEN m < 1 THEN 'low' WHEN m < 5 THEN 'medium' WHEN m IS NOT NULL THEN 'high' END AS alan_class
    FROM tot LEFT JOIN s ON tot.zone = s.zone AND tot.yr = s.yr""",
)
def _(t):
    out = P.site_metrics(t.zone_pixels, ["zone", "yr"])
    return out.select(
        "zone", "yr", "total_pixels", "valid_pixels", "quality_pct", "alan_class",
        *R6("mean_value", "median_value", "min_value", "max_value", "std_value"),
    )


@query(
    "a03_change_decomposition",
    "good",
    """WITH d AS (SELECT a.zone, b.med - a.med AS d FROM good a JOIN good b ON a.r = b.r AND a.c = b.c AND a.zone = b.zone
      WHERE a.yr = 1996 AND b.yr = 2000)
    SELECT zone, round(sum(CASE WHEN d > 0.5 THEN 1 ELSE 0 END) / count(*) * 100.0, 1) AS pct_brightening,
     round(sum(CASE WHEN d < -0.5 THEN 1 ELSE 0 END) / count(*) * 100.0, 1) AS pct_dimming,
     round(sum(CASE WHEN abs(d) <= 0.5 THEN 1 ELSE 0 END) / count(*) * 100.0, 1) AS pct_stable,
     round(coalesce(avg(CASE WHEN d > 0.5 THEN d END), 0), 3) AS mean_brightening,
     round(coalesce(avg(CASE WHEN d < -0.5 THEN d END), 0), 3) AS mean_dimming FROM d GROUP BY zone""",
)
def _(t):
    return P.change_decomposition(P.site_quality_filter(t.zone_pixels), 1996, 2000, ["zone"])


@query(
    "a04_quality_report",
    "zone_pixels",
    """SELECT zone, yr, count(*) AS total_pixels, count(*) FILTER (WHERE med IS NOT NULL AND lit > 0 AND cf >= 5) AS passed_all,
     count(*) FILTER (WHERE med IS NULL) AS failed_nodata, count(*) FILTER (WHERE NOT coalesce(lit > 0, false)) AS failed_lit,
     count(*) FILTER (WHERE NOT coalesce(cf >= 5, false)) AS failed_cf,
     round(count(*) FILTER (WHERE med IS NOT NULL AND lit > 0 AND cf >= 5) / count(*) * 100.0, 1) AS quality_pct
    FROM zone_pixels GROUP BY zone, yr""",
)
def _(t):
    return P.quality_report(t.zone_pixels, ["zone", "yr"])


@query(
    "a05_raster_audit",
    "pixels",
    f"""SELECT yr, count(*) AS n_valid, {STATS}, round(quantile_cont(med, 0.01), 6) AS p01, round(quantile_cont(med, 0.05), 6) AS p05,
     round(quantile_cont(med, 0.95), 6) AS p95, round(quantile_cont(med, 0.99), 6) AS p99,
     round(count(*) FILTER (WHERE med < 0.25) / count(*) * 100.0, 6) AS pct_below_025,
     round(count(*) FILTER (WHERE med < 0.5) / count(*) * 100.0, 6) AS pct_below_050
    FROM pixels WHERE med > 0 GROUP BY yr""",
)
def _(t):
    out = P.raster_audit(t.pixels)
    return out.select("yr", "n_valid", *R6(*[c for c in out.columns if c not in ("yr", "n_valid")]))


@query(
    "a06_threshold_sensitivity",
    "pixels",
    """SELECT yr, t AS threshold, count(*) AS n_total, count(*) FILTER (WHERE med < t) AS n_below,
     round(count(*) FILTER (WHERE med < t) / count(*) * 100.0, 6) AS pct_below
    FROM pixels, (SELECT CAST(unnest([0.1, 0.2, 0.25, 0.3, 0.5, 1.0]) AS DOUBLE) AS t) WHERE med > 0 GROUP BY yr, t""",
)
def _(t):
    out = P.threshold_sensitivity(t.pixels)
    return out.select("yr", "threshold", "n_total", "n_below", *R6("pct_below"))


CF_SQL = """WITH k AS (SELECT zone, CAST(t AS INT) AS cf_threshold FROM zones, (SELECT unnest([3, 5, 7, 10]) AS t)),
 s AS (SELECT p.zone, k.cf_threshold, avg(med) AS mv, median(med) AS dv, count(*) AS n FROM zone_pixels p
   JOIN k ON p.zone = k.zone AND p.cf >= k.cf_threshold WHERE p.lit > 0 AND med IS NOT NULL GROUP BY 1, 2)
"""


@query(
    "a07_cf_sensitivity",
    "zones zone_pixels",
    CF_SQL
    + """SELECT k.zone, k.cf_threshold, round(mv, 6) AS mean_value, round(dv, 6) AS median_value, coalesce(n, 0) AS valid_pixels
    FROM k LEFT JOIN s ON k.zone = s.zone AND k.cf_threshold = s.cf_threshold""",
)
def _(t):
    out = P.cf_sensitivity(t.zone_pixels, ["zone"], t.zones.select("zone"))
    return out.select("zone", "cf_threshold", *R6("mean_value", "median_value"), "valid_pixels")


@query(
    "a07_cf_sensitivity_summary",
    "zones zone_pixels",
    CF_SQL
    + """SELECT k.cf_threshold, round(avg(mv), 6) AS mean_of_means, round(stddev_samp(mv), 6) AS std_of_means,
    CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_valid
    FROM k LEFT JOIN s ON k.zone = s.zone AND k.cf_threshold = s.cf_threshold GROUP BY 1""",
)
def _(t):
    out = P.cf_sensitivity_summary(P.cf_sensitivity(t.zone_pixels, ["zone"], t.zones.select("zone")))
    return out.select("cf_threshold", *R6("mean_of_means", "std_of_means"), "total_valid")


@query(
    "a08_histogram",
    "pixels",
    """WITH v AS (SELECT yr, med FROM pixels WHERE med > 0 AND med < 2),
    s AS (SELECT yr, min(med) AS lo, max(med) AS hi, count(*) AS m FROM v GROUP BY yr),
    b AS (SELECT v.yr, lo, hi, m, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((med - lo) / ((hi - lo) / 100)), 99) AS INT) END AS bin FROM v JOIN s ON v.yr = s.yr)
    SELECT yr, CAST(bin AS INT) AS bin, round(lo + bin * ((hi - lo) / 100), 6) AS bin_start, count(*) AS n,
     round(count(*) / nullif(m * ((hi - lo) / 100), 0), 6) AS density FROM b GROUP BY yr, bin, lo, hi, m""",
)
def _(t):
    return P.histogram(t.pixels).select("yr", "bin", "n", *R6("bin_start", "density"))


def _class_pixels(t):
    return P.attach_class(t.zone_pixels, t.classes, 72.5, 67.0 / 3.0, 0.5, 1.0 / 3.0)


@query("j07_land_cover_join", "class_pixels", "SELECT zone, yr, r, c, class_id FROM class_pixels")
def _(t):
    return _class_pixels(t).select("zone", "yr", "r", "c", "class_id")


LC_NAME = """CASE class_id WHEN 1 THEN 'Forest' WHEN 2 THEN 'Shrubland' WHEN 3 THEN 'Grassland' WHEN 4 THEN 'Cropland'
 WHEN 5 THEN 'Urban/Built-up' WHEN 6 THEN 'Water' WHEN 7 THEN 'Wetland' ELSE 'Barren' END AS land_cover"""
LC_W = "CASE class_id WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.1 WHEN 6 THEN 0.5 WHEN 7 THEN 0.8 ELSE 0.2 END"


@query(
    "a09_land_cover_stats",
    "class_pixels",
    f"""SELECT {LC_NAME}, count(*) AS pixel_count, round(avg(med), 6) AS mean_value, round(median(med), 6) AS median_value,
     round(stddev_pop(med), 6) AS std_value, round(max(med), 6) AS max_value,
     round(count(*) FILTER (WHERE med > 1) / count(*) * 100.0, 6) AS pct_above_low,
     round(count(*) FILTER (WHERE med > 5) / count(*) * 100.0, 6) AS pct_above_medium,
     CAST({LC_W} AS DOUBLE) AS sensitivity, round(avg(med) * {LC_W}, 6) AS impact_score
    FROM class_pixels WHERE med >= 0 GROUP BY class_id ORDER BY impact_score DESC""",
)
def _(t):
    out = P.land_cover_stats(_class_pixels(t)).orderBy(F.desc("impact_score"))
    return out.select(
        "land_cover", "pixel_count", "sensitivity",
        *R6("mean_value", "median_value", "std_value", "max_value", "pct_above_low", "pct_above_medium", "impact_score"),
    )


@query(
    "a10_district_land_cover",
    "class_pixels",
    f"""SELECT zone, {LC_NAME}, count(*) AS pixel_count, round(avg(med), 6) AS mean_value, round(median(med), 6) AS median_value
    FROM class_pixels GROUP BY zone, class_id HAVING count(*) >= 10""",
)
def _(t):
    out = P.district_land_cover(_class_pixels(t))
    return out.select("zone", "land_cover", "pixel_count", *R6("mean_value", "median_value"))


A14 = """round(count(*) FILTER (WHERE med >= 1.5) / count(med) * 100.0, 6) AS lit_pct,
 round(count(*) FILTER (WHERE med < 0.25) / count(med) * 100.0, 6) AS dark_pct, round(avg(med), 6) AS mean_value"""


@query("a14_yearly_state", "pixels", f"SELECT yr, {A14} FROM pixels GROUP BY yr")
def _(t):
    return P.yearly_state(t.pixels, ["yr"]).select("yr", *R6("lit_pct", "dark_pct", "mean_value"))


@query("a14_yearly_state_by_zone", "zone_pixels", f"SELECT zone, yr, {A14} FROM zone_pixels GROUP BY zone, yr")
def _(t):
    return P.yearly_state(t.zone_pixels, ["zone", "yr"]).select("zone", "yr", *R6("lit_pct", "dark_pct", "mean_value"))


@query(
    "a14_change_from_baseline",
    "pixels",
    """WITH y AS (SELECT yr, avg(med) AS mv FROM pixels GROUP BY yr), b AS (SELECT mv AS bm FROM y WHERE yr = 1996),
    d AS (SELECT p.yr, avg(p.med - q.med) AS mc FROM pixels p JOIN pixels q ON p.r = q.r AND p.c = q.c AND q.yr = 1996 GROUP BY p.yr)
    SELECT y.yr, round(mv, 6) AS mean_value, round(bm, 6) AS base_mean, round(mc, 6) AS mean_change,
      CASE WHEN bm > 0 AND y.yr <> 1996 THEN round((mv - bm) / bm * 100, 6) END AS pct_change
    FROM y LEFT JOIN b ON true LEFT JOIN d ON y.yr = d.yr""",
)
def _(t):
    out = P.change_from_baseline(t.pixels, 1996)
    return out.select("yr", *R6("mean_value", "base_mean", "mean_change", "pct_change"))


@query(
    "a15_pixel_slopes",
    "pixels",
    """SELECT r, c, round(regr_slope(med, yr), 6) AS slope, count(*) AS n_years FROM pixels GROUP BY r, c""",
)
def _(t):
    return P.pixel_slopes(t.pixels).select("r", "c", *R6("slope"), "n_years")


@query(
    "a15_pixel_slopes_complete",
    "pixels",
    """SELECT r, c, round(regr_slope(med, yr), 6) AS slope, count(*) AS n_years FROM pixels GROUP BY r, c HAVING count(*) = 7""",
)
def _(t):
    return P.pixel_slopes(t.pixels, n_years=7).select("r", "c", *R6("slope"), "n_years")


@query(
    "j21_baseline_join",
    "pixels",
    """SELECT p.yr, p.r, p.c, round(p.med - q.med, 6) AS diff FROM pixels p JOIN pixels q ON p.r = q.r AND p.c = q.c AND q.yr = 1996""",
)
def _(t):
    return P.baseline_difference(t.pixels, 1996).select("yr", "r", "c", F.round("diff", 6).alias("diff"))


@query("j01_cells_in_polygons", "zone_pixels", "SELECT zone, yr, r, c FROM zone_pixels")
def _(t):
    return t.zone_pixels.select("zone", "yr", "r", "c")


@query(
    "j01_cell_centres_in_polygons",
    "pixels zones",
    """SELECT zone, yr, r, c FROM pixels p JOIN zones z
    ON p.lon > z.x0 + 0.12 AND p.lon < z.x1 - 0.12 AND p.lat > z.y0 + 0.1 AND p.lat < z.y1 - 0.1""",
)
def _(t):
    spans = zone_spans(polygon_edges(t.polygons), GRID, all_touched=False)
    return join_cells(t.pixels, spans).select("zone", "yr", "r", "c")


@query(
    "j01_clip_to_polygons",
    "zone_pixels",
    "SELECT yr, r, c FROM zone_pixels WHERE zone % 2 = 0",
)
def _(t):
    spans = zone_spans(polygon_edges(t.polygons.filter(F.col("zone") % 2 == 0)), GRID)
    return clip_cells(t.pixels, spans).select("yr", "r", "c")
