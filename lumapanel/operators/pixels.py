"""Pixel-table operators: filters, zonal statistics, audits and per-pixel change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_rows, over
from ..functions.scalars import ALAN_LOW, ALAN_MEDIUM, alan_class
from ..session import saved
from .ranking import summarise

# Filter limits, change limit, land-cover classes and weights.
CF_MIN = 5
DARK_BELOW, LIT_FROM = 0.25, 1.5
CHANGE_LIMIT = 0.5
CF_TESTED = (3, 5, 7, 10)
RADIANCE_TESTED = (0.1, 0.2, 0.25, 0.3, 0.5, 1.0)
LAND_COVER = [
    (1, "Forest", 0.9),
    (2, "Shrubland", 0.7),
    (3, "Grassland", 0.6),
    (4, "Cropland", 0.4),
    (5, "Urban/Built-up", 0.1),
    (6, "Water", 0.5),
    (7, "Wetland", 0.8),
    (8, "Barren", 0.2),
]


def passes(value: str = "med", lit: str | None = "lit", cf: str | None = "cf", cf_min: int | Column = CF_MIN) -> Column:
    """Present, lit, and seen often enough; an absent layer filters nothing."""
    ok = F.col(value).isNotNull()
    if lit:
        ok = ok & F.coalesce(F.col(lit) > 0, F.lit(False))
    if cf:
        ok = ok & F.coalesce(F.col(cf) >= cf_min, F.lit(False))
    return ok


def quality_filter(px: DataFrame, value="med", lit="lit", cf="cf", cf_min=CF_MIN, clip_negative=True) -> DataFrame:
    have = set(px.columns)
    kept = px.filter(passes(value, lit if lit in have else None, cf if cf in have else None, cf_min))
    return kept.withColumn(value, F.greatest(F.col(value), F.lit(0.0))) if clip_negative else kept


def site_quality_filter(px: DataFrame, value="med", lit="lit", cf="cf", cf_min=CF_MIN) -> DataFrame:
    """The stricter form: every layer must exist and negatives stay."""
    missing = [n for n in (value, lit, cf) if n not in px.columns]
    if missing:
        raise ValueError(f"layers missing: {missing}")
    return px.filter(passes(value, lit, cf, cf_min))


def subtract_background(px: DataFrame, value="med", year="yr", share: float = 0.01) -> DataFrame:
    """Take each year's low percentile of positive values off, never below zero."""
    # One row per year; written so that the join knows its size and leaves the pixels in place.
    floor = saved(summarise(px.filter(F.col(value) > 0), [year], value, {"_floor": share}), "floor")
    out = px.join(floor, year, "left")
    return out.withColumn(
        value, F.when(F.col(value).isNotNull(), F.greatest(F.col(value) - F.coalesce("_floor", F.lit(0.0)), F.lit(0.0)))
    ).drop("_floor")


def box_subset(px: DataFrame, west: float, south: float, east: float, north: float, lat="lat", lon="lon") -> DataFrame:
    return px.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def zonal_stats(px: DataFrame, keys: Sequence[str], value: str = "med", spine: DataFrame | None = None) -> DataFrame:
    """Mean, median, count, min, max and population deviation per group.

    Groups of ``spine`` without pixels stay, with NULL statistics and count 0.
    """
    stats = summarise(
        px,
        keys,
        value,
        {"median_value": 0.5},
        mean="mean_value",
        low="min_value",
        high="max_value",
        std="std_value",
        count="pixel_count",
    )
    if spine is None:
        return stats
    out = spine.join(stats, list(keys), "left")
    return out.withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))


def site_metrics(px: DataFrame, keys: Sequence[str], value="med", lit="lit", cf="cf", cf_min=CF_MIN, spine=None) -> DataFrame:
    """Statistics of the good pixels, the share of good ones and the light class."""
    totals = px.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_pixels"))
    good = zonal_stats(site_quality_filter(px, value, lit, cf, cf_min), keys, value).withColumnRenamed(
        "pixel_count", "valid_pixels"
    )
    base = totals if spine is None else spine.join(totals, list(keys), "left")
    out = base.join(good, list(keys), "left").withColumns(
        {
            "total_pixels": F.coalesce("total_pixels", F.lit(0)),
            "valid_pixels": F.coalesce("valid_pixels", F.lit(0)),
        }
    )
    out = out.withColumn("quality_pct", F.round(over("valid_pixels", "total_pixels") * 100.0, 1))
    return out.withColumn("alan_class", alan_class("median_value", unknown=None))


def change_decomposition(px, early: int, late: int, keys, cell=("r", "c"), value="med", year="yr", limit=CHANGE_LIMIT):
    """Share of brightening, dimming and stable pixels between two years."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(value)))
    both = (
        px.filter(F.col(year).isin(early, late))
        .groupBy(*keys, *cell)
        .agg((at(late) - at(early)).alias("diff"))
        .filter(F.col("diff").isNotNull())
    )
    d = F.col("diff")
    up, down = d > limit, d < -limit
    n = F.count(F.lit(1))
    share = lambda cond: F.round(F.count_if(cond) / n * 100.0, 1)
    return both.groupBy(*keys).agg(
        share(up).alias("pct_brightening"),
        share(down).alias("pct_dimming"),
        share(~up & ~down).alias("pct_stable"),
        F.round(F.coalesce(F.avg(F.when(up, d)), F.lit(0.0)), 3).alias("mean_brightening"),
        F.round(F.coalesce(F.avg(F.when(down, d)), F.lit(0.0)), 3).alias("mean_dimming"),
    )


def quality_report(px: DataFrame, keys: Sequence[str], value="med", lit="lit", cf="cf", cf_min=CF_MIN) -> DataFrame:
    total = F.count(F.lit(1))
    ok = F.count_if(passes(value, lit, cf, cf_min))
    return px.groupBy(*keys).agg(
        total.alias("total_pixels"),
        ok.alias("passed_all"),
        F.count_if(F.col(value).isNull()).alias("failed_nodata"),
        F.count_if(~F.coalesce(F.col(lit) > 0, F.lit(False))).alias("failed_lit"),
        F.count_if(~F.coalesce(F.col(cf) >= cf_min, F.lit(False))).alias("failed_cf"),
        F.round(ok / total * 100.0, 1).alias("quality_pct"),
    )


def raster_audit(px: DataFrame, year="yr", value="med") -> DataFrame:
    """Distribution of each year's positive values."""
    below = lambda limit: lambda v, n: F.sum(F.when(v < limit, n).otherwise(0)) / F.sum(n) * 100.0
    return summarise(
        px.filter(F.col(value) > 0),
        [year],
        value,
        {"p01": 0.01, "p05": 0.05, "median_value": 0.5, "p95": 0.95, "p99": 0.99},
        mean="mean_value",
        low="min_value",
        high="max_value",
        std="std_value",
        count="n_valid",
        extra={"pct_below_025": below(0.25), "pct_below_050": below(0.5)},
    )


def threshold_sensitivity(px: DataFrame, year="yr", value="med", limits=RADIANCE_TESTED) -> DataFrame:
    """Positive pixels below each limit; all limits are counted in one pass."""
    counts = [F.count_if(F.col(value) < t).alias(f"_{i}") for i, t in enumerate(limits)]
    wide = px.filter(F.col(value) > 0).groupBy(year).agg(F.count(F.lit(1)).alias("n_total"), *counts)
    recs = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n_below")) for i, t in enumerate(limits)]
    )
    return wide.select(year, "n_total", F.inline(recs)).withColumn("pct_below", over("n_below", "n_total") * 100.0)


def cf_sensitivity(px, keys, spine: DataFrame, value="med", lit="lit", cf="cf", limits=CF_TESTED) -> DataFrame:
    """Statistics per group under each coverage limit.

    A pixel is paired only with the limits it passes.
    """
    passed = F.filter(F.array(*[F.lit(t) for t in limits]), lambda t: t <= F.col(cf))
    tried = px.filter(passes(value, lit, None)).withColumn("cf_threshold", F.explode(passed))
    stats = summarise(tried, [*keys, "cf_threshold"], value, {"median_value": 0.5}, mean="mean_value", count="valid_pixels")
    all_rows = literal_rows(spine, "cf_threshold", list(limits))
    out = all_rows.join(stats, [*keys, "cf_threshold"], "left")
    return out.withColumn("valid_pixels", F.coalesce("valid_pixels", F.lit(0)))


def cf_sensitivity_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("cf_threshold").agg(
        F.avg("mean_value").alias("mean_of_means"),
        F.stddev_samp("mean_value").alias("std_of_means"),
        F.sum("valid_pixels").alias("total_valid"),
    )


def histogram(px: DataFrame, year="yr", value="med", top: float = 2.0, bins: int = 100) -> DataFrame:
    """Equal-width density histogram of values in (0, top) between each year's extremes."""
    inside = px.filter((F.col(value) > 0) & (F.col(value) < top))
    ends = inside.groupBy(year).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n_year"))
    span = saved(ends, "span")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0))
    binned = inside.join(span, year).withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    counted = binned.groupBy(year, "bin", "lo", "hi", "n_year").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        year,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        "n",
        F.try_divide(F.col("n").cast("double"), F.col("n_year") * width).alias("density"),
    )


def attach_class(px: DataFrame, classes: DataFrame, west, north, width, height, lat="lat", lon="lon") -> DataFrame:
    """Nearest-neighbour class of each pixel centre from a class grid (cr, cc, class_id)."""
    cell = px.withColumn("_cr", F.floor((F.lit(north) - F.col(lat)) / height).cast("int")).withColumn(
        "_cc", F.floor((F.col(lon) - F.lit(west)) / width).cast("int")
    )
    hit = (F.col("_cr") == F.col("cr")) & (F.col("_cc") == F.col("cc"))
    return cell.join(classes, hit).drop("_cr", "_cc", "cr", "cc")


def land_cover_stats(px: DataFrame, class_id="class_id", value="med") -> DataFrame:
    """Light per land-cover class, its sensitivity weight and impact score."""
    above = lambda limit: lambda v, n: F.sum(F.when(v > limit, n).otherwise(0)) / F.sum(n) * 100.0
    stats = summarise(
        px.filter(F.col(value) >= 0),
        [class_id],
        value,
        {"median_value": 0.5},
        mean="mean_value",
        high="max_value",
        std="std_value",
        count="pixel_count",
        extra={"pct_above_low": above(ALAN_LOW), "pct_above_medium": above(ALAN_MEDIUM)},
    )
    return name_classes(stats, class_id).withColumn("impact_score", F.col("mean_value") * F.col("sensitivity"))


def name_classes(df: DataFrame, class_id="class_id") -> DataFrame:
    """Known class names and weights; unknown classes are dropped."""
    name = weight = None
    for i, label, w in LAND_COVER:
        hit = F.col(class_id) == i
        name = F.when(hit, label) if name is None else name.when(hit, label)
        weight = F.when(hit, w) if weight is None else weight.when(hit, w)
    return df.withColumn("land_cover", name).withColumn("sensitivity", weight).filter(F.col("land_cover").isNotNull())


def district_land_cover(px: DataFrame, zone="zone", class_id="class_id", value="med", min_pixels: int = 10) -> DataFrame:
    stats = summarise(
        px, [zone, class_id], value, {"median_value": 0.5}, mean="mean_value", count="pixel_count"
    ).filter(F.col("pixel_count") >= min_pixels)
    return name_classes(stats, class_id)


def yearly_state(px: DataFrame, keys: Sequence[str], value="med", lit_from=LIT_FROM, dark_below=DARK_BELOW) -> DataFrame:
    """Lit and dark share and mean per group; NULL pixels count nowhere."""
    n = F.count(value)
    v = F.col(value)
    return px.groupBy(*keys).agg(
        (F.count_if(v >= lit_from) / n * 100.0).alias("lit_pct"),
        (F.count_if(v < dark_below) / n * 100.0).alias("dark_pct"),
        F.avg(value).alias("mean_value"),
    )


def baseline_difference(px: DataFrame, baseline: int, cell=("r", "c"), value="med", year="yr") -> DataFrame:
    """Each pixel against the same pixel of the baseline year."""
    base = px.filter(F.col(year) == baseline).select(*cell, F.col(value).alias("baseline_value"))
    return px.join(base, list(cell)).withColumn("diff", F.col(value) - F.col("baseline_value"))


def change_from_baseline(px: DataFrame, baseline: int, value="med", year="yr", cell=("r", "c")) -> DataFrame:
    """Mean pixel change and change of the mean per year against the baseline year."""
    per_year = px.groupBy(year).agg(F.avg(value).alias("mean_value"))
    base = per_year.filter(F.col(year) == baseline).select(F.col("mean_value").alias("base_mean"), F.lit(1).alias("_k"))
    diffs = baseline_difference(px, baseline, cell, value, year).groupBy(year).agg(F.avg("diff").alias("mean_change"))
    out = per_year.withColumn("_k", F.lit(1)).join(base, "_k", "left").drop("_k").join(diffs, year, "left")
    delta = F.col("mean_value") - F.col("base_mean")
    return out.withColumn(
        "pct_change", F.when((F.col("base_mean") > 0) & (F.col(year) != baseline), delta / F.col("base_mean") * 100.0)
    )


def pixel_slopes(px: DataFrame, cell=("r", "c"), value="med", year="yr", n_years: int | None = None) -> DataFrame:
    """Least-squares slope per pixel; with ``n_years`` only pixels present in every year."""
    out = px.groupBy(*cell).agg(
        F.regr_slope(F.col(value), F.col(year).cast("double")).alias("slope"), F.count(value).alias("n_years")
    )
    return out.filter(F.col("n_years") == n_years) if n_years else out
