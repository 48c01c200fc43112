"""Light-dome fits: radiance over distance as peak * exp(-k d) + background."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over, total
from ..session import saved

# Limits of the fit and the background that ends a dome.
K_MAX = 10.0
BACKGROUND = 0.5
MIN_RINGS = 3
STEPS = 200
NEGLIGIBLE = 1e-4  # of the innermost ring's share, at the second ring


def _fit_for(df: DataFrame, keys: list[str], ks: Column, rings: str) -> DataFrame:
    """Best non-negative (peak, background) for each tried decay rate.

    The sums run over the rings in the order of their distance. So rates that fit
    equally well, as all do where the peak is zero, have equal errors whatever the
    order of the rows, and the smallest rate is taken.
    """
    r, k = F.col(rings), F.explode(ks).alias("_k")
    tried = df.select(*keys, F.transform(r, lambda x: x["_d"]).alias("_ds"), F.transform(r, lambda x: x["_v"]).alias("_vs"), k)
    tried = tried.withColumn("_es", F.transform("_ds", lambda d: F.exp(-F.col("_k") * d)))

    def products(a: str, b: str) -> Column:
        return total(F.zip_with(a, b, lambda x, y: x * y))

    s = tried.select(
        *keys, "_k", F.size("_es").alias("_n"), total(F.col("_es")).alias("_se"), products("_es", "_es").alias("_see"),
        total(F.col("_vs")).alias("_sy"), products("_vs", "_vs").alias("_syy"), products("_es", "_vs").alias("_sey"),
    )
    n, se, see, sy, sey = (F.col(c) for c in ("_n", "_se", "_see", "_sy", "_sey"))
    det = n * see - se * se
    peak = F.when(det > 1e-12 * n * see, (n * sey - se * sy) / det).otherwise(F.lit(0.0))
    base = (sy - peak * se) / n

    def option(p: Column, b: Column) -> Column:
        sse = F.col("_syy") - 2.0 * (p * sey + b * sy) + p * p * see + 2.0 * p * b * se + b * b * n
        return F.struct(sse.alias("sse"), F.col("_k").alias("_k"), p.alias("_peak"), b.alias("_base"))

    only_peak = option(F.greatest(over(sey, see), F.lit(0.0)), F.lit(0.0))
    only_base = option(F.lit(0.0), F.greatest(sy / n, F.lit(0.0)))
    free = F.when((peak >= 0) & (base >= 0), option(peak, base))
    return s.groupBy(*keys).agg(F.min(F.least(free, only_peak, only_base)).alias("_fit"))


def light_domes(profile: DataFrame, key: str | Sequence[str], distance: str, value: str, threshold: float = BACKGROUND) -> DataFrame:
    """Peak, decay, dome radius, half distance, r2 and area per location.

    For a given decay rate the model is linear, so a grid of rates with a
    second, finer grid around the best replaces an iterative solver. Needs
    three rings with values; otherwise every measure is NULL.

    Where the best decay is so steep that the dome has gone by the second ring,
    any steeper one fits as well: the rate, and what follows from it, is not
    determined by the data. ``rate_determined`` is false then and those measures
    are NULL; the background, the fitted value at the innermost ring and r2 are
    given for every dome.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = profile.filter(F.col(value).isNotNull() & F.col(distance).isNotNull())
    rows = rows.select(*keys, F.col(distance).cast("double").alias("_d"), F.col(value).cast("double").alias("_v"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("_v") > F.min("_v")).alias("_varies"),
        F.slice(F.array_sort(F.collect_set("_d")), 1, 2).alias("_near"),  # a location has few rings
        F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_rings"),
    ).filter(F.col("_n") >= MIN_RINGS)
    vs = F.transform("_rings", lambda x: x["_v"])
    base = base.withColumn("_mean", total(vs) / F.col("_n"))
    base = saved(base.withColumn("_ss", total(F.transform(vs, lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))))), "rings")
    # Rates from 1e-4 to the limit in equal ratios, and zero.
    ratio = math.log(K_MAX / 1e-4) / (STEPS - 1)
    coarse = F.concat(
        F.array(F.lit(0.0)),
        F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: F.lit(1e-4) * F.exp(i * ratio)),
    )
    first = _fit_for(base, keys, coarse, "_rings").select(*keys, F.col("_fit._k").alias("_k0"))
    low, high = F.col("_k0") * math.exp(-ratio), F.least(F.col("_k0") * math.exp(ratio), F.lit(K_MAX))
    high = F.when(F.col("_k0") == 0, F.lit(1e-4)).otherwise(high)
    fine = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: low + (high - low) * i / STEPS)
    best = _fit_for(base.join(first, keys), keys, fine, "_rings")
    fit = best.join(base, keys).select(
        *keys, F.col("_fit._peak").alias("_peak"), F.col("_fit._k").alias("_k"), F.col("_fit._base").alias("_base"),
        "_near", F.when(F.col("_varies"), 1.0 - F.col("_fit.sse") / F.col("_ss")).otherwise(0.0).alias("_r2"),
    )
    peak, k, b = F.col("_peak"), F.col("_k"), F.col("_base")
    ends = (peak > threshold) & (k > 0) & (b < threshold)
    radius = F.when(ends, F.greatest(-F.ln((threshold - b) / peak) / k, F.lit(0.0)))
    known = k * (F.get("_near", F.lit(1)) - F.get("_near", F.lit(0))) < -math.log(NEGLIGIBLE)
    measures = {
        "peak_radiance": peak, "dome_radius_km": radius, "decay_rate": k, "half_distance_km": F.when(k > 0, math.log(2.0) / k),
        "effective_area_km2": math.pi * radius * radius,
    }
    out = fit.select(
        *keys, *[F.when(known, v).alias(n) for n, v in measures.items()], F.col("_r2").alias("model_r_squared"), b.alias("background_radiance"),
        (b + peak * F.exp(-k * F.get("_near", F.lit(0)))).alias("inner_radiance"), known.alias("rate_determined"),
    )
    return profile.select(*keys).distinct().join(out, keys, "left")
