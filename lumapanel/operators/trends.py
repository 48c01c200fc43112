"""Per-entity time-series fits on a panel with one row per (entity, year).

All fits are closed forms over aggregates, so an entity needs one shuffle and
its group is never longer than the number of years.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, no_nan, over, pct_of_slope
from ..functions.scalars import alan_class, stability_class
from ..functions.student_t import slope_p, t_two_sided_p

# Model constants and warning limits.
LOG_EPSILON = 1e-6
RESAMPLES = 1000
SEED = 42
CI_SHARES = (0.025, 0.975)
BLOCK_YEARS = 3
SERIES_AT_ONCE = 1000
VERSION_YEAR = 2014
LED_YEAR = 2015
OUTLIER_Z = 2.0
DW_LOW, DW_HIGH = 1.0, 3.0
JB_ALPHA = 0.05
COOK_LIMIT = 1.0
R2_LOW = 0.5


def log_value(value: str | Column, clip_negative: bool = True) -> Column:
    v = as_col(value)
    x = F.greatest(v, F.lit(0.0)) if clip_negative else v
    # greatest() skips NULL, so a missing value has to be kept missing here.
    return F.when(v.isNotNull() & (x + LOG_EPSILON > 0), F.ln(x + LOG_EPSILON))


def _xy(panel: DataFrame, entity: str, year: str, value: str, clip=True) -> DataFrame:
    return panel.select(entity, F.col(year).cast("double").alias("_x"), log_value(value, clip).alias("_y"))


def _sums(x: Column, y: Column, tag: str = "") -> list[Column]:
    return [
        F.regr_count(y, x).alias(f"_n{tag}"),
        F.regr_sxx(y, x).alias(f"_sxx{tag}"),
        F.regr_syy(y, x).alias(f"_syy{tag}"),
        F.regr_sxy(y, x).alias(f"_sxy{tag}"),
        F.regr_avgx(y, x).alias(f"_mx{tag}"),
        F.regr_avgy(y, x).alias(f"_my{tag}"),
    ]


def fit_trend(panel: DataFrame, entity: str, year: str, value: str, min_years: int = 2) -> DataFrame:
    """Log-linear trend: annual percent, slope, r2, p-value and number of years.

    A constant series has no r2; fewer than ``min_years`` rows give NULLs.
    """
    fit = _xy(panel, entity, year, value).groupBy(entity).agg(*_sums(F.col("_x"), F.col("_y")), F.count(F.lit(1)).alias("_rows"))
    sxx, syy, sxy, n = (F.col(c) for c in ("_sxx", "_syy", "_sxy", "_n"))
    ok = (n >= min_years) & (sxx > 0)
    beta = F.when(ok, sxy / sxx)
    return fit.select(
        entity,
        pct_of_slope(beta).alias("annual_pct_change"),
        F.when(ok & (syy > 0), sxy * sxy / (sxx * syy)).alias("r_squared"),
        F.when(ok, slope_p(sxx, syy, sxy, n)).alias("p_value"),
        F.col("_rows").cast("int").alias("n_years"),
        beta.alias("beta"),
        F.when(ok, F.col("_my") - beta * F.col("_mx")).alias("intercept"),
    )


def trend_residuals(panel: DataFrame, entity: str, year: str, value: str, clip: bool = True) -> DataFrame:
    """Panel rows with x, y, the fitted line's residual and the group's sums."""
    w = Window.partitionBy(entity)
    rows = panel.select(entity, year, F.col(year).cast("double").alias("_x"), log_value(value, clip).alias("_y"))
    rows = rows.filter(F.col("_y").isNotNull())
    x, y = F.col("_x"), F.col("_y")
    rows = rows.withColumns(
        {
            "_n": F.count(F.lit(1)).over(w),
            "_sxx": F.regr_sxx(y, x).over(w),
            "_syy": F.regr_syy(y, x).over(w),
            "_sxy": F.regr_sxy(y, x).over(w),
            "_mx": F.avg(x).over(w),
            "_my": F.avg(y).over(w),
        }
    )
    slope = F.try_divide(F.col("_sxy"), F.col("_sxx"))
    return rows.withColumn("_e", y - F.col("_my") - slope * (x - F.col("_mx")))


def latest_values(panel: DataFrame, entity: str, year: str, values: Sequence[str], suffix: str = "_latest") -> DataFrame:
    """The newest row's values per entity."""
    return panel.groupBy(entity).agg(*[F.max_by(v, year).alias(f"{v}{suffix}") for v in values])


def trends_with_latest(panel, entity, year, value, mean_value, min_years=2) -> DataFrame:
    out = fit_trend(panel, entity, year, value, min_years).join(
        latest_values(panel, entity, year, [value, mean_value]), entity, "left"
    )
    return out.withColumn("alan_class", alan_class(f"{value}_latest"))


def site_trends(panel, entity, year, value, mean_value, quality="quality_pct", valid="valid_pixels") -> DataFrame:
    """Trend with a quality gate on the median share and number of valid pixels."""
    gate = panel.groupBy(entity).agg(
        F.median(quality).alias("median_quality_pct"), F.median(valid).alias("median_valid_pixels")
    )
    low = (F.col("median_quality_pct") < 5.0) | (F.col("median_valid_pixels") < 30)
    out = fit_trend(panel, entity, year, value, 3).join(gate, entity)
    out = out.join(latest_values(panel, entity, year, [value, mean_value]), entity, "left")
    known = F.col("annual_pct_change").isNotNull()
    return out.withColumns(
        {
            "quality_flag": F.when(low, "low_quality").otherwise("ok"),
            "median_quality_pct": F.round("median_quality_pct", 1),
            "median_valid_pixels": F.col("median_valid_pixels").cast("int"),
            f"{value}_latest": F.when(known, F.col(f"{value}_latest")),
            f"{mean_value}_latest": F.when(known, F.col(f"{mean_value}_latest")),
        }
    )


@lru_cache(maxsize=64)
def _draw_counts(n: int, resamples: int, seed: int, block: int | None) -> np.ndarray:
    """How often each of ``n`` years is drawn (columns) in each resample (rows).

    A draw is a pick from a hash of (seed, resample, draw), so every worker has
    the same matrix. With ``block`` whole runs of years are drawn and the last
    one is cut at ``n`` years; shorter series are taken as they are.
    """
    out = np.zeros((resamples, n), np.int32)
    size = n if block is None else max(n - (block - 1), 1)
    for b in range(resamples):
        for k in range(0, n, block or 1):
            text = f"{seed}:{b + 1}:{k // (block or 1)}"
            start = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % size
            if block is None:
                out[b, start] += 1
            elif n >= block:
                out[b, start : start + min(block, n - k)] += 1
    if block is not None and n < block:
        out[:] = 1
    return out


def _series(panel, entity, year, value) -> DataFrame:
    """One row per entity: year offsets and log values in year order."""
    rows = _xy(panel, entity, year, value).filter(F.col("_y").isNotNull())
    got = rows.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_x", "_y"))).alias("_s"))
    first = F.element_at("_s", 1)["_x"]
    return got.select(entity, F.transform("_s", lambda r: r["_x"] - first).alias("_xs"), F.col("_s._y").alias("_ys"))


def _intervals(x: np.ndarray, y: np.ndarray, counts: np.ndarray, shares: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the annual percent over all resamples, a row per series; and how many resamples had two years or more."""
    n = x.shape[1]
    w = counts.T.astype(float)
    sx, sy, sxx, sxy = x @ w, y @ w, (x * x) @ w, (x * y) @ w
    den = n * sxx - sx * sx
    slope = np.divide(n * sxy - sx * sy, den, out=np.full(den.shape, np.nan), where=den != 0)
    pct = np.sort((np.exp(slope) - 1.0) * 100.0, axis=1)  # NaN last
    valid = (~np.isnan(pct)).sum(axis=1)
    out = np.full((len(x), len(shares)), np.nan)
    some = np.flatnonzero(valid)
    for j, share in enumerate(shares):
        at = (valid[some] - 1) * share
        low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
        a, b = pct[some, low], pct[some, high]
        out[some, j] = a + (b - a) * (at - low)
    return out, valid


def _resampled(series: DataFrame, entity: str, names: Sequence[str], resamples: int, seed: int, least: int, block: int | None, shares: Sequence[float]) -> DataFrame:
    """(entity, low, high, resamples): series of one length share the matrix of draws, so a batch needs one product per length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch["_ys"]).to_numpy(zero_copy_only=False)
            ends, valid = np.full((len(lengths), 2), np.nan), np.zeros(len(lengths), np.int32)
            for n in np.unique(lengths[lengths >= least]) if resamples > 0 else ():
                counts, which = _draw_counts(int(n), resamples, seed, block), np.flatnonzero(lengths == n)
                for low in range(0, len(which), SERIES_AT_ONCE):
                    some = which[low : low + SERIES_AT_ONCE]
                    x, y = (batch[c].take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("_xs", "_ys"))
                    ends[some], valid[some] = _intervals(x, y, counts, shares)
            bounds = [pa.array(ends[:, j], from_pandas=True) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch[entity], *bounds, pa.array(valid)], names=[entity, *names])

    kind = series.schema[entity].dataType.simpleString()
    return series.mapInArrow(run, f"`{entity}` {kind}, {names[0]} double, {names[1]} double, {names[2]} int")


def bootstrap_ci(panel, entity, year, value, resamples=RESAMPLES, seed=SEED, min_years=2, shares=CI_SHARES) -> DataFrame:
    """Interval of the annual percent from independent resamples of the years."""
    return _resampled(_series(panel, entity, year, value), entity, ("ci_low", "ci_high", "n_resamples"), resamples, seed, min_years, None, shares)


def block_bootstrap_ci(
    panel, entity, year, value, block=BLOCK_YEARS, resamples=RESAMPLES, seed=SEED, shares=CI_SHARES
) -> DataFrame:
    """The same from runs of consecutive years, which keeps their correlation."""
    names = ("ci_low_block", "ci_high_block", "n_valid_resamples")
    return _resampled(_series(panel, entity, year, value), entity, names, resamples, seed, 4, block, shares)


def version_trend(panel, entity, year, value, boundary: int = VERSION_YEAR) -> DataFrame:
    """Trend with a step at the product version, from sums within both sides.

    NULL where all years lie on one side.
    """
    x, y = F.col("_x"), F.col("_y")
    late = x >= boundary
    a_x, a_y = F.when(~late, x), F.when(~late, y)
    b_x, b_y = F.when(late, x), F.when(late, y)
    fit = _xy(panel, entity, year, value).groupBy(entity).agg(
        *_sums(x, y), *_sums(a_x, a_y, "0"), *_sums(b_x, b_y, "1")
    )
    both = lambda s: F.coalesce(F.col(f"{s}0"), F.lit(0.0)) + F.coalesce(F.col(f"{s}1"), F.lit(0.0))
    n, n0, n1 = F.col("_n").cast("double"), F.col("_n0"), F.col("_n1")
    sxx, syy, sxy = F.col("_sxx"), F.col("_syy"), F.col("_sxy")
    wxx, wxy, wyy = both("_sxx"), both("_sxy"), both("_syy")
    ok = (F.col("_n") >= 4) & (sxx > 0)
    two = ok & (n0 > 0) & (n1 > 0) & (wxx > 0)
    slope = wxy / wxx
    gap = F.col("_mx1") - F.col("_mx0")
    effect = F.col("_my1") - F.col("_my0") - slope * gap
    rss = F.greatest(wyy - wxy * wxy / wxx, F.lit(0.0))
    dof = F.col("_n") - 3
    s2 = rss / dof
    mix = n0 * n1 / n
    var_effect = s2 / (mix - mix * mix * gap * gap / sxx)
    p = lambda est, var: F.when(dof >= 1, F.when(var > 0, t_two_sided_p(est / F.sqrt(var), dof)).otherwise(0.0))
    return fit.select(
        entity,
        F.when(ok, pct_of_slope(sxy / sxx)).alias("annual_pct_change"),
        F.when(two, pct_of_slope(slope)).alias("annual_pct_change_adjusted"),
        F.when(two, effect).alias("version_effect"),
        F.when(ok & (syy > 0), sxy * sxy / (sxx * syy)).alias("r_squared"),
        F.when(two & (syy > 0), 1.0 - rss / syy).alias("r_squared_adjusted"),
        F.when(two, p(slope, s2 / wxx)).alias("p_value_trend"),
        F.when(two, p(effect, var_effect)).alias("p_value_version"),
    )


def trend_diagnostics(panel, entity, year, value) -> DataFrame:
    """Fit quality, residual tests, influence and outlier years per entity.

    Values are not clipped here. Fewer than four years give one warning only.
    """
    res = trend_residuals(panel, entity, year, value, clip=False)
    e, n = F.col("_e"), F.col("_n")
    along = Window.partitionBy(entity).orderBy("_x")
    sse_row = F.greatest(F.col("_syy") - over(F.col("_sxy") * F.col("_sxy"), "_sxx"), F.lit(0.0))
    lever = 1.0 / n + over((F.col("_x") - F.col("_mx")) * (F.col("_x") - F.col("_mx")), "_sxx")
    spread = F.sqrt(F.avg(e * e).over(Window.partitionBy(entity)))
    res = res.withColumns(
        {
            "_step": e - F.lag("_e").over(along),
            "_cook": F.try_divide(e * e * lever, 2.0 * F.try_divide(sse_row, n - 2) * (1.0 - lever) * (1.0 - lever)),
            "_z": F.try_divide(e, spread),
        }
    )
    odd = F.filter(
        F.array_sort(F.collect_list(F.when(F.abs("_z") > OUTLIER_Z, F.col(year)))), lambda v: v.isNotNull()
    )
    agg = res.groupBy(entity).agg(
        F.max("_n").alias("_n"),
        F.max("_syy").alias("_syy"),
        F.sum(e * e).alias("_sse"),
        F.try_divide(F.sum(F.col("_step") * F.col("_step")), F.sum(e * e)).alias("_dw"),
        F.when(F.sum(e * e) > 0, F.skewness("_e")).alias("_sk"),
        F.when(F.sum(e * e) > 0, F.kurtosis("_e")).alias("_ku"),
        F.max("_cook").alias("_cook"),
        odd.alias("_odd"),
    )
    n = F.col("_n")
    r2 = F.when(F.col("_syy") > 0, 1.0 - F.col("_sse") / F.col("_syy"))
    jb = n / 6.0 * (F.col("_sk") * F.col("_sk") + F.col("_ku") * F.col("_ku") / 4.0)
    agg = agg.withColumns({"_r2": r2, "_jb_p": F.exp(-jb / 2.0)})
    say = lambda cond, text, v: F.when(cond, F.format_string(text, v))
    warn = F.concat_ws(
        "; ",
        say(~F.col("_dw").between(DW_LOW, DW_HIGH), "high autocorrelation (DW=%.2f)", F.col("_dw")),
        say(F.col("_jb_p") < JB_ALPHA, "non-normal residuals (JB p=%.3f)", F.col("_jb_p")),
        say(F.col("_cook") > COOK_LIMIT, "high-influence observation (Cook's D=%.2f)", F.col("_cook")),
        say(F.col("_r2") < R2_LOW, "poor model fit (R²=%.3f)", F.col("_r2")),
    )
    ok = n >= 4
    every = panel.select(entity).distinct()
    out = every.join(agg, entity, "left")
    return out.select(
        entity,
        F.when(ok, F.col("_r2")).alias("r_squared"),
        F.when(ok, 1.0 - (1.0 - F.col("_r2")) * (n - 1) / (n - 2)).alias("adj_r_squared"),
        F.when(ok, F.col("_dw")).alias("durbin_watson"),
        F.when(ok, F.col("_jb_p")).alias("jarque_bera_p"),
        F.when(ok, F.col("_cook")).alias("cooks_distance_max"),
        F.when(ok, F.array_join(F.col("_odd").cast("array<string>"), ",")).otherwise("").alias("outlier_years"),
        F.when(ok, warn).otherwise("insufficient data (<4 years)").alias("model_warnings"),
    )


def breakpoints(panel, entity, year, value) -> DataFrame:
    """Best single split of the trend by AIC; the split model is two separate lines."""
    rows = _xy(panel, entity, year, value).filter(F.col("_y").isNotNull())
    years = F.array_sort(F.collect_list(F.col("_x").cast("int")))
    single = rows.groupBy(entity).agg(*_sums(F.col("_x"), F.col("_y")), years.alias("_years"))
    n = F.col("_n")
    sse1 = F.greatest(F.col("_syy") - over(F.col("_sxy") * F.col("_sxy"), "_sxx"), F.lit(0.0))
    tiny = F.lit(1e-300)
    aic = lambda sse, n, k: n * F.ln(F.greatest(sse / n, tiny)) + 2.0 * k
    single = single.withColumn("_aic1", aic(sse1, n, 2)).withColumn("_beta", over("_sxy", "_sxx"))
    tried = single.filter(n >= 5).select(
        entity, F.explode(F.sequence(F.get("_years", F.lit(2)), F.get("_years", n.cast("int") - 2))).alias("_bp")
    )
    x, y, bp = F.col("_x"), F.col("_y"), F.col("_bp")
    before, after = x <= bp, x > bp
    split = (
        tried.join(rows, entity)
        .groupBy(entity, "_bp")
        .agg(
            *_sums(F.when(before, x), F.when(before, y), "0"),
            *_sums(F.when(after, x), F.when(after, y), "1"),
        )
        .filter((F.col("_n0") >= 2) & (F.col("_n1") >= 2) & (F.col("_sxx0") > 0) & (F.col("_sxx1") > 0))
    )
    part = lambda t: F.greatest(F.col(f"_syy{t}") - F.col(f"_sxy{t}") * F.col(f"_sxy{t}") / F.col(f"_sxx{t}"), F.lit(0.0))
    m = F.col("_n0") + F.col("_n1")
    split = split.withColumn("_sse2", part("0") + part("1")).withColumn("_aic2", aic(F.col("_sse2"), m, 4))
    b0, b1 = F.col("_sxy0") / F.col("_sxx0"), F.col("_sxy1") / F.col("_sxx1")
    var = F.col("_sse2") / (m - 4) * (1.0 / F.col("_sxx0") + 1.0 / F.col("_sxx1"))
    p = F.when(m > 4, F.when(var > 0, t_two_sided_p((b1 - b0) / F.sqrt(var), m - 4)).otherwise(0.0))
    best = split.groupBy(entity).agg(
        F.min(F.struct(F.col("_aic2").alias("aic"), bp.alias("bp"), b0.alias("b0"), b1.alias("b1"), p.alias("p"))).alias("_best")
    )
    out = single.join(best, entity, "left")
    better = F.col("_best.aic") < F.col("_aic1")
    enough = n >= 5
    g0 = F.when(better, pct_of_slope("_best.b0")).otherwise(pct_of_slope("_beta"))
    g1 = F.when(better, pct_of_slope("_best.b1")).otherwise(pct_of_slope("_beta"))
    kind = (
        F.when((g0 >= 0) & (g1 < 0), "reversal_to_decline")
        .when((g0 < 0) & (g1 >= 0), "reversal_to_growth")
        .when(F.abs(g1) > F.abs(g0), "acceleration")
        .otherwise("deceleration")
    )
    return out.select(
        entity,
        F.when(better, F.col("_best.bp")).alias("breakpoint_year"),
        F.when(enough, g0).alias("growth_rate_before"),
        F.when(enough, g1).alias("growth_rate_after"),
        F.when(better, kind).alias("change_type"),
        F.when(better, F.col("_best.p")).alias("p_value"),
        F.when(better, F.col("_aic1") - F.col("_best.aic")).when(enough, 0.0).alias("aic_improvement"),
    )


def stability(panel, entity, year, value, led_year: int = LED_YEAR) -> DataFrame:
    """Variation measures per entity; skewness and kurtosis are bias-corrected."""
    along = Window.partitionBy(entity).orderBy(year)
    known = panel.filter(F.col(value).isNotNull()).select(entity, year, F.col(value).cast("double").alias("_v"))
    known = known.withColumn("_jump", F.abs(F.col("_v") - F.lag("_v").over(along)))
    agg = known.groupBy(entity).agg(
        F.count("_v").alias("_n"),
        F.avg("_v").alias("_mean"),
        F.stddev_samp("_v").alias("_sd"),
        F.var_pop("_v").alias("_vp"),
        F.skewness("_v").alias("_g1"),
        F.kurtosis("_v").alias("_g2"),
        (F.percentile("_v", 0.75) - F.percentile("_v", 0.25)).alias("_iqr"),
        F.max("_jump").alias("_jump"),
        F.avg(F.when(F.col(year) < led_year, F.col("_v"))).alias("_pre"),
        F.avg(F.when(F.col(year) >= led_year, F.col("_v"))).alias("_post"),
    )
    n = F.col("_n").cast("double")
    ok, varied = F.col("_n") >= 2, F.col("_vp") > 0
    cv = F.when(F.col("_mean") > 0, F.col("_sd") / F.col("_mean"))
    skew = F.when((n >= 3) & varied, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & varied, ((n + 1) * F.col("_g2") + 6.0) * (n - 1) / ((n - 2) * (n - 3)))
    only = lambda c: F.when(ok, c)
    return panel.select(entity).distinct().join(agg, entity, "left").select(
        entity,
        only(F.col("_mean")).alias("mean_value"),
        only(F.col("_sd")).alias("std_value"),
        only(cv).alias("coefficient_of_variation"),
        only(skew).alias("skewness"),
        only(kurt).alias("kurtosis"),
        only(F.col("_iqr")).alias("iqr"),
        only(F.col("_jump")).alias("max_year_to_year_change"),
        only(stability_class(cv)).alias("stability_class"),
        only(F.coalesce(F.col("_post") < F.col("_pre"), F.lit(False))).alias("possible_led_transition"),
    )


def year_on_year(panel, entity, year, value) -> DataFrame:
    """Change to the entity's previous row and the gap to it in years."""
    along = Window.partitionBy(entity).orderBy(year)
    return panel.select(
        entity,
        year,
        (F.col(value) - F.lag(value).over(along)).alias("change"),
        (F.col(year) - F.lag(year).over(along)).alias("gap"),
    )


def baseline_change(panel, entity, year, value) -> DataFrame:
    """First and latest values of each entity and the total percent change."""
    v = no_nan(F.col(value).cast("double"))
    ends = panel.groupBy(entity).agg(
        F.min(year).alias("baseline_year"),
        F.max(year).alias("latest_year"),
        F.min_by(v, F.col(year)).alias("baseline_value"),
        F.max_by(v, F.col(year)).alias("latest_value"),
    )
    return ends.withColumn(
        "pct_change_total", over(F.col("latest_value") - F.col("baseline_value"), "baseline_value") * 100.0
    )
