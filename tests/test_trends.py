import math
from itertools import permutations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumapanel.functions import scalars as S
from lumapanel.functions.student_t import t_two_sided_p
from lumapanel.operators import correlation as C
from lumapanel.operators import panel as N
from lumapanel.operators import trends as T
from lumapanel.operators.domes import light_domes

YEARS = range(2012, 2025)


def panel(spark, series):
    rows = [(e, int(y), None if v is None else float(v)) for e, pts in series.items() for y, v in pts]
    return spark.createDataFrame(rows, "e string, y int, v double")


def one(df, key="e"):
    return {r[key]: r for r in df.collect()}


def test_published_classes_and_magnitudes(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0.5, 0.99, 1.0, 1.01, 4.99, 5.0, 50.0)], "x double")
    assert [r[0] for r in df.select(S.alan_class("x")).collect()] == ["low"] * 3 + ["medium"] * 3 + ["high"] * 2
    want = {0: 22.0, 0.1: 21.89, 0.5: 21.55, 1: 21.23, 2: 20.78, 5: 20.02, 10: 19.36, 50: 17.7}
    df = spark.createDataFrame([(float(x),) for x in want], "x double")
    assert [round(r[0], 2) for r in df.select(S.sky_magnitude("x")).collect()] == list(want.values())
    null = spark.createDataFrame([(None,)], "x double")
    assert null.select(S.alan_class("x"), S.alan_class("x", None), *S.bortle("x"), S.stability_class("x")).first() == (
        "unknown", None, None, "", "unknown",
    )


def test_t_p_values(spark):
    # Reference values of the two-sided Student t tail.
    cases = [(1.0, 1, 0.5), (2.0, 2, 0.1835034190722739), (12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05),
             (2.570581835636314, 5, 0.05), (0.0, 7, 1.0)]
    df = spark.createDataFrame([(t, v) for t, v, _ in cases], "t double, v int")
    got = [r[0] for r in df.select(t_two_sided_p(F.col("t"), F.col("v"))).collect()]
    assert got == pytest.approx([p for *_, p in cases], rel=1e-9)


def test_trend_against_matrix_fit(spark):
    rng = np.random.default_rng(5)
    series = {"noisy": [(y, 2 + rng.random()) for y in YEARS], "grow": [(y, 2.0 * math.exp(0.08 * (y - 2012))) for y in YEARS]}
    got = one(T.fit_trend(panel(spark, series), "e", "y", "v"))
    for name, pts in series.items():
        x, y = np.array([p[0] for p in pts], float), np.log(np.array([p[1] for p in pts]) + 1e-6)
        slope, icpt = np.polyfit(x - 2018, y, 1)
        resid = y - slope * (x - 2018) - icpt
        assert got[name].annual_pct_change == pytest.approx((math.exp(slope) - 1) * 100, rel=1e-7)
        assert got[name].r_squared == pytest.approx(1 - (resid**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
        assert got[name].n_years == 13
    assert got["grow"].annual_pct_change == pytest.approx(8.3287, abs=1e-3)
    assert got["grow"].p_value < 1e-20


def test_few_and_constant_years(spark):
    series = {"one": [(2012, 1)], "two": [(2012, 1), (2013, 2)], "flat": [(y, 3) for y in YEARS], "gap": [(2012, 1), (2013, None), (2014, 3)]}
    p = panel(spark, series)
    fit = one(T.fit_trend(p, "e", "y", "v"))
    assert fit["one"].annual_pct_change is None and fit["one"].n_years == 1
    assert fit["two"].annual_pct_change == pytest.approx(100, abs=1e-3) and fit["two"].p_value is None
    assert fit["flat"].annual_pct_change == pytest.approx(0) and fit["flat"].r_squared is None
    # A missing value is no zero: two known years from 1 to 3 over two years.
    assert fit["gap"].annual_pct_change == pytest.approx((math.sqrt(3) - 1) * 100, abs=1e-3)
    brk = one(T.breakpoints(p, "e", "y", "v"))
    assert brk["one"].growth_rate_before is None and brk["flat"].breakpoint_year is None
    dia = one(T.trend_diagnostics(p, "e", "y", "v"))
    assert dia["two"].model_warnings == "insufficient data (<4 years)" and dia["two"].r_squared is None
    stab = one(T.stability(p, "e", "y", "v"))
    assert stab["one"].mean_value is None and stab["one"].stability_class is None
    assert stab["flat"].coefficient_of_variation == 0 and stab["flat"].skewness is None
    boot = one(T.bootstrap_ci(p, "e", "y", "v", resamples=50))
    assert boot["one"].ci_low is None and boot["flat"].ci_low == pytest.approx(0)
    assert one(T.block_bootstrap_ci(p, "e", "y", "v", resamples=50))["two"].n_valid_resamples == 0


def test_breakpoint_is_found(spark):
    bent = [(y, math.exp(0.02 * (y - 2012) if y <= 2018 else 0.12 - 0.1 * (y - 2018))) for y in YEARS]
    got = one(T.breakpoints(panel(spark, {"bent": bent}), "e", "y", "v"))["bent"]
    assert got.breakpoint_year in (2017, 2018) and got.change_type == "reversal_to_decline"
    assert got.growth_rate_before == pytest.approx(2.02, abs=0.01) and got.growth_rate_after == pytest.approx(-9.516, abs=0.01)


def test_version_step_is_absorbed(spark):
    pts = [(y, math.exp(0.05 * (y - 2012) + (0.3 if y >= 2014 else 0.0))) for y in YEARS]
    got = one(T.version_trend(panel(spark, {"a": pts, "late": pts[2:]}), "e", "y", "v"))
    assert got["a"].annual_pct_change_adjusted == pytest.approx((math.exp(0.05) - 1) * 100, abs=1e-3)
    assert got["a"].version_effect == pytest.approx(0.3, abs=1e-4)
    assert got["late"].annual_pct_change_adjusted is None and got["late"].annual_pct_change is not None


def test_bootstrap_covers_the_estimate(spark):
    rng = np.random.default_rng(2)
    pts = [(y, math.exp(0.05 * (y - 2012) + rng.normal(0, 0.1))) for y in YEARS]
    p = panel(spark, {"a": pts})
    fit, ci = one(T.fit_trend(p, "e", "y", "v"))["a"], one(T.bootstrap_ci(p, "e", "y", "v", resamples=300))["a"]
    other = one(T.bootstrap_ci(p, "e", "y", "v", resamples=300, seed=7))["a"]
    assert ci.ci_low < fit.annual_pct_change < ci.ci_high
    assert max(ci.ci_low, other.ci_low) < min(ci.ci_high, other.ci_high)


def test_correlation_edges(spark):
    rows = [("perfect", float(i), 2.0 * i) for i in range(5)] + [("constant", float(i), 1.0) for i in range(5)]
    rows += [("short", 1.0, 2.0), ("short", 2.0, 1.0), ("three", 1.0, 1.0), ("three", 2.0, 3.0), ("three", 3.0, 2.0), ("three", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = one(C.pearson(df, ["k"], "x", "y"), "k")
    assert got["perfect"].r == pytest.approx(1) and got["perfect"].p_value == pytest.approx(0, abs=1e-6)
    assert got["constant"].r is None and got["short"].r is None
    assert got["three"].n == 3 and (got["three"].ci_low, got["three"].ci_high) == (-1.0, 1.0)
    rho = one(C.spearman(df, ["k"], "x", "y"), "k")
    assert rho["three"].rho == pytest.approx(0.5) and rho["three"].n == 3


def test_light_dome_recovers_its_parameters(spark):
    rings = [1.0, 5.0, 10.0, 20.0, 50.0]
    rows = [("c", d, 20.0 * math.exp(-0.15 * d) + 0.2) for d in rings] + [("few", 1.0, 2.0), ("few", 5.0, None)]
    got = one(light_domes(spark.createDataFrame(rows, "e string, d double, v double"), "e", "d", "v"))
    assert got["c"].decay_rate == pytest.approx(0.15, rel=1e-3) and got["c"].peak_radiance == pytest.approx(20, rel=1e-3)
    assert got["c"].half_distance_km == pytest.approx(math.log(2) / 0.15, rel=1e-3) and got["c"].model_r_squared > 0.9999
    assert got["few"].decay_rate is None


def test_light_dome_does_not_depend_on_the_order_of_rows(spark):
    # No dome: a constant fits best, at every rate alike, and its value lies where rounding to two digits turns.
    rings = [(20.0, 5.0), (40.0, 10.266666666666666), (60.0, 12.575), (80.0, 14.041666666666666), (120.0, 13.041666666666666)]
    rows = [(i, d, v) for i, order in enumerate(permutations(rings)) for d, v in order]
    got = light_domes(spark.createDataFrame(rows, "e int, d double, v double").coalesce(1), "e", "d", "v").drop("e").distinct().collect()
    assert len(got) == 1
    assert (got[0].decay_rate, got[0].peak_radiance, got[0].background_radiance, got[0].rate_determined) == (0.0, 0.0, 10.985, True)


def test_nearest_by_value_with_many_ties(spark):
    rng = np.random.default_rng(4)
    vals = rng.choice([1.0, 1.0, 1.0, 2.0, 2.5, 3.0, 7.0], 60)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "e int, v double")
    got = {}
    for r in N.nearest_by_value(df, "e", "v").collect():
        got.setdefault(r.e, set()).add(r.neighbor)
    for i, v in enumerate(vals):
        want = sorted((abs(w - v), j) for j, w in enumerate(vals) if j != i)[:3]
        assert got[i] == {j for _, j in want}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1000), min_size=3, max_size=13))
def test_fit_is_total_and_bounded(spark, values):
    r = one(T.fit_trend(panel(spark, {"a": list(zip(range(2000, 2000 + len(values)), values))}), "e", "y", "v"))["a"]
    assert r.annual_pct_change is not None and not math.isnan(r.annual_pct_change)
    assert r.r_squared is None or -1e-9 <= r.r_squared <= 1 + 1e-9
    assert r.p_value is None or 0 <= r.p_value <= 1 + 1e-12


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1e4), min_size=2, max_size=20))
def test_magnitude_falls_with_light(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "x double")
    mags = [r[0] for r in df.select(S.sky_magnitude("x")).collect()]
    assert all(a >= b for a, b in zip(mags, mags[1:]))


def test_no_resamples_give_no_interval(spark):
    df = panel(spark, {"a": [(y, 2.0 + y % 3) for y in YEARS]})
    for make in (T.bootstrap_ci, T.block_bootstrap_ci):
        r = make(df, "e", "y", "v", resamples=0).first()
        assert tuple(r)[1:] == (None, None, 0)
