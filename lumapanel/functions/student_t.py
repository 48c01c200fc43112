"""Two-sided Student-t p-value as a column expression (integer degrees of freedom).

Moderate statistics use the finite trigonometric series. Where ``t*t > 2*dof``
that series would lose the small tail to cancellation, so the incomplete-beta
series is used there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BETA_TERMS = 60


def _sum_terms(first: Column, count: Column, step) -> Column:
    """Sum ``count`` terms where ``step(term, i)`` gives term i from term i-1."""
    start = F.struct(first.alias("term"), first.alias("total"))

    def merge(acc, i):
        nxt = acc["term"] * step(i)
        return F.struct(nxt.alias("term"), (acc["total"] + nxt).alias("total"))

    idx = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(count > 0, F.aggregate(idx, start, merge, lambda a: a["total"])).otherwise(F.lit(0.0))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    t = t.cast("double")
    v = dof.cast("int")
    vd = v.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(vd))
    cos, sin = F.cos(theta), F.sin(theta)
    cos2 = cos * cos

    odd_sum = _sum_terms(cos, F.floor((v - 1) / 2).cast("int"), lambda i: cos2 * (2.0 * i) / (2.0 * i + 1.0))
    even_sum = _sum_terms(F.lit(1.0), F.floor(v / 2).cast("int"), lambda i: cos2 * (2.0 * i - 1.0) / (2.0 * i))
    central = F.when(v % 2 == 1, (2.0 / math.pi) * (theta + sin * odd_sum)).otherwise(sin * even_sum)
    near = 1.0 - central

    # B(dof/2, 1/2), reached from B(1/2,1/2)=pi or B(1,1/2)=2 in steps of one.
    steps = F.when(v > 2, F.sequence(F.when(v % 2 == 1, F.lit(3)).otherwise(F.lit(4)), v, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    base = F.when(v % 2 == 1, F.lit(math.pi)).otherwise(F.lit(2.0))
    beta = F.aggregate(steps, base, lambda b, k: b * (k - 2.0) / (k - 1.0))
    x = vd / (vd + t * t)
    half = vd / 2.0
    acc0 = F.struct(F.lit(1.0).alias("co"), F.lit(1.0).alias("xn"), F.lit(0.0).alias("total"))

    def add(acc, n):
        part = acc["co"] * acc["xn"] * half / (half + n)
        return F.struct(
            (acc["co"] * (n + 0.5) / (n + 1.0)).alias("co"),
            (acc["xn"] * x).alias("xn"),
            (acc["total"] + part).alias("total"),
        )

    tail_sum = F.aggregate(F.sequence(F.lit(0), F.lit(BETA_TERMS - 1)), acc0, add, lambda a: a["total"])
    tail = F.pow(x, half) / (half * beta) * tail_sum
    return F.when(t.isNotNull() & (v >= 1), F.when(t * t > 2.0 * vd, tail).otherwise(F.greatest(near, F.lit(0.0))))


def slope_p(sxx: Column, syy: Column, sxy: Column, n: Column) -> Column:
    """p-value of a simple-regression slope from centred sums; a perfect fit gives 0."""
    sse = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    dof = n - 2
    t = (sxy / sxx) / F.sqrt(sse / dof / sxx)
    return F.when((dof >= 1) & (sxx > 0), F.when(sse > 0, t_two_sided_p(t, dof)).when(syy > 0, F.lit(0.0)))


def corr_p(r: Column, n: Column) -> Column:
    """p-value of a correlation coefficient with n-2 degrees of freedom."""
    dof = n - 2
    t = r * F.sqrt(dof / F.greatest(1.0 - r * r, F.lit(1e-300)))
    return F.when(dof >= 1, F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(t_two_sided_p(t, dof)))
