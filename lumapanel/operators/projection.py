"""Linear projection of census metrics between and beyond their anchor years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECTION_YEARS = tuple(range(2012, 2025))


def _anchors(year: str, metric: str) -> Column:
    """Known (year, value) pairs of one entity in year order; one row per census at most."""
    pair = F.when(
        F.col(metric).isNotNull(), F.struct(F.col(year).cast("double").alias("y"), F.col(metric).cast("double").alias("v"))
    )
    return F.array_sort(F.collect_list(pair))


def _line(anchors: Column, target: Column, single: str, floor_zero: bool) -> Column:
    n = F.size(anchors)
    below = F.size(F.filter(anchors, lambda p: p["y"] < target))
    i = F.greatest(F.least(below - 1, n - 2), F.lit(0))
    p, q = F.get(anchors, i), F.get(anchors, i + 1)
    slope = F.try_divide(q["v"] - p["v"], q["y"] - p["y"])
    value = F.coalesce(p["v"] + slope * (target - p["y"]), p["v"])
    if floor_zero:
        value = F.greatest(value, F.lit(0.0))
    alone = F.get(anchors, F.lit(0))["v"] if single == "hold" else F.lit(None).cast("double")
    return F.when(n >= 2, value).when(n == 1, alone)


def project(
    df: DataFrame,
    keys: Sequence[str],
    year: str,
    metrics: Sequence[str],
    targets: Sequence[int] = PROJECTION_YEARS,
    min_anchors: int = 2,
    single: str = "hold",
    floor_zero: bool = False,
) -> DataFrame:
    """Metrics of every entity for the target years from the two nearest anchors.

    Entities with fewer than ``min_anchors`` census rows are dropped. A metric
    with one anchor is held constant or NULL (``single``).
    """
    got = df.groupBy(*keys).agg(F.count_distinct(year).alias("_n"), *[_anchors(year, m).alias(m) for m in metrics])
    got = got.filter(F.col("_n") >= min_anchors)
    out = got.withColumn("year", F.explode(F.array(*[F.lit(int(t)) for t in targets])))
    at = F.col("year").cast("double")
    return out.select(*keys, "year", *[_line(F.col(m), at, single, floor_zero).alias(m) for m in metrics])
