"""Exact ranks and percentiles that never put a whole group into one task.

``positions`` first collapses a group to its distinct values with counts, then
cuts the values into fine buckets on a fixed logarithmic scale, counts the
buckets, and ranks only inside a bucket. The cuts depend on the value alone, so
a recomputed task makes the same cuts. Ranks, ``cume_dist``, row numbers and
interpolated percentiles all read from that one result.

Rows with a NULL key belong to no group, as in a pandas ``groupby``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .ordering import numbered

# Buckets per factor e of the value: a bucket spans a tenth of a percent, which
# holds at most some thousand distinct single-precision values.
BUCKETS_PER_E = 1024


def _bucket(df: DataFrame, value: str, per_e: int) -> Column:
    """A monotone bucket number for any orderable column."""
    kind = df.schema[value].dataType.typeName()
    v = F.col(value)
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(v, "UTF-8"), 1, 3)), 6, "0"), 16, 10).cast("long")
    if kind == "boolean":
        v = v.cast("int")
    elif kind in ("date", "timestamp"):
        v = F.unix_micros(v.cast("timestamp"))
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_e).cast("long")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    buckets_per_e: int = BUCKETS_PER_E,
    weight: str | None = None,
) -> DataFrame:
    """One row per (keys, distinct value).

    ``n_at`` rows hold the value, ``n_below`` rows of the group are smaller,
    ``n_group`` rows are in the group, ``low``/``high`` bound the group.
    With ``weight`` the input already carries row counts.
    """
    keys = list(keys)
    rows = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    grouped = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    counted = (
        src.filter(F.col(value).isNotNull())
        .dropna(subset=grouped)
        .groupBy(*grouped, value)
        .agg(rows.alias("n_at"))
        .withColumn("_bucket", _bucket(src, value, buckets_per_e))
    )
    totals = counted.groupBy(*grouped, "_bucket").agg(
        F.sum("n_at").alias("_in"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    group = Window.partitionBy(*grouped)
    starts = totals.select(
        *grouped,
        "_bucket",
        (F.sum("_in").over(group.orderBy("_bucket")) - F.col("_in")).alias("_start"),
        F.sum("_in").over(group).alias("n_group"),
        F.min("_lo").over(group).alias("low"),
        F.max("_hi").over(group).alias("high"),
    )
    inside = Window.partitionBy(*grouped, "_bucket").orderBy(value)
    ranked = counted.withColumn("_run", F.sum("n_at").over(inside) - F.col("n_at"))
    return ranked.join(starts, [*grouped, "_bucket"]).select(
        *keys,
        value,
        "n_at",
        (F.col("_start") + F.col("_run")).alias("n_below"),
        "n_group",
        "low",
        "high",
    )


def average_rank() -> Column:
    """Rank with ties averaged."""
    return F.col("n_below") + (F.col("n_at") + 1) / 2.0


def cume_share() -> Column:
    """Share of rows not larger than the value."""
    return (F.col("n_below") + F.col("n_at")) / F.col("n_group")


def attach_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every input row with the rank columns of its value (NULL values stay NULL)."""
    return df.join(positions(df, keys, value).drop("low", "high"), [*keys, value], "left")


def row_numbers(
    df: DataFrame, value: str, tie: str, name: str, keys: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Number all rows by value, equal values by ``tie``; NULL and NaN values last.

    The rows are cut at measured boundaries of (keys, value, tie), so neither a
    large group nor a large tie, nor ids, dates or names that lie close together,
    are sorted in one task.
    """
    order, late = f"_ord_{name}", f"_late_{name}"
    missing = F.col(value).isNull()
    if df.schema[value].dataType.typeName() in ("double", "float"):
        missing |= F.isnan(value)
    turned = -F.col(value).cast("double") if descending else F.col(value)
    src = df.withColumn(late, missing).withColumn(order, F.when(~missing, turned))
    out = numbered(src, list(keys), [late, order, tie], "_number")
    return out.withColumn(name, (F.col("_number") + 1).cast("int")).drop(late, order, "_number")


def _quantile(p: float, value: str) -> Column:
    """Linear interpolation between the two neighbouring ranks of share ``p``."""
    at = (F.col("n_group") - 1) * F.lit(float(p))
    lo, hi = F.floor(at), F.ceil(at)

    def holder(rank):
        return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n_at")), F.col(value)))

    frac = F.max(at - lo)
    return holder(lo) + (holder(hi) - holder(lo)) * frac


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float] | None = None,
    mean: str | None = None,
    low: str | None = None,
    high: str | None = None,
    std: str | None = None,
    count: str | None = None,
    extra: Mapping[str, Callable[[Column, Column], Column]] | None = None,
    buckets_per_e: int = BUCKETS_PER_E,
) -> DataFrame:
    """Exact statistics of ``value`` per group.

    One pass counts and sums the fine buckets of each group, combined before the
    shuffle. The counts tell which one or two buckets hold a wanted rank; a second
    pass shuffles only the rows in those, cut further into equal parts of the
    range that was measured in the bucket. The standard deviation is the
    population one. ``extra`` builds aggregates from (value, count) columns.
    """
    grouped = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    src = src.filter(F.col(value).isNotNull()).dropna(subset=grouped).withColumn("_bucket", _bucket(src, value, buckets_per_e))
    v, rows = F.col(value), F.count(F.lit(1))
    cells = src.groupBy(*grouped, "_bucket").agg(
        rows.alias("_n"), F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    cells = saved(cells, "buckets")
    total = F.sum("_n")
    whole = cells.groupBy(*grouped).agg(
        total.cast("long").alias("_total"),
        (F.sum(F.col("_mean") * F.col("_n")) / total).alias("_avg"),
        F.min("_lo").alias("_min"),
        F.max("_hi").alias("_max"),
    )
    off = F.col("_mean") - F.col("_avg")
    spread = cells.join(whole, grouped).groupBy(*grouped).agg(
        *[F.first(c).alias(c) for c in ("_total", "_avg", "_min", "_max")],
        F.sqrt(F.sum(F.col("_n") * (F.col("_var") + off * off)) / F.first("_total")).alias("_std"),
    )
    names = {"_total": count, "_avg": mean, "_min": low, "_max": high, "_std": std}
    out = spread.select(*grouped, *[F.col(c).alias(n) for c, n in names.items() if n])
    if extra:
        more = src.groupBy(*grouped).agg(*[make(v, F.lit(1)).alias(n) for n, make in extra.items()])
        out = out.join(more, grouped)
    if quantiles:
        out = out.join(_quantiles(src, cells, grouped, value, quantiles), grouped)
    return out.select(*keys, *[c for c in out.columns if c not in grouped])


SUB_BUCKETS = 256


def _quantiles(src: DataFrame, cells: DataFrame, grouped: list[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Interpolated percentiles per group, from the rows of the buckets that hold a wanted rank."""
    line, group = Window.partitionBy(*grouped).orderBy("_bucket"), Window.partitionBy(*grouped)
    placed = cells.withColumn("_start", F.sum("_n").over(line) - F.col("_n")).withColumn("n_group", F.sum("_n").over(group))
    wanted = F.lit(False)
    for p in quantiles.values():
        at = (F.col("n_group") - 1) * F.lit(float(p))
        for rank in (F.floor(at), F.ceil(at)):
            wanted |= (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n"))
    held = saved(placed.filter(wanted).select(*grouped, "_bucket", "_start", "n_group", "_lo", "_hi"), "ranks")
    rows = src.select(*grouped, "_bucket", value).join(held, [*grouped, "_bucket"])
    v, lo, hi = (F.col(c).cast("double") for c in (value, "_lo", "_hi"))
    part = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * SUB_BUCKETS), F.lit(SUB_BUCKETS - 1))).otherwise(F.lit(0))
    cell = [*grouped, "_bucket", "_sub"]
    counted = rows.withColumn("_sub", part.cast("int")).groupBy(*cell, value).agg(
        F.count(F.lit(1)).alias("n_at"), F.first("_start").alias("_start"), F.first("n_group").alias("n_group")
    )
    subs = counted.groupBy(*cell).agg(F.sum("n_at").alias("_in"))
    before = Window.partitionBy(*grouped, "_bucket").orderBy("_sub")
    starts = subs.select(*cell, (F.sum("_in").over(before) - F.col("_in")).alias("_skip"))
    inside = Window.partitionBy(*cell).orderBy(value)
    ranked = counted.withColumn("_run", F.sum("n_at").over(inside) - F.col("n_at")).join(starts, cell)
    ranked = ranked.withColumn("n_below", F.col("_start") + F.col("_skip") + F.col("_run"))
    return ranked.groupBy(*grouped).agg(*[_quantile(p, value).alias(name) for name, p in quantiles.items()])


def top_k(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """First k rows overall, or per group.

    Spark keeps k rows per input partition before it shuffles in both forms,
    so a group of any size reaches its task as a short list.
    """
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in ``order``; rows equal in it are told apart by their other columns.

    Columns that can't be ordered, such as maps, may be there but tell no rows apart.
    """
    ties = [f.name for f in df.schema if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    return top_k(df, 1, [*order, *[F.col(c) for c in ties]], keys)
