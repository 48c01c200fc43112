"""Small column builders shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: str | Column) -> Column:
    """NaN becomes NULL; Spark aggregates skip NULL but not NaN."""
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`no_nan` to every floating column of a source."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: no_nan(n) for n in floats})


def over(num: str | Column, den: str | Column) -> Column:
    """Division in doubles with a zero denominator giving NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def number(x: str | Column) -> Column:
    """Text to DOUBLE, NULL where it is no number."""
    return no_nan(as_col(x).try_cast("double"))


def pct_of_slope(beta: str | Column) -> Column:
    """Annual percent change of a log-linear slope."""
    return (F.exp(as_col(beta)) - 1.0) * 100.0


def literal_rows(df: DataFrame, alias: str, values: Sequence) -> DataFrame:
    """Pair every row with each of a few literal values (no join)."""
    return df.withColumn(alias, F.explode(F.array(*[F.lit(v) for v in values])))


def literal_structs(df: DataFrame, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """Pair every row with each literal record of a short fixed list."""
    recs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    out = df.withColumn("_rec", F.explode(recs))
    return out.withColumns({n: F.col(f"_rec.{n}") for n in names}).drop("_rec")


def spine(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def total(values: Column) -> Column:
    """Sum of an array of doubles from left to right, with what rounding loses added at the end (Neumaier); 0 if empty."""

    def add(state: Column, x: Column) -> Column:
        s, lost = state["s"], state["lost"]
        t = s + x
        return F.struct(t.alias("s"), (lost + F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)).alias("lost"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lost"))
    return F.aggregate(values, zero, add, lambda state: state["s"] + state["lost"])
