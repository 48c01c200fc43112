"""Row numbers inside groups of any size, with Spark's own operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` (nulls first), without a gap.

    All rows are range-partitioned by group, order and a tie-breaker, so a large
    group, and even a large tie, is spread over many tasks; a group's number is
    the place in the partition plus the rows of the group in earlier partitions.
    Only the counts per partition pass a window. Rows equal in all of ``groups``
    and ``order`` may swap numbers between runs.
    """
    groups, order = list(groups), list(order)
    src = saved(df, "unnumbered").withColumn("_tie", F.monotonically_increasing_id())
    keys = [*groups, *order, "_tie"]
    ranged = src.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = saved(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part")
    shifts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_part").alias("_p"),
        (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(shifts, same).withColumn(name, F.col("_at") + F.col("_shift"))
    return out.select(*df.columns, name)
