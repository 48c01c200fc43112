"""Mixing sources to target weights by entropy balancing, in Spark's own operators.

Document ``i`` of source ``s`` gets the rate ``cap / (1 + (cap - 1) exp(-l_s z_i))``
with ``z_i`` its size over the source's mean size: the rates nearest to 1 in
relative entropy, bounded by ``cap``, whose words reach the source's target. The
multipliers ``l_s`` solve the convex dual by Newton steps. Rates depend on
(source, size) alone, so the documents are counted once by it and each step runs
over those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import saved

WEIGHTS = (5, 2, 1)
SCALE = 1 << 30  # rates are rounded to this before they are summed, so sums don't depend on the order


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(counts: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Word target per source: (source, source_size, target).

    ``counts`` has (source, size, n). Sources in code-point order, null last,
    weigh ``weights`` in turn and share ``share`` of all words; no target is
    above ``cap`` times its source, and the excess is shared again by weight
    until none is. That is a level L with target = min(cap size, weight L): it
    lies where the sources, sorted by cap size / weight, stop being full.
    One row per source passes the windows.
    """
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    line = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", turn).withColumn("_full", F.col("source_size") * float(cap))
    fill = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * float(share)
    # The level if this source and all later ones are not full.
    level = (total - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    per = per.withColumn("_level", level).withColumn("_open", F.col("_full") > F.col("_level") * F.col("_w"))
    per = per.withColumn("_place", F.row_number().over(fill))
    chosen = F.min_by("_level", F.when(F.col("_open"), F.col("_place"))).over(every)
    target = F.when(chosen.isNull(), F.col("_full")).otherwise(F.least("_full", F.col("_w") * chosen))
    return per.select("source", "source_size", target.alias("target"))


def _rate(theta: Column, cap: float) -> Column:
    return F.lit(cap) / (1.0 + (cap - 1.0) * F.exp(-theta))


def balance(counts: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """(source, size, n, rate) for every (source, size).

    Newton steps on the dual, for all sources at once, kept inside a bracket
    that each step narrows. A target of 0 gives rate 0, one of ``cap`` times the
    source (or more) gives rate ``cap``. ``tolerance`` is relative to the target.
    """
    totals = counts.groupBy("source").agg(F.sum("n").alias("_docs"))
    state = targets.join(totals, targets["source"].eqNullSafe(totals["source"])).select(
        targets["source"].alias("_s"),
        "target",
        (F.col("source_size") / F.col("_docs")).alias("_mean"),
        F.when(F.col("source_size") == 0, "none")
        .when(F.col("target") >= F.col("source_size") * cap * (1 - 1e-12), "full")
        .when(F.col("target") <= 0, "zero")
        .otherwise("open")
        .alias("_kind"),
        F.lit(0.0).alias("_l"),
        F.lit(None).cast("double").alias("_low"),
        F.lit(None).cast("double").alias("_high"),
        F.lit(False).alias("_done"),
    )
    state = saved(state, "dual")
    for _ in range(rounds):
        z = F.col("size") / F.col("_mean")
        r = _rate(F.col("_l") * z, cap)
        words = F.col("size") * F.col("n")
        sums = (
            counts.join(state.filter("_kind = 'open' and not _done"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy(F.col("_s").alias("_s2"))
            .agg(F.sum(words * r).alias("_got"), F.sum(words * z * r * (1 - r / cap)).alias("_slope"))
        )
        gap = F.col("_got") - F.col("target")
        high = F.when(gap > 0, F.col("_l")).otherwise(F.col("_high"))
        low = F.when(gap > 0, F.col("_low")).otherwise(F.col("_l"))
        newton = F.col("_l") - gap / F.greatest(F.col("_slope"), F.lit(1e-300))
        # Out of the bracket: halve it, or go further out where one side is open.
        further = F.when(high.isNull(), F.greatest(F.abs(low) * 2, F.lit(1.0))).when(low.isNull(), -F.greatest(F.abs(high) * 2, F.lit(1.0)))
        inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        reach = F.greatest(F.abs(F.col("_l")) * 4, F.lit(2.0))
        step = F.when(inside & (F.abs(newton - F.col("_l")) <= reach), newton).otherwise(
            F.coalesce(further, (low + high) / 2)
        )
        met = F.abs(gap) <= F.col("target") * tolerance
        state = state.join(sums, F.col("_s").eqNullSafe(F.col("_s2")), "left").select(
            "_s",
            "target",
            "_mean",
            "_kind",
            F.when(gap.isNull() | met, F.col("_l")).otherwise(step).alias("_l"),
            F.when(gap.isNull(), F.col("_low")).otherwise(low).alias("_low"),
            F.when(gap.isNull(), F.col("_high")).otherwise(high).alias("_high"),
            (F.col("_done") | F.coalesce(met, F.lit(False))).alias("_done"),
        )
        state = saved(state, "dual")
        if state.filter("_kind = 'open' and not _done").isEmpty():
            break
    kind = F.col("_kind")
    rate = F.when(kind == "full", F.lit(float(cap))).when(kind == "zero", F.lit(0.0)).when(kind == "none", F.lit(1.0))
    rate = rate.otherwise(_rate(F.col("_l") * F.col("size") / F.col("_mean"), cap))
    return counts.join(state, F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", rate.alias("rate"))


def _repairs(groups: DataFrame, cap: int) -> DataFrame:
    """Per source at most one document per size class to add or to drop, to meet the target more closely.

    ``groups`` has (source, size, n, _low, _more, _gap): each of the group's n
    documents has _low copies, the first _more of them one more; _gap words are
    wanted. Gives (source, size, _delta): one document of that size gets one
    copy more or less.
    """
    can_add = (F.col("_more") > 0) & (F.col("_low") + 1 < cap) | (F.col("_more") < F.col("n")) & (F.col("_low") < cap)
    can_drop = (F.col("_more") > 0) | (F.col("_low") > 0)
    able = F.when(F.col("_gap") > 0, can_add).otherwise(can_drop)
    octave = F.floor(F.log2(F.col("size").cast("double")) * 4)
    picks = (
        groups.filter((F.col("size") > 0) & able & (F.col("size") <= F.abs("_gap")))
        .groupBy("source", octave.alias("_o"))
        .agg(F.max("size").alias("size"), F.min("size").alias("_small"), F.max("_gap").alias("_gap"))
    )
    # A few hundred sizes per source at most: four per doubling, two of each.
    lists = picks.groupBy("source").agg(
        F.sort_array(F.flatten(F.collect_list(F.array_distinct(F.array("size", "_small")))), asc=False).alias("_sizes"),
        F.max("_gap").alias("_gap"),
    )
    none = F.array().cast("array<bigint>")

    def take_below(s: Column, x: Column) -> Column:
        return F.when(x <= s["left"], F.struct((s["left"] - x).alias("left"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)

    start = F.struct(F.abs("_gap").cast("long").alias("left"), none.alias("kept"))
    done = F.aggregate("_sizes", start, take_below)
    return lists.select("source", F.explode(done["kept"]).alias("size"), F.signum("_gap").cast("int").alias("_delta"))


def mix_sources(df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Copies of each row so that sources meet their word targets.

    ``df`` has (source, size, ...), with other columns to break ties: rows of a
    source are rounded from the longest to the shortest and, at equal size, by
    the other columns in turn. Adds ``source_size``, ``target``, ``rate`` and
    ``copies`` (0 to ``cap``). Sums of rates are carried from row to row, so a
    source's words differ from its target by less than a few documents; then
    one document each of some sizes is taken once more or less to close most of
    that gap. Null sources are one source, the last; rows of size 0 cost no
    words and keep their rounded rate; an empty table gives none. Runs over the
    same rows give the same copies.
    """
    rows = saved(df, "mix")
    counts = saved(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = saved(source_targets(counts, weights, share, float(cap)), "targets")
    rates = balance(counts, targets, float(cap)).withColumn("_r", F.round(F.col("rate") * SCALE).cast("long"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    # Distinct sizes of one source, at most as many as the longest text has words.
    groups = rates.withColumn("_before", F.sum(F.col("_r") * F.col("n")).over(down) - F.col("_r") * F.col("n"))
    low = F.shiftright("_r", 30)
    more = F.shiftright(F.col("_before") + F.col("_r") * F.col("n"), 30) - F.shiftright("_before", 30) - low * F.col("n")
    groups = groups.select("source", "size", "n", "rate", low.alias("_low"), more.alias("_more"))
    got = groups.groupBy("source").agg(F.sum(F.col("size") * (F.col("n") * F.col("_low") + F.col("_more"))).alias("_got"))
    facts = targets.join(got, targets["source"].eqNullSafe(got["source"])).select(
        targets["source"].alias("_s"), "source_size", "target", F.round(F.col("target") - F.col("_got")).cast("long").alias("_gap")
    )
    groups = saved(groups.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "rounded")
    fixes = _repairs(groups, cap).select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_delta")
    groups = groups.join(fixes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    groups = groups.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "source_size", "target", "rate", "_low",
        (F.col("_more") + F.coalesce("_delta", F.lit(0))).alias("_more"),
    )
    placed = numbered(rows, ["source", "size"], [c for c in rows.columns if c not in ("source", "size")], "_k")
    # _more may leave 0..n by one document, which then moves to the next whole number of copies.
    extra = F.floor((F.col("_more") - F.col("_k") - 1) / F.col("n")) + 1
    return placed.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(
        *rows.columns, "source_size", "target", "rate", (F.col("_low") + extra).cast("int").alias("copies")
    )
