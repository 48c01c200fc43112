"""Tiers, rankings, classes and comparisons on entity-year panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_rows, literal_structs, over
from ..functions.names import url_slug
from ..functions.scalars import alan_class, first_present, log_display, projected_10yr
from .ranking import attach_positions, average_rank, cume_share, row_numbers, summarise, top_k
from .trends import baseline_change

# Tiers, published growth rates and flag limits.
TIER_EDGES = (0, 20, 40, 60, 80, 100)
TIERS = ("Pristine", "Low", "Medium", "High", "Very High")
BENCHMARKS = [
    ("global_lit_area", "Kyba et al. (2017)", "Global (all countries)", "2012-2016", 2.2, 1.8, 2.6, "lit_area"),
    ("global_total_radiance", "Kyba et al. (2017)", "Global (all countries)", "2012-2016", 1.8, None, None, "total_radiance"),
    ("global_ground_based", "Kyba et al. (2023)", "Global (citizen science)", "2011-2022", 9.6, 8.3, 10.9, "sky_brightness_ground"),
    ("developing_asia", "Kyba et al. (2017)", "Developing Asia", "2012-2016", 4.1, 3.5, 4.7, "lit_area"),
    ("india_national", "Li et al. (2020)", "India (national)", "2012-2018", 5.3, 4.8, 5.8, "radiance"),
]
SIMILAR_WITHIN = 1.0
LOW_R2, EXTREME_PCT = 0.3, 20.0


def tier_of(pct: Column) -> Column:
    """Tier of a percentile in [0, 100]; upper edges belong to the lower tier."""
    out = F.when(pct <= TIER_EDGES[1], TIERS[0])
    for edge, name in zip(TIER_EDGES[2:], TIERS[1:]):
        out = out.when(pct <= edge, name)
    return out


def percentile_tiers(panel: DataFrame, entity: str, year: str, value: str, min_entities: int = 5) -> DataFrame:
    """Average-rank percentile and tier of every entity in its year.

    Years with fewer than ``min_entities`` values are left out.
    """
    sizes = panel.groupBy(year).agg(F.count(value).alias("_known")).filter(F.col("_known") >= min_entities)
    rows = panel.select(entity, year, value).join(sizes.drop("_known"), year, "left_semi")
    pct = average_rank() / F.col("n_group") * 100.0
    out = attach_positions(rows, [year], value)
    return out.select(
        entity, year, value, F.round(pct, 1).alias("percentile_rank"), tier_of(pct).alias("alan_tier")
    )


def tier_boundaries(panel: DataFrame, year: str, value: str, min_entities: int = 5) -> DataFrame:
    """Value at both percentile edges of each tier, per year."""
    cuts = {f"_q{e}": e / 100.0 for e in TIER_EDGES}
    q = summarise(panel, [year], value, cuts, count="_n").filter(F.col("_n") >= min_entities)
    recs = [
        F.struct(
            F.lit(name).alias("tier"),
            F.lit(lo).alias("percentile_low"),
            F.lit(hi).alias("percentile_high"),
            F.round(f"_q{lo}", 2).alias("radiance_low"),
            F.round(f"_q{hi}", 2).alias("radiance_high"),
        )
        for name, lo, hi in zip(TIERS, TIER_EDGES, TIER_EDGES[1:])
    ]
    return q.select(year, F.inline(F.array(*recs)))


def share_tier(df: DataFrame, keys: Sequence[str], value: str, name: str = "percentile_tier") -> DataFrame:
    """Tier by the share of values not larger than this one."""
    out = attach_positions(df, keys, value).withColumn(name, tier_of(cume_share() * 100.0))
    return out.drop("n_at", "n_below", "n_group")


def tier_distribution(tiers: DataFrame, year: str, tier: str = "alan_tier") -> DataFrame:
    """Entities per tier and year, one column per tier."""
    return tiers.groupBy(year).pivot(tier, list(TIERS)).agg(F.count(F.lit(1))).na.fill(0)


def tier_transitions(tiers: DataFrame, entity: str, year: str, first: int, last: int, tier="alan_tier") -> DataFrame:
    """Entities that moved from each tier to each other one; all pairs are present."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(tier)))
    moved = tiers.filter(F.col(year).isin(first, last)).groupBy(entity).agg(at(first).alias("tier_start"), at(last).alias("tier_end"))
    counts = moved.dropna().groupBy("tier_start", "tier_end").agg(F.count(F.lit(1)).alias("n"))
    one = tiers.sparkSession.range(1).select()
    grid = literal_rows(literal_rows(one, "tier_start", TIERS), "tier_end", TIERS)
    return grid.join(counts, ["tier_start", "tier_end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def entity_properties(panel: DataFrame, trends: DataFrame, entity: str, year: str, value: str, name: str | None = None):
    """Latest and baseline values, growth, class, tier, 10-year projection and three ranks.

    Entities need a value in both the first and the last year of the panel.
    """
    span = panel.agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    # The span is one row, attached through a constant key.
    ends = panel.withColumn("_k", F.lit(1)).join(span.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ends = ends.filter((F.col(year) == F.col("_first")) | (F.col(year) == F.col("_last")))
    ends = ends.groupBy(entity).agg(
        F.max("_first").alias("baseline_year"),
        F.max("_last").alias("latest_year"),
        F.max(F.when(F.col(year) == F.col("_first"), F.col(value))).alias("_base"),
        F.max(F.when(F.col(year) == F.col("_last"), F.col(value))).alias("_latest"),
    )
    ends = share_tier(ends.filter(F.col("_latest").isNotNull()), [], "_latest")
    ends = row_numbers(ends, "_latest", entity, "rank_latest_radiance", descending=True)
    grown = row_numbers(trends, "annual_pct_change", entity, "rank_annual_growth", descending=True)
    both = grown.join(ends, entity).filter(F.col("_base").isNotNull())
    label = F.col(name or entity).cast("string")
    out = both.select(
        entity,
        url_slug(label).alias("slug"),
        "latest_year",
        F.round("_latest", 4).alias("latest_radiance"),
        "baseline_year",
        F.round("_base", 4).alias("baseline_radiance"),
        F.round(over(F.col("_latest") - F.col("_base"), "_base") * 100.0, 2).alias("pct_change_total"),
        F.round("annual_pct_change", 3).alias("annual_pct_change"),
        first_present(["ci_low", "ci_lower"], trends).alias("annual_pct_change_ci_lower"),
        first_present(["ci_high", "ci_upper"], trends).alias("annual_pct_change_ci_upper"),
        alan_class("_latest").alias("alan_class"),
        "percentile_tier",
        "rank_annual_growth",
        "rank_latest_radiance",
        F.round(projected_10yr("_latest", "annual_pct_change"), 3).alias("projected_radiance_10yr"),
    )
    return row_numbers(out, "projected_radiance_10yr", entity, "rank_conservation")


def benchmark_comparison(trends: DataFrame, growth: str = "annual_pct_change") -> DataFrame:
    """Median growth of all entities against published rates."""
    g = summarise(trends, [], growth, {"med": 0.5}, mean="avg", low="lo", high="hi")
    names = ("benchmark_name", "benchmark_source", "benchmark_region", "benchmark_period", "benchmark_growth_pct",
             "benchmark_ci_low", "benchmark_ci_high", "benchmark_metric_type")
    rows = literal_structs(g, names, BENCHMARKS)
    diff = F.col("med") - F.col("benchmark_growth_pct")
    view = F.when(F.abs(diff) < SIMILAR_WITHIN, "similar").when(diff > 0, "faster").otherwise("slower")
    return rows.select(
        *names,
        F.round("med", 2).alias("median_growth"),
        F.round("avg", 2).alias("mean_growth"),
        F.round("lo", 2).alias("range_low"),
        F.round("hi", 2).alias("range_high"),
        F.round(diff, 2).alias("difference"),
        view.alias("interpretation"),
    )


def yearly_percentiles(panel: DataFrame, year: str, value: str) -> DataFrame:
    return summarise(panel, [year], value, {f"p{p}": p / 100.0 for p in (10, 25, 50, 75, 90)})


def group_median(panel: DataFrame, keys: Sequence[str], value: str, name: str = "median_value") -> DataFrame:
    return summarise(panel, keys, value, {name: 0.5})


def class_counts(panel: DataFrame, year: str, value: str) -> DataFrame:
    return panel.groupBy(year, alan_class(value).alias("alan_class")).agg(F.count(F.lit(1)).alias("n"))


def growth_classes(trends: DataFrame, entity: str, growth: str = "annual_pct_change") -> DataFrame:
    """Quartile classes when nothing shrinks, else fixed limits; labels carry the bounds."""
    q = summarise(trends, [], growth, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, low="lo")
    g = F.col(growth)
    text = lambda fmt, *cols: F.format_string(fmt, *[F.col(c) for c in cols])
    by_quartile = (
        F.when(g < F.col("q25"), text("Low (<%.1f%%)", "q25"))
        .when(g < F.col("q50"), text("Moderate (%.1f-%.1f%%)", "q25", "q50"))
        .when(g < F.col("q75"), text("High (%.1f-%.1f%%)", "q50", "q75"))
        .otherwise(text("Rapid (>%.1f%%)", "q75"))
    )
    fixed = (
        F.when(g < 0, "Declining (<0%)")
        .when(g < 2, "Slow (0-2%)")
        .when(g < 5, "Moderate (2-5%)")
        .otherwise("Rapid (>5%)")
    )
    # The bounds are one row, attached through a constant key.
    rows = trends.select(entity, growth).withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k", "left")
    label = F.when(g.isNull(), "No data").when(F.col("lo") >= 0, by_quartile).otherwise(fixed)
    return rows.select(entity, growth, label.alias("growth_class"))


def value_matrix(panel: DataFrame, entity: str, year: str, value: str, years: Sequence[int], log: bool = False) -> DataFrame:
    """Entities by years, ordered by the last year."""
    v = log_display(value) if log else F.col(value)
    wide = panel.groupBy(entity).pivot(year, list(years)).agg(F.avg(v))
    wide = wide.select(entity, *[F.col(str(y)).alias(f"y{y}") for y in years])
    return wide.orderBy(F.desc_nulls_last(f"y{years[-1]}"), entity)


def mean_by_entity(df: DataFrame, entity: str, value: str, spine: DataFrame, name: str) -> DataFrame:
    return spine.select(entity).distinct().join(df.groupBy(entity).agg(F.avg(value).alias(name)), entity, "left")


def anomaly_flags(trends: DataFrame, entity: str, growth="annual_pct_change", r2="r_squared") -> DataFrame:
    """Entities with a poor fit or an extreme trend, reasons joined by '; '."""
    weak = F.when(F.col(r2) < LOW_R2, F.format_string("Low R² (%.2f)", F.col(r2)))
    wild = F.when(F.abs(growth) > EXTREME_PCT, F.format_string("Extreme trend (%+.1f%%/yr)", F.col(growth)))
    return trends.select(entity, F.concat_ws("; ", weak, wild).alias("reasons")).filter(F.length("reasons") > 0)


def nearest_by_value(df: DataFrame, entity: str, value: str, k: int = 3) -> DataFrame:
    """The k other entities with the closest values, the smaller key first on ties.

    Entities are numbered in value order; the k nearest lie within k steps on
    either side of a run of equal values, so each entity meets 2k others plus
    the first k of its ties instead of everyone.
    """
    ranked = row_numbers(df.select(entity, value).filter(F.col(value).isNotNull()), value, entity, "_pos")
    spread = ranked.select(
        F.col(entity).alias("_oe"), F.col(value).alias("_ov"), F.explode(F.sequence(F.col("_pos") - k, F.col("_pos") + k)).alias("_pos")
    )
    pairs = ranked.join(spread, "_pos").filter(F.col(entity) != F.col("_oe"))
    # On each side, runs of equal values longer than k prefer their smallest keys.
    runs = ranked.groupBy(F.col(value).alias("_rv")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_len"))
    heads = runs.filter(F.col("_len") > 1).select("_rv", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.least("_len", F.lit(k + 1)).cast("int") - 1)).alias("_pos"))
    head_rows = heads.join(ranked, "_pos").select("_rv", F.col(entity).alias("_oe"), F.col(value).alias("_ov"))
    touched = pairs.select(entity, value, "_ov").distinct()
    own = ranked.select(entity, value, F.col(value).alias("_ov"))
    via_runs = touched.unionByName(own).distinct().join(head_rows.drop("_ov"), F.col("_ov") == F.col("_rv")).select(
        entity, value, "_oe", "_ov"
    )
    every = pairs.select(entity, value, "_oe", "_ov").unionByName(via_runs).filter(F.col(entity) != F.col("_oe")).distinct()
    gap = F.abs(F.col("_ov") - F.col(value))
    best = top_k(every.withColumn("_gap", gap), k, [F.col("_gap"), F.col("_oe")], [entity])
    return best.select(entity, F.col("_oe").alias("neighbor"), F.col("_ov").alias("neighbor_value"), F.col("_gap").alias("gap"))


def leaderboard(props: DataFrame, entity: str) -> DataFrame:
    """Best conserving (projection ascending) and fastest changing (growth descending), ranked."""
    best = props.withColumn("board", F.lit("best_conserving")).withColumn("rank", F.col("rank_conservation"))
    fast = row_numbers(props, "annual_pct_change", entity, "rank", descending=True).withColumn("board", F.lit("fastest_changing"))
    return best.unionByName(fast)


def null_counts(df: DataFrame, step: str) -> DataFrame:
    """NULL count of every column, one row per column, from a single pass."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return agg.unpivot([], df.columns, "column", "nulls").withColumn("step", F.lit(step))


def null_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Change of the NULL counts against an earlier step; new columns count from 0."""
    old = before.select("column", F.col("nulls").alias("previous"))
    out = now.join(old, "column", "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    return out.withColumn("delta", F.col("nulls") - F.col("previous"))


def nulls_by_entity(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    agg = df.groupBy(entity).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([entity], list(cols), "column", "nulls")


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns added and removed, and mean and NULL count of numeric columns on both sides."""
    num = ("double", "float", "integer", "long", "short", "byte", "decimal")

    def profile(df: DataFrame, tag: str) -> DataFrame:
        nums = [f.name for f in df.schema if f.dataType.typeName() in num]
        aggs = []
        for c in df.columns:
            mean = F.avg(c) if c in nums else F.lit(None).cast("double")
            aggs.append(F.struct(F.lit(c).alias("column"), mean.alias(f"mean_{tag}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{tag}")).alias(c))
        one = df.agg(*aggs)
        return one.select(F.inline(F.array(*[F.col(c) for c in df.columns])))

    both = profile(a, "a").join(profile(b, "b"), "column", "full_outer")
    status = F.when(F.col("nulls_a").isNull(), "added").when(F.col("nulls_b").isNull(), "removed").otherwise("common")
    ma, mb = F.col("mean_a"), F.col("mean_b")
    change = F.when(ma != 0, (mb - ma) / F.abs(ma) * 100.0).when(mb == 0, 0.0).when(
        ma.isNotNull() & mb.isNotNull(), F.lit(float("inf"))
    )
    return both.withColumns({"status": status, "mean_change_pct": change})
