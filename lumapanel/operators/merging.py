"""Joins of the entity-year panel and the trend table with further datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unmapped_districts


def merge_yearly(panel: DataFrame, datasets: Sequence[tuple[DataFrame, str, str]], entity: str, year: str = "year") -> DataFrame:
    """Left-join datasets given as (table, temporal type, entity type).

    Snapshots repeat for every year, time series match on the year, town-level
    tables are skipped because they have many rows per district.
    """
    out = panel
    for ds, temporal, level in datasets:
        if ds is None or level == "town":
            continue
        on = [entity, year] if temporal == "timeseries" and year in ds.columns else [entity]
        out = out.join(ds, on, "left")
    return out


def merge_trends(trends: DataFrame, datasets: Sequence[tuple[DataFrame, str, str]], entity: str, year: str = "year") -> DataFrame:
    """Left-join one row per entity of each dataset; of a time series the first year counts."""
    out = trends
    for ds, _, level in datasets:
        if ds is None or level == "town":
            continue
        if year in ds.columns:
            # One row per entity and year at most, so the window stays short.
            w = Window.partitionBy(entity).orderBy(year)
            ds = ds.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", year)
        out = out.join(ds, entity, "left")
    return out


def fan_out(before: DataFrame, after: DataFrame, label: str, factor: float = 2.0) -> DataFrame:
    """One check row: did a join multiply the rows by more than ``factor``?"""
    a = before.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("_k", F.lit(1))
    b = after.agg(F.count(F.lit(1)).alias("rows_after")).withColumn("_k", F.lit(1))
    out = a.join(b, "_k").drop("_k")
    return out.select(
        F.lit(label).alias("dataset"), "rows_before", "rows_after", (F.col("rows_after") > F.col("rows_before") * factor).alias("expanded")
    )


def roll_up(
    wards: DataFrame, district: str, town: str, town_name: str, metrics: Sequence[str], rural: DataFrame,
    unmapped: Sequence[str] | None = None,
) -> DataFrame:
    """Ward and rural rows to TOWN, DISTRICT-Urban, DISTRICT-Rural and DISTRICT-Total rows.

    Districts without a modern match (``unmapped``, by default those of the alias
    table) are dropped.

    ``rural`` has the district and the metrics. One grouping-sets aggregation
    makes all levels.
    """
    cols = [district, town, town_name, "tru", *metrics]
    blank = F.lit(None).cast("string")
    urban = wards.withColumn("tru", F.lit("Urban"))
    country = rural.select(district, blank.alias(town), blank.alias(town_name), F.lit("Rural").alias("tru"), *metrics)
    rows = urban.select(*cols).unionByName(country.select(*cols))
    lost = list(unmapped_districts() if unmapped is None else unmapped)
    rows = rows.filter(F.col(district).isNull() | ~F.col(district).isin(lost))
    sets = [[F.col(district), F.col("tru"), F.col(town)], [F.col(district), F.col("tru")], [F.col(district)]]
    agg = rows.groupingSets(sets, F.col(district), F.col("tru"), F.col(town)).agg(
        *[F.sum(m).alias(m) for m in metrics],
        F.min(town_name).alias("_name"),
        F.grouping(town).alias("_gt"),
        F.grouping("tru").alias("_gr"),
    )
    is_town = F.col("_gt") == 0
    agg = agg.filter(~is_town | (F.col("tru") == "Urban"))
    return agg.select(
        district,
        F.when(is_town, "TOWN").otherwise("DISTRICT").alias("level"),
        F.when(F.col("_gr") == 1, "Total").otherwise(F.col("tru")).alias("tru"),
        F.when(is_town, F.col("_name")).otherwise(F.col(district)).alias("entity_name"),
        F.when(is_town, F.col(town)).otherwise("").alias("entity_code"),
        *metrics,
    )


def level_order(df: DataFrame, code: str, name: str = "entity_name") -> DataFrame:
    """District rows before towns before villages, Total before Urban before Rural."""
    level = F.when(F.col("level") == "DISTRICT", 0).when(F.col("level") == "TOWN", 1).otherwise(2)
    tru = F.when(F.col("tru") == "Total", 0).when(F.col("tru") == "Urban", 1).otherwise(2)
    return df.orderBy(code, level, tru, name)


def sex_split_totals(df: DataFrame, sums: Mapping[str, tuple[str, str]], renames: Mapping[str, str]) -> DataFrame:
    """Person totals of male/female columns, and main workers as total less marginal."""
    from ..functions.columns import number

    made = {k: number(a) + number(b) for k, (a, b) in sums.items()}
    made |= {new: number(old) for old, new in renames.items()}
    out = df.withColumns(made)
    return out.withColumn("MAINWORK_P", F.col("TOT_WORK_P") - F.col("MARGWORK_P"))


def location_table(places: DataFrame, name: str, district: str, population: str, status: str, lat="lat", lon="lon") -> DataFrame:
    """Usable places: a name in several districts gets '(district)', a clash keeps the larger one."""
    from ..functions.names import capitalise_words

    ok = places.filter((F.coalesce(F.col(status), F.lit("")) != "failed") & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    spread = ok.groupBy(name).agg(F.count_distinct(district).alias("_d"))
    label = F.when(F.col("_d") > 1, F.concat(capitalise_words(name), F.lit(" ("), F.col(district), F.lit(")"))).otherwise(
        capitalise_words(name)
    )
    named = ok.join(spread, name).withColumn("display", label)
    pick = F.max_by(F.struct(lat, lon, district, population), F.struct(F.coalesce(F.col(population), F.lit(0)), F.col(lat), F.col(lon)))
    return named.groupBy("display").agg(pick.alias("p")).select("display", "p.*")
