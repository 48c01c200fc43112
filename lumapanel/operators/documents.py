"""Nested JSON documents from entity tables.

Each document is one row of JSON text per entity, feature or ranked row. A
collection or a leaderboard is a list of pieces (header, rows in order, footer)
for ``sinks.write_document``, so none of it is ever one value; a leaderboard is
also to be had in pages of the size that the caller wants.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_coords


def feature_rows(zones: DataFrame, props: DataFrame, zone: str, coords: str = "coordinates", depth: int = 3, digits: int = 5) -> DataFrame:
    """GeoJSON feature text per zone with properties; zones without properties are skipped.

    Coordinates nested ``depth`` 3 deep are polygons, 4 deep multi-polygons.
    """
    cols = [c for c in props.columns if c != zone]
    joined = zones.select(zone, round_coords(coords, depth, digits).alias("_c")).join(props, zone)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon" if depth == 3 else "MultiPolygon").alias("type"), F.col("_c").alias("coordinates")).alias("geometry"),
        F.struct(F.col(zone), *cols).alias("properties"),
    )
    return joined.select(zone, F.to_json(feature).alias("feature"))


def feature_collection(features: DataFrame, zone: str) -> list[str | DataFrame]:
    """The pieces of a GeoJSON feature collection, features in the order of their zones."""
    return ['{"type":"FeatureCollection","features":[', features.select(F.col(zone).alias("rank"), F.col("feature").alias("value")), "]}"]


# What the two rankings go by.
RANKING_BASIS = {
    "best_conserving": {"metric": "projected_radiance_10yr", "formula": "latest_radiance * (1 + annual_pct_change/100)^10", "order": "ascending"},
    "fastest_changing": {"metric": "annual_pct_change", "order": "descending"},
}
BOARD_FIELDS = ("slug", "latest_radiance", "annual_pct_change", "annual_pct_change_ci_lower", "annual_pct_change_ci_upper", "alan_class",
                "percentile_tier", "projected_radiance_10yr")


def leaderboard_document(board: DataFrame, entity: str, panel: DataFrame, year: str, cols: Sequence[str] = BOARD_FIELDS) -> list[str | DataFrame]:
    """The pieces of the leaderboard document: what the ranks go by, the years of the data, the number of entities, both rankings."""
    years = panel.agg(F.array(F.min(year), F.max(year)).alias("data_years")).withColumn("_k", F.lit(1))
    size = board.filter(F.col("board") == "best_conserving").agg(F.count(F.lit(1)).alias("total_districts")).withColumn("_k", F.lit(1))
    facts = years.join(size, "_k").select(
        F.lit(0).alias("rank"), F.to_json(F.struct(F.current_timestamp().alias("generated_at"), "data_years", "total_districts")).alias("_json")
    )
    # The object's closing bracket goes: the rankings follow inside it.
    facts = facts.select("rank", F.expr("substr(_json, 1, length(_json) - 1)").alias("value"))
    row = F.to_json(F.struct("rank", F.col(entity).alias("district"), *cols), {"ignoreNullFields": "false"})
    pieces: list[str | DataFrame] = [facts, f',"ranking_basis":{json.dumps(RANKING_BASIS)}']
    for name in RANKING_BASIS:
        pieces += [f',"{name}":[', board.filter(F.col("board") == name).select("rank", row.alias("value")), "]"]
    return [*pieces, "}"]


def leaderboard_pages(board: DataFrame, cols: Sequence[str], page: int) -> DataFrame:
    """JSON texts (board, page, document) holding the rows in rank order, ``page`` rows each.

    A board of up to ``page`` entities is one document; there is no default, so no
    board is split unasked.
    """
    item = F.struct("rank", *cols)
    paged = board.withColumn("page", F.floor((F.col("rank") - 1) / page).cast("int"))
    rows = paged.groupBy("board", "page").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return rows.select("board", "page", F.to_json(F.struct("board", "page", "rows")).alias("document"))


def entity_documents(
    panel: DataFrame, props: DataFrame, neighbors: DataFrame, entity: str, year: str, series: Sequence[str], digits: int = 4
) -> DataFrame:
    """One JSON text per entity: yearly series, properties, neighbours and ranks."""
    point = F.struct(F.col(year).alias("year"), *[F.round(c, digits).alias(c) if c != "pixel_count" else F.col(c) for c in series])
    rows = panel.groupBy(entity).agg(F.array_sort(F.collect_list(point)).alias("annual_series"))
    near = neighbors.groupBy(entity).agg(
        F.array_sort(F.collect_list(F.struct(F.col("gap"), F.col("neighbor"), F.round("neighbor_value", 3).alias("annual_pct_change")))).alias("_n")
    )
    near = near.select(entity, F.transform("_n", lambda n: F.struct(n["neighbor"].alias("entity"), n["annual_pct_change"].alias("annual_pct_change"))).alias("neighbors"))
    total = props.agg(F.count(F.lit(1)).alias("total_entities")).withColumn("_k", F.lit(1))
    out = props.join(rows, entity).join(near, entity, "left").withColumn("_k", F.lit(1)).join(total, "_k")
    doc = F.struct(
        F.col(entity).alias("entity"),
        "slug",
        "annual_series",
        F.struct("annual_pct_change", "baseline_year", "latest_year", "baseline_radiance", "latest_radiance", "pct_change_total").alias("trend"),
        F.struct("alan_class", "percentile_tier").alias("classification"),
        "neighbors",
        "projected_radiance_10yr",
        F.struct(
            F.col("rank_conservation").alias("conservation"),
            F.col("rank_annual_growth").alias("annual_growth"),
            F.col("rank_latest_radiance").alias("latest_radiance"),
            "total_entities",
        ).alias("rankings"),
    )
    return out.select(entity, "slug", F.to_json(doc).alias("document"))


def run_metadata(panel: DataFrame, entity: str, year: str) -> DataFrame:
    """One row with the year range and the number of entities, as JSON text."""
    one = panel.agg(F.min(year).alias("a"), F.max(year).alias("b"), F.count_distinct(entity).alias("total_entities"))
    return one.select("total_entities", F.to_json(F.struct(F.array("a", "b").alias("year_range"), "total_entities")).alias("document"))
