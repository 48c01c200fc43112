"""Files, checks, set operations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks as Q
from ..operators import documents as D
from ..operators import panel as N
from ..operators.ranking import first_by_key
from ..session import scratch_path
from ..sources import layers as Y
from ..sources import places as Z
from ..sources import sinks as K
from .registry import BOX, query, years_of
from .trend_queries import PROP_VIEWS, _scaled, _trend, props_of

SCHEMA_CHECKS = [
    Q.Rule("entity", False), Q.Rule("yr", False, 1996, 2050), Q.Rule("median_value", False, 0.0, 250000.0),
    Q.Rule("pixel_count", False, above=0), Q.Rule("kind", False, allowed=("even",)),
]


@query(
    "s02_layer_identification",
    "",
    """SELECT CAST(year(o_orderdate) AS INT) AS yr, unnest(['median', 'average', 'cf_cvg', 'lit_mask']) AS layer,
     unnest(['d/x_vcmcfg.median_masked.tif', 'd/x.average_masked.tif', 'd/x.cf_cvg.tif', 'd/lit_mask_x.tif']) AS path FROM (SELECT DISTINCT date_trunc('year', o_orderdate) AS o_orderdate FROM orders)""",
)
def _(t):
    names = ["d/x_vcmslcfg.median_masked.tif", "d/x_vcmcfg.median_masked.tif", "d/a_vcmslcfg.median_masked.tif", "d/x.average_masked.tif",
             "d/b.avg_rade9h.tif", "d/x.cf_cvg.tif", "d/lit_mask_x.tif", "d/readme.txt"]
    years = t.orders.select(F.year("o_orderdate").alias("yr")).distinct()
    return Y.identify_layers(years.withColumn("path", F.explode(F.array(*[F.lit(n) for n in names]))))


@query(
    "s08_place_directory_scan",
    "",
    "SELECT p_name AS name, p_brand AS district, CAST(p_retailprice AS DOUBLE) AS lat, CAST(p_size AS DOUBLE) AS lon FROM part WHERE p_partkey % 3 <> 0",
)
def _(t):
    path = scratch_path(t.spark, "places")
    t.part.select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("district"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("lat"), F.col("p_size").alias("lon")
    ).repartition(5).write.option("header", True).csv(path)
    return Z.read_places(t.spark, path).select("name", "district", "lat", "lon")


def _geojson(t):
    """The zones as boundary files: one feature collection per nation."""
    path = scratch_path(t.spark, "boundaries")
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    even = F.col("zone") % 2 == 0
    props = F.struct(
        F.concat(F.lit(" zone "), F.col("zone").cast("string")).alias("dtname"), F.when(F.col("zone") % 3 == 0, "Alpha").otherwise("beta").alias("stname"),
        F.col("zone").alias("dtcode11"), (F.col("zone") + 500).alias("Dist_LGD"),
    )
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")))
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":'), F.when(even, poly).otherwise(multi), F.lit("}]}")
    )
    t.zones.select("zone", text.alias("value")).write.partitionBy("zone").text(path)
    return path


@query(
    "s09_boundary_scan",
    "zones",
    "SELECT 'Zone ' || zone AS zone, CASE WHEN zone % 3 = 0 THEN 'Alpha' ELSE 'beta' END AS state, CAST(zone AS VARCHAR) AS district_code, CAST(zone + 500 AS VARCHAR) AS district_lgd, 0 AS part, 0 AS ring, CAST(5 AS INT) AS n, round(x0, 6) AS west, round(y1, 6) AS north FROM zones",
)
def _(t):
    b = Z.read_boundaries(t.spark, _geojson(t))
    return b.select(
        "zone", "state", "district_code", "district_lgd", "part", "ring", F.size("vertices").alias("n"), F.round(F.array_min("vertices.x"), 6).alias("west"), F.round(F.array_max("vertices.y"), 6).alias("north")
    )


@query(
    "s10_region_extraction",
    "zones",
    "SELECT 'Alpha' AS state_name, count(*) AS n FROM zones WHERE zone % 3 = 0 UNION ALL SELECT 'missing: gamma', 0",
)
def _(t):
    states = ["ALPHA", "gamma"]
    region = Z.extract_region(Z.read_features(t.spark, _geojson(t)), states)
    lost = Z.missing_states(region, states).select(F.concat(F.lit("missing: "), "state").alias("state_name"), F.lit(0).cast("long").alias("n"))
    return region.groupBy("state_name").agg(F.count(F.lit(1)).alias("n")).unionByName(lost)


@query("s12_place_files", "", "SELECT replace(lower(p_type), ' ', '_') AS district_key, p_name AS name, count(*) AS n, count(*) AS pending FROM part GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "placefiles")
    K.write_places(t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("district")), "district", path, rows_per_file=100)
    back = t.spark.read.option("header", True).csv(path)
    return back.groupBy("district_key", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("geocode_status") == "pending").alias("pending"))


@query("s13_panel_sink", "panel", "SELECT entity, yr, pixel_count, round(median_value, 4) AS median_value FROM panel")
def _(t):
    path = scratch_path(t.spark, "panel-csv")
    p = t.panel.select("entity", "yr", "pixel_count", F.round("median_value", 4).alias("median_value"))
    K.write_table(p, path, "csv")
    return t.spark.read.option("header", True).schema(p.schema).csv(path)


@query(
    "p23_first_candidate_inside",
    "sites",
    """WITH c AS (SELECT site_id, 0 AS o, lat + 3 AS lat, lon FROM sites UNION ALL SELECT site_id, 1, lat, lon + 4 FROM sites UNION ALL SELECT site_id, 2, lat, lon - 1 FROM sites),
    g AS (SELECT site_id, min(o) AS o, round(arg_min(lat, o), 6) AS lat, round(arg_min(lon, o), 6) AS lon FROM c WHERE lat BETWEEN 16.5 AND 21 AND lon BETWEEN 73.5 AND 79 GROUP BY 1)
    SELECT s.site_id, g.lat, g.lon, CASE WHEN o IS NULL THEN 'failed' WHEN o = 0 THEN 'ok' ELSE 'fallback' END AS geocode_status FROM sites s LEFT JOIN g ON s.site_id = g.site_id""",
)
def _(t):
    tries = F.array(
        F.struct(F.lit(0).alias("o"), (F.col("lat") + 3).alias("a"), F.col("lon").alias("b")),
        F.struct(F.lit(1).alias("o"), F.col("lat").alias("a"), (F.col("lon") + 4).alias("b")),
        F.struct(F.lit(2).alias("o"), F.col("lat").alias("a"), (F.col("lon") - 1).alias("b")),
    )
    cand = t.sites.select("site_id", F.inline(tries)).select("site_id", "o", F.col("a").alias("lat"), F.col("b").alias("lon"))
    return Z.first_inside(t.sites, cand, "site_id", "o", BOX)


@query("p24_rounded_coordinates", "zones", "SELECT zone, printf('%.2f %.2f', round(x0 + 0.004, 2), round(y1 + 0.004, 2)) AS corner FROM zones")
def _(t):
    ring = F.array(F.array(F.col("x0") + 0.004, F.col("y0")), F.array(F.col("x1"), F.col("y1") + 0.004))
    r = S.round_coords(F.array(ring), 3, 2)
    return t.zones.select("zone", r.alias("r")).select("zone", F.format_string("%.2f %.2f", F.col("r")[0][0][0], F.col("r")[0][1][1]).alias("corner"))


@query("u01_union_by_name", "", "SELECT o_orderkey AS k, o_orderstatus AS status, NULL AS flag FROM orders UNION ALL SELECT l_orderkey, NULL, l_returnflag FROM lineitem")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("flag"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "u02_first_by_key",
    "",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_totalprice, o_orderkey, o_orderpriority) = 1""",
)
def _(t):
    """Per customer and status the latest order, with its other columns."""
    o = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return first_by_key(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.col("o_totalprice")]).drop("o_orderdate")


@query("u02_distinct_by_key", "", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").dropDuplicates(["l_returnflag", "l_linestatus"])


@query(
    "u03_intersect_except",
    "",
    """SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL
    SELECT 'only_customer', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""",
)
def _(t):
    o, c = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    both = o.intersect(c.filter("k % 2 = 0")).select(F.lit("both").alias("side"), "k")
    return both.unionByName(c.join(o, "k", "left_anti").distinct().select(F.lit("only_customer").alias("side"), "k"))


@query(
    "q01_expectations",
    "panel",
    """SELECT 'yr' AS "column", 'in_range(1996, 2050)' AS "check", CAST(yr AS VARCHAR) AS value FROM panel WHERE yr < 1996
    UNION ALL SELECT 'median_value', 'in_range(0.0, 250000.0)', printf('%.4f', median_value) FROM panel WHERE median_value > 250000 AND entity <> 3
    UNION ALL SELECT 'median_value', 'not_null', NULL FROM panel WHERE entity = 3
    UNION ALL SELECT 'kind', 'isin(even)', 'odd' FROM panel WHERE entity % 2 = 1 UNION ALL SELECT 'missing', 'column is missing', NULL""",
)
def _(t):
    p = t.panel.withColumns({
        "median_value": F.when(F.col("entity") != 3, F.col("median_value")), "kind": F.when(F.col("entity") % 2 == 0, "even").otherwise("odd"),
    })
    # entity 3 keeps no value, so the range check applies to the others only
    out = Q.check_schema(p, [*SCHEMA_CHECKS, Q.Rule("missing")], "panel")
    text = F.when(F.col("column") == "median_value", F.format_string("%.4f", F.col("value").try_cast("double"))).otherwise(F.col("value"))
    return out.select("column", "check", F.when(F.col("value").isNotNull(), text).alias("value"))


@query(
    "q03_partition_completeness",
    "pixels",
    """SELECT CAST(y AS INT) AS yr, l AS layer FROM (SELECT unnest(range(min(yr) - 2, max(yr) + 3)) AS y FROM pixels), (SELECT unnest(['median', 'average', 'cf_cvg', 'lit_mask']) AS l)
    WHERE NOT (y IN (SELECT yr FROM pixels) AND (l IN ('median', 'lit_mask') OR (l = 'cf_cvg' AND y % 2 = 0)))""",
)
def _(t):
    present = t.pixels.select("yr").distinct().withColumn(
        "layer", F.explode(F.when(F.col("yr") % 2 == 0, F.array(F.lit("median"), F.lit("lit_mask"), F.lit("cf_cvg"))).otherwise(F.array(F.lit("median"), F.lit("lit_mask"))))
    )
    years = years_of(t.pixels)
    return Y.missing_layers(present, list(range(years[0] - 2, years[-1] + 3)))


@query("q04_duplicate_names", "", "SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.duplicate_keys(t.part, ["p_brand", "p_name"])


@query("q04_values_not_allowed", "", "SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL') GROUP BY 1")
def _(t):
    return Q.not_allowed(t.part, "p_type", ["ECONOMY", "SMALL"])


@query(
    "q05_stale_outputs",
    "",
    """SELECT n_name AS output, CASE n_nationkey % 5 WHEN 0 THEN 'output missing' WHEN 1 THEN 'not registered' WHEN 2 THEN 'new input' ELSE 'changed input' END AS reason FROM nation WHERE n_nationkey % 5 <> 4""",
)
def _(t):
    """One file per nation; the manifest is altered to make each kind of staleness."""
    path = scratch_path(t.spark, "inputs")
    t.nation.select("n_name", F.concat_ws(",", "n_nationkey", "n_regionkey").alias("value")).write.partitionBy("n_name").text(path)
    state = Q.file_states(t.spark, path).withColumn("output", F.regexp_extract("path", "n_name=([^/]+)", 1))
    state = state.join(t.nation.select(F.col("n_name").alias("output"), (F.col("n_nationkey") % 5).alias("m")), "output")
    before = state.filter("m <> 1").select(
        "output", F.when(F.col("m") == 2, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("m") == 3, "0").otherwise(F.col("hash")).alias("hash"), (F.col("mtime") - F.expr("INTERVAL 1 DAY")).alias("mtime"),
    )
    return Q.stale_outputs(before, state, state.select("output", (F.col("m") != 0).alias("present")))


def _joined(t, pieces):
    """A document written in parts, as one file."""
    path = scratch_path(t.spark, "document")
    K.write_document(t.spark, pieces, path)
    return K.join_document(t.spark, path, f"{path}-whole.json")


@query(
    "n01_feature_collection",
    PROP_VIEWS + " zones",
    """SELECT zone, 'Polygon' AS kind, CAST(5 AS INT) AS points, round(x0, 5) AS west, round(x1, 5) AS east, round(y0, 5) AS south, round(y1, 5) AS north, slug, latest_year, latest_radiance, baseline_year,
      baseline_radiance, pct_change_total, annual_pct_change, alan_class, percentile_tier, rank_annual_growth, rank_latest_radiance, rank_conservation
    FROM zones JOIN props ON zone = entity WHERE zone % 2 = 0""",
)
def _(t):
    """The features of a written collection as a GeoJSON reader finds them."""
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"), pt("x0", "y0"))
    zones = t.zones.select("zone", F.array(ring).alias("coordinates"))
    props = props_of(t).filter("entity % 2 = 0").withColumnRenamed("entity", "zone")
    found = Z.read_features(t.spark, _joined(t, D.feature_collection(D.feature_rows(zones, props, "zone"), "zone")))
    kinds = {f.name: f.dataType for f in props.schema}
    names = ["zone", "slug", "latest_year", "latest_radiance", "baseline_year", "baseline_radiance", "pct_change_total", "annual_pct_change", "alan_class",
             "percentile_tier", "rank_annual_growth", "rank_latest_radiance", "rank_conservation"]
    ends = F.from_json("text", "array<array<array<double>>>")[0]
    xs, ys = F.transform(ends, lambda p: p[0]), F.transform(ends, lambda p: p[1])
    box = {"west": F.array_min(xs), "east": F.array_max(xs), "south": F.array_min(ys), "north": F.array_max(ys)}
    return found.select(
        *[F.col("properties")[n].cast(kinds[n]).alias(n) for n in names], "kind", F.size(ends).alias("points"), *[v.alias(k) for k, v in box.items()]
    )


@query(
    "n02_leaderboard_document",
    PROP_VIEWS,
    """WITH p AS (SELECT *, annual_pct_change - 1 AS lo, annual_pct_change + 1 AS hi FROM props),
    b AS (SELECT 'best_conserving' AS board, 'projected_radiance_10yr' AS metric, 'ascending' AS direction, rank_conservation AS rank, * FROM p
      UNION ALL SELECT 'fastest_changing', 'annual_pct_change', 'descending', CAST(row_number() OVER (ORDER BY annual_pct_change DESC, entity) AS INT), * FROM p)
    SELECT board, metric, direction, 1995 AS first_year, 2001 AS last_year, (SELECT count(*) FROM props) AS total_districts, rank, entity AS district, slug, latest_radiance, annual_pct_change,
      round(lo, 3) AS ci_lower, round(hi, 3) AS ci_upper, alan_class, percentile_tier, projected_radiance_10yr FROM b""",
)
def _(t):
    """Every row of the written leaderboard with the document's header."""
    around = {"annual_pct_change_ci_lower": F.round(F.col("annual_pct_change") - 1, 3), "annual_pct_change_ci_upper": F.round(F.col("annual_pct_change") + 1, 3)}
    pieces = D.leaderboard_document(N.leaderboard(props_of(t).withColumns(around), "entity"), "entity", t.panel, "yr")
    row = """array<struct<rank:int,district:bigint,slug:string,latest_radiance:double,annual_pct_change:double,annual_pct_change_ci_lower:double,
      annual_pct_change_ci_upper:double,alan_class:string,percentile_tier:string,projected_radiance_10yr:double>>"""
    basis = "struct<metric:string,order:string>"
    schema = f"""data_years array<int>, total_districts bigint, best_conserving {row}, fastest_changing {row},
      ranking_basis struct<best_conserving:{basis},fastest_changing:{basis}>"""
    doc = t.spark.read.option("multiLine", True).schema(schema).json(_joined(t, pieces))
    rows = None
    for board in D.RANKING_BASIS:
        part = doc.select(
            F.lit(board).alias("board"), F.col(f"ranking_basis.{board}.metric").alias("metric"), F.col(f"ranking_basis.{board}.order").alias("direction"),
            F.col("data_years")[0].alias("first_year"), F.col("data_years")[1].alias("last_year"), "total_districts", F.inline(board),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumnsRenamed({"annual_pct_change_ci_lower": "ci_lower", "annual_pct_change_ci_upper": "ci_upper"})


@query(
    "n03_entity_documents",
    PROP_VIEWS,
    """SELECT p.entity, p.slug, (SELECT string_agg(CAST(s.yr AS VARCHAR), ',' ORDER BY s.yr) FROM scaled s WHERE s.entity = p.entity) AS years, p.alan_class, p.rank_annual_growth AS growth_rank, CAST(3 AS INT) AS n_neighbors FROM props p""",
)
def _(t):
    p = _scaled(t).withColumnRenamed("v", "mean_radiance")
    near = N.nearest_by_value(_trend(t), "entity", "annual_pct_change")
    out = D.entity_documents(p, props_of(t), near, "entity", "yr", ["mean_radiance", "w", "pixel_count"])
    schema = "annual_series array<struct<year:int>>, classification struct<alan_class:string>, neighbors array<struct<entity:bigint>>, rankings struct<annual_growth:int>"
    d = out.select("entity", "slug", F.from_json("document", schema).alias("d"))
    return d.select(
        "entity", "slug", F.array_join(F.col("d.annual_series.year").cast("array<string>"), ",").alias("years"), F.col("d.classification.alan_class").alias("alan_class"),
        F.col("d.rankings.annual_growth").alias("growth_rank"), F.size("d.neighbors").alias("n_neighbors"),
    )


@query("n04_run_metadata", "panel", """SELECT count(DISTINCT entity) AS total_entities, printf('{"year_range":[%d,%d],"total_entities":%d}', min(yr), max(yr), count(DISTINCT entity)) AS document FROM panel""")
def _(t):
    return D.run_metadata(t.panel, "entity", "yr")
