"""Census, name, linkage and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as M
from ..functions import scalars as S
from ..operators import linkage as L
from ..operators import merging as G
from ..operators.checks import dataset_messages
from ..operators.projection import project
from ..session import scratch_path
from ..sources import census as C
from ..sources import places as Z
from ..sources import sinks as K
from .pixel_queries import R6
from .registry import add_view, query

METRICS = ["tot_p", "p_lit", "no_hh", "tot_f"]
SUFFIXES = ["(M Corp.)", "(M Cl)", "(CT)", "(M)", "(CB)", "(Part)", "*", ""]

add_view(
    "dcensus",
    "census",
    """SELECT yr, district, CAST(sum(tot_p) AS BIGINT) AS tot_p, CAST(sum(p_lit) AS BIGINT) AS p_lit, CAST(sum(no_hh) AS BIGINT) AS no_hh,
    CAST(sum(tot_f) AS BIGINT) AS tot_f FROM census GROUP BY 1, 2""",
)


def _district(t):
    return t.census.groupBy("yr", "district").agg(*[F.sum(m).alias(m) for m in METRICS])


def _csv_folder(t, df, label):
    path = scratch_path(t.spark, label)
    df.write.option("header", True).csv(path)
    return path


@query("s03_district_census_scan", "census dcensus", "SELECT district, CAST(tot_p AS DOUBLE) AS TOT_P, CASE WHEN tot_f % 3 <> 0 THEN CAST(tot_f AS DOUBLE) END AS TOT_F FROM dcensus WHERE yr = 2011")
def _(t):
    # Written with an older name column and text where a number is missing.
    d = _district(t).filter("yr = 2011").select(
        F.col("district").alias("District_Name"), F.col("tot_p").alias("TOT_P"),
        F.when(F.col("tot_f") % 3 != 0, F.col("tot_f").cast("string")).otherwise("N.A.").alias("TOT_F"),
    )
    return C.district_census(t.spark, _csv_folder(t, d, "census"))


@query("s04_town_census_scan", "census", "SELECT district, town AS town_name, CAST(no_hh AS VARCHAR) AS town_code, CAST(tot_p AS DOUBLE) AS TOT_P FROM census WHERE yr = 2001")
def _(t):
    d = t.census.filter("yr = 2001").select(
        "district", F.lit("TOWN").alias("level"), F.lit("Urban").alias("tru"), F.col("town").alias("entity_name"),
        F.col("no_hh").alias("entity_code"), F.col("tot_p").alias("TOT_P"),
    )
    return C.town_census(t.spark, _csv_folder(t, d, "towns"))


@query(
    "s05_hierarchy_scan",
    "census dcensus",
    """SELECT district, regexp_extract(district, '([0-9]+)', 1) AS district_code, 'DISTRICT' AS level, 'Total' AS tru, district AS entity_name, '' AS entity_code, CAST(tot_p AS DOUBLE) AS TOT_P FROM dcensus WHERE yr = 2011
    UNION ALL SELECT district, regexp_extract(district, '([0-9]+)', 1), 'TOWN', 'Urban', upper(town[1]) || lower(town[2:]), CAST(no_hh AS VARCHAR), CAST(tot_p AS DOUBLE) FROM census WHERE yr = 2011""",
)
def _(t):
    from ..functions.columns import as_col

    d = _district(t).filter("yr = 2011").select(
        "district", F.lit("DISTRICT").alias("LEVEL"), F.lit("Total").alias("TRU"), F.col("district").alias("NAME"), F.lit("").alias("TOWN_VILL"), F.col("tot_p").alias("TOT_P")
    )
    w = t.census.filter("yr = 2011").select(
        "district", F.lit("TOWN").alias("LEVEL"), F.lit("Urban").alias("TRU"), F.concat(F.lit("* "), F.col("town")).alias("NAME"), F.col("no_hh").cast("string").alias("TOWN_VILL"), F.col("tot_p").alias("TOT_P")
    )
    rows = d.unionByName(w).withColumn("code", F.regexp_extract(as_col("district"), r"(\d+)", 1))
    # One file per district, named <folder>/pca_<code>.csv.
    root = scratch_path(t.spark, "hierarchy")
    rows.drop("district").repartition("code").write.partitionBy("code").option("header", True).csv(root)
    fs_root = _rename_parts(t.spark, root)
    return C.hierarchy(t.spark, f"{fs_root}/pca_*.csv")


def _rename_parts(spark, root: str) -> str:
    """Give each partition folder's file the name <root>/pca_<code>.csv."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(base):
        name = folder.getPath().getName()
        if name.startswith("code="):
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(base, f"pca_{name[5:]}.csv"))
    return root


@query(
    "p13_slugs",
    "",
    """SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority || ' & ' || o_orderstatus), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
     regexp_replace(replace(lower(o_orderpriority || ' (x)'), ' ', '_'), '[^a-z0-9_]', '', 'g') AS file_name,
     regexp_replace(replace(trim(lower(' ' || o_orderpriority || '. ')), ' ', '_'), '[^a-z0-9_-]', '', 'g') AS state_key,
     replace(lower(o_orderpriority), ' ', '_') AS district_key FROM orders""",
)
def _(t):
    p = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        M.url_slug(F.concat(p, F.lit(" & "), F.col("o_orderstatus"))).alias("slug"),
        M.safe_file_name(F.concat(p, F.lit(" (x)"))).alias("file_name"),
        M.state_key(F.concat(F.lit(" "), p, F.lit(". "))).alias("state_key"),
        M.district_key(p).alias("district_key"),
    )


@query(
    "p14_normal_name",
    "",
    """SELECT p_name, trim(regexp_replace(lower(strip_accents('  ' || replace(replace(p_name, 'e', 'é'), 'o', 'ö') || '  É')), '\\s+', ' ', 'g')) AS norm FROM (SELECT DISTINCT p_name FROM part)""",
)
def _(t):
    d = t.part.select("p_name").distinct()
    marked = F.concat(F.lit("  "), F.replace(F.replace(F.col("p_name"), F.lit("e"), F.lit("é")), F.lit("o"), F.lit("ö")), F.lit("  É"))
    return d.select("p_name", M.normal_name(marked).alias("norm"))


SUF = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "][1 + CAST(p_partkey % 8 AS INT)]"


def _suffixed(t):
    s = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", "p_name", F.concat(F.lit(" "), M.title_case("p_name"), F.lit(" "), s).alias("raw"))


@query("p15_town_key", "", "SELECT p_partkey, p_name AS town_key FROM part")
def _(t):
    return _suffixed(t).select("p_partkey", M.town_key("raw").alias("town_key"))


TITLE = "list_aggregate(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"


@query(
    "p16_query_names",
    "",
    f"""SELECT p_partkey, {TITLE.format(x='p_name')} AS basic_name,
     CASE WHEN p_partkey % 5 = 0 THEN 'Khadki' ELSE {TITLE.format(x='p_name')} END AS strict_name FROM part""",
)
def _(t):
    r = _suffixed(t)
    strict = F.when(F.col("p_partkey") % 5 == 0, "Ii)Kirkee Cantt.").otherwise(F.concat(F.lit("Iii)"), F.col("raw")))
    strict = F.when(F.col("p_partkey") % 5 == 0, strict).otherwise(F.concat(F.lit("IX)"), M.title_case("p_name"), F.lit(" (M Corp.) (Part)")))
    return r.select("p_partkey", M.basic_query_name("raw").alias("basic_name"), M.strict_query_name(strict).alias("strict_name"))


@query(
    "p17_query_variants",
    "",
    """WITH n AS (SELECT n_nationkey, n_name AS alt, 0 AS k FROM nation WHERE n_nationkey % 2 = 0 UNION ALL
      SELECT n_nationkey, unnest(['Khadki', 'Kirkee Cantonment', 'Kirkee']), unnest([0, 1, 2]) FROM nation WHERE n_nationkey % 2 = 1),
    q AS (SELECT n_nationkey, k * 3 + 0 AS pos, alt || ', D' || n_nationkey || ' district, State, Country' AS query FROM n
      UNION ALL SELECT n_nationkey, k * 3 + 1, alt || ', D' || n_nationkey || ', State, Country' FROM n
      UNION ALL SELECT n_nationkey, k * 3 + 2, alt || ', State, Country' FROM n)
    SELECT n_nationkey, CAST(pos AS INT) AS pos, query FROM q""",
)
def _(t):
    name = F.when(F.col("n_nationkey") % 2 == 1, "Kirkee").otherwise(F.col("n_name"))
    v = M.query_variants(name, F.concat(F.lit("D"), F.col("n_nationkey").cast("string")), "State", "Country")
    return t.nation.select("n_nationkey", F.posexplode(v).alias("pos", "query"))


@query(
    "p17_fallback_queries",
    "",
    """SELECT n_nationkey, CAST(unnest([0, 1, 2]) AS INT) AS pos, unnest([n_name || ', D district, State, Country', n_name || ', D, State', n_name || ', State, Country']) AS query FROM nation""",
)
def _(t):
    v = M.fallback_queries(F.col("n_name"), F.lit("D"), "State", "Country")
    return t.nation.select("n_nationkey", F.posexplode(v).alias("pos", "query"))


@query(
    "p18_ward_town_names",
    "",
    f"""SELECT p_partkey, {TITLE.format(x='p_name')} || ' (M.Corp.)' AS town, {TITLE.format(x='p_name')} AS words,
     CASE WHEN p_partkey % 3 = 0 THEN 'Mumbai Suburban' ELSE p_brand END AS district FROM part""",
)
def _(t):
    ward = F.concat(F.lit("a)"), F.upper("p_name"), F.lit(" (M.CORP.)* Ward No. 0"), F.col("p_size").cast("string"))
    raw = F.when(F.col("p_partkey") % 3 == 0, "' Mumbai (Suburban)*").otherwise(F.concat(F.lit("* "), F.col("p_brand"), F.lit("'")))
    return t.part.select(
        "p_partkey", M.town_of_ward(ward).alias("town"), M.capitalise_words(F.upper("p_name")).alias("words"), M.district_name(raw).alias("district")
    )


@query(
    "p19_derived_ratios",
    "census",
    """SELECT yr, district, town, round(p_lit / nullif(tot_p - 1110, 0), 8) AS literacy_rate, round((tot_p - 1110) / CAST(no_hh AS DOUBLE), 8) AS household_size FROM census""",
)
def _(t):
    c = t.census.select("yr", "district", "town", F.col("p_lit").alias("P_LIT"), (F.col("tot_p") - 1110).alias("TOT_P"), F.col("no_hh").alias("No_HH"))
    out = S.add_census_ratios(c)
    return out.select("yr", "district", "town", F.round("literacy_rate", 8).alias("literacy_rate"), F.round("household_size", 8).alias("household_size"))


@query("p20_prefixed_columns", "census dcensus", "SELECT district, yr AS c2011_yr, tot_p AS c2011_tot_p, p_lit AS c2011_p_lit FROM dcensus")
def _(t):
    return S.prefix_columns(_district(t).select("district", "yr", "tot_p", "p_lit"), "c2011", ["district"])


@query(
    "p21_sex_split_totals",
    "census",
    """SELECT yr, district, town, CAST(tot_p + tot_f AS DOUBLE) AS P_06, CAST(tot_f * 2 AS DOUBLE) AS TOT_WORK_P, CAST(no_hh AS DOUBLE) + p_lit AS MARGWORK_P,
     CAST(tot_f * 2 - no_hh - p_lit AS DOUBLE) AS MAINWORK_P, CASE WHEN no_hh % 3 <> 0 THEN CAST(no_hh AS DOUBLE) END AS No_HH FROM census""",
)
def _(t):
    text = lambda c: F.col(c).cast("string")
    c = t.census.select(
        "yr", "district", "town", text("tot_p").alias("POPLN_M6"), text("tot_f").alias("POPLN_F6"), text("tot_f").alias("T_M_WORKER"), text("tot_f").alias("T_F_WORKER"),
        text("no_hh").alias("M_MARGINAL"), text("p_lit").alias("F_MARGINAL"), F.when(F.col("no_hh") % 3 != 0, text("no_hh")).otherwise("-").alias("HOUSEHOLDS"),
    )
    sums = {k: C.SUMS_1991[k] for k in ("P_06", "TOT_WORK_P", "MARGWORK_P")}
    out = G.sex_split_totals(c, sums, {"HOUSEHOLDS": "No_HH"})
    return out.select("yr", "district", "town", "P_06", "TOT_WORK_P", "MARGWORK_P", "MAINWORK_P", "No_HH")


@query(
    "a16_hierarchy_roll_up",
    "census",
    """WITH u AS (SELECT district, town, tot_p, no_hh FROM census WHERE yr = 2011 AND district <> 'Nation 7'), r AS (SELECT district, tot_p * 2 AS tot_p, no_hh FROM census WHERE yr = 2001 AND district <> 'Nation 7'),
    a AS (SELECT district, tot_p, no_hh, 'Urban' AS tru FROM u UNION ALL SELECT district, tot_p, no_hh, 'Rural' FROM r)
    SELECT district, 'TOWN' AS level, 'Urban' AS tru, min(town) AS entity_name, town AS entity_code, CAST(sum(tot_p) AS BIGINT) AS tot_p, CAST(sum(no_hh) AS BIGINT) AS no_hh FROM u GROUP BY district, town
    UNION ALL SELECT district, 'DISTRICT', tru, district, '', CAST(sum(tot_p) AS BIGINT), CAST(sum(no_hh) AS BIGINT) FROM a GROUP BY district, tru
    UNION ALL SELECT district, 'DISTRICT', 'Total', district, '', CAST(sum(tot_p) AS BIGINT), CAST(sum(no_hh) AS BIGINT) FROM a GROUP BY district""",
)
def _(t):
    c = t.census
    wards = c.filter("yr = 2011").select("district", F.col("town").alias("code"), F.col("town").alias("name"), "tot_p", "no_hh")
    rural = c.filter("yr = 2001").select("district", (F.col("tot_p") * 2).alias("tot_p"), "no_hh")
    return G.level_order(G.roll_up(wards, "district", "code", "name", ["tot_p", "no_hh"], rural, unmapped=["Nation 7"]), "district")


MERGE_SQL = "SELECT p.entity, p.yr, round(p.mean_value, 6) AS mean_value, d.tot_p, d.p_lit FROM panel p LEFT JOIN {ds} d ON d.district = concat('Nation ', p.entity) {on}"


def _named_panel(t):
    return t.panel.select(
        "entity", F.col("yr").alias("year"), F.concat(F.lit("Nation "), F.col("entity").cast("string")).alias("district"), F.round("mean_value", 6).alias("mean_value")
    )


@query("j08_snapshot_join", "panel census dcensus", MERGE_SQL.format(ds="dcensus", on="AND d.yr = 1991"))
def _(t):
    snap = _district(t).filter("yr = 1991").select("district", "tot_p", "p_lit")
    out = G.merge_yearly(_named_panel(t), [(snap, "snapshot", "district"), (t.census, "snapshot", "town")], "district")
    return out.select("entity", F.col("year").alias("yr"), "mean_value", "tot_p", "p_lit")


@query("j09_year_matched_join", "panel census dcensus", MERGE_SQL.format(ds="dcensus", on="AND d.yr = p.yr"))
def _(t):
    series = _district(t).select("district", F.col("yr").alias("year"), "tot_p", "p_lit")
    out = G.merge_yearly(_named_panel(t), [(series, "timeseries", "district")], "district")
    return out.select("entity", F.col("year").alias("yr"), "mean_value", "tot_p", "p_lit")


@query(
    "j10_trend_join",
    "panel census dcensus",
    """SELECT p.entity, d.tot_p FROM (SELECT DISTINCT entity FROM panel) p LEFT JOIN (SELECT district, min_by(tot_p, yr) AS tot_p FROM dcensus GROUP BY district) d ON d.district = concat('Nation ', p.entity)""",
)
def _(t):
    one = _named_panel(t).select("entity", "district").distinct()
    series = _district(t).select("district", F.col("yr").alias("year"), "tot_p")
    return G.merge_trends(one, [(series, "timeseries", "district")], "district").select("entity", "tot_p")


@query(
    "j11_fan_out_guard",
    "panel census",
    """SELECT 'towns' AS dataset, (SELECT count(*) FROM panel) AS rows_before, count(*) AS rows_after, count(*) > 2 * (SELECT count(*) FROM panel) AS expanded
    FROM panel p LEFT JOIN census c ON c.district = concat('Nation ', p.entity)""",
)
def _(t):
    p = _named_panel(t)
    return G.fan_out(p, p.join(t.census.select("district", "town"), "district", "left"), "towns")


def _typo(t):
    """District names of the census with the spelling changes the cascade must undo."""
    k = F.regexp_extract("district", r"(\d+)", 1).cast("int")
    d = t.census.select("district").distinct()
    return d.select(
        F.when(k % 4 == 0, F.upper("district")).when(k % 4 == 1, F.concat(F.lit("Nationn "), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("Old "), k.cast("string"))).otherwise(F.concat(F.lit("zz "), k.cast("string"))).alias("name")
    )


@query(
    "j12_name_resolution",
    "census",
    r"""WITH d AS (SELECT DISTINCT district, CAST(regexp_extract(district, '(\d+)', 1) AS INT) AS k FROM census)
    SELECT CASE k % 4 WHEN 0 THEN upper(district) WHEN 1 THEN 'Nationn ' || k WHEN 2 THEN 'Old ' || k ELSE 'zz ' || k END AS name,
      CASE WHEN k % 4 = 3 THEN 'zz ' || k ELSE district END AS resolved, ['exact', 'fuzzy', 'override', 'unmatched'][k % 4 + 1] AS method FROM d""",
)
def _(t):
    known = t.census.select("district").distinct()
    over = {f"nation {i}": f"old {i}" for i in range(2, 25, 4)}
    return L.resolve_names(_typo(t), known, "name", "district", over, 0.8)


def _towns(t):
    """Towns per district and census with small spelling changes in one year."""
    n = F.col("town")
    name = F.when(F.col("yr") == 2001, F.concat(n, F.lit(" (M Cl)"))).when(
        (F.col("yr") == 2011) & (F.col("no_hh") % 40 == 0), F.concat(F.lower(n), F.lit("a"))
    ).otherwise(n)
    return t.census.withColumn("name", name).withColumn("norm", M.town_key("name"))


TOWN_CTE = """t AS (SELECT *, CASE WHEN yr = 2011 AND no_hh % 40 = 0 THEN lower(town) || 'a' ELSE lower(town) END AS norm,
 CASE WHEN yr = 2001 THEN town || ' (M Cl)' WHEN yr = 2011 AND no_hh % 40 = 0 THEN lower(town) || 'a' ELSE town END AS name FROM census)"""

# A misspelt town joins the right spelling of its district if that was seen in two censuses.
KEY_CTE = f"""{TOWN_CTE}, m AS (SELECT district, norm, count(DISTINCT yr) AS n FROM t GROUP BY 1, 2),
 keyed AS (SELECT t.*, CASE WHEN t.norm <> lower(t.town) AND m.n >= 2 THEN lower(t.town) ELSE t.norm END AS town_key
   FROM t LEFT JOIN m ON m.district = t.district AND m.norm = lower(t.town))"""


@query("j13_town_matching", "census", f"WITH {KEY_CTE} SELECT DISTINCT district, norm, yr, town_key FROM keyed")
def _(t):
    rows = _towns(t).withColumn("ord", F.col("tot_p"))
    return L.match_across_years(rows, "district", "norm", "yr", "ord")


@query(
    "j14_town_master",
    "census",
    f"""WITH {TOWN_CTE} SELECT district, norm, min_by(name, yr) AS display_name, min(yr) AS first_census, count(*) AS census_count,
     string_agg(CAST(yr AS VARCHAR), ',' ORDER BY yr) AS census_years, max(tot_p) FILTER (WHERE yr = 1991) AS tot_p_1991, max(tot_p) FILTER (WHERE yr = 2001) AS tot_p_2001,
     max(tot_p) FILTER (WHERE yr = 2011) AS tot_p_2011 FROM t GROUP BY district, norm""",
)
def _(t):
    return L.town_master(_towns(t), "district", "norm", "yr", "name", ["tot_p"], [1991, 2001, 2011])


@query(
    "j19_name_cross_check",
    "",
    """WITH a AS (SELECT DISTINCT n_name AS a FROM nation WHERE n_nationkey % 6 <> 0), b AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 1 THEN lower(n_name) WHEN n_nationkey = 12 THEN 'nati?' WHEN n_nationkey = 18 THEN 'na' ELSE n_name END AS b FROM nation WHERE n_nationkey % 4 <> 2 OR n_nationkey IN (12, 18)),
    j AS (SELECT * FROM (SELECT a, lower(trim(a)) AS ka FROM a) x FULL JOIN (SELECT b, lower(trim(b)) AS kb FROM b) y ON ka = kb)
    SELECT coalesce(b, a) AS name, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' ELSE 'case_only' END AS status,
     s.similar
    FROM j LEFT JOIN (SELECT a AS similar, lower(trim(a)) AS ks FROM a) s ON j.a IS NULL AND starts_with(s.ks, substr(kb, 1, 4))
    WHERE a IS NULL OR b IS NULL OR a <> b""",
)
def _(t):
    k = F.col("n_nationkey")
    a = t.nation.filter(k % 6 != 0).select("n_name")
    b = t.nation.filter((k % 4 != 2) | k.isin(12, 18)).select(
        F.when(k % 5 == 1, F.lower("n_name")).when(k == 12, "nati?").when(k == 18, "na").otherwise(F.col("n_name")).alias("name")
    )
    return L.cross_check(a, b, "n_name", "name")


@query(
    "j22_location_table",
    "",
    """WITH p AS (SELECT p_partkey, p_name AS name, p_brand AS district, p_retailprice AS pop, CAST(15 + p_partkey % 700 / 100.0 AS DOUBLE) AS lat, CAST(73 + p_partkey % 800 / 100.0 AS DOUBLE) AS lon FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 7 <> 0),
    d AS (SELECT name, count(DISTINCT district) AS nd FROM p GROUP BY name),
    l AS (SELECT p.*, (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(p.name, ' ')) AS w)) || CASE WHEN nd > 1 THEN ' (' || district || ')' ELSE '' END AS display FROM p JOIN d ON p.name = d.name)
    SELECT display, lat, lon, district, pop FROM (SELECT *, row_number() OVER (PARTITION BY display ORDER BY pop DESC, lat DESC, lon DESC) AS rn FROM l) WHERE rn = 1""",
)
def _(t):
    k = F.col("p_partkey")
    p = t.part.select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("district"), F.col("p_retailprice").alias("pop"),
        F.when(k % 7 != 0, 15 + (k % 700) / 100.0).alias("lat"), (73 + (k % 800) / 100.0).alias("lon"), F.when(k % 9 == 0, "failed").otherwise("ok").alias("status"),
    )
    return G.location_table(p, "name", "district", "pop", "status")


@query(
    "t17_district_projection",
    "census dcensus",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY yr DESC) AS k, count(*) OVER (PARTITION BY district) AS n FROM dcensus),
    e AS (SELECT x.district, x.yr AS y1, z.yr AS y0, x.tot_p AS p1, z.tot_p AS p0, x.p_lit AS l1, z.p_lit AS l0 FROM a x JOIN a z ON x.district = z.district AND x.k = 1 AND z.k = 2 WHERE x.n >= 2)
    SELECT district, CAST(t AS INT) AS year, round(p0 + (p1 - p0) / (y1 - y0) * (t - y0), 6) AS tot_p, round(l0 + (l1 - l0) / (y1 - y0) * (t - y0), 6) AS p_lit FROM e, (SELECT unnest(range(2012, 2025)) AS t)""",
)
def _(t):
    return project(_district(t), ["district"], "yr", ["tot_p", "p_lit"]).select("district", "year", *R6("tot_p", "p_lit"))


@query(
    "t17_interpolated_years",
    "census dcensus",
    """WITH y AS (SELECT unnest([1985, 1991, 1996, 2001, 2006, 2011, 2020]) AS t),
    r AS (SELECT district, t, max(yr) FILTER (WHERE yr < t) AS lo, min(yr) FILTER (WHERE yr >= t) AS hi, min(yr) AS a, max(yr) AS z FROM dcensus, y GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN lo IS NULL THEN a WHEN hi IS NULL THEN (SELECT max(yr) FROM dcensus d WHERE d.district = r.district AND d.yr < r.z) ELSE lo END AS y0,
      CASE WHEN lo IS NULL THEN (SELECT min(yr) FROM dcensus d WHERE d.district = r.district AND d.yr > r.a) WHEN hi IS NULL THEN z ELSE hi END AS y1 FROM r)
    SELECT s.district, CAST(t AS INT) AS year, round(p.tot_p + (q.tot_p - p.tot_p) / (y1 - y0) * (t - y0), 6) AS tot_p FROM s JOIN dcensus p ON p.district = s.district AND p.yr = y0 JOIN dcensus q ON q.district = s.district AND q.yr = y1""",
)
def _(t):
    return project(_district(t), ["district"], "yr", ["tot_p"], [1985, 1991, 1996, 2001, 2006, 2011, 2020]).select("district", "year", *R6("tot_p"))


@query(
    "t18_town_projection",
    "census",
    f"""WITH {KEY_CTE}, g AS (SELECT district, town_key, yr, CAST(max(tot_p) AS DOUBLE) AS p, CAST(max(p_lit) AS DOUBLE) AS l FROM keyed GROUP BY 1, 2, 3),
     a AS (SELECT *, row_number() OVER (PARTITION BY district, town_key ORDER BY yr DESC) AS k FROM g)
    SELECT x.district, x.town_key, CAST(t AS INT) AS year, round(z.p + (x.p - z.p) / (x.yr - z.yr) * (t - z.yr), 6) AS tot_p,
      round(z.l + (x.l - z.l) / (x.yr - z.yr) * (t - z.yr), 6) AS p_lit
    FROM a x JOIN a z ON x.district = z.district AND x.town_key = z.town_key AND x.k = 1 AND z.k = 2, (SELECT unnest(range(2012, 2025)) AS t)""",
)
def _(t):
    rows = _towns(t).withColumn("ord", F.col("tot_p"))
    keys = L.match_across_years(rows, "district", "norm", "yr", "ord")
    linked = rows.join(keys, ["district", "norm", "yr"])
    sums = linked.groupBy("district", "town_key", "yr").agg(F.max("tot_p").alias("tot_p"), F.max("p_lit").alias("p_lit"))
    out = project(sums, ["district", "town_key"], "yr", ["tot_p", "p_lit"], single="null")
    return out.select("district", "town_key", "year", *R6("tot_p", "p_lit"))


PROJ19 = f"""WITH {TOWN_CTE},
 a AS (SELECT district, norm, yr, CAST(tot_p AS DOUBLE) AS p, CAST(p_lit AS DOUBLE) - 900 AS l, row_number() OVER (PARTITION BY district, norm ORDER BY yr DESC) AS k, count(*) OVER (PARTITION BY district, norm) AS n FROM t),
 e AS (SELECT x.district, x.norm, x.n, x.yr AS y1, z.yr AS y0, x.p AS p1, z.p AS p0, x.l AS l1, z.l AS l0 FROM a x LEFT JOIN a z ON x.district = z.district AND x.norm = z.norm AND z.k = 2 WHERE x.k = 1),
 f AS (SELECT district, norm, n, CAST(t AS INT) AS year, CASE WHEN n = 1 THEN p1 ELSE greatest(p0 + (p1 - p0) / (y1 - y0) * (t - y0), 0) END AS p, CASE WHEN n = 1 THEN l1 ELSE greatest(l0 + (l1 - l0) / (y1 - y0) * (t - y0), 0) END AS l FROM e, (SELECT unnest(range(2012, 2025)) AS t))
"""


def _held(t):
    rows = _towns(t).withColumn("p_lit", F.col("p_lit") - 900)
    return project(rows, ["district", "norm"], "yr", ["tot_p", "p_lit"], min_anchors=1, single="hold", floor_zero=True)


@query("t19_town_projection_held", "census", PROJ19 + "SELECT district, norm, year, round(p, 6) AS tot_p, round(l, 6) AS p_lit, round(l / nullif(p, 0), 6) AS literacy_rate FROM f")
def _(t):
    return S.add_census_ratios(_held(t)).select("district", "norm", "year", *R6("tot_p", "p_lit", "literacy_rate"))


@query("a32_projection_summary", "census", PROJ19 + "SELECT year, count(*) AS towns, CAST(count(DISTINCT district) AS BIGINT) AS districts, round(sum(p), 4) AS population FROM f GROUP BY year")
def _(t):
    return _held(t).groupBy("year").agg(
        F.count(F.lit(1)).alias("towns"), F.count_distinct("district").alias("districts"), F.round(F.sum("tot_p"), 4).alias("population")
    )


@query(
    "a32_anchor_counts",
    "census",
    f"WITH {TOWN_CTE} SELECT c AS census_count, count(*) AS towns FROM (SELECT count(*) AS c FROM t GROUP BY district, norm) GROUP BY c",
)
def _(t):
    return Z.projection_summary(L.town_master(_towns(t), "district", "norm", "yr", "name", ["tot_p"], [1991, 2001, 2011]))


@query(
    "a32_geocode_summary",
    "",
    """WITH p AS (SELECT p_brand AS district, p_partkey % 7 <> 0 AS ok, p_partkey % 9 = 0 AS bad FROM part)
    SELECT district, count(*) AS total, count(*) FILTER (WHERE ok) AS with_coords, count(*) FILTER (WHERE bad) AS failed, round(count(*) FILTER (WHERE ok) / count(*) * 100.0, 6) AS success_pct FROM p GROUP BY ROLLUP (district)""",
)
def _(t):
    k = F.col("p_partkey")
    p = t.part.select(F.col("p_brand").alias("district"), F.when(k % 7 != 0, 1.0).alias("lat"), F.when(k % 9 == 0, "failed").alias("geocode_status"))
    out = Z.geocode_summary(p)
    return out.select("district", "total", "with_coords", "failed", *R6("success_pct"))


@query(
    "f01_dataset_load",
    "census dcensus",
    """SELECT CASE WHEN CAST(regexp_extract(district, '([0-9]+)', 1) AS INT) % 2 = 0 THEN district ELSE district END AS district, CAST(tot_p AS DOUBLE) AS c2011_TOT_P, CAST(p_lit AS DOUBLE) AS c2011_P_LIT, CAST(no_hh AS DOUBLE) AS c2011_No_HH, round(p_lit / CAST(tot_p AS DOUBLE), 8) AS c2011_literacy_rate, round(tot_p / CAST(no_hh AS DOUBLE), 8) AS c2011_household_size FROM dcensus WHERE yr = 2011""",
)
def _(t):
    d = _district(t).filter("yr = 2011").select(
        F.upper("district").alias("district"), F.col("tot_p").alias("TOT_P"), F.col("p_lit").alias("P_LIT"), F.col("no_hh").alias("No_HH")
    )
    table = C.district_census(t.spark, _csv_folder(t, d, "census"))
    known = t.census.select("district").distinct()
    df, _ = C.load_dataset(table, C.Dataset("census_2011", "c2011"), known)
    return df.select(
        "district", "c2011_TOT_P", "c2011_P_LIT", "c2011_No_HH", F.round("c2011_literacy_rate", 8).alias("c2011_literacy_rate"), F.round("c2011_household_size", 8).alias("c2011_household_size")
    )


@query(
    "q02_dataset_messages",
    "census dcensus",
    """SELECT 'Only 2 metric columns (expected >= 5)' AS message UNION ALL
    SELECT printf('Column ''c_tot_f'' has %.1f%% NULL values', count(*) FILTER (WHERE tot_f % 2 = 0) / count(*) * 100.0) FROM dcensus HAVING count(*) FILTER (WHERE tot_f % 2 = 0) / count(*) > 0.2
    UNION ALL SELECT printf('Only %d districts (expected >= 20)', count(DISTINCT district)) FROM dcensus HAVING count(DISTINCT district) < 20""",
)
def _(t):
    d = _district(t).select("district", F.col("tot_p").alias("c_tot_p"), F.when(F.col("tot_f") % 2 != 0, F.col("tot_f")).alias("c_tot_f"))
    return dataset_messages(d, "c")


@query(
    "s12_census_sinks",
    "census dcensus",
    """WITH d AS (SELECT district, 'DISTRICT' AS level, district AS entity_name, tot_p FROM dcensus WHERE yr = 2011),
    w AS (SELECT district, 'TOWN' AS level, town AS entity_name, tot_p FROM census WHERE yr = 2011)
    SELECT output, district, level, entity_name, CAST(tot_p AS BIGINT) AS tot_p FROM (SELECT 'totals' AS output, district, NULL AS level, NULL AS entity_name, tot_p FROM d
      UNION ALL SELECT 'districts', * FROM d UNION ALL SELECT 'towns', * FROM w UNION ALL SELECT 'by_district', * FROM d UNION ALL SELECT 'by_district', * FROM w)""",
)
def _(t):
    d = _district(t).filter("yr = 2011").select("district", F.lit("DISTRICT").alias("level"), F.lit("Total").alias("tru"), F.col("district").alias("entity_name"), "tot_p")
    w = t.census.filter("yr = 2011").select("district", F.lit("TOWN").alias("level"), F.lit("Urban").alias("tru"), F.col("town").alias("entity_name"), "tot_p")
    rows = d.unionByName(w).withColumn("district_code", F.regexp_extract("district", r"(\d+)", 1))
    paths = K.census_outputs(rows, 2011, scratch_path(t.spark, "outputs"), ["tot_p"])
    out = None
    for name, path in paths.items():
        back = t.spark.read.option("header", True).csv(path)
        held = [F.col(c) if c in back.columns else F.lit(None).cast("string").alias(c) for c in ("district", "level", "entity_name")]
        one = back.select(F.lit(name).alias("output"), *held, F.col("tot_p").cast("long").alias("tot_p"))
        out = one if out is None else out.unionByName(one)
    return out


# Part names stand for datasets, part types for groups of them.
SELECT_SQL = """WITH known AS (SELECT p_name AS dataset, min(p_brand) AS label FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
 asked AS (SELECT DISTINCT CASE WHEN p_partkey % 11 = 0 THEN 'ECONOMY' WHEN p_partkey % 11 = 1 THEN p_name ELSE 'unknown' END AS n FROM part),
 wide AS (SELECT n FROM asked UNION SELECT p_name FROM part WHERE p_type = 'ECONOMY' AND 'ECONOMY' IN (SELECT n FROM asked))"""


def _selected(t):
    k = F.col("p_partkey")
    known = t.part.filter(k % 3 != 0).groupBy(F.col("p_name").alias("dataset")).agg(F.min("p_brand").alias("label"))
    groups = t.part.select(F.col("p_type").alias("alias"), F.col("p_name").alias("dataset")).distinct()
    asked = t.part.select(F.when(k % 11 == 0, "ECONOMY").when(k % 11 == 1, F.col("p_name")).otherwise("unknown").alias("name"))
    return C.select_datasets(asked, known, groups)


@query("s14_dataset_selection", "", SELECT_SQL + " SELECT dataset, label FROM known WHERE dataset IN (SELECT n FROM wide)")
def _(t):
    return _selected(t)


@query(
    "s14_dataset_suffix",
    "",
    SELECT_SQL + " SELECT coalesce('_x_' || string_agg(label, '_' ORDER BY label), '') AS suffix FROM (SELECT DISTINCT label FROM known WHERE dataset IN (SELECT n FROM wide))",
)
def _(t):
    return C.dataset_suffix(_selected(t))
