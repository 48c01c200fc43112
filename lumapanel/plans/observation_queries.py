"""Observation, migration and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as O
from ..session import scratch_path
from ..sources import observations as R
from ..streaming.profiles import stream_monthly_sums
from .pixel_queries import R6
from .registry import add_view, query

DIRECTIONS = {"view": "N", "click": "E", "signup": "S", "purchase": "W"}
DIR_SQL = "CASE state WHEN 'view' THEN 'N' WHEN 'click' THEN 'E' WHEN 'signup' THEN 'S' WHEN 'purchase' THEN 'W' END"
HOME = "error"
COLS = {"individuals": "individualcount"}
NAMES = {"species": "specieskey", "month": "mon"}
EXTENT = {"west": 72.6, "east": 80.6, "south": 16.0, "north": 22.0}
NX, NY = 17, 13

SUMS = """count(*) AS obs_count, avg(lat) AS mean_lat, avg(lon) AS mean_lon, CAST(sum(coalesce(individualcount, 1)) AS BIGINT) AS individual_sum"""
add_view(
    "prof",
    "observations",
    f"""SELECT p.*, p.obs_count / e.effort AS norm_frequency FROM (SELECT specieskey, mon, {SUMS} FROM observations GROUP BY 1, 2) p
    JOIN (SELECT mon, count(*) AS effort FROM observations GROUP BY 1) e ON p.mon = e.mon WHERE obs_count >= 5""",
)
add_view(
    "classes_view",
    "observations prof",
    """SELECT specieskey, CAST(count(*) AS INT) AS months_present, stddev_pop(norm_frequency) / avg(norm_frequency) AS cv,
     sqrt(pow(max(mean_lat) - min(mean_lat), 2) + pow(max(mean_lon) - min(mean_lon), 2)) AS shift, max(gap) AS gap,
     arg_min(mon, -obs_count * 100 + mon) AS peak, min(mon) AS first, max(mon) AS last, avg(mean_lon) AS mlon,
     arg_min(mon, -coalesce(gap, 0) * 100 + mon) AS gap_from, arg_min(nxt, -coalesce(gap, 0) * 100 + mon) AS gap_to
    FROM (SELECT *, lead(mon) OVER w AS nxt, lead(mon) OVER w - mon AS gap FROM prof WINDOW w AS (PARTITION BY specieskey ORDER BY mon)) GROUP BY 1""",
)
add_view(
    "class_table",
    "observations prof classes_view",
    """SELECT specieskey, months_present, round(cv, 4) AS seasonality_cv, round(shift, 4) AS centroid_shift_deg, CAST(peak AS INT) AS peak_month,
     CASE WHEN months_present >= 10 THEN 'resident' WHEN months_present >= 3 THEN 'migratory' ELSE 'passage' END AS migration_class,
     CAST(CASE WHEN months_present < 10 THEN CASE WHEN gap > 3 THEN gap_to ELSE first END END AS INT) AS arrival_month,
     CAST(CASE WHEN months_present < 10 THEN CASE WHEN gap > 3 THEN gap_from ELSE last END END AS INT) AS departure_month, mlon < 76.5 AS is_coastal FROM classes_view""",
)
CLASS_VIEWS = "observations prof classes_view class_table"


def _profiles(t):
    return O.monthly_profiles(t.observations, **NAMES, **COLS)


def _classes(t):
    return O.classify_species(_profiles(t), **NAMES, coast_lon=76.5)


def _neighbours(t, classes):
    moving = classes.filter(F.col("migration_class") != "resident")
    # Neighbours to the north see a species a month earlier, those to the east a month later.
    shift = F.when(F.col("state") == "view", 10).when(F.col("state") == "click", 12).otherwise(11)
    there = t.observations.filter(F.col("state") != HOME).withColumn("mon", (1 + (F.col("mon") + shift) % 12).cast("int"))
    return O.neighbour_profiles(there, moving, **NAMES, **COLS)


add_view(
    "nb",
    CLASS_VIEWS,
    f"""SELECT o.specieskey, o.state, CAST(1 + (o.mon + CASE state WHEN 'view' THEN 10 WHEN 'click' THEN 12 ELSE 11 END) % 12 AS INT) AS mon, {SUMS}
    FROM observations o WHERE state <> '{HOME}' AND specieskey IN
    (SELECT specieskey FROM class_table WHERE migration_class <> 'resident') GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
)
NB_VIEWS = CLASS_VIEWS + " nb"


def _tsv(t):
    """Events written as a tab-separated observation file with gaps."""
    path = scratch_path(t.spark, "obs")
    o = t.observations.select(
        F.col("specieskey").alias("speciesKey"), F.concat(F.lit("Sp "), "specieskey").alias("scientificName"),
        F.when(F.col("event_id") % 9 != 0, F.col("lat")).alias("decimalLatitude"), F.col("lon").alias("decimalLongitude"),
        F.when(F.col("event_id") % 10 != 0, F.col("mon")).alias("month"), (F.lit(1985) + F.col("event_id") % 20).alias("year"),
        F.col("individualcount").alias("individualCount"), F.lit("unused").alias("order"),
    )
    o.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return path


@query(
    "s06_observation_scan",
    "observations",
    """SELECT specieskey AS species_key, mon AS month, count(*) AS n, round(sum(lat), 4) AS lat_sum FROM observations
    WHERE event_id % 9 <> 0 AND event_id % 10 <> 0 AND CAST(specieskey AS INT) < 30 GROUP BY 1, 2""",
)
def _(t):
    keys = t.observations.filter(F.col("specieskey").cast("int") < 30).select(F.col("specieskey").alias("species_key"))
    rows = R.read_observations(t.spark, _tsv(t), keys)
    return rows.groupBy("species_key", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("lat_sum"))


@query(
    "s07_second_source_scan",
    "observations",
    """SELECT event_id AS row_id, CAST(concat(1985 + event_id % 12, '-0', 1 + event_id % 9, '-11') AS DATE) AS observed_on, CAST(1 + event_id % 9 AS INT) AS month,
     CAST(1985 + event_id % 12 AS INT) AS year, lat FROM observations WHERE event_id % 12 >= 6 AND event_id % 5 <> 0 AND event_id % 13 <> 0""",
)
def _(t):
    e = F.col("event_id")
    path = scratch_path(t.spark, "second")
    day = F.concat((1985 + e % 12).cast("string"), F.lit("-0"), (1 + e % 9).cast("string"), F.lit("-11"))
    t.observations.select(
        e.alias("id"), F.when(e % 13 != 0, F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"), F.lit("Name").alias("scientific_name"),
        F.lit("n").alias("common_name"), F.when(e % 5 == 0, "someday").otherwise(day).alias("observed_on"),
    ).write.option("header", True).csv(path)
    out = R.read_second_source(t.spark, path)
    return out.select(F.col("row_id").cast("long").alias("row_id"), "observed_on", "month", "year", "lat")


@query(
    "s11_partitioned_split",
    "observations",
    """SELECT replace(state, ' ', '_') AS state_key, CASE WHEN event_id % 21 = 20 THEN 'archive' WHEN 1985 + event_id % 20 >= 1991 THEN 'modern' ELSE 'archive' END AS era,
      event_id, CASE WHEN event_id % 21 = 20 THEN 'x' ELSE CAST(1985 + event_id % 20 AS VARCHAR) END AS year, ' ' || upper(state) || '.' AS province
    FROM observations WHERE event_id % 8 <> 0""",
)
def _(t):
    e = F.col("event_id")
    path = scratch_path(t.spark, "split")
    rows = t.observations.select(
        "event_id", F.when(e % 8 != 0, F.concat(F.lit(" "), F.upper("state"), F.lit("."))).otherwise(" ").alias("stateProvince"),
        F.when(e % 21 == 20, "x").otherwise((1985 + e % 20).cast("string")).alias("year"),
    )
    R.write_split(rows, "stateProvince", "year", path, rows_per_file=1000)
    back = t.spark.read.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return back.select("state_key", "era", F.col("event_id").cast("long").alias("event_id"), "year", F.col("stateProvince").alias("province"))


@query(
    "s11_split_counts",
    "observations",
    """SELECT CASE WHEN event_id % 8 = 0 THEN 'skipped' ELSE state || CASE WHEN 1985 + event_id % 20 >= 1991 THEN '_modern' ELSE '_archive' END END AS file_key, count(*) AS n FROM observations GROUP BY 1""",
)
def _(t):
    e = F.col("event_id")
    rows = t.observations.select(F.when(e % 8 != 0, F.col("state")).alias("state"), (1985 + e % 20).alias("year"))
    return R.split_counts(rows, "state", "year")


P6 = "specieskey, mon, obs_count, round(norm_frequency, 8) AS norm_frequency, round(mean_lat, 6) AS mean_lat, round(mean_lon, 6) AS mean_lon, individual_sum"


@query("a18_monthly_profiles", "observations prof", f"SELECT {P6} FROM prof")
def _(t):
    return _profiles(t).select(
        "specieskey", "mon", "obs_count", F.round("norm_frequency", 8).alias("norm_frequency"), *R6("mean_lat", "mean_lon"), "individual_sum"
    )


@query("a19_neighbour_profiles", NB_VIEWS, "SELECT specieskey, state, mon, obs_count, round(mean_lat, 6) AS mean_lat, round(mean_lon, 6) AS mean_lon, individual_sum FROM nb")
def _(t):
    return _neighbours(t, _classes(t)).select("specieskey", "state", "mon", "obs_count", *R6("mean_lat", "mean_lon"), "individual_sum")


@query("a20_species_classes", CLASS_VIEWS, "SELECT * FROM class_table")
def _(t):
    return _classes(t)


@query("w08_arrival_departure", CLASS_VIEWS, "SELECT specieskey, migration_class, arrival_month, departure_month FROM class_table WHERE arrival_month IS NOT NULL")
def _(t):
    return _classes(t).filter(F.col("arrival_month").isNotNull()).select("specieskey", "migration_class", "arrival_month", "departure_month")


CORR = f"""WITH s AS (SELECT {DIR_SQL} AS direction, n.specieskey, CAST(sum(obs_count) AS BIGINT) AS obs, bool_or((c.arrival_month - n.mon + 12) % 12 BETWEEN 1 AND 3) AS "entry",
   bool_or((n.mon - c.departure_month + 12) % 12 BETWEEN 1 AND 3) AS "exit" FROM nb n JOIN class_table c ON n.specieskey = c.specieskey WHERE c.arrival_month IS NOT NULL GROUP BY 1, 2)
"""


@query("a21_corridor_species", NB_VIEWS, CORR + 'SELECT direction, specieskey, obs, "entry", "exit" FROM s')
def _(t):
    c = _classes(t)
    return O.corridor_species(c, _neighbours(t, c), DIRECTIONS, **NAMES)


@query(
    "a21_corridors",
    NB_VIEWS,
    CORR
    + """SELECT d.direction, count(*) FILTER (WHERE "entry") AS n_entry, count(*) FILTER (WHERE "exit") AS n_exit, CAST(coalesce(sum(obs), 0) AS BIGINT) AS total_obs,
     coalesce(string_agg(specieskey || ':' || obs, ',' ORDER BY obs DESC, specieskey) FILTER (WHERE "entry"), '') AS entry_species,
     coalesce(string_agg(specieskey || ':' || obs, ',' ORDER BY obs DESC, specieskey) FILTER (WHERE "exit"), '') AS exit_species
    FROM (SELECT unnest(['N', 'E', 'S', 'W']) AS direction) d LEFT JOIN s ON s.direction = d.direction GROUP BY 1""",
)
def _(t):
    c = _classes(t)
    return O.corridors(O.corridor_species(c, _neighbours(t, c), DIRECTIONS, **NAMES), DIRECTIONS, "specieskey")


@query(
    "a21_corridor_leaders",
    NB_VIEWS,
    CORR + 'SELECT direction, specieskey, obs FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY obs DESC, specieskey) AS rn FROM s WHERE "entry") WHERE rn <= 3',
)
def _(t):
    c = _classes(t)
    return O.corridor_leaders(O.corridor_species(c, _neighbours(t, c), DIRECTIONS, **NAMES), "entry", 3, "specieskey")


LOOKUP_SQL = "SELECT DISTINCT specieskey, ['CR', 'EN', 'VU', 'NT', 'LC', 'DD'][1 + CAST(specieskey AS INT) % 6] AS iucn_code, 'CAT' || CAST(specieskey AS INT) % 6 AS iucn_category FROM observations WHERE CAST(specieskey AS INT) % 4 <> 0"


def _lookup(t):
    k = F.col("specieskey").cast("int")
    codes = F.array(*[F.lit(c) for c in O.RED_LIST[:6]])
    rows = t.observations.filter(k % 4 != 0).select("specieskey").distinct()
    return rows.select("specieskey", F.element_at(codes, k % 6 + 1).alias("iucn_code"), F.concat(F.lit("CAT"), (k % 6).cast("string")).alias("iucn_category"))


add_view("rich", CLASS_VIEWS, f"SELECT c.*, coalesce(l.iucn_code, 'NE') AS iucn_code, coalesce(l.iucn_category, 'NOT_EVALUATED') AS iucn_category FROM class_table c LEFT JOIN ({LOOKUP_SQL}) l ON c.specieskey = l.specieskey")


@query("j15_red_list_enrichment", CLASS_VIEWS + " rich", "SELECT specieskey, migration_class, iucn_code, iucn_category FROM rich")
def _(t):
    return O.enrich(_classes(t), _lookup(t), "specieskey").select("specieskey", "migration_class", "iucn_code", "iucn_category")


@query(
    "a22_seasonal_summary",
    CLASS_VIEWS + " rich",
    """WITH m AS (SELECT * FROM rich WHERE migration_class <> 'resident'), f AS (SELECT 'code' AS panel, iucn_code AS label FROM m UNION ALL SELECT 'arrival', CAST(arrival_month AS VARCHAR) FROM m
      UNION ALL SELECT 'departure', CAST(departure_month AS VARCHAR) FROM m UNION ALL SELECT 'class', migration_class FROM rich),
    s AS (SELECT 'code' AS panel, unnest(['CR', 'EN', 'VU', 'NT', 'LC', 'DD', 'NE']) AS label UNION ALL SELECT p, CAST(i AS VARCHAR) FROM (SELECT unnest(['arrival', 'departure']) AS p), (SELECT unnest(range(1, 13)) AS i)
      UNION ALL SELECT 'class', unnest(['resident', 'migratory', 'passage']))
    SELECT s.panel, s.label, count(f.label) AS n FROM s LEFT JOIN f ON s.panel = f.panel AND s.label = f.label GROUP BY 1, 2""",
)
def _(t):
    return O.seasonal_summary(O.enrich(_classes(t), _lookup(t), "specieskey"))


@query(
    "a22_seasons",
    "observations",
    "SELECT CASE WHEN mon IN (9, 10, 11) THEN 'post_nuptial' WHEN mon IN (6, 7, 8) THEN 'breeding' ELSE 'pre_nuptial' END AS season, count(*) AS n FROM observations GROUP BY 1",
)
def _(t):
    return t.observations.groupBy(O.season_of(F.col("mon")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a23_density_surface",
    "observations",
    f"""WITH s AS (SELECT mon, count(*) AS n, var_samp(lon) AS vx, var_samp(lat) AS vy, covar_samp(lon, lat) AS vxy FROM observations GROUP BY 1 HAVING count(*) >= 10),
    b AS (SELECT mon, lon AS px, lat AS py, count(*) AS m FROM observations GROUP BY 1, 2, 3),
    g AS (SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, 72.6 + i * 0.5 AS gx, 16.0 + j * 0.5 AS gy FROM (SELECT unnest(range(0, {NX})) AS i), (SELECT unnest(range(0, {NY})) AS j)),
    c AS (SELECT mon, n, vx * 0.0225 AS a, vy * 0.0225 AS d, vxy * 0.0225 AS o, (vx * vy - vxy * vxy) * 0.0225 * 0.0225 AS det FROM s)
    SELECT c.mon, ix, iy, round(sum(m * exp(-0.5 * (d * pow(gx - px, 2) - 2 * o * (gx - px) * (gy - py) + a * pow(gy - py, 2)) / det)) / max(n * 2 * pi() * sqrt(det)), 5) AS density
    FROM c JOIN b ON b.mon = c.mon, g GROUP BY 1, 2, 3""",
)
def _(t):
    return O.density_surface(t.observations, "mon", EXTENT, NX, NY).select("mon", "ix", "iy", F.round("density", 5).alias("density"))


@query(
    "a34_species_dimension",
    "observations",
    "SELECT specieskey, arg_min(state, event_id) AS state, arg_min(mon, event_id) AS mon FROM observations GROUP BY 1",
)
def _(t):
    return O.species_dimension(t.observations, "specieskey", "event_id", ["state", "mon"])


def _matches(t):
    k = F.col("specieskey").cast("int")
    return t.observations.select(
        F.concat(F.lit("Sp "), "specieskey").alias("scientific_name"), F.when(k % 5 != 0, F.concat(F.lit("G"), "specieskey")).otherwise("").alias("species_key"),
        F.when(k % 7 == 0, "NONE").otherwise("EXACT").alias("match_status"),
    )


@query(
    "j16_name_match",
    "observations",
    "SELECT event_id, 'G' || specieskey AS species_key FROM observations WHERE CAST(specieskey AS INT) % 5 <> 0 AND CAST(specieskey AS INT) % 7 <> 0",
)
def _(t):
    o = t.observations.select("event_id", F.concat(F.lit("Sp "), "specieskey").alias("scientific_name"))
    return O.match_by_name(o, _matches(t)).select("event_id", "species_key")


@query("j17_semi_join", CLASS_VIEWS, "SELECT event_id, specieskey FROM observations WHERE specieskey IN (SELECT specieskey FROM class_table WHERE migration_class = 'migratory')")
def _(t):
    keep = _classes(t).filter("migration_class = 'migratory'").select("specieskey")
    return t.observations.join(keep, "specieskey", "left_semi").select("event_id", "specieskey")


@query(
    "j18_unprocessed_keys",
    "observations",
    "SELECT DISTINCT specieskey FROM observations WHERE CAST(specieskey AS INT) % 3 <> 0 OR CAST(specieskey AS INT) % 6 = 0",
)
def _(t):
    k = F.col("specieskey").cast("int")
    done = t.observations.filter(k % 3 == 0).select("specieskey", F.when(k % 6 == 0, "failed").otherwise("ok").alias("status")).distinct()
    return O.unprocessed(t.observations, done, "specieskey", "status")


@query(
    "w09_capped_sample",
    "observations",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY specieskey, mon ORDER BY md5(concat_ws(':', '42', CAST(event_id AS VARCHAR))), event_id) AS rn FROM observations)
    SELECT event_id, specieskey, mon, 'first' AS source FROM r WHERE rn <= 20 UNION ALL SELECT event_id, specieskey, mon, 'second' FROM observations WHERE state = 'signup'""",
)
def _(t):
    o = t.observations
    first = O.sample_points(o, "specieskey", "mon", "event_id", 20)
    second = o.filter(F.col("state") == "signup").drop("individualcount")
    return O.add_second_source(first, second, "first", "second").select("event_id", "specieskey", "mon", "source")


@query(
    "w10_centroid_trails",
    NB_VIEWS,
    """WITH a AS (SELECT specieskey, mon, mean_lat, mean_lon, obs_count, true AS h FROM prof UNION ALL SELECT specieskey, mon, mean_lat, mean_lon, obs_count, false FROM nb),
    g AS (SELECT specieskey, mon, sum(mean_lat * obs_count) / sum(obs_count) AS lat, sum(mean_lon * obs_count) / sum(obs_count) AS lon, CAST(sum(obs_count) AS BIGINT) AS obs_count, bool_or(h) AS in_home FROM a GROUP BY 1, 2),
    o AS (SELECT g.*, coalesce((g.mon - arrival_month + 12) % 12, g.mon) AS step, count(*) OVER (PARTITION BY g.specieskey) AS n FROM g JOIN class_table c ON g.specieskey = c.specieskey)
    SELECT specieskey, mon, round(lat, 8) AS lat, round(lon, 8) AS lon, obs_count, in_home, CAST(row_number() OVER w AS INT) AS seq, round(lead(lat) OVER w, 8) AS next_lat, round(lead(lon) OVER w, 8) AS next_lon
    FROM o WHERE n >= 2 WINDOW w AS (PARTITION BY specieskey ORDER BY step)""",
)
def _(t):
    c = _classes(t)
    out = O.centroid_trails(_profiles(t), _neighbours(t, c), c, **NAMES)
    r8 = [F.round(c, 8).alias(c) for c in ("lat", "lon", "next_lat", "next_lon")]
    return out.select("specieskey", "mon", "obs_count", "in_home", "seq", *r8)


@query(
    "r01_streaming_profiles",
    "observations",
    """SELECT specieskey, mon, count(*) AS obs_count, round(sum(lat), 4) AS lat_sum, round(sum(lon), 4) AS lon_sum, CAST(sum(coalesce(individualcount, 1)) AS BIGINT) AS individual_sum FROM observations GROUP BY 1, 2""",
)
def _(t):
    folder = scratch_path(t.spark, "arriving")
    t.observations.repartition(4).write.parquet(folder)
    out = stream_monthly_sums(t.spark, folder, t.observations.schema, ["specieskey", "mon"], **COLS)
    return out.select("specieskey", "mon", "obs_count", F.round("lat_sum", 4).alias("lat_sum"), F.round("lon_sum", 4).alias("lon_sum"), "individual_sum")
