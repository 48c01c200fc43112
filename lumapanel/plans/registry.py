"""Registry of runnable queries over the driver tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.polygons import Grid, polygon_edges, zone_spans
from ..operators.ranking import summarise
from ..session import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WEST, SOUTH, EAST, NORTH = 72.5, 15.5, 81.0, 22.1
GRID = Grid(WEST, NORTH, 0.2125, 0.165)
BOX = {"west": 73.5, "south": 16.5, "east": 79.0, "north": 21.0}
ZONE_INSET = (0.12, 0.1)


def years_of(df: DataFrame) -> list[int]:
    """The years a table holds, in order."""
    return sorted(r["yr"] for r in df.select("yr").distinct().collect())



class Tables:
    """Driver tables and the views the operators run on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def panel(self) -> DataFrame:
        """Order value per nation and year, the entity-year panel of the trend operators."""
        rows = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.select(
            F.col("c_nationkey").cast("long").alias("entity"), F.year("o_orderdate").alias("yr"), "o_totalprice"
        )
        stats = summarise(
            rows,
            ["entity", "yr"],
            "o_totalprice",
            {"median_value": 0.5},
            mean="mean_value",
            low="min_value",
            high="max_value",
            std="std_value",
            count="pixel_count",
        )
        # Written once and read by every branch, like a panel checkpoint.
        return saved(
            stats.select("entity", "yr", "pixel_count", "mean_value", "median_value", "min_value", "max_value", "std_value"),
            "panel",
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """Line items binned to a 40 x 40 grid, one row per (year, cell)."""
        li = self.read("lineitem").select(
            F.year("l_shipdate").alias("yr"),
            (F.col("l_partkey") % 40).cast("int").alias("r"),
            ((F.col("l_orderkey") + F.col("l_suppkey")) % 40).cast("int").alias("c"),
            "l_quantity",
            "l_linenumber",
        )
        px = li.groupBy("yr", "r", "c").agg(
            (F.avg("l_quantity") - 12.0).alias("med"),
            (F.sum("l_linenumber") % 3).cast("int").alias("lit"),
            F.count(F.lit(1)).cast("int").alias("cf"),
        )
        return px.withColumn("lat", GRID.centre_lat(F.col("r"))).withColumn("lon", GRID.centre_lon(F.col("c")))

    @cached_property
    def zones(self) -> DataFrame:
        n = F.col("n_nationkey").cast("double")
        x0, y0 = 72.5 + (F.col("n_nationkey") % 5) * 1.7, 15.5 + F.floor(n / 5) * 1.32
        return self.read("nation").select(
            F.col("n_nationkey").cast("long").alias("zone"),
            x0.alias("x0"),
            (72.5 + (F.col("n_nationkey") % 5 + 1) * 1.7).alias("x1"),
            y0.alias("y0"),
            (15.5 + (F.floor(n / 5) + 1) * 1.32).alias("y1"),
        )

    @cached_property
    def polygons(self) -> DataFrame:
        """Zone boxes drawn a little inside their cells, as rings of vertices."""
        dx, dy = ZONE_INSET
        a, b = F.col("x0") + dx, F.col("x1") - dx
        c, d = F.col("y0") + dy, F.col("y1") - dy
        corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        ring = F.array(corner(a, c), corner(b, c), corner(b, d), corner(a, d), corner(a, c))
        return self.zones.select("zone", F.lit(0).alias("part"), F.lit(0).alias("ring"), ring.alias("vertices"))

    @cached_property
    def spans(self) -> DataFrame:
        # Written so that the join with the pixels knows its size.
        return saved(zone_spans(polygon_edges(self.polygons), GRID), "spans")

    @cached_property
    def zone_pixels(self) -> DataFrame:
        from ..operators.polygons import join_cells

        return join_cells(self.pixels, self.spans)

    @cached_property
    def sites(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(
            k.alias("site_id"),
            k.cast("string").alias("name"),
            (15.8 + ((k * 37) % 600).cast("double") / 100).alias("lat"),
            (73.0 + ((k * 91) % 750).cast("double") / 100).alias("lon"),
        )

    @cached_property
    def cities(self) -> DataFrame:
        k = F.col("n_nationkey").cast("long")
        return self.read("nation").select(
            k.alias("city_id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").cast("int").alias("region"),
            (16.0 + ((k * 53) % 580).cast("double") / 100).alias("lat"),
            (73.1 + ((k * 29) % 740).cast("double") / 100).alias("lon"),
        )

    @cached_property
    def classes(self) -> DataFrame:
        """A coarser land-cover class grid."""
        k = F.col("p_partkey")
        cr, cc = (k % 21).cast("int"), (F.floor(k / 21) % 17).cast("int")
        return (
            self.read("part").select(cr.alias("cr"), cc.alias("cc")).distinct()
            .withColumn("class_id", 1 + (66 - F.col("cr") + F.col("cc") + 145) % 8)
        )

    @cached_property
    def observations(self) -> DataFrame:
        u, e = F.col("user_id") % 60, F.col("event_id")
        return self.read("events").select(
            "event_id",
            u.cast("string").alias("specieskey"),
            (1 + ((u * 5) % 12 + e % (1 + u % 12)) % 12).cast("int").alias("mon"),
            F.col("event_type").alias("state"),
            (16.0 + ((e * 13) % 600).cast("double") / 100).alias("lat"),
            (72.6 + ((e * 17) % 800).cast("double") / 100).alias("lon"),
            F.when(e % 7 != 0, F.floor("value").cast("int")).alias("individualcount"),
        )

    @cached_property
    def census(self) -> DataFrame:
        base = self.read("customer").groupBy("c_nationkey", "c_mktsegment").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("c_custkey") % 50).alias("extra")
        )
        rows = base.withColumn("yr", F.explode(F.array(F.lit(1991), F.lit(2001), F.lit(2011))))
        rows = rows.filter(~((F.col("yr") == 1991) & (F.col("c_nationkey") % 5 == 0)))
        return rows.select(
            "yr",
            F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("district"),
            F.col("c_mktsegment").alias("town"),
            (F.col("n") * (F.col("yr") - 1900)).alias("tot_p"),
            (F.col("n") * (F.col("yr") - 1960)).alias("p_lit"),
            (F.col("n") * 20).alias("no_hh"),
            (F.col("n") * 9 + F.col("extra")).alias("tot_f"),
        )


# The same views for the oracle, written independently in SQL.
VIEWS = {
    "panel": """SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(year(o_orderdate) AS INT) AS yr,
        count(*) AS pixel_count, avg(o_totalprice) AS mean_value, median(o_totalprice) AS median_value,
        min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, stddev_pop(o_totalprice) AS std_value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "pixels": """SELECT CAST(year(l_shipdate) AS INT) AS yr, CAST(l_partkey % 40 AS INT) AS r,
        CAST((l_orderkey + l_suppkey) % 40 AS INT) AS c,
        CAST(22.1 AS DOUBLE) - (CAST(l_partkey % 40 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.165 AS DOUBLE) AS lat,
        CAST(72.5 AS DOUBLE) + (CAST((l_orderkey + l_suppkey) % 40 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.2125 AS DOUBLE) AS lon,
        avg(l_quantity) - CAST(12 AS DOUBLE) AS med, CAST(sum(l_linenumber) % 3 AS INT) AS lit, CAST(count(*) AS INT) AS cf
        FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "zones": """SELECT CAST(n_nationkey AS BIGINT) AS zone,
        CAST(72.5 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(1.7 AS DOUBLE) AS x0,
        CAST(72.5 AS DOUBLE) + CAST(n_nationkey % 5 + 1 AS DOUBLE) * CAST(1.7 AS DOUBLE) AS x1,
        CAST(15.5 AS DOUBLE) + floor(CAST(n_nationkey AS DOUBLE) / 5) * CAST(1.32 AS DOUBLE) AS y0,
        CAST(15.5 AS DOUBLE) + (floor(CAST(n_nationkey AS DOUBLE) / 5) + 1) * CAST(1.32 AS DOUBLE) AS y1 FROM nation""",
    "zone_pixels": """SELECT p.*, z.zone FROM pixels p JOIN zones z
        ON p.lon > z.x0 AND p.lon < z.x1 AND p.lat > z.y0 AND p.lat < z.y1""",
    "sites": """SELECT s_suppkey AS site_id, CAST(s_suppkey AS VARCHAR) AS name,
        CAST(15.8 AS DOUBLE) + CAST((s_suppkey * 37) % 600 AS DOUBLE) / 100 AS lat,
        CAST(73 AS DOUBLE) + CAST((s_suppkey * 91) % 750 AS DOUBLE) / 100 AS lon FROM supplier""",
    "cities": """SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS name, CAST(n_regionkey AS INT) AS region,
        CAST(16 AS DOUBLE) + CAST((n_nationkey * 53) % 580 AS DOUBLE) / 100 AS lat,
        CAST(73.1 AS DOUBLE) + CAST((n_nationkey * 29) % 740 AS DOUBLE) / 100 AS lon FROM nation""",
    "classes": """SELECT DISTINCT CAST(p_partkey % 21 AS INT) AS cr, CAST((p_partkey // 21) % 17 AS INT) AS cc,
        CAST(1 + (66 - p_partkey % 21 + (p_partkey // 21) % 17 + 145) % 8 AS INT) AS class_id FROM part""",
    "class_pixels": """SELECT z.*, k.class_id FROM zone_pixels z JOIN classes k
        ON 66 - CAST(floor(z.lat * 3) AS INT) = k.cr AND CAST(floor(z.lon * 2) AS INT) - 145 = k.cc""",
    "observations": """SELECT event_id, CAST(user_id % 60 AS VARCHAR) AS specieskey,
        CAST(1 + (((user_id % 60) * 5) % 12 + event_id % (1 + (user_id % 60) % 12)) % 12 AS INT) AS mon,
        event_type AS state, CAST(16 AS DOUBLE) + CAST((event_id * 13) % 600 AS DOUBLE) / 100 AS lat,
        CAST(72.6 AS DOUBLE) + CAST((event_id * 17) % 800 AS DOUBLE) / 100 AS lon,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS individualcount FROM events""",
    "census": """SELECT CAST(y.yr AS INT) AS yr, concat('Nation ', CAST(c_nationkey AS VARCHAR)) AS district,
        c_mktsegment AS town, CAST(count(*) * (y.yr - 1900) AS BIGINT) AS tot_p,
        CAST(count(*) * (y.yr - 1960) AS BIGINT) AS p_lit, CAST(count(*) * 20 AS BIGINT) AS no_hh,
        CAST(count(*) * 9 + sum(c_custkey % 50) AS BIGINT) AS tot_f
        FROM customer CROSS JOIN (SELECT 1991 AS yr UNION ALL SELECT 2001 UNION ALL SELECT 2011) y
        WHERE NOT (y.yr = 1991 AND c_nationkey % 5 = 0) GROUP BY y.yr, c_nationkey, c_mktsegment""",
}
NEEDS = {"zone_pixels": ["pixels", "zones"], "class_pixels": ["pixels", "zones", "zone_pixels", "classes"]}


def with_views(views: str, sql: str) -> str:
    """Prefix an oracle query with the named views as CTEs."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS.get(n) or MORE_VIEWS[n]})" for n in names)
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


MORE_VIEWS: dict[str, str] = {}


def add_view(name: str, needs: str, sql: str) -> None:
    """A derived oracle view that later oracles build on."""
    MORE_VIEWS[name] = sql
    full: list[str] = []
    for v in needs.split():
        full += [*NEEDS.get(v, []), v]
    NEEDS[name] = list(dict.fromkeys(full))


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; the function takes :class:`Tables`."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return wrap


def sql_t_p(t: str, dof: str) -> str:
    """Oracle text of the two-sided t p-value, by gamma functions instead of a recurrence."""
    theta = f"atan(abs({t}) / sqrt(CAST({dof} AS DOUBLE)))"
    odd = (
        f"list_sum(list_transform(range(0, CAST(({dof} - 1) // 2 AS BIGINT)), lambda i: "
        f"pow(cos({theta}), 2 * i + 1) * sqrt(pi()) / 2 * exp(lgamma(i + 1.0) - lgamma(i + 1.5))))"
    )
    even = (
        f"list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), lambda i: "
        f"pow(cos({theta}), 2 * i) * exp(lgamma(i + 0.5) - lgamma(i + 1.0)) / sqrt(pi())))"
    )
    return (
        f"CASE WHEN {dof} % 2 = 1 THEN 1 - 2 / pi() * ({theta} + sin({theta}) * coalesce({odd}, 0)) "
        f"ELSE 1 - sin({theta}) * {even} END"
    )
