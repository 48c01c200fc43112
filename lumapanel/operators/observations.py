"""Monthly species profiles, migration classes, corridors and density surfaces."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .ranking import top_k

# Observation limits, months, seasons and red-list codes.
MIN_OBS = 5
RESIDENT_MONTHS, MIGRATORY_MONTHS = 10, 3
COAST_LON = 73.5
SEASONS = {
    "post_nuptial": (9, 10, 11),
    "pre_nuptial": (12, 1, 2, 3, 4, 5),
    "breeding": (6, 7, 8),
}
RED_LIST = ("CR", "EN", "VU", "NT", "LC", "DD", "NE")
CLASSES = ("resident", "migratory", "passage")
KDE_FACTOR = 0.15
KDE_MIN_POINTS = 10


def monthly_sums(obs: DataFrame, keys: Sequence[str], lat="lat", lon="lon", individuals="individuals") -> DataFrame:
    """Counts and sums per group; a missing individual count is one bird."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    return obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("obs_count"),
        F.sum(la).alias("lat_sum"),
        F.sum(lo).alias("lon_sum"),
        F.sum(F.coalesce(F.col(individuals).cast("long"), F.lit(1))).alias("individual_sum"),
        F.sum(la * la).alias("lat_sq_sum"),
        F.sum(lo * lo).alias("lon_sq_sum"),
    )


def _means(sums: DataFrame) -> DataFrame:
    n = F.col("obs_count")
    return sums.withColumns({"mean_lat": F.col("lat_sum") / n, "mean_lon": F.col("lon_sum") / n})


def monthly_profiles(obs: DataFrame, species="species_key", month="month", min_obs: int = MIN_OBS, **cols) -> DataFrame:
    """Profile per (species, month) with its share of the month's effort.

    Effort is the sum of the species counts, so the rows are scanned once.
    """
    sums = _means(monthly_sums(obs, [species, month], **cols))
    effort = sums.groupBy(month).agg(F.sum("obs_count").alias("_effort"))
    out = sums.join(effort, month).filter(F.col("obs_count") >= min_obs)
    return out.select(
        species, month, "obs_count", (F.col("obs_count") / F.col("_effort")).alias("norm_frequency"), "mean_lat", "mean_lon",
        "individual_sum", "lat_sq_sum", "lon_sq_sum",
    )


def neighbour_profiles(obs, keep: DataFrame, species="species_key", state="state", month="month", min_obs=MIN_OBS, **cols) -> DataFrame:
    """The same per neighbouring state for the given species only."""
    mine = obs.join(keep.select(species).distinct(), species, "left_semi")
    out = _means(monthly_sums(mine, [species, state, month], **cols)).filter(F.col("obs_count") >= min_obs)
    return out.select(species, state, month, "obs_count", "mean_lat", "mean_lon", "individual_sum")


def classify_species(profiles: DataFrame, species="species_key", month="month", coast_lon: float = COAST_LON) -> DataFrame:
    """Class, seasonality, centroid shift and arrival/departure months per species.

    A species has at most twelve rows, so its window and group are short.
    """
    along = Window.partitionBy(species).orderBy(month)
    rows = profiles.withColumn("_next", F.lead(month).over(along)).withColumn("_gap", F.col("_next") - F.col(month))
    # The largest gap, the earliest one on ties.
    widest = F.max(F.when(F.col("_gap").isNotNull(), F.struct(F.col("_gap").alias("gap"), (-F.col(month)).alias("at"), F.col("_next").alias("to"))))
    g = rows.groupBy(species).agg(
        F.count(F.lit(1)).cast("int").alias("months_present"),
        F.try_divide(F.stddev_pop("norm_frequency"), F.avg("norm_frequency")).alias("_cv"),
        (F.max("mean_lat") - F.min("mean_lat")).alias("_la"),
        (F.max("mean_lon") - F.min("mean_lon")).alias("_lo"),
        F.max_by(month, F.struct(F.col("obs_count"), -F.col(month))).alias("peak_month"),
        F.min(month).alias("_first"),
        F.max(month).alias("_last"),
        widest.alias("_w"),
        F.avg("mean_lon").alias("_lon"),
    )
    n = F.col("months_present")
    kind = F.when(n >= RESIDENT_MONTHS, "resident").when(n >= MIGRATORY_MONTHS, "migratory").otherwise("passage")
    moves = n < RESIDENT_MONTHS
    wraps = F.coalesce(F.col("_w.gap") > 3, F.lit(False))
    return g.select(
        species,
        "months_present",
        F.round(F.coalesce("_cv", F.lit(0.0)), 4).alias("seasonality_cv"),
        F.round(F.sqrt(F.col("_la") * F.col("_la") + F.col("_lo") * F.col("_lo")), 4).alias("centroid_shift_deg"),
        "peak_month",
        kind.alias("migration_class"),
        F.when(moves, F.when(wraps, F.col("_w.to")).otherwise(F.col("_first"))).alias("arrival_month"),
        F.when(moves, F.when(wraps, -F.col("_w.at")).otherwise(F.col("_last"))).alias("departure_month"),
        (F.col("_lon") < coast_lon).alias("is_coastal"),
    )


def enrich(classes: DataFrame, red_list: DataFrame, species="species_key", code="iucn_code", category="iucn_category") -> DataFrame:
    """Red-list code and category; unknown species are not evaluated."""
    out = classes.join(red_list.select(species, code, category), species, "left")
    return out.withColumns({code: F.coalesce(code, F.lit("NE")), category: F.coalesce(category, F.lit("NOT_EVALUATED"))})


def corridor_species(classes, neighbours, directions: Mapping[str, str], species="species_key", state="state", month="month") -> DataFrame:
    """Per direction and species: observations and whether it enters or leaves that way.

    Entry: seen there one to three months before arrival; exit: one to three
    months after departure, both modulo the year.
    """
    pairs = [F.lit(x) for kv in directions.items() for x in kv]
    there = neighbours.withColumn("direction", F.element_at(F.create_map(*pairs), F.col(state))).filter(F.col("direction").isNotNull())
    timed = classes.filter(F.col("arrival_month").isNotNull() & F.col("departure_month").isNotNull())
    j = there.join(timed.select(species, "arrival_month", "departure_month"), species)
    lead = F.pmod(F.col("arrival_month") - F.col(month), F.lit(12))
    lag = F.pmod(F.col(month) - F.col("departure_month"), F.lit(12))
    return j.groupBy("direction", species).agg(
        F.sum("obs_count").alias("obs"), F.max(lead.between(1, 3)).alias("entry"), F.max(lag.between(1, 3)).alias("exit")
    )


def corridors(per_species: DataFrame, directions: Mapping[str, str], species="species_key") -> DataFrame:
    """One row per direction: entry and exit species with their counts, and all observations.

    The lists hold one short entry per species, bounded by the number of species.
    """
    item = F.struct((-F.col("obs")).alias("k"), F.col(species).alias("s"))
    listed = lambda flag: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), item))), lambda x: F.concat(x["s"], F.lit(":"), (-x["k"]).cast("string"))), ","
    )
    got = per_species.groupBy("direction").agg(
        F.count_if("entry").alias("n_entry"), F.count_if("exit").alias("n_exit"), F.sum("obs").alias("total_obs"),
        listed("entry").alias("entry_species"), listed("exit").alias("exit_species"),
    )
    base = per_species.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in directions.values()])).alias("direction"))
    return base.join(got, "direction", "left").na.fill({"n_entry": 0, "n_exit": 0, "total_obs": 0, "entry_species": "", "exit_species": ""})


def corridor_leaders(per_species: DataFrame, flag: str, k: int = 3, species="species_key") -> DataFrame:
    return top_k(per_species.filter(F.col(flag)), k, [F.desc("obs"), F.col(species)], ["direction"]).select("direction", species, "obs")


def season_of(month: Column) -> Column:
    out = None
    for name, months in SEASONS.items():
        out = F.when(month.isin(list(months)), name) if out is None else out.when(month.isin(list(months)), name)
    return out


def seasonal_summary(classes: DataFrame, code="iucn_code") -> DataFrame:
    """Counts of moving species by code and month of arrival and departure, and class counts.

    Long rows (panel, label, n); codes and months without species are there with 0.
    """
    moving = F.col("migration_class").isin("migratory", "passage")
    facts = F.array(
        F.struct(F.lit("code").alias("panel"), F.when(moving, F.col(code)).alias("label")),
        F.struct(F.lit("arrival").alias("panel"), F.when(moving, F.col("arrival_month").cast("string")).alias("label")),
        F.struct(F.lit("departure").alias("panel"), F.when(moving, F.col("departure_month").cast("string")).alias("label")),
        F.struct(F.lit("class").alias("panel"), F.col("migration_class").alias("label")),
    )
    counts = classes.select(F.inline(facts)).filter(F.col("label").isNotNull()).groupBy("panel", "label").agg(F.count(F.lit(1)).alias("n"))
    months = [str(m) for m in range(1, 13)]
    want = [("code", c) for c in RED_LIST] + [(p, m) for p in ("arrival", "departure") for m in months] + [("class", c) for c in CLASSES]
    spine = classes.sparkSession.createDataFrame(want, "panel string, label string")
    return spine.join(counts, ["panel", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def density_surface(
    obs: DataFrame, group: str, box: Mapping[str, float], nx: int, ny: int, lat="lat", lon="lon",
    factor: float = KDE_FACTOR, min_points: int = KDE_MIN_POINTS,
) -> DataFrame:
    """Gaussian kernel density on a grid over the box, per group.

    The bandwidth is ``factor`` times the full covariance of the group. Equal
    points are counted first; then every task adds up the kernels of its points
    in an array the size of the grid, and only those partial sums are shuffled.
    Points without a position take no part. Groups with too few points are left
    out; a singular covariance gives NULL densities.
    """
    placed = obs.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(group).isNotNull())
    stats = placed.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.var_samp(lon).alias("_vx"), F.var_samp(lat).alias("_vy"), F.covar_samp(lon, lat).alias("_vxy")
    ).filter(F.col("_n") >= min_points)
    det = (F.col("_vx") * F.col("_vy") - F.col("_vxy") * F.col("_vxy")) * factor**4
    stats = saved(stats.withColumn("_det", F.when(det > 1e-18, det)), "kernels")
    points = placed.groupBy(group, F.col(lon).cast("double").alias("_px"), F.col(lat).cast("double").alias("_py")).agg(F.count(F.lit(1)).alias("_m"))
    rows = points.join(stats.filter(F.col("_det").isNotNull()), group)
    gx = np.tile(np.linspace(box["west"], box["east"], nx), ny)
    gy = np.repeat(np.linspace(box["south"], box["north"], ny), nx)
    block = max(1, (1 << 20) // (nx * ny))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(nx * ny)

        def part() -> pa.RecordBatch:
            cells = np.flatnonzero(total)
            return pa.RecordBatch.from_pydict({group: pa.array([key] * len(cells), kind), "_cell": cells, "_part": total[cells]})

        for batch in batches:
            kind, keys = batch[group].type, batch[group].to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if key is not None and keys[low] != key:
                    yield part()
                    total[:] = 0.0
                key = keys[low]
                x, y, m, vx, vy, vxy, d = (
                    batch[c].to_numpy()[low:high] for c in ("_px", "_py", "_m", "_vx", "_vy", "_vxy", "_det")
                )
                a, b, c = vy[0] * factor**2 / d[0], vxy[0] * factor**2 / d[0], vx[0] * factor**2 / d[0]
                for i in range(0, len(x), block):
                    ex, ey = gx[None, :] - x[i : i + block, None], gy[None, :] - y[i : i + block, None]
                    total += m[i : i + block] @ np.exp(-0.5 * (a * ex * ex - 2.0 * b * ex * ey + c * ey * ey))
        if key is not None:
            yield part()

    kind = obs.schema[group].dataType.simpleString()
    sums = rows.select(group, "_px", "_py", "_m", "_vx", "_vy", "_vxy", "_det").sortWithinPartitions(group)
    sums = sums.mapInArrow(add, f"`{group}` {kind}, _cell long, _part double").groupBy(group, "_cell").agg(F.sum("_part").alias("_sum"))
    grid = stats.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn(
        "iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))
    )
    grid = grid.withColumn("_cell", (F.col("iy") * nx + F.col("ix")).cast("long"))
    density = F.coalesce("_sum", F.lit(0.0)) / (F.col("_n") * 2.0 * math.pi * F.sqrt("_det"))
    return grid.join(sums, [group, "_cell"], "left").select(group, "ix", "iy", density.alias("density"))


def sample_points(obs, species, month, key, cap: int, seed=42, lat="lat", lon="lon") -> DataFrame:
    """At most ``cap`` points per (species, month), picked by a seeded hash of the row key."""
    pick = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = obs.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(month).isNotNull())
    return top_k(rows, cap, [pick, F.col(key)], [species, month])


def add_second_source(sampled: DataFrame, second: DataFrame, first_tag: str, second_tag: str) -> DataFrame:
    a, b = sampled.withColumn("source", F.lit(first_tag)), second.withColumn("source", F.lit(second_tag))
    return a.unionByName(b, allowMissingColumns=True)


def match_by_name(obs: DataFrame, matches: DataFrame, name="scientific_name", key="species_key", status="match_status") -> DataFrame:
    """Observations whose name has a successful match, with the matched key."""
    good = matches.filter(F.col(key).isNotNull() & (F.col(key) != "") & (F.col(status) != "NONE")).select(name, key).distinct()
    return obs.join(good, name)


def unprocessed(names: DataFrame, done: DataFrame, key: str, status: str | None = None, failed: str = "failed") -> DataFrame:
    """Keys without a result yet; failed ones are tried again."""
    ok = done.filter(F.coalesce(F.col(status), F.lit("")) != failed) if status else done
    return names.select(key).distinct().join(ok, key, "left_anti")


def centroid_trails(
    home: DataFrame, neighbours: DataFrame, classes: DataFrame, species="species_key", month="month", state="state"
) -> DataFrame:
    """Monthly weighted centroid per species over all regions, in order from arrival, with the next one."""
    cols = [species, month, "mean_lat", "mean_lon", "obs_count"]
    rows = home.select(*cols, F.lit(True).alias("_home")).unionByName(neighbours.select(*cols, F.lit(False).alias("_home")))
    n = F.col("obs_count")
    mid = rows.groupBy(species, month).agg(
        (F.sum(F.col("mean_lat") * n) / F.sum(n)).alias("lat"),
        (F.sum(F.col("mean_lon") * n) / F.sum(n)).alias("lon"),
        F.sum(n).alias("obs_count"),
        F.max("_home").alias("in_home"),
    )
    j = mid.join(classes.select(species, "arrival_month"), species)
    step = F.coalesce(F.pmod(F.col(month) - F.col("arrival_month"), F.lit(12)), F.col(month))
    along = Window.partitionBy(species).orderBy("_step")
    whole = Window.partitionBy(species)
    out = j.withColumn("_step", step).withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= 2)
    return out.select(
        species, month, "lat", "lon", "obs_count", "in_home",
        F.row_number().over(along).alias("seq"), F.lead("lat").over(along).alias("next_lat"), F.lead("lon").over(along).alias("next_lon"),
    )


def species_dimension(obs: DataFrame, species: str, order: str, attributes: Sequence[str]) -> DataFrame:
    """First row per species by an explicit order; rows without a key are skipped."""
    known = obs.filter(F.col(species).isNotNull() & (F.col(species) != ""))
    return known.groupBy(species).agg(F.min_by(F.struct(*attributes), order).alias("a")).select(species, "a.*")
