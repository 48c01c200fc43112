"""Census scans, dataset descriptors and their loading."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import number
from ..functions.names import district_name, title_case
from ..functions.scalars import add_census_ratios, prefix_columns
from ..operators.checks import dataset_messages
from ..operators.linkage import apply_resolution, resolve_names

# The twelve common counts and the 1991 columns they come from.
METRICS = ["No_HH", "TOT_P", "TOT_M", "TOT_F", "P_06", "P_SC", "P_ST", "P_LIT", "TOT_WORK_P", "MAINWORK_P", "MARGWORK_P", "NON_WORK_P"]
SUMS_1991 = {
    "P_06": ("POPLN_M6", "POPLN_F6"),
    "P_SC": ("M_SC", "F_SC"),
    "P_ST": ("M_ST", "F_ST"),
    "P_LIT": ("M_LITERATE", "F_LITERATE"),
    "TOT_WORK_P": ("T_M_WORKER", "T_F_WORKER"),
    "MARGWORK_P": ("M_MARGINAL", "F_MARGINAL"),
    "NON_WORK_P": ("M_NON_WORK", "F_NON_WORK"),
}
RENAMES_1991 = {"HOUSEHOLDS": "No_HH", "T_POPLN": "TOT_P", "T_M_POPLN": "TOT_M", "T_F_POPLN": "TOT_F"}
NAME_COLUMNS = ["Name", "name", "DISTRICT_NAME", "District_Name", "District"]


@dataclass(frozen=True)
class Dataset:
    """What a dataset is; it drives join keys and column prefixes."""

    name: str
    label: str
    temporal: str = "snapshot"
    level: str = "district"


# Known datasets and the alias naming all of them.
DATASETS = [
    Dataset("census_1991", "c1991"),
    Dataset("census_1991_towns", "c1991t", level="town"),
    Dataset("census_2001", "c2001"),
    Dataset("census_2001_towns", "c2001t", level="town"),
    Dataset("census_2011", "c2011"),
    Dataset("census_2011_towns", "c2011t", level="town"),
    Dataset("census_projected", "cproj", "timeseries"),
    Dataset("census_towns_projected", "ctproj", "timeseries", "town"),
]
GROUPS = {"census": [d.name for d in DATASETS]}


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def _numbers(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return df.withColumns({m: number(m) for m in metrics if m in df.columns})


def district_census(spark: SparkSession, path: str, entity: str = "district", metrics=METRICS) -> DataFrame:
    """One census year's district table; a missing name column falls back to older spellings."""
    df = _csv(spark, path)
    have = {c.lower(): c for c in df.columns}
    if entity.lower() not in have:
        old = next((have[c.lower()] for c in NAME_COLUMNS if c.lower() in have), None)
        if old is None:
            raise ValueError(f"no name column among {df.columns}")
        df = df.withColumnRenamed(old, entity)
    keep = [m for m in metrics if m in df.columns]
    return _numbers(df.select(entity, *keep), metrics)


def town_census(spark: SparkSession, path: str, metrics=METRICS) -> DataFrame:
    """The town table: name and code of the town, no level columns."""
    df = _csv(spark, path)
    keep = [m for m in metrics if m in df.columns]
    return _numbers(
        df.select("district", F.col("entity_name").alias("town_name"), F.col("entity_code").alias("town_code"), *keep), metrics
    )


def hierarchy(spark: SparkSession, path: str, metrics=METRICS, villages: bool = False, level="LEVEL", tru="TRU", name="NAME", code="TOWN_VILL"):
    """Per-district files to district (Total, Urban, Rural), town and village rows.

    The district code is the last number of the file name. Each file's district
    name comes from its own district row.
    """
    raw = _csv(spark, path).withColumn("district_code", F.regexp_extract("_metadata.file_name", r"_(\d+)\.[^.]*$", 1))
    lev = F.col(level)
    keep = ["DISTRICT", "TOWN", *(["VILLAGE"] if villages else [])]
    rows = _numbers(raw.filter(lev.isin(keep)), metrics)
    rows = rows.filter((lev != "DISTRICT") | F.col(tru).isin("Total", "Urban", "Rural"))
    own = raw.filter(lev == "DISTRICT").groupBy("district_code").agg(F.min(district_name(name)).alias("district"))
    rows = rows.join(own, "district_code")
    place: Column = title_case(F.trim(F.col(name), F.lit("* ")))
    return rows.select(
        "district",
        "district_code",
        lev.alias("level"),
        F.when(lev == "DISTRICT", F.col(tru)).when(lev == "TOWN", "Urban").otherwise("Rural").alias("tru"),
        F.when(lev == "DISTRICT", F.col("district")).otherwise(place).alias("entity_name"),
        F.when(lev == "DISTRICT", "").otherwise(F.trim(F.coalesce(code, F.lit("")))).alias("entity_code"),
        *[m for m in metrics if m in raw.columns],
    )


def registry_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The known datasets (dataset, label) and the group aliases (alias, dataset)."""
    known = spark.createDataFrame([(d.name, d.label) for d in DATASETS], "dataset string, label string")
    groups = spark.createDataFrame([(g, n) for g, names in GROUPS.items() for n in names], "alias string, dataset string")
    return known, groups


def select_datasets(asked: DataFrame, known: DataFrame, groups: DataFrame, name: str = "name") -> DataFrame:
    """Known datasets among the asked names after expanding group aliases, sorted.

    The name ``all`` selects every known dataset; unknown names are dropped.
    """
    names = asked.select(F.trim(F.col(name)).alias("_asked")).distinct()
    wider = names.join(groups, F.col("_asked") == F.col("alias"), "left")
    wanted = wider.select(F.coalesce("dataset", "_asked").alias("_want")).distinct()
    if not names.filter(F.col("_asked") == "all").isEmpty():
        return known.orderBy("dataset")
    return known.join(wanted, F.col("_want") == F.col("dataset"), "left_semi").orderBy("dataset")


def dataset_suffix(selected: DataFrame) -> DataFrame:
    """File suffix naming the active datasets, '' for none."""
    labels = F.array_sort(F.collect_set("label"))
    return selected.agg(F.when(F.size(labels) > 0, F.concat(F.lit("_x_"), F.array_join(labels, "_"))).otherwise("").alias("suffix"))


def load_dataset(table: DataFrame, meta: Dataset, known: DataFrame | None, entity: str = "district", known_name: str = "district"):
    """Ratios, resolved names and prefixed columns of one dataset, and its warnings."""
    df = add_census_ratios(table)
    if known is not None:
        df = apply_resolution(df, resolve_names(df, known, entity, known_name), entity)
    keep = [entity] + (["year"] if meta.temporal == "timeseries" else [])
    df = prefix_columns(df, meta.label, keep)
    return df, dataset_messages(df, meta.label, entity, meta.level, meta.temporal)


def load_all(tables: dict[str, DataFrame], known: DataFrame | None, registry: Sequence[Dataset] = DATASETS, entity="district"):
    """Every dataset that can be planned; the others are reported with their error."""
    loaded, failed = {}, {}
    for meta in registry:
        if meta.name in tables:
            try:
                loaded[meta.name] = load_dataset(tables[meta.name], meta, known, entity)
            except (AnalysisException, KeyError, ValueError) as e:  # one broken table must not stop the others
                failed[meta.name] = str(e)
    return loaded, failed
