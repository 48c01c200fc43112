"""Data-quality expectations, dataset checks, completeness and stale outputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, scratch_path
from ..sources.files import BLOCK_BYTES, blocks, listed, located, pieces


@dataclass(frozen=True)
class Rule:
    """What a column must satisfy; bounds are inclusive, ``above`` is exclusive."""

    column: str
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    above: float | None = None
    allowed: Sequence[Any] | None = None


# The five table schemas.
YEARLY = [Rule("district", False), Rule("year", False, 2012, 2050), Rule("mean_radiance", False, 0.0, 500.0),
          Rule("median_radiance", False, 0.0, 500.0), Rule("pixel_count", False, above=0)]
TRENDS = [Rule("district", False), Rule("annual_pct_change", True, -50.0, 100.0), Rule("r_squared", True, 0.0, 1.0)]
SITE_YEARLY = [Rule("name", False), Rule("year", False, 2012, 2050), Rule("median_radiance", False, 0.0, 500.0),
               Rule("type", False, allowed=("city", "site"))]
SITE_TRENDS = [Rule("name", False), Rule("annual_pct_change", True, -50.0, 100.0), Rule("type", False, allowed=("city", "site"))]
STABILITY = [Rule("district", False), Rule("coefficient_of_variation", True, low=0.0)]


def _tests(rule: Rule) -> list[tuple[str, Column]]:
    """(check name, condition that marks a failing row)."""
    c = F.col(rule.column)
    out = [] if rule.nullable else [("not_null", c.isNull())]
    if rule.low is not None and rule.high is not None:
        out.append((f"in_range({rule.low}, {rule.high})", ~c.between(rule.low, rule.high)))
    elif rule.low is not None:
        out.append((f"at_least({rule.low})", c < rule.low))
    if rule.above is not None:
        out.append((f"greater_than({rule.above})", c <= rule.above))
    if rule.allowed is not None:
        out.append((f"isin({', '.join(map(str, rule.allowed))})", ~c.isin(list(rule.allowed))))
    return out


def check_schema(df: DataFrame | None, rules: Sequence[Rule], step: str, spark: SparkSession | None = None) -> DataFrame:
    """All failing (step, column, check, value) rows from one pass over the table.

    A missing table, an empty table and a missing column are failures too.
    """
    if df is None:
        return spark.createDataFrame([(step, None, "table is missing", None)], "step string, column string, check string, value string")
    spark = df.sparkSession
    have = [r for r in rules if r.column in df.columns]
    absent = [(step, r.column, "column is missing", None) for r in rules if r.column not in df.columns]
    schema = "step string, column string, check string, value string"
    tests = [
        F.when(
            F.coalesce(bad, F.lit(False)),
            F.struct(F.lit(r.column).alias("column"), F.lit(name).alias("check"), F.col(r.column).cast("string").alias("value")),
        )
        for r in have
        for name, bad in _tests(r)
    ]
    found = df.select(F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("f")).select(F.lit(step).alias("step"), "f.*")
    empty = df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(step).alias("step"), F.lit(None).cast("string").alias("column"), F.lit("table is empty").alias("check"), F.lit(None).cast("string").alias("value")
    )
    out = found.unionByName(empty)
    return out.unionByName(spark.createDataFrame(absent, schema)) if absent else out


def require_schema(df: DataFrame, rules: Sequence[Rule], step: str) -> DataFrame:
    """The strict form: hand the table on, or write all failures down and raise with their number and place."""
    path = scratch_path(df.sparkSession, "schema-failures")
    check_schema(df, rules, step).write.parquet(path)
    bad = df.sparkSession.read.parquet(path)
    if n := bad.count():
        kinds = bad.groupBy("column", "check").count().orderBy("column", "check").collect()
        raise ValueError(f"[{step}] {n} schema violations, all in {path}: {[tuple(r) for r in kinds]}")
    return df


def dataset_messages(
    df: DataFrame, label: str, entity: str = "district", level: str = "district", temporal: str = "snapshot",
    min_entities: int = 20, min_towns: int = 50, year: str = "year",
) -> DataFrame:
    """Warnings about a loaded dataset, one row per message."""
    spark = df.sparkSession
    fixed = []
    if entity not in df.columns:
        return spark.createDataFrame([(f"Missing entity column '{entity}'",)], "message string")
    metrics = [c for c in df.columns if c.startswith(f"{label}_")]
    if level == "town":
        if f"{label}_town_name" not in df.columns:
            fixed.append(F.lit(f"Missing town name column '{label}_town_name'"))
    elif len(metrics) < 5:
        fixed.append(F.lit(f"Only {len(metrics)} metric columns (expected >= 5)"))
    if temporal == "timeseries" and year not in df.columns:
        fixed.append(F.lit("Missing 'year' column for timeseries dataset"))
    n = F.count(F.lit(1))
    aggs = [n.alias("_rows"), F.count_distinct(entity).alias("_entities")]
    aggs += [(F.count_if(F.col(c).isNull()) / n * 100.0).alias(f"_p{i}") for i, c in enumerate(metrics)]
    one = df.agg(*aggs)
    if level == "town":
        live = [F.when(F.col("_rows") < min_towns, F.format_string("Only %d towns (expected >= %d)", "_rows", F.lit(min_towns)))]
    else:
        live = [F.when(F.col("_entities") < min_entities, F.format_string("Only %d districts (expected >= %d)", "_entities", F.lit(min_entities)))]
        live += [
            F.when(F.col(f"_p{i}") > 20, F.format_string(f"Column '{c}' has %.1f%% NULL values", F.col(f"_p{i}")))
            for i, c in enumerate(metrics)
        ]
    return one.select(F.explode(F.filter(F.array(*fixed, *live), lambda m: m.isNotNull())).alias("message"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def not_allowed(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed set, with their number of rows."""
    return df.filter(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def _block_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path, start, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "size")), strict=True):
            fs, name = located(path)
            digest = hashlib.sha256()
            with fs.open_input_file(name) as file:
                for piece in pieces(file, start, size):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"path": batch["path"], "block": batch["block"], "leaf": pa.array(found, pa.string())})


def file_states(spark: SparkSession, path: str, known: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Path, length, modification time and content hash of every file below a folder that isn't empty.

    The hash is a tree of two levels: SHA-256 over the SHA-256 of the blocks and
    the length. Blocks are ranges read by separate tasks, so a file may have any
    size. A file whose length and time are those in ``known`` (path, length,
    mtime, hash; all of the same ``block_bytes``) keeps its hash and isn't read.
    """
    files = saved(listed(spark, path), "files")
    if known is not None:
        old = known.select("path", "length", "mtime", F.col("hash").alias("_hash")).dropDuplicates(["path"])
        files = saved(files.join(old, ["path", "length", "mtime"], "left"), "files")
        unread = files.filter("_hash IS NULL")
    else:
        unread = files
    leaves = blocks(unread.select("path", "length"), block_bytes)[0].mapInArrow(_block_hashes, "path string, block long, leaf string")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "leaf"))), lambda b: b["leaf"])
    roots = leaves.groupBy("path").agg(F.array_join(in_order, "").alias("_leaves"))
    read = unread.join(roots, "path").withColumn("hash", F.sha2(F.concat_ws(":", "_leaves", "length"), 256))
    out = read.select("path", "length", "mtime", "hash")
    if known is not None:
        out = out.unionByName(files.filter("_hash IS NOT NULL").select("path", "length", "mtime", F.col("_hash").alias("hash")))
    return out


def stale_outputs(manifest: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs to rebuild and why.

    ``manifest`` (output, path, hash, mtime) lists what each output was built
    from, ``inputs`` (output, path, hash, mtime) what it would be built from
    now, ``outputs`` (output, present) which ones exist.
    """
    old = manifest.select("output", "path", F.col("hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    now = inputs.select("output", "path", F.col("hash").alias("new_hash"), F.col("mtime").alias("new_mtime"))
    both = now.join(old, ["output", "path"], "left")
    known = manifest.select("output").distinct().withColumn("known", F.lit(True))
    reason = (
        F.when(F.col("old_hash").isNull(), "new input")
        .when((F.col("new_mtime") > F.col("old_mtime")) & (F.col("new_hash") != F.col("old_hash")), "changed input")
    )
    changed = both.withColumn("r", reason).groupBy("output").agg(F.min("r").alias("input_reason"))
    out = outputs.join(known, "output", "left").join(changed, "output", "left")
    why = (
        F.when(~F.col("present"), "output missing")
        .when(F.col("known").isNull(), "not registered")
        .otherwise(F.col("input_reason"))
    )
    return out.select("output", why.alias("reason")).filter(F.col("reason").isNotNull())
