"""The corpus pipeline: from raw documents to sharded training rows.

Every stage takes all rows its predecessor kept, written as Parquet and read
again, and its decisions take effect. All columns of ``documents`` are kept, also
unknown ones; rows repeat only where the mix takes a document twice. Nulls: a
null text is empty (never toxic, a duplicate or contaminated, and of size 0), a
null source is a source of its own, a null doc_id is shard key 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumapanel.llm import chosen_path, decontamination, mixing, sharding, toxicity
from lumapanel.session import saved

SHARDS = 24


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it (names aren't case-sensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine, fitted on the labelled ones, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(toxicity.train(docs, labels), spark)
    return docs.filter(score("text") < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the first row."""
    row = _free(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    classes = chosen_path.near_duplicates(rows.select(F.col(row).alias("uid"), "text"))
    later = saved(classes.filter(F.col("uid") != F.col("root")).select(F.col("uid").alias(row)), "later-copies")
    return rows.join(later, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times."""
    row, times = _free(docs, "_row"), _free(docs, "_times")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    sized = rows.select("source", mixing.word_count(F.col("text")).alias("size"), "doc_id", F.col(row).alias("row"))
    taken = mixing.mix_sources(sized).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    # The same join at every size: the copies are as many as the documents.
    repeated = rows.join(saved(taken, "taken").hint("merge"), row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the row's shard, its slot there, and its shard if there were one more."""
    row = _free(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    keys = rows.select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.col(row).alias("row"))
    placed = sharding.shard_rows(keys, "doc_id", ["text_crc32", "row"], SHARDS)
    found = [F.col(c).alias(_free(docs, c)) for c in ("shard", "slot", "grown_shard")]
    return rows.join(placed.select(F.col("row").alias(row), *found).hint("merge"), row).drop(row)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# The classifier, the join's classes and the alignment can't be put in SQL; tests/llm has brute force for them.
ORACLE_SQL = None
