import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumapanel.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group with a third of the rows, a hot value in it, negatives, NULLs and small groups."""
    rng = np.random.default_rng(1)
    n = 6000
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    v = np.round(rng.lognormal(0, 2, n) * rng.choice([-1, 1], n), 3)
    v[rng.random(n) < 0.3] = 1.5
    pdf = pd.DataFrame({"g": g, "v": v, "k": np.arange(n)})
    pdf["v"] = pdf["v"].where(rng.random(n) > 0.05)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df, pdf


def test_summary_equals_pandas(skewed):
    df, pdf = skewed
    got = R.summarise(df, ["g"], "v", {"p10": 0.1, "med": 0.5, "p99": 0.99}, "mean", "lo", "hi", "sd", "n").toPandas()
    got = got.set_index("g").sort_index()
    want = pdf.groupby("g")["v"]
    for name, series in {
        "p10": want.quantile(0.1), "med": want.median(), "p99": want.quantile(0.99), "mean": want.mean(),
        "lo": want.min(), "hi": want.max(), "sd": want.std(ddof=0), "n": want.count(),
    }.items():
        np.testing.assert_allclose(got[name].values, series.values, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("per_e", [1, 1024])
def test_ranks_do_not_depend_on_buckets(skewed, per_e):
    df, pdf = skewed
    pos = R.positions(df, ["g"], "v", per_e)
    got = df.join(pos, ["g", "v"]).withColumn("r", R.average_rank()).toPandas().set_index("k")["r"].sort_index()
    want = pdf.dropna().groupby("g")["v"].rank()
    assert (got == want.loc[got.index]).all() and len(got) == len(want)


@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_with_ties_and_nulls(skewed, descending):
    df, pdf = skewed
    got = R.row_numbers(df, "v", "k", "rn", descending=descending).toPandas().sort_values("rn")
    want = pdf.sort_values(["v", "k"], ascending=[not descending, True], na_position="last")
    assert list(got["rn"]) == list(range(1, len(pdf) + 1))
    assert list(got["k"]) == list(want["k"])


def test_row_numbers_per_group_with_text_tie(spark):
    rows = [("a", 1.0, "é"), ("a", 1.0, "z"), ("a", 1.0, "b"), ("b", 2.0, "x"), ("b", 1.0, "y")]
    df = spark.createDataFrame(rows, "g string, v double, t string")
    got = {(r.g, r.t): r.rn for r in R.row_numbers(df, "v", "t", "rn", ["g"]).collect()}
    assert got == {("a", "b"): 1, ("a", "z"): 2, ("a", "é"): 3, ("b", "y"): 1, ("b", "x"): 2}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = R.top_k(df, 3, [F.desc("id")], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_empty_input(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert R.summarise(df, ["g"], "v", {"m": 0.5}).count() == 0


def test_close_values_are_spread_over_tasks(spark):
    """Ids, times and names that lie close together are numbered in many tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for make in (lambda i: i + 10**9, lambda i: F.concat(F.lit("Customer#"), F.lpad(i.cast("string"), 9, "0"))):
            df = spark.range(20_000).select(make(F.col("id")).alias("v"), F.col("id").alias("t"))
            out = R.row_numbers(df, "v", "t", "rn")
            assert out.filter(F.col("rn") != F.col("t") + 1).count() == 0
            sizes = [len(p) for p in R.numbered(df, [], ["v", "t"], "k").rdd.glom().collect()]
            assert max(sizes) < 12_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
