"""Correlations and regressions across joined tables."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException, UnsupportedOperationException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.student_t import corr_p
from ..session import saved
from .ranking import attach_positions, average_rank, summarise, top_k

R_CLAMP = 0.9999999


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def _pairs(x: Column, y: Column) -> Column:
    return F.count_if(x.isNotNull() & y.isNotNull())


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """r, p, n and the Fisher-z 95% interval per group."""
    got = df.groupBy(*keys).agg(safe_corr(F.col(x), F.col(y)).alias("r"), _pairs(F.col(x), F.col(y)).alias("n"))
    n = F.col("n")
    got = got.withColumn("r", F.when(n >= 3, F.col("r")))
    r = F.least(F.greatest(F.col("r"), F.lit(-R_CLAMP)), F.lit(R_CLAMP))
    z = 0.5 * F.ln((1.0 + r) / (1.0 - r))
    half = F.when(n > 3, 1.96 / F.sqrt(n - 3.0))
    bound = lambda sign: F.when(F.col("r").isNotNull(), F.when(n > 3, F.tanh(z + sign * half)).otherwise(float(sign)))
    return got.withColumns({"p_value": corr_p(F.col("r"), n), "ci_low": bound(-1), "ci_high": bound(1)})


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """rho, p and n per group from average ranks of the complete pairs."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    for name in (x, y):
        full = attach_positions(full, keys, name).withColumn(f"_rank_{name}", average_rank()).drop("n_at", "n_below", "n_group")
    got = full.groupBy(*keys).agg(
        safe_corr(F.col(f"_rank_{x}"), F.col(f"_rank_{y}")).alias("rho"), F.count(F.lit(1)).alias("n")
    )
    got = got.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
    return got.withColumn("p_value", corr_p(F.col("rho"), F.col("n")))


def partial(df: DataFrame, keys: Sequence[str], x: str, y: str, covariates: Sequence[str]) -> DataFrame:
    """Correlation of x and y given covariates, by recursion over pairwise correlations."""
    names = [x, y, *covariates]
    full = df.dropna(subset=names)
    pair = {(a, b): f"_r{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    got = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[safe_corr(F.col(a), F.col(b)).alias(c) for (a, b), c in pair.items()]
    )

    def rho(a: str, b: str, given: Sequence[str]) -> Column:
        if not given:
            return F.col(pair.get((a, b)) or pair[(b, a)])
        rest, z = given[:-1], given[-1]
        ab, az, bz = rho(a, b, rest), rho(a, z, rest), rho(b, z, rest)
        return F.try_divide(ab - az * bz, F.sqrt(F.greatest((1.0 - az * az) * (1.0 - bz * bz), F.lit(0.0))))

    k = len(covariates)
    got = got.withColumn("r", F.when(F.col("n") >= k + 3, rho(x, y, list(covariates))))
    return got.select(*keys, "r", corr_p(F.col("r"), F.col("n")).alias("p_value"), "n")


def multiple_ols(df: DataFrame, y: str, features: Sequence[str]):
    """Multiple regression: (coefficient table, r2, fitted model), or None with too few rows.

    The normal-equation solver needs one pass that sums cross products on the
    executors; only the k-by-k system reaches the driver.
    """
    full = df.select(F.col(y).cast("double"), *[F.col(f).cast("double") for f in features]).dropna()
    need = len(features) + 2
    if full.limit(need).count() < need:
        return None
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(full)
    model = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(data)
    s = model.summary
    terms = [*features, "intercept"]
    coefs = [*map(float, model.coefficients), float(model.intercept)]
    try:
        p_values = list(map(float, s.pValues))
    except (Py4JJavaError, UnsupportedOperationException, IllegalArgumentException):  # the summary refuses p-values without spare degrees of freedom
        p_values = [None] * len(terms)
    table = df.sparkSession.createDataFrame(
        [(t, c, p, float(s.r2)) for t, c, p in zip(terms, coefs, p_values)],
        "term string, coefficient double, p_value double, r_squared double",
    )
    return table, float(s.r2), model


def ols_residuals(df: DataFrame, model, y: str, features: Sequence[str]) -> DataFrame:
    fitted = F.lit(float(model.intercept))
    for f, c in zip(features, model.coefficients):
        fitted = fitted + F.col(f) * float(c)
    return df.dropna(subset=[y, *features]).withColumn("residual", F.col(y) - fitted)


def metric_pairs(df: DataFrame, entity: str, x_cols: Sequence[str], y_cols: Sequence[str], carry: str | None = None) -> DataFrame:
    """Long rows (entity, x_col, x, y_col, y, z) of the columns that exist; ``carry`` fills z."""
    xs = [c for c in x_cols if c in df.columns]
    ys = [c for c in y_cols if c in df.columns]
    z = F.col(carry).cast("double") if carry else F.lit(None).cast("double")
    recs = [
        F.struct(
            F.lit(a).alias("x_col"), F.col(a).cast("double").alias("x"),
            F.lit(b).alias("y_col"), F.col(b).cast("double").alias("y"), z.alias("z"),
        )
        for a in xs
        for b in ys
    ]
    return df.select(entity, F.inline(F.array(*recs)))


def correlation_matrix(
    df: DataFrame, entity: str, x_cols: Sequence[str], y_cols: Sequence[str], population: str | None = None
) -> DataFrame:
    """Pearson, Spearman and (given population) partial correlation of every column pair."""
    pairs = saved(metric_pairs(df, entity, x_cols, y_cols, population), "pairs")
    first_x = next(c for c in x_cols if c in df.columns)
    known = pairs.filter(F.col("x_col") == first_x).groupBy("y_col").agg(F.count("y").alias("_n"))
    pairs = pairs.join(known.filter(F.col("_n") >= 3), "y_col", "left_semi")
    keys = ["x_col", "y_col"]
    p = pearson(pairs, keys, "x", "y").select(
        *keys, F.col("r").alias("pearson_r"), F.col("p_value").alias("pearson_p"), "n"
    )
    s = spearman(pairs, keys, "x", "y").select(
        *keys, F.col("rho").alias("spearman_r"), F.col("p_value").alias("spearman_p")
    )
    out = p.join(s, keys, "left")
    if population:
        with_z = pairs.filter(F.col("y_col") != population)
        part = partial(with_z, keys, "x", "y", ["z"]).select(
            *keys, F.col("r").alias("partial_r"), F.col("p_value").alias("partial_p")
        )
        out = out.join(part, keys, "left")
    return out


def strongest(corr: DataFrame, k: int, r: str = "pearson_r") -> DataFrame:
    """The k pairs with the largest absolute correlation."""
    return top_k(corr.filter(F.col(r).isNotNull()), k, [F.abs(r).desc(), F.col("x_col"), F.col("y_col")])


def pearson_matrix(df: DataFrame, x_cols: Sequence[str], y_cols: Sequence[str]) -> DataFrame:
    """Pearson correlation and regression line of every column pair, from one aggregation over the table.

    Columns that don't exist, and y columns with fewer than three values, are left out.
    """
    value = lambda c: F.col(c).cast("double")
    pairs = [(a, b) for a in x_cols for b in y_cols if a in df.columns and b in df.columns]
    cells = [
        F.struct(
            F.lit(a).alias("x_col"), F.lit(b).alias("y_col"), safe_corr(value(a), value(b)).alias("r"), _pairs(value(a), value(b)).alias("n"),
            F.regr_slope(value(b), value(a)).alias("slope"), F.regr_intercept(value(b), value(a)).alias("intercept"), F.count(b).alias("_known"),
        ).alias(f"_{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    out = df.agg(*cells).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(pairs))]))).filter(F.col("_known") >= 3)
    out = out.withColumn("pearson_r", F.when(F.col("n") >= 3, F.col("r")))
    return out.withColumn("p_value", corr_p(F.col("r"), F.col("n"))).drop("_known")


def pair_lines(df: DataFrame, chosen: DataFrame, x_cols: Sequence[str], y_cols: Sequence[str]) -> DataFrame:
    """Regression line of each chosen pair."""
    lines = pearson_matrix(df, x_cols, y_cols).join(chosen.select("x_col", "y_col"), ["x_col", "y_col"], "left_semi")
    return lines.select("x_col", "y_col", "slope", "intercept", "r", "n", "p_value")


def quadrants(df: DataFrame, entity: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """HH / HL / LH / LL class of each entity by both medians, per metric pair."""
    recs = [
        F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs
    ]
    rows = df.select(entity, F.inline(F.array(*recs))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    mx = summarise(rows, ["pair"], "x", {"mx": 0.5})
    my = summarise(rows, ["pair"], "y", {"my": 0.5})
    code = F.concat(
        F.when(F.col("x") >= F.col("mx"), "H").otherwise("L"), F.when(F.col("y") >= F.col("my"), "H").otherwise("L")
    )
    return rows.join(mx, "pair").join(my, "pair").withColumn("quadrant", code).drop("mx", "my")
