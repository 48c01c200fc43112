"""Trend, stability, tier, ranking and correlation queries on the order panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.columns import no_nan
from ..functions.student_t import t_two_sided_p
from ..operators import correlation as C
from ..operators import panel as N
from ..operators import trends as T
from ..operators.ranking import row_numbers, top_k
from .pixel_queries import R6
from .registry import add_view, query, sql_t_p, years_of

BOUNDARY = 1998
PCT = "(exp({b}) - 1) * 100"

add_view("xy", "panel", "SELECT entity, yr, median_value, ln(greatest(median_value, 0) + 1e-6) AS y FROM panel")
add_view(
    "fit",
    "panel xy",
    """SELECT entity, count(*) AS n, regr_slope(y, yr) AS b, regr_intercept(y, yr) AS a, avg(yr) AS mx, avg(y) AS my,
    regr_sxx(y, yr) AS sxx, regr_syy(y, yr) AS syy, regr_sxy(y, yr) AS sxy FROM xy GROUP BY entity""",
)
add_view(
    "trend",
    "panel xy fit",
    f"""SELECT entity, {PCT.format(b='b')} AS annual_pct_change, sxy * sxy / (sxx * syy) AS r_squared,
    {sql_t_p('(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx))', '(n - 2)')} AS p_value, CAST(n AS INT) AS n_years, b AS beta FROM fit""",
)
add_view(
    "scaled",
    "panel",
    "SELECT entity, yr, median_value / 100000.0 AS v, mean_value / 100000.0 AS w, pixel_count FROM panel",
)
ALAN_SQL = "CASE WHEN {v} < 1 THEN 'low' WHEN {v} < 5 THEN 'medium' WHEN {v} IS NOT NULL THEN 'high' ELSE 'unknown' END"


def _scaled(t):
    return t.panel.select(
        "entity", "yr", (F.col("median_value") / 100000.0).alias("v"), (F.col("mean_value") / 100000.0).alias("w"), "pixel_count"
    )


def _trend(t):
    return T.fit_trend(t.panel, "entity", "yr", "median_value")


add_view(
    "strend",
    "panel scaled",
    f"""SELECT entity, {PCT.format(b='b')} AS annual_pct_change, sxy * sxy / (sxx * syy) AS r_squared,
    {sql_t_p('(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx))', '(n - 2)')} AS p_value, CAST(n AS INT) AS n_years
    FROM (SELECT entity, count(*) AS n, regr_slope(y, yr) AS b, regr_sxx(y, yr) AS sxx, regr_syy(y, yr) AS syy, regr_sxy(y, yr) AS sxy
      FROM (SELECT entity, yr, ln(v + 1e-6) AS y FROM scaled) GROUP BY entity)""",
)


@query(
    "t01_trend_class_rank",
    "panel scaled strend",
    f"""WITH l AS (SELECT entity, max_by(v, yr) AS v, max_by(w, yr) AS w FROM scaled GROUP BY entity)
    SELECT t.entity, round(annual_pct_change, 6) AS annual_pct_change, round(r_squared, 6) AS r_squared,
     round(p_value, 6) AS p_value, n_years, round(v, 6) AS v_latest, round(w, 6) AS w_latest,
     {ALAN_SQL.format(v='v')} AS alan_class,
     CAST(row_number() OVER (ORDER BY annual_pct_change DESC, t.entity) AS INT) AS growth_rank
    FROM strend t JOIN l ON t.entity = l.entity""",
)
def _(t):
    out = T.trends_with_latest(_scaled(t), "entity", "yr", "v", "w")
    out = row_numbers(out, "annual_pct_change", "entity", "growth_rank", descending=True)
    return out.select(
        "entity", *R6("annual_pct_change", "r_squared", "p_value"), "n_years", *R6("v_latest", "w_latest"), "alan_class", "growth_rank"
    )


@query(
    "t02_site_trends",
    "panel xy fit trend",
    """WITH q AS (SELECT entity, median(CAST(pixel_count % 12 AS DOUBLE)) AS mq, median(pixel_count) AS mv,
      max_by(median_value, yr) AS v, max_by(mean_value, yr) AS w FROM panel GROUP BY entity)
    SELECT t.entity, round(annual_pct_change, 6) AS annual_pct_change, round(p_value, 6) AS p_value, round(mq, 1) AS median_quality_pct,
     CAST(floor(mv) AS INT) AS median_valid_pixels, CASE WHEN mq < 5 OR mv < 30 THEN 'low_quality' ELSE 'ok' END AS quality_flag,
     round(v, 4) AS median_value_latest, round(w, 8) AS mean_value_latest FROM trend t JOIN q ON t.entity = q.entity""",
)
def _(t):
    p = t.panel.withColumn("quality_pct", (F.col("pixel_count") % 12).cast("double"))
    out = T.site_trends(p, "entity", "yr", "median_value", "mean_value", valid="pixel_count")
    return out.select(
        "entity", *R6("annual_pct_change", "p_value"), "median_quality_pct", "median_valid_pixels", "quality_flag",
        F.round("median_value_latest", 4).alias("median_value_latest"), F.round("mean_value_latest", 8).alias("mean_value_latest"),
    )


DRAW = "CAST(('0x' || substr(md5(concat_ws(':', '42', CAST({b} AS VARCHAR), CAST({i} AS VARCHAR))), 1, 8)) AS BIGINT)"
SERIES = """s AS (SELECT entity, yr, y, row_number() OVER (PARTITION BY entity ORDER BY yr) - 1 AS k,
  count(*) OVER (PARTITION BY entity) AS n FROM xy),
 b AS (SELECT CAST(unnest(range(1, {B} + 1)) AS BIGINT) AS b), i AS (SELECT CAST(unnest(range(0, 20)) AS BIGINT) AS i)"""


@query(
    "t03_bootstrap_ci",
    "panel xy",
    f"""WITH {SERIES.format(B=1000)},
    d AS (SELECT n, b, i, {DRAW.format(b='b', i='i')} % n AS idx FROM (SELECT DISTINCT n FROM s), b, i WHERE i < n),
    m AS (SELECT entity, b, {PCT.format(b='regr_slope(y, yr)')} AS pct FROM s JOIN d ON s.n = d.n AND s.k = d.idx
      GROUP BY entity, b HAVING count(DISTINCT yr) > 1)
    SELECT entity, round(quantile_cont(pct, 0.025), 6) AS ci_low, round(quantile_cont(pct, 0.975), 6) AS ci_high,
     CAST(count(*) AS INT) AS n_resamples FROM m GROUP BY entity""",
)
def _(t):
    return T.bootstrap_ci(t.panel, "entity", "yr", "median_value").select("entity", *R6("ci_low", "ci_high"), "n_resamples")


@query(
    "t04_block_bootstrap_ci",
    "panel xy",
    f"""WITH {SERIES.format(B=1000)},
    d AS (SELECT n, b, i, {DRAW.format(b='b', i='(i // 3)')} % greatest(1, n - 2) + i % 3 AS idx FROM (SELECT DISTINCT n FROM s), b, i WHERE i < n AND n >= 4),
    m AS (SELECT entity, b, {PCT.format(b='regr_slope(y, yr)')} AS pct FROM s JOIN d ON s.n = d.n AND s.k = d.idx
      GROUP BY entity, b HAVING count(DISTINCT yr) > 1)
    SELECT entity, round(quantile_cont(pct, 0.025), 6) AS ci_low_block, round(quantile_cont(pct, 0.975), 6) AS ci_high_block,
     CAST(count(*) AS INT) AS n_valid_resamples FROM m GROUP BY entity""",
)
def _(t):
    out = T.block_bootstrap_ci(t.panel, "entity", "yr", "median_value")
    return out.select("entity", *R6("ci_low_block", "ci_high_block"), "n_valid_resamples")


@query(
    "t05_version_trend",
    "panel xy fit",
    f"""WITH d AS (SELECT entity, yr, y, CASE WHEN yr >= {BOUNDARY} THEN 1.0 ELSE 0.0 END AS d FROM xy),
    m AS (SELECT entity, count(*) AS n, regr_sxx(y, yr) AS xx, regr_sxx(y, d) AS dd, regr_sxy(yr, d) AS xd, regr_sxy(y, yr) AS xy,
      regr_sxy(y, d) AS dy, regr_syy(y, yr) AS yy FROM d GROUP BY entity),
    c AS (SELECT *, xx * dd - xd * xd AS det FROM m),
    e AS (SELECT *, (xy * dd - dy * xd) / det AS bx, (dy * xx - xy * xd) / det AS bd FROM c),
    r AS (SELECT *, yy - bx * xy - bd * dy AS rss FROM e)
    SELECT entity, round({PCT.format(b='xy / xx')}, 6) AS annual_pct_change, round({PCT.format(b='bx')}, 6) AS annual_pct_change_adjusted,
     round(bd, 6) AS version_effect, round(xy * xy / (xx * yy), 6) AS r_squared, round(1 - rss / yy, 6) AS r_squared_adjusted,
     round({sql_t_p('(bx / sqrt(rss / (n - 3) * dd / det))', '(n - 3)')}, 6) AS p_value_trend,
     round({sql_t_p('(bd / sqrt(rss / (n - 3) * xx / det))', '(n - 3)')}, 6) AS p_value_version FROM r""",
)
def _(t):
    out = T.version_trend(t.panel, "entity", "yr", "median_value", BOUNDARY)
    return out.select("entity", *R6(*[c for c in out.columns if c != "entity"]))


@query(
    "t06_trend_diagnostics",
    "panel xy fit",
    """WITH e AS (SELECT x.entity, yr, y - my - b * (yr - mx) AS e, n, sxx, syy, 1.0 / n + (yr - mx) * (yr - mx) / sxx AS h
       FROM xy x JOIN fit f ON x.entity = f.entity),
    w AS (SELECT *, lag(e) OVER (PARTITION BY entity ORDER BY yr) AS p, sum(e * e) OVER (PARTITION BY entity) AS sse FROM e),
    z AS (SELECT *, e * e / (2 * sse / (n - 2)) * h / pow(1 - h, 2) AS cook, e / sqrt(sse / n) AS z FROM w),
    g AS (SELECT entity, max(n) AS n, 1 - max(sse) / max(syy) AS r2, sum(pow(e - p, 2)) / max(sse) AS dw,
      avg(pow(e, 3)) / pow(avg(e * e), 1.5) AS sk, avg(pow(e, 4)) / pow(avg(e * e), 2) - 3 AS ku, max(cook) AS cook,
      coalesce(string_agg(CAST(yr AS VARCHAR), ',' ORDER BY yr) FILTER (WHERE abs(z) > 2), '') AS outlier_years FROM z GROUP BY entity),
    j AS (SELECT *, exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2) AS jb FROM g)
    SELECT entity, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r_squared, round(dw, 6) AS durbin_watson,
     round(jb, 6) AS jarque_bera_p, round(cook, 6) AS cooks_distance_max, outlier_years,
     concat_ws('; ', CASE WHEN dw < 1 OR dw > 3 THEN printf('high autocorrelation (DW=%.2f)', dw) END,
       CASE WHEN jb < 0.05 THEN printf('non-normal residuals (JB p=%.3f)', jb) END,
       CASE WHEN cook > 1 THEN printf('high-influence observation (Cook''s D=%.2f)', cook) END,
       CASE WHEN r2 < 0.5 THEN printf('poor model fit (R²=%.3f)', r2) END) AS model_warnings FROM j""",
)
def _(t):
    out = T.trend_diagnostics(t.panel, "entity", "yr", "median_value")
    return out.select(
        "entity", *R6("r_squared", "adj_r_squared", "durbin_watson", "jarque_bera_p", "cooks_distance_max"), "outlier_years", "model_warnings"
    )


@query(
    "t07_breakpoints",
    "panel xy fit",
    f"""WITH r AS (SELECT entity, yr, row_number() OVER (PARTITION BY entity ORDER BY yr) AS k, count(*) OVER (PARTITION BY entity) AS n FROM xy),
    lim AS (SELECT entity, max(yr) FILTER (WHERE k = 3) AS lo, max(yr) FILTER (WHERE k = n - 1) AS hi FROM r GROUP BY entity HAVING max(n) >= 5),
    c AS (SELECT entity, unnest(range(lo, hi + 1)) AS bp FROM lim),
    s AS (SELECT x.entity, bp, yr > bp AS late, count(*) AS m, regr_slope(y, yr) AS b, regr_sxx(y, yr) AS sxx,
      regr_syy(y, yr) - coalesce(pow(regr_sxy(y, yr), 2) / regr_sxx(y, yr), 0) AS sse FROM xy x JOIN c ON x.entity = c.entity GROUP BY 1, 2, 3),
    p AS (SELECT a.entity, a.bp, a.m + z.m AS n, a.b AS b0, z.b AS b1, greatest(a.sse, 0) + greatest(z.sse, 0) AS sse, 1 / a.sxx + 1 / z.sxx AS v
      FROM s a JOIN s z ON a.entity = z.entity AND a.bp = z.bp AND NOT a.late AND z.late AND a.m >= 2 AND z.m >= 2),
    q AS (SELECT *, n * ln(sse / n) + 8 AS aic, row_number() OVER (PARTITION BY entity ORDER BY n * ln(sse / n), bp) AS rn FROM p),
    o AS (SELECT f.entity, f.b, f.n * ln((syy - sxy * sxy / sxx) / f.n) + 4 AS aic1, q.* EXCLUDE (entity) FROM fit f LEFT JOIN q ON f.entity = q.entity AND rn = 1),
    g AS (SELECT *, aic < aic1 AS better, {PCT.format(b='CASE WHEN aic < aic1 THEN b0 ELSE b END')} AS g0, {PCT.format(b='CASE WHEN aic < aic1 THEN b1 ELSE b END')} AS g1 FROM o)
    SELECT entity, CASE WHEN better THEN CAST(bp AS INT) END AS breakpoint_year, round(g0, 5) AS growth_rate_before, round(g1, 5) AS growth_rate_after,
     CASE WHEN better THEN CASE WHEN g0 >= 0 AND g1 < 0 THEN 'reversal_to_decline' WHEN g0 < 0 AND g1 >= 0 THEN 'reversal_to_growth'
       WHEN abs(g1) > abs(g0) THEN 'acceleration' ELSE 'deceleration' END END AS change_type,
     CASE WHEN better THEN round({sql_t_p('((b1 - b0) / sqrt(sse / (n - 4) * v))', '(n - 4)')}, 5) END AS p_value,
     CASE WHEN better THEN round(aic1 - aic, 5) ELSE 0.0 END AS aic_improvement FROM g""",
)
def _(t):
    out = T.breakpoints(t.panel, "entity", "yr", "median_value")
    r5 = [F.round(c, 5).alias(c) for c in ("growth_rate_before", "growth_rate_after", "p_value", "aic_improvement")]
    return out.select("entity", "breakpoint_year", "change_type", *r5)


@query(
    "t08_stability",
    "scaled",
    """WITH j AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY entity ORDER BY yr)) AS jump FROM scaled),
    g AS (SELECT entity, avg(v) AS m, stddev_samp(v) AS sd, skewness(v) AS sk, kurtosis(v) AS ku,
      quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, max(jump) AS jump, avg(v) FILTER (WHERE yr < 1998) AS pre, avg(v) FILTER (WHERE yr >= 1998) AS post FROM j GROUP BY entity)
    SELECT entity, round(m, 6) AS mean_value, round(sd, 6) AS std_value, round(sd / m, 6) AS coefficient_of_variation, round(sk, 5) AS skewness,
     round(ku, 5) AS kurtosis, round(iqr, 6) AS iqr, round(jump, 6) AS max_year_to_year_change,
     CASE WHEN sd / m < 0.2 THEN 'stable' WHEN sd / m < 0.5 THEN 'moderate' ELSE 'erratic' END AS stability_class,
     coalesce(post < pre, false) AS possible_led_transition FROM g""",
)
def _(t):
    out = T.stability(_scaled(t), "entity", "yr", "v", 1998)
    return out.select(
        "entity", *R6("mean_value", "std_value", "coefficient_of_variation", "iqr", "max_year_to_year_change"),
        F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), "stability_class", "possible_led_transition",
    )


@query(
    "t09_pearson",
    "scaled",
    f"""WITH g AS (SELECT yr, corr(v, w) AS r, count(*) AS n FROM scaled GROUP BY yr), z AS (SELECT *, atanh(r) AS z, 1.96 / sqrt(n - 3) AS h FROM g)
    SELECT yr, round(r, 6) AS r, n, round({sql_t_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p_value,
     round(tanh(z - h), 6) AS ci_low, round(tanh(z + h), 6) AS ci_high FROM z""",
)
def _(t):
    return C.pearson(_scaled(t), ["yr"], "v", "w").select("yr", "n", *R6("r", "p_value", "ci_low", "ci_high"))


RANKS = """k AS (SELECT yr, rank() OVER (PARTITION BY yr ORDER BY {x}) + (count(*) OVER (PARTITION BY yr, {x}) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY yr ORDER BY {y}) + (count(*) OVER (PARTITION BY yr, {y}) - 1) / 2.0 AS b FROM scaled)"""


@query(
    "t10_spearman",
    "scaled",
    f"""WITH {RANKS.format(x='v', y='(pixel_count // 5)')}, g AS (SELECT yr, corr(a, b) AS r, count(*) AS n FROM k GROUP BY yr)
    SELECT yr, round(r, 6) AS rho, n, round({sql_t_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p_value FROM g""",
)
def _(t):
    p = _scaled(t).withColumn("size", F.floor(F.col("pixel_count") / 5))
    return C.spearman(p, ["yr"], "v", "size").select("yr", *R6("rho", "p_value"), "n")


PART = "({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz}))"


@query(
    "t11_partial_correlation",
    "scaled",
    f"""WITH g AS (SELECT yr, corr(v, w) AS xy, corr(v, pixel_count) AS xz, corr(w, pixel_count) AS yz, count(*) AS n FROM scaled GROUP BY yr),
    p AS (SELECT yr, n, {PART.format(xy='xy', xz='xz', yz='yz')} AS r FROM g)
    SELECT yr, round(r, 6) AS r, n, round({sql_t_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p_value FROM p""",
)
def _(t):
    return C.partial(_scaled(t), ["yr"], "v", "w", ["pixel_count"]).select("yr", *R6("r", "p_value"), "n")


@query(
    "t11_partial_two_covariates",
    "panel",
    f"""WITH g AS (SELECT yr, corr(median_value, mean_value) AS xy, corr(median_value, pixel_count) AS xz, corr(mean_value, pixel_count) AS yz,
      corr(median_value, std_value) AS xs, corr(mean_value, std_value) AS ys, corr(pixel_count, std_value) AS zs, count(*) AS n FROM panel GROUP BY yr),
    a AS (SELECT yr, n, {PART.format(xy='xy', xz='xz', yz='yz')} AS xyz, {PART.format(xy='xs', xz='xz', yz='zs')} AS xsz, {PART.format(xy='ys', xz='yz', yz='zs')} AS ysz FROM g),
    p AS (SELECT yr, n, {PART.format(xy='xyz', xz='xsz', yz='ysz')} AS r FROM a)
    SELECT yr, round(r, 6) AS r, n, round({sql_t_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p_value FROM p""",
)
def _(t):
    return C.partial(t.panel, ["yr"], "median_value", "mean_value", ["pixel_count", "std_value"]).select("yr", *R6("r", "p_value"), "n")


OLS_VIEW = """WITH d AS (SELECT ln(median_value) AS y, CAST(yr - 1995 AS DOUBLE) AS a, pixel_count / 100.0 AS b FROM panel),
 m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS aa, regr_sxx(y, b) AS bb, regr_sxy(a, b) AS ab,
   regr_sxy(y, a) AS ay, regr_sxy(y, b) AS byy, regr_syy(y, a) AS yy FROM d),
 e AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ba, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS bb2 FROM m),
 r AS (SELECT *, yy - ba * ay - bb2 * byy AS rss, my - ba * ma - bb2 * mb AS b0 FROM e)"""


def _ols(t):
    d = t.panel.select(
        "entity", "yr", F.ln("median_value").alias("y"), (F.col("yr") - 1995).cast("double").alias("a"), (F.col("pixel_count") / 100.0).alias("b")
    )
    return d, C.multiple_ols(d, "y", ["a", "b"])


@query(
    "t12_multiple_ols",
    "panel",
    OLS_VIEW
    + f""", v AS (SELECT *, rss / (n - 3) * bb / det AS va, rss / (n - 3) * aa / det AS vb,
      rss / (n - 3) * (1.0 / n + (ma * ma * bb + mb * mb * aa - 2 * ma * mb * ab) / det) AS v0 FROM r),
    k AS (SELECT 'a' AS term, ba AS c, va AS v, n, rss, yy FROM v UNION ALL SELECT 'b', bb2, vb, n, rss, yy FROM v UNION ALL SELECT 'intercept', b0, v0, n, rss, yy FROM v)
    SELECT term, round(c, 6) AS coefficient, round({sql_t_p('(c / sqrt(v))', '(n - 3)')}, 5) AS p_value, round(1 - rss / yy, 6) AS r_squared FROM k""",
)
def _(t):
    table = _ols(t)[1][0]
    return table.select("term", *R6("coefficient"), F.round("p_value", 5).alias("p_value"), *R6("r_squared"))


@query(
    "t12_ols_residuals",
    "panel",
    OLS_VIEW + " SELECT entity, yr, round(ln(median_value) - b0 - ba * (yr - 1995) - bb2 * pixel_count / 100.0, 5) AS residual FROM panel, r",
)
def _(t):
    d, (_, _, model) = _ols(t)
    return C.ols_residuals(d, model, "y", ["a", "b"]).select("entity", "yr", F.round("residual", 5).alias("residual"))


@query(
    "t13_student_t",
    "",
    f"""SELECT o_orderkey, round({sql_t_p('((o_totalprice % 700) / 100.0 - 3.5)', '(1 + o_orderkey % 30)')}, 9) AS p_value FROM orders""",
)
def _(t):
    x = (no_nan("o_totalprice") % 700) / 100.0 - 3.5
    return t.orders.select("o_orderkey", F.round(t_two_sided_p(x, (1 + F.col("o_orderkey") % 30).cast("int")), 9).alias("p_value"))


add_view(
    "crossed",
    "panel xy fit trend",
    """SELECT t.entity, t.annual_pct_change, t.r_squared, c.* EXCLUDE (entity) FROM trend t LEFT JOIN (
      SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(count(*) AS DOUBLE) AS tot_p, avg(c_acctbal) AS balance,
       CAST(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE) / count(*) AS building_share,
       CAST(count(*) FILTER (WHERE c_acctbal < 0) AS DOUBLE) / count(*) AS debt_share FROM customer GROUP BY 1) c ON t.entity = c.entity""",
)
X_COLS = ["annual_pct_change", "r_squared"]
Y_COLS = ["tot_p", "balance", "building_share", "debt_share"]


def _cross(t):
    n = F.count(F.lit(1)).cast("double")
    stats = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("entity")).agg(
        n.alias("tot_p"),
        F.avg("c_acctbal").alias("balance"),
        (F.count_if(F.col("c_mktsegment") == "BUILDING") / n).alias("building_share"),
        (F.count_if(F.col("c_acctbal") < 0) / n).alias("debt_share"),
    )
    return _trend(t).select("entity", *X_COLS).join(stats, "entity", "left")


add_view(
    "long_pairs",
    "crossed",
    " UNION ALL ".join(
        f"SELECT entity, '{x}' AS x_col, {x} AS x, '{y}' AS y_col, {y} AS y, tot_p AS z FROM crossed" for x in X_COLS for y in Y_COLS
    ),
)
CROSS_VIEWS = "panel xy fit trend crossed long_pairs"
CORR_SQL = f"""WITH g AS (SELECT x_col, y_col, corr(x, y) AS r, count(*) AS n, corr(x, z) AS xz, corr(y, z) AS yz FROM long_pairs GROUP BY 1, 2),
 k AS (SELECT x_col, y_col, rank() OVER (PARTITION BY x_col, y_col ORDER BY x) + (count(*) OVER (PARTITION BY x_col, y_col, x) - 1) / 2.0 AS a,
   rank() OVER (PARTITION BY x_col, y_col ORDER BY y) + (count(*) OVER (PARTITION BY x_col, y_col, y) - 1) / 2.0 AS b FROM long_pairs),
 s AS (SELECT x_col, y_col, corr(a, b) AS rho FROM k GROUP BY 1, 2),
 f AS (SELECT g.*, s.rho, CASE WHEN g.y_col <> 'tot_p' THEN {PART.format(xy='r', xz='xz', yz='yz')} END AS pr FROM g JOIN s ON g.x_col = s.x_col AND g.y_col = s.y_col)
"""


def p_of(r: str) -> str:
    return sql_t_p(f"({r} * sqrt((n - 2) / (1 - {r} * {r})))", "(n - 2)")


@query(
    "t14_correlation_matrix",
    CROSS_VIEWS,
    CORR_SQL
    + f"""SELECT x_col, y_col, n, round(r, 6) AS pearson_r, round({p_of('r')}, 6) AS pearson_p, round(rho, 6) AS spearman_r,
     round({p_of('rho')}, 6) AS spearman_p, round(pr, 6) AS partial_r, round(CASE WHEN pr IS NOT NULL THEN {p_of('pr')} END, 6) AS partial_p FROM f""",
)
def _(t):
    out = C.correlation_matrix(_cross(t), "entity", X_COLS, Y_COLS, "tot_p")
    return out.select("x_col", "y_col", "n", *R6("pearson_r", "pearson_p", "spearman_r", "spearman_p", "partial_r", "partial_p"))


@query(
    "t16_pair_lines",
    CROSS_VIEWS,
    f"""WITH g AS (SELECT x_col, y_col, corr(x, y) AS r, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM long_pairs GROUP BY 1, 2
      ORDER BY abs(corr(x, y)) DESC LIMIT 6)
    SELECT x_col, y_col, round(b, 6) AS slope, round(a, 5) AS intercept, round(r, 6) AS r, n, round({p_of('r')}, 6) AS p_value FROM g""",
)
def _(t):
    cross = _cross(t)
    best = C.strongest(C.pearson_matrix(cross, X_COLS, Y_COLS), 6)
    out = C.pair_lines(cross, best, X_COLS, Y_COLS)
    return out.select("x_col", "y_col", *R6("slope", "r", "p_value"), F.round("intercept", 5).alias("intercept"), "n")


@query(
    "k02_top_correlations",
    CROSS_VIEWS,
    "SELECT x_col, y_col, round(corr(x, y), 6) AS pearson_r FROM long_pairs GROUP BY 1, 2 ORDER BY abs(corr(x, y)) DESC LIMIT 5",
)
def _(t):
    best = C.strongest(C.pearson_matrix(_cross(t), X_COLS, Y_COLS), 5)
    return best.select("x_col", "y_col", *R6("pearson_r"))


QUAD_SQL = """WITH v AS (SELECT *, median(annual_pct_change) OVER () AS mx, median(balance) OVER () AS my, median(building_share) OVER () AS mz FROM crossed
   WHERE annual_pct_change IS NOT NULL AND balance IS NOT NULL AND building_share IS NOT NULL),
 q AS (SELECT entity, 'annual_pct_change_vs_balance' AS pair, (CASE WHEN annual_pct_change >= mx THEN 'H' ELSE 'L' END) || (CASE WHEN balance >= my THEN 'H' ELSE 'L' END) AS quadrant FROM v
  UNION ALL SELECT entity, 'annual_pct_change_vs_building_share', (CASE WHEN annual_pct_change >= mx THEN 'H' ELSE 'L' END) || (CASE WHEN building_share >= mz THEN 'H' ELSE 'L' END) FROM v)
"""
QUAD_PAIRS = [("annual_pct_change", "balance"), ("annual_pct_change", "building_share")]


@query("a31_quadrants", "panel xy fit trend crossed", QUAD_SQL + "SELECT entity, pair, quadrant FROM q")
def _(t):
    return C.quadrants(_cross(t), "entity", QUAD_PAIRS).select("entity", "pair", "quadrant")


@query("a31_quadrant_counts", "panel xy fit trend crossed", QUAD_SQL + "SELECT pair, quadrant, count(*) AS n FROM q GROUP BY 1, 2")
def _(t):
    return C.quadrants(_cross(t), "entity", QUAD_PAIRS).groupBy("pair", "quadrant").agg(F.count(F.lit(1)).alias("n"))


# --- scalar classes and conversions on the panel -----------------------------------------


@query("p05_alan_class", "scaled", f"SELECT entity, yr, {ALAN_SQL.format(v='(v * 2 - 1)')} AS alan_class FROM scaled")
def _(t):
    return _scaled(t).select("entity", "yr", S.alan_class(F.col("v") * 2 - 1).alias("alan_class"))


@query(
    "p06_stability_class",
    "panel",
    """SELECT entity, CASE WHEN cv < 0.2 THEN 'stable' WHEN cv < 0.5 THEN 'moderate' WHEN cv IS NULL THEN 'unknown' ELSE 'erratic' END AS stability_class
    FROM (SELECT entity, stddev_samp(min_value) / nullif(avg(min_value), 0) AS cv FROM panel GROUP BY entity)""",
)
def _(t):
    g = t.panel.groupBy("entity").agg(F.try_divide(F.stddev_samp("min_value"), F.avg("min_value")).alias("cv"))
    return g.select("entity", S.stability_class("cv").alias("stability_class"))


MAG = "(-2.5 * log10((l_quantity * 0.177 + 108000000.0 * pow(10, -8.8)) / 108000000.0))"


@query("p07_sky_magnitude", "", f"SELECT l_orderkey, l_linenumber, l_partkey, round({MAG}, 6) AS mag FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.sky_magnitude("l_quantity"), 6).alias("mag"))


@query(
    "p08_bortle_class",
    "",
    f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, {MAG.replace('l_quantity', '(l_discount * l_quantity)')} AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(m, 2) AS sky_magnitude,
     CASE WHEN m >= 21.75 THEN 1 WHEN m >= 21.5 THEN 2 WHEN m >= 21.25 THEN 3 WHEN m >= 20.5 THEN 4 WHEN m >= 19.5 THEN 5 WHEN m >= 18.5 THEN 6 WHEN m >= 18 THEN 7 WHEN m >= 17 THEN 8 ELSE 9 END AS bortle_class,
     CASE WHEN m >= 21.75 THEN 'Excellent dark-sky site' WHEN m >= 21.5 THEN 'Typical dark-sky site' WHEN m >= 21.25 THEN 'Rural sky' WHEN m >= 20.5 THEN 'Rural/suburban transition'
      WHEN m >= 19.5 THEN 'Suburban sky' WHEN m >= 18.5 THEN 'Bright suburban sky' WHEN m >= 18 THEN 'Suburban/urban transition' WHEN m >= 17 THEN 'City sky' ELSE 'Inner-city sky' END AS bortle_description FROM m""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * F.col("l_quantity")).alias("x"))
    return S.add_sky_brightness(rows, "x").drop("x")


@query("p09_elevation_factor", "", "SELECT s_suppkey, round(exp(-(s_acctbal + 1000) / 8500.0), 8) AS factor FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.round(S.elevation_factor(F.col("s_acctbal") + 1000), 8).alias("factor"))


@query(
    "p25_projected_value",
    "panel xy fit trend scaled",
    """SELECT t.entity, round(l.v * pow(1 + annual_pct_change / 100, 10), 6) AS projected FROM trend t
    JOIN (SELECT entity, max_by(v, yr) AS v FROM scaled GROUP BY entity) l ON t.entity = l.entity""",
)
def _(t):
    j = _trend(t).join(T.latest_values(_scaled(t), "entity", "yr", ["v"]), "entity")
    return j.select("entity", F.round(S.projected_10yr("v_latest", "annual_pct_change"), 6).alias("projected"))


@query(
    "p26_interval_fallback",
    "panel",
    """SELECT entity, yr, round(CASE WHEN yr % 2 = 0 THEN min_value END, 3) AS low_only, round(coalesce(CASE WHEN yr % 2 = 0 THEN min_value END, max_value), 3) AS low_or_lower FROM panel""",
)
def _(t):
    p = t.panel.withColumns({"ci_low": F.when(F.col("yr") % 2 == 0, F.col("min_value")), "ci_lower": F.col("max_value")})
    return p.select(
        "entity", "yr", S.first_present(["ci_low", "absent"], p).alias("low_only"), S.first_present(["ci_low", "ci_lower"], p).alias("low_or_lower")
    )


# --- tiers, windows, ranks ----------------------------------------------------------------

TIER = "CASE WHEN {p} <= 20 THEN 'Pristine' WHEN {p} <= 40 THEN 'Low' WHEN {p} <= 60 THEN 'Medium' WHEN {p} <= 80 THEN 'High' ELSE 'Very High' END"
add_view(
    "tiers",
    "scaled",
    f"""SELECT entity, yr, v, round(p, 1) AS percentile_rank, {TIER.format(p='p')} AS alan_tier FROM (SELECT entity, yr, v,
    (rank() OVER (PARTITION BY yr ORDER BY v) + (count(*) OVER (PARTITION BY yr, v) - 1) / 2.0) / count(*) OVER (PARTITION BY yr) * 100 AS p FROM scaled)""",
)
TIER_VIEWS = "panel scaled tiers"
ORDER_YEARS = range(1995, 2002)  # the years the driver's orders have


@query("w01_percentile_tiers", TIER_VIEWS, "SELECT entity, yr, round(v, 6) AS v, percentile_rank, alan_tier FROM tiers")
def _(t):
    out = N.percentile_tiers(_scaled(t), "entity", "yr", "v")
    return out.select("entity", "yr", *R6("v"), "percentile_rank", "alan_tier")


@query(
    "w02_tier_boundaries",
    "panel scaled",
    """WITH q AS (SELECT yr, [quantile_cont(v, 0), quantile_cont(v, 0.2), quantile_cont(v, 0.4), quantile_cont(v, 0.6), quantile_cont(v, 0.8), quantile_cont(v, 1)] AS q FROM scaled GROUP BY yr),
    i AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS i)
    SELECT yr, ['Pristine', 'Low', 'Medium', 'High', 'Very High'][i] AS tier, (i - 1) * 20 AS percentile_low, i * 20 AS percentile_high,
     round(q[i], 2) AS radiance_low, round(q[i + 1], 2) AS radiance_high FROM q, i""",
)
def _(t):
    return N.tier_boundaries(_scaled(t), "yr", "v")


@query("w03_tier_trajectory", TIER_VIEWS, "SELECT entity, yr, percentile_rank, alan_tier FROM tiers")
def _(t):
    return N.percentile_tiers(_scaled(t), "entity", "yr", "v").select("entity", "yr", "percentile_rank", "alan_tier")


@query("w04_share_tier", "panel scaled", f"SELECT entity, yr, {TIER.format(p='c * 100')} AS percentile_tier FROM (SELECT entity, yr, cume_dist() OVER (PARTITION BY yr ORDER BY v) AS c FROM scaled)")
def _(t):
    return N.share_tier(_scaled(t).select("entity", "yr", "v"), ["yr"], "v").select("entity", "yr", "percentile_tier")


add_view(
    "props",
    "panel xy fit trend scaled",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY projected_radiance_10yr, entity) AS INT) AS rank_conservation FROM (
    SELECT t.entity, CAST(t.entity AS VARCHAR) AS slug, 2001 AS latest_year, round(l.v, 4) AS latest_radiance, 1995 AS baseline_year, round(b.v, 4) AS baseline_radiance,
     round((l.v - b.v) / b.v * 100, 2) AS pct_change_total, round(annual_pct_change, 3) AS annual_pct_change, {ALAN_SQL.format(v='l.v')} AS alan_class,
     {TIER.format(p='l.share * 100')} AS percentile_tier, t.growth_rank AS rank_annual_growth, l.latest_rank AS rank_latest_radiance,
     round(l.v * pow(1 + t.annual_pct_change / 100, 10), 3) AS projected_radiance_10yr
    FROM (SELECT *, CAST(row_number() OVER (ORDER BY annual_pct_change DESC, entity) AS INT) AS growth_rank FROM trend) t
    JOIN (SELECT *, CAST(row_number() OVER (ORDER BY v DESC, entity) AS INT) AS latest_rank, cume_dist() OVER (ORDER BY v) AS share
      FROM scaled WHERE yr = 2001) l ON l.entity = t.entity JOIN scaled b ON b.entity = t.entity AND b.yr = 1995)""",
)
PROP_VIEWS = "panel xy fit trend scaled props"


def props_of(t):
    p = _scaled(t).withColumnRenamed("v", "mean_radiance")
    return N.entity_properties(p, _trend(t), "entity", "yr", "mean_radiance").drop("annual_pct_change_ci_lower", "annual_pct_change_ci_upper")


@query("w05_rankings", PROP_VIEWS, "SELECT * FROM props")
def _(t):
    return props_of(t)


@query(
    "w06_latest_and_baseline",
    "panel scaled",
    """SELECT entity, min(yr) AS baseline_year, max(yr) AS latest_year, round(min_by(v, yr), 6) AS baseline_value, round(max_by(v, yr), 6) AS latest_value,
    round((max_by(v, yr) - min_by(v, yr)) / min_by(v, yr) * 100, 6) AS pct_change_total FROM scaled GROUP BY entity""",
)
def _(t):
    out = T.baseline_change(_scaled(t), "entity", "yr", "v")
    return out.select("entity", "baseline_year", "latest_year", *R6("baseline_value", "latest_value", "pct_change_total"))


@query(
    "w07_year_on_year",
    "panel scaled",
    """SELECT entity, yr, round(v - lag(v) OVER w, 6) AS change, yr - lag(yr) OVER w AS gap FROM scaled WINDOW w AS (PARTITION BY entity ORDER BY yr)""",
)
def _(t):
    return T.year_on_year(_scaled(t), "entity", "yr", "v").select("entity", "yr", *R6("change"), "gap")


@query("k01_top_entities", "panel", "SELECT entity, yr, round(median_value, 4) AS v FROM panel ORDER BY median_value DESC, entity LIMIT 10")
def _(t):
    return top_k(t.panel, 10, [F.desc("median_value"), F.col("entity")]).select("entity", "yr", F.round("median_value", 4).alias("v"))


@query(
    "k01_top_per_group",
    "",
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""",
)
def _(t):
    o = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_k(o, 5, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderpriority"])


@query("k03_district_ranking", "panel", "SELECT entity, round(median_value, 4) AS v FROM panel WHERE yr = (SELECT max(yr) FROM panel) AND median_value IS NOT NULL ORDER BY median_value")
def _(t):
    p = t.panel.join(t.panel.agg(F.max("yr").alias("yr")), "yr").filter(F.col("median_value").isNotNull())
    return p.orderBy("median_value").select("entity", F.round("median_value", 4).alias("v"))


@query(
    "k04_leaderboard",
    PROP_VIEWS,
    """SELECT 'best_conserving' AS board, rank_conservation AS rank, entity, latest_radiance, annual_pct_change, projected_radiance_10yr FROM props
    UNION ALL SELECT 'fastest_changing', CAST(row_number() OVER (ORDER BY annual_pct_change DESC, entity) AS INT), entity, latest_radiance, annual_pct_change, projected_radiance_10yr FROM props""",
)
def _(t):
    return N.leaderboard(props_of(t), "entity").select("board", "rank", "entity", "latest_radiance", "annual_pct_change", "projected_radiance_10yr")


@query(
    "j20_nearest_by_value",
    "panel xy fit trend",
    """SELECT entity, neighbor, round(gap, 6) AS gap FROM (SELECT a.entity, b.entity AS neighbor, abs(a.annual_pct_change - b.annual_pct_change) AS gap,
    row_number() OVER (PARTITION BY a.entity ORDER BY abs(a.annual_pct_change - b.annual_pct_change), b.entity) AS rn FROM trend a, trend b WHERE a.entity <> b.entity) WHERE rn <= 3""",
)
def _(t):
    return N.nearest_by_value(_trend(t), "entity", "annual_pct_change").select("entity", "neighbor", *R6("gap"))


# --- aggregates over entities -------------------------------------------------------------


@query(
    "a17_benchmark_comparison",
    "panel xy fit trend",
    """WITH g AS (SELECT median(annual_pct_change) AS m, avg(annual_pct_change) AS a, min(annual_pct_change) AS lo, max(annual_pct_change) AS hi FROM trend),
    b AS (SELECT * FROM (VALUES ('global_lit_area', 2.2), ('global_total_radiance', 1.8), ('global_ground_based', 9.6), ('developing_asia', 4.1), ('india_national', 5.3)) v(benchmark_name, pct))
    SELECT benchmark_name, CAST(pct AS DOUBLE) AS benchmark_growth_pct, round(m, 2) AS median_growth, round(a, 2) AS mean_growth, round(lo, 2) AS range_low, round(hi, 2) AS range_high,
     round(m - CAST(pct AS DOUBLE), 2) AS difference, CASE WHEN abs(m - pct) < 1 THEN 'similar' WHEN m > pct THEN 'faster' ELSE 'slower' END AS interpretation FROM g, b""",
)
def _(t):
    out = N.benchmark_comparison(_trend(t))
    return out.select("benchmark_name", "benchmark_growth_pct", "median_growth", "mean_growth", "range_low", "range_high", "difference", "interpretation")


@query(
    "a24_yearly_percentiles",
    "panel",
    "SELECT yr, " + ", ".join(f"round(quantile_cont(median_value, 0.{p}), 4) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM panel GROUP BY yr",
)
def _(t):
    return N.yearly_percentiles(t.panel, "yr", "median_value").select("yr", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


@query("a24_group_median", "panel", "SELECT entity % 5 AS region, yr, round(median(median_value), 4) AS median_value FROM panel GROUP BY 1, 2")
def _(t):
    out = N.group_median(t.panel.withColumn("region", F.col("entity") % 5), ["region", "yr"], "median_value", "m")
    return out.select("region", "yr", F.round("m", 4).alias("median_value"))


@query("a24_class_counts", "scaled", f"SELECT yr, {ALAN_SQL.format(v='(v - 1.5)')} AS alan_class, count(*) AS n FROM scaled GROUP BY 1, 2")
def _(t):
    return N.class_counts(_scaled(t).withColumn("v", F.col("v") - 1.5), "yr", "v")


@query(
    "a25_null_census",
    "",
    """SELECT 'value' AS "column", count(*) FILTER (WHERE event_id % 7 = 0) AS nulls, CAST(0 AS BIGINT) AS previous, count(*) FILTER (WHERE event_id % 7 = 0) AS delta FROM events
    UNION ALL SELECT 'user_id', count(*) FILTER (WHERE event_id % 11 = 0), count(*) FILTER (WHERE event_id % 22 = 0), count(*) FILTER (WHERE event_id % 11 = 0) - count(*) FILTER (WHERE event_id % 22 = 0) FROM events""",
)
def _(t):
    e = t.events
    first = e.select(F.when(F.col("event_id") % 22 != 0, F.col("user_id")).alias("user_id"))
    later = e.select(
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id")
    )
    out = N.null_delta(N.null_counts(later, "later"), N.null_counts(first, "first"))
    return out.select("column", "nulls", "previous", "delta")


@query(
    "a25_nulls_by_entity",
    "observations",
    """SELECT specieskey, 'individualcount' AS "column", count(*) FILTER (WHERE individualcount IS NULL) AS nulls FROM observations GROUP BY 1
    UNION ALL SELECT specieskey, 'lat', count(*) FILTER (WHERE lat IS NULL) FROM observations GROUP BY 1""",
)
def _(t):
    return N.nulls_by_entity(t.observations, "specieskey", ["individualcount", "lat"])


@query(
    "a26_table_comparison",
    "",
    """SELECT 'o_totalprice' AS "column", 'common' AS status, round(avg(o_totalprice), 6) AS mean_a, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS mean_b,
      round((avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice)) / abs(avg(o_totalprice)) * 100, 6) AS mean_change_pct FROM orders
    UNION ALL SELECT 'o_custkey', 'removed', round(avg(o_custkey), 6), NULL, NULL FROM orders
    UNION ALL SELECT 'flag', 'added', NULL, CAST(1.0 AS DOUBLE), NULL""",
)
def _(t):
    a = t.orders.select("o_totalprice", "o_custkey")
    b = t.orders.filter("o_orderstatus = 'F'").select("o_totalprice", F.lit(1).alias("flag"))
    out = N.compare_tables(a, b)
    return out.select("column", "status", *R6("mean_a", "mean_b", "mean_change_pct"))


@query(
    "a27_growth_classes",
    "panel xy fit trend",
    """WITH g AS (SELECT entity, abs(annual_pct_change) AS g FROM trend), q AS (SELECT quantile_cont(g, 0.25) AS a, quantile_cont(g, 0.5) AS b, quantile_cont(g, 0.75) AS c FROM g)
    SELECT entity, CASE WHEN g < a THEN printf('Low (<%.1f%%)', a) WHEN g < b THEN printf('Moderate (%.1f-%.1f%%)', a, b)
      WHEN g < c THEN printf('High (%.1f-%.1f%%)', b, c) ELSE printf('Rapid (>%.1f%%)', c) END AS growth_class FROM g, q""",
)
def _(t):
    g = _trend(t).select("entity", F.abs("annual_pct_change").alias("g"))
    return N.growth_classes(g, "entity", "g").select("entity", "growth_class")


@query(
    "a27_growth_classes_mixed",
    "panel xy fit trend",
    """SELECT entity, CASE WHEN annual_pct_change < 0 THEN 'Declining (<0%)' WHEN annual_pct_change < 2 THEN 'Slow (0-2%)' WHEN annual_pct_change < 5 THEN 'Moderate (2-5%)' ELSE 'Rapid (>5%)' END AS growth_class FROM trend""",
)
def _(t):
    return N.growth_classes(_trend(t), "entity").select("entity", "growth_class")


@query(
    "a28_mean_quality",
    "panel",
    """SELECT n.n_nationkey AS entity, round(avg(p.pixel_count), 6) AS mean_quality FROM nation n LEFT JOIN panel p ON n.n_nationkey = p.entity AND p.entity % 4 <> 0 GROUP BY 1""",
)
def _(t):
    spine = t.nation.select(F.col("n_nationkey").alias("entity"))
    p = t.panel.filter(F.col("entity") % 4 != 0).withColumn("entity", F.col("entity").cast("int"))
    return N.mean_by_entity(p, "entity", "pixel_count", spine, "mean_quality").select("entity", *R6("mean_quality"))


@query(
    "a29_value_matrix",
    "panel",
    "SELECT entity, "
    + ", ".join(f"round(avg(log10(greatest(median_value, 0.01))) FILTER (WHERE yr = {y}), 6) AS y{y}" for y in ORDER_YEARS)
    + " FROM panel GROUP BY entity",
)
def _(t):
    out = N.value_matrix(t.panel, "entity", "yr", "median_value", years_of(t.panel), log=True)
    return out.select("entity", *R6(*[c for c in out.columns if c != "entity"]))


@query(
    "a30_tier_distribution",
    TIER_VIEWS,
    "SELECT yr, " + ", ".join(f"count(*) FILTER (WHERE alan_tier = '{x}') AS \"{x}\"" for x in N.TIERS) + " FROM tiers GROUP BY yr",
)
def _(t):
    return N.tier_distribution(N.percentile_tiers(_scaled(t), "entity", "yr", "v"), "yr")


@query(
    "a30_tier_transitions",
    TIER_VIEWS,
    """WITH t AS (SELECT unnest(['Pristine', 'Low', 'Medium', 'High', 'Very High']) AS t),
    m AS (SELECT a.alan_tier AS s, b.alan_tier AS e FROM tiers a JOIN tiers b ON a.entity = b.entity AND a.yr = 1995 AND b.yr = 2001)
    SELECT x.t AS tier_start, y.t AS tier_end, count(m.s) AS n FROM t x CROSS JOIN t y LEFT JOIN m ON m.s = x.t AND m.e = y.t GROUP BY 1, 2""",
)
def _(t):
    tiers = N.percentile_tiers(_scaled(t), "entity", "yr", "v")
    return N.tier_transitions(tiers, "entity", "yr", 1995, 2001)


@query(
    "a33_anomalies",
    "panel xy fit trend",
    """SELECT entity, concat_ws('; ', CASE WHEN r_squared < 0.3 THEN printf('Low R² (%.2f)', r_squared) END,
      CASE WHEN abs(annual_pct_change * 10) > 20 THEN printf('Extreme trend (%+.1f%%/yr)', annual_pct_change * 10) END) AS reasons
    FROM trend WHERE r_squared < 0.3 OR abs(annual_pct_change * 10) > 20""",
)
def _(t):
    return N.anomaly_flags(_trend(t).withColumn("annual_pct_change", F.col("annual_pct_change") * 10), "entity")
