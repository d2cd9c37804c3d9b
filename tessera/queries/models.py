"""Cohort tests and regressions on orders, with closed-form SQL oracles.

The oracles use other formulas than the library: demeaning instead of
dummies, covariance ratios instead of projections, saturated cells instead of
iterations, numeric integration instead of special functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.queries.registry import query
from tessera.sources.tables import table
from tessera.stats.absorb import ols_absorbed as absorb
from tessera.stats.design import Cat, Inter, Num
from tessera.stats.discrete import logit as fit_logit
from tessera.stats.discrete import probit_imr as score_probit
from tessera.stats.linear import (
    impute_by_model,
    iv,
    model_family as fit_family,
    nested_test,
    ols,
    robust,
    robust_iv,
)
from tessera.stats.report import coefficient_table as report
from tessera.stats.report import marginal_grid as predictions
from tessera.stats.selection import heckman as fit_heckman
from tessera.stats.selection import heckman_family as fit_selection_family
from tessera.stats.selection import iv_selection as fit_iv_selection
from tessera.stats.tests import correlation, prop_test as test_shares, welch_test as test_means


def facts(spark, folder):
    """Orders with the nation and balance of their customer; status P is an unknown cohort."""
    customer = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        (F.col("o_totalprice") / 1000).alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.year("o_orderdate").cast("double").alias("year"),
    )
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "price",
        "month",
        "year",
        "nation",
        "balance",
        "segment",
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("cohort"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("selected"),
    )


_FACTS = """
    facts AS (SELECT o_totalprice / 1000 AS price, month(o_orderdate)::DOUBLE AS month,
                     year(o_orderdate)::DOUBLE AS year, c_nationkey::VARCHAR AS nation, c_acctbal AS balance,
                     c_mktsegment AS segment, o_orderpriority AS priority,
                     CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS cohort,
                     CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS selected
              FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def _erf(z: str) -> str:
    """Error function by its all-positive series."""
    return (
        f"(CASE WHEN abs({z}) < 1e-12 THEN 0.0 ELSE sign({z}) * list_sum(list_transform(range(0, 120), "
        f"lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma(k + 1.5) - ({z}) * ({z})))) END)"
    )


def _simpson(density: str, upper: str, steps: int = 4000) -> str:
    """Integral of ``density`` (in x) over [0, upper] by Simpson's rule."""
    body = density.replace("{x}", f"(k * ({upper}) / {steps}.0)")
    weight = f"(CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return (
        f"(({upper}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps} + 1), "
        f"lambda k: {weight} * {body})))"
    )


def _student_tail(t: str, df: str) -> str:
    density = (
        f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi()) "
        f"- ({df} + 1) / 2.0 * ln(1 + {{x}} * {{x}} / {df}))"
    )
    return f"(1 - 2 * {_simpson(density, f'abs({t})')})"


def _fisher_tail(f: str, d1: str, d2: str) -> str:
    density = (
        f"(CASE WHEN {{x}} <= 0 THEN 0 ELSE exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) "
        f"+ {d1} / 2.0 * ln({d1} / {d2}) + ({d1} / 2.0 - 1) * ln(greatest({{x}}, 1e-300)) "
        f"- ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {{x}} / {d2})) END)"
    )
    return f"(1 - {_simpson(density, f)})"


_COUNTS = """
    long AS (SELECT cohort, 'priority' AS variable, priority AS level FROM facts WHERE cohort IS NOT NULL UNION ALL
             SELECT cohort, 'segment', segment FROM facts WHERE cohort IS NOT NULL),
    cnt AS (SELECT variable, level, count(*) FILTER (cohort) AS x1, count(*) FILTER (NOT cohort) AS x2
            FROM long GROUP BY ALL),
    sized AS (SELECT *, sum(x1) OVER (PARTITION BY variable)::BIGINT AS n1,
                     sum(x2) OVER (PARTITION BY variable)::BIGINT AS n2 FROM cnt),
    pooled AS (SELECT *, (x1 + x2) / (n1 + n2)::DOUBLE AS p,
                      least(0.5, abs(x1 / n1::DOUBLE - x2 / n2::DOUBLE) / (1.0 / n1 + 1.0 / n2)) AS y FROM sized),
    tested AS (SELECT *, power(abs(x1 - n1 * p) - y, 2) * (1 / (n1 * p) + 1 / (n1 * (1 - p)))
                       + power(abs(x2 - n2 * p) - y, 2) * (1 / (n2 * p) + 1 / (n2 * (1 - p))) AS s FROM pooled)
"""


@query(
    f"""
    WITH {_FACTS}, {_COUNTS}
    SELECT variable, level, x1 AS count_1, n1 AS total_1, ROUND(x1 / n1 * 100, 4) AS percent_1,
           x2 AS count_2, n2 AS total_2, ROUND(x2 / n2 * 100, 4) AS percent_2, ROUND(s, 6) AS statistic,
           ROUND(1 - {_erf('sqrt(s / 2)')}, 6) AS p_value
    FROM tested WHERE x1 > 0
    """
)
def prop_test(spark, folder):
    """Equality of level shares between two cohorts."""
    rows = facts(spark, folder)
    tested = test_shares(rows, F.col("cohort"), ["priority", "segment"])
    rounded = {"percent_1": 4, "percent_2": 4, "statistic": 6, "p_value": 6}
    return tested.withColumns({c: F.round(c, d) for c, d in rounded.items()})


@query(
    f"""
    WITH {_FACTS},
    long AS (SELECT cohort, 'price' AS variable, price AS v FROM facts UNION ALL
             SELECT cohort, 'balance', CASE WHEN balance > 0 THEN balance END FROM facts),
    s AS (SELECT variable, avg(v) FILTER (cohort) AS m1, var_samp(v) FILTER (cohort) AS v1, count(v) FILTER (cohort) AS n1,
                 avg(v) FILTER (NOT cohort) AS m2, var_samp(v) FILTER (NOT cohort) AS v2,
                 count(v) FILTER (NOT cohort) AS n2 FROM long GROUP BY 1),
    t AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
                 power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS d FROM s)
    SELECT variable, ROUND(m1, 4) AS mean_1, ROUND(sqrt(v1), 4) AS sd_1, n1 AS n_1, ROUND(m2, 4) AS mean_2,
           ROUND(sqrt(v2), 4) AS sd_2, n2 AS n_2, ROUND(t, 6) AS statistic, ROUND(d, 2) AS df,
           ROUND({_student_tail('t', 'd')}, 6) AS p_value
    FROM t
    """
)
def welch_test(spark, folder):
    """Unequal-variance t tests of cohort means."""
    rows = facts(spark, folder).withColumn("balance", F.when(F.col("balance") > 0, F.col("balance")))
    tested = test_means(rows, F.col("cohort"), ["price", "balance"])
    rounded = {"mean_1": 4, "sd_1": 4, "mean_2": 4, "sd_2": 4, "statistic": 6, "df": 2, "p_value": 6}
    return tested.withColumns({c: F.round(c, d) for c, d in rounded.items()})


@query(
    f"""
    WITH {_FACTS}
    SELECT ROUND(r, 6) AS r, n, ROUND(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lower,
           ROUND(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS upper
    FROM (SELECT corr(price, month) AS r, count(*) AS n FROM facts)
    """
)
def corr_ci(spark, folder):
    """Correlation with its Fisher interval."""
    found = correlation(facts(spark, folder), "price", "month")
    return found.withColumns({c: F.round(c, 6) for c in ("r", "lower", "upper")})


def _terms(df, digits=4):
    return df.select(
        "term",
        F.round("estimate", digits).alias("estimate"),
        F.round("std_error", digits).alias("std_error"),
        F.round("statistic", digits).alias("statistic"),
    )


@query(
    """
    WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                      regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
                      avg(l_quantity) AS mx, count(*) AS n FROM lineitem),
    e AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS s2 FROM s)
    SELECT 'l_quantity' AS term, ROUND(b, 4) AS estimate, ROUND(sqrt(s2 / sxx), 4) AS std_error,
           ROUND(b / sqrt(s2 / sxx), 4) AS statistic FROM e
    UNION ALL
    SELECT '(Intercept)', ROUND(a, 4), ROUND(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4),
           ROUND(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) FROM e
    """
)
def ols_simple(spark, folder):
    """One-regressor least squares over all lines."""
    fit = ols(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"])
    return _terms(fit.tidy(spark))


_WITHIN = """
    g AS (SELECT nation, avg(price) AS my, avg(month) AS mx, count(*) AS ng FROM facts GROUP BY 1),
    w AS (SELECT sum((f.month - mx) * (f.price - my)) / sum(power(f.month - mx, 2)) AS b,
                 sum(power(f.month - mx, 2)) AS sxx, sum(power(f.price - my, 2)) AS syy,
                 count(*) AS n, count(DISTINCT nation) AS k FROM facts f JOIN g USING (nation)),
    e AS (SELECT *, syy - b * b * sxx AS rss, (syy - b * b * sxx) / (n - k - 1) AS s2 FROM w)
"""


@query(
    f"""
    WITH {_FACTS}, {_WITHIN},
    ref AS (SELECT my AS ry, mx AS rx, ng AS rn FROM g WHERE nation = '0')
    SELECT 'month' AS term, ROUND(b, 4) AS estimate, ROUND(sqrt(s2 / sxx), 4) AS std_error,
           ROUND(b / sqrt(s2 / sxx), 4) AS statistic FROM e
    UNION ALL
    SELECT 'nation' || nation, ROUND(d, 4), ROUND(se, 4), ROUND(d / se, 4)
    FROM (SELECT nation, (my - b * mx) - (ry - b * rx) AS d,
                 sqrt(s2 * (1.0 / ng + 1.0 / rn + power(mx - rx, 2) / sxx)) AS se FROM g, ref, e WHERE nation <> '0')
    UNION ALL
    SELECT '(Intercept)', ROUND(a, 4), ROUND(se, 4), ROUND(a / se, 4)
    FROM (SELECT ry - b * rx AS a, sqrt(s2 * (1.0 / rn + rx * rx / sxx)) AS se FROM ref, e)
    """
)
def ols_fe(spark, folder):
    """Least squares with a fixed effect per nation."""
    fit = ols(facts(spark, folder), "price", [Num("month"), Cat("nation")])
    return _terms(fit.tidy(spark))


@query(
    f"""
    WITH {_FACTS}, {_WITHIN}
    SELECT n::DOUBLE AS n, ROUND(sqrt(s2), 6) AS sigma,
           ROUND(1 - rss / t, 8) AS r_squared, ROUND(1 - (rss / (n - k - 1)) / (t / (n - 1)), 8) AS adj_r_squared,
           ROUND(((t - rss) / k) / s2, 6) AS f_statistic
    FROM e, (SELECT regr_syy(price, price) AS t FROM facts)
    """
)
def ols_fit_statistics(spark, folder):
    """n, sigma, R2, adjusted R2 and F of the fixed-effect model."""
    fit = ols(facts(spark, folder), "price", [Num("month"), Cat("nation")])
    digits = {"sigma": 6, "r_squared": 8, "adj_r_squared": 8, "f_statistic": 6}
    return fit.glance(spark).select("n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    f"""
    WITH {_FACTS}, m AS (SELECT segment, avg(price) AS m FROM facts GROUP BY 1)
    SELECT 'segment' || segment AS term, ROUND(m - (SELECT m FROM m WHERE segment = 'AUTOMOBILE'), 6) AS estimate
    FROM m WHERE segment <> 'AUTOMOBILE'
    UNION ALL SELECT '(Intercept)', ROUND(avg(m), 6) FROM m
    """
)
def centered_contrasts(spark, folder):
    """Centred contrasts: level against reference, intercept the mean of level means."""
    fit = ols(facts(spark, folder), "price", [Cat("segment", coding="centered")])
    return fit.tidy(spark).select("term", F.round("estimate", 6).alias("estimate"))


@query(
    f"""
    WITH {_FACTS},
    r AS (SELECT segment, regr_slope(price, month) AS b, regr_intercept(price, month) AS a FROM facts GROUP BY 1),
    ref AS (SELECT a AS ra, b AS rb FROM r WHERE segment = 'AUTOMOBILE')
    SELECT '(Intercept)' AS term, ROUND(ra, 5) AS estimate FROM ref
    UNION ALL SELECT 'month', ROUND(rb, 5) FROM ref
    UNION ALL SELECT 'segment' || segment, ROUND(a - ra, 5) FROM r, ref WHERE segment <> 'AUTOMOBILE'
    UNION ALL SELECT 'segment' || segment || ':month', ROUND(b - rb, 5) FROM r, ref WHERE segment <> 'AUTOMOBILE'
    """
)
def ols_interaction(spark, folder):
    """Slopes that differ by segment."""
    terms = [Num("month"), Cat("segment"), Inter(Cat("segment"), Num("month"))]
    fit = ols(facts(spark, folder), "price", terms)
    return fit.tidy(spark).select("term", F.round("estimate", 5).alias("estimate"))


@query(
    f"""
    WITH {_FACTS},
    s AS (SELECT regr_slope(price, month) AS b, regr_intercept(price, month) AS a, avg(month) AS mx,
                 regr_sxx(price, month) AS sxx, count(*) AS n FROM facts)
    SELECT 'month' AS term, ROUND(b, 5) AS estimate,
           ROUND(sqrt(n / (n - 2) * (SELECT sum(power((month - mx) * (price - a - b * month), 2)) FROM facts) / (sxx * sxx)), 5) AS std_error
    FROM s
    """
)
def robust_errors(spark, folder):
    """HC1 standard error of a slope."""
    rows = facts(spark, folder)
    fit = robust(rows, ols(rows, "price", ["month"]))
    return (
        fit.tidy(spark)
        .filter("term = 'month'")
        .select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))
    )


_IV = """
    iv AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, p_retailprice AS z
           FROM lineitem JOIN part ON l_partkey = p_partkey),
    mom AS (SELECT covar_samp(z, y) AS zy, covar_samp(z, x) AS zx, var_samp(z) AS zz, var_samp(x) AS xx,
                 var_samp(y) AS yy, covar_samp(x, y) AS xy, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM iv)
"""


def _instrument(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x")
    )
    part = table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("z"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("y", "x", "z")


@query(
    f"""
    WITH {_IV},
    e AS (SELECT *, zy / zx AS b, (yy - 2 * zy / zx * xy + power(zy / zx, 2) * xx) * (n - 1) / (n - 2) AS s2 FROM mom)
    SELECT 'x' AS term, ROUND(b, 5) AS estimate, ROUND(sqrt(s2 * zz / (n - 1)) / abs(zx), 5) AS std_error FROM e
    UNION ALL
    SELECT '(Intercept)', ROUND(my - b * mx, 4),
           ROUND(sqrt(s2 * (1.0 / n + mx * mx * zz / ((n - 1) * zx * zx))), 4) FROM e
    """
)
def iv_ratio(spark, folder):
    """Exactly identified two-stage least squares."""
    fit = iv(_instrument(spark, folder), "y", ["x"], [], ["z"]).fit
    digits = F.when(F.col("term") == "x", 5).otherwise(4)
    return fit.tidy(spark).select(
        "term",
        F.when(digits == 5, F.round("estimate", 5)).otherwise(F.round("estimate", 4)).alias("estimate"),
        F.when(digits == 5, F.round("std_error", 5)).otherwise(F.round("std_error", 4)).alias("std_error"),
    )


@query(
    f"""
    WITH {_IV},
    f AS (SELECT *, (zx / zz) * (zx / zz) * zz AS hh, xx - (zx * zx) / zz AS vv, zy / zx AS b,
                 (xy - zx / zz * zy) / (xx - zx * zx / zz) AS d FROM mom),
    h AS (SELECT *, (yy - b * b * hh - d * d * vv) * (n - 1) / (n - 3) AS s2 FROM f)
    SELECT 'weak instruments (x)' AS test, ROUND(hh / (vv / (n - 2)), 4) AS statistic, 1.0::DOUBLE AS df1,
           (n - 2)::DOUBLE AS df2 FROM h
    UNION ALL
    SELECT 'Wu-Hausman', ROUND(power(d - b, 2) / (s2 / (n - 1) * (1 / hh + 1 / vv)), 4), 1.0, (n - 3)::DOUBLE FROM h
    """
)
def iv_diagnostics(spark, folder):
    """Weak-instrument and exogeneity tests from the same cross products."""
    found = iv(_instrument(spark, folder), "y", ["x"], [], ["z"])
    return found.diagnostics(spark).select("test", F.round("statistic", 4).alias("statistic"), "df1", "df2")


@query(
    f"""
    WITH {_IV},
    e AS (SELECT *, zy / zx AS b, zx / zz AS p, avg(z) OVER () AS mz FROM iv, mom),
    s AS (SELECT any_value(n) AS n, any_value(b) AS b, any_value(p) AS p,
                 sum(power((y - my - b * (x - mx)) * (z - mz), 2)) AS meat, sum(power((x - mx - p * (z - mz)) * (z - mz), 2)) AS first,
                 any_value(zx) * (any_value(n) - 1) AS szx, any_value(zz) * (any_value(n) - 1) AS szz FROM e)
    SELECT 'x' AS term, ROUND(b, 5) AS estimate, ROUND(sqrt(n / (n - 2) * meat) / abs(szx), 5) AS std_error,
           ROUND(p * p / (n / (n - 2) * first / (szz * szz)), 4) AS first_stage_f FROM s
    """
)
def iv_robust(spark, folder):
    """Robust error of an instrumented slope, and the robust F of its first stage."""
    rows = _instrument(spark, folder)
    found = robust_iv(rows, iv(rows, "y", ["x"], [], ["z"]))
    return (
        found.fit.tidy(spark)
        .filter("term = 'x'")
        .select(
            "term",
            F.round("estimate", 5).alias("estimate"),
            F.round("std_error", 5).alias("std_error"),
            F.lit(round(found.first_stage_f["x"][0], 4)).alias("first_stage_f"),
        )
    )


@query(
    f"""
    WITH RECURSIVE {_FACTS}, {_WITHIN},
    g2 AS (SELECT nation, row_number() OVER (ORDER BY nation) AS i FROM g),
    y2 AS (SELECT year, row_number() OVER (ORDER BY year) AS j FROM (SELECT DISTINCT year FROM facts)),
    cell AS (SELECT i, j, count(*)::DOUBLE AS n, sum(price - 150) AS p, sum(month - 6) AS m, sum((price - 150) * (month - 6)) AS pm,
                    sum(power(month - 6, 2)) AS mm, sum(power(price - 150, 2)) AS pp
             FROM facts JOIN g2 USING (nation) JOIN y2 USING (year) GROUP BY ALL),
    one AS (SELECT list({{'i': i, 'j': j, 'n': n, 'p': p, 'm': m}}) AS cells, max(i) AS gs, max(j) AS ys FROM cell),
    -- effects of price (a by nation, c by year) and of month (d, e), one side after the other
    fit(k, a, c, d, e) AS (
        SELECT 0, list_transform(range(gs), lambda z: 0.0::DOUBLE), list_transform(range(ys), lambda z: 0.0::DOUBLE),
               list_transform(range(gs), lambda z: 0.0::DOUBLE), list_transform(range(ys), lambda z: 0.0::DOUBLE) FROM one
        UNION ALL
        SELECT k + 1,
               CASE WHEN k % 2 = 0 THEN [list_sum([x.p - x.n * c[x.j] FOR x IN cells IF x.i = l]) / list_sum([x.n FOR x IN cells IF x.i = l]) FOR l IN range(1, gs + 1)] ELSE a END,
               CASE WHEN k % 2 = 1 THEN [list_sum([x.p - x.n * a[x.i] FOR x IN cells IF x.j = l]) / list_sum([x.n FOR x IN cells IF x.j = l]) FOR l IN range(1, ys + 1)] ELSE c END,
               CASE WHEN k % 2 = 0 THEN [list_sum([x.m - x.n * e[x.j] FOR x IN cells IF x.i = l]) / list_sum([x.n FOR x IN cells IF x.i = l]) FOR l IN range(1, gs + 1)] ELSE d END,
               CASE WHEN k % 2 = 1 THEN [list_sum([x.m - x.n * d[x.i] FOR x IN cells IF x.j = l]) / list_sum([x.n FOR x IN cells IF x.j = l]) FOR l IN range(1, ys + 1)] ELSE e END
        FROM fit, one WHERE k < 60),
    free AS (SELECT sum(pm - p * (d[i] + e[j]) - m * (a[i] + c[j]) + n * (a[i] + c[j]) * (d[i] + e[j])) AS xy,
                    sum(mm - 2 * m * (d[i] + e[j]) + n * power(d[i] + e[j], 2)) AS xx,
                    sum(pp - 2 * p * (a[i] + c[j]) + n * power(a[i] + c[j], 2)) AS yy,
                    sum(n) AS n, count(DISTINCT i) + count(DISTINCT j) - 1 AS k
             FROM cell, fit WHERE fit.k = 60)
    SELECT 'nation' AS absorbed, ROUND(b, 5) AS estimate, ROUND(sqrt(s2 / sxx), 5) AS std_error, (n - k - 1)::DOUBLE AS df_residual FROM e
    UNION ALL
    SELECT 'nation, year', ROUND(xy / xx, 5), ROUND(sqrt((yy - xy * xy / xx) / (n - k - 1) / xx), 5), (n - k - 1)::DOUBLE FROM free
    """
)
def ols_absorbed(spark, folder):
    """Slope of month with nations, and with nations and years, absorbed instead of estimated."""
    rows = facts(spark, folder)
    data = []
    for factors in (["nation"], ["nation", "year"]):
        fit = absorb(rows, "price", ["month"], factors)
        data.append((", ".join(factors), round(fit.coefficients["month"], 5), round(fit.errors["month"], 5), float(fit.df_residual)))
    return spark.createDataFrame(data, "absorbed string, estimate double, std_error double, df_residual double")


@query(
    f"""
    WITH {_FACTS},
    r AS (SELECT regr_slope(price, month) AS b, regr_intercept(price, month) AS a FROM facts WHERE priority <> '5-LOW')
    SELECT segment, count(*) AS n, ROUND(sum(CASE WHEN priority = '5-LOW' AND segment <> 'BUILDING' THEN a + b * month END), 3) AS imputed,
           ROUND(sum(CASE WHEN priority <> '5-LOW' THEN price WHEN segment <> 'BUILDING' THEN a + b * month END), 3) AS final,
           ROUND(avg(CASE WHEN priority <> '5-LOW' THEN price * price WHEN segment <> 'BUILDING' THEN power(a + b * month, 2) END), 3) AS squared
    FROM facts, r GROUP BY 1
    """
)
def imputation(spark, folder):
    """Missing values of a population filled by regression on its known rows."""
    rows = facts(spark, folder).withColumn("price", F.when(F.col("priority") != "5-LOW", F.col("price")))
    filled, _ = impute_by_model(
        rows,
        "price",
        ["month"],
        where=F.col("segment") != "BUILDING",
        fit_rows=F.lit(True),
        squared="price_sq_final",
    )
    return filled.groupBy("segment").agg(
        F.count("*").alias("n"),
        F.round(F.sum("price_imputed"), 3).alias("imputed"),
        F.round(F.sum("price_final"), 3).alias("final"),
        F.round(F.avg("price_sq_final"), 3).alias("squared"),
    )


@query(
    f"""
    WITH {_FACTS}, {_WITHIN}
    SELECT 'plain' AS model, regr_count(price, month)::BIGINT AS n, ROUND(regr_slope(price, month), 6) AS estimate,
           ROUND(regr_r2(price, month), 8) AS r_squared FROM facts
    UNION ALL
    SELECT 'nation', n, ROUND(b, 6), ROUND(1 - rss / (SELECT regr_syy(price, price) FROM facts), 8) FROM e
    UNION ALL
    SELECT 'known', regr_count(price, b)::BIGINT, ROUND(regr_slope(price, b), 6), ROUND(regr_r2(price, b), 8)
    FROM (SELECT price, CASE WHEN balance > 0 THEN month END AS b FROM facts)
    """
)
def model_family(spark, folder):
    """Nested models on shared rows, and one that loses rows to missing values."""
    rows = facts(spark, folder).withColumn("known_month", F.when(F.col("balance") > 0, F.col("month")))
    fits = fit_family(
        rows,
        "price",
        {"plain": ["month"], "nation": ["month", "nation"], "known": ["known_month"]},
    )
    data = [
        (name, f.n, f.coefficients.get("month", f.coefficients.get("known_month")), f.summary["r_squared"])
        for name, f in fits.items()
    ]
    df = spark.createDataFrame(data, "model string, n bigint, estimate double, r_squared double")
    return df.select(
        "model", "n", F.round("estimate", 6).alias("estimate"), F.round("r_squared", 8).alias("r_squared")
    )


@query(
    f"""
    WITH {_FACTS}, {_WITHIN},
    s AS (SELECT regr_syy(price, month) - regr_slope(price, month) * regr_slope(price, month) * regr_sxx(price, month) AS rss0
          FROM facts),
    f AS (SELECT rss0, rss, (k - 1)::DOUBLE AS d1, (n - k - 1)::DOUBLE AS d2, ((rss0 - rss) / (k - 1)) / s2 AS f FROM s, e)
    SELECT ROUND(rss0, 2) AS rss_small, ROUND(rss, 2) AS rss_large, d1 AS df, d2 AS df_residual, ROUND(f, 6) AS f,
           ROUND({_fisher_tail('f', 'd1', 'd2')}, 6) AS p_value
    FROM f
    """
)
def anova(spark, folder):
    """F test of a model against one with nation effects."""
    fits = fit_family(
        facts(spark, folder), "price", {"plain": ["month"], "nation": ["month", "nation"]}
    )
    tested = nested_test(spark, fits["plain"], fits["nation"])
    return tested.select(
        F.round("rss_small", 2).alias("rss_small"),
        F.round("rss_large", 2).alias("rss_large"),
        "df",
        "df_residual",
        F.round("f", 6).alias("f"),
        F.round("p_value", 6).alias("p_value"),
    )


@query(
    f"""
    WITH {_FACTS}, {_WITHIN}
    SELECT nation, m.month, ROUND(my + b * (m.month - mx), 5) AS predicted,
           ROUND(sqrt(s2 * (1.0 / ng + power(m.month - mx, 2) / sxx)), 5) AS std_error
    FROM g, e, (VALUES (3.0::DOUBLE), (9.0)) m(month)
    """
)
def marginal_grid(spark, folder):
    """Predictions over two terms of a fitted model."""
    fit = ols(facts(spark, folder), "price", [Num("month"), Cat("nation")])
    grid = predictions(spark, fit, {"nation": None, "month": [3.0, 9.0]})
    return grid.select(
        "nation", "month", F.round("predicted", 5).alias("predicted"), F.round("std_error", 5).alias("std_error")
    )


def _text(estimate: str, error: str) -> str:
    p = _student_tail(f"({estimate} / {error})", "d")
    stars = f"CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' ELSE '' END"
    return f"format('{{:.3f}}', {estimate}) || {stars} || format(' ({{:.3f}})', {error})"


@query(
    f"""
    WITH {_FACTS}, {_WITHIN},
    p AS (SELECT regr_slope(price, month) AS b, regr_intercept(price, month) AS a, avg(month) AS mx,
                 regr_sxx(price, month) AS sxx, count(*) AS n,
                 (regr_syy(price, month) - regr_slope(price, month) * regr_slope(price, month) * regr_sxx(price, month))
                 / (count(*) - 2) AS s2 FROM facts),
    plain AS (SELECT *, (n - 2)::DOUBLE AS d, sqrt(s2 / sxx) AS eb FROM p),
    wide AS (SELECT *, (n - k - 1)::DOUBLE AS d, sqrt(s2 / sxx) AS eb FROM e),
    tss AS (SELECT regr_syy(price, month) AS t FROM facts)
    SELECT 1 AS position, 'Month' AS term, (SELECT {_text('b', 'eb')} FROM plain) AS plain,
           (SELECT {_text('b', 'eb')} FROM wide) AS nation
    UNION ALL SELECT 1 + count(DISTINCT nation)::INTEGER, 'Nation controls', 'No', 'Yes' FROM facts
    UNION ALL SELECT 2 + count(DISTINCT nation)::INTEGER, 'Observations', count(*)::VARCHAR, count(*)::VARCHAR FROM facts
    UNION ALL SELECT 3 + (SELECT count(DISTINCT nation) FROM facts)::INTEGER, 'R2',
           (SELECT format('{{:.3f}}', 1 - s2 * d / t) FROM plain, tss), (SELECT format('{{:.3f}}', 1 - s2 * d / t) FROM wide, tss)
    UNION ALL SELECT 4 + (SELECT count(DISTINCT nation) FROM facts)::INTEGER, 'F',
           (SELECT format('{{:.3f}}', (t - s2 * d) / s2) FROM plain, tss), (SELECT format('{{:.3f}}', (t - s2 * d) / k / s2) FROM wide, tss)
    """
)
def coefficient_table(spark, folder):
    """Models side by side: kept terms renamed, stars, a controls row, fit statistics."""
    fits = fit_family(
        facts(spark, folder), "price", {"plain": ["month"], "nation": ["month", "nation"]}
    )
    return report(
        spark,
        fits,
        keep=["^month"],
        omit=["nation"],
        names={"month": "Month"},
        controls={"Nation controls": "^nation"},
        statistics={"Observations": "n", "R2": "r_squared", "F": "f_statistic"},
    )


@query(
    f"""
    WITH {_FACTS},
    c AS (SELECT priority, sum(selected) AS a, count(*) - sum(selected) AS b FROM facts GROUP BY 1),
    r AS (SELECT a AS ra, b AS rb FROM c WHERE priority = '1-URGENT')
    SELECT 'priority' || priority AS term, ROUND(ln(a / b) - ln(ra / rb), 5) AS estimate,
           ROUND(sqrt(1 / a + 1 / b + 1 / ra + 1 / rb), 5) AS std_error
    FROM c, r WHERE priority <> '1-URGENT'
    UNION ALL SELECT '(Intercept)', ROUND(ln(ra / rb), 5), ROUND(sqrt(1 / ra + 1 / rb), 5) FROM r
    """
)
def logit(spark, folder):
    """Logit of a flag on a factor; cells give the closed form."""
    found = fit_logit(facts(spark, folder), "selected", [Cat("priority")])
    return found.fit.tidy(spark).select(
        "term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error")
    )


def _one_by_one(update: str, steps: int) -> str:
    """A logit fitted by Newton steps on one coefficient block after the other, over lists of cells."""
    mu = "(1 / (1 + exp(-(a[x.p] + c[x.s] + b * x.m))))"
    residual, weight = f"(x.k - x.n * {mu})", f"(x.n * {mu} * (1 - {mu}))"

    def moved(own: str, test: str, times: str = "1") -> str:
        up = f"list_sum([{residual} * {times} FOR x IN cells IF {test}])"
        return f"{own} + {up} / list_sum([{weight} * {times} * {times} FOR x IN cells IF {test}])"

    return f"""
    fit(i, a, c, b) AS (
        SELECT 0, list_transform(range(ps), lambda z: 0.0::DOUBLE), list_transform(range(ss), lambda z: 0.0::DOUBLE), 0.0::DOUBLE FROM {update}
        UNION ALL
        SELECT i + 1, CASE WHEN i % 3 = 0 THEN [{moved('a[l]', 'x.p = l')} FOR l IN range(1, ps + 1)] ELSE a END,
               CASE WHEN i % 3 = 1 THEN [CASE WHEN l = 1 THEN 0.0 ELSE {moved('c[l]', 'x.s = l')} END FOR l IN range(1, ss + 1)] ELSE c END,
               CASE WHEN i % 3 = 2 THEN {moved('b', 'true', 'x.m')} ELSE b END
        FROM fit, {update} WHERE i < {steps})
    """


@query(
    f"""
    WITH RECURSIVE {_FACTS},
    p AS (SELECT priority, row_number() OVER (ORDER BY priority) AS p FROM (SELECT DISTINCT priority FROM facts)),
    s AS (SELECT segment, row_number() OVER (ORDER BY segment) AS s FROM (SELECT DISTINCT segment FROM facts)),
    grouped AS (SELECT p, s, month - 6 AS m, count(*)::DOUBLE AS n, sum(selected)::DOUBLE AS k
                FROM facts JOIN p USING (priority) JOIN s USING (segment) GROUP BY ALL),
    one AS (SELECT list({{'p': p, 's': s, 'm': m, 'n': n, 'k': k}}) AS cells, (SELECT count(*) FROM p) AS ps,
                   (SELECT count(*) FROM s) AS ss FROM grouped),
    {_one_by_one('one', 360)},
    last AS (SELECT a, c, b FROM fit WHERE i = 360)
    SELECT '(Intercept)' AS term, ROUND(a[1] - 6 * b, 5) AS estimate FROM last
    UNION ALL SELECT 'priority' || priority, ROUND(a[p] - a[1], 5) FROM last, p WHERE p > 1
    UNION ALL SELECT 'segment' || segment, ROUND(c[s], 5) FROM last, s WHERE s > 1
    UNION ALL SELECT 'month', ROUND(b, 5) FROM last
    """
)
def logit_factors(spark, folder):
    """Logit of a flag on two factors and a number."""
    found = fit_logit(facts(spark, folder), "selected", [Cat("priority"), Cat("segment"), Num("month")])
    return found.fit.tidy(spark).select("term", F.round("estimate", 5).alias("estimate"))


def _quantiles(key: str, tag: str = "", rows: str = "facts") -> str:
    """Normal quantile of each cell's share, by bisection."""
    phi = f"0.5 * (1 + {_erf('((lo + hi) / 2 / sqrt(2.0))')})"
    return f"""
    cells{tag} AS (SELECT {key}, avg(selected) AS p, count(*) AS n FROM {rows} GROUP BY 1),
    bis{tag} AS (SELECT {key}, p, n, -6.0::DOUBLE AS lo, 6.0::DOUBLE AS hi, 0 AS i FROM cells{tag}
            UNION ALL
            SELECT {key}, p, n, CASE WHEN {phi} < p THEN (lo + hi) / 2 ELSE lo END,
                   CASE WHEN {phi} < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM bis{tag} WHERE i < 48),
    eta{tag} AS (SELECT {key}, p, n, (lo + hi) / 2 AS eta,
                   exp(-power((lo + hi) / 2, 2) / 2) / sqrt(2 * pi()) / p AS imr FROM bis{tag} WHERE i = 48)
    """


@query(
    f"""
    WITH RECURSIVE {_FACTS}, {_quantiles('priority')}
    SELECT priority, n, ROUND(p, 6) AS probability, ROUND(eta, 6) AS eta, ROUND(imr, 6) AS imr FROM eta
    """
)
def probit_imr(spark, folder):
    """Probit of a flag on a factor: linear predictor, probability, inverse Mills ratio."""
    scored, _ = score_probit(facts(spark, folder), "selected", [Cat("priority")])
    return scored.groupBy("priority").agg(
        F.count("*").alias("n"),
        F.round(F.avg("probability"), 6).alias("probability"),
        F.round(F.avg("eta"), 6).alias("eta"),
        F.round(F.avg("imr"), 6).alias("imr"),
    )


@query(
    f"""
    WITH RECURSIVE {_FACTS}, {_quantiles('nation')},
    sel AS (SELECT price, imr, imr * (imr + eta) AS delta FROM facts JOIN eta USING (nation) WHERE selected = 1),
    r AS (SELECT regr_slope(price, imr) AS b, regr_intercept(price, imr) AS a, count(*) AS n, avg(delta) AS delta,
                 regr_syy(price, imr) AS syy, regr_sxx(price, imr) AS sxx FROM sel),
    v AS (SELECT *, sqrt((syy - b * b * sxx) / n + delta * b * b) AS sigma FROM r)
    SELECT n, ROUND(a, 2) AS intercept, ROUND(b, 2) AS b_lambda, ROUND(sigma, 3) AS sigma, ROUND(b / sigma, 5) AS rho FROM v
    """
)
def heckman(spark, folder):
    """Two-step selection model with a selection effect per nation."""
    found = fit_heckman(facts(spark, folder), "selected", [Cat("nation")], "price", [])
    b = found.outcome.coefficients
    data = [
        (
            found.outcome.n,
            round(b["(Intercept)"], 2),
            round(b["inv_mills_ratio"], 2),
            round(found.sigma, 3),
            round(found.rho, 5),
        )
    ]
    return spark.createDataFrame(
        data, "n bigint, intercept double, b_lambda double, sigma double, rho double"
    )


def _two_step(name: str, key: str, tag: str, rows: str) -> str:
    return f"""
    SELECT '{name}' AS model, n, ROUND(a, 2) AS intercept, ROUND(b, 2) AS b_lambda,
           ROUND(sqrt((syy - b * b * sxx) / n + delta * b * b), 3) AS sigma
    FROM (SELECT regr_slope(price, imr) AS b, regr_intercept(price, imr) AS a, count(*) AS n, avg(imr * (imr + eta)) AS delta,
                 regr_syy(price, imr) AS syy, regr_sxx(price, imr) AS sxx
          FROM {rows} JOIN eta{tag} USING ({key}) WHERE selected = 1)
    """


@query(
    f"""
    WITH RECURSIVE {_FACTS}, solvent AS (SELECT * FROM facts WHERE balance > 0), late AS (SELECT * FROM facts WHERE month > 3 OR selected = 0),
    {_quantiles('nation')}, {_quantiles('nation', '_s', 'solvent')}, {_quantiles('priority', '_l', 'late')}
    {_two_step('nation', 'nation', '', 'facts')} UNION ALL {_two_step('solvent', 'nation', '_s', 'solvent')}
    UNION ALL {_two_step('late', 'priority', '_l', 'late')}
    """
)
def selection_family(spark, folder):
    """Three selection models that lose different rows to missing values, fitted in the same passes."""
    rows = facts(spark, folder).withColumns(
        {
            "solvent_nation": F.when(F.col("balance") > 0, F.col("nation")),
            "late": F.when(F.col("month") > 3, F.lit(1.0)),
        }
    )
    found = fit_selection_family(
        rows,
        "selected",
        "price",
        {
            "nation": ([Cat("nation")], []),
            "solvent": ([Cat("solvent_nation")], []),
            "late": ([Cat("priority")], [Num("late")]),
        },
    )
    data = [
        (name, f.outcome.n, f.outcome.coefficients["(Intercept)"], f.outcome.coefficients["inv_mills_ratio"], f.sigma)
        for name, f in found.items()
    ]
    out = spark.createDataFrame(data, "model string, n bigint, intercept double, b_lambda double, sigma double")
    return out.withColumns({c: F.round(c, d) for c, d in {"intercept": 2, "b_lambda": 2, "sigma": 3}.items()})


@query(
    f"""
    WITH RECURSIVE {_FACTS}, {_quantiles('nation')},
    sel AS (SELECT nation, price, imr, imr * (imr + eta) AS delta FROM facts JOIN eta USING (nation) WHERE selected = 1),
    r AS (SELECT regr_slope(price, imr) AS b, regr_intercept(price, imr) AS a, count(*) AS n, avg(delta) AS delta,
                 regr_syy(price, imr) AS syy, regr_sxx(price, imr) AS sxx FROM sel),
    v AS (SELECT *, (syy - b * b * sxx) / n + delta * b * b AS sigma2 FROM r),
    cell AS (SELECT nation, eta, imr AS l, imr * (imr + eta) AS d, sum(selected)::DOUBLE AS m, any_value(p) AS p,
                    any_value(n) AS n FROM facts JOIN eta USING (nation) GROUP BY 1, 2, 3),
    spread AS (SELECT *, p * (1 - p) / (n * power(exp(-eta * eta / 2) / sqrt(2 * pi()), 2)) * m * d * m * d AS e FROM cell),
    sums AS (SELECT sum(m) AS s0, sum(m * l) AS s1, sum(m * l * l) AS s2, sum(m * d) AS d0, sum(m * d * l) AS d1,
                    sum(m * d * l * l) AS d2, sum(e) AS e0, sum(e * l) AS e1, sum(e * l * l) AS e2 FROM spread),
    middle AS (SELECT a, b, sigma2, s0 - b * b / sigma2 * (d0 - e0) AS a0, s1 - b * b / sigma2 * (d1 - e1) AS a1,
                      s2 - b * b / sigma2 * (d2 - e2) AS a2, s2 / (s0 * s2 - s1 * s1) AS b0, -s1 / (s0 * s2 - s1 * s1) AS b1,
                      s0 / (s0 * s2 - s1 * s1) AS b2 FROM sums, v)
    SELECT '(Intercept)' AS term, ROUND(a, 2) AS estimate,
           ROUND(sqrt(sigma2 * (b0 * b0 * a0 + 2 * b0 * b1 * a1 + b1 * b1 * a2)), 3) AS std_error FROM middle
    UNION ALL
    SELECT 'inv_mills_ratio', ROUND(b, 2),
           ROUND(sqrt(sigma2 * (b1 * b1 * a0 + 2 * b1 * b2 * a1 + b2 * b2 * a2)), 3) FROM middle
    """
)
def heckman_errors(spark, folder):
    """Corrected standard errors of a selection model with a selection effect per nation."""
    found = fit_heckman(facts(spark, folder), "selected", [Cat("nation")], "price", [])
    tidy = found.outcome.tidy(spark)
    return tidy.select("term", F.round("estimate", 2).alias("estimate"), F.round("std_error", 3).alias("std_error"))


@query(
    f"""
    WITH RECURSIVE {_FACTS}, {_quantiles('nation')},
    stage AS (SELECT regr_slope(balance, month) AS k, regr_intercept(balance, month) AS c FROM facts),
    sel AS (SELECT price AS y, c + k * month AS x, imr AS l, imr * (imr + eta) AS delta
            FROM facts JOIN eta USING (nation), stage WHERE selected = 1),
    m AS (SELECT count(*) AS n, avg(y) AS y, avg(x) AS x, avg(l) AS l, avg(delta) AS delta, var_pop(y) AS yy, var_pop(x) AS xx,
                 var_pop(l) AS ll, covar_pop(x, l) AS xl, covar_pop(x, y) AS xy, covar_pop(l, y) AS ly FROM sel),
    b AS (SELECT *, (xy * ll - ly * xl) / (xx * ll - xl * xl) AS b1, (ly * xx - xy * xl) / (xx * ll - xl * xl) AS b2 FROM m),
    f AS (SELECT *, sqrt(yy - b1 * xy - b2 * ly + delta * b2 * b2) AS sigma FROM b)
    SELECT n, ROUND(y - b1 * x - b2 * l, 1) AS intercept, ROUND(b1, 4) AS b_hat, ROUND(b2, 2) AS b_lambda,
           ROUND(sigma, 3) AS sigma, ROUND(b2 / sigma, 5) AS rho FROM f
    """
)
def iv_selection(spark, folder):
    """Selection model whose endogenous regressor is a first-stage prediction."""
    _, found = fit_iv_selection(
        facts(spark, folder), {"balance_hat": ("balance", ["month"])}, "selected", [Cat("nation")], "price", []
    )
    b = found.outcome.coefficients
    data = [
        (
            found.outcome.n,
            round(b["(Intercept)"], 1),
            round(b["balance_hat"], 4),
            round(b["inv_mills_ratio"], 2),
            round(found.sigma, 3),
            round(found.rho, 5),
        )
    ]
    return spark.createDataFrame(
        data, "n bigint, intercept double, b_hat double, b_lambda double, sigma double, rho double"
    )
