"""Newton fits, families and spreads: sizes, shared passes, plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.groups import contingency_table
from tessera.operators.reshape import spread
from tessera.stats.design import Cat, Inter, Num
from tessera.stats.discrete import binary_family, logit, probit
from tessera.stats.selection import heckman, heckman_family


def newton(x, y):
    """Logit by dense Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        info = (x.T * (p * (1 - p))) @ x
        beta = beta + np.linalg.solve(info, x.T @ (y - p))
    return beta, np.linalg.inv(info)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    n = 4000
    g, h = rng.integers(0, 4, n), rng.integers(0, 5, n)
    x = rng.normal(size=n).round(2)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 * (g == 1) - 0.5 * (h == 3) + 0.6 * x - 0.2)))).astype(int)
    wage = 2 + 0.3 * x + 0.2 * (g == 2) + rng.normal(size=n)
    rows = [(f"g{a}", f"h{b}", float(c), int(d), float(w), None if i % 9 == 0 else float(w) / 2) for i, (a, b, c, d, w) in enumerate(zip(g, h, x, y, wage))]
    df = spark.createDataFrame(rows, "g string, h string, x double, y int, wage double, half double").repartition(4).cache()
    return df, dict(g=g, h=h, x=x, y=y)


@pytest.mark.parametrize("coding", ["treatment", "centered", "sum"])
def test_two_factors_and_a_number(sample, coding, monkeypatch):
    df, v = sample
    x = np.column_stack([np.ones(len(v["x"])), *[v["g"] == i for i in (1, 2, 3)], *[v["h"] == i for i in (1, 2, 3, 4)], v["x"]]).astype(float)
    beta, vcov = newton(x, v["y"])
    terms = [Cat("g"), Cat("h", coding=coding), Num("x")]
    dense = logit(df, "y", terms).fit
    monkeypatch.setattr("tessera.stats.gram.ELIMINATE_FROM", 2)
    by_level = logit(df, "y", terms).fit
    assert dense.names == by_level.names == dense.kept
    np.testing.assert_allclose(dense.beta, by_level.beta, atol=1e-9)
    np.testing.assert_allclose(dense.vcov, by_level.vcov, atol=1e-9)
    if coding == "treatment":
        np.testing.assert_allclose(dense.beta, beta, atol=1e-8)
        np.testing.assert_allclose(dense.vcov, vcov, atol=1e-8)


def test_aliased_columns_and_products(sample):
    df, v = sample
    twice = df.withColumn("twin", F.concat(F.lit("t"), F.substring("g", 2, 1)))
    fit = logit(twice, "y", [Cat("g"), Cat("twin"), Num("x")]).fit
    assert [c for c in fit.names if c not in fit.kept] == ["twint1", "twint2", "twint3"]
    x = np.column_stack([np.ones(len(v["x"])), v["x"], v["g"] == 1, v["g"] == 2, v["g"] == 3, *[(v["g"] == i) * v["x"] for i in (1, 2, 3)]]).astype(float)
    fit = logit(df, "y", [Num("x"), Cat("g"), Inter(Cat("g"), Num("x"))]).fit
    np.testing.assert_allclose(fit.beta, newton(x, v["y"])[0], atol=1e-8)


def test_five_thousand_levels_without_an_expression_per_level(spark):
    rng = np.random.default_rng(3)
    levels, each = 5000, 20
    effect = rng.normal(size=levels) * 0.3
    g = np.repeat(np.arange(levels), each)
    x = rng.normal(size=len(g)).round(1)
    y = (rng.random(len(g)) < 1 / (1 + np.exp(-(effect[g] + 0.5 * x)))).astype(int)
    y[::each], y[1::each] = 0, 1  # no level without both outcomes
    data = {"g": [f"level {i}" for i in g], "x": x, "y": y}
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(data))
    found = probit(df, "y", [Num("x"), Cat("g")])
    assert len(found.fit.kept) == levels + 1 and 0.2 < found.fit.coefficients["x"] < 0.4
    plan = found.score(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 10 and "Join" in plan
    # at the maximum, fitted and observed successes agree in every level
    gaps = found.score(df).groupBy("g").agg(F.sum(F.col("y")).alias("k"), F.sum("__mu").alias("m"))
    assert found.fit.errors["x"] > 0 and gaps.count() == levels


def jobs_of(spark, work):
    group = f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_eight_models_share_their_passes(spark, sample):
    df, _ = sample
    outcomes = [[], [Num("x")], [Num("x"), Cat("g")], [Cat("h")], [Num("half")], [Num("half"), Cat("g")], [Cat("g")], [Num("x"), Cat("h")]]
    models = {str(i): ([Cat("g"), Num("x")] if i % 2 else [Cat("h"), Num("x")], out) for i, out in enumerate(outcomes)}
    one, single = jobs_of(spark, lambda: heckman(df, "y", *models["3"][:1], "wage", models["3"][1]))
    many, together = jobs_of(spark, lambda: heckman_family(df, "y", "wage", models))
    assert together <= 2 * single
    for name in ("2", "4", "7"):
        sel, out = models[name]
        alone = heckman(df, "y", sel, "wage", out)
        assert alone.outcome.n == many[name].outcome.n and alone.outcome.kept == many[name].outcome.kept
        np.testing.assert_allclose(alone.outcome.beta, many[name].outcome.beta, rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(alone.outcome.vcov, many[name].outcome.vcov, rtol=1e-6, atol=1e-9)
    assert many["4"].outcome.n < many["3"].outcome.n == one.outcome.n


def test_family_of_logits_and_what_cannot_be_fitted(spark, sample):
    df, _ = sample
    both = binary_family(df, "y", {"a": [Num("x")], "b": [Num("x"), Cat("g")]}, "logit")
    np.testing.assert_allclose(both["a"].fit.beta, logit(df, "y", [Num("x")]).fit.beta, atol=1e-12)
    apart = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "x double, y int")
    with pytest.raises(RuntimeError):
        logit(apart, "y", [Num("x")], max_iter=12)
    with pytest.raises(ValueError):
        logit(df.filter("x > 99"), "y", [Num("x")])
    level_without_hits = df.withColumn("y", F.when(F.col("g") == "g1", 0).otherwise(F.col("y")))
    assert math.isclose(logit(df, "y", []).fit.coefficients["(Intercept)"], math.log(df.filter("y = 1").count() / df.filter("y = 0").count()), rel_tol=1e-9)
    with pytest.raises(RuntimeError):
        logit(level_without_hits, "y", [Cat("g")], max_iter=15)


def test_spread_shows_unlisted_levels(spark):
    df = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (2, "a"), (3, None)], "k int, level string")
    wide = spread(df, ["k"], "level", F.count(F.lit(1)), first=["c", "z"])
    assert wide.columns == ["k", "c", "z", "a", "b"]
    assert sorted(tuple(r) for r in wide.na.fill(0).collect()) == [(1, 1, 0, 0, 1), (2, 0, 0, 2, 0), (3, 0, 0, 0, 0)]
    with pytest.raises(ValueError, match="a.*b"):
        spread(df, ["k"], "level", F.count(F.lit(1)), first=["c"], only_first=True)
    with pytest.raises(ValueError, match="key"):
        spread(df.withColumnRenamed("k", "a"), ["a"], "level", F.count(F.lit(1)))


def test_grid_stands_in_many_partitions(spark):
    rows = [(i % 97, f"v{i % 101}", i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    grid = contingency_table(df, ["a", "b", "c"], {"c": [9]})
    assert grid.count() == 97 * 101 * 4 and grid.agg(F.sum("freq")).head()[0] == 500
    assert grid.filter("freq > 0").count() == len(set(rows)) and grid.filter("c = 9").agg(F.sum("freq")).head()[0] == 0
    assert grid.rdd.getNumPartitions() > 1
    assert contingency_table(df.limit(0), ["a", "b"]).count() == 0
