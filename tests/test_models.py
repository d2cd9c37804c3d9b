"""Designs, fits and selection models against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.groups import cell_text, contingency_table, crosstab, keep_large_groups
from tessera.stats.design import Cat, Inter, Num, resolve
from tessera.stats.gram import product_sums
from tessera.stats.linear import iv, model_family, nested_test, ols, robust
from tessera.stats.report import coefficient_table
from tessera.stats.selection import heckman


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(12)
    n = 600
    g, h = rng.integers(0, 3, n), rng.integers(0, 12, n)
    x, z, w = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    x = x + 0.6 * z + 0.5 * w
    y = 1 + 0.5 * x - 0.3 * g + 0.05 * h + 0.2 * x * z + rng.normal(size=n)
    chosen = (0.3 + 0.5 * (g == 1) + 0.4 * z + rng.normal(size=n) > 0).astype(int)
    rows = [(f"g{a}", int(b), *map(float, r), int(c)) for a, b, *r, c in zip(g, h, x, z, w, y, chosen)]
    df = spark.createDataFrame(rows, "g string, h int, x double, z double, w double, y double, chosen int").cache()
    return df, dict(g=g, h=h, x=x, z=z, w=w, y=y, chosen=chosen)


def columns(*parts):
    return np.column_stack([np.ones(len(parts[0])), *parts])


def lstsq(a, y):
    return np.linalg.lstsq(a, y, rcond=None)[0]


def test_product_sums_match_a_dense_product(sample):
    df, v = sample
    keys = [("1",), ("x",), ("g", "g1"), ("g", "g2"), ("h", "11"), (("g", "g1"), ("x",)), (("g", "g2"), ("h", "3")), (("x",), ("z",))]
    dense = np.column_stack([
        np.ones(len(v["x"])), v["x"], v["g"] == 1, v["g"] == 2, v["h"] == 11, (v["g"] == 1) * v["x"],
        (v["g"] == 2) * (v["h"] == 3), v["x"] * v["z"],
    ]).astype(float)
    numbers = {"x": F.col("x"), "z": F.col("z")}
    assert np.allclose(product_sums(df, keys, numbers), dense.T @ dense)
    assert np.allclose(product_sums(df, keys, numbers, F.exp("z")), dense.T @ (dense * np.exp(v["z"])[:, None]))


def test_levels_keep_the_order_of_their_type(sample):
    design, n = resolve(sample[0], [Cat("h"), Num("x")])
    assert n == 600 and design.levels["h"] == [str(i) for i in range(12)]


def test_factor_by_factor_and_number_by_number(sample):
    df, v = sample
    fit = ols(df.filter("h < 3"), "y", [Cat("g"), Cat("h"), Inter(Cat("g"), Cat("h"))])
    for a in range(3):
        for b in range(3):
            cell = (v["g"] == a) & (v["h"] == b)
            x = fit.design.row({"g": f"g{a}", "h": b})
            assert math.isclose(float(x @ fit.beta), v["y"][cell].mean(), rel_tol=1e-8)
    fit = ols(df, "y", [Num("x"), Num("z"), Inter(Num("x"), Num("z"))])
    want = lstsq(columns(v["x"], v["z"], v["x"] * v["z"]), v["y"])
    assert np.allclose(fit.beta, want)


def test_sum_coding_gives_deviations_from_the_mean_of_means(sample):
    df, v = sample
    fit = ols(df, "y", [Cat("g", coding="sum")])
    means = [v["y"][v["g"] == i].mean() for i in range(3)]
    assert np.allclose(fit.beta, [np.mean(means), means[0] - np.mean(means), means[1] - np.mean(means)])


def test_nested_family_and_f_test(spark, sample):
    df, v = sample
    fits = model_family(df, "y", {"a": ["x"], "b": ["x", "z", "g"]})
    small, large = columns(v["x"]), columns(v["x"], v["z"], v["g"] == 1, v["g"] == 2).astype(float)
    assert np.allclose(fits["a"].beta, lstsq(small, v["y"])) and np.allclose(fits["b"].beta, lstsq(large, v["y"]))
    rss = [((v["y"] - m @ lstsq(m, v["y"])) ** 2).sum() for m in (small, large)]
    f = ((rss[0] - rss[1]) / 3) / (rss[1] / (600 - 5))
    assert math.isclose(nested_test(spark, fits["a"], fits["b"]).head()["f"], f, rel_tol=1e-8)
    table = coefficient_table(spark, fits, statistics={"N": "n", "R2": "r_squared"}).collect()
    assert table[-2].asDict()["a"] == "600" and table[-1]["b"] == f"{1 - rss[1] / ((v['y'] - v['y'].mean()) ** 2).sum():.3f}"


def test_robust_errors(sample):
    df, v = sample
    fit = robust(df, ols(df, "y", ["x", "z"]))
    a = columns(v["x"], v["z"])
    e, bread = v["y"] - a @ lstsq(a, v["y"]), np.linalg.inv(a.T @ a)
    want = 600 / 597 * bread @ (a.T * e**2) @ a @ bread
    assert np.allclose(fit.vcov, want)


def test_instruments(sample):
    df, v = sample
    same = iv(df.withColumn("copy", F.col("x")), "y", ["x"], ["z"], ["copy"]).fit
    assert np.allclose(sorted(same.beta), sorted(lstsq(columns(v["x"], v["z"]), v["y"])))
    over = iv(df, "y", ["x"], [], ["z", "w"]).fit
    q, a = columns(v["z"], v["w"]), columns(v["x"])
    fitted = q @ lstsq(q, a)
    assert np.allclose(over.beta, lstsq(fitted, v["y"]))


def test_selection_with_several_regressors(sample):
    df, v = sample
    found = heckman(df, "chosen", [Cat("g"), Num("z")], "y", [Num("x"), Cat("g")])
    w = columns(v["g"] == 1, v["g"] == 2, v["z"]).astype(float)
    beta = np.zeros(4)
    phi = lambda t: np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda t: 0.5 * math.erfc(-t / math.sqrt(2)))
    for _ in range(30):
        eta = w @ beta
        p = cdf(eta)
        info = (w.T * (phi(eta) ** 2 / (p * (1 - p)))) @ w
        beta = beta + np.linalg.solve(info, w.T @ ((v["chosen"] - p) * phi(eta) / (p * (1 - p))))
    eta = w @ beta
    lam = (phi(eta) / cdf(eta))[v["chosen"] == 1]
    sel = v["chosen"] == 1
    x = np.column_stack([np.ones(sel.sum()), v["x"][sel], v["g"][sel] == 1, v["g"][sel] == 2, lam]).astype(float)
    b = lstsq(x, v["y"][sel])
    delta = lam * (lam + eta[sel])
    sigma2 = ((v["y"][sel] - x @ b) ** 2).mean() + delta.mean() * b[-1] ** 2
    rho2, bread = b[-1] ** 2 / sigma2, np.linalg.inv(x.T @ x)
    q = rho2 * (x.T * delta) @ w[sel] @ np.linalg.inv(info) @ (w[sel].T * delta) @ x
    vcov = sigma2 * bread @ ((x.T * (1 - rho2 * delta)) @ x + q) @ bread
    assert np.allclose(found.outcome.beta, b, rtol=1e-5) and np.allclose(found.outcome.vcov, vcov, rtol=1e-4, atol=1e-7)
    assert math.isclose(found.sigma, math.sqrt(sigma2), rel_tol=1e-6)


def test_rows_without_a_stratum_belong_to_no_group(spark):
    df = spark.createDataFrame([(None,)] * 12 + [("a",)] * 12 + [("b",)] * 3, "k string")
    assert keep_large_groups(df, "k", 11).distinct().collect() == [("a",)]
    assert keep_large_groups(df, "k", 11, null_groups=True).distinct().count() == 2


def test_contingency_keeps_every_observed_level(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (3, None)], "a int, b string")
    cells = {(r.a, r.b): r.freq for r in contingency_table(df, ["a", "b"], {"b": ["z"]}).collect()}
    assert sum(cells.values()) == 3 and len(cells) == 9 and cells[3, "y"] == 1 and cells[2, "z"] == 0


def test_cells_print_plain_numbers(spark):
    df = spark.createDataFrame([(4.0, 12, 1.25), (12345678.25, 5, 10.0), (0.5, 1, 0.04)], "m double, n int, s double")
    out = [tuple(r) for r in df.select(cell_text("m", F.col("n")), cell_text("m", F.col("s"), extra_digits=1)).collect()]
    assert out == [("4 (12)", "4 (1.3)"), ("12345678.25 (5)", "12345678.25 (10)"), ("0.5 (1)", "0.5 (0)")]


def test_margins_add_up_cells(spark):
    rng = np.random.default_rng(0)
    rows = [(str(rng.integers(3)), str(rng.integers(4)), float(v)) for v in rng.normal(1000, 5, 300)] + [("0", "0", None), ("9", "9", None)]
    df = spark.createDataFrame(rows, "r string, c string, v double")
    cells = {(r.r, r.c): r for r in crosstab(df, "r", "c", "v", ["0", "9"], ["0"]).collect()}
    values = np.array([v for a, _, v in rows if a == "0" and v is not None])
    assert cells["0", "Total"].n == len(values) and math.isclose(cells["0", "Total"].sd, values.std(ddof=1), rel_tol=1e-6)
    assert cells["9", "Total"].n == 0 and cells["9", "Total"].mean is None and cells["9", "Total"].sd is None
