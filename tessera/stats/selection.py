"""Two-step sample selection models.

Step one is a probit of the selection flag, step two least squares on the
selected rows with the inverse Mills ratio added. The corrected covariance
needs one more cross-product pass. Models of a family share every pass; only
k x k matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.semantics import is_true
from tessera.sources.stages import releases_stages
from tessera.sources.tables import stage_derived
from tessera.stats.design import INTERCEPT, Design, Num, Wanted, as_terms, complete_rows, resolve_all, used_columns
from tessera.stats.discrete import DiscreteFit, binary_family, mills_ratio
from tessera.stats.fit import Fit
from tessera.stats.gram import SumSpec, sum_products
from tessera.stats.linear import Moments, moment_spec, ols, solve

LAMBDA = "inv_mills_ratio"


@dataclass
class SelectionFit:
    """Both equations, and the error structure linking them."""

    selection: DiscreteFit
    outcome: Fit
    sigma: float
    rho: float

    def glance(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                self.selection.fit.n,
                self.outcome.n,
                float(self.outcome.df_residual),
                self.sigma,
                self.rho,
                self.outcome.summary["r_squared"],
                self.outcome.summary["adj_r_squared"],
            )
        ]
        return spark.createDataFrame(
            rows,
            "n bigint, n_selected bigint, df_residual double, sigma double, rho double, "
            "r_squared double, adj_r_squared double",
        )


def heckman(
    df: DataFrame, selected: str, selection_terms: Sequence, y: str, outcome_terms: Sequence
) -> SelectionFit:
    """Two-step estimate of an outcome seen only for selected rows.

    A row counts when its selection variables are known and, if it is
    selected, its outcome variables as well.
    """
    return heckman_family(df, selected, y, {y: (selection_terms, outcome_terms)})[y]


@releases_stages
def heckman_family(
    df: DataFrame, selected: str, y: str, models: Mapping[str, tuple[Sequence, Sequence]]
) -> dict[str, SelectionFit]:
    """Selection models of one outcome: ``{name: (selection terms, outcome terms)}``.

    Each model deletes rows by its own terms. All of them read the same staged
    rows: a Newton step, the outcome's cross products and the correction of
    the covariance are one job each, whatever the number of models.
    """
    sel = {name: as_terms(df, s) for name, (s, _) in models.items()}
    out = {name: as_terms(df, o) for name, (_, o) in models.items()}
    chosen = is_true(F.col(selected).cast("int") == 1)
    usable = {
        name: F.coalesce(complete_rows(df, sel[name], [selected]) & (~chosen | complete_rows(df, out[name], [y])), F.lit(False))
        for name in models
    }
    inside = {name: f"__use{i}" for i, name in enumerate(models)}
    columns = dict.fromkeys([selected, y, *(c for n in models for c in used_columns([*sel[n], *out[n]]))])
    rows = df.select(*columns, *[usable[n].alias(m) for n, m in inside.items()])
    rows = stage_derived(rows.filter(F.exists(F.array(*inside.values()), lambda v: v)))
    firsts = binary_family(rows, selected, sel, "probit", {n: F.col(m) for n, m in inside.items()})

    scored, ratios, etas = rows.filter(chosen), {}, {}
    for i, name in enumerate(models):
        etas[name], ratios[name] = f"__eta{i}", f"__ratio{i}"
        scored = mills_ratio(firsts[name].score(scored, etas[name], f"__mu{i}"), ratios[name], etas[name], f"__mu{i}").drop(f"__mu{i}")
    kept = stage_derived(scored)
    terms = {name: [*out[name], Num(LAMBDA)] for name in models}
    wanted = [Wanted(terms[n], [y], F.col(inside[n]), columns={LAMBDA: F.col(ratios[n])}) for n in models]
    designs = dict(zip(models, resolve_all(kept, wanted)))
    named = {n: {**d.numbers, LAMBDA: F.col(ratios[n]) - F.lit(d.shifts[LAMBDA])} for n, (d, _) in designs.items()}
    asked = [moment_spec(d, y, named[n], F.when(F.col(inside[n]), F.lit(1.0))) for n, (d, _) in designs.items()]
    products = {n: Moments(d.raw_keys, sums.dense(), d.shifts[y], size).model(d) for (n, (d, size)), sums in zip(designs.items(), sum_products(kept, asked))}
    plain = {n: solve(d.names, products[n], size, y, d) for n, (d, size) in designs.items()}

    # both equations' columns over one set of shifts, so that one pass sums them all
    sides, specs = {}, []
    for n, (design, _) in designs.items():
        first = firsts[n].fit
        shifts = {**first.design.shifts, **design.shifts}
        x_design, w_design = Design(design.terms, design.levels, shifts), Design(first.design.terms, first.design.levels, shifts)
        keys = list(dict.fromkeys([*x_design.raw_keys, *w_design.raw_keys]))
        ratio = F.col(ratios[n])
        delta = F.greatest(ratio * (ratio + F.col(etas[n])), F.lit(0.0))
        numbers = {**x_design.numbers, **w_design.numbers, LAMBDA: ratio - F.lit(shifts[LAMBDA])}
        specs.append(SumSpec(keys, numbers, F.when(F.col(inside[n]), delta)))
        x_map = x_design.mapping(keys)[:, [design.names.index(c) for c in plain[n].kept]]
        w_map = w_design.mapping(keys)[:, [first.names.index(c) for c in first.kept]]
        sides[n] = np.hstack([x_map, w_map])
    corrected = {}
    for n, sums in zip(models, sum_products(kept, specs)):
        weighted = (sides[n].T @ sums.dense() @ sides[n]).astype(float)
        corrected[n] = _corrected(firsts[n], plain[n], products[n], designs[n][0], weighted)
    return corrected


def _corrected(first: DiscreteFit, plain: Fit, products: np.ndarray, design: Design, weighted: np.ndarray) -> SelectionFit:
    """Error structure and covariance from the products weighted by the ratio's slope."""
    n, k = plain.n, len(plain.kept)
    x_delta_x, x_delta_w = weighted[:k, :k], weighted[:k, k:]
    b_lambda = plain.beta[plain.kept.index(LAMBDA)]
    constant = plain.kept.index(INTERCEPT)
    sigma2 = plain.summary["rss"] / n + x_delta_x[constant, constant] / n * b_lambda**2
    sigma = float(np.sqrt(sigma2))
    rho = float(b_lambda / sigma)
    bread = plain.vcov / plain.summary["sigma"] ** 2
    index = [design.names.index(c) for c in plain.kept]
    xx = products[np.ix_(index, index)].astype(float)
    extra = x_delta_w @ first.fit.vcov @ x_delta_w.T
    vcov = sigma2 * bread @ (xx - rho**2 * x_delta_x + rho**2 * extra) @ bread
    parameters = len(first.fit.kept) + k + 2
    outcome = Fit(**{**plain.__dict__, "vcov": vcov, "df_residual": first.fit.n - parameters})
    return SelectionFit(first, outcome, sigma, rho)


def iv_selection(
    df: DataFrame,
    first_stages: Mapping[str, tuple[str, Sequence]],
    selected: str,
    selection_terms: Sequence,
    y: str,
    outcome_terms: Sequence,
) -> tuple[dict[str, Fit], SelectionFit]:
    """Selection model whose endogenous regressors are first-stage predictions.

    ``first_stages`` maps the name of a predicted column to (endogenous
    column, first-stage terms). Predictions stay on their own row; a row whose
    first stage is incomplete has none and drops out.
    """
    fits = {}
    for name, (column, terms) in first_stages.items():
        fit = ols(df, column, terms)
        fits[name] = fit
        known = complete_rows(df, fit.design.terms, [column])
        df = fit.predict(df, "__fitted").withColumn(name, F.when(known, F.col("__fitted"))).drop("__fitted")
    return fits, heckman(df, selected, selection_terms, y, [*first_stages, *outcome_terms])
