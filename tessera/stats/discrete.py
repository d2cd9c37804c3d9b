"""Logit and probit by Newton steps on grouped cells.

Rows with equal regressors become one cell with a count and a number of
successes, so a model of factors is fitted on as many rows as there are level
combinations. Every step joins the coefficients by level, sums score,
information and likelihood in one job for all models of a family, and solves
the small system on the driver. No expression grows with the levels.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.pvalues import erfc
from tessera.sources.stages import releases_stages
from tessera.sources.tables import stage_derived
from tessera.stats.design import INTERCEPT, Design, Wanted, as_terms, complete_rows, resolve_all, used_columns
from tessera.stats.fit import Fit
from tessera.stats.gram import CellSums, SumSpec, solve_normal, solving_keys, sum_products

ETA, MU = "__eta", "__mu"
RESIDUAL = "__residual"
#: A step this small (in units of its own information) is the last one.
DECREMENT = 1e-14
HALVINGS = 30


def density(eta) -> Column:
    """Standard normal density."""
    eta = F.col(eta) if isinstance(eta, str) else eta
    return F.exp(-eta * eta / 2) / F.lit(math.sqrt(2 * math.pi))


def probability(eta: Column, link: str) -> Column:
    """Fitted probability, kept off 0 and 1 by the least double can hold."""
    if link == "logit":
        return 1 / (1 + F.exp(-eta))
    return F.greatest(erfc(-eta / math.sqrt(2)) / 2, F.lit(1e-300))


@dataclass
class DiscreteFit:
    """A binary-response fit and the means to score rows with it."""

    fit: Fit
    link: str

    def score(self, rows: DataFrame, eta: str = ETA, mu: str = MU) -> DataFrame:
        """Add the linear predictor and the fitted probability to complete rows."""
        return self.fit.predict(rows, eta).withColumn(mu, probability(F.col(eta), self.link))


class _Newton:
    """One model on its way to the maximum."""

    def __init__(self, place: int, name: str, design: Design, n: int, mask: Column, share: float, link: str):
        if n == 0:
            raise ValueError(f"no complete rows for {name}")
        self.place, self.name, self.design, self.n, self.mask, self.link = place, name, design, n, mask, link
        inside = min(max(share, 0.5 / n), 1 - 0.5 / n)
        start = math.log(inside / (1 - inside)) if link == "logit" else NormalDist().inv_cdf(inside)
        self.beta = {c: 0.0 for c in design.names} | {INTERCEPT: start}
        self.before: tuple[float, dict[str, float]] | None = None
        self.kept: list[str] = []
        self.halvings = 0
        self.done = False
        self.loglik, self.vcov = -math.inf, np.zeros((0, 0))

    @property
    def eta(self) -> str:
        return f"__eta{self.place}"

    def attach(self, cells: DataFrame) -> DataFrame:
        return self.design.with_value(cells, self.beta, self.eta)

    def spec(self) -> SumSpec:
        """Information, score (through the working residual) and likelihood of every cell."""
        eta = F.col(self.eta)
        eta = F.greatest(F.least(eta, F.lit(36.0)), F.lit(-36.0)) if self.link == "probit" else eta
        n, hits = F.col("__n"), F.col("__hits")
        p, q = probability(eta, self.link), probability(-eta, self.link)
        slope = p * q if self.link == "logit" else density(eta)
        weight = F.when(self.mask, n * slope * slope / (p * q))
        residual = (hits / n * q - (1 - hits / n) * p) / slope
        gain = F.when(hits > 0, hits * F.ln(p)).otherwise(0.0) + F.when(hits < n, (n - hits) * F.ln(q)).otherwise(0.0)
        keys = [*solving_keys(self.design), (RESIDUAL,)]
        return SumSpec(keys, {**self.design.numbers, RESIDUAL: residual}, weight, {"loglik": gain})

    def step(self, sums: CellSums) -> None:
        """Accept the point and move on, or halve the step that led to it."""
        loglik = sums.totals["loglik"]
        if self.before and loglik < self.before[0] - 1e-9 * abs(self.before[0]):
            self.halvings += 1
            if self.halvings > HALVINGS:
                raise RuntimeError(f"no step raises the likelihood of {self.name}")
            old = self.before[1]
            self.beta = {c: (old[c] + b) / 2 for c, b in self.beta.items()}
            return
        self.halvings, self.before, self.loglik = 0, (loglik, self.beta), loglik
        found = solve_normal(sums, self.design, self.kept or None)
        self.kept, self.vcov = found.kept, found.vcov
        self.beta = {**self.beta, **{c: self.beta[c] + float(d) for c, d in zip(found.kept, found.solution)}}
        self.done = found.decrement < DECREMENT

    def result(self, share: float) -> DiscreteFit:
        n, k = self.n, len(self.kept)
        null = 0.0 if share in (0, 1) else n * (share * math.log(share) + (1 - share) * math.log(1 - share))
        summary = {
            "log_likelihood": self.loglik, "deviance": -2 * self.loglik, "null_deviance": -2 * null,
            "aic": -2 * self.loglik + 2 * k,
        }
        beta = np.array([self.beta[c] for c in self.kept])
        fit = Fit(self.name, self.design.names, self.kept, beta, self.vcov, n, n - k, False, summary, self.design)
        return DiscreteFit(fit, self.link)


@releases_stages
def binary_family(
    df: DataFrame,
    y: str,
    models: Mapping[str, Sequence],
    link: str,
    masks: Mapping[str, Column] | None = None,
    max_iter: int = 100,
) -> dict[str, DiscreteFit]:
    """Logit or probit fits of a 0/1 (or boolean) column, all models in the same jobs.

    Each model deletes rows by its own terms, and by its mask. Cells are
    written once (an eager job); a step is one job for all models that have
    not converged. A model that has not after ``max_iter`` steps raises.
    Aliased columns are left out, earlier ones stay.
    """
    terms = {name: as_terms(df, t) for name, t in models.items()}
    used = list(dict.fromkeys(c for t in terms.values() for c in used_columns(t)))
    inside = {
        f"__in{i}": F.coalesce(complete_rows(df, t, [y]) & (masks or {}).get(name, F.lit(True)), F.lit(False))
        for i, (name, t) in enumerate(terms.items())
    }
    rows = df.select(*used, F.col(y).cast("double").alias("__y"), *[c.alias(n) for n, c in inside.items()])
    rows = rows.filter(F.exists(F.array(*inside), lambda v: v))
    cells = rows.groupBy(*used, *inside).agg(F.count("*").cast("double").alias("__n"), F.sum("__y").alias("__hits"))
    cells = stage_derived(cells)
    wanted = [Wanted(t, (), F.col(m), F.col("__n"), totals={"hits": F.col("__hits")}) for t, m in zip(terms.values(), inside)]
    designs = resolve_all(cells, wanted)
    shares = [w.found["hits"] / n if n else 0.0 for w, (_, n) in zip(wanted, designs)]
    fits = []
    for i, (name, m, (design, n)) in enumerate(zip(terms, inside, designs)):
        label = y if len(terms) == 1 else f"{y} ({name})"
        fits.append(_Newton(i, label, design, n, F.col(m), shares[i], link))
    for _ in range(max_iter):
        open_fits = [f for f in fits if not f.done]
        if not open_fits:
            break
        frame = cells
        for f in open_fits:
            frame = f.attach(frame)
        for f, sums in zip(open_fits, sum_products(frame, [f.spec() for f in open_fits], grouped=True)):
            f.step(sums)
    late = [f.name for f in fits if not f.done]
    if late:
        raise RuntimeError(f"the {link} fit of {', '.join(late)} has not converged after {max_iter} steps")
    out = {name: f.result(share) for name, f, share in zip(terms, fits, shares)}
    for found in out.values():
        found.fit.response = y
    return out


def logit(df: DataFrame, y: str, terms: Sequence, **options) -> DiscreteFit:
    return binary_family(df, y, {y: terms}, "logit", **options)[y]


def probit(df: DataFrame, y: str, terms: Sequence, **options) -> DiscreteFit:
    return binary_family(df, y, {y: terms}, "probit", **options)[y]


def mills_ratio(scored: DataFrame, name: str = "imr", eta: str = ETA, mu: str = MU) -> DataFrame:
    """Inverse Mills ratio of scored rows."""
    return scored.withColumn(name, density(eta) / F.col(mu))


def probit_imr(df: DataFrame, selected: str, terms: Sequence) -> tuple[DataFrame, DiscreteFit]:
    """Probit of a selection flag; complete rows with eta, probability and Mills ratio."""
    found = probit(df, selected, terms)
    rows = df.filter(complete_rows(df, found.fit.design.terms, [selected]))
    scored = mills_ratio(found.score(rows))
    return scored.withColumnsRenamed({ETA: "eta", MU: "probability"}), found
