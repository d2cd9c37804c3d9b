"""Least squares, model families, instruments, imputation, nested tests.

One pass sums the cross products of a model's columns; everything else is
algebra on that small matrix. Several models on the same rows share one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.pvalues import p_chi2, p_fisher
from tessera.sources.stages import releases_stages
from tessera.sources.tables import stage_derived
from tessera.stats.design import INTERCEPT, Design, Num, as_terms, complete_rows, resolve, used_columns
from tessera.stats.fit import Fit
from tessera.stats.gram import SumSpec, independent, inverse, product_sums, sum_products


@dataclass
class Moments:
    """Cross products of raw design columns and the centred response."""

    raw_keys: list[tuple]
    matrix: np.ndarray
    shift: float
    n: int

    def model(self, design: Design) -> np.ndarray:
        """Cross products of [model columns, response] in original units."""
        size = len(self.raw_keys)
        mapping = np.zeros((size + 1, len(design.names) + 1), dtype=np.longdouble)
        mapping[:size, :-1] = design.mapping(self.raw_keys)
        mapping[size, -1] = 1.0
        mapping[self.raw_keys.index(("1",)), -1] = self.shift
        return mapping.T @ self.matrix.astype(np.longdouble) @ mapping


def moment_spec(design: Design, y: str, numbers: Mapping[str, Column] | None = None, weight: Column | None = None) -> SumSpec:
    """What a pass must sum for a model and its centred response."""
    response = F.col(y).cast("double") - F.lit(design.shifts[y])
    return SumSpec([*design.raw_keys, ("__response",)], {**(numbers or design.numbers), "__response": response}, weight)


def moments(rows: DataFrame, design: Design, y: str, n: int) -> Moments:
    """The pass over the rows."""
    sums = sum_products(rows, [moment_spec(design, y)])[0].dense()
    return Moments(design.raw_keys, sums, design.shifts[y], n)


def solve(names: list[str], products: np.ndarray, n: int, y: str, design: Design | None) -> Fit:
    """Least squares from cross products of [columns, response]."""
    xx, xy, yy = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    kept = independent(xx)
    used, inv = xx[np.ix_(kept, kept)], inverse(xx[np.ix_(kept, kept)])
    beta = inv @ xy[kept]
    beta = beta + inv @ (xy[kept] - used @ beta)
    rank = len(kept)
    rss = max(yy - 2 * beta @ xy[kept] + beta @ used @ beta, 0.0)
    dof = n - rank
    sigma2 = rss / dof if dof > 0 else np.longdouble("nan")
    has_intercept = INTERCEPT in names
    tss = yy - xy[names.index(INTERCEPT)] ** 2 / n if has_intercept else yy
    regressors = rank - int(has_intercept)
    r2 = 1 - rss / tss if tss > 0 else None
    base = n - int(has_intercept)
    summary = {
        "rss": rss,
        "sigma": np.sqrt(sigma2) if dof > 0 else None,
        "r_squared": r2,
        "adj_r_squared": 1 - (1 - r2) * base / dof if r2 is not None and dof > 0 else None,
        "f_statistic": ((tss - rss) / regressors) / sigma2
        if regressors and dof > 0 and sigma2 > 0
        else None,
        "df_model": regressors,
    }
    return Fit(
        response=y,
        names=list(names),
        kept=[names[i] for i in kept],
        beta=beta.astype(float),
        vcov=(inv * sigma2).astype(float),
        n=n,
        df_residual=dof,
        student=True,
        summary={k: None if v is None else float(v) for k, v in summary.items()},
        design=design,
    )


def model_rows(df: DataFrame, terms: Sequence, extra: Sequence[str]) -> DataFrame:
    """The complete rows of a model, its columns only, written once (an eager job).

    Every later pass reads this narrow table, not the input's lineage.
    """
    columns = list(dict.fromkeys([*extra, *used_columns(terms)]))
    return stage_derived(df.filter(complete_rows(df, terms, extra)).select(*columns))


@releases_stages
def ols(df: DataFrame, y: str, terms: Sequence) -> Fit:
    """Ordinary least squares with listwise deletion and aliased terms dropped."""
    terms = as_terms(df, terms)
    rows = model_rows(df, terms, [y])
    design, n = resolve(rows, terms, [y])
    if n == 0:
        raise ValueError("no complete rows")
    return solve(design.names, moments(rows, design, y, n).model(design), n, y, design)


@releases_stages
def model_family(df: DataFrame, y: str, models: Mapping[str, Sequence]) -> dict[str, Fit]:
    """Several least-squares models of one response.

    Complete-row counts of all models come from one aggregate. Models nested
    in a larger one with the same count use the same rows, so they are solved
    from that model's matrix without another pass.
    """
    specs = {name: as_terms(df, t) for name, t in models.items()}
    df = stage_derived(df.select(*dict.fromkeys([y, *(c for t in specs.values() for c in used_columns(t))])))
    counts = df.agg(
        *[F.count_if(complete_rows(df, t, [y])).alias(name) for name, t in specs.items()]
    ).first()
    fits: dict[str, Fit] = {}
    shared: list[tuple[set, int, Design, Moments]] = []
    for name in sorted(specs, key=lambda m: -len(specs[m])):
        terms, n = specs[name], int(counts[name])
        found = next(
            (s for s in shared if set(terms) <= s[0] and s[1] == n), None
        )
        if found is None:
            rows = df.filter(complete_rows(df, terms, [y]))
            design, n = resolve(rows, terms, [y])
            sums = moments(rows, design, y, n)
            shared.append((set(terms), n, design, sums))
        else:
            _, _, wide, sums = found
            design = Design(list(terms), wide.levels, wide.shifts)
        fits[name] = solve(design.names, sums.model(design), n, y, design)
    return {name: fits[name] for name in models}


def nested_test(spark: SparkSession, small: Fit, large: Fit) -> DataFrame:
    """F test of a model against a larger one on the same rows."""
    if small.n != large.n:
        raise ValueError("models were fitted on different rows")
    extra = small.df_residual - large.df_residual
    gain = small.summary["rss"] - large.summary["rss"]
    f = (gain / extra) / (large.summary["rss"] / large.df_residual)
    df = spark.createDataFrame(
        [(small.summary["rss"], large.summary["rss"], float(extra), float(large.df_residual), gain, f)],
        "rss_small double, rss_large double, df double, df_residual double, sum_sq double, f double",
    )
    return df.withColumn("p_value", p_fisher("f", "df", "df_residual"))


@releases_stages
def robust(df: DataFrame, fit: Fit) -> Fit:
    """The same coefficients with an HC1 covariance, from one more pass."""
    rows = fit.predict(model_rows(df, fit.design.terms, [fit.response]), "__fitted")
    residual = F.col(fit.response).cast("double") - F.col("__fitted")
    keys = fit.design.raw_keys
    mapping = fit.design.mapping(keys)[:, [fit.names.index(c) for c in fit.kept]]
    sums = product_sums(rows, keys, fit.design.numbers, residual * residual)
    meat = (mapping.T @ sums @ mapping).astype(float)
    bread = fit.vcov / fit.summary["sigma"] ** 2
    scale = fit.n / fit.df_residual
    return Fit(**{**fit.__dict__, "vcov": scale * (bread @ meat @ bread)})


@dataclass
class InstrumentSpace:
    """Cross products of [exogenous, endogenous, instruments, response] and where each stands."""

    design: Design
    products: np.ndarray
    instruments: list[int]
    excluded: list[int]
    regressors: list[int]
    first: dict[str, np.ndarray]


@dataclass
class InstrumentFit:
    """Two-stage least squares with its diagnostics."""

    fit: Fit
    first_stage_f: dict[str, tuple[float, float, float]]
    wu_hausman: tuple[float, float, float] | None
    space: InstrumentSpace

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        rows = [(f"weak instruments ({k})", *v) for k, v in self.first_stage_f.items()]
        if self.wu_hausman:
            rows.append(("Wu-Hausman", *self.wu_hausman))
        df = spark.createDataFrame(rows, "test string, statistic double, df1 double, df2 double")
        return df.withColumn("p_value", p_fisher("statistic", "df1", "df2"))


def _rss(products: np.ndarray, columns: list[int], y: int) -> tuple[np.longdouble, int]:
    xx = products[np.ix_(columns, columns)]
    kept = [columns[i] for i in independent(xx)]
    beta = inverse(products[np.ix_(kept, kept)]) @ products[kept, y]
    return products[y, y] - beta @ products[kept, y], len(kept)


@releases_stages
def iv(
    df: DataFrame, y: str, endogenous: Sequence[str], exogenous: Sequence, instruments: Sequence[str]
) -> InstrumentFit:
    """Two-stage least squares from one matrix of [exogenous, endogenous, instruments, y]."""
    exo = as_terms(df, exogenous)
    endo = [Num(c) for c in endogenous]
    inst = [Num(c) for c in instruments]
    every = [*exo, *endo, *inst]
    rows = model_rows(df, every, [y])
    design, n = resolve(rows, every, [y])
    products = moments(rows, design, y, n).model(design)
    names = design.names
    y_at = len(names)
    endo_at = [names.index(c) for c in endogenous]
    inst_at = [names.index(c) for c in instruments]
    exo_at = [i for i in range(y_at) if i not in endo_at and i not in inst_at]

    z_all = [*exo_at, *inst_at]
    z = [z_all[i] for i in independent(products[np.ix_(z_all, z_all)])]
    x = [*exo_at, *endo_at]
    zz_inv = inverse(products[np.ix_(z, z)])
    zx, zy = products[np.ix_(z, x)], products[z, y_at]
    projected = zx.T @ zz_inv @ zx
    kept = independent(projected)
    inv = inverse(projected[np.ix_(kept, kept)])
    beta = inv @ (zx.T @ zz_inv @ zy)[kept]
    used = [x[i] for i in kept]
    xx = products[np.ix_(used, used)]
    rss = products[y_at, y_at] - 2 * beta @ products[used, y_at] + beta @ xx @ beta
    dof = n - len(used)
    sigma2 = rss / dof
    tss = products[y_at, y_at] - products[names.index(INTERCEPT), y_at] ** 2 / n
    model = Design([*exo, *endo], design.levels, design.shifts)
    fit = Fit(
        response=y,
        names=[names[i] for i in x],
        kept=[names[i] for i in used],
        beta=beta.astype(float),
        vcov=(inv * sigma2).astype(float),
        n=n,
        df_residual=dof,
        student=True,
        summary={
            "rss": float(rss),
            "sigma": float(np.sqrt(sigma2)),
            "r_squared": float(1 - rss / tss),
        },
        design=model,
    )

    first, residuals = {}, []
    for name, at in zip(endogenous, endo_at):
        full, rank_full = _rss(products, z, at)
        part, rank_part = _rss(products, exo_at, at)
        q, d = rank_full - rank_part, n - rank_full
        first[name] = (float(((part - full) / q) / (full / d)), float(q), float(d))
        residuals.append((at, zz_inv @ products[z, at]))

    # Adding the first-stage residuals to the regression tests exogeneity. They are
    # combinations of columns already summed, so the matrix is mapped, not recomputed.
    size = len(names) + 1
    mapping = np.eye(size, dtype=np.longdouble)
    for at, pi in residuals:
        column = np.zeros((size, 1), dtype=np.longdouble)
        column[at] = 1.0
        column[z, 0] -= pi
        mapping = np.hstack([mapping, column])
    grown = mapping.T @ products @ mapping
    small, rank_small = _rss(grown, x, y_at)
    large, rank_large = _rss(grown, [*x, *range(size, size + len(residuals))], y_at)
    q, d = rank_large - rank_small, n - rank_large
    hausman = (float(((small - large) / q) / (large / d)), float(q), float(d)) if q else None
    pi = {name: coefficients for name, (_, coefficients) in zip(endogenous, residuals)}
    excluded = [i for i in z if i in inst_at]
    return InstrumentFit(fit, first, hausman, InstrumentSpace(design, products, z, excluded, used, pi))


@dataclass
class RobustInstrumentFit:
    """Two-stage least squares with errors that allow for unequal variances, and its tests."""

    fit: Fit
    first_stage_f: dict[str, tuple[float, float, float]]
    sargan: tuple[float, float] | None
    hansen: tuple[float, float] | None

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        """Robust first-stage F and, with spare instruments, Sargan's and Hansen's chi-squared (df2 NULL)."""
        rows = [(f"robust first stage ({k})", *v) for k, v in self.first_stage_f.items()]
        rows += [(n, *v, None) for n, v in (("Sargan", self.sargan), ("Hansen J", self.hansen)) if v]
        df = spark.createDataFrame(rows, "test string, statistic double, df1 double, df2 double")
        chi = p_chi2("statistic", "df1")
        return df.withColumn("p_value", F.when(F.col("df2").isNull(), chi).otherwise(p_fisher("statistic", "df1", "df2")))


@releases_stages
def robust_iv(df: DataFrame, found: InstrumentFit) -> RobustInstrumentFit:
    """Heteroskedasticity-robust errors and tests of an instrument fit, from one more pass.

    The sandwich stands in the space of the instruments: squared residuals
    weight the instruments' cross products, and the first stage's
    coefficients carry them to the regressors. The same pass takes the squared
    first-stage residuals for robust F tests of the excluded instruments.
    """
    space, fit = found.space, found.fit
    design, names, products = space.design, space.design.names, space.products
    y_at, z, x = len(names), space.instruments, space.regressors
    rows = fit.predict(model_rows(df, design.terms, [fit.response]), "__fitted")
    weights = [F.pow(F.col(fit.response).cast("double") - F.col("__fitted"), 2)]
    for i, (name, pi) in enumerate(space.first.items()):
        rows = design.with_value(rows, {names[j]: float(c) for j, c in zip(z, pi)}, f"__first{i}")
        weights.append(F.pow(F.col(name).cast("double") - F.col(f"__first{i}"), 2))
    keys = design.raw_keys
    mapping = design.mapping(keys, z)
    sums = sum_products(rows, [SumSpec(keys, design.numbers, w) for w in weights])
    meat, *first_meats = [(mapping.T @ s.dense() @ mapping).astype(float) for s in sums]

    zz_inv = inverse(products[np.ix_(z, z)])
    zx, zy = products[np.ix_(z, x)], products[z, y_at]
    pull = (zz_inv @ zx).astype(float)
    bread = inverse(zx.T @ zz_inv @ zx).astype(float)
    n, dof = fit.n, fit.df_residual
    vcov = n / dof * bread @ pull.T @ meat @ pull @ bread
    robust_fit = Fit(**{**fit.__dict__, "vcov": vcov})

    first, zz_bread = {}, zz_inv.astype(float)
    tested = [z.index(i) for i in space.excluded]
    for (name, pi), own in zip(space.first.items(), first_meats):
        spread = n / (n - len(z)) * zz_bread @ own @ zz_bread
        part = np.asarray(pi, dtype=float)[tested]
        wald = float(part @ np.linalg.solve(spread[np.ix_(tested, tested)], part))
        first[name] = (wald / len(tested), float(len(tested)), float(n - len(z)))

    spare = len(z) - len(x)
    if spare <= 0:
        return RobustInstrumentFit(robust_fit, first, None, None)
    left = zy - zx @ fit.beta
    sargan = float(left @ zz_inv @ left / (fit.summary["rss"] / n))
    # Hansen's statistic: the efficient estimate weights moments by their own spread
    weight = inverse(meat)
    beta = inverse(zx.T @ weight @ zx) @ (zx.T @ weight @ zy)
    left = zy - zx @ beta
    return RobustInstrumentFit(robust_fit, first, (sargan, float(spare)), (float(left @ weight @ left), float(spare)))


def impute_by_model(
    df: DataFrame,
    target: str,
    terms: Sequence,
    where: Column,
    fit_rows: Column | None = None,
    squared: str | None = None,
) -> tuple[DataFrame, Fit]:
    """Fill a column from a regression on the rows where it is known.

    Adds ``<target>_imputed`` (the prediction where it was used) and
    ``<target>_final``; rows outside ``where`` keep their value.
    """
    where = F.coalesce(where, F.lit(False))
    fit = ols(df.filter(where if fit_rows is None else fit_rows), target, terms)
    gap = where & F.col(target).isNull()
    df = fit.predict(df, "__fitted").withColumn(f"{target}_imputed", F.when(gap, F.col("__fitted"))).drop("__fitted")
    final = F.coalesce(F.col(target).cast("double"), F.col(f"{target}_imputed"))
    df = df.withColumn(f"{target}_final", final)
    if squared:
        df = df.withColumn(squared, F.pow(F.col(f"{target}_final"), 2))
    return df, fit
