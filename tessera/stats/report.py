"""Coefficient tables and prediction grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.semantics import recode
from tessera.stats.design import factors, used_columns
from tessera.stats.fit import Fit


def stars(p) -> Column:
    """*** below 1%, ** below 5%, * below 10%."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def coefficients_long(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """Coefficients of several models under each other."""
    parts = [f.tidy(spark).withColumn("model", F.lit(name)) for name, f in fits.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def coefficient_table(
    spark: SparkSession,
    fits: Mapping[str, Fit],
    keep: Sequence[str] = (),
    omit: Sequence[str] = (),
    names: Mapping[str, str] | None = None,
    controls: Mapping[str, str] | None = None,
    digits: int = 3,
    statistics: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per term, one text column per model.

    ``keep`` and ``omit`` are patterns on term names, ``names`` renames terms,
    and ``controls`` adds Yes/No rows: label -> pattern of the terms whose
    presence it reports. ``statistics`` adds rows of fit statistics: label ->
    ``n`` or a key of the fit's summary. Terms keep their model order.
    """
    long = coefficients_long(spark, fits)
    shown = long
    if keep:
        shown = shown.filter(F.col("term").rlike("|".join(f"(?:{p})" for p in keep)))
    if omit:
        shown = shown.filter(~F.col("term").rlike("|".join(f"(?:{p})" for p in omit)))
    if names:
        shown = shown.withColumn("term", recode("term", names))
    number = f"%.{digits}f"
    text = F.concat(
        F.format_string(number, "estimate"),
        stars("p_value"),
        F.format_string(f" ({number})", "std_error"),
    )
    text = F.when(F.col("estimate").isNotNull(), text)
    models = list(fits)
    table = shown.groupBy("term").pivot("model", models).agg(F.first(text))
    order = shown.groupBy("term").agg(F.min("position").alias("position"))
    table = table.join(order, "term").select("position", "term", *models)
    base = len(max((f.names for f in fits.values()), key=len))
    if controls:
        flags = [
            long.groupBy()
            .pivot("model", models)
            .agg(F.max(F.when(F.col("term").rlike(pattern), "Yes").otherwise("No")))
            .select(F.lit(base + i).alias("position"), F.lit(label).alias("term"), *models)
            for i, (label, pattern) in enumerate(controls.items())
        ]
        table = reduce(lambda a, b: a.unionByName(b), flags, table)
    if statistics:
        start = base + len(controls or {})
        rows = [
            (start + i, label, *(_statistic(f, key, digits) for f in fits.values()))
            for i, (label, key) in enumerate(statistics.items())
        ]
        fields = "position int, term string, " + ", ".join(f"`{m}` string" for m in models)
        table = table.unionByName(spark.createDataFrame(rows, fields))
    return table.orderBy("position", "term")


def _statistic(fit: Fit, key: str, digits: int) -> str | None:
    if key == "n":
        return str(fit.n)
    value = fit.summary.get(key)
    return None if value is None else f"{value:.{digits}f}"


def marginal_grid(
    spark: SparkSession, fit: Fit, over: Mapping[str, Sequence | None], z: float = 1.959963984540054
) -> DataFrame:
    """Predictions over one or two terms, other covariates held fixed.

    Factors are held at their reference level, numbers at their mean. A value
    list of None means every level of a factor. The grid size is the product
    of the value lists, so it is built from the fit alone.
    """
    design = fit.design
    cats = factors(design.terms)
    values = {c: list(v) if v is not None else design.levels[c] for c, v in over.items()}
    base = {
        c: design.levels[c][0] if c in cats else design.shifts[c] for c in used_columns(design.terms)
    }
    kept = [design.names.index(n) for n in fit.kept]
    rows = []
    for combo in product(*values.values()):
        x = design.row({**base, **dict(zip(values, combo))})[kept]
        mean, error = float(x @ fit.beta), float(np.sqrt(x @ fit.vcov @ x))
        shown = [str(v) if c in cats else float(v) for c, v in zip(values, combo)]
        rows.append((*shown, mean, error, mean - z * error, mean + z * error))
    fields = [f"`{c}` {'string' if c in cats else 'double'}" for c in values]
    fields += [f"{c} double" for c in ("predicted", "std_error", "lower", "upper")]
    return spark.createDataFrame(rows, ", ".join(fields))
