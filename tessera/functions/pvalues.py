"""Tail probabilities as Spark expressions.

Spark SQL has no error function or incomplete beta. The math library that
ships with Spark does, and ``java_method`` reaches its static methods on the
executors. Used on test results (one row per level or term) and on the grouped
cells or scored rows of a probit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.semantics import as_col, safe_ratio

_ERF = "org.apache.commons.math3.special.Erf"
_GAMMA = "org.apache.commons.math3.special.Gamma"
_BETA = "org.apache.commons.math3.special.Beta"


def _static(cls: str, method: str, *args: Column) -> Column:
    """Call a static double method; NULL or NaN arguments give NULL."""
    known = F.lit(True)
    for a in args:
        known = known & a.isNotNull() & ~F.isnan(a)
    safe = [F.when(a.isNull() | F.isnan(a), F.lit(0.5)).otherwise(a) for a in args]
    return F.when(known, F.java_method(F.lit(cls), F.lit(method), *safe).cast("double"))


def erfc(x: Column) -> Column:
    """Complementary error function."""
    return _static(_ERF, "erfc", x.cast("double"))


def p_normal(z) -> Column:
    """Two-sided standard normal tail."""
    z = as_col(z).cast("double")
    return _static(_ERF, "erfc", F.abs(z) / F.sqrt(F.lit(2.0)))


def p_chi2_1(x) -> Column:
    """Upper chi-square tail with one degree of freedom."""
    x = as_col(x).cast("double")
    return _static(_ERF, "erfc", F.sqrt(F.when(x >= 0, x) / 2))


def p_chi2(x, df) -> Column:
    """Upper chi-square tail."""
    x, df = as_col(x).cast("double"), as_col(df).cast("double")
    return _static(_GAMMA, "regularizedGammaQ", df / 2, x / 2)


def p_student(t, df) -> Column:
    """Two-sided Student tail."""
    t, df = as_col(t).cast("double"), as_col(df).cast("double")
    return _static(_BETA, "regularizedBeta", safe_ratio(df, df + t * t), df / 2, F.lit(0.5))


def p_fisher(f, df1, df2) -> Column:
    """Upper F tail."""
    f, df1, df2 = (as_col(c).cast("double") for c in (f, df1, df2))
    return _static(_BETA, "regularizedBeta", safe_ratio(df2, df2 + df1 * f), df2 / 2, df1 / 2)
