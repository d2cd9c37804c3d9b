"""Two-cohort tests from grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.pvalues import p_chi2_1, p_student
from tessera.functions.semantics import is_true, safe_ratio
from tessera.operators.groups import with_group_total
from tessera.operators.reshape import melt


def yates_statistic(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Continuity-corrected chi-square of two proportions."""
    gap = F.abs(safe_ratio(x1, n1) - safe_ratio(x2, n2))
    spread = safe_ratio(F.lit(1.0), n1) + safe_ratio(F.lit(1.0), n2)
    correction = F.least(F.lit(0.5), safe_ratio(gap, spread))
    pooled = safe_ratio(x1 + x2, n1 + n2)
    parts = []
    for x, n in ((x1, n1), (x2, n2)):
        deviation = F.pow(F.abs(x - n * pooled) - correction, 2)
        parts += [safe_ratio(deviation, n * pooled), safe_ratio(deviation, n * (1 - pooled))]
    return parts[0] + parts[1] + parts[2] + parts[3]


def prop_test(df: DataFrame, cohort: Column, variables: Sequence[str]) -> DataFrame:
    """Equality of level shares between two cohorts, per variable and level.

    ``cohort`` is TRUE for the first cohort, FALSE for the second; unknown
    rows are left out. Levels are those seen in the first cohort.
    """
    flagged = df.select(
        cohort.alias("__first"), *[F.col(v).cast("string").alias(v) for v in variables]
    ).filter(F.col("__first").isNotNull())
    long = melt(flagged, ["__first"], variables, "variable", "level").filter("level IS NOT NULL")
    counts = long.groupBy("variable", "level").agg(
        F.count_if(F.col("__first")).alias("count_1"),
        F.count_if(~F.col("__first")).alias("count_2"),
    )
    sized = with_group_total(
        counts, "variable", {"total_1": F.sum("count_1"), "total_2": F.sum("count_2")}
    ).filter("count_1 > 0")
    statistic = yates_statistic(*[F.col(c).cast("double") for c in ("count_1", "total_1", "count_2", "total_2")])
    return sized.select(
        "variable",
        "level",
        "count_1",
        "total_1",
        (safe_ratio("count_1", "total_1") * 100).alias("percent_1"),
        "count_2",
        "total_2",
        (safe_ratio("count_2", "total_2") * 100).alias("percent_2"),
        statistic.alias("statistic"),
    ).withColumn("p_value", p_chi2_1("statistic"))


def welch_test(df: DataFrame, cohort: Column, columns: Sequence[str]) -> DataFrame:
    """Unequal-variance t test of cohort means, one row per column."""
    aggs = []
    first, second = is_true(cohort), is_true(~cohort)
    for i, c in enumerate(columns):
        for side, rule in ((1, first), (2, second)):
            value = F.when(rule, F.col(c).cast("double"))
            aggs += [
                F.avg(value).alias(f"mean_{side}_{i}"),
                F.var_samp(value).alias(f"var_{side}_{i}"),
                F.count(value).alias(f"n_{side}_{i}"),
            ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                *[
                    F.col(f"{stat}_{side}_{i}").alias(f"{stat}_{side}")
                    for side in (1, 2)
                    for stat in ("mean", "var", "n")
                ],
            )
            for i, c in enumerate(columns)
        ]
    )
    e1, e2 = safe_ratio("var_1", "n_1"), safe_ratio("var_2", "n_2")
    statistic = safe_ratio(F.col("mean_1") - F.col("mean_2"), F.sqrt(e1 + e2))
    freedom = safe_ratio(
        F.pow(e1 + e2, 2),
        safe_ratio(e1 * e1, F.col("n_1") - 1) + safe_ratio(e2 * e2, F.col("n_2") - 1),
    )
    return (
        df.agg(*aggs)
        .select(F.inline(rows))
        .select(
            "variable",
            "mean_1",
            F.sqrt("var_1").alias("sd_1"),
            "n_1",
            "mean_2",
            F.sqrt("var_2").alias("sd_2"),
            "n_2",
            statistic.alias("statistic"),
            freedom.alias("df"),
        )
        .withColumn("p_value", p_student("statistic", "df"))
    )


def correlation(df: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """Pearson correlation with its Fisher interval (95% by default)."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, width = F.col("r"), F.lit(z) / F.sqrt(F.col("n") - 3)
    return (
        known.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
        .withColumn("lower", F.tanh(F.atanh(r) - width))
        .withColumn("upper", F.tanh(F.atanh(r) + width))
    )
