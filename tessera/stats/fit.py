"""Fitted models as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.pvalues import p_normal, p_student
from tessera.functions.semantics import safe_ratio
from tessera.stats.design import Design


@dataclass
class Fit:
    """Coefficients and covariance of one model.

    ``names`` lists every model column; ``beta`` and ``vcov`` cover the ones
    in ``kept``, the rest are aliased and reported with NULL estimates.
    """

    response: str
    names: list[str]
    kept: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    df_residual: float
    student: bool
    summary: dict[str, float | None] = field(default_factory=dict)
    design: Design | None = None

    @property
    def coefficients(self) -> dict[str, float]:
        return {n: float(b) for n, b in zip(self.kept, self.beta)}

    @property
    def errors(self) -> dict[str, float]:
        return {n: float(np.sqrt(v)) for n, v in zip(self.kept, np.diag(self.vcov))}

    def tidy(self, spark: SparkSession) -> DataFrame:
        """term, estimate, std_error, statistic, p_value in model order."""
        b, e = self.coefficients, self.errors
        rows = [(i, n, b.get(n), e.get(n)) for i, n in enumerate(self.names)]
        df = spark.createDataFrame(rows, "position int, term string, estimate double, std_error double")
        df = df.withColumn("statistic", safe_ratio("estimate", "std_error"))
        tail = (
            p_student("statistic", F.lit(float(self.df_residual)))
            if self.student
            else p_normal("statistic")
        )
        return df.withColumn("p_value", tail)

    def glance(self, spark: SparkSession) -> DataFrame:
        """One row of fit statistics."""
        values = {"n": float(self.n), "df_residual": float(self.df_residual), **self.summary}
        schema = ", ".join(f"{k} double" for k in values)
        row = tuple(None if v is None else float(v) for v in values.values())
        return spark.createDataFrame([row], schema)

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """Add the linear predictor; NULL for an unknown input or an unseen level."""
        return self.design.with_value(rows, self.coefficients, out)
