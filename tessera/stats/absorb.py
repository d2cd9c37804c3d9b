"""Least squares with absorbed factors of any number of levels.

Fixed effects are taken out instead of estimated: every column is projected off
the factors by alternating projections (grouped demeaning, factor after factor,
until nothing moves). The projections run on cells, one per combination of
levels, and no list of levels exists anywhere but in tables. What the factors
cost in degrees of freedom is their number of levels less the number of
connected components of the graph in which two levels meet in a cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stages import releases_stages
from tessera.sources.tables import stage_derived
from tessera.stats.fit import Fit
from tessera.stats.gram import independent, inverse

#: Sweeps between two writes of the cells, and sweeps at most.
SWEEPS_A_STAGE = 4
MAX_SWEEPS = 2000
#: A sweep that moves less than this share of a column's squares is the last one.
TOLERANCE = 1e-20


def demeaned_cells(cells: DataFrame, columns: Sequence[str], factors: Sequence[str], squares: dict[str, float]) -> DataFrame:
    """Cells whose sums ``r_*`` are free of all factors; ``s_*`` and ``n`` stay (an eager loop).

    One factor needs one sweep. With more, a sweep takes the level means of
    each factor off in turn; the sum of squares it moves is known from the
    level means alone, and the loop ends when that is next to nothing.
    """
    now = cells.withColumns({f"r_{c}": F.col(f"s_{c}") for c in columns})
    for sweep in range(1, MAX_SWEEPS + 1):
        moved = []
        for f in factors:
            sums = [F.sum(f"r_{c}").alias(f"d_{c}") for c in columns]
            means = now.groupBy(F.col(f).alias("__level")).agg(F.sum("n").alias("__n"), *sums)
            means = stage_derived(means.select("__level", "__n", *[(F.col(f"d_{c}") / F.col("__n")).alias(f"d_{c}") for c in columns]))
            moved.append(means.agg(*[F.sum(F.col("__n") * F.col(f"d_{c}") * F.col(f"d_{c}")).alias(c) for c in columns]))
            now = now.join(means, F.col(f) == F.col("__level")).drop("__level", "__n")
            now = now.withColumns({f"r_{c}": F.col(f"r_{c}") - F.col("n") * F.col(f"d_{c}") for c in columns}).drop(*[f"d_{c}" for c in columns])
        if len(factors) == 1:
            return stage_derived(now)
        if sweep % SWEEPS_A_STAGE == 0 or sweep == 1:
            now = stage_derived(now)
            # the first factor's means are what the others have put back; the last sweep's alone count
            left = moved[0].first()
            if sweep > 1 and all(left[c] <= TOLERANCE * squares[c] for c in columns):
                return now
    raise RuntimeError(f"the projections off {', '.join(factors)} have not settled after {MAX_SWEEPS} sweeps")


def components(edges: DataFrame, left: str, right: str) -> int:
    """Connected components of a graph between two kinds of levels (an eager loop).

    Levels take the least label that they meet; a label then follows the label
    of the level it names, so long chains shorten by halves.
    """
    pairs = stage_derived(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct())
    labels = stage_derived(pairs.select("a").distinct().select("a", F.col("a").alias("label")))
    while True:
        met = pairs.join(labels, "a").groupBy("b").agg(F.min("label").alias("least"))
        own = pairs.join(met, "b").groupBy("a").agg(F.min("least").alias("label"))
        ahead = own.select(F.col("a").alias("__next"), F.col("label").alias("__label"))
        moved = own.join(ahead, F.col("label") == F.col("__next")).select("a", F.least("label", "__label").alias("label"))
        moved = stage_derived(moved)
        changed = moved.join(labels.withColumnRenamed("label", "__old"), "a").filter(F.col("label") != F.col("__old"))
        if changed.isEmpty():
            return moved.select("label").distinct().count()
        labels = moved


def absorbed_rank(cells: DataFrame, factors: Sequence[str]) -> int:
    """Independent columns among the dummies of all factors.

    Exact for one or two. Of each further factor, the levels less the
    components it forms with the first are counted, which is at least the
    truth, so errors are never too small.
    """
    if not factors:
        return 1
    sizes = cells.agg(*[F.count_distinct(f).alias(f) for f in factors]).first()
    return sizes[factors[0]] + sum(sizes[f] - components(cells, factors[0], f) for f in factors[1:])


@releases_stages
def ols_absorbed(df: DataFrame, y: str, regressors: Sequence[str], absorb: Sequence[str]) -> Fit:
    """Least squares of ``y`` on numbers, with a fixed effect per level of each column in ``absorb``.

    Rows with an unknown value go. Estimates, errors and fit statistics are
    those of the model with one dummy per level; the dummies themselves have no
    rows in the result. Runs its jobs at once: rows become cells in one pass,
    the projections work on cells.
    """
    absorb, columns = list(absorb), [y, *regressors]
    if not absorb:
        raise ValueError("no factor to absorb")
    numbers = {c: F.col(c).cast("double") for c in columns}
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in absorb])
    known = reduce(lambda a, c: a & c.isNotNull() & ~F.isnan(c), numbers.values(), known)
    rows = df.filter(known).select(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(absorb)], *[v.alias(f"c{i}") for i, v in enumerate(numbers.values())])
    rows = stage_derived(rows)
    factors, own = [f"f{i}" for i in range(len(absorb))], [f"c{i}" for i in range(len(columns))]
    means = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in own]).first()
    n = means["n"]
    if n == 0:
        raise ValueError("no complete rows")
    centred = rows.withColumns({c: F.col(c) - F.lit(means[c]) for c in own})
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i:]]
    cells = stage_derived(centred.groupBy(*factors).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in own],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs],
    ))
    total = cells.agg(*[F.sum(f"p_{a}_{b}").alias(f"{a}_{b}") for a, b in pairs]).first()
    squares = {c: max(total[f"{c}_{c}"], 1e-300) for c in own}
    free = demeaned_cells(cells.select(*factors, "n", *[f"s_{c}" for c in own]), own, factors, squares)
    # a cell's rows share the effect e = (s - r) / n; products of rows less effects follow from cell sums
    effect = {c: (F.col(f"s_{c}") - F.col(f"r_{c}")) / F.col("n") for c in own}
    taken = free.agg(*[
        F.sum(effect[a] * F.col(f"s_{b}") + effect[b] * F.col(f"s_{a}") - F.col("n") * effect[a] * effect[b]).alias(f"{a}_{b}")
        for a, b in pairs
    ]).first()
    matrix = np.zeros((len(own), len(own)), dtype=np.longdouble)
    for a, b in pairs:
        i, j = own.index(a), own.index(b)
        matrix[i, j] = matrix[j, i] = np.longdouble(total[f"{a}_{b}"]) - np.longdouble(taken[f"{a}_{b}"])
    # what is left of a column that the factors explain is rounding
    gone = [i for i in range(1, len(own)) if matrix[i, i] <= 1e-12 * squares[own[i]]]
    seen = [i for i in range(1, len(own)) if i not in gone]
    kept = [seen[i] for i in independent(matrix[np.ix_(seen, seen)])] if seen else []
    inv = inverse(matrix[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    beta = inv @ matrix[kept, 0]
    rss = max(matrix[0, 0] - beta @ matrix[kept, 0], np.longdouble(0))
    rank = absorbed_rank(cells, factors) + len(kept)
    dof = n - rank
    sigma2 = rss / dof if dof > 0 else np.longdouble("nan")
    tss = np.longdouble(squares[own[0]])
    summary = {
        "rss": rss, "sigma": np.sqrt(sigma2) if dof > 0 else None, "r_squared": 1 - rss / tss,
        "adj_r_squared": 1 - rss / tss * (n - 1) / dof if dof > 0 else None,
        "within_r_squared": 1 - rss / matrix[0, 0] if matrix[0, 0] > 0 else None,
        "f_statistic": ((tss - rss) / (rank - 1)) / sigma2 if dof > 0 and rank > 1 and sigma2 > 0 else None,
        "df_model": rank - 1, "absorbed": rank - len(kept),
    }
    names = list(regressors)
    return Fit(
        response=y, names=names, kept=[names[i - 1] for i in kept], beta=np.asarray(beta, dtype=float),
        vcov=np.asarray(inv * sigma2, dtype=float), n=n, df_residual=dof, student=True,
        summary={k: None if v is None else float(v) for k, v in summary.items()},
    )

