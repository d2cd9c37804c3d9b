"""Sums of cross products on the executors, small dense algebra on the driver.

The products of a design with factors are grouped sums: rows are first summed
per cell of the factor columns (combined before the shuffle), cells then per
set of factors that a pair of columns names. No expression per level is
evaluated. What reaches the driver is bounded by the k x k entries for k
design columns, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIAS_TOLERANCE = 1e-12


def _parsed(key: tuple) -> tuple[dict[str, str] | None, tuple[str, ...]]:
    """Levels named by a raw key (None if contradictory) and its numeric columns."""
    levels: dict[str, str] = {}
    numbers: list[str] = []
    for part in key if isinstance(key[0], tuple) else [key]:
        if part == ("1",):
            continue
        if len(part) == 1:
            numbers.append(part[0])
        elif levels.setdefault(part[0], part[1]) != part[1]:
            return None, ()
    return levels, tuple(sorted(numbers))


@dataclass
class SumSpec:
    """What one model asks of a pass over the rows.

    ``numbers`` gives the expression of every numeric column that a key names.
    ``weight`` multiplies each row's products; rows where it is NULL take no
    part. ``totals`` are further sums over the same rows.
    """

    keys: Sequence[tuple]
    numbers: Mapping[str, Column]
    weight: Column | None = None
    totals: Mapping[str, Column] = field(default_factory=dict)


@dataclass
class CellSums:
    """Entries of a cross-product matrix that some cell of the factors fills."""

    size: int
    entries: dict[tuple[int, int], float]
    totals: dict[str, float]

    def block(self, rows: Sequence[int], columns: Sequence[int]) -> np.ndarray:
        row_at, column_at = ({k: n for n, k in enumerate(keys)} for keys in (rows, columns))
        out = np.zeros((len(rows), len(columns)))
        for (i, j), value in self.entries.items():
            for a, b in {(i, j), (j, i)}:
                if a in row_at and b in column_at:
                    out[row_at[a], column_at[b]] = value
        return out

    def dense(self) -> np.ndarray:
        every = range(self.size)
        return self.block(every, every)


class _Layout:
    """Where the sums of one spec stand: kinds of keys by the factors they name."""

    def __init__(self, number: int, spec: SumSpec):
        parsed = [_parsed(k) for k in spec.keys]
        self.number, self.spec = number, spec
        self.columns = list(dict.fromkeys(c for levels, _ in parsed for c in levels or {}))
        self.powers = list(dict.fromkeys(n for _, n in parsed))
        self.pairs = [(i, j) for i in range(len(self.powers)) for j in range(i, len(self.powers))]
        self.kinds: dict[tuple, dict[tuple, int]] = {}
        for at, (levels, numbers) in enumerate(parsed):
            if levels is not None:
                names = tuple(sorted(levels))
                self.kinds.setdefault((names, self.powers.index(numbers)), {})[tuple(levels[c] for c in names)] = at
        kinds = list(self.kinds)
        self.met: dict[frozenset, list[tuple]] = {}
        for i, first in enumerate(kinds):
            for second in kinds[i:]:
                union = frozenset(first[0]) | frozenset(second[0])
                pair = self.pairs.index(tuple(sorted((first[1], second[1]))))
                self.met.setdefault(union, []).append((first, second, pair))

    def values(self) -> list[Column]:
        m, spec = self.number, self.spec
        of_power = [reduce(lambda a, b: a * b, [spec.numbers[c].cast("double") for c in p], F.lit(1.0)) for p in self.powers]
        weight = F.lit(1.0) if spec.weight is None else spec.weight.cast("double")
        return [
            weight.alias(f"w{m}"), *[v.alias(f"x{m}_{i}") for i, v in enumerate(of_power)],
            *[F.when(F.isnotnull(weight), t.cast("double")).alias(f"t{m}_{i}") for i, t in enumerate(spec.totals.values())],
        ]

    def sums(self) -> list[Column]:
        m = self.number
        products = [F.sum(F.col(f"w{m}") * F.col(f"x{m}_{i}") * F.col(f"x{m}_{j}")) for i, j in self.pairs]
        return [
            *[c.alias(f"s{m}_{n}") for n, c in enumerate(products)],
            *[F.sum(f"t{m}_{i}").alias(f"t{m}_{i}") for i in range(len(self.spec.totals))],
        ]

    def names(self) -> list[str]:
        m = self.number
        return [*[f"s{m}_{n}" for n in range(len(self.pairs))], *[f"t{m}_{i}" for i in range(len(self.spec.totals))]]

    def take(self, row, levels: dict[str, str], found: CellSums) -> None:
        union = frozenset(levels)
        for first, second, pair in self.met.get(union, []):
            value = row[f"s{self.number}_{pair}"]
            a = self.kinds[first].get(tuple(levels[c] for c in first[0]))
            b = self.kinds[second].get(tuple(levels[c] for c in second[0]))
            if value is not None and a is not None and b is not None:
                found.entries[a, b] = value
        if not union:
            found.totals.update({n: row[f"t{self.number}_{i}"] or 0.0 for i, n in enumerate(self.spec.totals)})


def sum_products(rows: DataFrame, specs: Sequence[SumSpec], grouped: bool = False) -> list[CellSums]:
    """Cross products of the raw design columns of several models, in one job.

    Rows are summed per cell of all factor columns, then cells per set of
    factors that a pair of keys names; ``grouped`` says that the rows are
    cells already. Factor columns are compared as text.
    """
    layouts = [_Layout(m, s) for m, s in enumerate(specs)]
    columns = list(dict.fromkeys(c for layout in layouts for c in layout.columns))
    groups = [f"g{i}" for i in range(len(columns))]
    wide = rows.select(
        *[F.col(c).cast("string").alias(g) for c, g in zip(columns, groups)], *[v for layout in layouts for v in layout.values()]
    )
    cells = wide
    if not (grouped and columns):
        cells = wide.groupBy(*groups).agg(*[c for layout in layouts for c in layout.sums()])
    if columns:
        unions = dict.fromkeys([frozenset(), *(u for layout in layouts for u in layout.met)])
        sets = [[g for c, g in zip(columns, groups) if c in u] for u in unions]
        last = [c for layout in layouts for c in (layout.sums() if grouped else [F.sum(n).alias(n) for n in layout.names()])]
        cells = cells.groupingSets(sets, *groups).agg(F.grouping_id().alias("id"), *last)
    found = [CellSums(len(layout.spec.keys), {}, {}) for layout in layouts]
    for row in cells.collect():
        out = int(row["id"]) if columns else 0
        levels = {c: row[g] for i, (c, g) in enumerate(zip(columns, groups)) if not out >> (len(columns) - 1 - i) & 1}
        for layout, sums in zip(layouts, found):
            layout.take(row, levels, sums)
    return found


def product_sums(
    rows: DataFrame, keys: Sequence[tuple], numbers: Mapping[str, Column], weight: Column | None = None
) -> np.ndarray:
    """Cross-product matrix of one model's raw design columns over all rows, in one job."""
    return sum_products(rows, [SumSpec(keys, numbers, weight)])[0].dense()


def independent(matrix: np.ndarray, tolerance: float = ALIAS_TOLERANCE) -> list[int]:
    """Columns of a Gram matrix that earlier columns do not explain, in order."""
    a = np.asarray(matrix, dtype=np.longdouble)
    scale = np.sqrt(np.diag(a))
    kept: list[int] = []
    factor = np.zeros((0, 0), dtype=np.longdouble)
    for j in range(a.shape[0]):
        if scale[j] == 0:
            continue
        cross = a[kept, j] / (scale[kept] * scale[j])
        row = forward(factor, cross)
        left = 1 - row @ row
        if left > tolerance:
            k = len(kept)
            grown = np.zeros((k + 1, k + 1), dtype=np.longdouble)
            grown[:k, :k] = factor
            grown[k, :k] = row
            grown[k, k] = np.sqrt(left)
            factor, kept = grown, [*kept, j]
    return kept


def forward(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve lower @ x = right."""
    x = np.zeros_like(right, dtype=np.longdouble)
    for i in range(lower.shape[0]):
        x[i] = (right[i] - lower[i, :i] @ x[:i]) / lower[i, i]
    return x


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix, equilibrated, extended precision."""
    a = np.asarray(matrix, dtype=np.longdouble)
    scale = np.sqrt(np.diag(a))
    scaled = a / np.outer(scale, scale)
    k = a.shape[0]
    lower = np.zeros_like(scaled)
    for j in range(k):
        lower[j, j] = np.sqrt(scaled[j, j] - lower[j, :j] @ lower[j, :j])
        lower[j + 1 :, j] = (scaled[j + 1 :, j] - lower[j + 1 :, :j] @ lower[j, :j]) / lower[j, j]
    half = forward(lower, np.eye(k, dtype=np.longdouble))
    return (half.T @ half) / np.outer(scale, scale)


#: A factor with more levels than this is eliminated before the system is solved.
ELIMINATE_FROM = 200


@dataclass
class Solution:
    """Solution of normal equations over the columns in ``kept``, its covariance, and the squared step length."""

    kept: list[str]
    solution: np.ndarray
    vcov: np.ndarray
    decrement: float


def solving_keys(design) -> list[tuple]:
    """Raw keys of a design, with every level of a factor that is to be eliminated."""
    large = design.separate_factor(ELIMINATE_FROM)
    levels = [(large[1], v) for v in design.levels[large[1]]] if large else []
    return list(dict.fromkeys([*design.raw_keys, *levels]))


def solve_normal(sums: CellSums, design, kept: Sequence[str] | None = None) -> Solution:
    """Solve the normal equations of a design from sums over ``solving_keys`` and, last, the right side.

    ``kept`` names the columns to use; without it, columns that earlier ones
    explain are left out. The levels of a large factor are eliminated one by
    one, which leaves a system in the other columns only.
    """
    found = _eliminated(sums, design)
    if found is None:
        keys = range(sums.size - 1)
        mapping = design.mapping(solving_keys(design))
        matrix = sums.block(keys, keys).astype(np.longdouble)
        right = sums.block(keys, [sums.size - 1]).astype(np.longdouble)[:, 0]
        whole, right = mapping.T @ matrix @ mapping, mapping.T @ right
        names = design.names
        at = [names.index(c) for c in kept] if kept else independent(whole)
        vcov = inverse(whole[np.ix_(at, at)])
        found = Solution([names[i] for i in at], vcov @ right[at], vcov, float(right[at] @ vcov @ right[at]))
    return Solution(found.kept, found.solution.astype(float), found.vcov.astype(float), found.decrement)


def _eliminated(sums: CellSums, design) -> Solution | None:
    """Solution by way of the largest factor's levels; None where that does not apply.

    With the levels' own sums on a diagonal, each level's value follows from
    the other columns alone. The intercept is part of the levels until the
    end, when both are turned into the factor's contrasts.
    """
    large = design.separate_factor(ELIMINATE_FROM)
    if large is None:
        return None
    block, column = large
    raw, names = solving_keys(design), design.names
    at = {k: i for i, k in enumerate(raw)}
    own_at = [at[column, v] for v in design.levels[column]]
    other_at = sorted(set(range(len(raw))) - set(own_at))
    inside = set(block.names) | {names[0]}
    rest = [i for i, c in enumerate(names) if c not in inside]
    mapping = design.mapping(raw, rest)[other_at].astype(float)
    size = np.array([sums.entries.get((i, i), 0.0) for i in own_at])
    if not (size > 0).all():
        return None
    across = sums.block(own_at, other_at) @ mapping
    inner = mapping.T @ sums.block(other_at, other_at) @ mapping
    right_own = sums.block(own_at, [sums.size - 1])[:, 0]
    right = mapping.T @ sums.block(other_at, [sums.size - 1])[:, 0]
    scaled = across / size[:, None]
    left = inner - across.T @ scaled
    if (np.diag(left) <= 1e-9 * np.diag(inner)).any() or len(independent(left)) < len(rest):
        return None  # some column is a sum of levels: the general way decides which one goes
    spread = inverse(left).astype(float) if rest else np.zeros((0, 0))
    slopes = spread @ (right - scaled.T @ right_own)
    values = (right_own - across @ slopes) / size
    cross = -scaled @ spread
    levels = np.diag(1 / size) - cross @ scaled.T
    # contrasts: levels against one reference, the intercept at another
    shown, against, centre = design.level_contrasts(block.term, len(size))
    to_ref, to_centre = levels @ against, levels @ centre
    own = levels[np.ix_(shown, shown)] - to_ref[shown][:, None] - to_ref[shown][None, :] + against @ to_ref
    own_centre = to_centre[shown] - centre @ to_ref
    own_rest = cross[shown] - (against @ cross)[None, :]
    order = [names[0], *block.names, *[names[i] for i in rest]]
    solution = np.concatenate([[centre @ values], values[shown] - against @ values, slopes])
    vcov = np.block([
        [np.array([[centre @ to_centre]]), own_centre[None, :], (centre @ cross)[None, :]],
        [own_centre[:, None], own, own_rest],
        [(centre @ cross)[:, None], own_rest.T, spread],
    ])
    stands = {c: i for i, c in enumerate(order)}
    place = [stands[c] for c in names]
    decrement = float(values @ right_own + slopes @ right)
    return Solution(list(names), solution[place], vcov[np.ix_(place, place)], decrement)
