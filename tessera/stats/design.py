"""Model terms and design columns.

A design is a list of *raw* columns the executors sum over (intercept,
shifted numbers, one dummy per level, products) and a small matrix that maps
them to the *model* columns (reference level dropped, contrasts applied,
shifts undone). Fits work on the mapped Gram matrix, so coding, shifting and
choosing a reference level cost no pass over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Num:
    """Numeric regressor."""

    column: str

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)


@dataclass(frozen=True)
class Cat:
    """Categorical regressor; the first level present is the reference.

    ``coding`` is ``treatment`` (level against reference), ``centered``
    (the same contrasts with centred columns, so that the intercept is the
    plain mean of the level means) or ``sum`` (deviation from that mean).
    """

    column: str
    levels: tuple | None = None
    coding: str = "treatment"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)


@dataclass(frozen=True)
class Inter:
    """Product of two terms whose main effects are in the model."""

    left: Num | Cat
    right: Num | Cat

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.left.column, self.right.column)


Term = Num | Cat | Inter


def as_terms(df: DataFrame, terms: Sequence) -> list[Term]:
    """Names become numeric or categorical terms by column type."""
    types = dict(df.dtypes)
    out: list[Term] = []
    for t in terms:
        if isinstance(t, str):
            t = Cat(t) if types[t] in ("string", "boolean") else Num(t)
        out.append(t)
    return out


def used_columns(terms: Sequence[Term]) -> list[str]:
    return list(dict.fromkeys(c for t in terms for c in t.columns))


def factors(terms: Sequence[Term]) -> dict[str, Cat]:
    found: dict[str, Cat] = {}
    for t in terms:
        for part in (t.left, t.right) if isinstance(t, Inter) else (t,):
            if isinstance(part, Cat):
                found.setdefault(part.column, part)
    return found


def complete_rows(df: DataFrame, terms: Sequence[Term], extra: Sequence[str] = ()) -> Column:
    """Listwise deletion: every used column known, every factor value listed."""
    types = dict(df.dtypes)
    cats = factors(terms)
    tests = []
    for c in dict.fromkeys([*extra, *used_columns(terms)]):
        tests.append(F.col(c).isNotNull())
        if types[c] in ("double", "float"):
            tests.append(~F.isnan(c))
        if c in cats and cats[c].levels:
            tests.append(F.col(c).cast("string").isin([str(v) for v in cats[c].levels]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def contrast_matrix(levels: Sequence[str], coding: str) -> tuple[np.ndarray, list[str]]:
    """Level by column matrix, and the level each column stands for."""
    k = len(levels)
    identity = np.eye(k)
    if coding == "treatment":
        return identity[:, 1:], list(levels[1:])
    if coding == "centered":
        return identity[:, 1:] - 1.0 / k, list(levels[1:])
    if coding == "sum":
        matrix = identity[:, :-1].copy()
        matrix[-1, :] = -1.0
        return matrix, list(levels[:-1])
    raise ValueError(f"unknown coding {coding}")


@dataclass
class Block:
    """One term's contribution: model column names and their raw weights."""

    term: Term
    names: list[str]
    weights: list[dict[tuple, float]]


@dataclass
class Design:
    """Resolved terms for one row set."""

    terms: list[Term]
    levels: dict[str, list[str]]
    shifts: dict[str, float]
    intercept: bool = True
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        if self.intercept:
            self.blocks.append(Block(Num("1"), [INTERCEPT], [{("1",): 1.0}]))
        for t in self.terms:
            self.blocks.append(self._block(t))

    # A raw key names a product of parts: ("1",), ("x",), ("g", level), ("g", level, "x").
    def _parts(self, part: Num | Cat) -> list[tuple[str, dict[tuple, float]]]:
        if isinstance(part, Num):
            weights = {(part.column,): 1.0}
            shift = self.shifts.get(part.column, 0.0)
            if shift:
                weights[("1",)] = shift
            return [(part.column, weights)]
        levels = self.levels[part.column]
        matrix, named = contrast_matrix(levels, part.coding)
        return [
            (
                f"{part.column}{name}",
                {(part.column, lv): matrix[i, j] for i, lv in enumerate(levels) if matrix[i, j]},
            )
            for j, name in enumerate(named)
        ]

    def _block(self, term: Term) -> Block:
        if not isinstance(term, Inter):
            parts = self._parts(term)
            return Block(term, [n for n, _ in parts], [w for _, w in parts])
        names, weights = [], []
        for left_name, left in self._parts(term.left):
            for right_name, right in self._parts(term.right):
                names.append(f"{left_name}:{right_name}")
                product: dict[tuple, float] = {}
                for a, wa in left.items():
                    for b, wb in right.items():
                        key = tuple(sorted(p for p in (a, b) if p != ("1",))) or (("1",),)
                        key = key[0] if len(key) == 1 else key
                        product[key] = product.get(key, 0.0) + wa * wb
                weights.append(product)
        return Block(term, names, weights)

    @property
    def names(self) -> list[str]:
        return [n for b in self.blocks for n in b.names]

    @property
    def raw_keys(self) -> list[tuple]:
        keys = dict.fromkeys(k for b in self.blocks for w in b.weights for k in w)
        return list(keys)

    def raw_column(self, key: tuple) -> Column:
        if key and isinstance(key[0], tuple):
            return reduce(lambda a, b: a * b, [self.raw_column(k) for k in key])
        if key == ("1",):
            return F.lit(1.0)
        if len(key) == 1:
            return F.col(key[0]).cast("double") - F.lit(self.shifts.get(key[0], 0.0))
        hit = F.col(key[0]).cast("string") == F.lit(key[1])
        return F.when(hit, 1.0).otherwise(0.0)

    @property
    def numbers(self) -> dict[str, Column]:
        """Shifted numeric columns by the name that raw keys use."""
        names = [c for c in used_columns(self.terms) if c not in self.levels]
        return {c: self.raw_column((c,)) for c in names}

    def mapping(self, raw_keys: Sequence[tuple], columns: Sequence[int] | None = None) -> np.ndarray:
        """Raw by model matrix, of all model columns or of the ones numbered in ``columns``."""
        position = {k: i for i, k in enumerate(raw_keys)}
        weights = [w for b in self.blocks for w in b.weights]
        chosen = range(len(weights)) if columns is None else columns
        matrix = np.zeros((len(raw_keys), len(chosen)), dtype=np.longdouble)
        for j, at in enumerate(chosen):
            for key, value in weights[at].items():
                matrix[position[key], j] += value
        return matrix

    def separate_factor(self, least: int) -> tuple[Block, str] | None:
        """The factor with most levels, at least ``least``, that is a main effect beside an intercept and in no product."""
        inside = {p.column for t in self.terms if isinstance(t, Inter) for p in (t.left, t.right)}
        sizes = [(len(self.levels[b.term.column]), b) for b in self.blocks if isinstance(b.term, Cat) and b.term.column not in inside]
        if not self.intercept or not sizes:
            return None
        size, block = max(sizes, key=lambda s: s[0])
        return (block, block.term.column) if size >= least else None

    @staticmethod
    def level_contrasts(term: Cat, k: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Levels with a coefficient, and the weights of the levels they and the intercept stand against."""
        first, mean = np.eye(k)[0], np.full(k, 1.0 / k)
        if term.coding == "treatment":
            return list(range(1, k)), first, first
        if term.coding == "centered":
            return list(range(1, k)), first, mean
        return list(range(k - 1)), mean, mean

    def row(self, values: dict) -> np.ndarray:
        """Model columns for one combination of regressor values."""

        def raw(key: tuple) -> float:
            if key and isinstance(key[0], tuple):
                return float(np.prod([raw(k) for k in key]))
            if key == ("1",):
                return 1.0
            if len(key) == 1:
                return float(values[key[0]]) - self.shifts.get(key[0], 0.0)
            return float(str(values[key[0]]) == key[1])

        return np.array(
            [sum(raw(k) * v for k, v in w.items()) for b in self.blocks for w in b.weights]
        )

    def with_value(self, rows: DataFrame, coefficients: Mapping[str, float], out: str) -> DataFrame:
        """Add the model's value; NULL for an unknown input or an unseen level.

        The coefficients of a factor are a table of levels that the rows join;
        a small one is broadcast by its size, a large one is not. ``out`` may
        not name a column that the model uses.
        """
        constant, slopes, tables = self._values(coefficients)
        numbers = self.numbers

        def scaled(value: Column, names: tuple[str, ...]) -> Column:
            return reduce(lambda a, b: a * b, [numbers[n] for n in names], value)

        parts = [F.lit(constant), *[scaled(F.lit(v), names) for names, v in slopes.items()]]
        helpers = []
        for t, (columns, by_level) in enumerate(tables.items()):
            powers = list(dict.fromkeys(n for values in by_level.values() for n in values))
            keys, values = [f"__{out}_k{t}_{i}" for i in range(len(columns))], [f"__{out}_v{t}_{i}" for i in range(len(powers))]
            data = {k: [levels[i] for levels in by_level] for i, k in enumerate(keys)}
            data |= {v: [found.get(n, 0.0) for found in by_level.values()] for v, n in zip(values, powers)}
            types = [pa.string()] * len(keys) + [pa.float64()] * len(values)
            side = rows.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(data.values(), types)], list(data)))
            same = [F.col(c).cast("string") == F.col(k) for c, k in zip(columns, keys)]
            rows = rows.join(side, reduce(lambda a, b: a & b, same), "left")
            parts += [scaled(F.col(v), n) for v, n in zip(values, powers)]
            helpers += [*keys, *values]
        return rows.withColumn(out, reduce(lambda a, b: a + b, parts)).drop(*helpers)

    def _values(self, coefficients: Mapping[str, float]) -> tuple[float, dict, dict]:
        """Coefficients by raw key: constant, slopes of numbers, and level tables per set of factors."""
        constant, slopes, tables = 0.0, {}, {}
        for block in self.blocks:
            for name, weights in zip(block.names, block.weights):
                beta = coefficients.get(name, 0.0)
                for key, weight in weights.items():
                    parts = key if isinstance(key[0], tuple) else (key,)
                    numbers = tuple(p[0] for p in parts if len(p) == 1 and p != ("1",))
                    levels = dict(p for p in parts if len(p) == 2)
                    if levels:
                        columns = tuple(sorted(levels))
                        table = tables.setdefault(columns, {}).setdefault(tuple(levels[c] for c in columns), {})
                        table[numbers] = table.get(numbers, 0.0) + beta * weight
                    elif numbers:
                        slopes[numbers] = slopes.get(numbers, 0.0) + beta * weight
                    else:
                        constant += beta * weight
        for column in factors(self.terms):
            tables.setdefault((column,), {})
        # a reference level has no weight of its own, yet is a known level
        for columns, by_level in tables.items():
            for levels in product(*(self.levels[c] for c in columns)):
                by_level.setdefault(levels, {})
        return constant, slopes, tables


def _levels_of(column: Column) -> Column:
    """Distinct values in their own order, as text."""
    return F.transform(F.array_sort(F.collect_set(column)), lambda v: v.cast("string"))


def resolve(
    df: DataFrame, terms: Sequence[Term], numeric: Sequence[str] = ()
) -> tuple[Design, int]:
    """Levels, shifts and row count of a row set that is already complete, in one job.

    Levels come in the order of the column's own type unless the term lists
    them; their number is the model's number of columns. Numbers are shifted to their mean before products are summed; this keeps
    the sums well conditioned. ``numeric`` names further columns (the
    response) to centre.
    """
    return resolve_all(df, [Wanted(terms, numeric)])[0]


@dataclass
class Wanted:
    """Terms to resolve over the rows where ``mask`` holds, each counted ``count`` times.

    ``columns`` gives expressions for names that the rows do not hold under that
    name; ``totals`` are sums over the same rows, which ``resolve_all`` leaves in ``found``.
    """

    terms: Sequence[Term]
    numeric: Sequence[str] = ()
    mask: Column | None = None
    count: Column | None = None
    columns: Mapping[str, Column] = field(default_factory=dict)
    totals: Mapping[str, Column] = field(default_factory=dict)
    found: dict[str, float] = field(default_factory=dict)


def resolve_all(df: DataFrame, wanted: Sequence[Wanted]) -> list[tuple[Design, int]]:
    """Designs and row counts of several models over one table, in one job."""
    asked, plan = {}, []
    for m, w in enumerate(wanted):
        cats = factors(w.terms)
        numbers = [c for c in dict.fromkeys([*used_columns(w.terms), *w.numeric]) if c not in cats]
        mask = F.lit(True) if w.mask is None else w.mask
        asked[f"n{m}"] = F.sum(F.when(mask, F.lit(1) if w.count is None else w.count))
        for i, c in enumerate(numbers):
            asked[f"m{m}_{i}"] = F.avg(F.when(mask, w.columns.get(c, F.col(c)).cast("double")))
        for i, c in enumerate(cats):
            asked[f"l{m}_{i}"] = _levels_of(F.when(mask, F.col(c)))
        for i, c in enumerate(w.totals.values()):
            asked[f"t{m}_{i}"] = F.sum(F.when(mask, c))
        plan.append((cats, numbers))
    row = df.agg(*[c.alias(n) for n, c in asked.items()]).first()
    out = []
    for m, (w, (cats, numbers)) in enumerate(zip(wanted, plan)):
        levels = {}
        for i, (c, spec) in enumerate(cats.items()):
            seen = list(row[f"l{m}_{i}"])
            levels[c] = [v for v in map(str, spec.levels) if v in set(seen)] if spec.levels else seen
        shifts = {c: float(row[f"m{m}_{i}"] or 0.0) for i, c in enumerate(numbers)}
        w.found.update({c: float(row[f"t{m}_{i}"] or 0.0) for i, c in enumerate(w.totals)})
        out.append((Design(list(w.terms), levels, shifts), int(row[f"n{m}"] or 0)))
    return out
