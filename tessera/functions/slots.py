"""Operators over numbered columns (``EDAD01 .. EDAD15``) of one row.

The slot count is fixed by the questionnaire, so a row never holds an
unbounded group. Expressions are unrolled over the slots instead of using
array lambdas: lambdas fall out of code generation, unrolled CASE and
arithmetic do not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import as_col, is_true, r_ifelse, total


def slot_columns(df: DataFrame, prefix: str) -> dict[int, str]:
    """Index -> column name for ``prefix`` followed by digits, in index order."""
    pattern = re.compile(re.escape(prefix) + r"(\d+)$")
    found = {int(m.group(1)): c for c in df.columns if (m := pattern.match(c))}
    return dict(sorted(found.items()))


def _indexed(cols) -> dict[int, Column]:
    if isinstance(cols, dict):
        return {i: as_col(c) for i, c in cols.items()}
    return {i: as_col(c) for i, c in enumerate(cols, start=1)}


def _first_hit(tests: Sequence[tuple[Column, Column]]) -> Column:
    chain = None
    for hit, value in tests:
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain if chain is not None else F.lit(None)


def pick_by_index(cols, index) -> Column:
    """The slot named by another column; gaps and out-of-range give NULL."""
    slots = _indexed(cols)
    none = F.lit(None)
    dense = [slots.get(i, none) for i in range(1, max(slots) + 1)]
    return F.get(F.array(*dense), as_col(index).cast("int") - 1)


def last_match_index(cols, code, pad: int | None = None) -> Column:
    """Index of the last slot equal to ``code``; NULL without a match."""
    slots = _indexed(cols)
    found = _first_hit([(slots[i] == F.lit(code), F.lit(i)) for i in sorted(slots, reverse=True)])
    return F.lpad(found.cast("string"), pad, "0") if pad else found


def last_non_null(cols) -> Column:
    slots = _indexed(cols)
    return F.coalesce(*[slots[i] for i in sorted(slots, reverse=True)])


def pick_where(keys, values, code) -> Column:
    """Value beside a matching key; the last match wins, even if it is NULL."""
    keys, values = _indexed(keys), _indexed(values)
    return _first_hit([(keys[i] == F.lit(code), values[i]) for i in sorted(keys, reverse=True)])


def has_changed(cols) -> Column:
    """1 when the slots hold more than one distinct value, else 0.

    Two values differ exactly when the smallest differs from the greatest;
    both skip NULL.
    """
    slots = list(_indexed(cols).values())
    if len(slots) < 2:
        return F.lit(0)
    return F.when(F.greatest(*slots) != F.least(*slots), 1).otherwise(0)


def count_where(cols, predicate: Callable[[Column], Column]) -> Column:
    """How many slots satisfy a predicate; unknown counts as no."""
    return total(F.when(predicate(c), 1).otherwise(0) for c in _indexed(cols).values())


def position_at(cols, year) -> Column:
    """How many start years lie at or before ``year``, at least 1.

    Known only when both the year and the first start year are.
    """
    slots = _indexed(cols)
    year = as_col(year)
    reached = count_where(cols, lambda c: year >= c)
    known = year.isNotNull() & slots[min(slots)].isNotNull()
    return F.when(known, F.greatest(reached, F.lit(1)))


def flag_label(cols: dict[str, str] | Sequence[str]) -> Column:
    """Names of the flags equal to 1, joined in column order; NULL when none."""
    names = cols if isinstance(cols, dict) else {c: c for c in cols}
    parts = [F.when(F.col(c) == 1, F.lit(n)).otherwise(F.lit("")) for c, n in names.items()]
    return F.nullif(F.concat(*parts), F.lit(""))


def collapse_label(label, name: str) -> Column:
    """Replace any combined label containing ``name`` by ``name`` alone."""
    label = as_col(label)
    return F.when(is_true(label.contains(name)), F.lit(name)).otherwise(label)


def only_flag(label, name: str, unknown: str) -> Column:
    """1 when ``name`` is the only flag set, NULL when ``unknown`` is among them, else 0."""
    label = as_col(label)
    otherwise = F.when(~label.contains(unknown), F.lit(0))
    return r_ifelse(label == name, F.lit(1), otherwise)
