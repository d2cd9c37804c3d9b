"""Scalar helpers: calendar arithmetic, bins, ordered levels, rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.semantics import as_col, member_of, r_ifelse, recode

# Months per answer code of "how long until the first job".
SEARCH_MONTHS = {1: 0, 2: 1, 3: 3, 4: 12, 5: 24, 6: 36}

# Midpoint of each monthly income bracket.
INCOME_MIDPOINTS = {
    1: 125, 2: 375, 3: 750, 4: 1250, 5: 1750, 6: 2500, 7: 4000, 8: 7500, 9: 10000,
}

# Municipality size classes by population.
SIZE_EDGES = [10000, 20000, 50000]
SIZE_LABELS = ["E1", "E2", "E3", "E4"]
SIZE_OTHER = "E9"


def month_start(year, month, default_month: int = 6) -> Column:
    """First day of a month; an unknown month takes ``default_month``."""
    month = F.coalesce(as_col(month).cast("int"), F.lit(default_month))
    return F.make_date(as_col(year).cast("int"), month, F.lit(1))


def minus_months(date, months) -> Column:
    """Subtract whole months, clamping at the month end."""
    return F.add_months(as_col(date), -as_col(months).cast("int"))


def quarter_label(month) -> Column:
    """Month number to T1..T4; empty text when unknown or out of range."""
    month = as_col(month)
    label = None
    for quarter in range(4):
        hit = member_of(month, [3 * quarter + 1, 3 * quarter + 2, 3 * quarter + 3])
        text = F.lit(f"T{quarter + 1}")
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return label.otherwise(F.lit(""))


def period_label(date, has_month: Column) -> Column:
    """``YYYYTq`` when the month was known, else ``YYYY``."""
    date = as_col(date)
    year = F.year(date).cast("string")
    full = F.concat(year, F.lit("T"), F.quarter(date).cast("string"))
    return F.when(date.isNull(), None).when(has_month, full).otherwise(year)


def period_year(label) -> Column:
    return F.substring(as_col(label), 1, 4).try_cast("int")


def years_since(year, reference: int | Column) -> Column:
    """Completed years, never negative."""
    reference = reference if isinstance(reference, Column) else F.lit(reference)
    gap = reference - as_col(year)
    return r_ifelse(gap > 0, gap, F.lit(0))


def size_class(
    count,
    edges: Sequence[float] = tuple(SIZE_EDGES),
    labels: Sequence[str] = tuple(SIZE_LABELS),
    other: str = SIZE_OTHER,
) -> Column:
    """Right-closed size classes over whole counts from zero.

    Above the last edge any value takes the last label; a negative or
    fractional count below it takes ``other``; NULL stays NULL.
    """
    count = as_col(count)
    whole = (count >= 0) & (count == F.floor(count))
    chain = F.when(count.isNull(), None)
    for edge, label in zip(edges, labels):
        chain = chain.when(whole & (count <= edge), F.lit(label))
    return chain.when(count > edges[-1], F.lit(labels[-1])).otherwise(F.lit(other))


def split_at(count, edge: float = 50000, below: str = "<= 50,000", above: str = "> 50,000") -> Column:
    return r_ifelse(as_col(count) <= edge, below, above)


def level_rank(col, levels: Sequence[str]) -> Column:
    """Position of a value in an ordered level list; NULL when not listed."""
    return recode(col, {level: i for i, level in enumerate(levels)}, keep_unmapped=False)


def relabel(col, labels: Mapping[str, str]) -> Column:
    """Translate or coarsen categories; values outside the map become NULL."""
    return recode(col, labels, keep_unmapped=False)


def bracket_value(reported, bracket, midpoints: Mapping[int, float] = INCOME_MIDPOINTS) -> Column:
    """Reported amount, else the midpoint of its bracket."""
    return F.coalesce(as_col(reported), recode(bracket, midpoints))


def signif(col, digits: int) -> Column:
    """Round to significant digits."""
    col = as_col(col)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(col))))
    return F.when(col == 0, col).otherwise(F.round(col * scale) / scale)
