"""Column helpers that keep the missing-value rules of statistical survey code.

Survey recodes are written with the rule "unknown in, unknown out". SQL's
``CASE WHEN NULL`` falls to the ELSE branch and ``NULL IN (...)`` is NULL, so
both need a guard. Every helper returns one JVM-side ``Column``; none of them
uses a lambda, so projections stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """Accept a column name or a Column."""
    return F.col(value) if isinstance(value, str) else value


def r_ifelse(condition: Column, yes, no) -> Column:
    """If/else where an unknown condition gives an unknown result."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(condition, yes).when(~condition, no)


def member_of(col, values: Iterable) -> Column:
    """Set membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(as_col(col).isin(list(values)), F.lit(False))


def is_true(condition: Column) -> Column:
    """Collapse an unknown condition to FALSE."""
    return F.coalesce(condition, F.lit(False))


def null_if(col, codes: Iterable) -> Column:
    """Turn sentinel codes (999, 0, 99, ...) into NULL."""
    col = as_col(col)
    return F.when(~member_of(col, codes), col)


def blank_to_null(col, also: Iterable[str] = ()) -> Column:
    """Trim text; empty text and the codes in ``also`` become NULL."""
    return null_if(F.trim(as_col(col)), ["", *also])


def recode(col, mapping: Mapping, keep_unmapped: bool = True) -> Column:
    """Replace values by ``mapping``; a target of None gives NULL.

    Unmapped values pass through unless ``keep_unmapped`` is False.
    """
    col = as_col(col)
    chain = None
    for source, target in mapping.items():
        hit = col == F.lit(source)
        chain = F.when(hit, F.lit(target)) if chain is None else chain.when(hit, F.lit(target))
    if chain is None:
        return col
    return chain.otherwise(col) if keep_unmapped else chain


def yes_no(col) -> Column:
    """Questionnaire coding 1 = yes, 6 = no as 1/0."""
    return recode(col, {1: 1, 6: 0})


def first_non_null(*cols) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def clamp_min(col, floor) -> Column:
    """Raise values below ``floor``; NULL stays NULL (plain greatest drops it)."""
    col = as_col(col)
    return F.when(col < floor, F.lit(floor)).otherwise(col)


def safe_ratio(numerator, denominator) -> Column:
    return F.try_divide(as_col(numerator), as_col(denominator))


def safe_ln(col) -> Column:
    """Natural log, NULL for zero and below."""
    col = as_col(col)
    return F.when(col > 0, F.ln(col))


def to_number(col) -> Column:
    """Text to double; blank or malformed text gives NULL, also under ANSI."""
    return F.trim(as_col(col)).try_cast("double")


def int_text(col) -> Column:
    """Whole number to text without a decimal part."""
    return as_col(col).cast("bigint").cast("string")


def total(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def row_sum(cols: Iterable) -> Column:
    """Row-wise sum with NULL counted as zero."""
    return total(F.coalesce(as_col(c), F.lit(0)) for c in cols)


def row_sum_strict(cols: Iterable) -> Column:
    """Row-wise sum, NULL as soon as one part is NULL."""
    return total(as_col(c) for c in cols)


def any_positive(score) -> Column:
    """1 when a score is above zero, 0 when not, NULL when unknown."""
    return r_ifelse(as_col(score) > 0, 1, 0)


def complete(cols: Iterable[str], numeric: Iterable[str] = ()) -> Column:
    """TRUE when no column is NULL (nor NaN for the numeric ones)."""
    tests = [F.col(c).isNotNull() for c in cols]
    tests += [~F.isnan(F.col(c)) for c in numeric]
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)


def name_key(col) -> Column:
    """Header-style key: blanks replaced by dots."""
    return F.replace(as_col(col), F.lit(" "), F.lit("."))
