"""Selections, renames, cleaning passes and population filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import blank_to_null, complete, is_true, name_key, null_if
from tessera.operators.groups import keep_large_groups


def select_matching(df: DataFrame, pattern: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns whose name matches a regular expression."""
    return df.select(*matching(df, pattern, exclude))


def matching(df: DataFrame, pattern: str, exclude: Sequence[str] = ()) -> list[str]:
    regex = re.compile(pattern)
    return [c for c in df.columns if regex.search(c) and c not in exclude]


def select_unique(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Final projection; a column listed twice appears once."""
    return df.select(*dict.fromkeys(columns))


def with_renames(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Blanks in column names replaced by dots."""
    return df.withColumnsRenamed({c: c.replace(" ", ".") for c in df.columns if " " in c})


def normalise_key(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, name_key(column))


def null_codes(df: DataFrame, codes: Mapping[str, Iterable]) -> DataFrame:
    """Sentinel codes per column to NULL, in one projection."""
    return df.withColumns({c: null_if(c, values) for c, values in codes.items()})


def null_blanks(df: DataFrame, columns: Iterable[str], also: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({c: blank_to_null(c, also) for c in columns})


def complete_case(df: DataFrame, columns: Sequence[str], name: str = "complete_case") -> DataFrame:
    """Flag rows where every listed column is known."""
    types = dict(df.dtypes)
    numeric = [c for c in columns if types[c] in ("double", "float")]
    return df.withColumn(name, complete(columns, numeric))


def population(df: DataFrame, *steps: Column | tuple | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply population rules in order.

    A step is a filter condition, a ``(keys, k)`` pair that keeps groups with
    more than ``k`` rows, or a function on the frame. Order matters: a size
    rule counts the rows left by the steps before it.
    """
    for step in steps:
        if isinstance(step, Column):
            df = df.filter(is_true(step))
        elif isinstance(step, tuple):
            keys, k = step
            df = keep_large_groups(df, keys, k)
        else:
            df = step(df)
    return df


def drop_listed(col, values: Iterable) -> Column:
    """Condition that is TRUE for every value outside a list, NULL included."""
    return ~F.coalesce((F.col(col) if isinstance(col, str) else col).isin(list(values)), F.lit(False))
