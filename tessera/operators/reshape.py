"""Wide to long, long to wide, and fills inside panel groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import as_col, int_text
from tessera.functions.slots import flag_label
from tessera.operators.groups import with_group_total
from tessera.sources.tables import stage_derived


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """Wide to long; without ``values`` every other column is melted."""
    values = list(values) if values else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, variable, value)


def melt_years(df: DataFrame, ids: Sequence[str], value: str, year: str = "year") -> DataFrame:
    """One column per year to long form with an integer year."""
    long = melt(df, ids, None, year, value)
    return long.withColumn(year, F.regexp_extract(year, r"(\d{4})", 1).try_cast("int"))


def spread(
    df: DataFrame, keys: Sequence[str], column: str, value: Column, first: Sequence = (), only_first: bool = False
) -> DataFrame:
    """Long to wide, one column per level that occurs (eager: cells are counted and staged).

    The rows are read once, into one cell per key and level; the levels come
    from those cells. ``first`` puts levels in front, present or not; the
    others follow in their own order. With ``only_first`` a level that
    ``first`` lacks is refused by name instead. A NULL level is no column; a
    level named like a key is refused.
    """
    cells = stage_derived(df.groupBy(*keys, column).agg(value.alias("__value")))
    seen = cells.select(column).where(F.col(column).isNotNull()).distinct()
    more = seen.where(~F.col(column).isin(list(first))) if first else seen
    more = [r[0] for r in more.orderBy(column).collect()]
    if more and only_first:
        raise ValueError(f"levels of {column} outside the list: {more[:20]}")
    levels = [*first, *more]
    clash = {str(v) for v in levels} & set(keys)
    if clash:
        raise ValueError(f"levels of {column} named like a key: {sorted(clash)}")
    return cells.groupBy(*keys).pivot(column, levels).agg(F.first("__value"))


def impute_zero(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Zeros replaced by the smallest non-zero value of their group."""
    smallest = {"__min": F.min(F.when(F.col(value) != 0, F.col(value)))}
    filled = with_group_total(df, keys, smallest)
    chosen = F.when(F.col(value) == 0, F.col("__min")).otherwise(F.col(value))
    return filled.withColumn(out or value, chosen).drop("__min")


def set_flags_long(df: DataFrame, key: str, flags: Sequence[str], out: str) -> DataFrame:
    """Joined names of the set flags per key, from rows that may repeat a key.

    Each flag is reduced to its maximum per key before the names are joined,
    which keeps the group state at one value per flag.
    """
    combined = df.groupBy(key).agg(*[F.max(f).alias(f) for f in flags])
    return combined.select(key, flag_label(list(flags)).alias(out))


def padded(col, width: int = 2) -> Column:
    """Whole number as zero-padded text."""
    return F.lpad(int_text(as_col(col)), width, "0")
