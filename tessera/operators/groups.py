"""Grouped counts, size rules, summaries and cross-tabs.

Everything aggregates before it shuffles. Group totals come from a second
aggregation joined back, not from a window: a window would bring all rows of
a hot group into one task, a partial aggregate sends one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import safe_ratio
from tessera.operators.joins import null_safe_join
from tessera.sources.tables import stage_derived


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def keep_large_groups(
    df: DataFrame, keys: str | Sequence[str], k: int, null_groups: bool = False
) -> DataFrame:
    """Rows of groups with more than ``k`` rows (runs a job at once).

    A row with a NULL key belongs to no group and goes, unless ``null_groups``
    makes NULL a key like any other. The surviving keys are staged as a file
    first. While they fit the broadcast threshold, the rows are filtered where
    they lie, without a shuffle; a longer key list joins by sort-merge.
    """
    keys = _keys(keys)
    if not null_groups:
        df = df.dropna(subset=keys)
    large = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > k)
    return null_safe_join(df, stage_derived(large.select(*keys)), keys, "left_semi")


def with_group_total(
    df: DataFrame, keys: str | Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """Add group aggregates to each row."""
    keys = _keys(keys)
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return null_safe_join(df, grouped, keys)


def within_group_percent(
    df: DataFrame, keys: str | Sequence[str], value: str, out: str, factor: float = 100.0
) -> DataFrame:
    """Each row's share of its group's sum, times ``factor``."""
    summed = with_group_total(df, keys, {"__sum": F.sum(value)})
    return summed.withColumn(out, safe_ratio(value, "__sum") * factor).drop("__sum")


def group_summary(df: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    """Count, mean and sample standard deviation of known values."""
    return df.groupBy(*_keys(keys)).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    )


def cohort_summary(df: DataFrame, cohort: str, values: Sequence[str]) -> DataFrame:
    """Mean, sd and known count per cohort, one row per (cohort, variable).

    One scan: every column is aggregated beside the others and only the
    small result is turned into long form.
    """
    aggs = []
    for v in values:
        aggs += [
            F.avg(v).alias(f"{v}__mean"),
            F.stddev_samp(v).alias(f"{v}__sd"),
            F.count(v).alias(f"{v}__n"),
        ]
    wide = df.filter(F.col(cohort).isNotNull()).groupBy(cohort).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                F.col(f"{v}__mean").alias("mean"),
                F.col(f"{v}__sd").alias("sd"),
                F.col(f"{v}__n").alias("n"),
            )
            for v in values
        ]
    )
    return wide.select(cohort, F.inline(rows))


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    value: str,
    rows: Sequence[str],
    cols: Sequence[str],
    total: str = "Total",
) -> DataFrame:
    """Count, mean and sd per displayed cell, with margins over all levels.

    Row and column margins include levels that are not displayed, and the
    grand total covers every row.
    """
    v = F.col(value).cast("double")
    # finest cells first: the margins then add up cells, not rows
    fine = df.groupBy(row, col).agg(
        F.count(v).alias("__n"), F.avg(v).alias("__mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("__m2")
    )
    mean = F.sum(F.col("__n") * F.col("__mean")) / F.sum("__n")
    # squares about the overall mean, by the parallel rule
    between = F.sum(F.col("__n") * F.col("__mean") * F.col("__mean")) - F.sum("__n") * mean * mean
    cells = fine.cube(row, col).agg(
        F.grouping_id().alias("__g"),
        F.sum("__n").alias("n"),
        F.when(F.sum("__n") > 0, mean).alias("mean"),
        F.when(F.sum("__n") > 1, F.sqrt(F.greatest(F.sum("__m2") + F.coalesce(between, F.lit(0.0)), F.lit(0.0)) / (F.sum("__n") - 1))).alias("sd"),
    )
    row_all, col_all = F.col("__g").bitwiseAND(2) != 0, F.col("__g").bitwiseAND(1) != 0
    shown = (row_all | F.col(row).isin(list(rows))) & (col_all | F.col(col).isin(list(cols)))
    return cells.filter(shown).select(
        F.when(row_all, total).otherwise(F.col(row)).alias(row),
        F.when(col_all, total).otherwise(F.col(col)).alias(col),
        "n",
        "mean",
        "sd",
    )


def cell_text(main, extra, main_digits: int = 2, extra_digits: int | None = None) -> Column:
    """``mean (n)`` or ``mean (sd)`` as text; numbers without trailing zeros or exponents."""
    return F.concat(_plain_number(main, main_digits), F.lit(" ("), _plain_number(extra, extra_digits or 0), F.lit(")"))


def _plain_number(value, digits: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    text = F.round(value.cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def crosstab_text(
    cells: DataFrame, row: str, col: str, text: Column, cols: Sequence[str], total: str = "Total"
) -> DataFrame:
    """Long cells to one row per ``row`` level, one text column per ``col`` level."""
    return cells.groupBy(row).pivot(col, [*cols, total]).agg(F.first(text, ignorenulls=True))


def frequency_table(df: DataFrame, column: str, above: int = 0) -> DataFrame:
    """Level counts above a threshold, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("freq"))
    return counts.filter(F.col("freq") > above).orderBy(F.desc("freq"), column)


def level_counts(df: DataFrame, column: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Per level, how many rows satisfy each condition."""
    return df.groupBy(column).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def contingency_table(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Counts for every combination of known levels, zero cells included (eager jobs).

    Observed cells are counted once; the levels of the grid are the ones
    observed, and ``levels`` may add further ones per column. Cells of the grid
    are numbers from 0 to the product of the level counts, spread over
    partitions; each number is read as one digit per column, which a table of
    numbered levels turns into a value. Only the level counts reach the driver.
    """
    types = dict(df.dtypes)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    observed = stage_derived(df.filter(known).groupBy(*columns).agg(F.count("*").alias("freq")))
    numbered = {c: stage_derived(_numbered(observed.select(c), c, types[c], (levels or {}).get(c, []))) for c in columns}
    sizes = {c: t.count() for c, t in numbered.items()}
    grid = df.sparkSession.range(reduce(lambda a, b: a * b, sizes.values(), 1)).withColumnRenamed("id", "__cell")
    step = 1
    for c in columns:
        digit = F.floor(F.col("__cell") / F.lit(step)) % sizes[c] if step > 1 else F.col("__cell") % sizes[c]
        grid = grid.withColumn(f"__{c}", digit.cast("long")).join(numbered[c], f"__{c}").drop(f"__{c}")
        step *= sizes[c]
    return grid.select(*columns).join(observed, list(columns), "left").na.fill(0, ["freq"])


def _numbered(seen: DataFrame, column: str, kind: str, more: Sequence) -> DataFrame:
    """Distinct levels numbered from 0, in their own order; numbers count up along sorted partitions."""
    every = seen.distinct()
    if more:
        extra = F.explode(F.array(*[F.lit(v).cast(kind) for v in more])).alias(column)
        every = every.unionByName(seen.sparkSession.range(1).select(extra)).distinct()
    ordered = stage_derived(every.repartitionByRange(column).sortWithinPartitions(column).select(
        column, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")
    ))
    parts = ordered.groupBy("__part").count().collect()  # one row per partition
    before, start = {}, 0
    for row in sorted(parts, key=lambda r: r["__part"]):
        before[row["__part"]], start = start, start + row["count"]
    if not before:
        return ordered.select(column, F.lit(0).cast("long").alias(f"__{column}"))
    offset = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])[F.col("__part")]
    return ordered.select(column, (offset + F.col("__at")).alias(f"__{column}"))


def unit_scale(df: DataFrame, factors: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Rescaled copies of columns: ``{out: (column, factor)}``."""
    return df.withColumns({out: F.col(c) * factor for out, (c, factor) in factors.items()})
