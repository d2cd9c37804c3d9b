"""Lookups, panel joins and shares.

No side is forced to broadcast. Spark broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold``, judged from file statistics at
planning time and from real shuffle sizes at run time; anything larger takes
a sort-merge join whose hot keys adaptive execution splits. Left joins here
keep the row count because dimension keys are checked for uniqueness or
grouped first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.semantics import safe_ratio
from tessera.sources.tables import stage_derived


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join on same-named keys where NULL matches NULL."""
    renamed = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__key_{k}"]) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__key_{k}" for k in keys])


def duplicate_keys(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a sound dimension."""
    return dim.groupBy(*keys).count().filter("count > 1")


def require_unique(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a left join to ``dim`` would multiply rows (runs a job at once)."""
    bad = duplicate_keys(dim, keys).head(1)
    if bad:
        raise ValueError(f"dimension key {list(keys)} is not unique, e.g. {bad[0].asDict()}")
    return dim


def decode(
    df: DataFrame,
    dim: DataFrame,
    code: str,
    labels: Mapping[str, str],
    on: str = "code",
) -> DataFrame:
    """Code to one or many labels of a dimension in one join.

    ``labels`` maps dimension columns to output columns. NULL codes and codes
    the dimension lacks give NULL; ``unknown_codes`` reports the latter.
    """
    side = dim.select(
        F.col(on).alias(f"__{code}"), *[F.col(c).alias(out) for c, out in labels.items()]
    )
    return df.join(side, F.col(code) == F.col(f"__{code}"), "left").drop(f"__{code}")


class DecodeAudit:
    """What a decoding join met, taken while the rows pass (see ``decode_audited``)."""

    def __init__(self, before: Observation, after: Observation, dim: Observation):
        self._parts = before, after, dim

    def counts(self) -> dict[str, int]:
        """``rows_in``, ``rows_out``, ``null_codes``, ``unknown_codes``, ``dim_rows`` and ``added_rows``.

        Known once an action has read the decoded frame to its end; until then
        the call waits. ``added_rows`` above 0 means that the dimension repeats
        a key that the rows use.
        """
        found = {k: int(v or 0) for part in self._parts for k, v in part.get.items()}
        return found | {"added_rows": found["rows_out"] - found["rows_in"]}


def decode_audited(
    df: DataFrame, dim: DataFrame, code: str, labels: Mapping[str, str], on: str = "code"
) -> tuple[DataFrame, DecodeAudit]:
    """``decode`` with an account of what it met, from the same job.

    Metrics are observed on both sides of the join, so neither side is read
    again to find unknown codes or repeated keys.
    """
    before, after, known = Observation(), Observation(), Observation()
    side = dim.select(
        F.col(on).alias(f"__{code}"), F.lit(True).alias(f"__{code}_known"), *[F.col(c).alias(out) for c, out in labels.items()]
    ).observe(known, F.count(F.lit(1)).alias("dim_rows"))
    rows = df.observe(before, F.count(F.lit(1)).alias("rows_in"))
    joined = rows.join(side, F.col(code) == F.col(f"__{code}"), "left").observe(
        after,
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if(F.col(code).isNull()).alias("null_codes"),
        F.count_if(F.col(code).isNotNull() & F.col(f"__{code}_known").isNull()).alias("unknown_codes"),
    )
    return joined.drop(f"__{code}", f"__{code}_known"), DecodeAudit(before, after, known)


def broadcast_size(df: DataFrame) -> bool:
    """Whether Spark would broadcast this frame: its planned size against the session's threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def decode_slots(
    df: DataFrame,
    dim: DataFrame,
    columns: Mapping[str, str],
    label: str = "label",
    on: str = "code",
    key: Sequence[str] = (),
    large: bool | None = None,
) -> DataFrame:
    """Decode several code columns through one dimension with unique codes.

    A dimension small enough for Spark to broadcast is shipped once and
    reused by every join, so the rows are not shuffled. A larger one would be
    shuffled once per slot. With ``key`` (columns that tell the rows apart) the
    slots are then put under each other, meet it in one join, and return to
    their row by position. The dimension is staged first (an eager job); its
    stored size decides, unless ``large`` does.
    """
    side = stage_derived(dim.select(F.col(on).alias("__code"), F.col(label).alias("__label")))
    if large is None:
        large = bool(key) and not broadcast_size(side)
    if not large:
        for code, out in columns.items():
            df = decode(df, side, code, {"__label": out}, "__code")
        return df
    if not key:
        raise ValueError("a row key is needed to bring decoded slots back to their row")
    slots = F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("code")) for i, c in enumerate(columns)])
    long = df.select(*key, F.explode(F.filter(slots, lambda s: s["code"].isNotNull())).alias("s"))
    met = long.select(*key, "s.at", "s.code").join(side, F.col("code") == F.col("__code"))
    wide = met.groupBy(*key).agg(*[F.max(F.when(F.col("at") == i, F.col("__label"))).alias(out) for i, out in enumerate(columns.values())])
    return null_safe_join(df, wide, key)


def unknown_codes(df: DataFrame, dim: DataFrame, code: str, on: str = "code") -> DataFrame:
    """Codes in the data that the dimension lacks, with their row counts."""
    seen = df.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).count()
    known = dim.select(F.col(on).alias("code"))
    return seen.join(known, "code", "left_anti").withColumnRenamed("count", "n")


def fill_from_rows(
    df: DataFrame,
    key: str,
    lookup_key: str,
    lookup_value: str,
    out: str,
    skip: Sequence[str] = (),
    order: Column | None = None,
) -> DataFrame:
    """Fill ``out`` from a lookup built out of the same rows (written at once).

    Per ``lookup_key`` the value of the last row in ``order`` wins (see
    ``tables.source_order`` for the order of the files); without an order, the
    greatest value. Both are map-side combined, so a hot key costs
    one row per partition in the shuffle, and the lookup is staged so that the
    rows themselves are only shuffled if it is too large to broadcast.
    """
    usable = df.filter(F.col(lookup_key).isNotNull() & ~F.col(lookup_key).isin(list(skip) or [""]))
    last = F.max_by(lookup_value, order) if order is not None else F.max(lookup_value)
    lookup = usable.groupBy(F.col(lookup_key).alias("__key")).agg(last.alias(out))
    return df.join(stage_derived(lookup), F.col(key) == F.col("__key"), "left").drop("__key")


def panel_join(
    df: DataFrame,
    panel: DataFrame,
    on: Mapping[str, str],
    values: Mapping[str, str],
) -> DataFrame:
    """Left join to a panel on several keys; one join can carry many values.

    ``on`` maps row columns to panel keys, ``values`` panel columns to output
    columns. A NULL key matches nothing. The panel is staged first (an eager
    job), so that a small one is broadcast from its real size instead of
    shuffling the rows.
    """
    side = stage_derived(
        panel.select(
            *[F.col(p).alias(f"__{r}") for r, p in on.items()],
            *[F.col(v).alias(out) for v, out in values.items()],
        )
    )
    condition = reduce(lambda a, b: a & b, [F.col(r) == F.col(f"__{r}") for r in on])
    return df.join(side, condition, "left").drop(*[f"__{r}" for r in on])


def panel_slices(
    panel: DataFrame,
    keys: Sequence[str],
    period: str,
    slices: Mapping[str, tuple],
) -> DataFrame:
    """Fixed-period slices side by side: ``{out: (value column, period)}``.

    Several fixed years become one row per key, so the big table needs one
    join instead of one per year.
    """
    periods = sorted({p for _, p in slices.values()})
    return (
        panel.filter(F.col(period).isin(periods))
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col(period) == p, F.col(value))).alias(out)
                for out, (value, p) in slices.items()
            ]
        )
    )


def map_panel(
    panel: DataFrame, crosswalk: DataFrame, column: str, source: str, target: str, weight: str, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """A panel on another classification: values of ``source`` levels handed to ``target`` levels by weight.

    A level may go to several targets and a target may take in several levels;
    parts add up per target and ``keys``. Levels that the crosswalk lacks go.
    Weights of a level that sum to 1 keep the panel's total.
    """
    side = stage_derived(crosswalk.select(F.col(source).alias("__from"), F.col(target).alias("__to"), F.col(weight).alias("__weight")))
    met = panel.join(side, F.col(column) == F.col("__from"))
    parts = [F.sum(F.col(v) * F.col("__weight")).alias(v) for v in values]
    return met.groupBy(*keys, F.col("__to").alias(column)).agg(*parts)


def share_of_total(
    df: DataFrame,
    part: str,
    total_level: str,
    value: str,
    on: Sequence[str],
    out: str | None = None,
    keep_total: bool = True,
) -> DataFrame:
    """Part rows with their "Total" row's value and the ratio of both."""
    out = out or f"{value}_relative"
    total = f"{value}_Total"
    totals = df.filter(F.col(part) == total_level).select(*on, F.col(value).alias(total))
    parts = df.filter(F.col(part) != total_level)
    joined = null_safe_join(parts, totals, on).withColumn(out, safe_ratio(value, total))
    return joined if keep_total else joined.drop(total)


def period_rates(
    fine: DataFrame, keys: Sequence[str], period: str, value: str, coarse_length: int = 4
) -> DataFrame:
    """Quarterly rows plus their yearly means, in one period column."""
    fine = fine.select(*keys, period, value)
    coarse = (
        fine.groupBy(*keys, F.substring(period, 1, coarse_length).alias(period))
        .agg(F.avg(value).alias(value))
        .select(*keys, period, value)
    )
    return fine.unionByName(coarse)


def attach_attributes(regions: DataFrame, values: DataFrame, region: str, on: str) -> DataFrame:
    """Values onto a region dimension; regions without values are kept."""
    side = values.withColumnRenamed(on, "__region")
    return regions.join(side, F.col(region) == F.col("__region"), "left").drop("__region")


def levels_present(
    dim: DataFrame, column: str, population: DataFrame, level: str, always: Sequence[str] = ()
) -> DataFrame:
    """Dimension rows whose level occurs in a population, plus listed exceptions."""
    present = population.select(F.col(level).alias(column)).distinct()
    if always:
        extra = dim.select(column).filter(F.col(column).isin(list(always)))
        present = present.unionByName(extra).distinct()
    return dim.join(present, column, "left_semi")
