"""Concentration of groups in places: absolute, relative, and change over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import safe_ln, safe_ratio
from tessera.operators.groups import with_group_total
from tessera.operators.joins import panel_slices, share_of_total

TOTAL = "Total"


def density_panel(
    rows: DataFrame, place: str, group: str, by: Sequence[str], total: str = TOTAL
) -> DataFrame:
    """Share of each group among the people of a place, with a row per group for all places.

    Rows are counted into cells first; every later step works on the cells.
    """
    cells = rows.groupBy(place, group, *by).agg(F.count("*").alias("n"))
    everywhere = (
        cells.groupBy(group, *by).agg(F.sum("n").alias("n")).withColumn(place, F.lit(total))
    )
    both = cells.unionByName(everywhere)
    sized = with_group_total(both, [place, *by], {"n_place": F.sum("n")})
    return sized.withColumn("density", safe_ratio("n", "n_place"))


def relative_density(
    panel: DataFrame, place: str, group: str, by: Sequence[str], total: str = TOTAL
) -> DataFrame:
    """Place share over the share in all places together."""
    return share_of_total(panel, place, total, "density", [group, *by])


def density_change(
    panel: DataFrame, keys: Sequence[str], period: str, first: int, last: int
) -> DataFrame:
    """Difference and log difference of a density between two periods."""
    wide = panel_slices(
        panel, keys, period, {"density_first": ("density", first), "density_last": ("density", last)}
    )
    change = F.col("density_last") - F.col("density_first")
    return wide.withColumn("density_change", change).withColumn("log_change", safe_ln(change))


def size_percentages(
    counts: DataFrame, province: str, by: Sequence[str], value: str = "Count"
) -> DataFrame:
    """Each cell's percent of its province and of the whole country."""
    sized = with_group_total(counts, [province, *by], {"__province": F.sum(value)})
    sized = with_group_total(sized, list(by), {"__country": F.sum(value)})
    return sized.withColumns(
        {
            "percent_prov_pop": safe_ratio(value, "__province") * 100,
            "percent_total_pop": safe_ratio(value, "__country") * 100,
        }
    ).drop("__province", "__country")
