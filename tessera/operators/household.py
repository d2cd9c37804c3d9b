"""Household members held in numbered columns.

One row describes a household: attribute ``EDAD03`` belongs to member 3, and
``P02_05`` is the relation of member 5 as stated by member 2. The selected
member's number picks the row of that relation matrix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import is_true, total
from tessera.functions.slots import pick_by_index, slot_columns

# Relation codes of the questionnaire.
PARTNER, CHILD, SIBLING = 1, 5, 7
HOUSEMATES = (11, 14)
SPANISH_BORN = "108"


def relation_columns(
    df: DataFrame, selected: str, slots: Sequence[int], prefix: str = "P", out: str = "relation"
) -> DataFrame:
    """Relation of each member to the selected member, one column per slot."""
    have = set(df.columns)
    picked = {}
    for h in slots:
        column = {
            n: f"{prefix}{n:02d}_{h:02d}" for n in slots if f"{prefix}{n:02d}_{h:02d}" in have
        }
        picked[f"{out}{h:02d}"] = (
            F.when(F.col(selected) != h, pick_by_index(column, selected)) if column else F.lit(None)
        )
    return df.withColumns(picked)


def member_attributes(
    df: DataFrame, selected: str, slots: Sequence[int], attributes: Mapping[str, str]
) -> DataFrame:
    """Attributes of everyone but the selected member: ``{prefix: out}``."""
    have = set(df.columns)
    wide = {}
    for prefix, out in attributes.items():
        for h in slots:
            source = f"{prefix}{h:02d}"
            if source in have:
                wide[f"{out}{h:02d}"] = F.when(F.col(selected) != h, F.col(source))
    return df.withColumns(wide)


def household_counts(
    df: DataFrame,
    size: str,
    slots: Sequence[int],
    relation: str = "compi_relation",
    age: str = "compi_age",
    country: str = "compi_country",
) -> DataFrame:
    """Counts over the other members, in one projection.

    Housemates and dependents are unknown for one-person households; the
    partner counts start at zero for everyone.
    """
    slots = [h for h in slots if f"{relation}{h:02d}" in df.columns]

    def members(rule) -> Column:
        return total(F.when(is_true(rule(h)), 1).otherwise(0) for h in slots)

    def rel(h):
        return F.col(f"{relation}{h:02d}")

    def born_here(h):
        return F.col(f"{country}{h:02d}") == SPANISH_BORN

    shared = F.col(size) > 1
    return df.withColumns(
        {
            "spanish_housemates": F.when(
                shared, members(lambda h: rel(h).isin(*HOUSEMATES) & born_here(h))
            ),
            "dependents": F.when(
                shared, members(lambda h: (F.col(f"{age}{h:02d}") < 16) & (rel(h) == CHILD))
            ),
            "spanish_partner": members(lambda h: (rel(h) == PARTNER) & born_here(h)),
            "partner_convive": members(lambda h: rel(h) == PARTNER),
            "HH_convive": members(lambda h: rel(h) == SIBLING),
        }
    )


def member_rows(
    df: DataFrame, keys: Sequence[str], slots: Sequence[int], attributes: Sequence[str]
) -> DataFrame:
    """One row per member slot, dropping empty slots."""
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("member"),
                *[F.col(f"{a}{h:02d}").alias(a) for a in attributes],
            )
            for h in slots
        ]
    )
    known = total(F.when(F.col(a).isNotNull(), 1).otherwise(0) for a in attributes)
    return df.select(*keys, F.inline(rows)).filter(known > 0)


def reference_person(
    df: DataFrame, selected: str, attributes: Mapping[str, str]
) -> DataFrame:
    """Attributes of the selected member: ``{prefix: out}``."""
    return df.withColumns(
        {out: pick_by_index(slot_columns(df, prefix), selected) for prefix, out in attributes.items()}
    )
