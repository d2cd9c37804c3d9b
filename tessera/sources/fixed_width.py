"""Fixed-width text scans driven by a codebook.

A codebook row is (name, description, type, width, position, keep); type is
``AN`` for text and ``N`` for numbers. The codebook is schema, one row per
questionnaire column, so collecting it on the driver is bounded by the width
of the table. Each field is one ``substring`` of the line, so a later
projection drops unused fields before they are cut.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.semantics import to_number

TEXT, NUMBER = "AN", "N"


@dataclass(frozen=True)
class Field:
    name: str
    description: str
    kind: str
    width: int
    keep: bool = True


def load_codebook(df: DataFrame) -> list[Field]:
    """Codebook table to field list, in position order."""
    rows = df.select("name", "description", "type", "width", "position", "keep")
    ordered = sorted(rows.collect(), key=lambda r: r["position"])
    return [
        Field(r["name"], r["description"] or "", r["type"], int(r["width"]), r["keep"] == "Yes")
        for r in ordered
    ]


def _cut(line: Column, fields: Iterable[Field]) -> dict[str, Column]:
    cuts, start = {}, 1
    for f in fields:
        cuts[f.name] = F.substring(line, start, f.width)
        start += f.width
    return cuts


def parse_fixed_width(lines: DataFrame, codebook: list[Field], column: str = "value") -> DataFrame:
    """Cut every field out of a text column; all fields stay text."""
    cuts = _cut(F.col(column), codebook)
    return lines.select(*[c.alias(name) for name, c in cuts.items()])


def read_fixed_width(spark: SparkSession, path: str, codebook: list[Field]) -> DataFrame:
    return parse_fixed_width(spark.read.text(path), codebook)


def apply_types(df: DataFrame, codebook: list[Field]) -> DataFrame:
    """Numeric fields to double (blank or malformed gives NULL), one select."""
    kinds = {f.name: f.kind for f in codebook}
    return df.select(
        *[
            to_number(c).alias(c) if kinds.get(c) == NUMBER else F.col(c)
            for c in df.columns
        ]
    )


def annotate(df: DataFrame, codebook: list[Field]) -> DataFrame:
    """Attach descriptions as column comments."""
    notes = {f.name: f.description for f in codebook}
    return df.select(
        *[
            F.col(c).alias(c, metadata={"comment": notes[c]}) if c in notes else F.col(c)
            for c in df.columns
        ]
    )


def select_flagged(df: DataFrame, codebook: list[Field]) -> DataFrame:
    """Keep the columns the codebook marks as kept."""
    return df.select(*[f.name for f in codebook if f.keep])


def read_survey(spark: SparkSession, path: str, codebook: list[Field]) -> DataFrame:
    """Scan, prune, type and annotate a fixed-width survey file."""
    raw = read_fixed_width(spark, path, codebook)
    return annotate(apply_types(select_flagged(raw, codebook), codebook), codebook)
