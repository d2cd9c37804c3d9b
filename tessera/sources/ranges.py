"""Row and column ranges of exported sheets.

Sheets carry title rows above their header and notes below their data. Their
lines are numbered where they lie, across splits of one file: Spark says which
file and block a line comes from, lines count up inside a block, and the counts
of the blocks before it (one row per block) give the offset. Nothing but the
header line reaches the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import stage_derived


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (from 1, per file) and ``value`` of text files (an eager job counts blocks)."""
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(
        F.col(place[0]).alias("file"), F.col(place[1]).alias("__block"), F.monotonically_increasing_id().alias("__at"), "value"
    )
    blocks = lines.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__block")) - F.col("__n")
    blocks = stage_derived(blocks.withColumn("__before", before)).withColumnsRenamed({"file": "__file", "__block": "__start"})
    same = (F.col("file") == F.col("__file")) & (F.col("__block") == F.col("__start"))
    number = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return lines.join(blocks, same).select("file", number.alias("line"), "value")


def column_numbers(columns: str | Sequence[int], width: int) -> list[int]:
    """Places (from 1) of a range like ``"B:D"`` or of listed places."""
    if isinstance(columns, str):
        ends = [0, 0]
        for i, letters in enumerate(columns.upper().split(":")):
            for c in letters:
                ends[i] = ends[i] * 26 + ord(c) - ord("A") + 1
        columns = range(ends[0], (ends[1] or ends[0]) + 1)
    places = list(columns)
    if not places or min(places) < 1 or max(places) > width:
        raise ValueError(f"columns {places} are not all within the sheet's {width}")
    return places


def read_range(
    spark: SparkSession,
    path: str,
    header_row: int | None = 1,
    first_row: int | None = None,
    last_row: int | None = None,
    columns: str | Sequence[int] | None = None,
    names: Sequence[str] | None = None,
    until_blank: bool = False,
    sep: str = ",",
    keep_line: bool = False,
) -> DataFrame:
    """Cells of a row and column range of delimited sheets, as text (eager jobs).

    ``header_row`` holds the names; without it ``names`` gives one for every
    column of the sheet. Data starts at ``first_row`` (below the header unless
    given) and ends at ``last_row``, or with ``until_blank`` before the first
    empty line from there on. Empty lines are no rows. A short line leaves its
    last cells NULL. All files of ``path`` must have the same header. A cell may
    be quoted, but not hold a line break. ``keep_line`` adds ``file`` and ``line``.
    """
    lines = numbered_lines(spark, path)
    if header_row is not None:
        found = [r[0] for r in lines.filter(F.col("line") == header_row).select("value").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"row {header_row} of {path}: {'no such row' if not found else 'files have other headers'}")
        names = [n.strip() for n in next(csv.reader(found, delimiter=sep))]
        first_row = first_row or header_row + 1
    if not names:
        raise ValueError("a sheet without a header row needs names")
    places = column_numbers(columns, len(names)) if columns is not None else list(range(1, len(names) + 1))
    chosen = [names[i - 1] for i in places]
    if len(set(chosen)) < len(chosen) or "" in chosen:
        raise ValueError(f"columns without a name of their own: {chosen}")
    blank = F.trim("value") == ""
    rows = lines.filter(F.col("line") >= (first_row or 1))
    if last_row is not None:
        rows = rows.filter(F.col("line") <= last_row)
    if until_blank:
        ends = rows.filter(blank).groupBy(F.col("file").alias("__file")).agg(F.min("line").alias("__end"))
        rows = rows.join(ends, F.col("file") == F.col("__file"), "left").filter(F.col("__end").isNull() | (F.col("line") < F.col("__end")))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(1, len(names) + 1)])
    cells = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep})
    kept = ["file", "line"] if keep_line else []
    parsed = rows.filter(~blank).select(*kept, cells.alias("__cells"))
    return parsed.select(*kept, *[F.col(f"__cells.c{i}").alias(n) for i, n in zip(places, chosen)])
