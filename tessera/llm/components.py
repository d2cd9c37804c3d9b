"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import stage_derived

#: Links that one task of an iteration writes, at least; few links then make few files.
LINKS_PER_TASK = 200_000


def _smallest_neighbour(edges: DataFrame, both: bool) -> DataFrame:
    """One step: tie each node's neighbours to the smallest id near the node.

    ``edges`` runs from the larger id ``u`` to the smaller ``v``. With ``both``
    each node ties its larger neighbours (large star), else its smaller ones
    and itself (small star). The smallest id is a grouped minimum, combined
    before the shuffle; a node of very high degree meets one summary row in a
    join whose hot keys adaptive execution splits.
    """
    if both:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        tied = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        tied = tied.toDF("u", "v")
    return tied.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), total).head())


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every linked id.

    ``edges`` has two columns of comparable type; direction, repeats and
    self-links do not matter, rows with a NULL end are ignored. Ids without a
    link are absent. Alternates large-star and small-star steps, each written
    to the shared folder, until the links no longer change; then each id
    points at its component.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    edges = edges.filter("a is not null and b is not null and u <> v").select("u", "v").distinct()
    edges = stage_derived(edges)
    before, now = None, _state(edges)
    while before != now:
        tasks = now[0] // LINKS_PER_TASK + 1  # steps do not add links
        for both in (True, False):
            edges = stage_derived(_smallest_neighbour(edges, both).coalesce(tasks))
        before, now = now, _state(edges)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
