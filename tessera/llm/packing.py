"""Length buckets of least padding, and token-budget batches inside them.

The histogram of text lengths over all documents is exact up to 4,096 tokens
and in steps of 1/2,048 of an octave above, rounded up, so it has a bounded
number of cells whatever the corpus. Dynamic programming over it chooses the
bucket boundaries with the least total padded length; for a given number of
buckets each step is the lower envelope of straight lines, so the whole choice
is linear in the cells. Within a bucket as many texts share a batch as fit the
token budget when padded to the bucket's boundary; a text beyond the budget is
a batch of its own.

Texts are numbered inside a bucket without bringing it into one task: buckets
are split into shards of ``SHARD`` texts by row number, numbered by shard, and
offset by the shards before.

Defined cases: NULL and wordless texts have length 0 and are padded to their
bucket as length 1 would be; repeated rows each take their own slot; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage_derived

BUCKETS = 16
BUDGET = 16_384
EXACT, OCTAVE = 4_096, 2_048
SHARD = 20_000


def token_count(name: str = "text") -> Column:
    """Words of a text: runs without space, tab, line feed, vertical tab, form feed, return."""
    return F.coalesce(F.regexp_count(F.col(name).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cell(length: Column) -> Column:
    """The histogram cell (its upper end) of a length, at least 1."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length - 1, F.lit(1)))) - int(np.log2(OCTAVE))).cast("long")
    return F.when(length <= EXACT, F.greatest(length, F.lit(1))).otherwise(F.ceil(length / step) * step).cast("long")


def boundaries(cells: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ends of at most ``buckets`` ranges of the sorted cells with the least padded length.

    After k ranges, best[j] = min over i of before[i] + cells[j] * (total[j] - total[i]):
    for rising cells the minimum over lines of falling slope -total[i].
    """
    n = len(cells)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).tolist()
    before, choices = [0.0] + [float("inf")] * n, []
    for _ in range(min(buckets, n)):
        best, came, hull, at = [float("inf")] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if before[i] < float("inf"):
                line = (-total[i], before[i], i)
                while len(hull) >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            at = min(at, len(hull) - 1) if hull else 0
            x = cells[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if hull:
                best[j] = x * total[j] + hull[at][0] * x + hull[at][1]
                came[j] = hull[at][2]
        choices.append(came)
        if best[n] >= before[n]:
            choices.pop()
            break
        before = best
    ends, j = [], n
    for came in reversed(choices):
        ends.append(cells[j - 1])
        j = came[j]
    return sorted(ends)


def _useless(a, b, c) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for a ``n_tokens`` column, from the histogram of all rows."""
    histogram = lengths.groupBy(_cell(F.col("n_tokens")).alias("cell")).count().orderBy("cell").collect()
    return boundaries([r["cell"] for r in histogram], [r["count"] for r in histogram], buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``bucket`` (padded length), ``batch``, ``slot``, ``padding`` of every row.

    Batches are numbered from 0 within a bucket, slots from 0 within a batch.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), token_count().alias("n_tokens"))
    lengths = stage_derived(narrow.withColumn("row", F.monotonically_increasing_id()))
    ends = length_buckets(lengths, buckets)
    if not ends:
        return lengths.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in _MORE])
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(_cell(F.col("n_tokens")) <= end, F.lit(end)).otherwise(bucket)
    shards = max(1, lengths.count() // SHARD)
    placed = lengths.select("*", bucket.cast("long").alias("bucket"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    sizes = placed.groupBy("bucket", "shard").count()
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id", "row")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1).join(stage_derived(offsets), ["bucket", "shard"])
    place, fit = F.col("place") + F.col("offset"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return numbered.select(
        "doc_id", "n_tokens", "bucket", F.floor(place / fit).alias("batch"), (place % fit).cast("int").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )


_MORE = [("bucket", "long"), ("batch", "long"), ("slot", "int"), ("padding", "long")]


def bucket_of(length: int, ends: list[int]) -> int:
    """Boundary that a length is padded to (as ``pack`` assigns it)."""
    return ends[min(bisect_left(ends, max(1, length)), len(ends) - 1)]


__all__ = ["boundaries", "bucket_of", "length_buckets", "pack", "token_count"]
