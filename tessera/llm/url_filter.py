"""URL filters over time: dated list entries as intervals, joined as of fetch time.

A list entry says from when on a host pattern is listed under a category, or
no longer is. Per category and pattern an entry holds until the next one
begins, which gives validity intervals; those that list are kept, clipped to
the span of the captures and cut by time buckets. A capture meets the
intervals of its host and of the host's parent domains (two labels or more) in
its own bucket only, so a pattern with a long history costs a capture no more
than the entries of one bucket.

The join is an equi-join on pattern and bucket, whose hot keys adaptive
execution splits; Spark broadcasts the intervals if their size allows it.

Defined cases: NULL or unparsable URL, or NULL fetch time, matches nothing and
stays in the result; entries with NULL pattern or date are ignored; entries of
one moment: listing wins; repeated captures give repeated rows; empty tables give
an empty result or no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage_derived

BUCKET_DAYS = 7


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; NULL where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def domains_of(host: Column) -> Column:
    """The host and its parents of at least two labels (a single label stands alone)."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Listing intervals [since, until) of ``pattern``, ``category``, ``since``, ``listed``."""
    known = entries.filter("pattern is not null and since is not null")
    moments = known.groupBy("pattern", "category", "since").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("pattern", "category").orderBy("since")
    return moments.withColumn("until", F.lead("since").over(order)).filter("listed").drop("listed")


def _bucket(moment: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(moment.cast("timestamp")) / (days * 86400))


def filter_captures(captures: DataFrame, entries: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """Every capture (``page_id``, ``url``, ``fetched_at``) with the entries active at its time.

    Adds ``host``, ``blocked``, ``n_active`` (active intervals), ``categories``
    (sorted, comma-joined) and ``pattern`` (the most specific that is active).
    """
    # equal captures meet the list once and come back as often as they were
    rows = captures.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    seen = rows.groupBy("page_id", "url", "fetched_at", "host").agg(F.count("*").cast("int").alias("copies"))
    first, last = captures.agg(F.min("fetched_at"), F.max("fetched_at")).head()
    spans = stage_derived(validity(entries)).filter((F.col("since") <= F.lit(last)) & (F.col("until").isNull() | (F.col("until") > F.lit(first))))
    begin = _bucket(F.greatest("since", F.lit(first)), days)
    end = _bucket(F.least(F.coalesce("until", F.lit(last)), F.lit(last)), days)
    spans = spans.withColumn("bucket", F.explode(F.sequence(begin, end))) if first is not None else spans.withColumn("bucket", F.lit(0))
    asked = seen.select("*", F.explode_outer(domains_of(F.col("host"))).alias("domain"), _bucket(F.col("fetched_at"), days).alias("at"))
    active = (
        (F.col("domain") == F.col("pattern")) & (F.col("at") == F.col("bucket"))
        & (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    )
    met = asked.join(spans, active, "left").groupBy("page_id", "url", "fetched_at", "host", "copies")
    longest = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("pattern"))))
    found = met.agg(
        F.count("pattern").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        longest["pattern"].alias("pattern"),
    ).withColumn("blocked", F.col("n_active") > 0)
    return found.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies")
