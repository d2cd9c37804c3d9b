"""Fixed-width scan, key repair, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.semantics import name_key
from tessera.queries.registry import query
from tessera.sources.fixed_width import Field, annotate, apply_types, parse_fixed_width, select_flagged
from tessera.sources.ranges import read_range
from tessera.sources.tables import shared_folder, stage_derived, table

CODEBOOK = [
    Field("key", "customer number", "N", 12),
    Field("nation", "country code", "AN", 2),
    Field("filler", "not kept", "AN", 3, keep=False),
    Field("balance", "blank when below zero", "N", 10),
    Field("segment", "padded text", "AN", 12),
]


@query(
    """
    SELECT c_custkey::DOUBLE AS key, lpad(c_nationkey::VARCHAR, 2, '0') AS nation,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, rpad(c_mktsegment, 12, ' ') AS segment
    FROM customer
    """
)
def fixed_width_typed(spark, folder):
    """Customer records written as fixed-width lines, then scanned by codebook."""
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(9,2)").cast("string"))
    line = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 12, " "),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.lit("###"),
        F.lpad(F.coalesce(balance, F.lit("")), 10, " "),
        F.rpad("c_mktsegment", 12, " "),
    )
    lines = table(spark, folder, "customer").select(line.alias("value"))
    kept = select_flagged(parse_fixed_width(lines, CODEBOOK), CODEBOOK)
    return annotate(apply_types(kept, CODEBOOK), CODEBOOK)


@query(
    """
    SELECT replace(o_orderpriority, ' ', '.') AS priority, count(*) AS n
    FROM orders GROUP BY 1
    """
)
def normalised_keys(spark, folder):
    """Blanks in keys replaced by dots before grouping."""
    keyed = table(spark, folder, "orders").select(name_key("o_orderpriority").alias("priority"))
    return keyed.groupBy("priority").agg(F.count("*").alias("n"))


@query(
    """
    SELECT o_custkey, count(*) AS n_orders, ROUND(sum(o_totalprice), 2) AS spent
    FROM orders GROUP BY 1
    """
)
def staged_table(spark, folder):
    """Stage output written to shared storage and read back."""
    spent = (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )
    return stage_derived(spent)


@query(
    """
    SELECT c_custkey % 4 AS sheet, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) + 4 AS line,
           c_nationkey::VARCHAR AS country, replace(c_mktsegment, 'U', 'U,') AS segment
    FROM customer
    """
)
def range_of_lines(spark, folder):
    """Customers written as four sheets with titles, a header in row 4 and notes; the data's middle columns read back."""
    quoted = F.concat(F.lit('"'), F.replace("c_mktsegment", F.lit("U"), F.lit("U,")), F.lit('"'))
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), quoted, F.lit("unused"))
    sheet = F.col("c_custkey") % 4
    data = table(spark, folder, "customer").select(sheet.alias("sheet"), F.col("c_custkey").alias("at"), row.alias("value"))
    fixed = [(-4, "Customers by country"), (-3, ""), (-2, "all segments, one row per customer"), (-1, "key,country,segment,note")]
    notes = [(1 << 60, ""), ((1 << 60) + 1, "Note: written by the query, 1, 2")]
    others = spark.range(4).select(F.col("id").alias("sheet"), F.inline(F.array(*[F.struct(F.lit(a).alias("at"), F.lit(v).alias("value")) for a, v in fixed + notes])))
    path = f"{shared_folder(spark)}/tessera-derived-{uuid.uuid4().hex}"
    ordered = data.unionByName(others).repartition(4, "sheet").sortWithinPartitions("sheet", "at")
    ordered.select("sheet", "value").write.partitionBy("sheet").text(path)
    found = read_range(spark, path, header_row=4, columns="B:C", until_blank=True, keep_line=True)
    number = F.regexp_extract("file", r"sheet=(\d+)", 1).cast("long")
    return found.select(number.alias("sheet"), "line", "country", "segment")
