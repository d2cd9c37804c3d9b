"""Cleaning, recodes, filters, bins and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import (
    bracket_value,
    level_rank,
    minus_months,
    month_start,
    period_label,
    period_year,
    quarter_label,
    relabel,
    signif,
    size_class,
    split_at,
    years_since,
)
from tessera.functions.semantics import (
    blank_to_null,
    clamp_min,
    first_non_null,
    member_of,
    name_key,
    null_if,
    r_ifelse,
    recode,
    safe_ln,
    safe_ratio,
    to_number,
)
from tessera.operators.clean import (
    complete_case,
    matching,
    null_blanks,
    null_codes,
    population,
    select_unique,
    with_renames,
)
from tessera.queries.registry import query
from tessera.sources.tables import table


def segment_rank(col: str) -> Column:
    return level_rank(col, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query(
    """
    SELECT o_orderkey,
           NULLIF(o_orderstatus, 'P') AS status,
           CASE WHEN o_custkey NOT IN (0, 999) THEN o_custkey END AS custkey,
           NULLIF(trim(substring(o_orderpriority, 3)), 'NOT SPECIFIED') AS priority
    FROM orders
    """
)
def null_cleaning(spark, folder):
    """Sentinel codes, blanks and padding to NULL."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" "), F.substring("o_orderpriority", F.lit(3), F.length("o_orderpriority")), F.lit("  ")).alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_custkey").alias("custkey"),
    )
    cleaned = null_blanks(orders, ["status"]).transform(null_codes, {"custkey": [0, 999]})
    cleaned = null_blanks(cleaned, ["priority"], also=["NOT SPECIFIED"])
    return cleaned.select("o_orderkey", "status", "custkey", "priority")


_KNOWN = "NULLIF(o_orderstatus, 'P')"


@query(
    f"""
    SELECT o_orderkey,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '5-LOW' THEN 'no'
                WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS urgent,
           CASE WHEN {_KNOWN} = 'F' THEN 1 WHEN {_KNOWN} <> 'F' THEN 0 END AS finished,
           CASE WHEN {_KNOWN} IS NOT NULL AND {_KNOWN} IN ('F', 'X') THEN 1 ELSE 0 END AS listed,
           CASE WHEN {_KNOWN} IS NULL THEN NULL WHEN {_KNOWN} = 'F' THEN 'done'
                WHEN o_totalprice > 250000 THEN 'large' ELSE 'open' END AS state
    FROM orders
    """
)
def recode_flags(spark, folder):
    """Pass-through recodes, unknown-propagating if/else, membership without NULL."""
    status = null_if("o_orderstatus", ["P"])
    return table(spark, folder, "orders").select(
        "o_orderkey",
        recode(
            "o_orderpriority", {"1-URGENT": "yes", "5-LOW": "no", "4-NOT SPECIFIED": None}
        ).alias("urgent"),
        r_ifelse(status == "F", 1, 0).alias("finished"),
        F.when(member_of(status, ["F", "X"]), 1).otherwise(0).alias("listed"),
        r_ifelse(
            status == "F", "done", r_ifelse(F.col("o_totalprice") > 250000, "large", "open")
        ).alias("state"),
    )


@query(
    """
    SELECT o_orderkey,
           COALESCE(CASE WHEN o_orderstatus = 'F' THEN y END,
                    CASE WHEN o_orderstatus = 'O' THEN y - 1 END, 1990) AS start_year,
           CASE WHEN s < 1998 THEN 1998 ELSE s END AS floored
    FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y,
                 CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS s
          FROM orders)
    """
)
def fallback_and_floor(spark, folder):
    """First known value of several, and a lower clamp that keeps NULL."""
    year = F.year("o_orderdate")
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        first_non_null(
            F.when(status == "F", year), F.when(status == "O", year - 1), F.lit(1990)
        ).alias("start_year"),
        clamp_min(F.when(status != "P", year), 1998).alias("floored"),
    )


@query(
    """
    WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
               WHERE o_totalprice > 50000 AND o_orderstatus <> 'P'
                 AND o_orderpriority NOT IN ('5-LOW')),
         b AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM a),
         c AS (SELECT * FROM b WHERE n > 2),
         d AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS m FROM c)
    SELECT o_custkey, o_orderkey, o_orderstatus FROM d WHERE m > 1
    """
)
def study_population(spark, folder):
    """Filters and group-size rules applied in order."""
    orders = table(spark, folder, "orders")
    return population(
        orders,
        (F.col("o_totalprice") > 50000) & (F.col("o_orderstatus") != "P"),
        ~member_of("o_orderpriority", ["5-LOW"]),
        lambda df: df.select("o_custkey", "o_orderkey", "o_orderstatus"),
        (["o_custkey"], 2),
        (["o_custkey", "o_orderstatus"], 1),
    )


@query(
    """
    SELECT d.doc_id, quality, toxic,
           (quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL) AS complete_case
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def complete_cases(spark, folder):
    """Flag documents whose labels are all known."""
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    joined = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    flagged = complete_case(joined, ["quality", "toxic", "lang"])
    return flagged.select("doc_id", "quality", "toxic", "complete_case")


@query(
    """
    SELECT o_orderkey,
           CASE WHEN v IS NULL THEN NULL
                WHEN v >= 0 AND v = floor(v) AND v <= 10000 THEN 'E1'
                WHEN v >= 0 AND v = floor(v) AND v <= 20000 THEN 'E2'
                WHEN v >= 0 AND v = floor(v) AND v <= 50000 THEN 'E3'
                WHEN v > 50000 THEN 'E4' ELSE 'E9' END AS size_class,
           CASE WHEN v <= 50000 THEN '<= 50,000' WHEN v > 50000 THEN '> 50,000' END AS side
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
                 WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 10)
                 ELSE o_totalprice / 10 END AS v FROM orders)
    """
)
def bins(spark, folder):
    """Right-closed size classes and a two-way split."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    value = F.when(status == "F", F.floor(price / 10).cast("double")).when(status == "O", price / 10)
    sized = table(spark, folder, "orders").select("o_orderkey", value.alias("v"))
    return sized.select(
        "o_orderkey", size_class("v").alias("size_class"), split_at("v").alias("side")
    )


@query(
    """
    SELECT c_custkey,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS segment_rank,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Industry'
                WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Home' END AS coarse,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 1
                WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 0 END AS coarse_rank
    FROM customer
    """
)
def ordered_levels(spark, folder):
    """Rank in an ordered level list; levels coarsened, then ranked again."""
    coarse = relabel(
        "c_mktsegment",
        {"AUTOMOBILE": "Industry", "MACHINERY": "Industry", "FURNITURE": "Home", "HOUSEHOLD": "Home"},
    )
    return table(spark, folder, "customer").select(
        "c_custkey",
        segment_rank("c_mktsegment").alias("segment_rank"),
        coarse.alias("coarse"),
        level_rank(coarse, ["Home", "Industry"]).alias("coarse_rank"),
    )


@query(
    """
    SELECT p_partkey,
           CASE WHEN p_size > 20 THEN p_retailprice
                ELSE CASE p_size % 10 WHEN 1 THEN 125.0 WHEN 2 THEN 375.0 WHEN 3 THEN 750.0
                     WHEN 4 THEN 1250.0 WHEN 5 THEN 1750.0 WHEN 6 THEN 2500.0 WHEN 7 THEN 4000.0
                     WHEN 8 THEN 7500.0 WHEN 9 THEN 10000.0 END END::DOUBLE AS amount
    FROM part
    """
)
def bracket_midpoint(spark, folder):
    """Reported amount, else the midpoint of a bracket."""
    reported = F.when(F.col("p_size") > 20, F.col("p_retailprice"))
    bracket = null_if((F.col("p_size") % 10).cast("double"), [0.0])
    amount = bracket_value(reported, bracket)
    return table(spark, folder, "part").select("p_partkey", amount.alias("amount"))


@query(
    """
    SELECT o_orderkey,
           CAST(make_date(y, COALESCE(m, 6), 1) AS DATE) AS start_month,
           CAST(make_date(y, COALESCE(m, 6), 1) - to_months(back) AS DATE) AS search_start,
           CASE WHEN m IS NOT NULL
                THEN year(make_date(y, m, 1) - to_months(back))::VARCHAR || 'T' ||
                     quarter(make_date(y, m, 1) - to_months(back))::VARCHAR
                ELSE year(make_date(y, 6, 1) - to_months(back))::VARCHAR END AS period,
           CAST(year(make_date(y, COALESCE(m, 6), 1) - to_months(back)) AS INTEGER) AS period_year,
           CASE WHEN m IS NULL THEN '' ELSE 'T' || ((m - 1) // 3 + 1)::VARCHAR END AS quarter,
           CASE WHEN 2000 - y > 0 THEN CAST(2000 - y AS INTEGER) ELSE 0 END AS years,
           CAST(o_orderdate AS DATE) AS day,
           CAST(CAST(o_orderdate AS DATE) - to_months(back) AS DATE) AS day_back
    FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y,
                 CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS INTEGER) END AS m,
                 CAST(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3'
                 THEN 3 WHEN '4' THEN 12 ELSE 24 END AS INTEGER) AS back FROM orders)
    """
)
def date_arithmetic(spark, folder):
    """Dates from parts, month subtraction, period labels, years since."""
    back = recode(F.substring("o_orderpriority", 1, 1).cast("int"), {1: 0, 2: 1, 3: 3, 4: 12, 5: 24})
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("y"),
        F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate")).alias("m"),
        back.alias("back"),
        F.to_date("o_orderdate").alias("day"),
    )
    dated = orders.withColumn("start_month", month_start("y", "m")).withColumn(
        "search_start", minus_months("start_month", "back")
    )
    period = period_label("search_start", F.col("m").isNotNull())
    return dated.select(
        "o_orderkey",
        "start_month",
        "search_start",
        period.alias("period"),
        period_year(period).alias("period_year"),
        quarter_label("m").alias("quarter"),
        years_since("y", 2000).alias("years"),
        "day",
        minus_months("day", "back").alias("day_back"),
    )


@query(
    """
    SELECT c_custkey,
           trim('  ' || c_mktsegment || ' ') AS trimmed,
           lpad((c_nationkey)::VARCHAR, 2, '0') AS code,
           replace(o.o_orderpriority, ' ', '.') AS key,
           substring(c_name, 10, 9) AS serial,
           regexp_matches(c_name, '#0+[1-4]') AS low,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment || ':' || c_nationkey::VARCHAR END AS stratum,
           TRY_CAST(substring(c_name, 10, 9) AS DOUBLE) AS number,
           TRY_CAST(c_mktsegment AS DOUBLE) AS no_number
    FROM customer JOIN orders o ON o_custkey = c_custkey
    """
)
def text_functions(spark, folder):
    """Trim, pad, substring, replace, pattern test, NULL-keeping concat, safe casts."""
    customer = table(spark, folder, "customer")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    segment = null_if("c_mktsegment", ["BUILDING"])
    nation = F.col("c_nationkey").cast("string")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey",
        blank_to_null(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
        F.lpad(nation, 2, "0").alias("code"),
        name_key("o_orderpriority").alias("key"),
        F.substring("c_name", 10, 9).alias("serial"),
        F.col("c_name").rlike("#0+[1-4]").alias("low"),
        F.concat(segment, F.lit(":"), nation).alias("stratum"),
        to_number(F.substring("c_name", 10, 9)).alias("number"),
        to_number("c_mktsegment").alias("no_number"),
    )


@query(
    """
    SELECT c_custkey,
           ROUND(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log_balance,
           ROUND(CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END, 6) AS per_nation,
           ROUND(c_acctbal * c_acctbal, 2) AS squared,
           ROUND(c_acctbal - 1000, 2) AS difference
    FROM customer
    """
)
def log_ratio(spark, folder):
    """Logs and ratios that are NULL where they are undefined."""
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.round(safe_ln("c_acctbal"), 6).alias("log_balance"),
        F.round(safe_ratio("c_acctbal", "c_nationkey"), 6).alias("per_nation"),
        F.round(F.pow("c_acctbal", F.lit(2)), 2).alias("squared"),
        F.round(F.col("c_acctbal") - 1000, 2).alias("difference"),
    )


@query(
    """
    SELECT n_nationkey, ROUND(m, 1) AS mean_1, ROUND(m, 2) AS mean_2,
           ROUND(m / power(10, floor(log10(abs(m))) - 2)) * power(10, floor(log10(abs(m))) - 2) AS signif_3
    FROM (SELECT n_nationkey, avg(o_totalprice) AS m
          FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    """
)
def rounding(spark, folder):
    """Fixed decimals and significant digits."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    means = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.avg("o_totalprice").alias("m"))
    )
    return means.select(
        "n_nationkey",
        F.round("m", 1).alias("mean_1"),
        F.round("m", 2).alias("mean_2"),
        signif("m", 3).alias("signif_3"),
    )


@query(
    """
    SELECT l_orderkey AS household, l_linenumber AS member, l_discount AS rate_discount,
           l_tax AS rate_tax
    FROM lineitem
    """
)
def select_and_rename(spark, folder):
    """Columns by pattern, renamed, each kept once."""
    lineitem = table(spark, folder, "lineitem")
    rates = matching(lineitem, r"^l_(discount|tax|quantity)$", exclude=["l_quantity"])
    chosen = select_unique(lineitem, ["l_orderkey", "l_linenumber", *rates, "l_orderkey"])
    return with_renames(
        chosen,
        {
            "l_orderkey": "household",
            "l_linenumber": "member",
            **{c: c.replace("l_", "rate_") for c in rates},
        },
    )
