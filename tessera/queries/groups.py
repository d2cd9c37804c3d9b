"""Grouped summaries, cross-tabs, shares and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import SIZE_LABELS, relabel, size_class, split_at
from tessera.functions.semantics import safe_ratio
from tessera.operators.groups import (
    cell_text,
    cohort_summary as summarise_cohorts,
    contingency_table,
    crosstab,
    crosstab_text,
    frequency_table as frequencies,
    group_summary as summarise,
    keep_large_groups,
    level_counts as count_levels,
    unit_scale,
    with_group_total,
    within_group_percent,
)
from tessera.operators.joins import share_of_total
from tessera.operators.reshape import impute_zero as fill_zero, melt, spread
from tessera.plans.concentration import size_percentages
from tessera.queries.registry import query
from tessera.sources.tables import table

SEGMENTS = ["BUILDING", "FURNITURE", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def order_segments(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = table(spark, folder, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


@query(
    """
    SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year,
           ROUND(avg(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END), 4) AS mean
    FROM orders GROUP BY 1, 2
    """
)
def group_means(spark, folder):
    """Group mean that ignores missing values."""
    known = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
        .agg(F.round(F.avg(known), 4).alias("mean"))
    )


@query(
    """
    SELECT c_nationkey, c_mktsegment, count(c_acctbal) AS n, ROUND(avg(c_acctbal), 4) AS mean,
           ROUND(stddev_samp(c_acctbal), 4) AS sd
    FROM customer GROUP BY 1, 2
    """
)
def group_summary(spark, folder):
    """Count, mean and standard deviation per group."""
    summed = summarise(table(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal")
    return summed.select(
        "c_nationkey", "c_mktsegment", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")
    )


@query(
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                      count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
         b AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS m FROM a WHERE n > 30)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM b WHERE m > 280
    """
)
def keep_large_groups_seq(spark, folder):
    """Large parts first, then suppliers large among the rows that are left."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    parts = keep_large_groups(lines, "l_partkey", 30)
    return keep_large_groups(parts, "l_suppkey", 280)


_CROSS = """
    base AS (SELECT o_orderpriority, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
    cells AS (SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS priority,
                     CASE WHEN grouping(c_mktsegment) = 1 THEN 'Total' ELSE c_mktsegment END AS segment,
                     count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd
              FROM base GROUP BY CUBE (o_orderpriority, c_mktsegment)),
    shown AS (SELECT * FROM cells WHERE priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', 'Total')
              AND segment IN ('BUILDING', 'FURNITURE', 'MACHINERY', 'Total'))
"""


def _cells(spark, folder):
    rows = order_segments(spark, folder).select(
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), "o_totalprice"
    )
    return crosstab(rows, "priority", "segment", "o_totalprice", PRIORITIES, SEGMENTS)


@query(
    f"""
    WITH {_CROSS}
    SELECT priority, segment, n, ROUND(mean, 4) AS mean, ROUND(sd, 4) AS sd FROM shown
    """
)
def crosstab_margins(spark, folder):
    """Cells of displayed levels with margins over all levels."""
    return _cells(spark, folder).select(
        "priority", "segment", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")
    )


@query(
    f"""
    WITH {_CROSS}, text AS (SELECT priority, segment, ROUND(mean)::BIGINT::VARCHAR || ' (' || n::VARCHAR || ')' AS t FROM shown)
    SELECT priority, max(t) FILTER (segment = 'BUILDING') AS "BUILDING",
           max(t) FILTER (segment = 'FURNITURE') AS "FURNITURE",
           max(t) FILTER (segment = 'MACHINERY') AS "MACHINERY", max(t) FILTER (segment = 'Total') AS "Total"
    FROM text GROUP BY 1
    """
)
def crosstab_cells(spark, folder):
    """The same table as text cells ``mean (n)``, one column per segment."""
    cells = _cells(spark, folder).withColumn("whole", F.round("mean").cast("bigint"))
    return crosstab_text(cells, "priority", "segment", cell_text("whole", F.col("n")), SEGMENTS)


@query(
    f"""
    WITH {_CROSS}, text AS (SELECT priority, segment, rtrim(rtrim(printf('%.1f', round(mean / 1000, 1)), '0'), '.') || ' ('
                            || rtrim(rtrim(printf('%.2f', round(sd / 1000, 2)), '0'), '.') || ')' AS t FROM shown)
    SELECT priority, max(t) FILTER (segment = 'BUILDING') AS "BUILDING",
           max(t) FILTER (segment = 'FURNITURE') AS "FURNITURE",
           max(t) FILTER (segment = 'MACHINERY') AS "MACHINERY", max(t) FILTER (segment = 'Total') AS "Total"
    FROM text GROUP BY 1
    """
)
def crosstab_cells_sd(spark, folder):
    """Decimal text cells ``mean (sd)`` in thousands."""
    text = cell_text(F.col("mean") / 1000, F.col("sd") / 1000, main_digits=1, extra_digits=2)
    return crosstab_text(_cells(spark, folder), "priority", "segment", text, SEGMENTS)


@query(
    """
    SELECT p_brand, count(*) AS freq FROM part GROUP BY 1 HAVING count(*) > 80
    """
)
def frequency_table(spark, folder):
    """Level counts above a threshold, most frequent first."""
    return frequencies(table(spark, folder, "part"), "p_brand", above=80)


@query(
    """
    WITH rows AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, o_orderstatus AS status,
                         CAST(year(o_orderdate) AS INTEGER) AS year
                  FROM orders JOIN customer ON o_custkey = c_custkey),
    grid AS (SELECT * FROM (SELECT DISTINCT nation FROM rows), (SELECT DISTINCT segment FROM rows),
                           (SELECT DISTINCT status FROM rows), (SELECT DISTINCT year FROM rows)),
    seen AS (SELECT nation, segment, status, year, count(*) AS freq FROM rows GROUP BY ALL),
    counted AS (SELECT nation, segment, status, year, COALESCE(freq, 0) AS freq
                FROM grid LEFT JOIN seen USING (nation, segment, status, year))
    SELECT *, ROUND(CASE WHEN t > 0 THEN freq * 100.0 / t END, 6) AS percent
    FROM (SELECT *, sum(freq) OVER (PARTITION BY nation, year)::BIGINT AS t FROM counted)
    """
)
def contingency_full(spark, folder):
    """Four-way counts with zero cells, and the percent within two of the factors."""
    rows = order_segments(spark, folder).select(
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("year"),
    )
    counts = contingency_table(rows, ["nation", "segment", "status", "year"])
    sized = with_group_total(counts, ["nation", "year"], {"t": F.sum("freq")})
    return sized.withColumn("percent", F.round(safe_ratio("freq", "t") * 100, 6))


_CITIES = """
    cities AS (SELECT c_nationkey AS province, c_custkey % 40 AS municipality, o_orderstatus AS sex,
                      c_mktsegment AS origin, floor(sum(o_totalprice) / 100) AS "Count"
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def _cities(spark, folder):
    return (
        order_segments(spark, folder)
        .groupBy(
            F.col("c_nationkey").alias("province"),
            (F.col("c_custkey") % 40).alias("municipality"),
            F.col("o_orderstatus").alias("sex"),
            F.col("c_mktsegment").alias("origin"),
        )
        .agg(F.floor(F.sum("o_totalprice") / 100).cast("double").alias("Count"))
    )


@query(
    f"""
    WITH {_CITIES}
    SELECT province, municipality, sex, origin,
           ROUND("Count" / sum("Count") OVER (PARTITION BY province, sex, origin) * 100, 6) AS percent_prov_pop,
           ROUND("Count" / sum("Count") OVER (PARTITION BY sex, origin) * 100, 6) AS percent_total_pop
    FROM cities
    """
)
def nested_shares(spark, folder):
    """Percent of the province and of the whole, nested."""
    sized = size_percentages(_cities(spark, folder), "province", ["sex", "origin"])
    return sized.select(
        "province",
        "municipality",
        "sex",
        "origin",
        F.round("percent_prov_pop", 6).alias("percent_prov_pop"),
        F.round("percent_total_pop", 6).alias("percent_total_pop"),
    )


@query(
    f"""
    WITH {_CITIES},
    all_origins AS (SELECT * FROM cities UNION ALL
                    SELECT province, municipality, sex, 'Total', sum("Count") FROM cities GROUP BY ALL),
    joined AS (SELECT a.*, b."Count" AS t FROM all_origins a LEFT JOIN all_origins b
               ON b.origin = 'Total' AND a.province = b.province AND a.municipality = b.municipality AND a.sex = b.sex
               WHERE a.origin <> 'Total')
    SELECT province, municipality, sex, origin, ROUND("Count" / t * 100, 6) AS percent_mun,
           CASE WHEN "Count" <= 10000 THEN '< 10,000' WHEN "Count" <= 20000 THEN '10,001 - 20,000'
                WHEN "Count" <= 50000 THEN '20,001 - 50,000' ELSE '> 50,000' END AS size,
           CASE WHEN "Count" <= 50000 THEN '<= 50,000' ELSE '> 50,000' END AS side
    FROM joined
    """
)
def municipality_table(spark, folder):
    """Share of each origin in a municipality, with size class and its label."""
    cities = _cities(spark, folder)
    keys = ["province", "municipality", "sex"]
    totals = cities.groupBy(*keys).agg(F.sum("Count").alias("Count")).withColumn("origin", F.lit("Total"))
    shares = share_of_total(cities.unionByName(totals), "origin", "Total", "Count", keys)
    labels = ["< 10,000", "10,001 - 20,000", "20,001 - 50,000", "> 50,000"]
    return shares.select(
        *keys,
        "origin",
        F.round(F.col("Count_relative") * 100, 6).alias("percent_mun"),
        relabel(size_class("Count"), dict(zip(SIZE_LABELS, labels))).alias("size"),
        split_at("Count").alias("side"),
    )


@query(
    """
    SELECT o_orderstatus AS cohort, variable, ROUND(avg(v), 4) AS mean, ROUND(stddev_samp(v), 4) AS sd, count(v) AS n
    FROM (SELECT o_orderstatus, 'price' AS variable, o_totalprice AS v FROM orders UNION ALL
          SELECT o_orderstatus, 'known_year', CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END FROM orders)
    GROUP BY 1, 2
    """
)
def cohort_summary(spark, folder):
    """Mean, sd and known count of several columns by cohort, from one scan."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("cohort"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("known_year"),
    )
    summed = summarise_cohorts(rows, "cohort", ["price", "known_year"])
    return summed.select(
        "cohort", "variable", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n"
    )


@query(
    """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished,
           count(*) FILTER (o_totalprice > 250000) AS large
    FROM orders GROUP BY 1
    """
)
def level_counts(spark, folder):
    """Rows per level satisfying each of several conditions."""
    return count_levels(
        table(spark, folder, "orders"),
        "o_orderpriority",
        {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 250000},
    )


@query(
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS cohort, count(*) AS n
    FROM orders GROUP BY 1, 2
    """
)
def year_histogram(spark, folder):
    """Counts by year and cohort."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("cohort")
    ).agg(F.count("*").alias("n"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, value FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount + 0 AS l_discount, l_tax + 0 AS l_tax
      FROM lineitem)
    UNPIVOT (value FOR measure IN (l_quantity, l_extendedprice, l_discount, l_tax))
    """
)
def melt_measures(spark, folder):
    """Four measures of a line as four rows."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, folder, "lineitem").select(
        *ids,
        "l_quantity",
        "l_extendedprice",
        *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")],
    )
    return melt(lines, ids, variable="measure", value="value")


@query(
    """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (l_returnflag = 'A') AS "A",
           count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R"
    FROM lineitem GROUP BY 1
    """
)
def spread_cells(spark, folder):
    """Counts spread to one column per level."""
    lines = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag")
    wide = spread(lines, ["year"], "l_returnflag", F.count(F.lit(1)), first=["R"])
    return wide.na.fill(0)


@query(
    """
    SELECT place, year, ROUND(n, 2) AS n, ROUND(CASE WHEN n = 0 THEN m ELSE n END, 2) AS filled
    FROM (SELECT *, min(NULLIF(n, 0)) OVER (PARTITION BY place) AS m FROM (
            SELECT c_nationkey AS place, CAST(year(o_orderdate) AS INTEGER) AS year,
                   sum(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN o_totalprice ELSE 0 END) AS n
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))
    """
)
def impute_zero(spark, folder):
    """Zero cells filled with the smallest non-zero value of their place."""
    price = F.when(
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), F.col("o_totalprice")
    ).otherwise(0.0)
    cells = (
        order_segments(spark, folder)
        .groupBy(F.col("c_nationkey").alias("place"), F.year("o_orderdate").alias("year"))
        .agg(F.sum(price).alias("n"))
    )
    filled = fill_zero(cells, ["place"], "n", "filled")
    return filled.select("place", "year", F.round("n", 2).alias("n"), F.round("filled", 2).alias("filled"))


@query(
    """
    WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS "Year", count(*) AS total,
                      count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o
               FROM orders GROUP BY 1)
    SELECT "Year", population AS "Population", ROUND(f / total * 100, 6) AS "Percent", ROUND("Count" / 1000000, 9) AS "Count_1000000"
    FROM (SELECT "Year", total, f, 'f' AS population, f AS "Count" FROM y UNION ALL
          SELECT "Year", total, f, 'o', o FROM y) WHERE "Year" NOT IN (1995)
    """
)
def population_series(spark, folder):
    """Counts of two populations per year in long form, scaled, with a percentage."""
    status = F.col("o_orderstatus")
    years = (
        table(spark, folder, "orders")
        .groupBy(F.year("o_orderdate").alias("Year"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(status == "F").alias("f"),
            F.count_if(status == "O").alias("o"),
        )
        .withColumn("Proportion", safe_ratio("f", "total"))
    )
    long = melt(years, ["Year", "Proportion"], ["f", "o"], "Population", "Count")
    scaled = unit_scale(
        long, {"Count_1000000": ("Count", 1 / 1000000), "Percent": ("Proportion", 100.0)}
    )
    return scaled.filter(F.col("Year") != 1995).select(
        "Year",
        "Population",
        F.round("Percent", 6).alias("Percent"),
        F.round("Count_1000000", 9).alias("Count_1000000"),
    )


@query(
    """
    WITH base AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 0 END AS influenced,
                         CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus = 'F' AS cohort FROM orders),
    grid AS (SELECT influenced, year, cohort FROM (VALUES (0), (1)) a(influenced),
             (SELECT DISTINCT year FROM base WHERE influenced IS NOT NULL), (VALUES (true), (false)) c(cohort)),
    cells AS (SELECT influenced, year, cohort, count(*) AS freq FROM base WHERE influenced IS NOT NULL GROUP BY ALL)
    SELECT year, cohort, influenced, COALESCE(freq, 0) AS freq,
           ROUND(COALESCE(freq, 0) / NULLIF(sum(COALESCE(freq, 0)) OVER (PARTITION BY year, cohort), 0) * 100, 6) AS prop,
           (SELECT count(*) FROM base b WHERE b.year = g.year AND b.cohort = g.cohort) AS arrivals
    FROM grid g LEFT JOIN cells USING (influenced, year, cohort)
    """
)
def influenced_series(spark, folder):
    """Percent answering yes by year and cohort, beside the number of arrivals."""
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", 1)
        .when(F.col("o_orderpriority") == "5-LOW", 0)
        .alias("influenced"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderstatus") == "F").alias("cohort"),
    )
    counts = contingency_table(
        rows,
        ["influenced", "year", "cohort"],
        {"influenced": [0, 1], "cohort": [True, False]},
    )
    shares = within_group_percent(counts, ["year", "cohort"], "freq", "prop")
    arrivals = rows.groupBy("year", "cohort").agg(F.count("*").alias("arrivals"))
    return shares.join(arrivals, ["year", "cohort"]).select(
        "year", "cohort", "influenced", "freq", F.round("prop", 6).alias("prop"), "arrivals"
    )
