"""Lookups, panel joins, shares and concentration measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import quarter_label
from tessera.functions.semantics import safe_ratio
from tessera.operators.groups import with_group_total
from tessera.operators.joins import (
    attach_attributes,
    decode,
    decode_audited,
    fill_from_rows,
    levels_present as present,
    map_panel,
    null_safe_join,
    panel_join,
    panel_slices as slices,
    period_rates,
    require_unique,
    share_of_total as share,
    unknown_codes as unknown,
)
from tessera.plans.concentration import density_change, density_panel, relative_density
from tessera.queries.registry import query
from tessera.sources.tables import source_order, stage_derived, table


def placed_orders(spark, folder) -> DataFrame:
    """Orders with the place (nation), group (segment), sex-like flag and year of their customer."""
    customer = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("origin")
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderstatus").alias("sex"),
        F.year("o_orderdate").alias("year"),
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def panel(spark, folder) -> DataFrame:
    """Density of each group per place, sex and year, with rows for all places."""
    placed = placed_orders(spark, folder).withColumn("place", F.col("place").cast("string"))
    return density_panel(placed, "place", "origin", ["sex", "year"])


_PLACED = """
    placed AS (SELECT o_orderkey, o_custkey, o_orderstatus AS sex, CAST(year(o_orderdate) AS INTEGER) AS year,
                      c_nationkey::VARCHAR AS place, c_mktsegment AS origin
               FROM orders JOIN customer ON o_custkey = c_custkey),
    cells AS (SELECT place, origin, sex, year, count(*) AS n FROM placed GROUP BY ALL
              UNION ALL
              SELECT 'Total', origin, sex, year, count(*) FROM placed GROUP BY ALL),
    panel AS (SELECT *, n / sum(n) OVER (PARTITION BY place, sex, year) AS density FROM cells)
"""


@query(
    f"""
    WITH {_PLACED}
    SELECT place, origin, sex, year, n, ROUND(density, 6) AS density FROM panel
    """
)
def concentration_abs(spark, folder):
    """Absolute concentration: group share among the people of a place."""
    cells = panel(spark, folder)
    return cells.select("place", "origin", "sex", "year", "n", F.round("density", 6).alias("density"))


@query(
    f"""
    WITH {_PLACED}
    SELECT p.place, p.origin, p.sex, p.year, ROUND(p.density, 6) AS density,
           ROUND(t.density, 6) AS national, ROUND(p.density / t.density, 6) AS relative
    FROM panel p LEFT JOIN panel t ON t.place = 'Total' AND p.origin = t.origin AND p.sex = t.sex
         AND p.year = t.year
    WHERE p.place <> 'Total'
    """
)
def concentration_rel(spark, folder):
    """Relative concentration: place share over the share in all places."""
    shares = relative_density(panel(spark, folder), "place", "origin", ["sex", "year"])
    return shares.select(
        "place",
        "origin",
        "sex",
        "year",
        F.round("density", 6).alias("density"),
        F.round("density_Total", 6).alias("national"),
        F.round("density_relative", 6).alias("relative"),
    )


@query(
    f"""
    WITH {_PLACED},
    wide AS (SELECT place, origin, sex, max(CASE WHEN year = 1996 THEN density END) AS a,
                    max(CASE WHEN year = 2000 THEN density END) AS b
             FROM panel WHERE year IN (1996, 2000) GROUP BY 1, 2, 3)
    SELECT place, origin, sex, ROUND(a, 6) AS first, ROUND(b, 6) AS last, ROUND(b - a, 6) AS change,
           ROUND(CASE WHEN b - a > 0 THEN ln(b - a) END, 4) AS log_change
    FROM wide
    """
)
def concentration_change(spark, folder):
    """Change of a concentration between two years, and its log."""
    moved = density_change(panel(spark, folder), ["place", "origin", "sex"], "year", 1996, 2000)
    return moved.select(
        "place",
        "origin",
        "sex",
        F.round("density_first", 6).alias("first"),
        F.round("density_last", 6).alias("last"),
        F.round("density_change", 6).alias("change"),
        F.round("log_change", 4).alias("log_change"),
    )


@query(
    """
    SELECT c_custkey, n_name AS country, n_regionkey AS country_class, r_name AS region
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    """
)
def decode_labels(spark, folder):
    """Several labels of one code in one join, then a second lookup."""
    nation = require_unique(table(spark, folder, "nation"), ["n_nationkey"])
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    labelled = decode(
        customer,
        nation,
        "c_nationkey",
        {"n_name": "country", "n_regionkey": "country_class"},
        on="n_nationkey",
    )
    labelled = decode(
        labelled, table(spark, folder, "region"), "country_class", {"r_name": "region"}, "r_regionkey"
    )
    return labelled.select("c_custkey", "country", "country_class", "region")


@query(
    """
    SELECT c_nationkey AS code, count(*) AS n FROM customer
    WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY 1
    """
)
def unknown_codes(spark, folder):
    """Codes the dimension lacks, with row counts."""
    nation = table(spark, folder, "nation").filter("n_regionkey <> 2")
    return unknown(table(spark, folder, "customer"), nation, "c_nationkey", "n_nationkey")


@query(
    """
    SELECT count(*) AS rows_in, count(*) AS rows_out, count(*) FILTER (code IS NULL) AS null_codes,
           count(*) FILTER (code IS NOT NULL AND n_nationkey IS NULL) AS unknown_codes,
           (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS dim_rows, 0::BIGINT AS added_rows,
           count(DISTINCT n_name) AS labels
    FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey END AS code FROM customer)
         LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON code = n_nationkey
    """
)
def decode_audit(spark, folder):
    """Rows, NULL codes and unknown codes of a decoding join, from the job that decodes."""
    customer = table(spark, folder, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("code"))
    nation = table(spark, folder, "nation").filter("n_regionkey <> 1")
    decoded, audit = decode_audited(customer, nation, "code", {"n_name": "country"}, "n_nationkey")
    written = stage_derived(decoded)
    counts = [F.lit(v).cast("long").alias(k) for k, v in audit.counts().items()]
    return written.agg(F.count_distinct("country").alias("labels")).select(*counts, "labels")


@query(
    """
    WITH placed AS (SELECT *, row_number() OVER () AS place FROM part),
    lookup AS (SELECT p_brand, arg_max(p_size, place) AS stratum FROM placed WHERE p_size % 3 <> 0 GROUP BY 1)
    SELECT p_partkey, p_brand AS municipality, stratum FROM part LEFT JOIN lookup USING (p_brand)
    """
)
def self_lookup_fill(spark, folder):
    """A lookup built from the rows themselves; the last row of a key in the file wins."""
    part = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_brand").alias("municipality"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("known"),
        "p_size",
        source_order().alias("source_order"),
    )
    filled = fill_from_rows(part, "municipality", "known", "p_size", "stratum", order=F.col("source_order"))
    return filled.select("p_partkey", "municipality", "stratum")


@query(
    f"""
    WITH {_PLACED}
    SELECT o_orderkey, ROUND(a.density, 6) AS density, a.n AS cell, ROUND(b.density, 6) AS density_3yr
    FROM placed p
    LEFT JOIN panel a ON p.place = a.place AND p.origin = a.origin AND p.sex = a.sex AND p.year = a.year
    LEFT JOIN panel b ON p.place = b.place AND p.origin = b.origin AND p.sex = b.sex AND p.year - 3 = b.year
    """
)
def panel_join_year(spark, folder):
    """Panel values at a row's own year and three years before."""
    cells = stage_derived(panel(spark, folder))
    rows = placed_orders(spark, folder).withColumn("place", F.col("place").cast("string"))
    rows = rows.withColumn("year_3", F.col("year") - 3)
    keys = {"place": "place", "origin": "origin", "sex": "sex"}
    rows = panel_join(rows, cells, {**keys, "year": "year"}, {"density": "d0", "n": "cell"})
    rows = panel_join(rows, cells, {**keys, "year_3": "year"}, {"density": "d3"})
    return rows.select(
        "o_orderkey", F.round("d0", 6).alias("density"), "cell", F.round("d3", 6).alias("density_3yr")
    )


@query(
    f"""
    WITH {_PLACED},
    wide AS (SELECT place, origin, sex, max(CASE WHEN year = 1996 THEN density END) AS d1996,
                    max(CASE WHEN year = 1998 THEN density END) AS d1998,
                    max(CASE WHEN year = 2000 THEN density END) AS d2000,
                    max(CASE WHEN year = 2000 THEN n END) AS n2000
             FROM panel GROUP BY 1, 2, 3)
    SELECT o_orderkey, ROUND(d1996, 6) AS d1996, ROUND(d1998, 6) AS d1998, ROUND(d2000, 6) AS d2000, n2000
    FROM placed LEFT JOIN wide USING (place, origin, sex)
    """
)
def panel_slices(spark, folder):
    """Fixed-year slices pivoted side by side, attached in one join."""
    wide = slices(
        panel(spark, folder),
        ["place", "origin", "sex"],
        "year",
        {
            "d1996": ("density", 1996),
            "d1998": ("density", 1998),
            "d2000": ("density", 2000),
            "n2000": ("n", 2000),
        },
    )
    rows = placed_orders(spark, folder).withColumn("place", F.col("place").cast("string"))
    keys = {"place": "place", "origin": "origin", "sex": "sex"}
    joined = panel_join(rows, wide, keys, {c: c for c in ("d1996", "d1998", "d2000", "n2000")})
    return joined.select(
        "o_orderkey", *[F.round(c, 6).alias(c) for c in ("d1996", "d1998", "d2000")], "n2000"
    )


@query(
    f"""
    WITH {_PLACED}, all_origins AS (SELECT place, sex, sum(n)::BIGINT AS n FROM cells
                                    WHERE year = 1998 GROUP BY 1, 2)
    SELECT o_orderkey, a.n AS all_1998 FROM placed p LEFT JOIN all_origins a
           ON p.place = a.place AND p.sex = a.sex
    """
)
def panel_group_total(spark, folder):
    """Slice of the all-groups total of one year, joined on place and sex."""
    totals = (
        panel(spark, folder).filter("year = 1998").groupBy("place", "sex").agg(F.sum("n").alias("n"))
    )
    rows = placed_orders(spark, folder).withColumn("place", F.col("place").cast("string"))
    joined = panel_join(rows, totals, {"place": "place", "sex": "sex"}, {"n": "all_1998"})
    return joined.select("o_orderkey", "all_1998")


#: The older classification's words that make up each group of today, and the share of each that goes there.
CROSSWALK = {
    "STANDARD": [("AUTOMOBILE", 0.75), ("BUILDING", 0.25)],
    "SMALL": [("BUILDING", 1.0)],
    "MEDIUM": [("FURNITURE", 0.5), ("HOUSEHOLD", 0.5)],
    "LARGE": [("HOUSEHOLD", 1.0)],
    "ECONOMY": [("MACHINERY", 0.6), ("AUTOMOBILE", 0.4)],
    "PROMO": [("MACHINERY", 1.0)],
}
_CROSSWALK = ", ".join(f"('{old}', '{new}', {w}::DOUBLE)" for old, parts in CROSSWALK.items() for new, w in parts)


@query(
    f"""
    WITH crosswalk(old, new, w) AS (VALUES {_CROSSWALK}),
    census AS (SELECT s_nationkey AS place, new AS origin, sum(l_quantity * w) AS v
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
               JOIN crosswalk ON upper(string_split(p_type, ' ')[1]) = old GROUP BY 1, 2),
    total AS (SELECT origin, sum(v) AS t FROM census GROUP BY 1)
    SELECT c_custkey, ROUND(v, 2) AS census_value, ROUND(v / t, 6) AS census_relative
    FROM customer LEFT JOIN (SELECT * FROM census JOIN total USING (origin)) c
         ON c_nationkey = c.place AND c.origin = c_mktsegment
    """
)
def second_panel(spark, folder):
    """A second reference panel without sex or year, brought to today's groups by a weighted crosswalk."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("place"))
    part = table(spark, folder, "part").select("p_partkey", F.upper(F.split("p_type", " ")[0]).alias("origin"))
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    placed = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    older = placed.groupBy("place", "origin").agg(F.sum("l_quantity").alias("v"))
    links = [(old, new, w) for old, parts in CROSSWALK.items() for new, w in parts]
    crosswalk = spark.createDataFrame(links, "old string, new string, w double")
    census = stage_derived(map_panel(older, crosswalk, "origin", "old", "new", "w", ["place"], ["v"]))
    totals = census.groupBy("origin").agg(F.sum("v").alias("v")).withColumn("place", F.lit("TOTAL"))
    shares = share(census.unionByName(totals, allowMissingColumns=True), "place", "TOTAL", "v", ["origin"])
    customer = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("province"), F.col("c_mktsegment").alias("country")
    )
    joined = panel_join(
        customer, shares, {"province": "place", "country": "origin"}, {"v": "census_value", "v_relative": "census_relative"}
    )
    return joined.select(
        "c_custkey",
        F.round("census_value", 2).alias("census_value"),
        F.round("census_relative", 6).alias("census_relative"),
    )


@query(
    """
    WITH m AS (SELECT o_orderstatus AS sex, o_orderpriority AS part, avg(o_totalprice) AS v FROM orders GROUP BY ALL
               UNION ALL SELECT o_orderstatus, 'Total', sum(o_totalprice) FROM orders GROUP BY ALL)
    SELECT a.sex, a.part, ROUND(a.v, 4) AS value, ROUND(b.v, 2) AS total, ROUND(a.v / b.v, 10) AS share
    FROM m a LEFT JOIN m b ON a.sex = b.sex AND b.part = 'Total' WHERE a.part <> 'Total'
    """
)
def share_of_total(spark, folder):
    """Part rows joined to the Total row of the same table."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("sex"), F.col("o_orderpriority").alias("part"), "o_totalprice"
    )
    parts = orders.groupBy("sex", "part").agg(F.avg("o_totalprice").alias("v"))
    totals = orders.groupBy("sex").agg(F.sum("o_totalprice").alias("v")).withColumn("part", F.lit("Total"))
    shares = share(parts.unionByName(totals), "part", "Total", "v", ["sex"])
    return shares.select(
        "sex",
        "part",
        F.round("v", 4).alias("value"),
        F.round("v_Total", 2).alias("total"),
        F.round("v_relative", 10).alias("share"),
    )


@query(
    """
    WITH q AS (SELECT o_orderstatus AS sex, year(o_orderdate)::VARCHAR || 'T' || quarter(o_orderdate)::VARCHAR AS period,
                      avg(o_totalprice) AS rate FROM orders GROUP BY ALL),
    rates AS (SELECT * FROM q UNION ALL
              SELECT sex, left(period, 4), avg(rate) FROM q GROUP BY ALL)
    SELECT o_orderkey, o.period, ROUND(rate, 4) AS rate
    FROM (SELECT o_orderkey, o_orderstatus AS sex,
                 year(o_orderdate)::VARCHAR || CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                 THEN 'T' || quarter(o_orderdate)::VARCHAR ELSE '' END AS period FROM orders) o
    LEFT JOIN rates r ON o.sex = r.sex AND o.period = r.period
    """
)
def period_fallback(spark, folder):
    """Quarterly rate where the quarter is known, else the year's mean of quarters."""
    orders = table(spark, folder, "orders")
    quarter = F.concat(
        F.year("o_orderdate").cast("string"), F.lit("T"), F.quarter("o_orderdate").cast("string")
    )
    fine = orders.groupBy(F.col("o_orderstatus").alias("sex"), quarter.alias("period")).agg(
        F.avg("o_totalprice").alias("rate")
    )
    month = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.month("o_orderdate"))
    rows = orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("sex"),
        F.concat(F.year("o_orderdate").cast("string"), quarter_label(month)).alias("period"),
    )
    rates = period_rates(fine, ["sex"], "period", "rate")
    joined = panel_join(rows, rates, {"sex": "sex", "period": "period"}, {"rate": "rate"})
    return joined.select("o_orderkey", "period", F.round("rate", 4).alias("rate"))


@query(
    f"""
    WITH {_PLACED},
    picked AS (SELECT p.place, p.origin, p.density, p.density / t.density AS relative
               FROM panel p JOIN panel t ON t.place = 'Total' AND p.origin = t.origin AND p.sex = t.sex
                    AND p.year = t.year
               WHERE p.year = 1999 AND p.sex = 'F' AND p.origin IN ('BUILDING', 'MACHINERY') AND p.place <> 'Total')
    SELECT n_name AS region, origin, measure, ROUND(value, 6) AS value
    FROM nation LEFT JOIN (SELECT place, origin, 'density' AS measure, density AS value FROM picked UNION ALL
                           SELECT place, origin, 'density_relative', relative FROM picked) v
         ON n_nationkey::VARCHAR = v.place
    """
)
def region_attributes(spark, folder):
    """Long measures of selected groups onto a region table; empty regions are kept."""
    shares = relative_density(panel(spark, folder), "place", "origin", ["sex", "year"])
    chosen = shares.filter(
        (F.col("year") == 1999)
        & (F.col("sex") == "F")
        & F.col("origin").isin("BUILDING", "MACHINERY")
    )
    long = chosen.unpivot(["place", "origin"], ["density", "density_relative"], "measure", "value")
    regions = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("region")
    )
    joined = attach_attributes(regions, long, "code", "place")
    return joined.select("region", "origin", "measure", F.round("value", 6).alias("value"))


@query(
    """
    SELECT o_orderkey, ROUND(c.n / t.n * 100, 6) AS percent
    FROM (SELECT o_orderkey, o_orderstatus AS s, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders) o
    LEFT JOIN (SELECT o_orderstatus AS s, NULLIF(o_orderpriority, '5-LOW') AS p, count(*) AS n
               FROM orders GROUP BY ALL) c ON o.s = c.s AND o.p IS NOT DISTINCT FROM c.p
    LEFT JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) t ON o.s = t.s
    """
)
def attach_proportion(spark, folder):
    """A derived proportion joined back to its rows; NULL keys match NULL."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("s"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"),
    )
    cells = orders.groupBy("s", "p").agg(F.count("*").alias("n"))
    sized = with_group_total(cells, "s", {"total": F.sum("n")})
    shares = sized.select("s", "p", F.round(safe_ratio("n", "total") * 100, 6).alias("percent"))
    return null_safe_join(orders, stage_derived(shares), ["s", "p"]).select("o_orderkey", "percent")


@query(
    """
    SELECT n_nationkey, n_name FROM nation
    WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey
                          WHERE o_totalprice > 475000) OR n_nationkey IN (2, 3)
    """
)
def levels_present(spark, folder):
    """Dimension rows whose level occurs in a population, plus listed exceptions."""
    orders = table(spark, folder, "orders").filter("o_totalprice > 475000").select("o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    population = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return present(nation, "n_nationkey", population, "c_nationkey", always=[2, 3])
