"""Job-search start and work-history flags on order- and user-shaped people."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.plans.survey import job_search, work_history
from tessera.queries.registry import query
from tessera.queries.wide import SLOTS, WIDE_ORDERS, WIDE_USERS, wide_orders, wide_users
from tessera.sources.tables import table

_REACHED = " + ".join(f"CASE WHEN year >= YR{i:02d} THEN 1 ELSE 0 END" for i in SLOTS)
_PLACE = " ".join(f"WHEN {i} THEN NAT{i:02d}" for i in SLOTS)


@query(
    f"""
    WITH {WIDE_ORDERS},
    person AS (SELECT o_orderkey, o_orderstatus <> 'P' AS first_job, CAST(year(o_orderdate) AS INTEGER) AS y,
                      CASE WHEN o_custkey % 3 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS m,
                      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 3
                           WHEN '4' THEN 12 WHEN '5' THEN 24 END AS back FROM orders),
    dated AS (SELECT *, CASE WHEN first_job THEN CAST(make_date(y, COALESCE(m, 6), 1) - to_months(back) AS DATE) END AS start
              FROM person),
    placed AS (SELECT d.*, w.*, CAST(year(start) AS INTEGER) AS year FROM dated d JOIN wide w ON o_orderkey = l_orderkey),
    slot AS (SELECT *, CASE WHEN year IS NOT NULL AND YR01 IS NOT NULL THEN greatest({_REACHED}, 1) END AS num FROM placed)
    SELECT o_orderkey, start AS job_search_start_dt,
           CASE WHEN m IS NOT NULL THEN year(start)::VARCHAR || 'T' || quarter(start)::VARCHAR ELSE year(start)::VARCHAR END
               AS job_search_start_yr_qt,
           num AS prv_num, n_name AS province_job_search
    FROM slot LEFT JOIN nation ON n_nationkey = CASE num {_PLACE} END
    """
)
def search_start(spark, folder):
    """Start of the first job search, its period label, the residence slot then and its decoded place."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(6).alias("PRIMTR"),
        F.year("o_orderdate").alias("ANOCOM"),
        F.when(F.col("o_custkey") % 3 != 0, F.month("o_orderdate")).alias("MESCOM"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("TPO1"),
    )
    slots = wide_orders(spark, folder).select(
        "l_orderkey",
        *[F.col(f"YR{i:02d}").alias(f"ANOM{i:02d}") for i in SLOTS],
        *[F.col(f"NAT{i:02d}").cast("string").alias(f"PRV{i:02d}") for i in SLOTS],
    )
    nation = table(spark, folder, "nation")
    places = nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    people = orders.join(slots, F.col("o_orderkey") == F.col("l_orderkey"))
    found = job_search(people, SimpleNamespace(province=places))
    return found.select(
        "o_orderkey", "job_search_start_dt", "job_search_start_yr_qt", "prv_num", "province_job_search"
    )


@query(
    f"""
    WITH {WIDE_USERS},
    item AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN "click" END AS trab1, CASE WHEN user_id % 7 > 1 THEN "signup" END AS trant,
                    user_id % 11 = 0 AS sector1, user_id % 13 = 0 AS sector3,
                    CASE WHEN user_id % 3 <> 0 THEN "purchase" END AS primtr, CASE WHEN user_id % 4 <> 0 THEN "view" END AS trante FROM wide),
    flag AS (SELECT *, sector1 OR trab1 = 1 OR trant = 1 AS before, sector3 OR primtr = 6 OR trante = 1 AS here FROM item)
    SELECT user_id, CASE WHEN before THEN 1 WHEN NOT before AND NOT (trab1 IS NULL AND trant IS NULL) THEN 0 END AS had_worked,
           CASE WHEN here THEN 1 WHEN primtr = 1 OR trante = 6 THEN 0 END AS had_worked_spain
    FROM flag
    """
)
def worked_before(spark, folder):
    """Three-valued work-history flags from partly missing items."""
    number = F.col("user_id")
    known = lambda name, rule: F.when(rule, F.col(name))
    items = wide_users(spark, folder).select(
        "user_id",
        known("click", number % 5 != 0).alias("TRAB1"),
        known("signup", number % 7 > 1).alias("TRANT"),
        F.when(number % 11 == 0, "a").alias("sector1"),
        F.when(number % 13 == 0, "a").alias("sector3"),
        known("purchase", number % 3 != 0).alias("PRIMTR"),
        known("view", number % 4 != 0).alias("TRANTE"),
    )
    return items.withColumns(work_history()).select("user_id", "had_worked", "had_worked_spain")
