"""Wide tables shaped like survey microdata, derived from the given tables.

An order stands for a household and its line numbers 1..7 for the member
slots; a user stands for a respondent and the event types for yes/no items.
Both are plain grouped maxima: bounded state, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import table

SLOTS = range(1, 8)
YEARS = range(1995, 2002)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _slot(number: int, value: Column) -> Column:
    return F.max(F.when(F.col("l_linenumber") == number, value))


def wide_orders(spark, folder) -> DataFrame:
    """One row per order; QTY, SUPP, NAT and YR columns per line number."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, folder, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    values = {
        "QTY": F.col("l_quantity"),
        "SUPP": F.col("l_suppkey"),
        "NAT": F.col("s_nationkey"),
        "YR": F.year("l_shipdate"),
    }
    return lines.groupBy("l_orderkey").agg(
        *[_slot(i, v).alias(f"{name}{i:02d}") for name, v in values.items() for i in SLOTS]
    )


def _sql_slots(name: str, value: str) -> str:
    return ",\n".join(
        f"max(CASE WHEN l_linenumber = {i} THEN {value} END) AS {name}{i:02d}" for i in SLOTS
    )


WIDE_ORDERS = f"""
    wide AS (SELECT l_orderkey, {_sql_slots('QTY', 'l_quantity')}, {_sql_slots('SUPP', 'l_suppkey')},
             {_sql_slots('NAT', 's_nationkey')}, {_sql_slots('YR', 'CAST(year(l_shipdate) AS INTEGER)')}
             FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey)
"""


def wide_users(spark, folder) -> DataFrame:
    """One row per user; a 1/6 item per event type (1 = yes, 6 = no)."""
    events = table(spark, folder, "events")
    return events.groupBy("user_id").agg(
        *[
            F.min(
                F.when((F.col("event_type") == e) & (F.col("value") > 150), 1).otherwise(6)
            ).alias(e)
            for e in EVENT_TYPES
        ]
    )


WIDE_USERS = "wide AS (SELECT user_id, " + ", ".join(
    f"min(CASE WHEN event_type = '{e}' AND value > 150 THEN 1 ELSE 6 END) AS \"{e}\""
    for e in EVENT_TYPES
) + " FROM events GROUP BY user_id)"
