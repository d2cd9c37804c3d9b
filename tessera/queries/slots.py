"""Operators over numbered columns, on orders as households and users as respondents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.semantics import any_positive, row_sum, row_sum_strict, yes_no
from tessera.functions.slots import (
    collapse_label,
    count_where,
    flag_label,
    has_changed as changed,
    last_match_index as last_match,
    last_non_null as last_known,
    only_flag,
    pick_by_index,
    pick_where as value_beside,
    position_at as position,
    slot_columns,
)
from tessera.operators.household import (
    household_counts,
    member_attributes,
    member_rows,
    reference_person,
)
from tessera.operators.joins import decode_slots
from tessera.operators.reshape import padded, set_flags_long
from tessera.queries.registry import query
from tessera.queries.wide import EVENT_TYPES, SLOTS, WIDE_ORDERS, WIDE_USERS, wide_orders, wide_users
from tessera.sources.tables import stage_derived, table

HEAD = "CAST(l_orderkey % 7 + 1 AS INTEGER)"


def _pick(prefix: str, index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {prefix}{i:02d}" for i in SLOTS)
    return f"CASE {index} {cases} END"


def _slots(prefix: str) -> list[str]:
    return [f"{prefix}{i:02d}" for i in SLOTS]


def _count(rule: str) -> str:
    return " + ".join(f"CASE WHEN {rule.format(i=f'{i:02d}', n=i)} THEN 1 ELSE 0 END" for i in SLOTS)


def _with_head(spark, folder):
    head = (F.col("l_orderkey") % 7 + 1).cast("int")
    return wide_orders(spark, folder).withColumn("head", head)


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey, {HEAD} AS head, {_pick('QTY', HEAD)} AS age, {_pick('NAT', HEAD)} AS country,
           {_pick('YR', HEAD)} AS arrival
    FROM wide
    """
)
def reference_line(spark, folder):
    """Attributes of the slot another column points to."""
    picked = reference_person(
        _with_head(spark, folder), "head", {"QTY": "age", "NAT": "country", "YR": "arrival"}
    )
    return picked.select("l_orderkey", "head", "age", "country", "arrival")


@query(
    f"""
    WITH {WIDE_ORDERS},
    hit AS (SELECT *, CASE {' '.join(f'WHEN NAT{i:02d} = 8 THEN {i}' for i in reversed(SLOTS))} END AS k
            FROM wide)
    SELECT l_orderkey, lpad(k::VARCHAR, 2, '0') AS last_move, {_pick('QTY', 'k')} AS motive FROM hit
    """
)
def last_match_index(spark, folder):
    """Last slot holding a code, zero-padded, and the value tied to it."""
    wide = wide_orders(spark, folder)
    nations = slot_columns(wide, "NAT")
    found = wide.withColumn("last_move", last_match(nations, 8, pad=2))
    return found.select(
        "l_orderkey",
        "last_move",
        pick_by_index(slot_columns(wide, "QTY"), F.col("last_move").cast("int")).alias("motive"),
    )


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey, COALESCE({', '.join(reversed(_slots('YR')))}) AS arrival_mun FROM wide
    """
)
def last_non_null(spark, folder):
    """Last known value across the slots."""
    wide = wide_orders(spark, folder)
    return wide.select("l_orderkey", last_known(slot_columns(wide, "YR")).alias("arrival_mun"))


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey,
           CASE {' '.join(f'WHEN NAT{i:02d} = 3 THEN QTY{i:02d}' for i in reversed(SLOTS))} END AS ability,
           CASE {' '.join(f'WHEN NAT{i:02d} = 3 THEN NULLIF(YR{i:02d}, 1998)' for i in reversed(SLOTS))} END AS item
    FROM wide
    """
)
def pick_where(spark, folder):
    """Value beside a matching key; the last match wins, also when it is NULL."""
    wide = wide_orders(spark, folder)
    keys = slot_columns(wide, "NAT")
    years = {i: F.nullif(F.col(c), F.lit(1998)) for i, c in slot_columns(wide, "YR").items()}
    return wide.select(
        "l_orderkey",
        value_beside(keys, slot_columns(wide, "QTY"), 3).alias("ability"),
        value_beside(keys, years, 3).alias("item"),
    )


@query(
    """
    SELECT l_orderkey,
           CASE WHEN count(DISTINCT s_nationkey) > 1 THEN 1 ELSE 0 END AS moved
    FROM (SELECT l_orderkey, l_linenumber, max(s_nationkey) AS s_nationkey
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1
    """
)
def has_changed(spark, folder):
    """More than one distinct value across the slots."""
    wide = wide_orders(spark, folder)
    return wide.select("l_orderkey", changed(slot_columns(wide, "NAT")).alias("moved"))


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey, {_count('QTY{i} > 25')} AS big, {_count('NAT{i} = NAT01')} AS same_as_first,
           {_count('QTY{i} IS NOT NULL')} AS known
    FROM wide
    """
)
def count_slots(spark, folder):
    """How many slots satisfy a predicate."""
    wide = wide_orders(spark, folder)
    quantities = slot_columns(wide, "QTY")
    return wide.select(
        "l_orderkey",
        count_where(quantities, lambda c: c > 25).alias("big"),
        count_where(slot_columns(wide, "NAT"), lambda c: c == F.col("NAT01")).alias("same_as_first"),
        count_where(quantities, lambda c: c.isNotNull()).alias("known"),
    )


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey,
           CASE WHEN y IS NOT NULL AND YR01 IS NOT NULL
                THEN greatest({_count('y >= YR{i}')}, 1) END AS prv_num
    FROM (SELECT w.*, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) + 1 END AS y
          FROM wide w JOIN orders ON l_orderkey = o_orderkey)
    """
)
def position_at(spark, folder):
    """How many start years lie at or before a year, at least one."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate") + 1).alias("y"),
    )
    wide = wide_orders(spark, folder)
    joined = wide.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", position(slot_columns(wide, "YR"), "y").alias("prv_num"))


def _relation(i: int) -> str:
    return f"CASE WHEN h <> {i} THEN CAST(SUPP{i:02d} % 15 AS INTEGER) END"


_MEMBERS = f"""
    people AS (SELECT l_orderkey, h, n, {', '.join(f'{_relation(i)} AS r{i:02d}' for i in SLOTS)},
                      {', '.join(f'CASE WHEN h <> {i} THEN QTY{i:02d} END AS a{i:02d}' for i in SLOTS)},
                      {', '.join(f"CASE WHEN h <> {i} THEN (NAT{i:02d} + 100)::VARCHAR END AS c{i:02d}" for i in SLOTS)}
               FROM (SELECT *, {HEAD} AS h, {_count('QTY{i} IS NOT NULL')} AS n FROM wide))
"""


def _members(spark, folder):
    wide = _with_head(spark, folder)
    wide = wide.withColumn("n", count_where(slot_columns(wide, "QTY"), lambda c: c.isNotNull()))
    texts = {f"CO{i:02d}": (F.col(f"NAT{i:02d}") + 100).cast("string") for i in SLOTS}
    relations = {f"RE{i:02d}": (F.col(f"SUPP{i:02d}") % 15).cast("int") for i in SLOTS}
    return member_attributes(
        wide.withColumns({**texts, **relations}),
        "head",
        list(SLOTS),
        {"QTY": "compi_age", "CO": "compi_country", "RE": "compi_relation"},
    )


@query(
    f"""
    WITH {WIDE_ORDERS}, {_MEMBERS}
    SELECT l_orderkey,
           CASE WHEN n > 1 THEN {_count("r{i} IN (11, 14) AND c{i} = '108'")} END AS spanish_housemates,
           CASE WHEN n > 1 THEN {_count('r{i} = 5 AND a{i} < 16')} END AS dependents,
           {_count("r{i} = 1 AND c{i} = '108'")} AS spanish_partner,
           {_count('r{i} = 1')} AS partner_convive, {_count('r{i} = 7')} AS "HH_convive"
    FROM people
    """
)
def household_relations(spark, folder):
    """Counts over the other members of a household by relation, age and origin."""
    counted = household_counts(_members(spark, folder), "n", list(SLOTS))
    return counted.select(
        "l_orderkey",
        "spanish_housemates",
        "dependents",
        "spanish_partner",
        "partner_convive",
        "HH_convive",
    )


@query(
    f"""
    WITH {WIDE_ORDERS}, {_MEMBERS}
    SELECT l_orderkey, {', '.join(f'r{i:02d} AS compi_relation{i:02d}, a{i:02d} AS compi_age{i:02d}' for i in SLOTS)}
    FROM people
    """
)
def member_columns(spark, folder):
    """Member attributes as numbered output columns, the head left out."""
    wide = _members(spark, folder)
    names = [f"{c}{i:02d}" for i in SLOTS for c in ("compi_relation", "compi_age")]
    return wide.select("l_orderkey", *names)


@query(
    f"""
    WITH {WIDE_ORDERS}, {_MEMBERS}
    SELECT * FROM ({' UNION ALL '.join(
        f"SELECT l_orderkey, {i} AS member, a{i:02d} AS compi_age, c{i:02d} AS compi_country FROM people"
        for i in SLOTS)}) WHERE compi_age IS NOT NULL OR compi_country IS NOT NULL
    """
)
def member_table(spark, folder):
    """One row per household member other than the head."""
    return member_rows(
        _members(spark, folder), ["l_orderkey"], list(SLOTS), ["compi_age", "compi_country"]
    )


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey, {', '.join(f'n{i}.n_name AS province{i}' for i in SLOTS)}, {', '.join(f's{i}.s_name AS supplier{i}' for i in SLOTS)}
    FROM wide {' '.join(f'LEFT JOIN nation n{i} ON NAT{i:02d} = n{i}.n_nationkey AND n{i}.n_nationkey <> 24' for i in SLOTS)}
         {' '.join(f'LEFT JOIN supplier s{i} ON SUPP{i:02d} = s{i}.s_suppkey' for i in SLOTS)}
    """
)
def decoded_slots(spark, folder):
    """Every slot decoded twice: by joins to a small dimension that lacks a code, and in one join to a large one."""
    nation = table(spark, folder, "nation").filter("n_nationkey <> 24")
    names = {f"NAT{i:02d}": f"province{i}" for i in SLOTS}
    suppliers = {f"SUPP{i:02d}": f"supplier{i}" for i in SLOTS}
    wide = stage_derived(wide_orders(spark, folder))
    decoded = decode_slots(wide, nation, names, "n_name", "n_nationkey", ["l_orderkey"])
    supplier = table(spark, folder, "supplier")
    decoded = decode_slots(decoded, supplier, suppliers, "s_name", "s_suppkey", ["l_orderkey"], large=True)
    return decoded.select("l_orderkey", *names.values(), *suppliers.values())


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT l_orderkey, {' + '.join(f'COALESCE({c}, 0)' for c in _slots('QTY'))} AS loose,
           QTY01 + QTY02 AS strict,
           CASE WHEN QTY01 + QTY02 > 60 THEN 1 WHEN QTY01 + QTY02 <= 60 THEN 0 END AS over_60
    FROM wide
    """
)
def row_sums(spark, folder):
    """Row sums with NULL as zero and with NULL kept; an indicator on the latter."""
    wide = wide_orders(spark, folder)
    strict = row_sum_strict(["QTY01", "QTY02"])
    return wide.select(
        "l_orderkey",
        row_sum(slot_columns(wide, "QTY").values()).alias("loose"),
        strict.alias("strict"),
        any_positive(strict - 60).alias("over_60"),
    )


_LABEL = " || ".join(f"CASE WHEN \"{e}\" = 1 THEN '{e}' ELSE '' END" for e in EVENT_TYPES)


@query(
    f"""
    WITH {WIDE_USERS}, labelled AS (SELECT user_id, NULLIF({_LABEL}, '') AS form FROM wide)
    SELECT user_id, form, CASE WHEN contains(form, 'purchase') THEN 'purchase' ELSE form END AS collapsed,
           CASE WHEN form IS NULL THEN NULL WHEN form = 'purchase' THEN 1
                WHEN contains(form, 'error') THEN NULL ELSE 0 END AS networked
    FROM labelled
    """
)
def flag_labels(spark, folder):
    """Names of the set items joined; collapse and exclusive-item rules."""
    labelled = wide_users(spark, folder).select("user_id", flag_label(EVENT_TYPES).alias("form"))
    return labelled.select(
        "user_id",
        "form",
        collapse_label("form", "purchase").alias("collapsed"),
        only_flag("form", "purchase", "error").alias("networked"),
    )


@query(
    """
    SELECT user_id, string_agg(event_type, '' ORDER BY event_type) FILTER (set_once) AS form
    FROM (SELECT user_id, event_type, max(value) > 150 AS set_once FROM events GROUP BY 1, 2) GROUP BY 1
    """
)
def flag_labels_long(spark, folder):
    """The same label built from long rows, one item per row; a user without any keeps a NULL label."""
    set_now = F.col("value") > 150
    flags = table(spark, folder, "events").select(
        "user_id", *[F.when((F.col("event_type") == e) & set_now, 1).otherwise(0).alias(e) for e in EVENT_TYPES]
    )
    return set_flags_long(flags, "user_id", EVENT_TYPES, "form")


_YES = {e: f"CASE \"{e}\" WHEN 1 THEN 1 WHEN 6 THEN 0 END" for e in EVENT_TYPES}


@query(
    f"""
    WITH {WIDE_USERS}, items AS (SELECT user_id, {', '.join(f'{v} AS "{k}"' for k, v in _YES.items())} FROM wide),
    scored AS (SELECT *, "click" + "error" + "purchase" + "signup" AS score, user_id % 6 AS self FROM items)
    SELECT user_id,
           CASE WHEN self = 0 THEN NULL WHEN self IN (1, 2) OR score >= 3 THEN 'good'
                WHEN self = 3 OR score = 2 THEN 'enough' WHEN self = 4 OR score < 2 THEN 'poor' END AS level
    FROM scored
    """
)
def ability_level(spark, folder):
    """Level from a self-report, else from the number of items answered yes."""
    from tessera.plans.survey import ability

    items = wide_users(spark, folder).select(
        "user_id", *[yes_no(e).alias(e) for e in EVENT_TYPES], (F.col("user_id") % 6).alias("self")
    )
    score = row_sum_strict(["click", "error", "purchase", "signup"])
    level = ability("self", score, {"good": [1, 2], "enough": [3], "poor": [4]})
    return items.select("user_id", F.when(F.col("self") != 0, level).alias("level"))


@query(
    f"""
    WITH {WIDE_ORDERS}
    SELECT lpad((l_orderkey % 7 + 1)::VARCHAR, 2, '0') AS head, count(*) AS households,
           count(QTY01) AS first_known
    FROM wide GROUP BY 1
    """
)
def padded_heads(spark, folder):
    """Household heads by zero-padded slot number."""
    return (
        _with_head(spark, folder)
        .groupBy(padded("head").alias("head"))
        .agg(F.count("*").alias("households"), F.count("QTY01").alias("first_known"))
    )
