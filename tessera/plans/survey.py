"""Raw household survey to analysis-ready person table.

Each stage is a function from DataFrame to DataFrame; ``process`` chains
them into one lazy plan. Derivations stay on their own row, so nothing relies
on row order. Reference tables arrive as a ``References`` bundle; their joins
are broadcast by Spark while they are as small as real codebooks are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import (
    INCOME_MIDPOINTS,
    SEARCH_MONTHS,
    bracket_value,
    minus_months,
    month_start,
    period_label,
    period_year,
    quarter_label,
    years_since,
)
from tessera.functions.semantics import (
    any_positive,
    as_col,
    blank_to_null,
    clamp_min,
    first_non_null,
    is_true,
    member_of,
    name_key,
    null_if,
    r_ifelse,
    recode,
    row_sum,
    row_sum_strict,
    safe_ln,
    safe_ratio,
    yes_no,
)
from tessera.functions.slots import (
    collapse_label,
    count_where,
    flag_label,
    has_changed,
    last_match_index,
    last_non_null,
    only_flag,
    pick_by_index,
    pick_where,
    position_at,
    slot_columns,
)
from tessera.operators.clean import matching, select_unique
from tessera.operators.household import (
    household_counts,
    member_attributes,
    reference_person,
    relation_columns,
)
from tessera.operators.joins import (
    decode,
    decode_slots,
    fill_from_rows,
    panel_join,
    panel_slices,
    period_rates,
    share_of_total,
)
from tessera.operators.reshape import melt, melt_years

# Codes and labels of the questionnaire.
SPAIN = "108"
SPANISH_LANGUAGE = 101
SPANISH_NAME = "español"
MEMBER_SLOTS = list(range(1, 16))
REFERENCE_ATTRIBUTES = ["EDAD", "SEXO", "PNAC", "ALLE", "MLLE", "ANAC", "NESP"]
MOTIVES = [
    "JUB", "DSLA", "FEMP", "BEMP", "POLI", "RELI", "EDUC", "CALV", "REAG", "COST", "CLIM", "TRNS",
    "OTRS",
]
MEMBER_ATTRIBUTES = {
    "EDAD": "compi_age", "PNAC": "compi_country", "SEXO": "compi_sex", "NESP": "compi_nesp",
    "DNAC": "compi_dnac", "ANE": "compi_ane", "ALLE": "compi_arrival_spain",
}
ZERO_IS_MISSING = [
    "NESP", "MLLE", "ANAC", "LMAT", "TIPEST", "TRAB1", "TRAB2", "TRANT", "TPO1", "DOCUM", "TENHH",
    "ANOCOM", "MESCOM",
]
OTHER_MISSING = {
    "EDAD": [999], "HORAS2": [999], "INGRTR": [0, 10], "RECANT": [99999], "NUMHH": [99], "NCONTR": [99],
}
BLANK_IS_MISSING = [
    "PNAC", "OCUP1", "OCUP2", "OCUP3", "CIOCUP1", "CIOCUP2", "CIOCUP3", "SECT1", "SECT2", "SECT3",
]
SUPPORT_ITEMS = ["LLCONT", "LLFAM", "LLAMIG", "LLEMPR", "LLINTR", "LLCONO", "LLOTR", "DINFAM"]
PARTICIPATION_ITEMS = [
    "PXAYU", "PXDEP", "PXEDU", "PXREL", "PXSOC", "PNXONG", "PNXPOL", "PNXREL", "PNXEDU", "PNXDEP",
    "PNXSOC", "PELEC",
]
FREE_HOUSING = [11, 12, 13, 14]
FIRST_PANEL_YEAR = 1998
SURVEY_YEAR = 2006
ALL_ORIGINS = "TOTAL.EXTRANJEROS"
ABILITY_LEVELS = {"Bien": [1, 2], "Suficiente": [3], "Necesita mejorar": [4]}


@dataclass
class References:
    """Dimension tables (code, label) and panels a survey is enriched with."""

    country: DataFrame
    province: DataFrame
    community: DataFrame
    language: DataFrame
    occupation: DataFrame
    occupation_detail: DataFrame
    sector: DataFrame
    situation: DataFrame
    education: DataFrame
    register: DataFrame
    census: DataFrame
    unemployment: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def migration_motives(df: DataFrame) -> DataFrame:
    """Which recorded move led to Spain, and the motives given for it."""
    df = df.withColumn("motive_var", last_match_index(slot_columns(df, "PTRS"), SPAIN, pad=2))
    index = F.col("motive_var").cast("int")
    return df.withColumns({m: yes_no(pick_by_index(slot_columns(df, m), index)) for m in MOTIVES})


def clean_missing(df: DataFrame) -> DataFrame:
    """Sentinel codes and blanks to NULL; arrival year from the first residence."""
    arrival = null_if("ALLE", [0])
    columns = {c: null_if(c, [0]) for c in ZERO_IS_MISSING}
    columns |= {c: null_if(c, codes) for c, codes in OTHER_MISSING.items()}
    columns |= {c: blank_to_null(c) for c in BLANK_IS_MISSING}
    columns["PR1VI"] = blank_to_null("PR1VI", also=["00"])
    columns["ALLE"] = first_non_null(arrival, F.when(F.col("ANOM01") > 0, F.col("ANOM01")))
    return df.withColumns(columns)


def decode_labels(df: DataFrame, refs: References) -> DataFrame:
    """Codes to labels; the six country attributes arrive in one join."""
    df = decode(
        df,
        refs.country.withColumn("register_match", name_key("register_match")),
        "PNAC",
        {
            "register_match": "country",
            "census_match": "country_1991",
            "short": "country_short",
            "eu": "country_eu",
            "grouping": "country_class",
            "spanish_mother_tongue": "country_spanish",
        },
    )
    df = decode(df, refs.language, "LMAT", {"label": "language"})
    provinces = refs.province.withColumn("label", F.trim("label"))
    df = decode_slots(df, provinces, {"PR1VI": "province_PR1VI"})
    df = decode(df, refs.community.withColumn("label", F.trim("label")), "CCAA", {"label": "comunidad"})
    for dim, source, out in (
        (refs.occupation, "OCUP", "occupation"),
        (refs.occupation_detail, "CIOCUP", "cioccupation"),
        (refs.sector, "SECT", "sector"),
        (refs.situation, "SITU", "situation"),
    ):
        df = decode_slots(df, dim, {f"{source}{i}": f"{out}{i}" for i in (1, 2, 3)})
    df = decode(df, refs.education, "MNIV", {"label": "education"})
    fallback = F.when(F.col("TIPEST") == 6, "Sin estudios").when(F.col("TIPEST") == 1, "Alguno/no sabe")
    return df.withColumn("education", F.coalesce("education", fallback))


def housemates(df: DataFrame) -> DataFrame:
    """Relation and attributes of every other member, and the counts over them."""
    df = relation_columns(df, "NPELEG", MEMBER_SLOTS, out="compi_relation")
    df = member_attributes(df, "NPELEG", MEMBER_SLOTS, MEMBER_ATTRIBUTES)
    return household_counts(df, "NPERS", MEMBER_SLOTS)


def siblings_homes(df: DataFrame, refs: References) -> DataFrame:
    """Where siblings outside the household live; ``province`` is decoded on the way."""
    homes = slot_columns(df, "PRHE")
    df = df.withColumns({c: blank_to_null(c, also=["00"]) for c in homes.values()})
    provinces = refs.province.withColumn("label", F.trim("label"))
    df = decode_slots(
        df, provinces, {"CPRO": "province", **{c: f"HH_province{i}" for i, c in homes.items()}}
    )
    where = slot_columns(df, "DVHE")
    same_municipality = count_where(where, lambda c: c == 1)
    named = [f"HH_province{i}" for i in homes]
    return df.withColumns(
        {
            "HH_no_convive": count_where(slot_columns(df, "NOHE"), lambda c: c.isNotNull()),
            "HH_mismo_prov": count_where(named, lambda c: c == F.col("province")) + same_municipality,
            "HH_mismo_mun": same_municipality,
            "HH_en_espana": count_where(where, lambda c: c.isin(1, 2)),
        }
    )


def ability(self_report, score, codes: Mapping[str, Sequence]) -> Column:
    """Level from a self-report code, else from the number of abilities (3, 2, fewer)."""
    report, score = as_col(self_report), as_col(score)
    high, middle, low = codes
    return r_ifelse(
        member_of(report, codes[high]) | (score >= 3),
        high,
        r_ifelse(
            (report == codes[middle][0]) | (score == 2),
            middle,
            r_ifelse((report == codes[low][0]) | (score < 2), low, F.lit(None).cast("string")),
        ),
    )


def spanish_items(df: DataFrame) -> DataFrame:
    """Comprehension, speech, reading and writing of Spanish among the listed languages."""
    keys = slot_columns(df, "IDIO")
    return df.withColumns(
        {
            p: pick_where(keys, slot_columns(df, p), SPANISH_LANGUAGE)
            for p in ("COMP", "HABLA", "LEE", "ESCRI")
        }
    )


def language_level(df: DataFrame) -> DataFrame:
    """Spanish level: native by mother tongue, else reported or tested ability."""
    score = row_sum_strict([yes_no(p) for p in ("COMP", "HABLA", "LEE", "ESCRI")])
    native = F.col("language") == SPANISH_NAME
    return df.withColumn("spanish", r_ifelse(native, F.lit("Nativo"), ability("HAESP", score, ABILITY_LEVELS)))


def residence(df: DataFrame) -> DataFrame:
    """Moves between provinces and municipalities, population stratum, start years."""
    provinces = matching(df, r"PRV\d", exclude=["PRVIV"])
    towns = matching(df, r"MUV_\d")
    strata = list(slot_columns(df, "MUV").values())
    df = df.withColumns({c: blank_to_null(c) for c in [*provinces, *towns, *strata, "MUV"]})
    df = df.withColumns(
        {
            "has_moved_province": has_changed(provinces),
            "has_moved_mun": has_changed(towns),
            **{c: null_if(c, [0]) for c in slot_columns(df, "ANOM").values()},
        }
    )
    df = fill_from_rows(
        df, "MUV", "MUV_01", "MUV01", "mun_estrato", skip=["No Sabe"], order=F.col("IDQ")
    )
    df = df.withColumn("ANOM", last_non_null(slot_columns(df, "ANOM")))
    stayed = (F.col("CBVIV") == 6) | (F.col("PRVIV") == 1)
    never_moved = F.when(F.col("has_moved_province") == 0, F.col("ALLE"))
    floor = F.coalesce("ANOM", r_ifelse(stayed, F.col("ALLE"), never_moved))
    df = df.withColumn("ANOM_floor", floor)
    df = df.withColumn("ANOM_ceiling", clamp_min("ANOM_floor", FIRST_PANEL_YEAR))
    return df.withColumn("ANOM_iv", clamp_min(F.col("ANOM_ceiling") - 3, FIRST_PANEL_YEAR))


def job_search(df: DataFrame, refs: References) -> DataFrame:
    """Imputed start of the first job search, and the province lived in then."""
    df = df.withColumn("job_search_months", recode("TPO1", SEARCH_MONTHS))
    known = (F.col("PRIMTR") == 1) & F.col("ANOCOM").isNotNull() & F.col("job_search_months").isNotNull()
    start = minus_months(month_start("ANOCOM", "MESCOM"), "job_search_months")
    df = df.withColumn("job_search_start_dt", F.when(known, start))
    label = period_label("job_search_start_dt", F.col("MESCOM").isNotNull())
    df = df.withColumn("job_search_start_yr_qt", label)
    df = df.withColumn("job_search_start_yr", period_year("job_search_start_yr_qt"))
    df = df.withColumn("prv_num", position_at(slot_columns(df, "ANOM"), "job_search_start_yr"))
    df = df.withColumn("prv_job_search", pick_by_index(slot_columns(df, "PRV"), "prv_num"))
    provinces = refs.province.withColumn("label", F.trim("label"))
    return decode(df, provinces, "prv_job_search", {"label": "province_job_search"})


def register_panel(wide: DataFrame) -> DataFrame:
    """Register sheet to a long panel with the share of the national figure."""
    ids = ["Destination", "Destination_mapSpain", "Origin", "SEXO"]
    long = melt_years(wide, ids, "eth_dens_prov").withColumn("Origin", name_key("Origin"))
    long = long.select("Destination", "Origin", F.col("SEXO").alias("sex"), "year", "eth_dens_prov")
    return share_of_total(
        long, "Destination", "Total", "eth_dens_prov", ["year", "sex", "Origin"]
    )


def register_joins(df: DataFrame, refs: References) -> DataFrame:
    """Densities at the row's own years, and fixed-year slices in one join."""
    sex = recode("SEXO", {1: "Male", 2: "Female"}, keep_unmapped=False)
    df = df.withColumn("sex", sex).withColumn("ALLE_year", F.col("ALLE").cast("int"))
    panel = register_panel(refs.register)
    density, relative = "eth_dens_prov", "eth_dens_prov_relative"
    for place, year, values in (
        ("province", "ANOM_iv", {density: "eth_dens_prov_iv_3yr"}),
        ("province", "ANOM_ceiling", {density: "eth_dens_prov_1", relative: "eth_dens_prov_1_relative"}),
        ("province_job_search", "job_search_start_yr", {density: "eth_dens_prov_2"}),
        ("province", "ALLE_year", {density: "eth_dens_prov_2i"}),
    ):
        on = {place: "Destination", "country": "Origin", "sex": "sex", year: "year"}
        df = panel_join(df, panel, on, values)
    total = f"{density}_Total"
    slices = panel_slices(
        panel,
        ["Destination", "Origin", "sex"],
        "year",
        {
            **{f"eth_dens_prov_{y}": (density, y) for y in (1998, 2003, 2006, 2007)},
            **{f"eth_dens_prov_{y}_relative": (relative, y) for y in (2006, 2007)},
            **{f"eth_dens_prov_all_prov_{y}": (total, y) for y in (1998, 2007)},
        },
    )
    on = {"province": "Destination", "country": "Origin", "sex": "sex"}
    df = panel_join(df, slices, on, {c: c for c in slices.columns if c not in on.values()})
    everyone = panel_slices(
        panel.filter(F.col("Origin") == ALL_ORIGINS),
        ["Destination", "sex"],
        "year",
        {f"eth_dens_prov_all_imm_{y}": (density, y) for y in (1998, 2007)},
    )
    on = {"province": "Destination", "sex": "sex"}
    df = panel_join(df, everyone, on, {c: c for c in everyone.columns if c not in on.values()})
    return df.drop("ALLE_year")


def census_join(df: DataFrame, refs: References) -> DataFrame:
    """Densities of the earlier census, which has its own origin names."""
    long = melt(refs.census, ["Provincia"], None, "origin", "v")
    shares = share_of_total(long, "Provincia", "TOTAL", "v", ["origin"], keep_total=False)
    on = {"province": "Provincia", "country_1991": "origin"}
    return panel_join(
        df, shares, on, {"v": "eth_dens_prov_1991", "v_relative": "eth_dens_prov_1991_relative"}
    )


def social_items(df: DataFrame) -> DataFrame:
    """Yes/no items to 1/0, and the combined ways of finding a job."""
    items = {c: yes_no(c) for c in [*SUPPORT_ITEMS, *PARTICIPATION_ITEMS]}
    items["CONFAM"] = recode("CONFAM", {1: 1, 6: 0, 2: None})
    df = df.withColumns(items)
    label = flag_label(matching(df, r"^FORM"))
    return df.withColumn("form", label).withColumn(
        "form_any_friends", collapse_label("form", "FORM04")
    )


def work_history() -> dict[str, Column]:
    """Three-valued flags: worked before arrival, worked before in the country."""
    before = F.col("sector1").isNotNull() | (F.col("TRAB1") == 1) | (F.col("TRANT") == 1)
    here = F.col("sector3").isNotNull() | (F.col("PRIMTR") == 6) | (F.col("TRANTE") == 1)
    not_here = (F.col("PRIMTR") == 1) | (F.col("TRANTE") == 6)
    answered = ~(F.col("TRAB1").isNull() & F.col("TRANT").isNull())
    return {
        "had_worked": r_ifelse(before, F.lit(1), F.when(answered, 0)),
        "had_worked_spain": F.when(is_true(here), 1).when(not_here, 0),
    }


def derive_person(df: DataFrame) -> DataFrame:
    """Person, work and social variables that need no other derived variable."""
    year = F.col("job_search_start_yr")
    permit = member_of("DOCUM", [1, 2, 3]) | (F.col("country_eu") == "Yes")
    no_permit_info = F.col("DOCUM").isNull() & F.col("country_eu").isNull()
    return df.withColumns(
        {
            "arrival_spain_yr": F.col("ALLE"),
            "arrival_spain_mo": F.col("MLLE"),
            "arrival_spain_qt": quarter_label("MLLE"),
            "years": years_since("ALLE", SURVEY_YEAR),
            "years_job_search": years_since("ALLE", year),
            "age": F.col("EDAD"),
            "age_arrival": F.col("ALLE") - F.col("ANAC"),
            "age_job_search": year - F.col("ANAC"),
            "work_permit": r_ifelse(permit, F.lit("Yes"), F.when(~no_permit_info, "No")),
            "spanish_nat": yes_no("NESP"),
            "municipality": F.trim("MUV"),
            "mun_strata": F.col("mun_estrato"),
            "arrival_mun": F.col("ANOM"),
            "part_time": r_ifelse(F.col("HORAS2") < 30, 1, 0),
            "weekly_hours": F.col("HORAS2"),
            "month_hours": F.col("HORAS2") * 4,
            "economic": any_positive(F.col("DSLA") + F.col("FEMP") + F.col("BEMP")),
            "retire": F.col("JUB"),
            "political": F.col("POLI"),
            "religious": F.col("RELI"),
            "student": F.col("EDUC"),
            "quality": F.col("CALV"),
            "regroup": F.col("REAG"),
            "cheaper": F.col("COST"),
            "climate": F.col("CLIM"),
            "temporary": F.col("TRNS"),
            "other": F.col("OTRS"),
            "working": yes_no("TRAB2"),
            "was_working": yes_no("TRAB1"),
            **work_history(),
            "month_earn": F.col("INGRE"),
            "month_earn_est": bracket_value("INGRE", "INGRTR", INCOME_MIDPOINTS),
            "lt_search_1mo": r_ifelse(F.col("TPO1") <= 2, 1, 0),
            "lt_search_3mo": r_ifelse(F.col("TPO1") <= 3, 1, 0),
            "lt_search": F.col("TPO1"),
            "remittance": F.col("RECANT"),
            "influenced": yes_no("INFLU"),
            "first_job_still": yes_no("PRIMTR"),
            "insecurity": yes_no("BUSEMP"),
            "precontract": recode("PROPTR", {1: 1, 6: 0, 0: None}),
            "networked": only_flag("form", "FORM04", "FORMNS"),
            "support_index": F.when(
                F.col("LLCONT").isNotNull(), row_sum(["LLFAM", "LLAMIG", "LLCONO"])
            ),
            "housing_connect": F.when(member_of("TENV", FREE_HOUSING), 1).otherwise(0),
            "participation_index": row_sum_strict(PARTICIPATION_ITEMS),
            "num_siblings": r_ifelse(F.col("TENHH") == 6, F.lit(0), F.col("NUMHH")),
            "reference_person": F.col("NPELEG"),
            "wage_pop": F.when(F.col("INGRE").isNotNull(), 1).otherwise(0),
        }
    )


SQUARES = [
    "years", "age", "age_arrival", "age_job_search", "eth_dens_prov_1", "eth_dens_prov_1_relative",
    "eth_dens_prov_2006", "eth_dens_prov_2", "eth_dens_prov_2i",
]
CHANGES = {
    "eth_dens_change_1998_2007": ("eth_dens_prov_2007", "eth_dens_prov_1998"),
    "eth_dens_change_2003_2007": ("eth_dens_prov_2007", "eth_dens_prov_2003"),
    "eth_dens_change_all_imm_1998_2007": ("eth_dens_prov_all_imm_2007", "eth_dens_prov_all_imm_1998"),
    "eth_dens_change_wi_imm_1998_2007": ("eth_dens_prov_all_prov_2007", "eth_dens_prov_all_prov_1998"),
}
RELATIVE_CHANGES = {
    "eth_dens_change_rel_all_imm_1998_2007": "eth_dens_change_all_imm_1998_2007",
    "eth_dens_change_rel_wi_imm_1998_2007": "eth_dens_change_wi_imm_1998_2007",
}
# Names of the output contract.
LOGS = [
    "month_earn", "month_earn_est", "hour_earn", "eth_dens_change_1998_2007", "eth_dens_prov_1",
    "eth_dens_prov_1_relative", "eth_dens_prov_2006", "eth_dens_prov_2006_relative",
    "eth_dens_prov_1991_relative", "eth_dens_prov_2007", "eth_dens_prov_2", "eth_dens_prov_2i",
    "eth_dens_change_2003_2007", "eth_dens_change_rel_all_imm_1998_2007",
    "eth_dens_change_rel_wi_imm_1998_2007", "eth_dens_prov_1991", "eth_dens_prov_iv_3yr",
    "eth_dens_prov_1998",
]


def derive_measures(df: DataFrame) -> DataFrame:
    """Squares, changes, ratios and logs, in three projections."""
    first = {f"{c}_sq": F.pow(F.col(c), 2) for c in SQUARES}
    first |= {out: F.col(a) - F.col(b) for out, (a, b) in CHANGES.items()}
    first |= {
        "arrival_spain_dt": F.concat(F.col("ALLE").cast("int").cast("string"), "arrival_spain_qt"),
        "hour_earn": safe_ratio("month_earn", "month_hours"),
        "any_support": any_positive("support_index"),
        "participation_indicator": any_positive("participation_index"),
    }
    df = df.withColumns(first)
    df = df.withColumns(
        {out: safe_ratio("eth_dens_change_1998_2007", base) for out, base in RELATIVE_CHANGES.items()}
    )
    return df.withColumns({f"log_{c}": safe_ln(c) for c in LOGS})


def unemployment_joins(df: DataFrame, refs: References) -> DataFrame:
    """Unemployment rate at arrival and at the first job search, yearly mean as fallback."""
    long = melt(refs.unemployment, ["Province", "Destination_mapSpain", "Sex"], None, "year_qt", "rate")
    long = long.withColumn("rate", F.col("rate").try_cast("double"))
    rates = period_rates(long, ["Province", "Sex"], "year_qt", "rate")
    for place, period, out in (
        ("province", "arrival_spain_dt", "tasa_paro_arrival"),
        ("province_job_search", "job_search_start_yr_qt", "tasa_paro_first_job"),
    ):
        df = panel_join(df, rates, {place: "Province", "sex": "Sex", period: "year_qt"}, {"rate": out})
    return df


# Names of the output contract.
SUBSET = [
    "IDQ", "NPERS", "arrival_spain_yr", "arrival_spain_mo", "arrival_spain_dt", "arrival_spain_qt",
    "arrival_mun", "years", "age", "age_arrival", "age_sq", "age_arrival_sq", "sex", "education",
    "work_permit", "spanish_nat", "country", "country_short", "country_class", "province", "comunidad",
    "occupation1", "occupation2", "occupation3", "sector1", "sector2", "sector3", "situation1",
    "situation2", "situation3", "municipality", "mun_strata", "num_siblings", "economic", "working",
    "was_working", "had_worked", "part_time", "month_earn", "log_month_earn", "weekly_hours",
    "month_hours", "hour_earn", "log_hour_earn", "lt_search_1mo", "lt_search_3mo", "lt_search",
    "remittance", "eth_dens_prov_1", "eth_dens_prov_2", "eth_dens_prov_iv_3yr", "eth_dens_prov_1998",
    "log_eth_dens_prov_1", "log_eth_dens_prov_2", "log_eth_dens_prov_iv_3yr",
    "log_eth_dens_prov_1998", "eth_dens_prov_1_sq", "eth_dens_prov_2_sq", "influenced",
    "first_job_still", "insecurity", "precontract", "form", "networked", "support_index",
    "any_support", "housing_connect", "participation_index", "participation_indicator",
    "num_siblings", "reference_person", "has_moved_province", "has_moved_mun", "tasa_paro_arrival",
    "tasa_paro_first_job", "job_search_start_yr_qt", "wage_pop",
]


# Columns that later stages only carry along: member, motive, sibling and language slots.
CARRIED = (
    r"^(P\d\d_\d\d|compi_\w+|(EDAD|SEXO|PNAC|ALLE|MLLE|ANAC|NESP|DNAC|ANE|PTRS)\d\d"
    rf"|({'|'.join(MOTIVES)})\d\d|(IDIO|COMP|HABLA|LEE|ESCRI)\d|(PRHE|DVHE|NOHE)\d\d|HH_province\d+)$"
)


def pack(df: DataFrame, pattern: str, name: str = "__carried") -> DataFrame:
    """Matching columns as one struct, so that joins copy one field instead of hundreds."""
    packed = matching(df, pattern)
    rest = [c for c in df.columns if c not in set(packed)]
    return df.select(*rest, F.struct(*packed).alias(name)) if packed else df


def unpack(df: DataFrame, name: str = "__carried") -> DataFrame:
    return df.select("*", f"{name}.*").drop(name) if name in df.columns else df


def process(df: DataFrame, refs: References) -> DataFrame:
    """The whole derivation, lazily; unused columns are never computed.

    The municipality lookup is built first, while it still reads a few raw
    columns. Household blocks follow, and their several hundred slot columns
    are packed before the label and panel joins.
    """
    df = reference_person(df, "NPELEG", {a: a for a in REFERENCE_ATTRIBUTES})
    df = residence(clean_missing(migration_motives(df)))
    df = siblings_homes(spanish_items(housemates(df)), refs)
    df = decode_labels(pack(df, CARRIED), refs)
    df = job_search(language_level(df), refs)
    df = census_join(register_joins(df, refs), refs)
    df = derive_measures(derive_person(social_items(df)))
    return unpack(unemployment_joins(df, refs))


def subset(df: DataFrame) -> DataFrame:
    """The columns handed on to analysis, with the optional household blocks."""
    blocks = [
        *matching(df, r"^compi_"), "spanish_housemates", "dependents", "HH_convive",
        *matching(df, r"^HH_province"), "HH_no_convive", "HH_mismo_prov", "HH_mismo_mun", "HH_en_espana",
        "spanish",
    ]
    return select_unique(df, [*SUBSET, *blocks])
