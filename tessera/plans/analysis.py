"""Person table to study populations, tables and chart data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import SIZE_LABELS, level_rank, relabel, size_class, split_at
from tessera.functions.semantics import is_true, r_ifelse, recode, safe_ln, safe_ratio
from tessera.operators.clean import complete_case, drop_listed, population
from tessera.operators.groups import (
    cell_text,
    contingency_table,
    crosstab,
    crosstab_text,
    frequency_table,
    unit_scale,
    within_group_percent,
)
from tessera.operators.joins import attach_attributes, share_of_total
from tessera.operators.reshape import melt, melt_years
from tessera.plans.concentration import size_percentages
from tessera.stats.design import Cat
from tessera.stats.linear import impute_by_model
from tessera.stats.tests import prop_test, welch_test

# Category labels of the survey and the order they are ranked in.
EDUCATION_NUMBERS = {
    "Sin estudios": 0, "Alguno/no sabe": 1, "Primaria (incompleto)": 2, "Primaria (completo)": 3,
    "Secudaria (primer ciclo)": 4, "Secudaria (segundo ciclo)": 5, "Terciaria (primer ciclo)": 6,
    "Terciaria (segundo ciclo)": 7,
}
EDUCATION_ENGLISH = {
    "Sin estudios": "No studies", "Alguno/no sabe": "Some studies",
    "Primaria (incompleto)": "Primary (incomplete)", "Primaria (completo)": "Primary (complete)",
    "Secudaria (primer ciclo)": "Secondary (1st cycle)",
    "Secudaria (segundo ciclo)": "Secondary (2nd cycle)",
    "Terciaria (primer ciclo)": "Tertiary (1st cycle)",
    "Terciaria (segundo ciclo)": "Tertiary (2nd cycle)",
}
NO_SECONDARY = "No secondary"
EDUCATION_CLASSES = (
    "No secondary", "Secondary (1st cycle)", "Secondary (2nd cycle)", "Tertiary (1st cycle)",
    "Tertiary (2nd cycle)",
)
SECTORS = (
    "Agriculture", "Business, commerce", "Construction", "Education", "Energy",
    "Extractive industries", "Financial intermediation", "Health, social, and community services",
    "Hospitality", "Household activities", "Manufacturing", "Public administration, defense",
    "Real estate; rental, business services", "Transportation, communications", "Unspecified",
)
SPANISH_LEVELS = ("Necesita mejorar", "Suficiente", "Bien", "Nativo")
DEVELOPED = "Developed countries (>75% GDPpc of Spain)"
# In the order in which the wide tables show them.
TOP_COUNTRIES = ["Argentina", "Bolivia", "Colombia", "Ecuador", "Marruecos", "Perú", "Rumanía"]
TOP_PROVINCES = [
    "Baleares (Illes)", "Barcelona", "Madrid", "Murcia", "Navarra", "Rioja (La)", "Valencia", "Zaragoza",
]
SMALL_SECTORS = [
    "Education", "Energy", "Extractive industries", "Financial intermediation",
    "Public administration, defense", "Transportation, communications",
]
SIZE_NAMES = ["< 10,000", "10,001 - 20,000", "20,001 - 50,000", "> 50,000"]

EDUCATION = Cat("education_eng_class", EDUCATION_CLASSES)
SECTOR = Cat("sector2", SECTORS)
SEX = Cat("sex", ("Male", "Female"))
PERMIT = Cat("work_permit", ("Yes", "No"))
BACKGROUND = ["eth_dens_prov_1", "country", "comunidad", EDUCATION]

# The columns that must be known, per study.
WAGE_CASE = [
    "education_eng", "education_eng_class", "years_final", "age_final", "age_sq_final", "sex", "country",
    "country_class", "comunidad", "province", "municipality",
]
SEARCH_CASE = [
    "lt_search_3mo", "education_eng", "education_eng_class", "educ_num", "years_job_search",
    "age_job_search", "age_job_search_sq", "sex", "had_worked", "country_class", "sector1",
    "occupation1", "tasa_paro_first_job", "province_job_search",
]


def categories(df: DataFrame) -> DataFrame:
    """Education codes and labels, language rank, economic motive, working label."""
    coarse = {k: NO_SECONDARY if n < 4 else EDUCATION_ENGLISH[k] for k, n in EDUCATION_NUMBERS.items()}
    wanted_quality = (F.col("quality") == 1) & (F.col("country_class") != DEVELOPED)
    return df.withColumns(
        {
            "educ_num": relabel("education", EDUCATION_NUMBERS),
            "education_eng": relabel("education", EDUCATION_ENGLISH),
            "education_eng_class": relabel("education", coarse),
            "spanish_rank": level_rank("spanish", SPANISH_LEVELS),
            "economic_final": r_ifelse((F.col("economic") == 1) | wanted_quality, True, False),
            "working": recode("working", {1: "Yes", 0: "No"}, keep_unmapped=False),
        }
    )


def impute(df: DataFrame) -> DataFrame:
    """Hours, age and years of economic immigrants filled by regression."""
    where = F.col("economic_final")
    shared = [*BACKGROUND]
    df, _ = impute_by_model(
        df, "weekly_hours", [*shared, "years", "age", "age_sq", SEX, PERMIT, SECTOR], where
    )
    hourly = safe_ratio("month_earn", F.col("weekly_hours_final") * 4)
    df = df.withColumn("hour_earn_final", hourly)
    df = df.withColumn("log_hour_earn_final", safe_ln("hour_earn_final"))
    df, _ = impute_by_model(
        df, "age", [*shared, "years", SEX, PERMIT, SECTOR], where, squared="age_sq_final"
    )
    df, _ = impute_by_model(
        df, "years", [*shared, "age", SEX, PERMIT, SECTOR], where, squared="years_sq_final"
    )
    return df


def prepare(df: DataFrame, with_imputation: bool = True) -> DataFrame:
    """Analysis table: categories, imputed values, strata, complete-case flags.

    The imputations fit three regressions, each scanning the input; hand in a
    stored table (``checkpoint_table``) rather than the raw derivation.
    """
    df = categories(df)
    if with_imputation:
        df = impute(df)
    else:
        raw = ["weekly_hours", "hour_earn", "log_hour_earn", "age", "age_sq", "years", "years_sq"]
        df = df.withColumns({f"{c}_final": F.col(c) for c in raw if c in df.columns})
    df = df.withColumn("province_strata", F.concat("province", "mun_strata"))
    df = complete_case(df, WAGE_CASE, "complete_case_1")
    df = complete_case(df, [*WAGE_CASE, "country_1991"], "complete_case_iv")
    return complete_case(df, SEARCH_CASE, "complete_case_2")


@dataclass
class Populations:
    """Named study populations."""

    wage: DataFrame
    search: DataFrame
    economic: DataFrame
    other: DataFrame


def wage_population(df: DataFrame) -> DataFrame:
    """Economic immigrants with complete cases, in countries and strata of some size.

    Each of the two size rules runs a job while the frame is built; hand in a
    stored table.
    """
    woman_with_family = (
        (F.col("sex") == "Female") & (F.col("dependents") > 0) & (F.col("partner_convive") == 1)
    )

    def flags(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "wage_data": F.when(F.col("log_hour_earn").isNotNull(), 1).otherwise(0),
                "woman_married_kids": r_ifelse(woman_with_family, 1, 0),
            }
        )

    return population(
        df,
        F.col("economic_final") & F.col("complete_case_1"),
        F.col("ANOM_floor") >= 1998,
        drop_listed("province", ["Ceuta", "Melilla"]),
        flags,
        (["country"], 10),
        (["province_strata"], 11),
    )


def search_population(df: DataFrame) -> DataFrame:
    """Those still in their first job, for the time-to-first-job analysis."""
    return population(
        df,
        (["country"], 1),
        F.col("economic_final") & (F.col("precontract") == 0) & (F.col("first_job_still") == 1),
        F.col("complete_case_2"),
        F.col("log_eth_dens_prov_2").isNotNull(),
    )


def populations(df: DataFrame) -> Populations:
    return Populations(
        wage=wage_population(df),
        search=search_population(df),
        economic=df.filter(F.col("economic_final")),
        other=df.filter(~F.col("economic_final")),
    )


def cohort_shares(df: DataFrame) -> DataFrame:
    """Economic against other immigrants, level by level, small sectors left out."""
    tested = prop_test(
        df,
        F.col("economic_final"),
        ["working", "sex", "education_eng_class", "country_class", "sector2", "comunidad"],
    )
    return tested.filter(drop_listed("level", SMALL_SECTORS))


def selection_shares(wage: DataFrame) -> DataFrame:
    """Wage earners against the rest of the wage population."""
    tested = prop_test(
        wage,
        F.col("wage_data") == 1,
        ["sex", "education_eng_class", "country_class", "woman_married_kids"],
    )
    flag = F.col("variable") == "woman_married_kids"
    return tested.withColumn(
        "level", F.when(flag, recode("level", {"0": "No", "1": "Yes"})).otherwise(F.col("level"))
    )


def cohort_means(df: DataFrame, cohort: Column, columns: Sequence[str]) -> DataFrame:
    """Means, spreads and Welch tests of two cohorts."""
    return welch_test(df, cohort, columns)


def wage_cells(
    wage: DataFrame, countries: Sequence[str] = TOP_COUNTRIES, provinces: Sequence[str] = TOP_PROVINCES
) -> DataFrame:
    """Mean hourly wage and count, country by province, margins over all levels."""
    known = wage.filter(F.col("hour_earn").isNotNull())
    return crosstab(known, "province", "country", "hour_earn", provinces, countries)


def density_cells(
    wage: DataFrame, countries: Sequence[str] = TOP_COUNTRIES, provinces: Sequence[str] = TOP_PROVINCES
) -> DataFrame:
    """Mean density per thousand; cells are wage earners, margins everyone."""
    known = wage.filter(F.col("eth_dens_prov_1").isNotNull()).withColumn(
        "per_thousand", F.col("eth_dens_prov_1") * 10
    )
    margin = (F.col("province") == "Total") | (F.col("country") == "Total")
    earners = known.filter(F.col("hour_earn").isNotNull())
    cells = crosstab(earners, "province", "country", "per_thousand", provinces, countries)
    margins = crosstab(known, "province", "country", "per_thousand", provinces, countries)
    return cells.filter(~margin).unionByName(margins.filter(margin))


def wage_table(cells: DataFrame, countries: Sequence[str] = TOP_COUNTRIES) -> DataFrame:
    """``mean (n)`` text, one row per province."""
    return crosstab_text(cells, "province", "country", cell_text("mean", F.col("n")), countries)


def density_table(cells: DataFrame, countries: Sequence[str] = TOP_COUNTRIES) -> DataFrame:
    """``mean (sd)`` text, one row per province."""
    text = cell_text("mean", F.col("sd"), extra_digits=1)
    return crosstab_text(cells, "province", "country", text, countries)


def top_countries(wage: DataFrame, above: int = 300) -> DataFrame:
    return frequency_table(wage, "country", above)


def map_attributes(
    register_wide: DataFrame,
    regions: DataFrame,
    region_key: str,
    origins: Sequence[str],
    year: int = 2004,
) -> DataFrame:
    """Absolute and relative density of chosen origins onto a region table, long form."""
    long = melt_years(
        register_wide, ["Destination_mapSpain", "Origin"], "eth_dens_prov"
    )
    shares = share_of_total(long, "Destination_mapSpain", "Total", "eth_dens_prov", ["year", "Origin"])
    shares = shares.withColumn("log_eth_dens_prov_relative", safe_ln("eth_dens_prov_relative"))
    chosen = shares.filter(F.col("Origin").isin(list(origins)) & (F.col("year") == year))
    values = melt(
        chosen.select("Destination_mapSpain", "Origin", "eth_dens_prov", "eth_dens_prov_relative"),
        ["Destination_mapSpain", "Origin"],
    )
    return attach_attributes(regions, values, region_key, "Destination_mapSpain")


def municipality_table(
    sheet: DataFrame, regions: DataFrame | None = None, region_key: str = "LAU_CODE"
) -> DataFrame:
    """Municipality counts per origin: nested percentages, share of all, size class.

    Percentages cover every row of the sheet; the share and the size class
    leave out the national total row.
    """
    ids = ["PROVINCE_CODE", "MUNCIPALITY_CODE", "YEAR", "SEX"]
    counted = [c for c in sheet.columns if c not in ids]
    numbers = sheet.withColumns({c: F.col(c).try_cast("double") for c in counted})
    long = melt(numbers, ids, counted, "Origin", "Count")
    sized = size_percentages(long, "PROVINCE_CODE", ["YEAR", "SEX", "Origin"])
    places = sized.filter(drop_listed("PROVINCE_CODE", ["TOTAL"]))
    everyone = places.filter(F.col("Origin") == "Total").select(*ids, F.col("Count").alias("Count_Total"))
    shares = places.join(everyone, ids, "left").withColumns(
        {
            "percent_mun": safe_ratio("Count", "Count_Total") * 100,
            "MUV": size_class("Count"),
            "MUV_ind": split_at("Count"),
        }
    )
    shares = shares.withColumns(
        {
            "MUV_factor": relabel("MUV", dict(zip(SIZE_LABELS, SIZE_NAMES))),
            "MUV_rank": level_rank("MUV", SIZE_LABELS),
        }
    )
    if regions is None:
        return shares
    return attach_attributes(regions, shares, region_key, "MUNCIPALITY_CODE")


def influenced_share(df: DataFrame) -> DataFrame:
    """Percent influenced by arrival year and cohort, zero cells included."""
    rows = df.select(
        F.col("influenced").cast("int").alias("influenced"),
        F.col("arrival_spain_yr").cast("int").alias("arrival_spain_yr"),
        F.col("economic_final").alias("economic_plot"),
    )
    counts = contingency_table(
        rows,
        ["influenced", "arrival_spain_yr", "economic_plot"],
        {"influenced": [0, 1], "economic_plot": [False, True]},
    )
    shares = within_group_percent(counts, ["arrival_spain_yr", "economic_plot"], "freq", "prop")
    return shares.filter("influenced = 1").drop("freq")




def population_series(sheet: DataFrame, skip: Sequence[int] = (1960, 1965)) -> DataFrame:
    """Population counts in millions with the percent born abroad, long form."""
    long = melt(sheet, ["Year", "Proportion"], None, "Population", "Count")
    scaled = unit_scale(
        long, {"Count_1000000": ("Count", 1 / 1000000), "Percent": ("Proportion", 100.0)}
    )
    return scaled.filter(~is_true(F.col("Year").isin(list(skip))))
