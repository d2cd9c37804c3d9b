"""Model lists of the wage, instrument and job-search analyses.

Specifications are data; nested lists grow by appending terms. The density
column of the plain regressions is a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.analysis import EDUCATION, EDUCATION_NUMBERS, PERMIT, SECTOR, SEX
from tessera.stats.design import Cat, Inter, Num
from tessera.stats.discrete import binary_family
from tessera.stats.fit import Fit
from tessera.stats.linear import InstrumentFit, iv, model_family, nested_test
from tessera.stats.report import coefficient_table, marginal_grid
from tessera.stats.selection import SelectionFit, heckman_family, iv_selection

def _some_studies_first(labels: Sequence[str]) -> tuple[str, ...]:
    """The uncoarsened labels in rank order, but with the unclear level as reference."""
    none, some, *rest = labels
    return (some, none, *rest)


RAW_EDUCATION = Cat("education", _some_studies_first(list(EDUCATION_NUMBERS)))

# The sectors of the earnings and search models, in their order.
RAW_SECTORS = (
    "Agriculture", "Business, commerce", "Construction", "Education", "Energy",
    "Extractive industries", "Extraterritorial organizations", "Financial intermediation", "Fishing",
    "Health and social services", "Hospitality", "Household activities", "Manufacturing",
    "Other social, community, personal services", "Public administration, defense",
    "Real estate; rental, business services", "Transportation, communications",
)
RAW_SECTOR = Cat("sector2", RAW_SECTORS, "centered")
SELECTION_TERMS = [SEX, Cat("country_class"), Num("woman_married_kids")]
SELECTION_BY_COUNTRY = [SEX, Cat("country"), Num("woman_married_kids")]
ABSOLUTE = [Num("eth_dens_prov_1")]
RELATIVE = [Num("log_eth_dens_prov_1"), Num("log_eth_dens_prov_1_relative")]
INSTRUMENTS = ["log_eth_dens_prov_1991", "log_eth_dens_prov_1991_relative"]
AGE = [Num("age_final"), Num("age_sq_final")]
WAGE_STEPS = [
    [], [SEX], [Num("years_final")], [EDUCATION], AGE, [SECTOR], [Cat("country")], [Cat("province_strata")],
]
STATISTICS = {
    "Observations": "n", "R2": "r_squared", "Adjusted R2": "adj_r_squared", "Residual error": "sigma", "F": "f_statistic",
}
CONTROLS = {
    "Sector controls": "^sector2", "Origin country controls": "^country", "Region controls": "^province",
}


def growing(start: Sequence, steps: Sequence[Sequence]) -> dict[str, list]:
    """Models 1..n, each adding one step's terms to the one before."""
    models, terms = {}, list(start)
    for i, step in enumerate(steps, start=1):
        terms = [*terms, *step]
        models[str(i)] = list(terms)
    return models


def wage_models(relative: bool = False) -> dict[str, tuple[list, list]]:
    """Eight selection models: (selection terms, outcome terms).

    The third model of absolute density selects on country, all others on
    the class of country.
    """
    outcome = growing(RELATIVE if relative else ABSOLUTE, WAGE_STEPS)
    return {
        name: (SELECTION_BY_COUNTRY if name == "3" and not relative else SELECTION_TERMS, terms)
        for name, terms in outcome.items()
    }


def fit_wage_models(
    wage: DataFrame, models: Mapping[str, tuple[list, list]], y: str = "log_hour_earn"
) -> dict[str, SelectionFit]:
    """Each model deletes rows by its own terms; all of them share every pass."""
    return heckman_family(wage, "wage_data", y, models)


def fit_instruments(wage: DataFrame, y: str = "log_hour_earn") -> InstrumentFit:
    """Absolute and relative density instrumented by their earlier census values."""
    exogenous = [
        EDUCATION, Num("years_final"), *AGE, SEX, SECTOR, Cat("country"), Cat("province_strata"),
    ]
    return iv(wage, y, [t.column for t in RELATIVE], exogenous, INSTRUMENTS)


def fit_two_stage(
    wage: DataFrame, y: str = "log_hour_earn"
) -> tuple[dict[str, Fit], SelectionFit]:
    """First-stage predictions of both densities as regressors of a selection model."""
    person = [EDUCATION, Num("years_final"), *AGE, SEX]
    first = [*map(Num, INSTRUMENTS), *person, Cat("country"), Cat("province_strata")]
    stages = {f"{t.column}_hat": (t.column, first) for t in RELATIVE}
    return iv_selection(
        wage, stages, "wage_data", SELECTION_TERMS, y, [*person, SECTOR, Cat("country")]
    )


def wage_report(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """Side-by-side table of person-level terms with control rows."""
    return coefficient_table(
        spark,
        fits,
        keep=["eth_dens", "sex", "years_final", "education_eng_class", "age_final", "age_sq_final"],
        omit=["sector2", "country", "province_strata"],
        controls=CONTROLS,
        statistics=STATISTICS,
    )


def plain_terms(density: str) -> dict[str, list]:
    """Eight nested regressor lists used for earnings and for the job search."""
    return growing(
        [Num(density)],
        [
            [],
            [Num("years"), RAW_EDUCATION],
            [Num("age"), Num("age_sq")],
            [SEX],
            [PERMIT],
            [RAW_SECTOR],
            [Cat("country_short")],
            [Cat("province")],
        ],
    )


def interactions(density: str) -> dict[str, Inter]:
    """Density interacted with sector, country and work permit."""
    return {
        "9": Inter(RAW_SECTOR, Num(density)),
        "10": Inter(Cat("country_short"), Num(density)),
        "11": Inter(PERMIT, Num(density)),
    }


def earnings_family(
    df: DataFrame, y: str, density: str = "log_eth_dens_prov_1", with_interactions: Sequence[str] = ("9",)
) -> dict[str, Fit]:
    """Full-time earners: eight nested models, then interactions added to the eighth."""
    rows = df.filter(F.col(y).isNotNull() & F.col(density).isNotNull() & (F.col("part_time") == 0))
    models = plain_terms(density)
    extra = interactions(density)
    for name in with_interactions:
        models[name] = [*models["8"], extra[name]]
    return model_family(rows, y, models)


def interaction_tests(spark: SparkSession, fits: Mapping[str, Fit]) -> dict[str, DataFrame]:
    """F tests of each interaction against the eighth model."""
    return {n: nested_test(spark, fits["8"], fits[n]) for n in ("9", "10", "11") if n in fits}


def interaction_grid(
    spark: SparkSession, fit: Fit, factor: str, density: str, at: Sequence[float]
) -> DataFrame:
    return marginal_grid(spark, fit, {factor: None, density: list(at)})


def search_family(
    df: DataFrame,
    y: str = "lt_search_1mo",
    density: str = "log_eth_dens_prov_1",
    names: Sequence[str] | None = None,
) -> dict[str, Fit]:
    """Logits of a quick first job among those without a contract on arrival."""
    rows = df.filter(
        F.col("TPO1").isNotNull() & (F.col("precontract") == 0) & F.col(density).isNotNull()
    )
    models = plain_terms(density)
    models["9"] = [*models["8"], interactions(density)["9"]]
    found = binary_family(rows, y, {n: models[n] for n in (names or models)}, "logit")
    return {n: f.fit for n, f in found.items()}
