"""Seeded survey-shaped inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.plans.survey import MOTIVES, PARTICIPATION_ITEMS, SUPPORT_ITEMS, References

PROVINCES = {"01": " Araba ", "02": "Madrid", "03": "Murcia ", "04": "Sevilla"}
COUNTRIES = {
    "108": ("España", "ESP", "España", "Yes", "Spain", "Yes"),
    "201": ("Reino Unido", "UK", "R. Unido", "Yes", "EU", "No"),
    "202": ("Ecuador", "ECU", "Ecuador", "No", "Latin America", "Yes"),
    "203": ("Marruecos", "MAR", "Marruecos", "No", "Africa", "No"),
}
YEARS = range(1998, 2008)


def _maybe(rng, values, n, missing=0.2):
    out = rng.choice(values, n).astype(object)
    out[rng.random(n) < missing] = None
    return out


def survey_pandas(n: int = 300, seed: int = 5) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    c: dict[str, object] = {"IDQ": [f"H{i:05d}" for i in range(n)]}
    size = rng.integers(1, 6, n)
    c["NPERS"] = size.astype(float)
    c["NPELEG"] = np.array([rng.integers(1, s + 1) for s in size]).astype(float)
    c["CPRO"] = rng.choice(list(PROVINCES), n)
    c["CCAA"] = rng.choice(["1", "2"], n)
    for m in range(1, 16):
        there = size >= m
        def num(values, there=there):
            return np.where(there, rng.choice(values, n), np.nan)
        c[f"EDAD{m:02d}"] = num([5, 14, 25, 40, 999])
        c[f"SEXO{m:02d}"] = num([1, 2])
        c[f"PNAC{m:02d}"] = np.where(there, rng.choice([*COUNTRIES, "999", "  "], n), "")
        c[f"ALLE{m:02d}"] = num([0, 1996, 1999, 2002, 2005])
        c[f"MLLE{m:02d}"] = num([0, 2, 5, 11])
        c[f"ANAC{m:02d}"] = num([0, 1960, 1975, 1985])
        c[f"NESP{m:02d}"] = num([0, 1, 6])
        c[f"DNAC{m:02d}"] = num([1, 6])
        c[f"ANE{m:02d}"] = num([1999, 2004])
        for h in range(1, 16):
            if h != m:
                both = there & (size >= h)
                c[f"P{m:02d}_{h:02d}"] = np.where(both, rng.choice([1, 5, 7, 11, 14], n), np.nan)
    for i in range(1, 5):
        c[f"PTRS{i:02d}"] = rng.choice(["108", "201", ""], n)
        for m in MOTIVES:
            c[f"{m}{i:02d}"] = _maybe(rng, [1.0, 6.0], n)
    for i in (1, 2, 3):
        c[f"OCUP{i}"] = rng.choice(["1", " 2 ", ""], n)
        c[f"CIOCUP{i}"] = rng.choice(["A", "B", " "], n)
        c[f"SECT{i}"] = rng.choice(["10", "20", " "], n)
        c[f"SITU{i}"] = _maybe(rng, ["1", "2"], n)
    for name, values in {
        "HORAS2": [20.0, 40.0, 45.0, 999.0], "INGRTR": [0.0, 1.0, 4.0, 9.0, 10.0],
        "INGRE": [800.0, 1200.0, 1500.0], "RECANT": [0.0, 500.0, 99999.0], "LMAT": [0.0, 101.0, 102.0],
        "TIPEST": [0.0, 1.0, 6.0], "TRAB1": [0.0, 1.0, 6.0], "TRAB2": [0.0, 1.0, 6.0],
        "TRANT": [0.0, 1.0, 6.0], "TRANTE": [1.0, 6.0], "TPO1": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
        "DOCUM": [0.0, 1.0, 3.0, 5.0], "NUMHH": [1.0, 3.0, 99.0], "TENHH": [0.0, 1.0, 6.0],
        "ANOCOM": [0.0, 1999.0, 2003.0], "NCONTR": [1.0, 99.0], "MESCOM": [0.0, 1.0, 8.0],
        "PRIMTR": [1.0, 6.0], "INFLU": [1.0, 6.0], "BUSEMP": [1.0, 6.0], "PROPTR": [0.0, 1.0, 6.0],
        "CBVIV": [1.0, 6.0], "PRVIV": [1.0, 2.0], "HAESP": [1.0, 2.0, 3.0, 4.0], "TENV": [1.0, 11.0, 14.0],
        "CONFAM": [1.0, 2.0, 6.0], "FORMNS": [1.0, 6.0],
    }.items():
        c[name] = _maybe(rng, values, n)
    c["MNIV"] = _maybe(rng, ["3", "4", "7"], n)
    c["PR1VI"] = rng.choice(["00", "02", "  ", "03"], n)
    c["MUV"] = rng.choice(["Alfa", " Beta", "Gamma", ""], n)
    for i in range(1, 5):
        c[f"PRV{i:02d}"] = rng.choice(["", "01", "02 "], n)
        c[f"MUV_{i:02d}"] = rng.choice(["", "Alfa", "Beta", "No Sabe"], n)
        c[f"MUV{i:02d}"] = rng.choice(["", "E1", "E2"], n)
        c[f"ANOM{i:02d}"] = _maybe(rng, [0.0, 1997.0, 2000.0, 2004.0], n)
    for i in range(1, 7):
        c[f"IDIO{i}"] = _maybe(rng, [101.0, 102.0, 103.0], n, 0.4)
        for p in ("COMP", "HABLA", "LEE", "ESCRI"):
            c[f"{p}{i}"] = _maybe(rng, [1.0, 6.0], n, 0.1)
    for i in range(1, 13):
        c[f"PRHE{i:02d}"] = rng.choice(["", "00", *PROVINCES], n)
        c[f"DVHE{i:02d}"] = _maybe(rng, [1.0, 2.0, 3.0], n)
        c[f"NOHE{i:02d}"] = _maybe(rng, [1.0], n, 0.5)
    for name in [*SUPPORT_ITEMS, *PARTICIPATION_ITEMS, *[f"FORM{i:02d}" for i in range(1, 7)]]:
        c[name] = _maybe(rng, [1.0, 6.0], n, 0.1)
    return pd.DataFrame(c)


def survey(spark, n: int = 300):
    pdf = survey_pandas(n)
    numbers = pdf.select_dtypes("object").columns
    for name in numbers:
        if any(isinstance(v, float) for v in pdf[name]):
            pdf[name] = pdf[name].astype(float)
    df = spark.createDataFrame(pdf)
    types = dict(df.dtypes)
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if types[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )


def _dim(spark, pairs, code="string"):
    return spark.createDataFrame(list(pairs.items()), f"code {code}, label string")


def register_rows():
    rng = np.random.default_rng(11)
    rows = []
    names = [v.strip() for v in PROVINCES.values()]
    for place in [*names, "Total"]:
        for origin in ["España", "Reino Unido", "Ecuador", "Marruecos", "TOTAL EXTRANJEROS"]:
            for sex in ("Male", "Female"):
                values = rng.choice([0.0, 0.5, 1.0, 2.5, 4.0], len(YEARS))
                rows.append((place, place, origin, sex, *map(float, values)))
    return rows


def references(spark) -> References:
    register = spark.createDataFrame(
        register_rows(),
        "Destination string, Destination_mapSpain string, Origin string, SEXO string, "
        + ", ".join(f"`{y}` double" for y in YEARS),
    )
    census = spark.createDataFrame(
        [("Madrid", 2.0, 4.0, 0.0), ("Murcia", 1.0, 3.0, 5.0), ("TOTAL", 4.0, 8.0, 5.0)],
        "Provincia string, UK double, ECU double, MAR double",
    )
    quarters = [f"{y}T{q}" for y in range(1996, 2007) for q in range(1, 5)]
    rates = [
        (p, p, s, *[".." if i == 3 else str(5.0 + i + k) for i in range(len(quarters))])
        for k, p in enumerate(["Madrid", "Murcia", "Sevilla"])
        for s in ("Male", "Female")
    ]
    unemployment = spark.createDataFrame(
        rates,
        "Province string, Destination_mapSpain string, Sex string, "
        + ", ".join(f"`{q}` string" for q in quarters),
    )
    country = spark.createDataFrame(
        [(k, *v) for k, v in COUNTRIES.items()],
        "code string, register_match string, census_match string, short string, eu string, "
        "grouping string, spanish_mother_tongue string",
    )
    return References(
        country=country,
        province=_dim(spark, PROVINCES),
        community=_dim(spark, {"1": "Norte ", "2": " Sur"}),
        language=_dim(spark, {101.0: "español", 102.0: "árabe"}, "double"),
        occupation=_dim(spark, {"1": "Directivos", "2": "Técnicos"}),
        occupation_detail=_dim(spark, {"A": "Alfa", "B": "Beta"}),
        sector=_dim(spark, {"10": "Agriculture", "20": "Construction"}),
        situation=_dim(spark, {"1": "Empresario", "2": "Asalariado"}),
        education=_dim(
            spark,
            {"3": "Primaria (completo)", "4": "Secudaria (primer ciclo)", "7": "Terciaria (segundo ciclo)"},
        ),
        register=register,
        census=census,
        unemployment=unemployment,
    )


def analysis_pandas(n: int = 2000, seed: int = 21) -> pd.DataFrame:
    """Person rows with known coefficients, selection rho 0.5, an endogenous regressor."""
    rng = np.random.default_rng(seed)
    countries = [f"C{i}" for i in range(8)]
    country = rng.choice(countries, n, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.06, 0.04])
    strata = rng.choice([f"P{i}E{j}" for i in range(4) for j in (1, 2)], n)
    sex = rng.choice(["Male", "Female"], n)
    age = rng.integers(20, 60, n).astype(float)
    years = rng.integers(0, 12, n).astype(float)
    z1, z2 = rng.normal(size=n), rng.normal(size=n)
    common = rng.normal(size=n)
    dens = 0.8 * z1 + common + rng.normal(size=n)
    rel = 0.7 * z2 + rng.normal(size=n)
    u = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], n)
    kids = rng.integers(0, 2, n)
    partner = rng.integers(0, 2, n)
    wmk = ((sex == "Female") & (kids > 0) & (partner == 1)).astype(int)
    selected = 0.4 + 0.5 * (sex == "Male") - 1.0 * wmk + 0.4 * np.isin(country, ["C0", "C2"]) + u[:, 0] > 0
    wage = (
        2 - 0.3 * dens + 0.1 * rel + 0.02 * age + 0.03 * years - 0.2 * (sex == "Female") + u[:, 1]
        + 0.5 * common
    )
    education = rng.choice(
        ["Sin estudios", "Primaria (completo)", "Secudaria (primer ciclo)", "Terciaria (segundo ciclo)"], n
    )
    return pd.DataFrame(
        {
            "IDQ": [f"H{i:05d}" for i in range(n)],
            "log_hour_earn": np.where(selected, wage, np.nan),
            "hour_earn": np.where(selected, np.exp(np.clip(wage, -5, 5)), np.nan),
            "eth_dens_prov_1": np.exp(dens / 3),
            "log_eth_dens_prov_1": dens,
            "log_eth_dens_prov_1_relative": rel,
            "log_eth_dens_prov_1991": z1,
            "log_eth_dens_prov_1991_relative": z2,
            "age": np.where(rng.random(n) < 0.03, np.nan, age),
            "age_sq": age**2,
            "years": np.where(rng.random(n) < 0.03, np.nan, years),
            "weekly_hours": np.where(rng.random(n) < 0.1, np.nan, 30 + 0.2 * age + rng.normal(size=n)),
            "month_earn": np.where(selected, 1000.0, np.nan),
            "sex": sex,
            "country": country,
            "country_1991": country,
            "country_short": country,
            "country_class": np.where(np.isin(country, ["C0", "C2", "C4"]), "Developing", "Other"),
            "education": education,
            "sector2": rng.choice(["Agriculture", "Construction", "Hospitality"], n),
            "work_permit": rng.choice(["Yes", "No"], n),
            "province": [s[:2] for s in strata],
            "mun_strata": [s[2:] for s in strata],
            "comunidad": [s[:2] for s in strata],
            "municipality": strata,
            "dependents": kids,
            "partner_convive": partner,
            "economic": rng.choice([1.0, 0.0], n, p=[0.8, 0.2]),
            "quality": rng.choice([1.0, 0.0], n),
            "working": rng.choice([1.0, 0.0], n),
            "spanish": rng.choice(["Bien", "Nativo"], n),
            "ANOM_floor": rng.choice([1990.0, 2000.0, 2004.0], n, p=[0.1, 0.4, 0.5]),
            "part_time": rng.choice([0, 1], n, p=[0.8, 0.2]),
            "TPO1": rng.choice([1.0, 2.0, 3.0, 4.0], n),
            "precontract": rng.choice([0.0, 1.0], n, p=[0.8, 0.2]),
            "first_job_still": rng.choice([0.0, 1.0], n),
            "lt_search_1mo": rng.choice([0, 1], n),
            "lt_search_3mo": rng.choice([0, 1], n),
            "years_job_search": years,
            "age_job_search": age,
            "age_job_search_sq": age**2,
            "had_worked": rng.choice([0, 1], n),
            "sector1": rng.choice(["Agriculture", "Construction"], n),
            "occupation1": rng.choice(["a", "b"], n),
            "tasa_paro_first_job": rng.normal(10, 1, n),
            "province_job_search": [s[:2] for s in strata],
            "log_eth_dens_prov_2": np.where(rng.random(n) < 0.1, np.nan, dens),
            "influenced": np.where(rng.random(n) < 0.1, np.nan, rng.choice([0.0, 1.0], n)),
            "arrival_spain_yr": rng.choice([1999.0, 2001.0, 2004.0], n),
        }
    )


def analysis(spark, n: int = 2000):
    df = spark.createDataFrame(analysis_pandas(n))
    types = dict(df.dtypes)
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if types[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )
