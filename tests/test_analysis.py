"""Stages 2 and 3 on simulated people, and the file-level sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import analysis as A
from tessera.plans import models as M
from tessera.sources.fixed_width import load_codebook, read_survey
from tessera.sources.tables import checkpoint_table, read_table
from tessera.stats.linear import ols
from tests.fixtures import analysis


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    raw = analysis(spark).withColumn("mun_strata", F.when(F.col("IDQ") > "H00030", F.col("mun_strata")))
    return checkpoint_table(A.prepare(raw), str(tmp_path_factory.mktemp("people") / "t"))


@pytest.fixture(scope="module")
def wage(people, tmp_path_factory):
    return checkpoint_table(A.wage_population(people), str(tmp_path_factory.mktemp("wage") / "t"))


def test_both_prepare_modes(spark, people):
    raw = A.prepare(analysis(spark), with_imputation=False)
    assert raw.filter(~F.col("age").eqNullSafe(F.col("age_final"))).count() == 0
    counts = people.agg(*[F.count_if("complete_case_1").alias("a")]).head()
    assert raw.agg(F.count_if("complete_case_1")).head()[0] < counts["a"]


def test_imputation_row_by_row(people):
    rows = people.filter("economic_final").toPandas()
    fit = ols(people.filter("economic_final"), "age", [*A.BACKGROUND, "years", A.SEX, A.PERMIT, A.SECTOR])
    gaps = rows[rows.age.isna() & rows.years.notna()]
    assert len(gaps)
    for r in gaps.head(20).to_dict("records"):
        assert math.isclose(float(fit.design.row(r)[[fit.names.index(n) for n in fit.kept]] @ fit.beta), r["age_final"], rel_tol=1e-8)
        assert math.isclose(r["age_sq_final"], r["age_final"] ** 2)
    known = rows[rows.age.notna()]
    assert (known.age == known.age_final).all()


def test_populations_drop_small_groups_and_missing_strata(people, wage):
    rows = wage.toPandas()
    assert rows.province_strata.notna().all() and (rows.ANOM_floor >= 1998).all()
    base = people.filter("economic_final and complete_case_1 and ANOM_floor >= 1998").toPandas()
    big = base[base.groupby("country").country.transform("size") > 10]
    big = big[big.groupby("province_strata").province_strata.transform("size") > 11]
    assert sorted(rows.IDQ) == sorted(big.IDQ)
    split = A.populations(people)
    assert split.economic.count() + split.other.count() == people.count()
    assert split.search.filter("log_eth_dens_prov_2 is null").count() == 0


def test_selection_models_recover_simulated_effects(wage):
    models = {k: v for k, v in M.wage_models(relative=True).items() if k == "5"}
    fit = M.fit_wage_models(wage, models)["5"].outcome
    truth = {"log_eth_dens_prov_1_relative": 0.1, "sexFemale": -0.2, "years_final": 0.03}
    for name, value in truth.items():
        assert abs(fit.coefficients[name] - value) < 4 * fit.errors[name], name


def test_instruments_recover_the_density_effect(wage):
    found = M.fit_instruments(wage)
    b, e = found.fit.coefficients["log_eth_dens_prov_1"], found.fit.errors["log_eth_dens_prov_1"]
    assert abs(b + 0.3) < 4 * e
    biased = ols(wage, "log_hour_earn", ["log_eth_dens_prov_1", "log_eth_dens_prov_1_relative", "age_final", "years_final", A.SEX])
    assert biased.coefficients["log_eth_dens_prov_1"] > b
    assert all(f[0] > 10 for f in found.first_stage_f.values())


def test_two_stage_selection_runs_with_predictions(wage):
    stages, found = M.fit_two_stage(wage)
    assert set(stages) == {"log_eth_dens_prov_1_hat", "log_eth_dens_prov_1_relative_hat"}
    assert set(stages) <= set(found.outcome.coefficients)


def test_earnings_family_and_interaction(spark, people):
    fits = M.earnings_family(people, "log_hour_earn")
    assert list(fits) == [*map(str, range(1, 10))]
    rss = [fits[str(i)].summary["rss"] for i in range(1, 9) if fits[str(i)].n == fits["8"].n]
    assert all(a >= b - 1e-9 for a, b in zip(rss, rss[1:]))
    test = M.interaction_tests(spark, fits)["9"].head()
    assert 0 <= test["p_value"] <= 1
    grid = M.interaction_grid(spark, fits["9"], "sector2", "log_eth_dens_prov_1", [0.0, 1.0])
    assert grid.count() == 6
    report = M.wage_report(spark, {"1": fits["1"], "8": fits["8"]}).collect()
    assert [r.term for r in report[-5:]] == list(M.STATISTICS)


def test_sector_contrasts_are_centred(people):
    rows = people.filter("log_hour_earn is not null")
    fit = ols(rows, "log_hour_earn", [M.RAW_SECTOR])
    means = rows.groupBy("sector2").agg(F.avg("log_hour_earn")).toPandas().iloc[:, 1]
    assert math.isclose(fit.coefficients["(Intercept)"], means.mean(), rel_tol=1e-9)


def test_job_search_family(people):
    fits = M.search_family(people, names=["1", "4"])
    assert fits["4"].summary["log_likelihood"] >= fits["1"].summary["log_likelihood"]


def test_tables_of_the_study(people, wage):
    countries, provinces = ["C0", "C1"], ["P0", "P1"]
    cells = A.density_cells(people, countries, provinces)
    by = {(r.province, r.country): r for r in cells.collect()}
    known = people.filter("eth_dens_prov_1 is not null").toPandas()
    assert math.isclose(by["Total", "Total"].mean, (known.eth_dens_prov_1 * 10).mean(), rel_tol=1e-9)
    earners = known[known.hour_earn.notna() & (known.province == "P0") & (known.country == "C1")]
    assert by["P0", "C1"].n == len(earners)
    assert A.density_table(cells, countries).count() == 3
    share = A.influenced_share(people)
    assert share.filter("prop < 0 or prop > 100").count() == 0 and share.count() > 0
    tested = A.cohort_shares(people).filter("variable = 'sex'").collect()
    assert np.isclose(sum(r.percent_1 for r in tested), 100)


def test_survey_from_a_text_file_with_its_codebook(spark, tmp_path):
    book = spark.createDataFrame(
        [("AGE", "Age in years", "N", 3, 2, "Yes"), ("ID", "Person", "AN", 2, 1, "Yes"), ("SKIP", "Unused", "AN", 1, 3, None)],
        "name string, description string, type string, width int, position int, keep string",
    )
    (tmp_path / "survey.txt").write_text("A1 42x\nB2   y\nC3007z\n")
    df = read_survey(spark, str(tmp_path / "survey.txt"), load_codebook(book))
    assert sorted(map(tuple, df.collect()), key=str) == [("A1", 42.0), ("B2", None), ("C3", 7.0)]
    assert df.dtypes == [("ID", "string"), ("AGE", "double")]
    assert df.schema["AGE"].metadata["comment"] == "Age in years"


def test_csv_tables_stay_text(spark, tmp_path):
    path = str(tmp_path / "sheet.csv")
    with open(path, "w") as file:
        file.write("code,label,extra\n007,x,1\n")
    assert read_table(spark, path, ["code", "label"]).collect() == [("007", "x")]
    assert read_table(spark, path, schema="code int, label string, extra int").head()["code"] == 7


def test_stages_notice_another_input(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert checkpoint_table(spark.range(3), path).count() == 3
    assert checkpoint_table(spark.range(9), path).count() == 9
    assert checkpoint_table(spark.range(3).withColumn("y", F.lit(1)), path).columns == ["id", "y"]
