"""The raw-to-person derivation against a row-by-row reading of the same rules."""

import datetime
import math

import pandas as pd
import pytest

from tests.fixtures import COUNTRIES, PROVINCES, references, register_rows, survey
from tessera.plans import survey as plan

REGISTER = {
    (r[0], r[2].replace(" ", "."), r[3], y): v
    for r in register_rows()
    for y, v in zip(range(1998, 2008), r[4:])
}


@pytest.fixture(scope="module")
def people(spark):
    raw = survey(spark)
    done = plan.process(raw, references(spark))
    before = {r["IDQ"]: r.asDict() for r in raw.collect()}
    after = {r["IDQ"]: r.asDict() for r in done.collect()}
    return before, after


def known(v):
    return v is not None and not (isinstance(v, float) and math.isnan(v))


def number(row, prefix, i):
    return row.get(f"{prefix}{i:02d}")


def test_row_count_is_kept(people):
    before, after = people
    assert len(before) == len(after) == 300


def test_reference_person(people):
    before, after = people
    for k, raw in before.items():
        n = int(raw["NPELEG"])
        age = number(raw, "EDAD", n)
        assert after[k]["age"] == (None if age == 999 else age)
        assert after[k]["sex"] == {1.0: "Male", 2.0: "Female"}[number(raw, "SEXO", n)]
        code = number(raw, "PNAC", n).strip() or None
        assert after[k]["PNAC"] == code
        labels = COUNTRIES.get(code)
        assert after[k]["country"] == (labels[0].replace(" ", ".") if labels else None)
        assert after[k]["country_class"] == (labels[4] if labels else None)


def test_move_to_spain(people):
    before, after = people
    seen = set()
    for k, raw in before.items():
        hits = [i for i in range(1, 5) if raw[f"PTRS{i:02d}"] == "108"]
        seen.add(len(hits))
        assert after[k]["motive_var"] == (f"{hits[-1]:02d}" if hits else None)
        for m in ("DSLA", "JUB"):
            v = raw[f"{m}{hits[-1]:02d}"] if hits else None
            assert after[k][m] == (None if v is None else {1.0: 1, 6.0: 0}[v])
        flags = [after[k][m] for m in ("DSLA", "FEMP", "BEMP")]
        expected = None if None in flags else int(sum(flags) > 0)
        assert after[k]["economic"] == expected
    assert {0, 2} <= seen


def test_housemates(people):
    before, after = people
    for k, raw in before.items():
        n = int(raw["NPELEG"])
        counts = dict.fromkeys(("mates", "dep", "sp", "pc", "sib"), 0)
        for h in range(1, 16):
            relation = raw.get(f"P{n:02d}_{h:02d}") if h != n else None
            country = raw[f"PNAC{h:02d}"] if h != n else None
            age = raw[f"EDAD{h:02d}"] if h != n else None
            assert after[k].get(f"compi_relation{h:02d}") == relation
            if relation is None:
                continue
            counts["mates"] += relation in (11, 14) and country == "108"
            counts["dep"] += relation == 5 and age is not None and age < 16
            counts["sp"] += relation == 1 and country == "108"
            counts["pc"] += relation == 1
            counts["sib"] += relation == 7
        alone = raw["NPERS"] <= 1
        assert after[k]["spanish_housemates"] == (None if alone else counts["mates"])
        assert after[k]["dependents"] == (None if alone else counts["dep"])
        assert after[k]["spanish_partner"] == counts["sp"]
        assert after[k]["partner_convive"] == counts["pc"]
        assert after[k]["HH_convive"] == counts["sib"]


def test_siblings(people):
    before, after = people
    for k, raw in before.items():
        homes = [PROVINCES[c].strip() if c not in ("", "00") else None for c in (raw[f"PRHE{i:02d}"] for i in range(1, 13))]
        where = [raw[f"DVHE{i:02d}"] for i in range(1, 13)]
        assert [after[k][f"HH_province{i}"] for i in range(1, 13)] == homes
        assert after[k]["HH_mismo_mun"] == where.count(1.0)
        assert after[k]["HH_en_espana"] == where.count(1.0) + where.count(2.0)
        here = PROVINCES[raw["CPRO"]].strip()
        assert after[k]["HH_mismo_prov"] == homes.count(here) + where.count(1.0)
        assert after[k]["HH_no_convive"] == sum(known(raw[f"NOHE{i:02d}"]) for i in range(1, 13))


def test_language(people):
    before, after = people
    seen = set()
    for k, raw in before.items():
        language = {101.0: "español", 102.0: "árabe"}.get(raw["LMAT"])
        items = [None] * 4
        for i in range(1, 7):
            if raw[f"IDIO{i}"] == 101:
                items = [raw[f"{p}{i}"] for p in ("COMP", "HABLA", "LEE", "ESCRI")]
        score = None if None in items else sum(v == 1 for v in items)
        report = raw["HAESP"]
        if language is None:
            expected = None
        elif language == "español":
            expected = "Nativo"
        elif report in (1, 2):
            expected = "Bien"
        elif score is None:
            expected = None
        elif score >= 3:
            expected = "Bien"
        elif report == 3 or score == 2:
            expected = "Suficiente"
        elif report is None:
            expected = None
        else:
            expected = "Necesita mejorar" if report == 4 or score < 2 else None
        seen.add(expected)
        assert after[k]["spanish"] == expected, k
    assert len(seen) == 5


def test_residence(people):
    before, after = people
    for k, raw in before.items():
        provinces = {raw[f"PRV{i:02d}"].strip() for i in range(1, 5)} - {""}
        towns = {raw[f"MUV_{i:02d}"].strip() for i in range(1, 5)} - {""}
        assert after[k]["has_moved_province"] == int(len(provinces) > 1)
        assert after[k]["has_moved_mun"] == int(len(towns) > 1)
        starts = [v for v in (raw[f"ANOM{i:02d}"] for i in range(1, 5)) if v]
        assert after[k]["ANOM"] == (starts[-1] if starts else None)
        floor = after[k]["ANOM_floor"]
        arrival = after[k]["ALLE"]
        if starts:
            assert floor == starts[-1]
        elif raw["CBVIV"] == 6 or raw["PRVIV"] == 1:
            assert floor == arrival
        elif raw["CBVIV"] is None or raw["PRVIV"] is None:
            assert floor is None
        else:
            assert floor == (arrival if len(provinces) <= 1 else None)
        assert after[k]["ANOM_ceiling"] == (None if floor is None else max(floor, 1998))
        assert after[k]["ANOM_iv"] == (None if floor is None else max(max(floor, 1998) - 3, 1998))


def test_municipality_stratum_last_row_wins(people):
    before, after = people
    lookup = {}
    for k in sorted(before):
        town = before[k]["MUV_01"].strip()
        if town and town != "No Sabe":
            lookup[town] = before[k]["MUV01"].strip() or None
    for k, raw in before.items():
        assert after[k]["mun_estrato"] == lookup.get(raw["MUV"].strip())


def test_job_search(people):
    before, after = people
    months = {1: 0, 2: 1, 3: 3, 4: 12, 5: 24, 6: 36}
    hits = 0
    for k, raw in before.items():
        year, month, code = raw["ANOCOM"] or None, raw["MESCOM"] or None, raw["TPO1"] or None
        if raw["PRIMTR"] != 1 or year is None or code is None:
            assert after[k]["job_search_start_dt"] is None
            continue
        hits += 1
        start = int(year) * 12 + int(month or 6) - 1 - months[int(code)]
        date = datetime.date(start // 12, start % 12 + 1, 1)
        assert after[k]["job_search_start_dt"] == date
        label = f"{date.year}T{(date.month - 1) // 3 + 1}" if month else str(date.year)
        assert after[k]["job_search_start_yr_qt"] == label
        first = raw["ANOM01"] or None
        if first is None:
            assert after[k]["prv_num"] is None
            continue
        reached = sum(1 for i in range(1, 5) if raw[f"ANOM{i:02d}"] and date.year >= raw[f"ANOM{i:02d}"])
        slot = max(reached, 1)
        assert after[k]["prv_num"] == slot
        code = raw[f"PRV{slot:02d}"].strip()
        assert after[k]["province_job_search"] == (PROVINCES[code].strip() if code else None)
    assert hits > 20


def test_register_values(people):
    _, after = people
    hits = 0
    for row in after.values():
        key = (row["province"], row["country"], row["sex"])
        for year, out in ((row["ANOM_ceiling"], "eth_dens_prov_1"), (row["ANOM_iv"], "eth_dens_prov_iv_3yr")):
            expected = REGISTER.get((*key, int(year))) if year else None
            assert row[out] == expected
            hits += expected is not None
        for year in (1998, 2003, 2006, 2007):
            assert row[f"eth_dens_prov_{year}"] == REGISTER.get((*key, year))
        total = REGISTER.get(("Total", row["country"], row["sex"], 2007))
        mine = REGISTER.get((*key, 2007))
        relative = mine / total if mine is not None and total else None
        assert row["eth_dens_prov_2007_relative"] == (pytest.approx(relative) if relative is not None else None)
        assert row["eth_dens_prov_all_imm_1998"] == REGISTER.get(
            (row["province"], "TOTAL.EXTRANJEROS", row["sex"], 1998)
        )
        change = row["eth_dens_change_1998_2007"]
        if row["eth_dens_prov_1998"] is not None:
            assert change == pytest.approx(mine - row["eth_dens_prov_1998"])
            log = row["log_eth_dens_change_1998_2007"]
            assert log == (pytest.approx(math.log(change)) if change > 0 else None)
    assert hits > 100


def test_census_and_unemployment(people):
    _, after = people
    census = {"Madrid": {"UK": 2.0, "ECU": 4.0, "MAR": 0.0}, "Murcia": {"UK": 1.0, "ECU": 3.0, "MAR": 5.0}}
    total = {"UK": 4.0, "ECU": 8.0, "MAR": 5.0}
    quarters = [f"{y}T{q}" for y in range(1996, 2007) for q in range(1, 5)]
    fallback = 0
    for row in after.values():
        value = census.get(row["province"], {}).get(row["country_1991"])
        assert row["eth_dens_prov_1991"] == value
        if value is not None:
            assert row["eth_dens_prov_1991_relative"] == pytest.approx(value / total[row["country_1991"]])
        place = {"Madrid": 0, "Murcia": 1, "Sevilla": 2}.get(row["province"])
        period = row["arrival_spain_dt"]
        if place is None or period is None:
            assert row["tasa_paro_arrival"] is None
            continue
        rates = {q: (None if i == 3 else 5.0 + i + place) for i, q in enumerate(quarters)}
        if "T" in period:
            assert row["tasa_paro_arrival"] == rates.get(period)
        else:
            fallback += 1
            year = [v for q, v in rates.items() if q.startswith(period) and v is not None]
            assert row["tasa_paro_arrival"] == pytest.approx(sum(year) / len(year))
    assert fallback > 5


def test_work_and_social_items(people):
    before, after = people
    for k, raw in before.items():
        row = after[k]
        flags = [f"FORM{i:02d}" for i in range(1, 7)] + ["FORMNS"]
        label = "".join(f for f in [c for c in raw if c in flags] if raw[f] == 1) or None
        assert row["form"] == label
        assert row["form_any_friends"] == ("FORM04" if label and "FORM04" in label else label)
        expected = None if label is None or "FORMNS" in label else int(label == "FORM04")
        assert row["networked"] == expected
        trab1, trant = raw["TRAB1"] or None, raw["TRANT"] or None
        if row["sector1"] is not None or trab1 == 1 or trant == 1:
            assert row["had_worked"] == 1
        elif trab1 is None or trant is None:
            assert row["had_worked"] is None
        else:
            assert row["had_worked"] == 0
        income = raw["INGRE"]
        bracket = {1.0: 125, 4.0: 1250, 9.0: 10000}.get(raw["INGRTR"])
        assert row["month_earn_est"] == (income if income is not None else bracket)
        hours = None if raw["HORAS2"] in (None, 999) else raw["HORAS2"]
        assert row["part_time"] == (None if hours is None else int(hours < 30))
        pay = None if income is None or hours is None else income / (hours * 4)
        assert row["hour_earn"] == (None if pay is None else pytest.approx(pay))
        support = [raw[c] for c in ("LLFAM", "LLAMIG", "LLCONO")]
        index = None if raw["LLCONT"] is None else sum(v == 1 for v in support)
        assert row["support_index"] == index
        parts = [raw[c] for c in plan.PARTICIPATION_ITEMS]
        assert row["participation_index"] == (None if None in parts else sum(v == 1 for v in parts))
        assert row["CONFAM"] == {1.0: 1, 6.0: 0}.get(raw["CONFAM"])
        assert row["precontract"] == {1.0: 1, 6.0: 0}.get(raw["PROPTR"])


def test_subset_lists_each_column_once(spark):
    done = plan.subset(plan.process(survey(spark, 20), references(spark)))
    assert len(done.columns) == len(set(done.columns))
    assert done.columns[:2] == ["IDQ", "NPERS"]
    assert isinstance(done.limit(1).toPandas(), pd.DataFrame)
