"""Ranges of sheets, audited joins, slots, file order, crosswalks, stages with an owner."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_size, decode_audited, decode_slots, fill_from_rows, map_panel
from tessera.sources.ranges import column_numbers, numbered_lines, read_range
from tessera.sources.stages import Stage, StageOwner, owned_stages
from tessera.sources.tables import shared_folder, source_order, stage_derived
from tessera.stats.absorb import components, ols_absorbed
from tessera.stats.linear import iv, ols, robust_iv
from tessera.stats.design import Cat, Num


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "100")
    yield
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def sheet(path, title, rows):
    path.write_text(f"{title}\n\nkey,name,\"a, b\",v\n" + "".join(f"{i},n{i},\"x, {i}\",{i / 2}\n" for i in range(rows)) + "\nsource: a note, and more\n")


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    for f, rows in (("a.csv", 400), ("b.csv", 3)):
        sheet(tmp_path / f, "Title", rows)
    lines = numbered_lines(spark, str(tmp_path))
    found = {(os.path.basename(r.file), r.line): r.value for r in lines.collect()}
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    for f in ("a.csv", "b.csv"):
        for i, text in enumerate((tmp_path / f).read_text().split("\n")[:-1], 1):
            assert found.pop((f, i)) == text
    assert not found


def test_ranges_by_row_and_column(spark, tmp_path, small_splits):
    path = str(tmp_path / "a.csv")
    sheet(tmp_path / "a.csv", "Title", 200)
    found = read_range(spark, path, header_row=3, columns="B:C", until_blank=True)
    assert found.columns == ["name", "a, b"] and sorted(map(tuple, found.collect())) == sorted((f"n{i}", f"x, {i}") for i in range(200))
    part = read_range(spark, path, header_row=3, first_row=6, last_row=7, columns=[4, 1])
    assert sorted(map(tuple, part.collect())) == [("1.0", "2"), ("1.5", "3")]
    named = read_range(spark, path, header_row=None, first_row=4, last_row=4, names=["p", "q", "r", "s"])
    assert [r.asDict() for r in named.collect()] == [{"p": "0", "q": "n0", "r": "x, 0", "s": "0.0"}]
    short = tmp_path / "short.csv"
    short.write_text("x,y\n1\n\n2,3\n")
    assert sorted(map(tuple, read_range(spark, str(short)).collect())) == [("1", None), ("2", "3")]
    with pytest.raises(ValueError):
        read_range(spark, path, header_row=999)
    with pytest.raises(ValueError):
        read_range(spark, path, header_row=3, columns="C:F")
    assert column_numbers("aa", 30) == [27]


def test_an_audited_join_reads_each_side_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(100)], "id int, code int")
    rows.write.parquet(str(tmp_path / "rows"))
    dim = spark.createDataFrame([(i, f"l{i}") for i in (1, 2, 3, 3)], "code int, label string")
    decoded, audit = decode_audited(spark.read.parquet(str(tmp_path / "rows")), dim, "code", {"label": "out"})
    assert decoded._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    out = decoded.collect()
    codes = [r.code for r in rows.collect()]
    threes = codes.count(3)
    assert audit.counts() == {
        "rows_in": 100, "dim_rows": 4, "rows_out": 100 + threes, "null_codes": 20,
        "unknown_codes": sum(c is not None and c not in (1, 2, 3) for c in codes), "added_rows": threes,
    }
    assert decoded.columns == ["id", "code", "out"] and len(out) == 100 + threes


def test_slots_meet_a_large_dimension_in_one_join(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "k", *[None if v == 0 else int(v) for v in rng.integers(0, 40, 6)]) for i in range(300)] + [(None, "z", 1, None, None, None, None, 2)]
    names = [f"s{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "id int, part string, " + ", ".join(f"{n} int" for n in names))
    dim = spark.createDataFrame([(i, f"label {i}") for i in range(1, 36)], "code int, label string")
    columns = {n: f"{n}_label" for n in names}
    small = decode_slots(df, dim, columns, key=["id", "part"])
    large = decode_slots(df, dim, columns, key=["id", "part"], large=True)
    assert large.columns == small.columns and sorted(map(str, large.collect())) == sorted(map(str, small.collect()))
    assert large._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Join") == 6
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert not broadcast_size(stage_derived(dim))
        chosen = decode_slots(df, dim, columns, key=["id", "part"])
        assert chosen._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        decode_slots(df, dim, columns, large=True)


def test_the_last_row_of_the_files_wins(spark, tmp_path):
    path = str(tmp_path / "rows")
    for part in range(3):
        data = [(f"k{i % 4}", part * 100 + (7 * i) % 30) for i in range(30)]
        spark.createDataFrame(data, "key string, value int").coalesce(1).write.parquet(f"{path}/p={part}")
    rows = spark.read.option("basePath", path).parquet(path).select("key", "value", source_order().alias("o"))
    shuffled = rows.repartition(7, "value")
    last = {}
    for part in range(3):
        for i in range(30):
            last[f"k{i % 4}"] = part * 100 + (7 * i) % 30
    filled = fill_from_rows(shuffled, "key", "key", "value", "out", order=F.col("o"))
    assert {r.key: r.out for r in filled.collect()} == last


def test_crosswalks_keep_totals(spark):
    panel = spark.createDataFrame([("p", "a", 10.0), ("p", "b", 4.0), ("q", "a", 2.0), ("q", "gone", 9.0)], "place string, g string, v double")
    walk = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75), ("b", "x", 1.0)], "old string, new string, w double")
    found = {(r.place, r.g): r.v for r in map_panel(panel, walk, "g", "old", "new", "w", ["place"], ["v"]).collect()}
    assert found == {("p", "x"): 6.5, ("p", "y"): 7.5, ("q", "x"): 0.5, ("q", "y"): 1.5}


def test_stages_are_reused_until_the_input_changes(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "stage")
    spark.range(5).write.parquet(source)
    stage = Stage(spark, path)
    assert stage.table(spark.read.parquet(source)).count() == 5 and len(stage.versions()) == 1
    assert stage.table(spark.read.parquet(source)).count() == 5 and len(stage.versions()) == 1
    spark.range(5, 8).write.mode("append").parquet(source)
    changed = stage.table(spark.read.parquet(source))
    assert changed.count() == 8 and len(stage.versions()) == 2
    assert stage.table(spark.read.parquet(source).filter("id > 5")).count() == 2
    stage.prune()
    assert len(stage.versions()) == 1 and stage.stored().count() == 2


def test_a_reader_keeps_its_version_during_a_refresh(spark, tmp_path):
    stage = Stage(spark, str(tmp_path / "stage"))
    reader = stage.table(spark.range(4))
    fresh = stage.table(spark.range(4), refresh=True)
    assert reader.count() == fresh.count() == 4 and len(stage.versions()) == 2
    os.makedirs(tmp_path / "stage" / "v-unfinished")
    assert stage.stored().count() == 4
    stage.prune()
    assert len(stage.versions()) == 1 and fresh.count() == 4


def test_an_owner_leaves_nothing_behind(spark, tmp_path):
    folder = tmp_path / "work"
    with StageOwner(spark, str(folder)) as stages:
        assert stages.table("a", spark.range(2)).count() == 2
        assert stages.table("b", spark.range(3).withColumn("half", F.col("id") % 2), partition_by=["half"]).count() == 3
        assert sorted(os.listdir(folder)) == ["a", "b"]
    assert os.listdir(folder) == []


def derived(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("tessera-derived-")} if os.path.isdir(folder) else set()


def test_fits_remove_what_they_staged(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), "ab"[i % 2]) for i in range(50)], "y double, x double, g string")
    before = derived(spark)
    ols(df, "y", ["x", Cat("g")])
    ols_absorbed(df, "y", ["x"], ["g"])
    assert derived(spark) == before
    with owned_stages(spark):
        assert stage_derived(df).count() == 50 and len(derived(spark)) == len(before) + 1
    assert derived(spark) == before


def test_absorbed_factors_equal_dummies(spark):
    rng = np.random.default_rng(5)
    n = 3000
    g, h = rng.integers(0, 40, n), rng.integers(0, 25, n)
    block = rng.integers(0, 2, n)  # two separate blocks of levels
    g, h = g + 100 * block, h + 100 * block
    x, z = rng.normal(size=n) + 0.01 * g, rng.normal(size=n)
    y = 2 * x - z + np.sin(g) + np.cos(h) + rng.normal(size=n)
    df = spark.createDataFrame([(int(a), f"h{b}", *map(float, r)) for a, b, *r in zip(g, h, x, z, y)], "g int, h string, x double, z double, y double")
    dummies = np.column_stack([*[g == v for v in np.unique(g)], *[h == v for v in np.unique(h)]]).astype(float)
    full = np.column_stack([x, z, dummies])
    rank = np.linalg.matrix_rank(full)
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    rss = ((y - full @ beta) ** 2).sum()
    fit = ols_absorbed(df, "y", ["x", "z"], ["g", "h"])
    assert fit.df_residual == n - rank and fit.summary["absorbed"] == rank - 2
    np.testing.assert_allclose(fit.beta, beta[:2], rtol=1e-7)
    np.testing.assert_allclose(fit.summary["rss"], rss, rtol=1e-9)
    free = np.column_stack([x, z]) - dummies @ np.linalg.lstsq(dummies, np.column_stack([x, z]), rcond=None)[0]
    np.testing.assert_allclose(fit.vcov, rss / (n - rank) * np.linalg.inv(free.T @ free), rtol=1e-7)
    assert components(df, "g", "h") == 2
    one = ols_absorbed(df.withColumn("by_g", F.col("g") * 2.0), "y", ["x", "by_g"], ["g"])
    assert one.kept == ["x"] and one.names == ["x", "by_g"]
    dense = ols(df, "y", [Num("x"), Cat("g")])
    np.testing.assert_allclose(one.beta[0], dense.coefficients["x"], rtol=1e-8)
    np.testing.assert_allclose(one.errors["x"], dense.errors["x"], rtol=1e-8)


def test_a_hundred_thousand_levels(spark):
    rows = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), F.rand(3).alias("x"), F.rand(4).alias("e"))
    rows = rows.withColumn("y", F.col("g") % 17 + 3 * F.col("x") + 0.1 * F.col("e"))
    fit = ols_absorbed(rows, "y", ["x"], ["g"])
    assert fit.df_residual == 199_999 and abs(fit.coefficients["x"] - 3) < 0.001


def test_robust_instruments(spark):
    rng = np.random.default_rng(2)
    n = 900
    z, v, w = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    u = rng.normal(size=n) * (1 + 0.5 * np.abs(z))
    x = 0.8 * z + 0.4 * v + 0.7 * u + rng.normal(size=n)
    y = 1 + 0.5 * x + 0.3 * w + u
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, v, w)], "x double, y double, z double, v double, w double")
    found = robust_iv(df, iv(df, "y", ["x"], [Num("w")], ["z", "v"]))
    one = np.ones(n)
    inst, reg = np.column_stack([one, w, z, v]), np.column_stack([one, w, x])
    first = np.linalg.lstsq(inst, reg, rcond=None)[0]
    hat = inst @ first
    beta = np.linalg.lstsq(hat, y, rcond=None)[0]
    e = y - reg @ beta
    bread = np.linalg.inv(hat.T @ hat)
    np.testing.assert_allclose(found.fit.beta, beta, rtol=1e-8)
    np.testing.assert_allclose(found.fit.vcov, n / (n - 3) * bread @ (hat.T * e**2) @ hat @ bread, rtol=1e-7)
    left = x - inst @ first[:, 2]
    zb = np.linalg.inv(inst.T @ inst)
    spread = n / (n - 4) * zb @ (inst.T * left**2) @ inst @ zb
    pi = first[2:, 2]
    np.testing.assert_allclose(found.first_stage_f["x"], (pi @ np.linalg.solve(spread[2:, 2:], pi) / 2, 2, n - 4), rtol=1e-7)
    ze = inst.T @ e
    np.testing.assert_allclose(found.sargan, (ze @ zb @ ze / (e @ e / n), 1), rtol=1e-7)
    weight = np.linalg.inv((inst.T * e**2) @ inst)
    zx = inst.T @ reg
    gmm = np.linalg.solve(zx.T @ weight @ zx, zx.T @ weight @ inst.T @ y)
    m = inst.T @ (y - reg @ gmm)
    np.testing.assert_allclose(found.hansen, (m @ weight @ m, 1), rtol=1e-6)
    rows = {r.test: r for r in found.diagnostics(spark).collect()}
    assert rows["Sargan"].df2 is None and 0 <= rows["Hansen J"].p_value <= 1 and rows["robust first stage (x)"].p_value < 1e-6
