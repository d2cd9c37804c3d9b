"""Missing-value rules, scalars and slot operators, one case per rule."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import pvalues as P
from tessera.functions import scalars as X
from tessera.functions import semantics as S
from tessera.functions import slots as C


def values(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_unknown_condition_gives_unknown(spark):
    out = values(spark, [(1,), (0,), (None,)], "a int", S.r_ifelse(F.col("a") == 1, "y", "n"))
    assert out == [("y",), ("n",), (None,)]


def test_membership_is_false_for_missing(spark):
    out = values(spark, [(1,), (2,), (None,)], "a int", S.member_of("a", [1]))
    assert out == [(True,), (False,), (False,)]


def test_sentinels_and_blanks(spark):
    out = values(
        spark,
        [(999, " x "), (0, "00"), (5, "   "), (None, None)],
        "a int, t string",
        S.null_if("a", [999, 0]),
        S.blank_to_null("t", also=["00"]),
    )
    assert out == [(None, "x"), (None, None), (5, None), (None, None)]


def test_recode_passes_unmapped_and_maps_to_null(spark):
    out = values(spark, [(1,), (6,), (2,), (9,), (None,)], "a int", S.recode("a", {1: 1, 6: 0, 2: None}))
    assert out == [(1,), (0,), (None,), (9,), (None,)]


def test_logs_ratios_casts(spark):
    rows = [(0.0, "12"), (-1.0, ""), (2.0, " 7 "), (None, "x")]
    out = values(
        spark, rows, "a double, t string", S.safe_ln("a").isNull(), S.safe_ratio(F.lit(1.0), "a"), S.to_number("t")
    )
    assert out == [(True, None, 12.0), (True, -1.0, None), (False, 0.5, 7.0), (True, None, None)]


def test_concat_is_null_when_a_part_is(spark):
    assert values(spark, [("a", None)], "a string, b string", F.concat("a", "b")) == [(None,)]


def test_row_sums(spark):
    out = values(
        spark, [(1, None), (1, 2)], "a int, b int", S.row_sum(["a", "b"]), S.row_sum_strict(["a", "b"])
    )
    assert out == [(1, None), (3, 3)]


def test_clamp_keeps_null(spark):
    assert values(spark, [(1,), (5,), (None,)], "a int", S.clamp_min("a", 3)) == [(3,), (5,), (None,)]


def test_size_classes(spark):
    rows = [(0.0,), (10000.0,), (10001.0,), (20001.0,), (50001.0,), (50000.5,), (1.5,), (-1.0,), (None,)]
    out = [r[0] for r in values(spark, rows, "n double", X.size_class("n"))]
    assert out == ["E1", "E1", "E2", "E3", "E4", "E4", "E9", "E9", None]


def test_month_arithmetic(spark):
    rows = [(2003, None, 1), (2003, 3, 36), (None, 3, 1), (2004, 2, None)]
    out = values(
        spark, rows, "y int, m int, b int", X.month_start("y", "m"), X.minus_months(X.month_start("y", "m"), "b")
    )
    d = datetime.date
    assert out == [
        (d(2003, 6, 1), d(2003, 5, 1)),
        (d(2003, 3, 1), d(2000, 3, 1)),
        (None, None),
        (d(2004, 2, 1), None),
    ]
    end = spark.createDataFrame([(d(2004, 3, 31),)], "d date")
    assert end.select(X.minus_months("d", F.lit(1))).first()[0] == d(2004, 2, 29)


def test_quarters_and_years(spark):
    out = values(spark, [(1.0,), (12.0,), (None,), (13.0,)], "m double", X.quarter_label("m"))
    assert out == [("T1",), ("T4",), ("",), ("",)]
    out = values(spark, [(2000,), (2009,), (None,)], "y int", X.years_since("y", 2006))
    assert out == [(6,), (0,), (None,)]


def test_signif(spark):
    out = values(spark, [(0.012345,), (98765.0,), (0.0,), (-0.5,)], "v double", X.signif("v", 3))
    assert [r[0] for r in out] == pytest.approx([0.0123, 98800.0, 0.0, -0.5])


def test_rounding_half_cases(spark):
    out = values(spark, [(2.5,), (-2.5,)], "v double", F.round("v"), F.bround("v"))
    assert out == [(3.0, 2.0), (-3.0, -2.0)]


def test_pick_by_index_handles_gaps(spark):
    df = spark.createDataFrame([(1, 10, 30), (2, 10, 30), (3, 10, 30), (9, 10, 30), (None, 1, 2)], "i int, E01 int, E03 int")
    slots = C.slot_columns(df, "E")
    assert list(slots) == [1, 3]
    out = [r[0] for r in df.select(C.pick_by_index(slots, "i")).collect()]
    assert out == [10, None, 30, None, None]


def test_last_match(spark):
    rows = [("108", "x", "108"), ("x", "108", None), (None, "x", "y")]
    out = values(
        spark, rows, "a string, b string, c string", C.last_match_index(["a", "b", "c"], "108", pad=2)
    )
    assert out == [("03",), ("02",), (None,)]


def test_value_beside_key_last_match_wins_even_null(spark):
    rows = [(101, 1, 101, None), (101, 1, 102, 6), (5, 1, 6, 6)]
    out = values(
        spark, rows, "k1 int, v1 int, k2 int, v2 int", C.pick_where(["k1", "k2"], ["v1", "v2"], 101)
    )
    assert out == [(None,), (1,), (None,)]


def test_changed_and_counts(spark):
    rows = [("a", "a", None), ("a", "b", None), (None, None, None)]
    out = values(
        spark,
        rows,
        "a string, b string, c string",
        C.has_changed(["a", "b", "c"]),
        C.count_where(["a", "b", "c"], lambda c: c == "a"),
        C.last_non_null(["a", "b", "c"]),
    )
    assert out == [(0, 2, "a"), (1, 1, "b"), (0, 0, None)]


def test_position_at(spark):
    rows = [(2000, 1990, 1999), (1980, 1990, None), (None, 1990, 1999), (2000, None, 1999)]
    out = values(spark, rows, "y int, a int, b int", C.position_at(["a", "b"], "y"))
    assert out == [(2,), (1,), (None,), (None,)]


def test_flag_labels(spark):
    rows = [(1, 6, None), (1, 1, 6), (6, 6, 6), (None, 1, 1)]
    df = spark.createDataFrame(rows, "FORM01 int, FORM04 int, FORMNS int")
    label = C.flag_label(df.columns)
    out = df.select(
        label.alias("l"), C.collapse_label(label, "FORM04").alias("c"), C.only_flag(label, "FORM04", "FORMNS").alias("n")
    )
    assert [tuple(r) for r in out.collect()] == [
        ("FORM01", "FORM01", 0),
        ("FORM01FORM04", "FORM04", 0),
        (None, None, None),
        ("FORM04FORMNS", "FORM04", None),
    ]


def test_tail_probabilities(spark):
    out = values(
        spark,
        [(1.959963984540054,)],
        "z double",
        P.p_normal("z"),
        P.p_chi2_1(F.col("z") * F.col("z")),
        P.p_student(F.lit(2.228138852), F.lit(10.0)),
        P.p_fisher(F.lit(4.9646027437307), F.lit(1.0), F.lit(10.0)),
        P.p_student(F.lit(None).cast("double"), F.lit(10.0)),
    )[0]
    assert out[:4] == pytest.approx([0.05, 0.05, 0.05, 0.05], rel=1e-6)
    assert out[4] is None
