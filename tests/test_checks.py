"""Checks against plain Python on small frames."""

from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from careledger.functions.windows import PaddedWindow
from careledger.operators import checks


def rows_of(df):
    return {r.column_name: (r.rows, r.bad_rows, r.detail) for r in df.collect()}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [
            ("12", "red", Decimal("1.000"), date(2024, 3, 1), date(2024, 3, 2)),
            ("-7", "red", Decimal("-2.505"), date(2024, 2, 1), date(2024, 1, 1)),
            ("9999999999", "a longer text", Decimal("3.100"), None, date(2024, 3, 2)),
            ("x1", None, None, date(2024, 3, 31), None),
            (None, "blue", Decimal("0.000"), date(2024, 4, 2), date(2024, 4, 2)),
        ],
        "n string, s string, m decimal(10,3), d date, e date",
    )


def test_numeric_text(frame):
    assert rows_of(checks.numeric_text(frame, "f", ["n"])) == {"n": (5, 2, "-7..9999999999")}


def test_value_set(frame):
    assert rows_of(checks.value_set(frame, "f", ["s", "n"], longest=5)) == {
        "s": (5, 1, "values=3 longest=13"),
        "n": (5, 1, "values=4 longest=10"),
    }


def test_money_scale(frame):
    assert rows_of(checks.money_scale(frame, "f", ["m"])) == {"m": (5, 1, "-2.51..3.10")}


def test_filter_coverage(frame):
    found = checks.filter_coverage(frame, "f", {"red": F.col("s") == "red"})
    assert rows_of(found) == {"red": (5, 1, "kept=2 dropped=2")}


def test_in_window(frame):
    window = PaddedWindow(date(2024, 3, 1), date(2024, 3, 31))
    assert rows_of(checks.in_window(frame, "f", ["d"], window)) == {
        "d": (5, 2, "2024-02-01..2024-04-02")
    }


def test_range_sign_and_order(frame):
    assert rows_of(checks.value_range(frame, "f", {"m": (0, 2)})) == {
        "m": (5, 2, "-2.505..3.100 nulls=1")
    }
    found = rows_of(checks.sign_check(frame, "f", {"m": False}))
    assert found == {"m": (5, 1, "negative=1 positive=2")}
    assert rows_of(checks.time_order(frame, "f", [("d", "e")])) == {"d <= e": (5, 1, "compared=2")}


def test_allowed_values(frame):
    assert rows_of(checks.allowed_values(frame, "f", {"s": ["red", "blue"]})) == {
        "s": (5, 1, "nulls=1")
    }


def test_same_rows_counts_copies(spark):
    left = spark.createDataFrame([(1, "a")] * 3 + [(2, None)] * 2, "x int, y string")
    right = spark.createDataFrame([(1, "a")] + [(2, None)] * 2 + [(3, "c")], "x int, y string")
    assert tuple(checks.same_rows(left, right).first()) == (5, 4, 2, 1)
    assert tuple(checks.same_rows(left, left).first()) == (5, 5, 0, 0)
    assert tuple(checks.same_rows(left.limit(0), left.limit(0)).first()) == (0, 0, 0, 0)


def test_join_audit_predicts_the_join(spark):
    left = spark.createDataFrame([(k,) for k in [1, 1, 1, 2, 3, None, None]], "k int")
    right = spark.createDataFrame([(k,) for k in [1, 1, 2, 4, None]], "k int")
    row = checks.join_audit("j", left, right, F.col("k"), F.col("k")).first()
    assert row.inner_rows == left.join(right, "k").count()
    assert row.left_join_rows == left.join(right, "k", "left").count()
    assert (row.left_keys, row.right_keys, row.left_null_keys, row.right_null_keys) == (3, 3, 2, 1)
    assert (row.left_largest_key, row.right_largest_key, row.larger_side) == (3, 2, "left")
    empty = checks.join_audit("j", left, right.limit(0), F.col("k"), F.col("k")).first()
    assert (empty.inner_rows, empty.left_join_rows, empty.right_largest_key) == (0, 7, 0)


def test_join_audit_of_a_very_hot_key_does_not_overflow(spark):
    hot = spark.range(1).select(F.lit(1).alias("k"))
    big = spark.range(0, 40_000, 1, 4).select(F.lit(1).alias("k"))
    row = checks.join_audit("j", big, big.unionByName(hot), F.col("k"), F.col("k")).first()
    assert row.inner_rows == 40_000 * 40_001


def test_stage_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "order_uuid string")
    found = checks.stage_counts({"s": df, "keyless": spark.range(3)}).collect()
    assert [tuple(r) for r in found] == [("s", 4, 2, 1, 1)]


def test_percentiles_are_close(spark):
    df = spark.range(10_001).select(F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
    found = {(r.column_name, r.percentile): r.value for r in checks.percentiles(df, ["v", "w"]).collect()}
    for column, scale in (("v", 1), ("w", 2)):
        for p in (0.25, 0.5, 0.75):
            assert abs(found[column, p] - 10_000 * p * scale) <= 10 * scale


def test_value_set_counts_match_python(spark, tables):
    adjustments = tables["adjustments"]
    reasons = Counter(r.reason for r in adjustments.select("reason").collect())
    found = rows_of(checks.value_set(adjustments, "a", ["reason"], longest=10))["reason"]
    known = {r: n for r, n in reasons.items() if r is not None}
    assert found[0] == sum(reasons.values())
    assert found[1] == sum(n for r, n in known.items() if len(r) > 10)
    assert found[2] == f"values={len(known)} longest={max(map(len, known))}"
