"""Exact percentiles, bitmaps of orders, days written on their own, and checks that run along."""

import os
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from careledger import write_days
from careledger.operators import checks, selection
from careledger.plans import rollup


def interpolated(values, p):
    return round(float(np.quantile(np.array(values, float), p)), 4)


@pytest.mark.parametrize("cuts", [64, 3])
def test_percentiles_are_exact(spark, monkeypatch, cuts):
    """One value in a third of the rows, a long tail, NULLs, a constant and an empty column."""
    monkeypatch.setattr(selection, "CUTS", cuts)
    draw = random.Random(4)
    rows = []
    for i in range(3000):
        v = 7.0 if i % 3 == 0 else draw.lognormvariate(0, 3) if i % 3 == 1 else None
        rows.append((v, draw.randrange(-50, 50), 5, None))
    df = spark.createDataFrame(rows, "v double, w int, c int, none double").repartition(5)
    at = (0.0, 0.01, 0.25, 0.5, 0.77, 1.0)
    found = {(r.column_name, r.percentile): r for r in selection.exact_percentiles(df, "s", df.columns, at).collect()}
    for k, name in enumerate(("v", "w", "c")):
        values = [r[k] for r in rows if r[k] is not None]
        for p in at:
            assert found[name, p].value == interpolated(values, p), (name, p)
    assert found["v", 0.5].null_share == round(1000 / 3000, 6)
    assert found["none", 0.5].value is None and found["none", 0.5].null_share == 1
    assert selection.exact_percentiles(df.limit(0), "s", ["v"]).count() == 0


def test_the_last_step_holds_a_small_part(spark):
    """After two rounds a window sees few of a column's values."""
    df = spark.range(200_000).select((F.col("id") * 1.5).alias("v"))
    counts = df.select(F.lit("v").alias("column_name"), F.col("v").alias("value"), F.lit(1).alias("n"))
    ranks = spark.createDataFrame([("v", 100_000)], "column_name string, rank long")
    rows, keys = counts.withColumn("before", F.lit(0).cast("bigint")), ["column_name"]
    for part in ("part0", "part1"):
        rows = selection._narrowed(rows, ranks, keys, part)
        keys.append(part)
    assert 0 < rows.count() < 200_000 / 60**2 * 4
    assert rows.filter(F.col("value") == 150_000).count() == 1


def test_bitmaps_roll_up_like_distinct_counts(spark, monkeypatch):
    monkeypatch.setattr(rollup, "CHUNK", 64)
    draw = random.Random(6)
    rows = [
        (draw.choice("abc"), draw.choice([1, 2, None]), None if draw.random() < 0.02 else f"o{draw.randrange(700)}")
        for _ in range(4000)
    ] + [("z", 9, None)]
    df = spark.createDataFrame(rows, "k string, m int, order_uuid string")
    bitmaps = rollup.order_bitmaps(df, ["k", "m"], parts=3)
    assert bitmaps.groupBy("k", "m", "part", "chunk").count().filter("count > 1").count() == 0
    for by in (["k"], ["m"], ["k", "m"], []):
        want = df.groupBy(*by).agg(F.count_distinct("order_uuid").alias("orders"))
        assert sorted(map(repr, rollup.roll_up(bitmaps, by).collect())) == sorted(map(repr, want.collect()))


def test_order_numbers_are_dense_and_repeatable(spark):
    df = spark.range(1000).select(F.concat(F.lit("o"), F.col("id") % 400).alias("order_uuid"))
    numbers = rollup.order_numbers(df, parts=4)
    got = {r.order_uuid: (r.part, r.chunk * rollup.CHUNK + r.bit) for r in numbers.collect()}
    again = {r.order_uuid: (r.part, r.chunk * rollup.CHUNK + r.bit) for r in rollup.order_numbers(df.repartition(7), parts=4).collect()}
    assert got == again and len(set(got.values())) == 400
    for part in range(4):
        own = sorted(n for p, n in got.values() if p == part)
        assert own == list(range(len(own)))


def files_of(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for name in names
        if name.startswith("part-")
    }


def test_only_changed_days_are_written(spark, tmp_path):
    path, staging = str(tmp_path / "report"), str(tmp_path / "next")

    def report(first, last, more=0):
        days = F.date_add(F.lit(first), (F.col("id") % ((last - first).days + 1)).cast("int"))
        return spark.range(300).select(
            F.col("id"), ((F.col("id") % 7) + more).cast("decimal(18,2)").alias("cost"), days.alias("date1")
        )

    one, two = (date(2024, 1, 1), date(2024, 1, 10)), (date(2024, 1, 6), date(2024, 1, 15))
    assert len(write_days(report(*one), path, staging, *one)) == 10
    before = files_of(path)
    assert write_days(report(*one).repartition(3), path, staging, *one) == []
    assert files_of(path) == before

    # A later window that overlaps: its days are replaced, the older ones stay file for file.
    assert write_days(report(*two, more=1), path, staging, *two) == [date(2024, 1, d) for d in range(6, 16)]
    after = files_of(path)
    old = {f: t for f, t in before.items() if any(f"date1=2024-01-0{d}/" in f for d in range(1, 6))}
    assert old and old.items() <= after.items()
    stored = spark.read.parquet(path)
    want = report(*one).filter("date1 < '2024-01-06'").unionByName(report(*two, more=1))
    assert checks.same_rows(want, stored.select(want.columns)).first()[2:] == (0, 0)

    # One day changes, another has no rows any more.
    third = report(*two, more=1).filter("date1 <> '2024-01-08'").withColumn(
        "cost", F.when(F.col("date1") == "2024-01-09", F.col("cost") + 1).otherwise(F.col("cost"))
    )
    assert write_days(third, path, staging, *two) == [date(2024, 1, 8), date(2024, 1, 9)]
    days = {r.date1 for r in spark.read.parquet(path).select("date1").distinct().collect()}
    assert days == {date(2024, 1, d) for d in range(1, 16)} - {date(2024, 1, 8)}


def test_checks_run_along_with_a_write(spark, tmp_path):
    rows = [("12", 1.25, -3), ("x", 2.505, 4), (None, None, None), ("99999999999", 3.0, -1)]
    df = spark.createDataFrame(rows, "t string, m double, s int").repartition(2)
    measure = [
        lambda d, s: checks.numeric_text(d, s, ["t"]),
        lambda d, s: checks.money_scale(d, s, ["m"]),
        lambda d, s: checks.sign_check(d, s, {"s": False, "m": False}),
        lambda d, s: checks.value_range(d, s, {"s": (-2, 3)}),
        lambda d, s: checks.allowed_values(d, s, {"t": ("12", "x")}),
    ]
    watched, observed = checks.observed(df, "stage", measure)
    watched.write.parquet(str(tmp_path / "out"))
    alone = [tuple(r) for check in measure for r in check(df, "stage").collect()]
    assert sorted(map(repr, observed.rows())) == sorted(map(repr, alone))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_observed_checks_of_a_whole_stage(spark, tables, params, tmp_path):
    """The values of the check queries, without a second scan of the stage."""
    from careledger import stages_a

    detail = stages_a(tables, params)["o3"]
    measure = [
        lambda d, s: checks.money_scale(d, s, ["total_care_cost"]),
        lambda d, s: checks.sign_check(d, s, {"tip": False, "cp_diner_adj": True}),
    ]
    watched, observed = checks.observed(detail, "o3", measure)
    watched.write.format("noop").mode("overwrite").save()
    alone = [tuple(r) for check in measure for r in check(detail, "o3").collect()]
    assert sorted(map(repr, observed.rows())) == sorted(map(repr, alone))


def bags(spark):
    draw = random.Random(9)
    rows = [(draw.randrange(300), draw.choice(["a", "b", None]), draw.choice([1, None]), draw.choice([1, None])) for _ in range(4000)]
    schema = "k int, t string, x int, y int"
    return rows, spark.createDataFrame(rows, schema), schema


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_same_rows_by_parts_like_same_rows(spark, keys):
    rows, left, schema = bags(spark)
    moved = [(k, t, y, x) if i == 7 or i % 500 == 0 else (k, t, x, y) for i, (k, t, x, y) in enumerate(rows)]
    others = [
        left.repartition(7),
        left.limit(0),
        left.union(left),
        spark.createDataFrame(rows[:-3] + [rows[0]] * 2, schema),
        spark.createDataFrame(moved, schema),
        spark.createDataFrame(moved, schema).select("y", "x", "t", "k"),
    ]
    for right in others:
        for one, two in ((left, right), (right, left)):
            assert checks.same_rows_by_parts(one, two, keys, parts=64).first() == checks.same_rows(one, two).first()
    empty = checks.same_rows_by_parts(left.limit(0), left.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_a_value_that_changes_places_with_a_null_is_seen(spark, tmp_path):
    """Hashes skip NULLs; the marks do not."""
    a = spark.createDataFrame([(date(2024, 1, 1), 5, None)], "date1 date, x int, y int")
    b = spark.createDataFrame([(date(2024, 1, 1), None, 5)], "date1 date, x int, y int")
    assert tuple(checks.same_rows_by_parts(a, b, ["date1"]).first()) == (1, 1, 1, 1)
    path, staging, day = str(tmp_path / "report"), str(tmp_path / "next"), date(2024, 1, 1)
    write_days(a, path, staging, day, day)
    assert write_days(b, path, staging, day, day) == [day]
    assert spark.read.parquet(path).first().y == 5


def test_nested_columns_are_compared_too(spark):
    a = spark.createDataFrame([(1, [None, 2], (None, 3))], "k int, l array<int>, s struct<p: int, q: int>")
    b = spark.createDataFrame([(1, [2, None], (3, None))], "k int, l array<int>, s struct<p: int, q: int>")
    assert tuple(checks.same_rows_by_parts(a, b, ["k"]).first()) == (1, 1, 1, 1)
    assert tuple(checks.same_rows_by_parts(a, a, ["k"]).first()) == (1, 1, 0, 0)


def test_equal_frames_shuffle_no_rows(spark, tmp_path):
    """What the exchanges of two equal frames carry are sums per part and task."""
    path = str(tmp_path / "rows")
    spark.range(200_000).select("id", (F.col("id") % 7).alias("v")).write.parquet(path)
    rows = spark.read.parquet(path)
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()

    def most_shuffled(frame, group):
        context.setJobGroup(group, "")
        try:
            assert tuple(frame.first())[:2] == (200_000, 200_000)
        finally:
            context._jsc.clearJobGroup()
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        return max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    by_parts = most_shuffled(checks.same_rows_by_parts(rows, rows.select("*"), ["id"], parts=16), "parts")
    assert 0 < by_parts < 1000 < 100_000 < most_shuffled(checks.same_rows(rows, rows.select("*")), "whole")
