"""The order joins: hot orders, copies and missing orders give the same bag of rows."""

import pytest
from pyspark.sql import functions as F

from careledger.operators import joins
from careledger.operators.joins import (
    Side,
    frequent_orders,
    hot_table,
    join_order_branches,
    join_order_sides,
    left_join_unique,
    spread_left_join,
)

KEYS = ["order_uuid"]


@pytest.fixture(scope="module")
def frames(spark):
    """A fact and three sides; "hot" holds most rows of each, some of them equal."""

    def order(i):
        return "hot" if i % 3 else (None if i % 5 == 0 else f"o{i % 40}")

    base = spark.createDataFrame(
        [(order(i), i % 7, None if i % 11 == 0 else i % 3) for i in range(120)],
        "order_uuid string, a int, b int",
    )
    legs = spark.createDataFrame(
        [(order(i + 1), i % 4) for i in range(90)], "order_uuid string, leg int"
    )
    cancels = spark.createDataFrame(
        [(order(i), None if i % 2 else "x") for i in range(60)] + [("o1", "y")] * 4,
        "order_uuid string, c string",
    )
    unique = spark.createDataFrame(
        [("hot", 1), ("o3", None), ("o6", 2)], "order_uuid string, u int"
    )
    return base, legs, cancels, unique


def plain(base, sides):
    for side in sides:
        base = base.join(side.rows, KEYS, side.how)
    return base


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [{}, {"hot": 5_000_000}, {"hot": 3_000_000, "o3": 2, "not there": 10**8}])
def test_same_bag_of_rows(frames, bag, how, hot):
    base, legs, cancels, unique = frames
    sides = [Side(legs, how, unique=False), Side(cancels, unique=False), Side(unique)]
    assert bag(join_order_sides(base, sides, KEYS, hot)) == bag(plain(base, sides))


def test_missing_orders_can_be_left_out(frames, bag):
    base, legs, _, _ = frames
    sides = [Side(legs, unique=False)]
    kept = join_order_sides(base, sides, KEYS, {"hot": 4_000_000}, keep_null=False)
    assert bag(kept) == bag(plain(base.filter("order_uuid is not null"), sides))


@pytest.mark.parametrize("hot", [{}, {"hot": 9_000_000}])
def test_copies_count_the_rows(frames, bag, hot):
    base, legs, cancels, unique = frames
    counted = [
        Side(
            df.groupBy(*df.columns).agg(F.count("*").alias(name)), how, unique=False, copies=name
        )
        for df, how, name in ((legs, "inner", "_l"), (cancels, "left", "_c"))
    ] + [Side(unique)]
    parts = join_order_branches(base, counted, KEYS, hot)
    full = plain(base, [Side(legs, "inner"), Side(cancels), Side(unique)])
    expected = full.groupBy(*full.columns).agg(F.count("*").alias("copies"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    names = full.columns
    assert bag(found.groupBy(*names).agg(F.sum("copies").alias("copies"))) == bag(expected)


def test_copies_of_one_row_are_dealt_out_to_all_slots(spark):
    df = spark.range(1000).select(F.lit("hot").alias("order_uuid"), F.lit(1).alias("v"))
    cut = joins._slotted(df.withColumn("_slots", F.lit(8).cast("bigint")), "slot", "n").collect()
    assert sorted(r.slot for r in cut) == list(range(8)) and {r.n for r in cut} == {125}


def test_slots_follow_the_rows(spark):
    hot = {"a": 1_000_001, "b": 5_000_000, "c": 10**9, "d": 3}
    found = {r.order_uuid: r._slots for r in hot_table(spark, hot).collect()}
    assert found == {"a": 2, "b": 8, "c": 1024, "d": 2}


def test_frequent_orders_in_one_job(spark):
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("o"), F.col("id")))
        .alias("order_uuid")
    )
    few = spark.range(50).select(F.lit("some").alias("order_uuid"))
    assert frequent_orders({"a": df, "b": few}, 1000) == {"hot": 30_000}
    assert frequent_orders({"a": df, "b": few}, 49) == {"hot": 30_000, "some": 50}
    assert frequent_orders({"a": df.limit(0)}) == {}


def test_too_many_hot_orders_are_refused(frames, monkeypatch):
    base, _, _, unique = frames
    monkeypatch.setattr(joins, "MOST_HOT", 1)
    with pytest.raises(ValueError, match="hot orders"):
        left_join_unique(base, unique, KEYS, {"hot": 1, "o3": 1})


def test_hot_ids_of_too_many_bytes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_HOT_BYTES", 10)
    assert hot_table(spark, {"a" * 10: 1}).count() == 1
    with pytest.raises(ValueError, match="11 bytes"):
        hot_table(spark, {"a" * 11: 1})


def test_hot_orders_are_a_table_not_literals(spark, frames):
    """The plan does not grow with the ids, and only their table is broadcast by hint."""
    base, legs, cancels, unique = frames
    sides = [Side(legs, "inner", unique=False), Side(cancels, unique=False), Side(unique)]

    def plan(n):
        joined = join_order_sides(base, sides, KEYS, {"hot": 5_000_000} | {f"h{i}": 2_000_000 for i in range(n)})
        return joined._jdf.queryExecution().optimizedPlan().toString()

    small, large = plan(5), plan(5000)
    assert "h4999" not in large and len(large) < 1.2 * len(small)
    hinted = [line for line in large.splitlines() if "Join" in line and "strategy=broadcast" in line]
    assert hinted and not any("_slot#" in line for line in hinted)


def test_a_hot_order_is_not_gathered(spark):
    """Without broadcasts of its sides, no task of the join sees more than some slots of the order."""
    base = spark.range(40_000).select(F.lit("hot").alias("order_uuid"), "id")
    unique = spark.createDataFrame([("hot", 1)], "order_uuid string, u int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = left_join_unique(base, unique, KEYS, {"hot": 64_000_000})
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 40_000 and max(sizes) < 10_000


def test_left_join_unique(frames, bag):
    base, _, _, unique = frames
    known = base.filter("order_uuid is not null")
    assert bag(left_join_unique(known, unique, KEYS, {"hot": 1, "o3": 1})) == bag(
        known.join(unique, KEYS, "left")
    )


def test_rows_without_a_key_are_spread(spark, frames, bag):
    base, legs, _, _ = frames
    assert bag(spread_left_join(base, legs, KEYS)) == bag(base.join(legs, KEYS, "left"))
    missing = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("string").alias("order_uuid"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = spread_left_join(missing, legs, KEYS)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1300


def test_building_stages_starts_no_job(spark, tables, params):
    from careledger import report_a, report_b, stages_a
    from careledger.plans.report_b import stages_b

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for build in (report_a, report_b, stages_a, stages_b):
            build(tables, params)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_hot_orders_of_the_inputs(tables, params):
    from careledger import PaddedWindow, find_hot_orders

    window = PaddedWindow(params.start, params.end)
    many = {**tables, "order_locations": tables["order_locations"].limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("k")}
    found = find_hot_orders(many, window, 250)
    assert list(found.values()) == [300]
