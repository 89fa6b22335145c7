"""Timelines of orders: neighbours across hours, equal events, and an order with most of the events."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from careledger.operators import timeline

SCHEMA = "line string, order_uuid string, at timestamp_ntz, state string"


def by_hand(rows):
    lines = defaultdict(list)
    for line, order, at, state in rows:
        lines[line, order].append((at, timeline.STATES.index(state), state))
    times, orders = Counter(), Counter()
    for (line, _), events in lines.items():
        before, steps = "start", Counter()
        seen = set()
        for event in sorted(events):
            if event[2] == "created" and event in seen:
                continue
            seen.add(event)
            steps[line, before, event[2]] += 1
            before = event[2]
        times += steps
        orders.update(steps.keys())
    return {key: (orders[key], n) for key, n in times.items()}


def found(df):
    return {(r.line, r.from_state, r.to_state): (r.orders, r.times) for r in timeline.transitions(df).collect()}


def test_like_a_walk_through_every_order(spark):
    draw = random.Random(5)
    rows = []
    for i in range(3000):
        order = "hot" if i % 3 == 0 else f"o{draw.randrange(200)}"
        # Few different instants, so that hours are shared and events repeat; some far apart.
        at = datetime(2024, 3, 30, 23) + timedelta(minutes=20 * draw.randrange(30), days=draw.choice([0, 0, 400]))
        rows.append((draw.choice(["life", "care"]), order, at, draw.choice(timeline.STATES)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == by_hand(rows)
    assert found(df.limit(0)) == {}


def test_what_may_follow(spark):
    steps = [
        ("start", "created", True), ("start", "assigned", False), ("created", "created", False),
        ("created", "delivered", True), ("delivered", "cancelled", False), ("cancelled", "delivered", False),
        ("cancelled", "cancelled", False), ("created", "cancelled", True), ("contacted", "contacted", True),
        ("adjusted", "created", False),
    ]
    df = spark.createDataFrame(steps, "a string, b string, want boolean")
    assert df.filter(timeline.legal(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_events_of_the_inputs(spark, tables):
    """Each input is read once; rows without an order or a time have no event."""
    events = timeline.order_events(tables)
    counts = {(r.line, r.state): r["count"] for r in events.groupBy("line", "state").count().collect()}
    legs, tickets = tables["deliveries"], tables["tickets"]
    assert counts["life", "created"] == counts["care", "created"] == legs.filter("order_created_time_utc is not null").count()
    assert counts["care", "contacted"] == tickets.filter("order_uuid is not null and created_time is not null").count()
    cancelled = tables["cancellations"].filter("order_status_cancel_ind and cancellation_time_utc is not null")
    assert counts["life", "cancelled"] == cancelled.count()
    assert events.filter("order_uuid is null or at is null").count() == 0


def test_a_hot_order_meets_by_hours(spark):
    """Neighbours are looked up within an hour of an order; one order alone only for the edges of hours."""
    events = spark.range(100_000).select(
        F.lit("care").alias("line"),
        F.lit("hot").alias("order_uuid"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 36000)").alias("at"),
        F.lit("contacted").alias("state"),
    )
    assert found(events) == {("care", "start", "contacted"): (1, 1), ("care", "contacted", "contacted"): (1, 99_999)}


def test_events_are_made_and_dealt_once(spark, tables):
    """One plan of the events, one exchange of them and one of an order's days; orders are dealt once for all inputs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = timeline.transitions(timeline.order_events(tables))
        rows = df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = text[: text.index("== Initial Plan ==")]
    assert len(rows) > 10
    # Refunds and concessions.
    assert len(re.findall(r"Scan parquet[^\n]*\[l_orderkey#", final)) == 2
    dealt = re.findall(r"- Exchange hashpartitioning\(([^)]*)\)", final)
    assert len([keys for keys in dealt if "order_uuid" in keys]) == 2
    assert len([keys for keys in dealt if keys.startswith("o_orderkey")]) == 1


def test_equal_events_edges_of_days_and_missing_times(spark):
    """Many copies of one event, microseconds before and after midnight and 1970, and events without a time."""
    noon, night = datetime(2024, 3, 31, 12), datetime(2024, 4, 1)
    rows = [("care", "many", noon, "contacted")] * 70_000 + [("life", "many", noon, "created")] * 3
    rows += [("care", "many", noon + timedelta(seconds=1), "adjusted")] * 600
    for at in (datetime(1969, 12, 31), datetime(1970, 1, 1), night, datetime(1, 1, 2), datetime(9999, 1, 1)):
        for i, state in enumerate(("delivered", "created", "cancelled", "assigned", "assigned")):
            rows.append(("life", "edges", at + timedelta(microseconds=i - 2), state))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df) == by_hand(rows)
    zoned = df.withColumn("at", F.col("at").cast("timestamp"))
    assert found(zoned) == by_hand(rows)
    # Without a time an event comes first.
    odd = spark.createDataFrame([*rows, ("life", "edges", None, "assigned"), ("care", None, noon, "created")], SCHEMA)
    first = [*rows, ("life", "edges", datetime.min, "assigned"), ("care", "unnamed", noon, "created")]
    assert found(odd) == by_hand(first)


def test_a_state_without_a_place_is_refused(spark):
    df = spark.createDataFrame([("life", "a", datetime(2024, 1, 1), "lost")], SCHEMA)
    with pytest.raises(Exception, match="not a state of a timeline: lost"):
        timeline.transitions(df).collect()
