"""Semantics of single stages on small inputs."""

from datetime import date, datetime
from decimal import Decimal
from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from careledger import fixture_tables
from careledger.functions import fixed_values as fixed
from careledger.functions.columns import latest, minutes_between, whole_seconds
from careledger.functions.windows import PaddedWindow, RollingWindow, WindowSet, months_before
from careledger.operators import events, orders
from careledger.operators.deliveries import delivery_first_leg, delivery_legs, late
from tests.test_rules import first_match

WINDOW = PaddedWindow(date(2024, 3, 1), date(2024, 3, 31))


def at(day, hour=0, minute=0, second=0, micro=0):
    return datetime(2024, 3, day, hour, minute, second, micro)


def test_latest_keeps_null_values_and_skips_null_times(spark):
    df = spark.createDataFrame(
        [
            ("null wins", "old", at(1), 1),
            ("null wins", None, at(2), 2),
            ("tie", "low", at(1), 1),
            ("tie", "high", at(1), 2),
            ("no time", "x", None, 1),
            ("one time", "x", None, 9),
            ("one time", "y", at(1), 1),
        ],
        "k string, v string, t timestamp_ntz, id int",
    )
    for rows in (df, df.orderBy(F.desc("id")), df.orderBy("id")):
        pick = latest(F.col("v"), F.col("t"), F.col("id")).alias("v")
        found = {r.k: r.v for r in rows.groupBy("k").agg(pick).collect()}
        assert found == {"null wins": None, "tie": "high", "no time": None, "one time": "y"}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    """Across a clock change, and with fractions of a second."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(
            [(at(10, 1, 30, 0, 900_000), at(10, 3, 30, 0, 100_000)), (at(10, 3), at(10, 1))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        found = df.select(
            whole_seconds(F.col("a"), F.col("b")), minutes_between(F.col("a"), F.col("b"))
        ).collect()
        assert [tuple(r) for r in found] == [(7199, 119.9833), (-7200, -120.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_late_means_a_whole_minute(spark):
    rows = [(at(1), at(1, 0, 0, 59)), (at(1), at(1, 0, 1, 0)), (at(1), None), (None, at(1))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(late(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0]


def test_rolling_window_clamps_to_the_month_end():
    assert months_before(date(2024, 8, 31), 6) == date(2024, 2, 29)
    assert months_before(date(2024, 1, 15), 6) == date(2023, 7, 15)
    assert months_before(date(2024, 12, 31), 12) == date(2023, 12, 31)


def test_windows_include_their_padding(spark):
    days = spark.sql(
        "SELECT explode(sequence(DATE'2024-02-25', DATE'2024-04-05')) AS d"
    ).withColumn("i", F.date_format("d", "yyyyMMdd").cast("int"))
    padded = [r.d for r in WINDOW.within(days, "d").collect()]
    assert (min(padded), max(padded)) == (date(2024, 2, 29), date(2024, 4, 1))
    assert WINDOW.within_int(days, "i").count() == len(padded)
    exact = [r.d for r in WINDOW.exact(days, "d").collect()]
    assert (min(exact), max(exact)) == (date(2024, 3, 1), date(2024, 3, 31))
    assert RollingWindow(date(2024, 9, 30), 6).within(days, "d").count() == 7


def test_window_set_equals_single_windows(spark, bag):
    days = spark.sql(
        "SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS d"
    ).withColumn("i", F.date_format("d", "yyyyMMdd").cast("int"))
    windows = [
        ("a", date(2024, 3, 1), date(2024, 3, 31)),
        ("b", date(2024, 3, 15), date(2024, 4, 2)),
        ("c", date(2024, 7, 1), date(2024, 7, 1)),
    ]
    many = WindowSet(spark, windows)
    for method, column in (("within", "d"), ("within_int", "i")):
        single = [
            getattr(PaddedWindow(s, e), method)(days, column).withColumn("window_id", F.lit(n))
            for n, s, e in windows
        ]
        assert bag(getattr(many, method)(days, column)) == sorted(sum(map(bag, single), []))
    tagged = many.within(days, "d")
    exact = many.exact(tagged, "d").groupBy("window_id").count()
    assert {r.window_id: r["count"] for r in exact.collect()} == {"a": 31, "b": 19, "c": 1}
    with pytest.raises(ValueError):
        WindowSet(spark, [windows[0], windows[0]])


TICKETS = "ticket_id bigint, created_time timestamp_ntz, ticket_created_date date, primary_name string, secondary_name string, contact_reason string"
CANCELLATIONS = "order_uuid string, order_status_cancel_ind boolean, order_status_cancel_reason string, primary_cancel_reason_id string, cancellation_ticket_id string, cancellation_time_utc timestamp_ntz, cancellation_date date"
MAP = "cancel_reason_id int, cancel_reason_name string, cancel_group string"
OWN = "order_uuid string, reason_code string, diner_ss_cancel_reason string, diner_ss_cancel_reason_group string"


def run_cancels(spark, rows, strict=True, hot=None):
    tickets = spark.createDataFrame(
        [
            (1, at(5), date(2024, 3, 5), "P", None, "P"),
            (2, at(5), date(2023, 1, 5), "P", "S", "S"),
        ],
        TICKETS,
    )
    names = spark.createDataFrame(
        [(1, "Late Order", "Logistics Issues"), (3, "Not Mapped", "Not Mapped")], MAP
    )
    own = spark.createDataFrame([("o1", "X", "Payment Issues", "Diner Issues")], OWN)
    return events.cancels(
        spark.createDataFrame(rows, CANCELLATIONS), names, tickets, own, WINDOW, strict, hot
    )


def test_cancel_overrides(spark):
    day = date(2024, 3, 5)
    rows = [
        ("o1", True, "other", "3", "1", None, day),
        ("o2", True, "other", "3", "2", at(6), day),
        ("o3", True, "Restaurant didnt receive order", "1", None, None, day),
        ("o4", True, "Restaurant didn't receive order", "1", None, None, day),
        ("o5", True, "other", "99", None, None, day),
        ("o6", True, "other", "1", None, None, date(2024, 4, 2)),
        (None, True, "other", "1", None, None, day),
    ]
    found = {r.order_uuid: r for r in run_cancels(spark, rows).collect()}
    assert (found["o1"].cancel_group, found["o1"].cancel_reason_name) == (
        "Diner Issues",
        "Payment Issues",
    )
    assert found["o1"].cancel_time_utc == at(5) and found["o1"].cancel_contact_reason == "P"
    # The ticket of o2 lies outside the window, so its reason is not seen.
    assert found["o2"].cancel_group == "Not Mapped" and found["o2"].cancel_contact_reason is None
    assert found["o3"].cancel_group == fixed.NOT_RECEIVED_GROUP
    # The apostrophe form is not covered by the pattern.
    assert found["o4"].cancel_group == "Logistics Issues"
    assert found["o5"].cancel_group is None
    assert "o6" not in found and None in found


def test_cancels_with_hot_orders_are_the_same(spark, bag):
    rows = [
        (o, True, "other", "3", t, None, date(2024, 3, 5))
        for o in ("o1", "o1", "o2", None)
        for t in ("1", None)
    ]
    assert bag(run_cancels(spark, rows, hot={"o1": 9, "zz": 9})) == bag(run_cancels(spark, rows))


def test_ticket_ids_are_strict_unless_asked(spark):
    rows = [("o1", True, "other", "3", "not a number", at(1), date(2024, 3, 5))]
    with pytest.raises(PySparkException):
        run_cancels(spark, rows).collect()
    assert run_cancels(spark, rows, strict=False).count() == 1


def test_guarantee_claims_take_the_alphabetical_maximum(spark):
    day = date(2024, 3, 5)
    rows = [
        ("both", "SERVICE", day, "GRANT"),
        ("both", "PRICING", day, "GRANT"),
        ("late", "SERVICE", day, "GRANT"),
        ("late", "PRICING", day, "DENY"),
        ("other", "OTHER", day, "GRANT"),
    ]
    claims = spark.createDataFrame(
        rows, "cart_uuid string, claim_type string, created_date date, decision string"
    )
    found = {r.order_uuid: r.fg_reason for r in events.guarantee_claims(claims, WINDOW).collect()}
    assert found == {"both": "Price - GHG", "late": "Late Delivery - GHG", "other": None}


def test_delivery_window_uses_the_local_day(spark, params):
    # These tables have orders on both edges of the window.
    tables = fixture_tables(spark, "/root/testdata/sf0.01")
    window = PaddedWindow(params.start, params.end)
    legs = delivery_legs(tables["deliveries"], window, params.flagged_regions)
    row = legs.agg(F.min("date2").alias("lo"), F.max("date2").alias("hi")).first()
    assert params.start <= row.lo and row.hi <= params.end
    assert window.within(tables["deliveries"], "business_day").count() > legs.count()
    first = delivery_first_leg(tables["deliveries"], RollingWindow(params.as_of, 120))
    assert first.count() == first.select("order_uuid").distinct().count()


def expected_groups(cancel_group, map_group, combined, concession):
    def group(text):
        if cancel_group is not None and cancel_group != "Other":
            return map_group
        fallback = map_group if map_group is not None else "not grouped"
        return first_match(text, fixed.GROUP_RULES, fallback)

    return group(combined), group(concession)


def test_groups_follow_the_truth_table(spark):
    """Gate, rule, map hit and fill over every combination."""
    names = {"late order": "Logistics Issues", "billing question": "Other", "odd": None}
    rows = [
        (i, group, text, reason, amount)
        for i, (group, text, reason, amount) in enumerate(
            product(
                [None, "Other", "Not Mapped", "Diner Issues"],
                [None, "late order", "billing question", "odd", "menu error", "unknown"],
                [None, "missing item", "billing question", "unknown"],
                [None, Decimal("0.00"), Decimal("-1.00")],
            )
        )
    ]
    reasoned = spark.createDataFrame(
        [(*r, Decimal("-2.00"), None, None, Decimal("0.50")) for r in rows],
        "id int, cancel_group string, adjustment_and_cancel_reason_combined string, fg_reason string,"
        " cp_care_concession_awarded_amount decimal(18,2), cp_care_ticket_cost decimal(18,2),"
        " cp_redelivery_cost decimal(18,2), cp_grub_care_refund decimal(18,2), cp_diner_adj decimal(18,2)",
    )
    reason_map = spark.createDataFrame(
        [(i, text.title(), group) for i, (text, group) in enumerate(names.items())], MAP
    )
    reasoned = reasoned.withColumn("order_uuid", F.col("id").cast("string"))
    found = {r.id: r for r in orders.order_detail(reasoned, reason_map, "a").collect()}
    assert len(found) == len(rows)
    for i, group, text, reason, amount in rows:
        row = found[i]
        assert (row.adjustment_group, row.fg_group) == expected_groups(
            group, names.get(text), text, reason
        )
        filled = text if reason is None and amount is not None and amount < 0 else reason
        assert row.fg_reason == filled
        # Only redelivery and refund count as zero when unknown.
        total = None if amount is None else amount - Decimal("2.00") + Decimal("0.50")
        assert row.total_care_cost == total and row.cp_redelivery_cost == 0


def test_combined_reason(spark):
    df = spark.createDataFrame(
        [("Not Mapped", "a"), (None, "a"), ("Late Order", "a"), ("Late Order", None)],
        "cancel_reason_name string, adjustment_reason_name string",
    ).withColumn("adj_contact_reason", F.lit("x"))
    found = orders.order_reasoned(df)
    assert [r[1] for r in found.collect()] == ["a", "a", "late order", "late order"]
