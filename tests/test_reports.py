"""Whole reports: both forms agree, and the properties that must hold."""

import dataclasses
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as catalog
from careledger import report_a, report_b, stages_a, stages_b, sweep
from careledger.operators import checks
from careledger.plans.report_a import summarise_a

STAGES_A = "adj ghg care_fg diner_ss_cancels cancels mdf contacts o o2 o3 final_output".split()
STAGES_B = (
    "adj ghg care_fg diner_ss_cancels cancels osmf of mdf rest_refunds contacts o o2 o3 final_output"
).split()


@pytest.fixture(scope="module")
def hot(tables):
    """Orders taken as hot: some with two legs, cancellations and contacts."""
    rows = tables["order_profit"].filter("order_date >= '1997-01-01'").orderBy("order_uuid")
    return tuple(r.order_uuid for r in rows.select("order_uuid").limit(60).collect())


def with_hot_rows(tables, factor=3):
    """Tables in which one order of each report has repeated rows everywhere."""

    def repeat(df, column="order_uuid"):
        chosen = F.col(column).isin("o-400", "o-60", "o-1440", "o-300")
        times = F.when(chosen, factor).otherwise(1)
        return df.withColumn("_i", F.explode(F.sequence(F.lit(1), times))).drop("_i")

    changed = dict(tables)
    for name in (
        "order_profit",
        "deliveries",
        "cancellations",
        "order_milestones",
        "order_attributes",
        "order_locations",
    ):
        changed[name] = repeat(tables[name])
    for name in tables:
        changed.setdefault(name, tables[name])
    return changed


@pytest.fixture(scope="module")
def all_tables(tables):
    from careledger.sources.fixtures import SELECTS

    return {name: tables[name] for name in SELECTS}


def test_stage_names_and_columns(all_tables, params):
    a, b = stages_a(all_tables, params), stages_b(all_tables, params)
    assert list(a) == STAGES_A and list(b) == STAGES_B
    assert [len(a[s].columns) for s in ("o", "o2", "o3", "final_output")] == [40, 39, 41, 9]
    assert [len(b[s].columns) for s in ("o", "o2", "o3", "final_output")] == [37, 36, 38, 42]


def test_report_a_equals_its_stages(all_tables, params, hot, bag):
    expected = bag(stages_a(all_tables, params)["final_output"])
    assert bag(report_a(all_tables, params)) == expected
    given = dataclasses.replace(params, hot_orders=dict.fromkeys(hot, 5_000_000))
    assert bag(report_a(all_tables, given)) == expected
    assert bag(stages_a(all_tables, given)["final_output"]) == expected


def test_report_b_equals_its_stages(all_tables, params, hot, bag):
    # Ten years, so that the small tables fill every branch.
    wide = dataclasses.replace(params, months=120)
    expected = bag(stages_b(all_tables, wide)["final_output"])
    assert bag(report_b(all_tables, wide)) == expected
    given = dataclasses.replace(wide, hot_orders=dict.fromkeys(hot, 5_000_000))
    assert bag(report_b(all_tables, given)) == expected


def test_repeated_rows_multiply_as_in_a_join(all_tables, params, bag):
    many = with_hot_rows(all_tables)
    wide = dataclasses.replace(params, start=date(1995, 1, 1), end=date(2001, 8, 1), months=120)
    for report, stages in ((report_a, stages_a), (report_b, stages_b)):
        expected = bag(stages(many, wide)["final_output"])
        assert bag(report(many, wide)) == expected
        given = dataclasses.replace(wide, hot_orders={"o-400": 10**7, "o-60": 1, "o-1440": 3 * 10**6})
        assert bag(report(many, given)) == expected
        assert expected != bag(report(all_tables, wide))


def test_orders_without_an_id_stay_in_report_b(all_tables, params, bag):
    profit = all_tables["order_profit"]
    unnamed = {**all_tables, "order_profit": profit.withColumn("order_uuid", F.lit(None).cast("string"))}
    wide = dataclasses.replace(params, months=120)
    found = report_b(unnamed, wide)
    assert bag(found) == bag(stages_b(unnamed, wide)["final_output"])
    row = found.agg(F.sum("orders").alias("orders"), F.sum("ghd_orders").alias("ghd")).first()
    assert row.orders == 0 and row.ghd > 0
    assert report_a(unnamed, params).count() == 0


def test_a_repeated_map_row_repeats_rows_but_not_orders(all_tables, params):
    reason_map = all_tables["cancel_reason_map"]
    doubled = {
        **all_tables,
        "cancel_reason_map": reason_map.unionByName(
            reason_map.filter("cancel_reason_name = 'Payment Issues'").withColumn(
                "cancel_reason_id", F.lit(77)
            )
        ),
    }
    before, after = (
        summarise_a([stages_a(t, params)["o3"]], ["adjustment_and_cancel_reason_combined"])
        for t in (all_tables, doubled)
    )
    rows = before.join(after, "adjustment_and_cancel_reason_combined").select(
        (F.col("adjustment_and_cancel_reason_combined") == "payment issues").alias("hit"),
        (before["orders"] * F.when(F.col("hit"), 2).otherwise(1) == after["orders"]).alias("rows_ok"),
        (before["distinct_order_uuid"] == after["distinct_order_uuid"]).alias("orders_ok"),
    )
    found = rows.collect()
    assert any(r.hit for r in found) and all(r.rows_ok and r.orders_ok for r in found)


def test_row_order_and_partitioning_change_nothing(all_tables, params, bag):
    shuffled = {
        name: df.repartition(3).sortWithinPartitions(F.desc(df.columns[0]))
        for name, df in all_tables.items()
    }
    assert bag(report_a(shuffled, params)) == bag(report_a(all_tables, params))
    assert bag(report_b(shuffled, params)) == bag(report_b(all_tables, params))


def test_every_order_of_the_scope_is_in_the_detail(all_tables, params):
    stages = stages_a(all_tables, params)
    scope = catalog.orders.managed_orders(all_tables["order_profit"], catalog.WINDOW_A).join(
        stages["mdf"], "order_uuid", "left_semi"
    )
    assert scope.join(stages["o3"], "order_uuid", "left_anti").count() == 0


def test_adjacent_windows_add_up(all_tables, params):
    """Costs by market of two halves add up to the whole (orders are dated within a day)."""
    from careledger.functions.windows import PaddedWindow
    from careledger.operators.deliveries import delivery_legs
    from careledger.operators.orders import managed_orders

    def orders_of(start, end):
        window = PaddedWindow(start, end)
        legs = delivery_legs(all_tables["deliveries"], window, params.flagged_regions)
        return managed_orders(all_tables["order_profit"], window).join(legs, "order_uuid").count()

    whole = orders_of(date(1997, 1, 1), date(1997, 12, 31))
    assert whole > 0
    assert whole == orders_of(date(1997, 1, 1), date(1997, 6, 30)) + orders_of(
        date(1997, 7, 1), date(1997, 12, 31)
    )


def test_sweep_equals_single_runs(all_tables, params, bag):
    windows = [
        ("year", date(1997, 1, 1), date(1997, 12, 31)),
        ("half", date(1997, 1, 1), date(1997, 6, 30)),
        ("day", date(1997, 3, 3), date(1997, 3, 3)),
    ]
    expected = []
    for name, start, end in windows:
        run = stages_a(all_tables, dataclasses.replace(params, start=start, end=end))["o3"]
        expected += bag(
            summarise_a([run.withColumn("window_id", F.lit(name))], ["window_id", "region_name"])
        )
    found = sweep(all_tables, params, windows)
    assert bag(found) == sorted(expected) and expected
    hot_params = dataclasses.replace(params, hot_orders={"o-400": 10**7, "o-20": 1})
    assert bag(sweep(all_tables, hot_params, windows)) == sorted(expected)


def test_fanout_is_visible(all_tables, params):
    found = checks.fanout(report_a(all_tables, params), ["cany_ind"])
    assert found.agg(F.max("repeated_rows")).first()[0] > 0
