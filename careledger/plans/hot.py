"""Finding the orders that are too large for one task, before a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.functions.windows import Window
from careledger.operators.joins import ROWS_PER_TASK, frequent_orders

#: The inputs that keep repeated orders, and the date that their window is about.
REPEATED = {
    "order_profit": "order_date",
    "deliveries": "business_day",
    "cancellations": "cancellation_date",
    "order_milestones": "business_day",
    "order_attributes": "delivery_time_ct",
    "order_locations": None,
}


def find_hot_orders(
    tables: Mapping[str, DataFrame], window: Window, rows_per_task: int = ROWS_PER_TASK
) -> dict[str, int]:
    """Order ids with more rows in the window than a task can take, and how many.

    One job that reads one column and the dates of each input, so it is not part of building a
    report. Its result goes into ``Params.hot_orders``:

        hot = find_hot_orders(tables, PaddedWindow(start, end))
        report_a(tables, dataclasses.replace(params, hot_orders=hot))
    """
    inputs = {
        name: tables[name] if day is None else tables[name].filter(window.holds(F.col(day).cast("date")))
        for name, day in REPEATED.items()
        if name in tables
    }
    return frequent_orders(inputs, rows_per_task)
