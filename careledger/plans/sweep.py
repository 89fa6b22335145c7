"""Report A over many windows and regions in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.functions.windows import WindowSet
from careledger.operators.deliveries import delivery_legs
from careledger.operators.joins import Side
from careledger.params import Params
from careledger.plans.report_a import counted_orders, summarise_a


def sweep(
    tables: Mapping[str, DataFrame],
    params: Params,
    windows: Iterable[tuple[str, date, date]],
    by: Sequence[str] = ("region_name",),
) -> DataFrame:
    """The measures of report A per window and region (or other leg columns).

    Equal to running the report once per window: what is latest in a window
    depends on the window, so every stage is grouped by window too. A row of an
    input is read once and counts in each window that holds its date. ``start``
    and ``end`` of ``params`` are not used.
    """
    spark = tables["order_profit"].sparkSession
    window = WindowSet(spark, windows)
    legs = (
        delivery_legs(tables["deliveries"], window, params.flagged_regions)
        .groupBy("order_uuid", "window_id", *by)
        .agg(F.count("*").alias("_legs"))
    )
    parts = counted_orders(
        tables, params, window, Side(legs, how="inner", unique=False, copies="_legs")
    )
    return summarise_a(parts, ["window_id", *by])
