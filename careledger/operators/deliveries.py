"""Managed deliveries: one row per leg (report A) or the first leg (report B)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.columns import earliest, hours, minutes, minutes_between
from careledger.functions.windows import PaddedWindow, RollingWindow, WindowSet


def _delivery_time(clock: str) -> Column:
    """Dropoff, else promised, else an hour after the order, on one clock."""
    return F.coalesce(
        f"dropoff_complete_time_{clock}",
        f"eta_at_order_placement_time_{clock}",
        F.col(f"order_created_time_{clock}") + hours(1),
    )


def _limit() -> Column:
    return F.col("eta_at_order_placement_time_utc") + minutes(10)


def late(limit: Column, dropoff: Column) -> Column:
    """1 when a whole minute has passed between ``limit`` and ``dropoff``, else 0."""
    return F.when(dropoff >= limit + minutes(1), 1).otherwise(0)


def is_true(flag: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(flag, F.lit(False))


def delivery_legs(
    deliveries: DataFrame, window: PaddedWindow | WindowSet, flagged_regions: Iterable[str]
) -> DataFrame:
    """Legs delivered in the exact window on the local clock, with their calendar parts."""
    local = deliveries.withColumn("datetime_local", _delivery_time("local")).withColumn(
        "date2", F.col("datetime_local").cast("date")
    )
    legs = window.exact(window.within(local, "business_day"), "date2")
    start = F.when(is_true(F.col("future_order_ind")), F.col("delivery_created_time_utc")).otherwise(
        F.col("order_created_time_utc")
    )
    cancelled = F.col("cancelled_time_local").isNotNull()
    return legs.select(
        "order_uuid",
        *window.keys,
        "region_uuid",
        "region_name",
        "mealtime",
        "delivery_eta_type",
        F.when(F.col("region_name").startswith(fixed.CA_PREFIX), "CA")
        .otherwise("xCA")
        .alias("CA_Market"),
        F.when(F.col("region_uuid").isin(*sorted(flagged_regions)), "DCWP")
        .otherwise("xDCWP")
        .alias("NYC_Market"),
        F.col("bundle_type").isNotNull().alias("bundle_ind"),
        is_true(F.col("future_order_ind")).alias("future"),
        F.trunc("date2", "week").alias("start_of_week"),
        "date2",
        F.weekofyear("date2").alias("week"),
        F.month("date2").alias("month"),
        _delivery_time("utc").alias("deliverytime_utc"),
        F.date_format("date2", "E").alias("dayofweek"),
        "datetime_local",
        minutes_between(start, F.col("lower_bound_eta_at_order_placement_time_utc")).alias(
            "diner_ty_eta"
        ),
        "dropoff_complete_time_utc",
        _limit().alias("ghd_eta_utc"),
        late(_limit(), F.col("dropoff_complete_time_utc")).alias("ghd_late_ind"),
        cancelled.cast("int").alias("cancel_ind"),
        F.when(
            cancelled,
            minutes_between(F.col("click_start_time_local"), F.col("cancelled_time_local")),
        ).alias("cancel_mins"),
    )


def delivery_first_leg(deliveries: DataFrame, window: RollingWindow) -> DataFrame:
    """The leg created first, per order."""
    leg = F.struct(
        "dropoff_complete_time_utc",
        _limit().alias("ghd_eta_utc"),
        F.col("bundle_type").isNotNull().alias("bundle_ind"),
        is_true(F.col("delivery_fulfillment_type") == fixed.SHOP_AND_PAY).alias("shop_and_pay_ind"),
    )
    first = (
        window.within(deliveries, "business_day")
        .groupBy("order_uuid")
        .agg(earliest(leg, F.col("order_created_time_utc"), leg).alias("leg"))
    )
    return first.select(
        "order_uuid",
        "leg.dropoff_complete_time_utc",
        "leg.ghd_eta_utc",
        late(F.col("leg.ghd_eta_utc"), F.col("leg.dropoff_complete_time_utc")).alias("ghd_late_ind"),
        "leg.bundle_ind",
        "leg.shop_and_pay_ind",
    )
