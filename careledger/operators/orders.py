"""Order-level stages: everything known about an order, one reason, one group, one cost.

The same functions serve both reports and two shapes of input. With all columns
they give the order-level stages. A report passes only what its groups need, with
a ``copies`` column that counts repeated rows instead of repeating them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.columns import classify, matchable, sql_text
from careledger.functions.windows import PaddedWindow, RollingWindow, WindowSet
from careledger.operators.deliveries import is_true
from careledger.operators.joins import spread_left_join

# Columns of the joined order stage, per report.
JOINED_A = (
    "date1",
    "region_uuid",
    "region_name",
    "CA_Market",
    "NYC_Market",
    "diner_ty_eta",
    "delivery_eta_type",
    "mealtime",
    "month",
    "start_of_week",
    "week",
    "date2",
    "deliverytime_utc",
    "dayofweek",
    "datetime_local",
    "time_local",
    "ghd_ind",
    "order_uuid",
    "cp_diner_adj",
    "cancel_ind",
    "cancel_mins",
    "order_status_cancel_ind",
    "cancel_fact_ind",
    "cancel_group",
    "cancel_reason_name",
    "cancel_contact_reason",
    "ghd_late_ind",
    "ghd_late_ind_incl_cancel_time",
    "adjustment_reason_name",
    "adj_contact_reason",
    "driver_pay_per_order",
    "tip",
    "bundle_ind",
    "fg_reason",
    "care_cost_reason",
    "care_cost_group",
    "cp_care_concession_awarded_amount",
    "cp_grub_care_refund",
    "cp_redelivery_cost",
    "cp_care_ticket_cost",
)
JOINED_B = (
    "date1",
    "ghd_ind",
    "delivery_ind",
    "order_uuid",
    "cp_diner_adj",
    "order_status_cancel_ind",
    "cancel_fact_ind",
    "cancel_group",
    "cancel_reason_name",
    "cancel_contact_reason",
    "status_cancelled_reached_ind",
    "automated_ind",
    "modified_cbsa_name",
    "key_cities_cbsa",
    "ghd_delivery_region_name",
    "large_order_ind",
    "tri_state_ind",
    "cancelled_order_ind",
    "cp_revenue",
    "ghd_late_ind",
    "ghd_late_ind_incl_cancel_time",
    "adjustment_reason_name",
    "adj_contact_reason",
    "tip",
    "bundle_ind",
    "shop_and_pay_ind",
    "fg_reason",
    "care_cost_reason",
    "care_cost_group",
    "cp_care_concession_awarded_amount",
    "driver_pay_per_order",
    "true_up",
    "cp_redelivery_cost",
    "cp_grubcash_care_concession_awarded_amount",
    "cp_grub_care_refund",
    "rr_refund",
    "cp_care_ticket_cost",
)


def money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)")


def cents(amount: Column) -> Column:
    """A DECIMAL(18,2) amount as whole cents, which add up as plain longs."""
    return (amount * 100).cast("bigint")


def from_cents(total: Column) -> Column:
    """A sum of :func:`cents` as DECIMAL(18,2); a larger sum would not fit that type either."""
    return (total.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(18,2)")


def or_zero(name: str) -> Column:
    # Both branches have one type, so no wider decimal is made.
    return F.coalesce(F.col(name), money(F.lit(0)))


def ticket_cost() -> Column:
    """The four ticket cost parts; NULL when any of them is."""
    return money(
        F.col("cp_diner_care_tickets")
        + F.col("cp_driver_care_tickets")
        + F.col("cp_restaurant_care_tickets")
        + F.col("cp_gh_internal_care_tickets")
    )


def total_cost() -> Column:
    """Five cost parts; only redelivery and refund count as zero when NULL."""
    return money(
        F.col("cp_care_concession_awarded_amount")
        + F.col("cp_care_ticket_cost")
        + F.col("cp_diner_adj")
        + or_zero("cp_redelivery_cost")
        + or_zero("cp_grub_care_refund")
    )


def managed_orders(profit: DataFrame, window: PaddedWindow | WindowSet) -> DataFrame:
    """Report A's orders: managed deliveries with an order date in the padded window."""
    # A bare flag: a filter drops NULL anyway, and only this form reaches the scan.
    return window.within(profit, "order_date").filter("managed_delivery_ind")


def recent_orders(profit: DataFrame, window: RollingWindow) -> DataFrame:
    """Report B's orders: delivered in the rolling window and before its last day."""
    delivered = F.col("delivery_time_ct").cast("date")
    return window.within(profit, "order_date").filter(
        window.holds(delivered) & (delivered < F.lit(window.as_of))
    )


def normal_reason(df: DataFrame, text: str, name: str, fallback: bool = True) -> DataFrame:
    """Adds the normalised form of a reason; without a rule the text in lower case.

    Done on each side before the join: fewer rows than orders, and the rules stay
    out of the long generated method of the join chain, which the JVM would not
    compile beyond 8 kB.
    """
    rules = classify("_match", fixed.REASON_RULES, f"lower({text})" if fallback else "NULL")
    return df.withColumn("_match", matchable(F.col(text))).withColumn(name, rules).drop("_match")


def adjustment_columns(adjustments: DataFrame) -> DataFrame:
    """The latest adjustment with the rule its reason matches and its contact reason."""
    ruled = normal_reason(
        adjustments, "adjustment_reason_name", "adjustment_rule", fallback=False
    )
    return normal_reason(ruled, "adj_contact_reason", "adj_contact_normal")


def claim_columns(claims: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The normalised reason of a claim or concession, as ``name``."""
    return normal_reason(claims, "fg_reason", name).select(*keys, name)


def cancel_columns(cancelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the order stage takes from the cancellations, with a presence flag."""
    return normal_reason(cancelled, "cancel_contact_reason", "cancel_contact_normal").select(
        *keys,
        "order_status_cancel_ind",
        "cancel_group",
        "cancel_reason_name",
        "cancel_contact_reason",
        "cancel_contact_normal",
        "cancel_time_utc",
        F.lit(True).alias("cancel_fact_ind"),
    )


def cancelled_late(cancel_time: Column, limit: Column, dropoff: Column) -> Column:
    """Cancelled after the limit and never dropped off."""
    return (cancel_time > limit) & dropoff.isNull()


def order_joined(joined: DataFrame, cost_map: DataFrame, report: str, columns: Sequence[str]) -> DataFrame:
    """The joined order stage: labels, flags, normalised reasons and cost parts.

    ``joined`` is the profit fact with all sides attached, the sides of reasons as
    the functions above give them. ``columns`` picks the output.
    """
    costs = cost_map.select(
        F.col("scr").alias("latest_contact_reason"), "care_cost_reason", "care_cost_group"
    )
    # Most orders have no contact.
    texts = spread_left_join(joined, costs, ["latest_contact_reason"], by=["order_uuid"])
    derived = _derived(texts.columns, report)
    return texts.select(
        *[derived[name]().alias(name) if name in derived else F.col(name) for name in columns]
    )


def _derived(available: Sequence[str], report: str) -> dict[str, Callable[[], Column]]:
    def late_with_cancel() -> Column:
        if "cancelled_late" in available:
            late = F.col("cancelled_late")
        else:
            late = cancelled_late(
                F.col("cancel_time_utc"), F.col("ghd_eta_utc"), F.col("dropoff_complete_time_utc")
            )
        return F.when((F.col("ghd_late_ind") == 1) | late, 1).otherwise(0)

    def adjustment_reason() -> Column:
        # Texts such as "refund for 3 items" match no rule: the contact says more.
        return F.coalesce(
            "adjustment_rule",
            "cancel_contact_normal",
            "adj_contact_normal",
            F.lower("adjustment_reason_name"),
        )

    def concession_reason() -> Column:
        paid = F.coalesce(F.col("cp_care_concession_awarded_amount") != 0, F.lit(True))
        return F.when(paid, F.coalesce("claim_normal", "concession_normal"))

    def label(flag: str, yes: str, no: str) -> Column:
        return F.when(F.col(flag), yes).otherwise(no)

    columns: dict[str, Callable[[], Column]] = {
        "date1": lambda: F.col("delivery_time_ct").cast("date"),
        "time_local": lambda: F.format_string(
            "%02d:%02d", F.hour("datetime_local"), F.minute("datetime_local")
        ),
        "ghd_ind": lambda: label("managed_delivery_ind", "ghd", "non-ghd"),
        "delivery_ind": lambda: label("delivery_ind", "delivery", "pickup"),
        "order_status_cancel_ind": lambda: is_true(F.col("order_status_cancel_ind")),
        "cancel_fact_ind": lambda: is_true(F.col("cancel_fact_ind")),
        "ghd_late_ind": lambda: F.coalesce("ghd_late_ind", F.lit(0)),
        "ghd_late_ind_incl_cancel_time": late_with_cancel,
        "adjustment_reason_name": adjustment_reason,
        "fg_reason": concession_reason,
        "care_cost_group": lambda: F.coalesce("care_cost_group", F.lit(fixed.NOT_GROUPED)),
        "cp_care_ticket_cost": ticket_cost,
        "tri_state_ind": lambda: F.coalesce("tri_state_ind", F.lit("Other")),
    }
    if report == "b":
        columns |= {
            "driver_pay_per_order": lambda: or_zero("cp_driver_pay_per_order"),
            "true_up": lambda: or_zero("cp_driver_true_up"),
            "rr_refund": lambda: or_zero("rr_refund_total"),
            "cp_redelivery_cost": lambda: or_zero("cp_redelivery_cost"),
            "cp_grub_care_refund": lambda: or_zero("cp_grub_care_refund"),
            "cp_grubcash_care_concession_awarded_amount": lambda: or_zero(
                "cp_grubcash_care_concession_awarded_amount"
            ),
        }
    elif "driver_pay_per_order" not in available:
        columns["driver_pay_per_order"] = lambda: F.col("cp_driver_pay_per_order")
    return columns


def order_reasoned(orders: DataFrame) -> DataFrame:
    """Adds the combined reason: the cancel reason when mapped, else the adjustment's."""
    cancel, adjustment = F.col("cancel_reason_name"), F.col("adjustment_reason_name")
    combined = F.when(
        cancel.isNull() | (cancel == fixed.NOT_MAPPED), adjustment
    ).otherwise(F.lower(cancel))
    kept = [c for c in orders.columns if c not in ("adjustment_reason_name", "adj_contact_reason")]
    return orders.select(*kept, combined.alias("adjustment_and_cancel_reason_combined"))


def order_detail(reasoned: DataFrame, reason_map: DataFrame, report: str) -> DataFrame:
    """Adds the adjustment and concession groups, and in report A the total cost.

    The map is met by its lower-cased text. A text that is in the map twice gives
    an order two rows.
    """
    groups = reason_map.select(
        F.lower("cancel_reason_name").alias("_text"), F.col("cancel_group").alias("_map_group")
    )
    rows = reasoned.withColumns(
        {
            "_text": F.lower("adjustment_and_cancel_reason_combined"),
            "_match": matchable(F.col("adjustment_and_cancel_reason_combined")),
            "_concession": matchable(F.col("fg_reason")),
        }
    )
    # Most orders have no reason either.
    rows = spread_left_join(rows, groups, ["_text"], by=["order_uuid"])
    gate = (
        f"WHEN cancel_group IS NOT NULL AND cancel_group <> {sql_text(fixed.OTHER_GROUP)} THEN _map_group"
    )
    fallback = f"coalesce(_map_group, {sql_text(fixed.NOT_GROUPED)})"

    def group(text: str) -> Column:
        return classify(text, fixed.GROUP_RULES, fallback, gate)

    # One select: the concession group reads the reason before the reason is filled.
    replaced = {
        "fg_reason": F.when(
            (F.col("cp_care_concession_awarded_amount") < 0) & F.col("fg_reason").isNull(),
            F.col("adjustment_and_cancel_reason_combined"),
        ).otherwise(F.col("fg_reason"))
    }
    added = {"adjustment_group": group("_match"), "fg_group": group("_concession")}
    dropped = ()
    if report == "a":
        replaced["cp_redelivery_cost"] = or_zero("cp_redelivery_cost")
        added["total_care_cost"] = total_cost()
        dropped = ("cp_grub_care_refund",)
    return rows.select(
        *[
            replaced[name].alias(name) if name in replaced else F.col(name)
            for name in reasoned.columns
            if name not in dropped
        ],
        *[column.alias(name) for name, column in added.items()],
    )
