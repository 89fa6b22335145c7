"""Report B: the wide report over the last six months, 18 dimensions and 24 measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.windows import RollingWindow
from careledger.operators import events
from careledger.operators.deliveries import delivery_first_leg
from careledger.operators.joins import (
    Hot,
    Side,
    join_order_branches,
    join_order_sides,
    left_join_unique,
)
from careledger.operators.orders import (
    JOINED_B,
    cancel_columns,
    cancelled_late,
    cents,
    order_detail,
    order_joined,
    order_reasoned,
    recent_orders,
    total_cost,
)
from careledger.params import Params
from careledger.plans.measures import amount, copies_of, number, summarise
from careledger.plans.report_a import reason_sides

Tables = Mapping[str, DataFrame]

KEYS = ["order_uuid"]
DIMENSIONS = (
    "date1",
    "ghd_ind",
    "delivery_ind",
    "cancel_fact_ind",
    "adjustment_group",
    "adjustment_and_cancel_reason_combined",
    "ghd_late_ind",
    "ghd_late_ind_incl_cancel_time",
    "bundle_ind",
    "shop_and_pay_ind",
    "automated_ind",
    "modified_cbsa_name",
    "key_cities_cbsa",
    "ghd_delivery_region_name",
    "large_order_ind",
    "tri_state_ind",
)
REASONS = ("care_cost_reason_group", "care_cost_reason")
MEASURES = (
    "orders",
    "cancels",
    "missed_revenue_cp",
    "cp_diner_adj",
    "cp_care_concession_awarded_amount",
    "cp_care_ticket_cost",
    "redelivery_cost",
    "cp_grubcash_care_concession_awarded_amount",
    "cp_grubcare_refund",
    "rr_refund",
    "cp_total_care_cost",
    "ghd_late_count",
    "ghd_orders",
    "driver_pay_cpf",
    "tip",
    "true_up",
    "orders_with_adjustments",
    "orders_with_fg",
    "orders_with_redelivery",
    "orders_with_gh_credit",
    "orders_with_gh_credit_refund",
    "orders_with_rr_refund",
    "orders_with_care_cost",
    "cancels_osmf_definition",
)
# Report columns that are plain sums, and the order column each one adds up.
SUMS = {
    "cp_diner_adj": "cp_diner_adj",
    "cp_care_concession_awarded_amount": "cp_care_concession_awarded_amount",
    "cp_care_ticket_cost": "cp_care_ticket_cost",
    "redelivery_cost": "cp_redelivery_cost",
    "cp_grubcash_care_concession_awarded_amount": "cp_grubcash_care_concession_awarded_amount",
    "cp_grubcare_refund": "cp_grub_care_refund",
    "rr_refund": "rr_refund",
    "cp_total_care_cost": "_total",
    "driver_pay_cpf": "driver_pay_per_order",
    "tip": "tip",
    "true_up": "true_up",
}
# Report columns that count orders with a negative amount, and the amount.
NEGATIVES = {
    "orders_with_adjustments": "cp_diner_adj",
    "orders_with_fg": "cp_care_concession_awarded_amount",
    "orders_with_redelivery": "cp_redelivery_cost",
    "orders_with_gh_credit": "cp_grubcash_care_concession_awarded_amount",
    "orders_with_gh_credit_refund": "cp_grub_care_refund",
    "orders_with_care_cost": "_total",
}
_CANCEL = (
    "order_status_cancel_ind",
    "cancel_group",
    "cancel_reason_name",
    "cancel_contact_normal",
    "cancel_fact_ind",
)
_PROFIT = (
    "managed_delivery_ind",
    "delivery_ind",
    "cancelled_order_ind",
    "cp_revenue",
    "tip",
    "cp_diner_adj",
    "cp_care_concession_awarded_amount",
    "cp_diner_care_tickets",
    "cp_driver_care_tickets",
    "cp_restaurant_care_tickets",
    "cp_gh_internal_care_tickets",
    "cp_driver_pay_per_order",
    "cp_driver_true_up",
    "cp_redelivery_cost",
    "cp_grubcash_care_concession_awarded_amount",
    "cp_grub_care_refund",
)


def event_stages(
    tables: Tables, params: Params, window: RollingWindow, keep_null: bool = True
) -> dict[str, DataFrame]:
    """The stages below the order level, by name; see :func:`events.cancels`."""
    reasons = events.ticket_reasons(
        tables["tickets"], tables["contact_reason_primary"], tables["contact_reason_secondary"]
    )
    own = events.self_service_cancels(tables["self_service_cancels"], window)
    return {
        "adj": events.latest_adjustment(
            tables["adjustments"], reasons, window, params.platform_payer
        ),
        "ghg": events.guarantee_claims(tables["guarantee_claims"], window),
        "care_fg": events.latest_concession(tables["concessions"], reasons, window),
        "diner_ss_cancels": own,
        "cancels": events.cancels(
            tables["cancellations"],
            tables["cancel_reason_map"],
            reasons,
            own,
            window,
            params.strict_ticket_ids,
            params.hot_orders,
            keep_null,
        ),
        "osmf": events.order_milestones(tables["order_milestones"], window),
        "of": events.order_attributes(tables["order_attributes"], tables["merchants"], window),
        "mdf": delivery_first_leg(tables["deliveries"], window),
        "rest_refunds": events.merchant_refunds(tables["transactions"], window),
        "contacts": events.contacts(reasons, window, F.lit(params.as_of), automated=True),
    }


def _unique_sides(stages: Mapping[str, DataFrame]) -> list[Side]:
    return [
        Side(stages["mdf"]),
        *reason_sides(stages, KEYS),
        Side(stages["contacts"].select(*KEYS, "latest_contact_reason", "automated_ind")),
        Side(stages["rest_refunds"]),
    ]


def stages_b(tables: Tables, params: Params) -> dict[str, DataFrame]:
    """Every stage by name, as lazy DataFrames; the report is ``final_output``."""
    window = RollingWindow(params.as_of, params.months)
    stages = event_stages(tables, params, window)
    geography = events.order_geography(
        tables["order_locations"], tables["blockgroups"], stages["of"]
    )
    joined = join_order_sides(
        recent_orders(tables["order_profit"], window),
        [
            Side(cancel_columns(stages["cancels"], KEYS), unique=False),
            *_unique_sides(stages),
            Side(stages["osmf"], unique=False),
            Side(events.located_attributes(stages["of"], geography, params.hot_orders), unique=False),
        ],
        KEYS,
        params.hot_orders,
    )
    stages["o"] = order_joined(joined, tables["contact_reason_cost_map"], "b", JOINED_B)
    stages["o2"] = order_reasoned(stages["o"])
    stages["o3"] = order_detail(stages["o2"], tables["cancel_reason_map"], "b")
    stages["final_output"] = summarise_b([stages["o3"]])
    return stages


def report_b(tables: Tables, params: Params) -> DataFrame:
    """The report alone; same rows as ``stages_b(..)["final_output"]``, less work.

    Cancellations, milestones and attributes that repeat for an order are counted
    before the joins and never multiplied out.
    """
    window = RollingWindow(params.as_of, params.months)
    stages = event_stages(tables, params, window, keep_null=False)
    geography = events.order_geography(
        tables["order_locations"], tables["blockgroups"], stages["of"]
    )
    reached = F.col("status_cancelled_reached_ind")
    milestones = (
        stages["osmf"]
        .groupBy(*KEYS)
        .agg(F.count("*").alias("_milestones"), F.count_if(reached).alias("_reached"))
    )
    parts = join_order_branches(
        # Only what is needed, so that equal rows of a hot order become one.
        recent_orders(tables["order_profit"], window).select(
            *KEYS, F.col("delivery_time_ct").cast("date").alias("delivery_time_ct"), *_PROFIT
        ),
        [
            Side(_outcomes(stages["cancels"], stages["mdf"], params.hot_orders), unique=False, copies="_cancels"),
            *_unique_sides(stages),
            Side(milestones),
            Side(
                events.counted_attributes(stages["of"], geography, params.hot_orders),
                unique=False,
                copies="_attributes",
            ),
        ],
        KEYS,
        params.hot_orders,
    )
    with_milestones = {
        "reached_copies": F.col("copies") * F.coalesce("_reached", F.lit(0)),
        "copies": F.col("copies") * F.coalesce("_milestones", F.lit(1)),
    }
    needed = [
        name
        for name in JOINED_B
        if name not in ("adj_contact_reason", "cancel_contact_reason", "status_cancelled_reached_ind")
    ]
    needed += ["copies", "reached_copies"]
    joined = [
        order_joined(
            part.withColumns(with_milestones), tables["contact_reason_cost_map"], "b", needed
        )
        for part in parts
    ]
    return summarise_b(
        [order_detail(order_reasoned(o), tables["cancel_reason_map"], "b") for o in joined]
    )


def _outcomes(cancelled: DataFrame, first_leg: DataFrame, hot: Hot) -> DataFrame:
    """Cancellations as distinct outcomes, with their number in ``_cancels``.

    Whether a cancellation came after the promised time needs the first leg, so it
    is settled here and the cancel time itself need not be kept apart.
    """
    leg = first_leg.select(*KEYS, "ghd_eta_utc", "dropoff_complete_time_utc")
    after = cancelled_late(
        F.col("cancel_time_utc"), F.col("ghd_eta_utc"), F.col("dropoff_complete_time_utc")
    )
    return (
        left_join_unique(cancel_columns(cancelled, KEYS), leg, KEYS, hot)
        .groupBy(*KEYS, *_CANCEL, after.alias("cancelled_late"))
        .agg(F.count("*").alias("_cancels"))
    )


def reason_group() -> Column:
    """As in report A, with redelivered orders second."""
    chain = F.when(F.col("_total") == 0, fixed.NO_CARE_COST).when(
        F.col("cp_redelivery_cost") < 0, fixed.REDELIVERY_GROUP
    )
    for name in ("adjustment_group", "fg_group", "care_cost_group"):
        chain = chain.when(F.col(name) != fixed.NOT_GROUPED, F.col(name))
    return F.lower(chain.otherwise(fixed.NOT_GROUPED))


def care_reason() -> Column:
    reason = F.lower(
        F.coalesce("adjustment_and_cancel_reason_combined", "fg_reason", "care_cost_reason")
    )
    return F.when(F.col("cp_redelivery_cost") < 0, fixed.REDELIVERY_REASON).otherwise(reason)


def summarise_b(parts: Sequence[DataFrame]) -> DataFrame:
    """The 24 measures of report B by its 18 dimensions."""
    copies = copies_of(parts[0])
    if "reached_copies" in parts[0].columns:
        reached = F.col("reached_copies")
    else:
        reached = number(F.col("status_cancelled_reached_ind"), copies)
    missed = (reached > 0) & (F.col("cancelled_order_ind") == F.lit(False))
    counts = {
        "cancels": number(F.col("cancel_fact_ind"), copies),
        "ghd_late_count": number(F.col("ghd_late_ind") == 1, copies),
        "ghd_orders": number(F.col("ghd_ind") == "ghd", copies),
        "orders_with_rr_refund": number(F.abs("rr_refund") > 0, copies),
        "cancels_osmf_definition": number(
            F.col("order_status_cancel_ind") & F.col("order_uuid").isNotNull(), copies
        ),
    }
    counts |= {name: number(F.col(cost) < 0, copies) for name, cost in NEGATIVES.items()}
    amounts = {"missed_revenue_cp": F.when(missed, cents(F.col("cp_revenue")) * reached)}
    amounts |= {name: amount(cost, copies) for name, cost in SUMS.items()}
    rows = [part.withColumn("_total", total_cost()) for part in parts]
    # The reason dimension takes the name of the column it is made from.
    rows = [
        part.withColumns(
            {"care_cost_reason_group": reason_group(), "care_cost_reason": care_reason()}
        )
        for part in rows
    ]
    return summarise(
        rows, [*DIMENSIONS, *REASONS], distinct="orders", counts=counts, amounts=amounts
    ).select(*DIMENSIONS, *REASONS, *MEASURES)
