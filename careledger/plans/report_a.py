"""Report A: care cost by market, reason group and ETA flag for a date window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.windows import PaddedWindow, WindowSet
from careledger.operators import events
from careledger.operators.deliveries import delivery_legs
from careledger.operators.joins import Side, join_order_branches, join_order_sides
from careledger.operators.orders import (
    JOINED_A,
    adjustment_columns,
    cancel_columns,
    claim_columns,
    managed_orders,
    order_detail,
    order_joined,
    order_reasoned,
)
from careledger.params import Params
from careledger.plans.measures import amount, copies_of, number, summarise

Tables = Mapping[str, DataFrame]

# What the groups and measures of the report need from an order.
_NEEDED = (
    "order_uuid",
    "ghd_ind",
    "cp_diner_adj",
    "order_status_cancel_ind",
    "cancel_group",
    "cancel_reason_name",
    "adjustment_reason_name",
    "fg_reason",
    "care_cost_reason",
    "care_cost_group",
    "cp_care_concession_awarded_amount",
    "cp_grub_care_refund",
    "cp_redelivery_cost",
    "cp_care_ticket_cost",
)
MEASURES = (
    "orders",
    "distinct_order_uuid",
    "total_care_cost",
    "ghd_orders",
    "orders_with_care_cost",
    "cancels_osmf_definition",
)
LABELS = ("cany_ind", "care_cost_reason_group", "eta_care_reasons")
_PROFIT = (
    "managed_delivery_ind",
    "cp_diner_adj",
    "cp_care_concession_awarded_amount",
    "cp_diner_care_tickets",
    "cp_driver_care_tickets",
    "cp_restaurant_care_tickets",
    "cp_gh_internal_care_tickets",
    "cp_redelivery_cost",
    "cp_grub_care_refund",
)
_CANCEL = ("order_status_cancel_ind", "cancel_group", "cancel_reason_name", "cancel_contact_normal")


def market(ca: Column, flagged: Column) -> Column:
    """The market label of a leg."""
    return F.when(ca == "CA", "CA").when(flagged == "DCWP", "DCWP").otherwise("ROM")


def event_stages(
    tables: Tables, params: Params, window: PaddedWindow | WindowSet, keep_null: bool = True
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
        "mdf": delivery_legs(tables["deliveries"], window, params.flagged_regions),
        "contacts": events.contacts(reasons, window, F.lit(params.as_of)),
    }


def reason_sides(stages: Mapping[str, DataFrame], keys: Sequence[str]) -> list[Side]:
    """The sides with one row per order, reduced to the columns in use."""
    return [
        Side(adjustment_columns(stages["adj"])),
        Side(claim_columns(stages["ghg"], keys, "claim_normal")),
        Side(claim_columns(stages["care_fg"], keys, "concession_normal")),
    ]


def stages_a(
    tables: Tables, params: Params, window: PaddedWindow | None = None
) -> dict[str, DataFrame]:
    """Every stage by name, as lazy DataFrames; the report is ``final_output``."""
    window = window or PaddedWindow(params.start, params.end)
    keys = ["order_uuid", *window.keys]
    stages = event_stages(tables, params, window)
    joined = join_order_sides(
        managed_orders(tables["order_profit"], window),
        [
            Side(stages["mdf"], how="inner", unique=False),
            Side(cancel_columns(stages["cancels"], keys), unique=False),
            *reason_sides(stages, keys),
            Side(stages["contacts"].select(*keys, "latest_contact_reason")),
        ],
        keys,
        params.hot_orders,
    )
    stages["o"] = order_joined(
        joined, tables["contact_reason_cost_map"], "a", [*JOINED_A, *window.keys]
    )
    stages["o2"] = order_reasoned(stages["o"])
    stages["o3"] = order_detail(stages["o2"], tables["cancel_reason_map"], "a")
    stages["final_output"] = summarise_a([labelled(stages["o3"])], LABELS)
    return stages


def labelled(orders: DataFrame) -> DataFrame:
    """Orders with the three dimensions of the report."""
    labels = {"care_cost_reason_group": reason_group(), "eta_care_reasons": eta_flag()}
    if "cany_ind" not in orders.columns:
        labels["cany_ind"] = market(F.col("CA_Market"), F.col("NYC_Market"))
    return orders.withColumns(labels)


def report_a(tables: Tables, params: Params) -> DataFrame:
    """The report alone; same rows as ``stages_a(..)["final_output"]``, less work.

    Repeated rows of an order are counted before the joins and never multiplied
    out: legs become one count per market, cancellations one row per outcome.
    """
    window = PaddedWindow(params.start, params.end)
    legs = F.col("cany_ind")
    by_order = (
        delivery_legs(tables["deliveries"], window, params.flagged_regions)
        .select("order_uuid", market(F.col("CA_Market"), F.col("NYC_Market")).alias("cany_ind"))
        .groupBy("order_uuid")
        .agg(*[F.count_if(legs == name).alias(f"_{name}") for name in fixed.MARKETS])
    )
    markets = F.array(
        *[
            F.struct(F.lit(name).alias("cany_ind"), F.col(f"_{name}").alias("legs"))
            for name in fixed.MARKETS
        ]
    )

    def by_market(orders: DataFrame) -> DataFrame:
        rows = orders.withColumn("_leg", F.explode(F.filter(markets, lambda m: m["legs"] > 0)))
        return rows.withColumns(
            {"cany_ind": F.col("_leg.cany_ind"), "copies": F.col("copies") * F.col("_leg.legs")}
        )

    parts = counted_orders(tables, params, window, Side(by_order, how="inner"))
    return summarise_a([labelled(by_market(part)) for part in parts], LABELS)


def counted_orders(
    tables: Tables, params: Params, window: PaddedWindow | WindowSet, legs: Side
) -> list[DataFrame]:
    """Orders with groups and total cost, repeated rows counted in ``copies``.

    Parts that share no order, see :func:`join_order_branches`.
    """
    keys = ["order_uuid", *window.keys]
    stages = event_stages(tables, params, window, keep_null=False)
    outcomes = (
        cancel_columns(stages["cancels"], keys)
        .groupBy(*keys, *_CANCEL)
        .agg(F.count("*").alias("_cancels"))
    )
    parts = join_order_branches(
        # Only what is needed, so that equal rows of a hot order become one.
        managed_orders(tables["order_profit"], window).select(*keys, *_PROFIT),
        [
            legs,
            Side(outcomes, unique=False, copies="_cancels"),
            *reason_sides(stages, keys),
            Side(stages["contacts"].select(*keys, "latest_contact_reason")),
        ],
        keys,
        params.hot_orders,
    )
    carried = [c for c in legs.rows.columns if c not in keys and c != legs.copies]
    needed = [*_NEEDED, *window.keys, *carried, "copies"]
    joined = [order_joined(p, tables["contact_reason_cost_map"], "a", needed) for p in parts]
    return [order_detail(order_reasoned(o), tables["cancel_reason_map"], "a") for o in joined]


def reason_group() -> Column:
    """First group that says something, in lower case."""
    chain = F.when(F.col("total_care_cost") == 0, fixed.NO_CARE_COST)
    for name in ("adjustment_group", "fg_group", "care_cost_group"):
        chain = chain.when(F.col(name) != fixed.NOT_GROUPED, F.col(name))
    return F.lower(chain.otherwise(fixed.NOT_GROUPED))


def eta_flag() -> Column:
    reason = F.lower(
        F.coalesce("adjustment_and_cancel_reason_combined", "fg_reason", "care_cost_reason")
    )
    return F.when(reason.isin(*fixed.ETA_REASONS), "ETA Issues").otherwise("Other")


def summarise_a(parts: Sequence[DataFrame], dimensions: Sequence[str]) -> DataFrame:
    """The six measures of report A by any dimensions."""
    copies = copies_of(parts[0])
    known = F.col("order_uuid").isNotNull()
    three_parts = (
        F.col("cp_diner_adj")
        + F.col("cp_care_concession_awarded_amount")
        + F.col("cp_care_ticket_cost")
    )
    return summarise(
        parts,
        dimensions,
        distinct="distinct_order_uuid",
        counts={
            "orders": number(known, copies),
            "ghd_orders": number(F.col("ghd_ind") == "ghd", copies),
            "orders_with_care_cost": number(three_parts < 0, copies),
            "cancels_osmf_definition": number(F.col("order_status_cancel_ind") & known, copies),
        },
        amounts={"total_care_cost": amount("total_care_cost", copies)},
    ).select(*dimensions, *MEASURES)
