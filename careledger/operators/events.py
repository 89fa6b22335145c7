"""Care events reduced to what an order needs to know about them.

All stages but :func:`cancels` give one row per order (and window). Aggregates
combine on the map side first, so an order with very many events sends few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.columns import latest, lookup, max_label
from careledger.functions.windows import Window
from careledger.operators.joins import Hot, Side, join_order_sides, left_join_unique, spread_left_join


def ticket_reasons(tickets: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Tickets with the names of their reasons; the secondary one is preferred."""
    first = primary.select(
        F.col("contact_reason_id").alias("primary_contact_reason"),
        F.col("name").alias("primary_name"),
    )
    second = secondary.select(
        F.col("contact_reason_id").alias("secondary_contact_reason"),
        F.col("name").alias("secondary_name"),
    )
    return (
        tickets.join(first, "primary_contact_reason", "left")
        .join(second, "secondary_contact_reason", "left")
        .select(
            *tickets.columns,
            "primary_name",
            "secondary_name",
            F.coalesce("secondary_name", "primary_name").alias("contact_reason"),
        )
    )


def _with_ticket(events: DataFrame, reasons: DataFrame, window: Window) -> DataFrame:
    """Events with the reason columns of their ticket, if it lies in the window.

    Most events of some kinds have no ticket; they match nothing and are spread. Every
    caller takes the same ticket columns, so one exchange of the tickets serves all.
    """
    tickets = window.within(reasons, "ticket_created_date").select(
        "ticket_id",
        *window.keys,
        "created_time",
        "primary_name",
        "secondary_name",
        "contact_reason",
    )
    return spread_left_join(events, tickets, ["ticket_id", *window.keys])


def _tie_break(df: DataFrame, column: str, payload: Column) -> Column:
    """The event's own id if the table has one, else the payload itself."""
    return F.col(column) if column in df.columns else payload


def latest_adjustment(
    adjustments: DataFrame, reasons: DataFrame, window: Window, payer: str
) -> DataFrame:
    """Reason and contact reason of the latest refund that the platform paid."""
    refunds = window.within_int(adjustments, "adjustment_dt").filter(
        (F.col("direction") == fixed.REFUND_DIRECTION) & (F.col("payer") == payer)
    )
    found = F.struct("reason", "contact_reason")
    pick = latest(
        found, F.col("adjustment_timestamp_utc"), _tie_break(adjustments, "adjustment_id", found)
    )
    return (
        _with_ticket(refunds, reasons, window)
        .groupBy("order_uuid", *window.keys)
        .agg(pick.alias("pick"))
        .select(
            "order_uuid",
            *window.keys,
            F.col("pick.reason").alias("adjustment_reason_name"),
            F.col("pick.contact_reason").alias("adj_contact_reason"),
        )
    )


def guarantee_claims(claims: DataFrame, window: Window) -> DataFrame:
    """Reason of the granted guarantee claims of an order (alphabetical maximum)."""
    granted = window.within(claims, "created_date").filter(F.col("decision") == fixed.GRANTED)
    return granted.groupBy(F.col("cart_uuid").alias("order_uuid"), *window.keys).agg(
        max_label(F.col("claim_type"), fixed.CLAIM_REASONS).alias("fg_reason")
    )


def latest_concession(concessions: DataFrame, reasons: DataFrame, window: Window) -> DataFrame:
    """Contact reason of the concession issued last, among those that expire in the window."""
    pick = latest(
        F.col("contact_reason"),
        F.col("issue_timestamp_utc"),
        _tie_break(concessions, "concession_id", F.col("contact_reason")),
    )
    return (
        _with_ticket(window.within_int(concessions, "expiration_dt"), reasons, window)
        .groupBy("order_uuid", *window.keys)
        .agg(pick.alias("fg_reason"))
    )


def self_service_cancels(results: DataFrame, window: Window) -> DataFrame:
    """Self-service cancellation code, reason and group, each the maximum on its own."""
    code = F.col("reason_code")
    return (
        window.within(results, "created_date")
        .groupBy(F.col("order_id").alias("order_uuid"), *window.keys)
        .agg(
            F.max(code).alias("reason_code"),
            max_label(code, fixed.SELF_SERVICE_REASONS).alias("diner_ss_cancel_reason"),
            max_label(code, fixed.SELF_SERVICE_GROUPS).alias("diner_ss_cancel_reason_group"),
        )
    )


def cancels(
    cancellations: DataFrame,
    reason_map: DataFrame,
    reasons: DataFrame,
    self_service: DataFrame,
    window: Window,
    strict: bool = True,
    hot: Hot | None = None,
    keep_null: bool = True,
) -> DataFrame:
    """Cancelled orders with the mapped or overridden reason and group.

    Not one row per order: a repeated cancellation or map row stays repeated.
    ``strict`` makes a ticket id that is not a number an error, as a cast does;
    otherwise it counts as "no ticket". ``keep_null=False`` leaves out rows without an
    order, which no order can meet.
    """
    ticket = F.col("cancellation_ticket_id")
    named = reason_map.select(
        F.col("cancel_reason_id").cast("string").alias("_reason_id"),
        F.col("cancel_reason_name").alias("_map_reason"),
        F.col("cancel_group").alias("_map_group"),
    )
    joined = _with_ticket(
        window.within(cancellations, "cancellation_date")
        .withColumn("ticket_id", ticket.cast("bigint") if strict else ticket.try_cast("bigint"))
        .withColumn("_reason_id", F.col("primary_cancel_reason_id").cast("string"))
        .join(named, "_reason_id", "left"),
        reasons,
        window,
    )
    keys = ["order_uuid", *window.keys]
    unknown = F.col("order_uuid").isNull()
    own = left_join_unique(joined.filter(~unknown), self_service, keys, hot)
    if keep_null:
        codes = [c for c in self_service.columns if c not in keys]
        own = own.unionByName(
            joined.filter(unknown).withColumns(
                {c: F.lit(None).cast(self_service.schema[c].dataType) for c in codes}
            )
        )
    joined = own
    lost = F.lower("order_status_cancel_reason").like(fixed.NOT_RECEIVED_LIKE)

    def override(mapped: str, own: str, when_lost: str) -> Column:
        return (
            F.when((F.col(mapped) == fixed.NOT_MAPPED) & F.col(own).isNotNull(), F.col(own))
            .when(lost, when_lost)
            .otherwise(F.col(mapped))
        )

    return joined.select(
        *keys,
        "order_status_cancel_ind",
        override("_map_group", "diner_ss_cancel_reason_group", fixed.NOT_RECEIVED_GROUP).alias(
            "cancel_group"
        ),
        override("_map_reason", "diner_ss_cancel_reason", fixed.NOT_RECEIVED_REASON).alias(
            "cancel_reason_name"
        ),
        F.col("primary_name").alias("cancel_pcr"),
        F.col("secondary_name").alias("cancel_scr"),
        F.coalesce("cancellation_time_utc", "created_time").alias("cancel_time_utc"),
        F.col("contact_reason").alias("cancel_contact_reason"),
    )


def contacts(reasons: DataFrame, window: Window, as_of: Column, automated: bool = False) -> DataFrame:
    """Latest worked contact of an order and the number of its contacts.

    ``automated`` adds whether the latest one was deflected by automation.
    """
    worked = window.within(reasons, "ticket_created_date").filter(
        (F.col("ticket_created_date") < as_of)
        & F.col("order_uuid").isNotNull()
        & (F.col("cpo_contact_indicator") == 1)
    )
    carried = ["ticket_id", "contact_reason"] + ["automation_deflected_ind"] * automated
    pick = latest(F.struct(*carried), F.col("created_time"), F.col("ticket_id"))
    found = [
        F.col("pick.ticket_id").alias("latest_ticket_id"),
        F.col("pick.contact_reason").alias("latest_contact_reason"),
    ]
    if automated:
        found.append(F.col("pick.automation_deflected_ind").alias("automated_ind"))
    return (
        worked.groupBy("order_uuid", *window.keys)
        .agg(pick.alias("pick"), F.count("ticket_id").alias("contacts"))
        .select("order_uuid", *window.keys, *found, "contacts")
    )


def order_milestones(milestones: DataFrame, window: Window) -> DataFrame:
    """Whether the order ever reached the cancelled status."""
    return window.within(milestones, "business_day").select(
        "order_uuid", "status_cancelled_reached_ind"
    )


def merchant_refunds(transactions: DataFrame, window: Window) -> DataFrame:
    """Single refunds paid by the merchant, from cents."""
    refunds = window.within(transactions, "created_date").filter(
        window.holds(F.col("transaction_time_ct"))
        & (F.col("transaction_type") == fixed.SINGLE_REFUND)
    )
    cents = F.sum("net_amount").cast("decimal(18,0)")
    return refunds.groupBy("order_uuid").agg(
        (cents * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(18,2)").alias("rr_refund_total")
    )


def order_attributes(order_fact: DataFrame, merchants: DataFrame, window: Window) -> DataFrame:
    """Area, delivery region and size band of an order."""
    area = F.col("modified_cbsa_name")
    size = F.col("food_and_beverage")
    recent = order_fact.filter(window.holds(F.col("delivery_time_ct").cast("date")))
    return (
        spread_left_join(recent, merchants.select("cust_id", "ghd_delivery_region_name"), ["cust_id"])
        .select(
            "order_uuid",
            "modified_cbsa_name",
            F.when(area.isin(*fixed.KEY_CITIES), area).otherwise("Other CBSA").alias(
                "key_cities_cbsa"
            ),
            "ghd_delivery_region_name",
            F.when(size > 1000, "Over $1000")
            .when(size > 250, "Over $250")
            .otherwise("Less than $250")
            .alias("large_order_ind"),
        )
    )


def order_geography(
    locations: DataFrame, blockgroups: DataFrame, orders: DataFrame | None = None
) -> DataFrame:
    """Tri-state flag of the block group where an order is dropped off.

    ``orders`` leaves only the locations of its orders, before anything else is done.
    """
    if orders is not None:
        locations = locations.join(orders.select("order_uuid"), "order_uuid", "left_semi")
    groups = blockgroups.filter(F.substring("blockgroup_geoid", 12, 1) != "0").select(
        F.col("blockgroup_geoid").alias("dropoff_blockgroup_geoid"), "csa_name"
    )
    return spread_left_join(locations, groups, ["dropoff_blockgroup_geoid"]).select(
        "order_uuid",
        F.when(F.col("csa_name") == fixed.TRI_STATE_CSA, "Tri-State")
        .otherwise("Other")
        .alias("tri_state_ind"),
    )


def located_attributes(
    attributes: DataFrame, geography: DataFrame, hot: Hot | None = None
) -> DataFrame:
    """Order attributes with the tri-state flag of every location of the order.

    The location is looked up from the attributes, so an order without attributes
    has none. NULL where an order with attributes has no location.
    """
    return join_order_sides(
        attributes, [Side(geography, unique=False)], ["order_uuid"], hot, keep_null=False
    )


def counted_attributes(
    attributes: DataFrame, geography: DataFrame, hot: Hot | None = None
) -> DataFrame:
    """:func:`located_attributes` as distinct rows, with their number in ``_attributes``."""
    tri_state = F.col("tri_state_ind") == "Tri-State"
    flags = geography.groupBy("order_uuid").agg(
        F.count_if(tri_state).alias("_tri_state"), F.count_if(~tri_state).alias("_other")
    )
    places = F.array(
        F.struct(F.lit("Tri-State").alias("flag"), F.col("_tri_state").alias("n")),
        F.struct(F.lit("Other").alias("flag"), F.coalesce("_other", F.lit(1)).alias("n")),
    )
    return (
        left_join_unique(
            attributes.filter(F.col("order_uuid").isNotNull()), flags, ["order_uuid"], hot
        )
        .withColumn("_place", F.explode(F.filter(places, lambda p: p["n"] > 0)))
        .groupBy(*attributes.columns, F.col("_place.flag").alias("tri_state_ind"))
        .agg(F.sum("_place.n").alias("_attributes"))
    )
