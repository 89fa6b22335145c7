
from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careledger.functions import fixed_values as fixed
from careledger.functions.columns import classify, matchable, sql_text
from careledger.functions.windows import PaddedWindow, RollingWindow
from careledger.operators import checks, events, orders
from careledger.operators.deliveries import delivery_first_leg, delivery_legs
from careledger.operators.joins import Side, join_order_sides, spread_left_join
from careledger.operators.selection import exact_percentiles
from careledger.operators.timeline import order_events, transitions
from careledger.params import Params
from careledger.plans.report_a import labelled, market, report_a, stages_a
from careledger.plans.report_b import reason_group as reason_group_b
from careledger.plans.report_b import report_b, stages_b, total_cost
from careledger.plans.rollup import order_bitmaps, roll_up
from careledger.plans.sweep import sweep
from careledger.sources.fixtures import fixture_tables
from oracle import oracle_queries

# The training-data operators and what they need can be left out of an installation.
try:
    import corpus_pipeline  # noqa: F401
    from careledger.llm.catalog import corpus_queries, corpus_sql
except ImportError:
    HAS_CORPUS = False
else:
    HAS_CORPUS = True

Tables = Mapping[str, DataFrame]

PARAMS = Params(
    start=date(1997, 1, 1),
    end=date(1997, 12, 31),
    as_of=date(2001, 8, 2),
    platform_payer="PLATFORM",
    flagged_regions=frozenset({"NATION_0", "NATION_5", "NATION_10"}),
)
WINDOW_A = PaddedWindow(PARAMS.start, PARAMS.end)
WINDOW_B = RollingWindow(PARAMS.as_of, PARAMS.months)

# Overlapping windows of different length, so that "latest in the window" differs.
SWEEP = [
    ("1996", date(1996, 1, 1), date(1996, 12, 31)),
    ("1997", date(1997, 1, 1), date(1997, 12, 31)),
    ("1997-q1", date(1997, 1, 1), date(1997, 3, 31)),
    ("1997-q2", date(1997, 4, 1), date(1997, 6, 30)),
    ("1997-q3", date(1997, 7, 1), date(1997, 9, 30)),
    ("1997-q4", date(1997, 10, 1), date(1997, 12, 31)),
    ("1997-mid", date(1997, 2, 15), date(1997, 8, 15)),
    ("1998", date(1998, 1, 1), date(1998, 12, 31)),
]


def cost_by_market(t: Tables) -> DataFrame:
    """The smallest slice of report A: no reasons, two inputs."""
    legs = delivery_legs(t["deliveries"], WINDOW_A, PARAMS.flagged_regions).select(
        "order_uuid", market(F.col("CA_Market"), F.col("NYC_Market")).alias("cany_ind")
    )
    costs = orders.managed_orders(t["order_profit"], WINDOW_A).withColumn(
        "cp_care_ticket_cost", orders.ticket_cost()
    )
    sides = [Side(legs, how="inner", unique=False)]
    rows = join_order_sides(costs, sides, ["order_uuid"], PARAMS.hot_orders)
    return rows.groupBy("cany_ind").agg(
        F.count("order_uuid").alias("orders"),
        F.count_distinct("order_uuid").alias("distinct_order_uuid"),
        F.sum(orders.total_cost()).cast("decimal(18,2)").alias("total_care_cost"),
        F.count_if("managed_delivery_ind").alias("ghd_orders"),
    )


def reasons(t: Tables) -> DataFrame:
    return events.ticket_reasons(
        t["tickets"], t["contact_reason_primary"], t["contact_reason_secondary"]
    )


def cancelled(t: Tables) -> DataFrame:
    own = events.self_service_cancels(t["self_service_cancels"], WINDOW_A)
    return events.cancels(
        t["cancellations"], t["cancel_reason_map"], reasons(t), own, WINDOW_A
    )


def reason_normalised(t: Tables) -> DataFrame:
    """The reason rules over every free text of the inputs, with their counts."""
    texts = (
        t["part"]
        .select(F.lit("part").alias("source"), F.col("p_name").alias("text"))
        .unionByName(t["adjustments"].select(F.lit("adjustment").alias("source"), F.col("reason").alias("text")))
        .unionByName(reasons(t).select(F.lit("ticket").alias("source"), F.col("contact_reason").alias("text")))
        .groupBy("source", "text")
        .agg(F.count("*").alias("n"))
    )
    return orders.normal_reason(texts, "text", "normal")


def reason_group(t: Tables) -> DataFrame:
    rows = reason_normalised(t)
    group = classify("_match", fixed.GROUP_RULES, sql_text(fixed.NOT_GROUPED))
    return rows.withColumn("_match", matchable(F.col("normal"))).select(
        *rows.columns, group.alias("reason_group")
    )


def money_scale(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    amounts = t["lineitem"].select(
        price.cast("decimal(18,2)").alias("price"),
        (price.cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).alias("discount"),
    )
    detail = stages_a(t, PARAMS)["o3"]
    return checks.money_scale(amounts, "lineitem", ["price", "discount"]).unionByName(
        checks.money_scale(detail, "order_detail_a", ["total_care_cost"])
    )


def value_set(t: Tables) -> DataFrame:
    names = ["adjustment_group", "fg_group", "care_cost_group", "ghd_ind", "mealtime", "order_uuid"]
    return checks.value_set(stages_a(t, PARAMS)["o3"], "order_detail_a", names).unionByName(
        checks.value_set(t["adjustments"], "adjustments", ["reason", "direction", "payer"])
    )


def filter_coverage(t: Tables) -> DataFrame:
    c = F.col
    covered = [
        checks.filter_coverage(
            t["tickets"],
            "tickets",
            {
                "window": WINDOW_A.holds(c("ticket_created_date")),
                "before_as_of": c("ticket_created_date") < F.lit(PARAMS.as_of),
                "has_order": c("order_uuid").isNotNull(),
                "worked": c("cpo_contact_indicator") == 1,
                "secondary_known": c("secondary_contact_reason") <= 110,
            },
        ),
        checks.filter_coverage(
            t["adjustments"],
            "adjustments",
            {
                "window": c("adjustment_dt").between(19961231, 19980101),
                "refund": c("direction") == fixed.REFUND_DIRECTION,
                "platform": c("payer") == PARAMS.platform_payer,
            },
        ),
        checks.filter_coverage(
            t["order_profit"],
            "order_profit",
            {
                "window": WINDOW_A.holds(c("order_date")),
                "managed": c("managed_delivery_ind"),
            },
        ),
    ]
    return reduce(DataFrame.unionByName, covered)


def early_filter(t: Tables) -> DataFrame:
    """Refund filters before the ticket join give what filters after it give."""
    early = events.latest_adjustment(
        t["adjustments"], reasons(t), WINDOW_A, PARAMS.platform_payer
    )
    tickets = WINDOW_A.within(reasons(t), "ticket_created_date").select(
        "ticket_id", "contact_reason"
    )
    joined = spread_left_join(t["adjustments"], tickets, ["ticket_id"])
    kept = WINDOW_A.within_int(joined, "adjustment_dt").filter(
        (F.col("direction") == fixed.REFUND_DIRECTION) & (F.col("payer") == PARAMS.platform_payer)
    )
    last = F.max(F.struct("adjustment_timestamp_utc", "adjustment_id", "reason", "contact_reason"))
    late = (
        kept.groupBy("order_uuid")
        .agg(last.alias("last"))
        .select(
            "order_uuid",
            F.col("last.reason").alias("adjustment_reason_name"),
            F.col("last.contact_reason").alias("adj_contact_reason"),
        )
    )
    return checks.same_rows(early, late)


def reason_sources(t: Tables) -> DataFrame:
    """Tickets whose reason is not their primary one, by comparing the two names of all tickets as bags."""
    named = reasons(t)
    preferred = named.select("ticket_id", "order_uuid", F.col("contact_reason").alias("name"))
    primary = named.select("ticket_id", "order_uuid", F.col("primary_name").alias("name"))
    return checks.same_rows_by_parts(preferred, primary, ["ticket_id"])


def join_audit(t: Tables) -> DataFrame:
    """Every join of the two reports, on the inputs or stages it really reads."""
    c = F.col
    stages = stages_a(t, PARAMS)
    order = c("order_uuid")
    ticket = c("ticket_id")
    profit = t["order_profit"]
    audits = [
        ("adjustments-tickets", t["adjustments"], t["tickets"], ticket, ticket),
        ("concessions-tickets", t["concessions"], t["tickets"], ticket, ticket),
        (
            "cancellations-tickets",
            t["cancellations"],
            t["tickets"],
            c("cancellation_ticket_id").cast("bigint"),
            ticket,
        ),
        (
            "tickets-primary_reason",
            t["tickets"],
            t["contact_reason_primary"],
            c("primary_contact_reason"),
            c("contact_reason_id"),
        ),
        (
            "tickets-secondary_reason",
            t["tickets"],
            t["contact_reason_secondary"],
            c("secondary_contact_reason"),
            c("contact_reason_id"),
        ),
        (
            "cancellations-reason_map",
            t["cancellations"],
            t["cancel_reason_map"],
            c("primary_cancel_reason_id"),
            c("cancel_reason_id").cast("string"),
        ),
        ("cancellations-self_service", t["cancellations"], stages["diner_ss_cancels"], order, order),
        ("profit-deliveries", profit, stages["mdf"], order, order),
        ("profit-cancels", profit, stages["cancels"], order, order),
        ("profit-adjustment", profit, stages["adj"], order, order),
        ("profit-claim", profit, stages["ghg"], order, order),
        ("profit-concession", profit, stages["care_fg"], order, order),
        ("profit-contact", profit, stages["contacts"], order, order),
        (
            "contact-cost_map",
            stages["contacts"],
            t["contact_reason_cost_map"],
            c("latest_contact_reason"),
            c("scr"),
        ),
        (
            "order-reason_map",
            stages["o2"],
            t["cancel_reason_map"],
            F.lower("adjustment_and_cancel_reason_combined"),
            F.lower("cancel_reason_name"),
        ),
        ("attributes-merchants", t["order_attributes"], t["merchants"], c("cust_id"), c("cust_id")),
        ("attributes-locations", t["order_attributes"], t["order_locations"], order, order),
        (
            "locations-blockgroups",
            t["order_locations"],
            t["blockgroups"],
            c("dropoff_blockgroup_geoid"),
            c("blockgroup_geoid"),
        ),
    ]
    return checks.join_audits(audits)


def join_audit_b(t: Tables) -> DataFrame:
    """The joins that only report B has, on the stages that it really joins."""
    stages = stages_b(t, PARAMS)
    order, profit = F.col("order_uuid"), t["order_profit"]
    names = {"first_leg": "mdf", "merchant_refunds": "rest_refunds", "milestones": "osmf", "attributes": "of"}
    return checks.join_audits(
        [(f"profit-{name}", profit, stages[stage], order, order) for name, stage in names.items()]
        + [("windowed_attributes-locations", stages["of"], t["order_locations"], order, order)]
    )


def checks_b(t: Tables) -> DataFrame:
    """The column checks over the order detail of report B."""
    detail, stage = stages_b(t, PARAMS)["o3"], "order_detail_b"
    costs = {"cp_diner_adj": True, "cp_care_ticket_cost": True, "cp_redelivery_cost": True, "tip": False}
    found = [
        checks.in_window(detail, stage, ["date1"], WINDOW_B),
        checks.value_range(detail, stage, {"tip": (0, 50), "rr_refund": (0, 5)}),
        checks.sign_check(detail, stage, costs),
        checks.allowed_values(
            detail, stage, {"tri_state_ind": ("Tri-State", "Other"), "ghd_ind": ("ghd", "non-ghd")}
        ),
    ]
    return reduce(DataFrame.unionByName, found)


def orders_rolled_up(t: Tables) -> DataFrame:
    """The distinct orders of report B by day, by reason group and by managed flag, from one set of bitmaps."""
    detail = stages_b(t, PARAMS)["o3"].withColumn("_total", total_cost())
    rows = detail.withColumn("care_cost_reason_group", reason_group_b())
    levels = ("date1", "care_cost_reason_group", "ghd_ind")
    bitmaps = order_bitmaps(rows, levels, parts=8)
    found = [
        roll_up(bitmaps, [level]).select(
            F.lit(level).alias("dimension"), F.col(level).cast("string").alias("value"), "orders"
        )
        for level in levels
    ]
    return reduce(DataFrame.unionByName, found)


def _detail_a(t: Tables) -> DataFrame:
    return stages_a(t, PARAMS)["o3"]


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "cost_by_market": cost_by_market,
    "ticket_reasons": reasons,
    "latest_adjustment": lambda t: events.latest_adjustment(
        t["adjustments"], reasons(t), WINDOW_A, PARAMS.platform_payer
    ),
    "guarantee_claims": lambda t: events.guarantee_claims(t["guarantee_claims"], WINDOW_A),
    "latest_concession": lambda t: events.latest_concession(t["concessions"], reasons(t), WINDOW_A),
    "self_service_cancels": lambda t: events.self_service_cancels(
        t["self_service_cancels"], WINDOW_A
    ),
    "contacts": lambda t: events.contacts(reasons(t), WINDOW_A, F.lit(PARAMS.as_of)),
    "contacts_automated": lambda t: events.contacts(
        reasons(t), WINDOW_B, F.lit(PARAMS.as_of), automated=True
    ),
    "cancels": cancelled,
    "delivery_legs": lambda t: delivery_legs(t["deliveries"], WINDOW_A, PARAMS.flagged_regions),
    "delivery_first_leg": lambda t: delivery_first_leg(t["deliveries"], WINDOW_B),
    "reason_normalised": reason_normalised,
    "reason_group": reason_group,
    "order_joined_a": lambda t: stages_a(t, PARAMS)["o"],
    "order_reasoned_a": lambda t: stages_a(t, PARAMS)["o2"],
    "order_detail_a": _detail_a,
    "report_a": lambda t: report_a(t, PARAMS),
    "order_milestones": lambda t: events.order_milestones(t["order_milestones"], WINDOW_B),
    "order_attributes": lambda t: events.order_attributes(
        t["order_attributes"], t["merchants"], WINDOW_B
    ),
    "merchant_refunds": lambda t: events.merchant_refunds(t["transactions"], WINDOW_B),
    "order_geography": lambda t: events.order_geography(t["order_locations"], t["blockgroups"]),
    "order_joined_b": lambda t: stages_b(t, PARAMS)["o"],
    "order_detail_b": lambda t: stages_b(t, PARAMS)["o3"],
    "report_b": lambda t: report_b(t, PARAMS),
    "sweep_window_region": lambda t: sweep(t, PARAMS, SWEEP),
    "check_numeric_text": lambda t: checks.numeric_text(
        t["cancellations"],
        "cancellations",
        ["primary_cancel_reason_id", "cancellation_ticket_id", "order_uuid"],
    ),
    "check_value_set": value_set,
    "check_money_scale": money_scale,
    "check_filter_coverage": filter_coverage,
    "check_early_filter": early_filter,
    "check_reason_sources": reason_sources,
    "check_in_window": lambda t: checks.in_window(
        _detail_a(t), "order_detail_a", ["date1", "date2", "start_of_week"], WINDOW_A
    ),
    "check_value_range": lambda t: checks.value_range(
        _detail_a(t),
        "order_detail_a",
        {
            "total_care_cost": (-5000, 0),
            "month": (1, 12),
            "week": (1, 53),
            "tip": (0, 50),
            "cp_care_ticket_cost": (-2, 0),
        },
    ),
    "check_time_order": lambda t: checks.time_order(
        t["deliveries"],
        "deliveries",
        [
            ("order_created_time_utc", "eta_at_order_placement_time_utc"),
            ("order_created_time_utc", "dropoff_complete_time_utc"),
            ("eta_at_order_placement_time_utc", "dropoff_complete_time_utc"),
            ("click_start_time_local", "cancelled_time_local"),
            ("order_created_time_utc", "order_created_time_local"),
        ],
    ),
    "check_transitions": lambda t: transitions(order_events(t)),
    "check_sign": lambda t: checks.sign_check(
        _detail_a(t),
        "order_detail_a",
        {
            "cp_diner_adj": True,
            "cp_care_concession_awarded_amount": True,
            "cp_care_ticket_cost": True,
            "cp_redelivery_cost": True,
            "tip": False,
            "driver_pay_per_order": False,
            "diner_ty_eta": False,
            "cancel_mins": False,
        },
    ),
    "check_allowed_values": lambda t: checks.allowed_values(
        labelled(_detail_a(t)),
        "report_a",
        {
            "cany_ind": fixed.MARKETS,
            "care_cost_reason_group": fixed.REASON_GROUPS,
            "eta_care_reasons": fixed.ETA_FLAGS,
        },
    ),
    "check_fanout": lambda t: checks.fanout(
        report_a(t, PARAMS), ["cany_ind", "care_cost_reason_group", "eta_care_reasons"]
    ),
    "join_audit": join_audit,
    "stage_counts": lambda t: checks.stage_counts(stages_a(t, PARAMS), same={"o2": "o"}),
    "order_reasoned_b": lambda t: stages_b(t, PARAMS)["o2"],
    "join_audit_b": join_audit_b,
    "check_report_b": checks_b,
    "stage_counts_b": lambda t: checks.stage_counts(stages_b(t, PARAMS), same={"o2": "o"}),
    "report_b_orders_rolled_up": orders_rolled_up,
    "check_exact_percentiles": lambda t: exact_percentiles(
        _detail_a(t),
        "order_detail_a",
        ["total_care_cost", "tip", "diner_ty_eta", "cp_care_concession_awarded_amount", "cp_diner_adj"],
        (0.01, 0.25, 0.5, 0.75, 0.99),
    ),
    "check_percentiles": lambda t: checks.counted_percentiles(
        _detail_a(t),
        "order_detail_a",
        {"total_care_cost": 0, "tip": 1, "diner_ty_eta": 1, "cp_care_concession_awarded_amount": 0},
    ),
}


def entry(spark: SparkSession) -> DataFrame:
    """Report A on the smallest tables."""
    return report_a(fixture_tables(spark, "/root/testdata/sf0.001"), PARAMS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each reads its tables from ``sf_dir``."""

    def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(fixture_tables(spark, sf_dir))

    named = {name: bind(query) for name, query in QUERIES.items()}
    return named | (corpus_queries() if HAS_CORPUS else {})


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL over the driver's tables."""
    return oracle_queries(SWEEP) | (corpus_sql() if HAS_CORPUS else {})
