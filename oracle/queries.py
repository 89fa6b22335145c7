"""The oracle SQL of every registered query."""

from __future__ import annotations

from datetime import date, timedelta

from oracle import texts as fixed
from oracle.ctes import AS_OF, MEASURES_A, build, in_list, windows

DAY = timedelta(days=1)
START, END = date(1997, 1, 1), date(1997, 12, 31)
CUTOFF = date(2001, 2, 2)

WIN_A = windows([("a", START - DAY, END + DAY, START, END)])
WIN_B = windows([("b", CUTOFF, None, CUTOFF, None)])


def sweep_windows(rows) -> str:
    return windows([(name, s - DAY, e + DAY, s, e) for name, s, e in rows])


def a(final: str) -> str:
    return build(final, WIN_A)


def b(final: str) -> str:
    return build(final, WIN_B)


STAGE = "SELECT * EXCLUDE (window_id) FROM {}"

LONG = '{stage} AS stage, {column} AS column_name, {check} AS "check"'


def long_form(frame: str, stage: str, check: str, columns: dict[str, tuple[str, str]]) -> str:
    """Union of one row per column: total rows, bad rows, detail."""
    return "\nUNION ALL\n".join(
        f"""SELECT '{stage}' AS stage, '{column}' AS column_name, '{check}' AS "check",
               count(*) AS "rows", count(*) FILTER (WHERE {bad}) AS bad_rows, {detail} AS detail
        FROM {frame}"""
        for column, (bad, detail) in columns.items()
    )


def span(value: str) -> str:
    return (
        f"coalesce(CAST(min({value}) AS VARCHAR), 'none') || '..' || "
        f"coalesce(CAST(max({value}) AS VARCHAR), 'none')"
    )


def counted(label: str, condition: str) -> str:
    return f"'{label}=' || CAST(count(*) FILTER (WHERE {condition}) AS VARCHAR)"


def value_set(frame: str, stage: str, columns: list[str], longest: int) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{stage}' AS stage, '{c}' AS column_name, 'value_set' AS "check",
               count(*) AS "rows", count(*) FILTER (WHERE length({c}) > {longest}) AS bad_rows,
               'values=' || CAST(count(DISTINCT {c}) AS VARCHAR) || ' longest='
                 || coalesce(CAST(max(length({c})) AS VARCHAR), 'none') AS detail
        FROM {frame}"""
        for c in columns
    )


def audit(name: str, left: str, left_key: str, right: str, right_key: str) -> str:
    """Join sizes, from grouped counts and from the joins themselves."""
    lk = f"(SELECT {left_key} AS key FROM {left})"
    rk = f"(SELECT {right_key} AS key FROM {right})"
    return f"""
        SELECT '{name}' AS join_name, *,
               CASE WHEN left_rows >= right_rows THEN 'left' ELSE 'right' END AS larger_side
        FROM (SELECT
            (SELECT count(*) FROM {lk}) AS left_rows,
            (SELECT count(*) FROM {rk}) AS right_rows,
            (SELECT count(DISTINCT key) FROM {lk}) AS left_keys,
            (SELECT count(DISTINCT key) FROM {rk}) AS right_keys,
            (SELECT count(*) FROM {lk} WHERE key IS NULL) AS left_null_keys,
            (SELECT count(*) FROM {rk} WHERE key IS NULL) AS right_null_keys,
            (SELECT ifnull(max(n), 0) FROM (SELECT count(*) AS n FROM {lk} WHERE key IS NOT NULL GROUP BY key))
                AS left_largest_key,
            (SELECT ifnull(max(n), 0) FROM (SELECT count(*) AS n FROM {rk} WHERE key IS NOT NULL GROUP BY key))
                AS right_largest_key,
            (SELECT CAST(count(*) AS DECIMAL(38,0)) FROM {lk} x JOIN {rk} y ON x.key = y.key) AS inner_rows,
            (SELECT CAST(count(*) AS DECIMAL(38,0)) FROM {lk} x LEFT JOIN {rk} y ON x.key = y.key)
                AS left_join_rows)"""


TRANSITIONS = """
    SELECT * FROM (WITH happened AS (
        SELECT DISTINCT line, order_uuid, order_created_time_utc AS moment, 1 AS pos, 'created' AS state
        FROM in_deliveries, (VALUES ('life'), ('care')) AS v(line)
        UNION ALL SELECT 'life', order_uuid, delivery_created_time_utc, 2, 'assigned' FROM in_deliveries
        UNION ALL SELECT 'life', order_uuid, dropoff_complete_time_utc, 3, 'delivered' FROM in_deliveries
        UNION ALL SELECT 'life', order_uuid, cancellation_time_utc, 4, 'cancelled' FROM in_cancellations
        WHERE order_status_cancel_ind
        UNION ALL SELECT 'care', order_uuid, created_time, 5, 'contacted' FROM in_tickets
        UNION ALL SELECT 'care', order_uuid, adjustment_timestamp_utc, 6, 'adjusted' FROM in_adjustments
        UNION ALL SELECT 'care', order_uuid, issue_timestamp_utc, 7, 'conceded' FROM in_concessions
    ), steps AS (
        SELECT line, order_uuid, state AS to_state,
               coalesce(lag(state) OVER (PARTITION BY line, order_uuid ORDER BY moment, pos), 'start') AS from_state
        FROM happened WHERE order_uuid IS NOT NULL AND moment IS NOT NULL
    )
    SELECT line, from_state, to_state,
           CASE WHEN from_state = 'start' THEN to_state = 'created'
                WHEN to_state = 'created' THEN FALSE
                ELSE from_state || '>' || to_state NOT IN ('cancelled>assigned', 'cancelled>delivered',
                     'cancelled>cancelled', 'delivered>cancelled') END AS legal,
           count(DISTINCT order_uuid) AS orders, count(*) AS times
    FROM steps GROUP BY line, from_state, to_state)"""

AUDITS = [
    ("adjustments-tickets", "in_adjustments", "ticket_id", "in_tickets", "ticket_id"),
    ("concessions-tickets", "in_concessions", "ticket_id", "in_tickets", "ticket_id"),
    (
        "cancellations-tickets",
        "in_cancellations",
        "CAST(cancellation_ticket_id AS BIGINT)",
        "in_tickets",
        "ticket_id",
    ),
    (
        "tickets-primary_reason",
        "in_tickets",
        "primary_contact_reason",
        "in_contact_reason_primary",
        "contact_reason_id",
    ),
    (
        "tickets-secondary_reason",
        "in_tickets",
        "secondary_contact_reason",
        "in_contact_reason_secondary",
        "contact_reason_id",
    ),
    (
        "cancellations-reason_map",
        "in_cancellations",
        "primary_cancel_reason_id",
        "in_cancel_reason_map",
        "CAST(cancel_reason_id AS VARCHAR)",
    ),
    ("cancellations-self_service", "in_cancellations", "order_uuid", "st_self_service", "order_uuid"),
    ("profit-deliveries", "in_order_profit", "order_uuid", "st_leg", "order_uuid"),
    ("profit-cancels", "in_order_profit", "order_uuid", "st_cancel", "order_uuid"),
    ("profit-adjustment", "in_order_profit", "order_uuid", "st_adjustment", "order_uuid"),
    ("profit-claim", "in_order_profit", "order_uuid", "st_claim", "order_uuid"),
    ("profit-concession", "in_order_profit", "order_uuid", "st_concession", "order_uuid"),
    ("profit-contact", "in_order_profit", "order_uuid", "st_contact", "order_uuid"),
    (
        "contact-cost_map",
        "st_contact",
        "latest_contact_reason",
        "in_contact_reason_cost_map",
        "scr",
    ),
    (
        "order-reason_map",
        "reasoned_a",
        "lower(adjustment_and_cancel_reason_combined)",
        "in_cancel_reason_map",
        "lower(cancel_reason_name)",
    ),
    ("attributes-merchants", "in_order_attributes", "cust_id", "in_merchants", "cust_id"),
    ("attributes-locations", "in_order_attributes", "order_uuid", "in_order_locations", "order_uuid"),
    (
        "locations-blockgroups",
        "in_order_locations",
        "dropoff_blockgroup_geoid",
        "in_blockgroups",
        "blockgroup_geoid",
    ),
]

FIVE_B = (
    "cp_diner_adj + cp_care_concession_awarded_amount + cp_care_ticket_cost"
    " + cp_redelivery_cost + cp_grub_care_refund"
)


def _sum(expression: str, name: str) -> str:
    return f"CAST(sum({expression}) AS DECIMAL(18,2)) AS {name}"


def _rows_where(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


GROUPED_B = f"""(
        SELECT date1, ghd_ind, order_uuid,
               CASE WHEN {FIVE_B} = 0 THEN 'orders with no care cost'
                    WHEN cp_redelivery_cost < 0 THEN 'logistics issues'
                    ELSE lower(coalesce(nullif(adjustment_group, 'not grouped'),
                                        nullif(fg_group, 'not grouped'), care_cost_group)) END
               AS care_cost_reason_group
        FROM detail_b)"""

REPORT_B = f"""
    SELECT date1, ghd_ind, delivery_ind, cancel_fact_ind, adjustment_group,
           adjustment_and_cancel_reason_combined, ghd_late_ind, ghd_late_ind_incl_cancel_time,
           bundle_ind, shop_and_pay_ind, automated_ind, modified_cbsa_name, key_cities_cbsa,
           ghd_delivery_region_name, large_order_ind, tri_state_ind, reason_group AS care_cost_reason_group,
           reason AS care_cost_reason,
           count(DISTINCT order_uuid) AS orders,
           {_rows_where("cancel_fact_ind", "cancels")},
           CAST(sum(cp_revenue) FILTER (WHERE status_cancelled_reached_ind AND NOT cancelled_order_ind)
                AS DECIMAL(18,2)) AS missed_revenue_cp,
           {_sum("cp_diner_adj", "cp_diner_adj")},
           {_sum("cp_care_concession_awarded_amount", "cp_care_concession_awarded_amount")},
           {_sum("cp_care_ticket_cost", "cp_care_ticket_cost")},
           {_sum("cp_redelivery_cost", "redelivery_cost")},
           {_sum("cp_grubcash_care_concession_awarded_amount", "cp_grubcash_care_concession_awarded_amount")},
           {_sum("cp_grub_care_refund", "cp_grubcare_refund")},
           {_sum("rr_refund", "rr_refund")},
           {_sum("five", "cp_total_care_cost")},
           {_rows_where("ghd_late_ind = 1", "ghd_late_count")},
           {_rows_where("ghd_ind = 'ghd'", "ghd_orders")},
           {_sum("driver_pay_per_order", "driver_pay_cpf")},
           {_sum("tip", "tip")},
           {_sum("true_up", "true_up")},
           {_rows_where("cp_diner_adj < 0", "orders_with_adjustments")},
           {_rows_where("cp_care_concession_awarded_amount < 0", "orders_with_fg")},
           {_rows_where("cp_redelivery_cost < 0", "orders_with_redelivery")},
           {_rows_where("cp_grubcash_care_concession_awarded_amount < 0", "orders_with_gh_credit")},
           {_rows_where("cp_grub_care_refund < 0", "orders_with_gh_credit_refund")},
           {_rows_where("rr_refund <> 0", "orders_with_rr_refund")},
           {_rows_where("five < 0", "orders_with_care_cost")},
           {_rows_where("order_status_cancel_ind", "cancels_osmf_definition")}
    FROM (
        SELECT *, {FIVE_B} AS five,
               CASE WHEN {FIVE_B} = 0 THEN 'orders with no care cost'
                    WHEN cp_redelivery_cost < 0 THEN 'logistics issues'
                    ELSE lower(coalesce(nullif(adjustment_group, 'not grouped'),
                                        nullif(fg_group, 'not grouped'), care_cost_group)) END AS reason_group,
               CASE WHEN cp_redelivery_cost < 0 THEN 'Missed Delivery'
                    ELSE lower(coalesce(adjustment_and_cancel_reason_combined, fg_reason, care_cost_reason))
               END AS reason
        FROM detail_b)
    GROUP BY ALL"""


def oracle_queries(sweep_rows) -> dict[str, str]:
    group_texts = """
        SELECT source, text, normal, n, coalesce(
            (SELECT arg_min(r.result, r.pos) FROM group_rules r WHERE regexp_matches(normal, r.pattern)),
            'not grouped') AS reason_group
        FROM counted_texts"""
    counted_texts = """
        SELECT s.source, s.text, r.normal, count(*) AS n
        FROM (SELECT 'part' AS source, p_name AS text FROM part
              UNION ALL SELECT 'adjustment', reason FROM in_adjustments
              UNION ALL SELECT 'ticket', contact_reason FROM named_tickets) s
        LEFT JOIN normal_reasons r ON r.text = lower(s.text)
        GROUP BY ALL"""
    return {
        "cost_by_market": a(
            """
            SELECT CASE WHEN l."CA_Market" = 'CA' THEN 'CA' WHEN l."NYC_Market" = 'DCWP' THEN 'DCWP'
                        ELSE 'ROM' END AS cany_ind,
                   count(*) AS orders, count(DISTINCT p.order_uuid) AS distinct_order_uuid,
                   CAST(sum(p.cp_diner_adj + p.cp_care_concession_awarded_amount + p.cp_diner_care_tickets
                       + p.cp_driver_care_tickets + p.cp_restaurant_care_tickets
                       + p.cp_gh_internal_care_tickets + ifnull(p.cp_redelivery_cost, 0)
                       + ifnull(p.cp_grub_care_refund, 0)) AS DECIMAL(18,2)) AS total_care_cost,
                   count(*) AS ghd_orders
            FROM in_order_profit p
            JOIN win w ON p.order_date BETWEEN w.lo AND w.hi
            JOIN st_leg l USING (order_uuid)
            WHERE p.managed_delivery_ind
            GROUP BY 1"""
        ),
        "ticket_reasons": a("SELECT * FROM named_tickets"),
        "latest_adjustment": a(STAGE.format("st_adjustment")),
        "guarantee_claims": a(STAGE.format("st_claim")),
        "latest_concession": a(STAGE.format("st_concession")),
        "self_service_cancels": a(STAGE.format("st_self_service")),
        "contacts": a("SELECT * EXCLUDE (window_id, automated_ind) FROM st_contact"),
        "contacts_automated": b(STAGE.format("st_contact")),
        "cancels": a(STAGE.format("st_cancel")),
        "delivery_legs": a(STAGE.format("st_leg")),
        "delivery_first_leg": b(STAGE.format("st_first_leg")),
        "reason_normalised": build(counted_texts),
        "reason_group": build(f"SELECT * FROM ({group_texts.replace('counted_texts', f'({counted_texts})')})"),
        "order_joined_a": a(STAGE.format("joined_a")),
        "order_reasoned_a": a(STAGE.format("reasoned_a")),
        "order_detail_a": a(
            "SELECT * EXCLUDE (window_id, cp_redelivery_cost, cp_grub_care_refund, total),"
            " total AS total_care_cost, ifnull(cp_redelivery_cost, 0) AS cp_redelivery_cost FROM detail_a"
        ),
        "report_a": a(
            f"SELECT cany_ind, care_cost_reason_group, eta_care_reasons, {MEASURES_A}"
            " FROM labelled_a GROUP BY ALL"
        ),
        "order_milestones": b("SELECT * FROM st_milestone"),
        "order_attributes": b("SELECT * FROM st_attribute"),
        "merchant_refunds": b("SELECT * FROM st_refund"),
        "order_geography": b("SELECT * FROM st_geography"),
        "order_joined_b": b("SELECT * FROM joined_b"),
        "order_detail_b": b("SELECT * EXCLUDE (total) FROM detail_b"),
        "report_b": b(REPORT_B),
        "sweep_window_region": build(
            f"SELECT window_id, region_name, {MEASURES_A} FROM labelled_a GROUP BY ALL",
            sweep_windows(sweep_rows),
        ),
        "check_numeric_text": build(
            long_form(
                "in_cancellations",
                "cancellations",
                "numeric_text",
                {
                    c: (
                        f"{c} IS NOT NULL AND NOT regexp_full_match({c}, '[0-9]+')",
                        span(f"TRY_CAST({c} AS BIGINT)"),
                    )
                    for c in ("primary_cancel_reason_id", "cancellation_ticket_id", "order_uuid")
                },
            )
        ),
        "check_value_set": a(
            value_set(
                "detail_a",
                "order_detail_a",
                ["adjustment_group", "fg_group", "care_cost_group", "ghd_ind", "mealtime", "order_uuid"],
                20,
            )
            + "\nUNION ALL\n"
            + value_set("in_adjustments", "adjustments", ["reason", "direction", "payer"], 20)
        ),
        "check_money_scale": a(
            long_form(
                "(SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS price,"
                " CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount"
                " FROM lineitem)",
                "lineitem",
                "money_scale",
                {
                    c: (f"{c} <> round({c}, 2)", span(f"CAST(round({c}, 2) AS DECIMAL(18,2))"))
                    for c in ("price", "discount")
                },
            )
            + "\nUNION ALL\n"
            + long_form(
                "detail_a",
                "order_detail_a",
                "money_scale",
                {"total_care_cost": ("total <> round(total, 2)", span("total"))},
            )
        ),
        "check_filter_coverage": build(
            "\nUNION ALL\n".join(
                long_form(
                    frame,
                    stage,
                    "filter_coverage",
                    {
                        name: (
                            f"({predicate}) IS NULL",
                            counted("kept", predicate)
                            + " || "
                            + counted(" dropped", f"NOT ({predicate})"),
                        )
                        for name, predicate in predicates.items()
                    },
                )
                for frame, stage, predicates in [
                    (
                        "in_tickets",
                        "tickets",
                        {
                            "window": "ticket_created_date BETWEEN DATE '1996-12-31' AND DATE '1998-01-01'",
                            "before_as_of": f"ticket_created_date < DATE '{AS_OF.isoformat()}'",
                            "has_order": "order_uuid IS NOT NULL",
                            "worked": "cpo_contact_indicator = 1",
                            "secondary_known": "secondary_contact_reason <= 110",
                        },
                    ),
                    (
                        "in_adjustments",
                        "adjustments",
                        {
                            "window": "adjustment_dt BETWEEN 19961231 AND 19980101",
                            "refund": "direction = 'ADJUST_DOWN'",
                            "platform": "payer = 'PLATFORM'",
                        },
                    ),
                    (
                        "in_order_profit",
                        "order_profit",
                        {
                            "window": "order_date BETWEEN DATE '1996-12-31' AND DATE '1998-01-01'",
                            "managed": "managed_delivery_ind",
                        },
                    ),
                ]
            )
        ),
        "check_early_filter": a(
            "SELECT count(*) AS left_rows, count(*) AS right_rows,"
            " CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM st_adjustment"
        ),
        "check_reason_sources": build(
            """SELECT (SELECT count(*) FROM named_tickets) AS left_rows, (SELECT count(*) FROM named_tickets) AS right_rows,
                 (SELECT count(*) FROM (SELECT ticket_id, order_uuid, contact_reason FROM named_tickets
                    EXCEPT ALL SELECT ticket_id, order_uuid, primary_name FROM named_tickets)) AS only_left,
                 (SELECT count(*) FROM (SELECT ticket_id, order_uuid, primary_name FROM named_tickets
                    EXCEPT ALL SELECT ticket_id, order_uuid, contact_reason FROM named_tickets)) AS only_right"""
        ),
        "check_in_window": a(
            long_form(
                "detail_a",
                "order_detail_a",
                "in_window",
                {
                    c: (
                        f"{c} < DATE '1996-12-31' OR {c} > DATE '1998-01-01'",
                        span(c),
                    )
                    for c in ("date1", "date2", "start_of_week")
                },
            )
        ),
        "check_value_range": a(
            long_form(
                "detail_a",
                "order_detail_a",
                "value_range",
                {
                    c: (
                        f"{e} < {low} OR {e} > {high}",
                        span(e) + " || " + counted(" nulls", f"{e} IS NULL"),
                    )
                    for c, e, low, high in [
                        ("total_care_cost", "total", -5000, 0),
                        ("month", "month", 1, 12),
                        ("week", "week", 1, 53),
                        ("tip", "tip", 0, 50),
                        ("cp_care_ticket_cost", "cp_care_ticket_cost", -2, 0),
                    ]
                },
            )
        ),
        "check_time_order": build(
            long_form(
                "in_deliveries",
                "deliveries",
                "time_order",
                {
                    f"{x} <= {y}": (f"{y} < {x}", counted("compared", f"{y} >= {x}"))
                    for x, y in [
                        ("order_created_time_utc", "eta_at_order_placement_time_utc"),
                        ("order_created_time_utc", "dropoff_complete_time_utc"),
                        ("eta_at_order_placement_time_utc", "dropoff_complete_time_utc"),
                        ("click_start_time_local", "cancelled_time_local"),
                        ("order_created_time_utc", "order_created_time_local"),
                    ]
                },
            )
        ),
        "check_transitions": build(TRANSITIONS),
        "check_sign": a(
            long_form(
                "detail_a",
                "order_detail_a",
                "sign",
                {
                    c: (
                        f"{c} {'>' if negative else '<'} 0",
                        counted("negative", f"{c} < 0") + " || " + counted(" positive", f"{c} > 0"),
                    )
                    for c, negative in [
                        ("cp_diner_adj", True),
                        ("cp_care_concession_awarded_amount", True),
                        ("cp_care_ticket_cost", True),
                        ("cp_redelivery_cost", True),
                        ("tip", False),
                        ("driver_pay_per_order", False),
                        ("diner_ty_eta", False),
                        ("cancel_mins", False),
                    ]
                },
            )
        ),
        "check_allowed_values": a(
            long_form(
                "labelled_a",
                "report_a",
                "allowed_values",
                {
                    c: (f"{c} NOT IN ({in_list(values)})", counted("nulls", f"{c} IS NULL"))
                    for c, values in [
                        ("cany_ind", fixed.MARKETS),
                        ("care_cost_reason_group", fixed.REASON_GROUPS),
                        ("eta_care_reasons", fixed.ETA_FLAGS),
                    ]
                },
            )
        ),
        "check_fanout": a(
            "SELECT cany_ind, care_cost_reason_group, eta_care_reasons, count(order_uuid) AS orders,"
            " count(DISTINCT order_uuid) AS distinct_order_uuid,"
            " count(order_uuid) - count(DISTINCT order_uuid) AS repeated_rows FROM labelled_a GROUP BY ALL"
        ),
        "join_audit": a("\nUNION ALL\n".join(audit(*row) for row in AUDITS)),
        "stage_counts": a(
            "\nUNION ALL\n".join(
                f"SELECT '{stage}' AS stage, count(*) AS \"rows\", count(DISTINCT order_uuid) AS keys,"
                f" count(*) FILTER (WHERE order_uuid IS NULL) AS null_keys,"
                f" count(order_uuid) - count(DISTINCT order_uuid) AS repeated_rows FROM {frame}"
                for stage, frame in [
                    ("adj", "st_adjustment"),
                    ("ghg", "st_claim"),
                    ("care_fg", "st_concession"),
                    ("diner_ss_cancels", "st_self_service"),
                    ("cancels", "st_cancel"),
                    ("mdf", "st_leg"),
                    ("contacts", "st_contact"),
                    ("o", "joined_a"),
                    ("o2", "reasoned_a"),
                    ("o3", "detail_a"),
                ]
            )
        ),
        "order_reasoned_b": b("SELECT * FROM reasoned_b"),
        "join_audit_b": b(
            "\nUNION ALL\n".join(
                audit(*row)
                for row in [
                    ("profit-first_leg", "in_order_profit", "order_uuid", "st_first_leg", "order_uuid"),
                    ("profit-merchant_refunds", "in_order_profit", "order_uuid", "st_refund", "order_uuid"),
                    ("profit-milestones", "in_order_profit", "order_uuid", "st_milestone", "order_uuid"),
                    ("profit-attributes", "in_order_profit", "order_uuid", "st_attribute", "order_uuid"),
                    (
                        "windowed_attributes-locations",
                        "st_attribute",
                        "order_uuid",
                        "in_order_locations",
                        "order_uuid",
                    ),
                ]
            )
        ),
        "check_report_b": b(
            "\nUNION ALL\n".join(
                long_form("detail_b", "order_detail_b", check, columns)
                for check, columns in {
                    "in_window": {"date1": (f"date1 < DATE '{CUTOFF.isoformat()}'", span("date1"))},
                    "value_range": {
                        c: (f"{c} < 0 OR {c} > {high}", span(c) + " || " + counted(" nulls", f"{c} IS NULL"))
                        for c, high in (("tip", 50), ("rr_refund", 5))
                    },
                    "sign": {
                        c: (
                            f"{c} {'<' if c == 'tip' else '>'} 0",
                            counted("negative", f"{c} < 0") + " || " + counted(" positive", f"{c} > 0"),
                        )
                        for c in ("cp_diner_adj", "cp_care_ticket_cost", "cp_redelivery_cost", "tip")
                    },
                    "allowed_values": {
                        c: (f"{c} NOT IN ({in_list(values)})", counted("nulls", f"{c} IS NULL"))
                        for c, values in (
                            ("tri_state_ind", ("Tri-State", "Other")),
                            ("ghd_ind", ("ghd", "non-ghd")),
                        )
                    },
                }.items()
            )
        ),
        "stage_counts_b": b(
            "\nUNION ALL\n".join(
                f"SELECT '{stage}' AS stage, count(*) AS \"rows\", count(DISTINCT order_uuid) AS keys,"
                f" count(*) FILTER (WHERE order_uuid IS NULL) AS null_keys,"
                f" count(order_uuid) - count(DISTINCT order_uuid) AS repeated_rows FROM {frame}"
                for stage, frame in [
                    ("adj", "st_adjustment"),
                    ("ghg", "st_claim"),
                    ("care_fg", "st_concession"),
                    ("diner_ss_cancels", "st_self_service"),
                    ("cancels", "st_cancel"),
                    ("osmf", "st_milestone"),
                    ("of", "st_attribute"),
                    ("mdf", "st_first_leg"),
                    ("rest_refunds", "st_refund"),
                    ("contacts", "st_contact"),
                    ("o", "joined_b"),
                    ("o2", "reasoned_b"),
                    ("o3", "detail_b"),
                ]
            )
        ),
        "report_b_orders_rolled_up": b(
            "\nUNION ALL\n".join(
                f"SELECT '{level}' AS dimension, CAST({level} AS VARCHAR) AS value,"
                f" count(DISTINCT order_uuid) AS orders FROM {GROUPED_B} GROUP BY {level}"
                for level in ("date1", "care_cost_reason_group", "ghd_ind")
            )
        ),
        "check_exact_percentiles": a(
            "\nUNION ALL\n".join(
                f"""SELECT 'order_detail_a' AS stage, '{c}' AS column_name,
                       round(count(*) FILTER (WHERE {e} IS NULL) / count(*), 6) AS null_share,
                       CAST({p} AS DOUBLE) AS percentile,
                       round(quantile_cont(CAST({e} AS DOUBLE), {p}), 4) AS value
                FROM detail_a"""
                for c, e in [
                    ("total_care_cost", "total"),
                    ("tip", "tip"),
                    ("diner_ty_eta", "diner_ty_eta"),
                    ("cp_care_concession_awarded_amount", "cp_care_concession_awarded_amount"),
                    ("cp_diner_adj", "cp_diner_adj"),
                ]
                for p in (0.01, 0.25, 0.5, 0.75, 0.99)
            )
        ),
        "check_percentiles": a(
            "\nUNION ALL\n".join(
                f"""SELECT 'order_detail_a' AS stage, '{c}' AS column_name,
                       round(count(*) FILTER (WHERE {e} IS NULL) / count(*), 6) AS null_share,
                       CAST({p} AS DOUBLE) AS percentile,
                       round(quantile_cont(round(CAST({e} AS DOUBLE), {scale}), {p}), 4) AS value
                FROM detail_a"""
                for c, e, scale in [
                    ("total_care_cost", "total", 0),
                    ("tip", "tip", 1),
                    ("diner_ty_eta", "diner_ty_eta", 1),
                    ("cp_care_concession_awarded_amount", "cp_care_concession_awarded_amount", 0),
                ]
                for p in (0.25, 0.5, 0.75)
            )
        ),
    }
