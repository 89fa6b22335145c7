"""Building blocks of the oracle: one named SQL text per step."""

from __future__ import annotations

import re
from datetime import date

from careledger.sources.fixtures import SELECTS
from oracle import texts as fixed


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_values(rules) -> str:
    return ", ".join(
        f"({i}, {literal(pattern)}, {literal(result)})" for i, (pattern, result) in enumerate(rules)
    )


def in_list(values) -> str:
    return ", ".join(literal(v) for v in values)


def windows(rows: list[tuple[str, date, date | None, date, date | None]]) -> str:
    """The windows of a query: id, padded bounds, exact bounds."""

    def day(d: date | None) -> str:
        return f"DATE '{(d or date(9999, 12, 31)).isoformat()}'"

    values = ", ".join(
        f"({literal(name)}, {day(lo)}, {day(hi)}, {day(first)}, {day(last)})"
        for name, lo, hi, first, last in rows
    )
    return f"SELECT * FROM (VALUES {values}) AS v(window_id, lo, hi, first_day, last_day)"


FLAGGED = ("NATION_0", "NATION_5", "NATION_10")
AS_OF = date(2001, 8, 2)

STEPS = {
    "reason_rules": f"SELECT * FROM (VALUES {rule_values(fixed.REASON_RULES)}) AS v(pos, pattern, result)",
    "group_rules": f"SELECT * FROM (VALUES {rule_values(fixed.GROUP_RULES)}) AS v(pos, pattern, result)",
    "ss_codes": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({literal(code)}, {literal(reason)}, {literal(fixed.SELF_SERVICE_GROUPS[code])})"
        for code, reason in fixed.SELF_SERVICE_REASONS.items()
    )
    + ") AS v(code, code_reason, code_group)",
    "claim_codes": "SELECT * FROM (VALUES "
    + ", ".join(f"({literal(k)}, {literal(v)})" for k, v in fixed.CLAIM_REASONS.items())
    + ") AS v(claim_code, claim_text)",
    "named_tickets": """
        SELECT t.*, p.name AS primary_name, s.name AS secondary_name,
               ifnull(s.name, p.name) AS contact_reason
        FROM in_tickets t
        LEFT JOIN in_contact_reason_primary p ON t.primary_contact_reason = p.contact_reason_id
        LEFT JOIN in_contact_reason_secondary s ON t.secondary_contact_reason = s.contact_reason_id""",
    "window_tickets": """
        SELECT w.window_id, n.*
        FROM named_tickets n JOIN win w ON n.ticket_created_date BETWEEN w.lo AND w.hi""",
    "st_adjustment": """
        SELECT window_id, order_uuid, reason AS adjustment_reason_name, contact_reason AS adj_contact_reason
        FROM (
            SELECT w.window_id, a.order_uuid, a.reason, k.contact_reason,
                   row_number() OVER (PARTITION BY w.window_id, a.order_uuid
                       ORDER BY a.adjustment_timestamp_utc DESC NULLS LAST, a.adjustment_id DESC) AS place
            FROM in_adjustments a
            JOIN win w
              ON CAST(strptime(CAST(a.adjustment_dt AS VARCHAR), '%Y%m%d') AS DATE) BETWEEN w.lo AND w.hi
            LEFT JOIN window_tickets k ON k.ticket_id = a.ticket_id AND k.window_id = w.window_id
            WHERE a.payer = 'PLATFORM' AND a.direction = 'ADJUST_DOWN')
        WHERE place = 1""",
    "st_claim": """
        SELECT w.window_id, c.cart_uuid AS order_uuid, max(k.claim_text) AS fg_reason
        FROM in_guarantee_claims c
        JOIN win w ON c.created_date BETWEEN w.lo AND w.hi
        LEFT JOIN claim_codes k ON k.claim_code = c.claim_type
        WHERE c.decision = 'GRANT'
        GROUP BY ALL""",
    "st_concession": """
        SELECT window_id, order_uuid, contact_reason AS fg_reason
        FROM (
            SELECT w.window_id, c.order_uuid, k.contact_reason,
                   row_number() OVER (PARTITION BY w.window_id, c.order_uuid
                       ORDER BY c.issue_timestamp_utc DESC NULLS LAST, c.concession_id DESC) AS place
            FROM in_concessions c
            JOIN win w
              ON CAST(strptime(CAST(c.expiration_dt AS VARCHAR), '%Y%m%d') AS DATE) BETWEEN w.lo AND w.hi
            LEFT JOIN window_tickets k ON k.ticket_id = c.ticket_id AND k.window_id = w.window_id)
        WHERE place = 1""",
    "st_self_service": """
        SELECT w.window_id, s.order_id AS order_uuid, max(s.reason_code) AS reason_code,
               max(k.code_reason) AS diner_ss_cancel_reason,
               max(k.code_group) AS diner_ss_cancel_reason_group
        FROM in_self_service_cancels s
        JOIN win w ON s.created_date BETWEEN w.lo AND w.hi
        LEFT JOIN ss_codes k ON k.code = s.reason_code
        GROUP BY ALL""",
    "st_cancel": """
        SELECT w.window_id, c.order_uuid, c.order_status_cancel_ind,
               CASE WHEN m.cancel_group = 'Not Mapped' AND s.diner_ss_cancel_reason_group IS NOT NULL
                      THEN s.diner_ss_cancel_reason_group
                    WHEN regexp_matches(lower(c.order_status_cancel_reason), 'restaurant did.*nt receive')
                      THEN 'Transmission Issues'
                    ELSE m.cancel_group END AS cancel_group,
               CASE WHEN m.cancel_reason_name = 'Not Mapped' AND s.diner_ss_cancel_reason IS NOT NULL
                      THEN s.diner_ss_cancel_reason
                    WHEN regexp_matches(lower(c.order_status_cancel_reason), 'restaurant did.*nt receive')
                      THEN 'restaurant did not receive order'
                    ELSE m.cancel_reason_name END AS cancel_reason_name,
               k.primary_name AS cancel_pcr, k.secondary_name AS cancel_scr,
               ifnull(c.cancellation_time_utc, k.created_time) AS cancel_time_utc,
               k.contact_reason AS cancel_contact_reason
        FROM in_cancellations c
        JOIN win w ON c.cancellation_date BETWEEN w.lo AND w.hi
        LEFT JOIN in_cancel_reason_map m ON m.cancel_reason_id = CAST(c.primary_cancel_reason_id AS INT)
        LEFT JOIN window_tickets k
          ON k.window_id = w.window_id AND k.ticket_id = CAST(c.cancellation_ticket_id AS BIGINT)
        LEFT JOIN st_self_service s ON s.window_id = w.window_id AND s.order_uuid = c.order_uuid""",
    "clocked_deliveries": """
        SELECT d.*,
               coalesce(dropoff_complete_time_local, eta_at_order_placement_time_local,
                        order_created_time_local + INTERVAL 1 HOUR) AS local_at,
               coalesce(dropoff_complete_time_utc, eta_at_order_placement_time_utc,
                        order_created_time_utc + INTERVAL 1 HOUR) AS utc_at,
               eta_at_order_placement_time_utc + INTERVAL 10 MINUTE AS late_after
        FROM in_deliveries d""",
    "st_leg": f"""
        SELECT w.window_id, d.order_uuid, d.region_uuid, d.region_name, d.mealtime, d.delivery_eta_type,
               CASE WHEN left(d.region_name, 2) = 'CA' THEN 'CA' ELSE 'xCA' END AS "CA_Market",
               CASE WHEN d.region_uuid IN ({in_list(FLAGGED)}) THEN 'DCWP' ELSE 'xDCWP' END AS "NYC_Market",
               d.bundle_type IS NOT NULL AS bundle_ind,
               d.future_order_ind IS NOT DISTINCT FROM TRUE AS future,
               CAST(date_trunc('week', local_at) AS DATE) AS start_of_week,
               CAST(local_at AS DATE) AS date2,
               CAST(weekofyear(local_at) AS INT) AS week,
               CAST(month(local_at) AS INT) AS month,
               utc_at AS deliverytime_utc,
               strftime(local_at, '%a') AS dayofweek,
               local_at AS datetime_local,
               round(date_sub('second',
                   CASE WHEN d.future_order_ind THEN d.delivery_created_time_utc
                        ELSE d.order_created_time_utc END,
                   d.lower_bound_eta_at_order_placement_time_utc) / 60.0, 4) AS diner_ty_eta,
               d.dropoff_complete_time_utc,
               late_after AS ghd_eta_utc,
               CASE WHEN date_sub('minute', late_after, d.dropoff_complete_time_utc) > 0
                    THEN 1 ELSE 0 END AS ghd_late_ind,
               CASE WHEN d.cancelled_time_local IS NULL THEN 0 ELSE 1 END AS cancel_ind,
               round(date_sub('second', d.click_start_time_local, d.cancelled_time_local) / 60.0, 4)
                   AS cancel_mins
        FROM clocked_deliveries d
        JOIN win w ON d.business_day BETWEEN w.lo AND w.hi
         AND CAST(local_at AS DATE) BETWEEN w.first_day AND w.last_day""",
    "st_first_leg": """
        SELECT window_id, order_uuid, dropoff_complete_time_utc, late_after AS ghd_eta_utc,
               CASE WHEN date_sub('minute', late_after, dropoff_complete_time_utc) > 0
                    THEN 1 ELSE 0 END AS ghd_late_ind,
               bundle_type IS NOT NULL AS bundle_ind,
               delivery_fulfillment_type IS NOT DISTINCT FROM 'SHOP_AND_PAY' AS shop_and_pay_ind
        FROM (
            SELECT w.window_id, d.*,
                   row_number() OVER (PARTITION BY w.window_id, d.order_uuid
                                      ORDER BY d.order_created_time_utc) AS place
            FROM clocked_deliveries d JOIN win w ON d.business_day BETWEEN w.lo AND w.hi)
        WHERE place = 1""",
    "st_contact": f"""
        SELECT window_id, order_uuid, ticket_id AS latest_ticket_id, contact_reason AS latest_contact_reason,
               automation_deflected_ind AS automated_ind, number AS contacts
        FROM (
            SELECT *, count(*) OVER (PARTITION BY window_id, order_uuid) AS number,
                   row_number() OVER (PARTITION BY window_id, order_uuid
                                      ORDER BY created_time DESC NULLS LAST, ticket_id DESC) AS place
            FROM window_tickets
            WHERE ticket_created_date < DATE '{AS_OF.isoformat()}'
              AND order_uuid IS NOT NULL AND cpo_contact_indicator = 1)
        WHERE place = 1""",
    "st_milestone": """
        SELECT m.order_uuid, m.status_cancelled_reached_ind
        FROM in_order_milestones m JOIN win w ON m.business_day BETWEEN w.lo AND w.hi""",
    "st_refund": """
        SELECT t.order_uuid, CAST(CAST(sum(t.net_amount) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS rr_refund_total
        FROM in_transactions t
        JOIN win w ON t.created_date BETWEEN w.lo AND w.hi AND t.transaction_time_ct >= w.lo
        WHERE t.transaction_type = 'PCI_SINGLE_REFUND'
        GROUP BY t.order_uuid""",
    "st_attribute": f"""
        SELECT a.order_uuid, a.modified_cbsa_name,
               CASE WHEN a.modified_cbsa_name IN ({in_list(fixed.KEY_CITIES)})
                    THEN a.modified_cbsa_name ELSE 'Other CBSA' END AS key_cities_cbsa,
               m.ghd_delivery_region_name,
               CASE WHEN a.food_and_beverage > 1000 THEN 'Over $1000'
                    WHEN a.food_and_beverage > 250 THEN 'Over $250'
                    ELSE 'Less than $250' END AS large_order_ind
        FROM in_order_attributes a
        JOIN win w ON CAST(a.delivery_time_ct AS DATE) BETWEEN w.lo AND w.hi
        LEFT JOIN in_merchants m ON m.cust_id = a.cust_id""",
    "st_geography": f"""
        SELECT l.order_uuid,
               CASE WHEN b.csa_name = {literal(fixed.TRI_STATE_CSA)} THEN 'Tri-State' ELSE 'Other' END
                   AS tri_state_ind
        FROM in_order_locations l
        LEFT JOIN in_blockgroups b
          ON b.blockgroup_geoid = l.dropoff_blockgroup_geoid AND b.blockgroup_geoid[12] <> '0'""",
    "reason_texts": """
        SELECT DISTINCT lower(text) AS text
        FROM (SELECT reason AS text FROM in_adjustments
              UNION ALL SELECT name FROM in_contact_reason_primary
              UNION ALL SELECT name FROM in_contact_reason_secondary
              UNION ALL SELECT claim_text FROM claim_codes
              UNION ALL SELECT p_name FROM part)
        WHERE text IS NOT NULL""",
    "normal_of": """
        SELECT t.text, arg_min(r.result, r.pos) AS normal
        FROM reason_texts t JOIN reason_rules r ON regexp_matches(t.text, r.pattern)
        GROUP BY t.text""",
    "normal_reasons": """
        SELECT t.text, coalesce(n.normal, t.text) AS normal
        FROM reason_texts t LEFT JOIN normal_of n USING (text)""",
    # The joined order stage. Report A: managed orders, inner join to legs.
    "joined_a": """
        SELECT w.window_id, CAST(p.delivery_time_ct AS DATE) AS date1,
               l.region_uuid, l.region_name, l."CA_Market", l."NYC_Market", l.diner_ty_eta,
               l.delivery_eta_type, l.mealtime, l.month, l.start_of_week, l.week, l.date2,
               l.deliverytime_utc, l.dayofweek, l.datetime_local,
               strftime(l.datetime_local, '%H:%M') AS time_local,
               'ghd' AS ghd_ind, p.order_uuid, p.cp_diner_adj, l.cancel_ind, l.cancel_mins,
               coalesce(c.order_status_cancel_ind, FALSE) AS order_status_cancel_ind,
               c.order_uuid IS NOT NULL AS cancel_fact_ind,
               c.cancel_group, c.cancel_reason_name, c.cancel_contact_reason,
               l.ghd_late_ind,
               CASE WHEN l.ghd_late_ind = 1
                      OR (c.cancel_time_utc > l.ghd_eta_utc AND l.dropoff_complete_time_utc IS NULL)
                    THEN 1 ELSE 0 END AS ghd_late_ind_incl_cancel_time,
               coalesce(n1.normal, n2.normal,
                        lower(coalesce(c.cancel_contact_reason, a.adj_contact_reason, a.adjustment_reason_name)))
                   AS adjustment_reason_name,
               a.adj_contact_reason,
               p.cp_driver_pay_per_order AS driver_pay_per_order, p.tip, l.bundle_ind,
               CASE WHEN p.cp_care_concession_awarded_amount IS DISTINCT FROM 0
                    THEN coalesce(n3.normal, lower(coalesce(g.fg_reason, f.fg_reason))) END AS fg_reason,
               x.care_cost_reason, coalesce(x.care_cost_group, 'not grouped') AS care_cost_group,
               p.cp_care_concession_awarded_amount, p.cp_grub_care_refund, p.cp_redelivery_cost,
               CAST(p.cp_diner_care_tickets + p.cp_driver_care_tickets + p.cp_restaurant_care_tickets
                    + p.cp_gh_internal_care_tickets AS DECIMAL(18,2)) AS cp_care_ticket_cost
        FROM in_order_profit p
        JOIN win w ON p.order_date BETWEEN w.lo AND w.hi
        JOIN st_leg l ON l.order_uuid = p.order_uuid AND l.window_id = w.window_id
        LEFT JOIN st_cancel c ON c.order_uuid = p.order_uuid AND c.window_id = w.window_id
        LEFT JOIN st_adjustment a ON a.order_uuid = p.order_uuid AND a.window_id = w.window_id
        LEFT JOIN st_claim g ON g.order_uuid = p.order_uuid AND g.window_id = w.window_id
        LEFT JOIN st_concession f ON f.order_uuid = p.order_uuid AND f.window_id = w.window_id
        LEFT JOIN st_contact k ON k.order_uuid = p.order_uuid AND k.window_id = w.window_id
        LEFT JOIN in_contact_reason_cost_map x ON x.scr = k.latest_contact_reason
        LEFT JOIN normal_of n1 ON n1.text = lower(a.adjustment_reason_name)
        LEFT JOIN normal_of n2 ON n2.text = lower(coalesce(c.cancel_contact_reason, a.adj_contact_reason))
        LEFT JOIN normal_of n3 ON n3.text = lower(coalesce(g.fg_reason, f.fg_reason))
        WHERE p.managed_delivery_ind""",
    "joined_b": f"""
        SELECT CAST(p.delivery_time_ct AS DATE) AS date1,
               CASE WHEN p.managed_delivery_ind THEN 'ghd' ELSE 'non-ghd' END AS ghd_ind,
               CASE WHEN p.delivery_ind THEN 'delivery' ELSE 'pickup' END AS delivery_ind,
               p.order_uuid, p.cp_diner_adj,
               coalesce(c.order_status_cancel_ind, FALSE) AS order_status_cancel_ind,
               c.order_uuid IS NOT NULL AS cancel_fact_ind,
               c.cancel_group, c.cancel_reason_name, c.cancel_contact_reason,
               s.status_cancelled_reached_ind, k.automated_ind,
               q.modified_cbsa_name, q.key_cities_cbsa, q.ghd_delivery_region_name, q.large_order_ind,
               coalesce(geo.tri_state_ind, 'Other') AS tri_state_ind,
               p.cancelled_order_ind, p.cp_revenue,
               coalesce(l.ghd_late_ind, 0) AS ghd_late_ind,
               CASE WHEN l.ghd_late_ind = 1
                      OR (c.cancel_time_utc > l.ghd_eta_utc AND l.dropoff_complete_time_utc IS NULL)
                    THEN 1 ELSE 0 END AS ghd_late_ind_incl_cancel_time,
               coalesce(n1.normal, n2.normal,
                        lower(coalesce(c.cancel_contact_reason, a.adj_contact_reason, a.adjustment_reason_name)))
                   AS adjustment_reason_name,
               a.adj_contact_reason, p.tip, l.bundle_ind, l.shop_and_pay_ind,
               CASE WHEN p.cp_care_concession_awarded_amount IS DISTINCT FROM 0
                    THEN coalesce(n3.normal, lower(coalesce(g.fg_reason, f.fg_reason))) END AS fg_reason,
               x.care_cost_reason, coalesce(x.care_cost_group, 'not grouped') AS care_cost_group,
               p.cp_care_concession_awarded_amount,
               ifnull(p.cp_driver_pay_per_order, 0) AS driver_pay_per_order,
               ifnull(p.cp_driver_true_up, 0) AS true_up,
               ifnull(p.cp_redelivery_cost, 0) AS cp_redelivery_cost,
               ifnull(p.cp_grubcash_care_concession_awarded_amount, 0)
                   AS cp_grubcash_care_concession_awarded_amount,
               ifnull(p.cp_grub_care_refund, 0) AS cp_grub_care_refund,
               ifnull(r.rr_refund_total, 0) AS rr_refund,
               CAST(p.cp_diner_care_tickets + p.cp_driver_care_tickets + p.cp_restaurant_care_tickets
                    + p.cp_gh_internal_care_tickets AS DECIMAL(18,2)) AS cp_care_ticket_cost
        FROM in_order_profit p
        JOIN win w ON p.order_date BETWEEN w.lo AND w.hi
         AND CAST(p.delivery_time_ct AS DATE) >= w.lo
         AND CAST(p.delivery_time_ct AS DATE) < DATE '{AS_OF.isoformat()}'
        LEFT JOIN st_cancel c ON c.order_uuid = p.order_uuid
        LEFT JOIN st_adjustment a ON a.order_uuid = p.order_uuid
        LEFT JOIN st_first_leg l ON l.order_uuid = p.order_uuid
        LEFT JOIN st_claim g ON g.order_uuid = p.order_uuid
        LEFT JOIN st_concession f ON f.order_uuid = p.order_uuid
        LEFT JOIN st_contact k ON k.order_uuid = p.order_uuid
        LEFT JOIN st_refund r ON r.order_uuid = p.order_uuid
        LEFT JOIN st_milestone s ON s.order_uuid = p.order_uuid
        LEFT JOIN st_attribute q ON q.order_uuid = p.order_uuid
        LEFT JOIN st_geography geo ON geo.order_uuid = q.order_uuid
        LEFT JOIN in_contact_reason_cost_map x ON x.scr = k.latest_contact_reason
        LEFT JOIN normal_of n1 ON n1.text = lower(a.adjustment_reason_name)
        LEFT JOIN normal_of n2 ON n2.text = lower(coalesce(c.cancel_contact_reason, a.adj_contact_reason))
        LEFT JOIN normal_of n3 ON n3.text = lower(coalesce(g.fg_reason, f.fg_reason))""",
}

for _r in "ab":
    STEPS[f"reasoned_{_r}"] = f"""
        SELECT * EXCLUDE (adjustment_reason_name, adj_contact_reason),
               coalesce(lower(nullif(cancel_reason_name, 'Not Mapped')), adjustment_reason_name)
                   AS adjustment_and_cancel_reason_combined
        FROM joined_{_r}"""
    STEPS[f"group_of_{_r}"] = f"""
        SELECT t.text, arg_min(r.result, r.pos) AS result
        FROM (SELECT DISTINCT unnest([lower(adjustment_and_cancel_reason_combined), lower(fg_reason)]) AS text
              FROM reasoned_{_r}) t
        JOIN group_rules r ON regexp_matches(t.text, r.pattern)
        GROUP BY t.text"""
    STEPS[f"detail_{_r}"] = f"""
        SELECT o.* EXCLUDE (fg_reason),
               CASE WHEN o.cancel_group <> 'Other' THEN m.cancel_group
                    ELSE coalesce(g1.result, m.cancel_group, 'not grouped') END AS adjustment_group,
               CASE WHEN o.cancel_group <> 'Other' THEN m.cancel_group
                    ELSE coalesce(g2.result, m.cancel_group, 'not grouped') END AS fg_group,
               coalesce(o.fg_reason, CASE WHEN o.cp_care_concession_awarded_amount < 0
                                          THEN o.adjustment_and_cancel_reason_combined END) AS fg_reason,
               CAST(o.cp_diner_adj + o.cp_care_concession_awarded_amount + o.cp_care_ticket_cost
                    + coalesce(o.cp_redelivery_cost, 0) + coalesce(o.cp_grub_care_refund, 0)
                    AS DECIMAL(18,2)) AS total
        FROM reasoned_{_r} o
        LEFT JOIN in_cancel_reason_map m
          ON lower(m.cancel_reason_name) = lower(o.adjustment_and_cancel_reason_combined)
        LEFT JOIN group_of_{_r} g1 ON g1.text = lower(o.adjustment_and_cancel_reason_combined)
        LEFT JOIN group_of_{_r} g2 ON g2.text = lower(o.fg_reason)"""

STEPS["labelled_a"] = f"""
        SELECT *,
               CASE WHEN "CA_Market" = 'CA' THEN 'CA' WHEN "NYC_Market" = 'DCWP' THEN 'DCWP'
                    ELSE 'ROM' END AS cany_ind,
               CASE WHEN total = 0 THEN 'orders with no care cost'
                    ELSE lower(coalesce(nullif(adjustment_group, 'not grouped'),
                                        nullif(fg_group, 'not grouped'), care_cost_group)) END
                   AS care_cost_reason_group,
               CASE WHEN lower(coalesce(adjustment_and_cancel_reason_combined, fg_reason, care_cost_reason))
                         IN ({in_list(fixed.ETA_REASONS)}) THEN 'ETA Issues' ELSE 'Other' END
                   AS eta_care_reasons
        FROM detail_a"""

MEASURES_A = """count(order_uuid) AS orders, count(DISTINCT order_uuid) AS distinct_order_uuid,
               CAST(sum(total) AS DECIMAL(18,2)) AS total_care_cost,
               count(*) FILTER (WHERE ghd_ind = 'ghd') AS ghd_orders,
               count(*) FILTER (WHERE cp_diner_adj + cp_care_concession_awarded_amount
                                      + cp_care_ticket_cost < 0) AS orders_with_care_cost,
               count(order_uuid) FILTER (WHERE order_status_cancel_ind) AS cancels_osmf_definition"""

INPUTS = {f"in_{name}": text for name, text in SELECTS.items()}


def build(final: str, win: str | None = None) -> str:
    """``final`` with a WITH clause of every step it needs, directly or not."""
    steps = INPUTS | ({"win": win} if win else {}) | STEPS
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b[a-z_]+\b", text)) & steps.keys():
            if name not in needed:
                needed.add(name)
                visit(steps[name])

    visit(final)
    parts = [f"{name} AS ({text})" for name, text in steps.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + final
