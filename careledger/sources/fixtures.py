"""Input tables derived from the driver's tables, as portable SQL.

Every text runs unchanged on Spark and on DuckDB, so both sides of a check start
from the same rows. Every base row gives a row: whether an order has an event of a kind
in a window is decided by that row's date, type or decision, which the reports test. Only
deliveries leave some orders out, the ones that are not managed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Driver tables that the inputs are derived from, with their schemas as Spark DDL.
BASE_TABLES = {
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "region": "r_regionkey int, r_name string",
}

SELECTS = {
    "contact_reason_primary": """
        SELECT
            contact_reason_id,
            name
        FROM (VALUES (1,'Late Delivery'),(2,'Order ETA Update'),(3,'Missing Item'),(4,'Incorrect Order'),(5,'Food Damaged'),(6,'Change of Plans'),(7,'Billing Question'),(8,'Delivery Estimate Confirmation')) AS t(contact_reason_id, name)""",
    "contact_reason_secondary": """
        SELECT
            contact_reason_id,
            name
        FROM (VALUES (101,'Food Arrived Cold'),(102,'Refund For 2 Items'),(103,'Wrong Order Received'),(104,'Order Not Received'),(105,'Red Plate'),(106,'Menu Error'),(107,'Item Temporarily Unavailable'),(108,'Special Instructions Ignored'),(109,'Diner Requested Cancel - Order Too Late'),(110,'Account Help')) AS t(contact_reason_id, name)""",
    "cancel_reason_map": """
        SELECT
            cancel_reason_id,
            cancel_reason_name,
            cancel_group
        FROM (VALUES (1,'Late Order','Logistics Issues'),(2,'Change of Plans','Diner Issues'),(3,'Not Mapped','Not Mapped'),(4,'Out of Item','Restaurant Issues'),(5,'Test Order','Other'),(6,'late order','Logistics Issues'),(7,'Payment Issues','Diner Issues'),(8,'Billing Question','Other')) AS t(cancel_reason_id, cancel_reason_name, cancel_group)""",
    "contact_reason_cost_map": """
        SELECT
            scr,
            care_cost_reason,
            care_cost_group
        FROM (VALUES ('Late Delivery','late delivery','Logistics Issues'),('Order ETA Update','order eta update','Logistics Issues'),('Delivery Estimate Confirmation','delivery estimate confirmation','Logistics Issues'),('Billing Question','billing','Diner Issues'),('Menu Error','menu','Restaurant Issues')) AS t(scr, care_cost_reason, care_cost_group)""",
    "tickets": """
        SELECT
            event_id AS ticket_id,
            CASE WHEN event_id % 41 = 0 THEN NULL ELSE 'o-' || CAST(o_orderkey AS STRING) END AS order_uuid,
            o_orderdate + INTERVAL '1' HOUR * (CASE WHEN event_id % 10 < 2 THEN 1 ELSE event_id % 30 END) AS created_time,
            CAST(o_orderdate + INTERVAL '1' HOUR * (CASE WHEN event_id % 10 < 2 THEN 1 ELSE event_id % 30 END) AS DATE) AS ticket_created_date,
            CAST(1 + user_id % 9 AS INT) AS primary_contact_reason,
            CASE WHEN event_type IN ('error','purchase') THEN CAST(101 + event_id % 11 AS INT) END AS secondary_contact_reason,
            CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS cpo_contact_indicator,
            event_type = 'click' AS automation_deflected_ind
        FROM events
        JOIN orders ON o_orderkey = event_id - event_id % 2""",
    "adjustments": """
        SELECT
            CAST(l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS BIGINT) AS adjustment_id,
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            o_orderkey AS ticket_id,
            CASE l_suppkey % 9 WHEN 0 THEN 'Missing Item' WHEN 1 THEN 'Late Order' WHEN 2 THEN 'QUALITY_TEMP' WHEN 3 THEN 'Refund for 3 items' WHEN 4 THEN 'Incorrect_Item' WHEN 5 THEN 'Missed Delivery' WHEN 6 THEN NULL WHEN 7 THEN 'Item Removed' ELSE p_name END AS reason,
            o_orderdate + INTERVAL '1' HOUR * l_linenumber AS adjustment_timestamp_utc,
            CAST(year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate) AS INT) AS adjustment_dt,
            CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' AND l_partkey % 2 = 0 THEN 'ADJUST_DOWN' ELSE 'ADJUST_UP' END AS direction,
            CASE WHEN l_suppkey % 4 = 0 THEN 'MERCHANT' ELSE 'PLATFORM' END AS payer
        FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey
        JOIN part ON p_partkey = l_partkey""",
    "guarantee_claims": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS cart_uuid,
            CASE WHEN o_orderkey % 2 = 0 THEN 'SERVICE' WHEN o_orderkey % 27 = 0 THEN 'OTHER' ELSE 'PRICING' END AS claim_type,
            CAST(o_orderdate AS DATE) AS created_date,
            CASE WHEN o_orderkey % 9 <> 0 THEN 'OPEN' WHEN o_orderpriority = '5-LOW' THEN 'DENY' ELSE 'GRANT' END AS decision
        FROM orders""",
    "concessions": """
        SELECT
            CAST(l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS BIGINT) AS concession_id,
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            o_orderkey + 1 AS ticket_id,
            o_orderdate + INTERVAL '1' HOUR * l_linenumber AS issue_timestamp_utc,
            CASE WHEN l_returnflag = 'A' AND l_partkey % 4 = 0 THEN CAST(year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate) AS INT) ELSE 19700101 END AS expiration_dt
        FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey""",
    "self_service_cancels": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_id,
            CASE o_orderkey % 7 WHEN 0 THEN 'DINER_PAYMENT_ISSUE' WHEN 1 THEN 'DINER_CHOSE_WRONG_ADDRESS' WHEN 2 THEN 'DINER_CHOSE_WRONG_ORDER_ITEMS' WHEN 3 THEN 'DINER_DOES_NOT_WANT_LATE_ORDER' WHEN 4 THEN 'DINER_DOES_NOT_WANT_THE_FOOD' ELSE 'UNKNOWN' END AS reason_code,
            CASE WHEN o_orderkey % 12 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST('1970-01-01' AS DATE) END AS created_date
        FROM orders""",
    "cancellations": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            o_orderstatus <> 'O' AS order_status_cancel_ind,
            CASE WHEN o_orderkey % 30 = 0 THEN 'Restaurant didnt receive order' ELSE 'other' END AS order_status_cancel_reason,
            CAST(1 + o_orderkey % 10 AS STRING) AS primary_cancel_reason_id,
            CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS STRING) END AS cancellation_ticket_id,
            CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '1' HOUR * 2 END AS cancellation_time_utc,
            CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST('1970-01-01' AS DATE) END AS cancellation_date
        FROM orders""",
    "deliveries": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            n_name AS region_uuid,
            CASE WHEN n_regionkey = 1 THEN 'CA - ' || n_name ELSE n_name END AS region_name,
            CASE WHEN o_orderkey % 2 = 0 THEN 'lunch' ELSE 'dinner' END AS mealtime,
            o_orderpriority AS delivery_eta_type,
            CASE WHEN o_orderkey % 8 = 0 THEN 'BUNDLE' END AS bundle_type,
            CASE WHEN o_orderkey % 11 = 0 THEN TRUE WHEN o_orderkey % 11 = 1 THEN NULL ELSE FALSE END AS future_order_ind,
            CASE WHEN o_orderkey % 13 = 0 THEN 'SHOP_AND_PAY' ELSE 'STANDARD' END AS delivery_fulfillment_type,
            o_orderdate + INTERVAL '1' MINUTE * leg_no AS order_created_time_utc,
            o_orderdate + INTERVAL '1' MINUTE * leg_no - INTERVAL '6' HOUR AS order_created_time_local,
            o_orderdate + INTERVAL '5' MINUTE AS delivery_created_time_utc,
            o_orderdate - INTERVAL '6' HOUR AS click_start_time_local,
            CASE WHEN o_orderkey % 37 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * 2730 END AS eta_at_order_placement_time_utc,
            o_orderdate + INTERVAL '35' MINUTE AS lower_bound_eta_at_order_placement_time_utc,
            CASE WHEN o_orderkey % 37 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * 2730 - INTERVAL '6' HOUR END AS eta_at_order_placement_time_local,
            CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * (3270 + 10 * (o_orderkey % 13)) END AS dropoff_complete_time_utc,
            CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * (3270 + 10 * (o_orderkey % 13)) - INTERVAL '6' HOUR END AS dropoff_complete_time_local,
            CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL '20' MINUTE - INTERVAL '6' HOUR END AS cancelled_time_local,
            CAST(o_orderdate AS DATE) AS business_day
        FROM (
            SELECT o.*, 0 AS leg_no FROM orders AS o
            UNION ALL
            SELECT o.*, 1 AS leg_no FROM orders AS o WHERE o_orderkey % 20 = 0
        ) AS leg
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey
        WHERE o_orderkey % 5 <> 0 OR o_orderkey % 20 = 0""",
    "order_profit": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            CAST(o_orderdate AS DATE) AS order_date,
            o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 30) AS delivery_time_ct,
            o_orderkey % 5 <> 0 OR o_orderkey % 20 = 0 AS managed_delivery_ind,
            o_orderkey % 7 <> 0 AS delivery_ind,
            o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS cancelled_order_ind,
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.1000 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS cp_revenue,
            CASE WHEN o_orderkey % 4 = 0 THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0200 AS DECIMAL(6,4)) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS cp_diner_adj,
            CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0100 AS DECIMAL(6,4)) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS cp_care_concession_awarded_amount,
            CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1.25 ELSE 0 END AS DECIMAL(18,2)) AS cp_diner_care_tickets,
            CAST(CASE WHEN o_orderkey % 15 = 0 THEN -0.75 ELSE 0 END AS DECIMAL(18,2)) AS cp_driver_care_tickets,
            CAST(CASE WHEN o_orderkey % 25 = 0 THEN -0.50 ELSE 0 END AS DECIMAL(18,2)) AS cp_restaurant_care_tickets,
            CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(0 AS DECIMAL(18,2)) END AS cp_gh_internal_care_tickets,
            CASE WHEN o_orderkey % 50 = 0 THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0050 AS DECIMAL(6,4)) AS DECIMAL(18,2)) WHEN o_orderkey % 2 = 1 THEN CAST(0 AS DECIMAL(18,2)) END AS cp_redelivery_cost,
            CASE WHEN o_orderkey % 40 = 0 THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0030 AS DECIMAL(6,4)) AS DECIMAL(18,2)) WHEN o_orderkey % 3 = 1 THEN CAST(0 AS DECIMAL(18,2)) END AS cp_grub_care_refund,
            CASE WHEN o_orderkey % 35 = 0 THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0020 AS DECIMAL(6,4)) AS DECIMAL(18,2)) END AS cp_grubcash_care_concession_awarded_amount,
            CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0001 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS cp_driver_pay_per_order,
            CASE WHEN o_orderkey % 10 = 0 THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0001 AS DECIMAL(6,4)) AS DECIMAL(18,2)) END AS cp_driver_true_up,
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0002 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS tip
        FROM orders""",
    "order_milestones": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            o_orderkey % 6 = 0 AS status_cancelled_reached_ind,
            CAST(o_orderdate AS DATE) AS business_day
        FROM orders""",
    "order_attributes": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            o_custkey AS cust_id,
            CASE n_nationkey WHEN 1 THEN 'New York CBSA Excluding Manhattan' WHEN 2 THEN 'New York - Manhattan' WHEN 3 THEN 'Chicago-Naperville-Elgin IL-IN-WI' ELSE n_name END AS modified_cbsa_name,
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0040 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS food_and_beverage,
            o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 30) AS delivery_time_ct
        FROM orders
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey""",
    "merchants": """
        SELECT
            c_custkey AS cust_id,
            CASE WHEN c_custkey % 10 <> 0 THEN r_name END AS ghd_delivery_region_name
        FROM customer
        JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "transactions": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            CAST(100 + o_orderkey % 900 AS BIGINT) AS net_amount,
            CAST(o_orderdate AS DATE) AS created_date,
            o_orderdate AS transaction_time_ct,
            CASE WHEN o_orderkey % 32 = 0 THEN 'PCI_SINGLE_REFUND' ELSE 'CAPTURE' END AS transaction_type
        FROM orders""",
    "order_locations": """
        SELECT
            'o-' || CAST(o_orderkey AS STRING) AS order_uuid,
            CAST(36061000100 + c_nationkey AS STRING) || CAST(o_orderkey % 3 AS STRING) AS dropoff_blockgroup_geoid
        FROM orders
        JOIN customer ON c_custkey = o_custkey""",
    "blockgroups": """
        SELECT
            CAST(36061000100 + n_nationkey AS STRING) || CAST(bg AS STRING) AS blockgroup_geoid,
            CASE WHEN n_regionkey = 0 THEN 'New York-Newark - NY-NJ-CT-PA' ELSE n_name END AS csa_name
        FROM (
            SELECT n.*, 0 AS bg FROM nation AS n
            UNION ALL
            SELECT n.*, 1 AS bg FROM nation AS n
            UNION ALL
            SELECT n.*, 2 AS bg FROM nation AS n
        ) AS b""",
}


class FixtureTables(dict):
    """Input tables by name, each derived when first asked for.

    The driver tables it is made of can be asked for by name too.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in SELECTS:
            text = SELECTS[name]
            used = {base: self[base] for base in BASE_TABLES if re.search(rf"\b{base}\b", text)}
            self[name] = self._spark.sql(_bind(text), **used)
        elif name in BASE_TABLES:
            reader = self._spark.read.schema(BASE_TABLES[name])
            self[name] = reader.parquet(f"{self._dir}/{name}.parquet")
        else:
            raise KeyError(name)
        return self[name]


def fixture_tables(spark: SparkSession, sf_dir: str) -> FixtureTables:
    """The 18 input tables over the driver tables in ``sf_dir``."""
    return FixtureTables(spark, sf_dir)


def _bind(text: str) -> str:
    """Point each base table name after FROM or JOIN to a DataFrame argument."""
    names = "|".join(BASE_TABLES)
    return re.sub(rf"\b(FROM|JOIN) ({names})\b", r"\1 {\2}", text)
