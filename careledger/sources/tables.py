"""The 18 input tables: schemas, readers and the report sink."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careledger.functions.columns import nested_columns, row_marks

# Columns the reports read, as Spark DDL. `adjustment_id` and `concession_id` only
# break ties between events of the same instant; a table without them still works.
SCHEMAS = {
    "contact_reason_primary": (
        "contact_reason_id int, "
        "name string"
    ),
    "contact_reason_secondary": (
        "contact_reason_id int, "
        "name string"
    ),
    "cancel_reason_map": (
        "cancel_reason_id int, "
        "cancel_reason_name string, "
        "cancel_group string"
    ),
    "contact_reason_cost_map": (
        "scr string, "
        "care_cost_reason string, "
        "care_cost_group string"
    ),
    "tickets": (
        "ticket_id bigint, "
        "order_uuid string, "
        "created_time timestamp_ntz, "
        "ticket_created_date date, "
        "primary_contact_reason int, "
        "secondary_contact_reason int, "
        "cpo_contact_indicator int, "
        "automation_deflected_ind boolean"
    ),
    "adjustments": (
        "adjustment_id bigint, "
        "order_uuid string, "
        "ticket_id bigint, "
        "reason string, "
        "adjustment_timestamp_utc timestamp_ntz, "
        "adjustment_dt int, "
        "direction string, "
        "payer string"
    ),
    "guarantee_claims": (
        "cart_uuid string, "
        "claim_type string, "
        "created_date date, "
        "decision string"
    ),
    "concessions": (
        "concession_id bigint, "
        "order_uuid string, "
        "ticket_id bigint, "
        "issue_timestamp_utc timestamp_ntz, "
        "expiration_dt int"
    ),
    "self_service_cancels": (
        "order_id string, "
        "reason_code string, "
        "created_date date"
    ),
    "cancellations": (
        "order_uuid string, "
        "order_status_cancel_ind boolean, "
        "order_status_cancel_reason string, "
        "primary_cancel_reason_id string, "
        "cancellation_ticket_id string, "
        "cancellation_time_utc timestamp_ntz, "
        "cancellation_date date"
    ),
    "deliveries": (
        "order_uuid string, "
        "region_uuid string, "
        "region_name string, "
        "mealtime string, "
        "delivery_eta_type string, "
        "bundle_type string, "
        "future_order_ind boolean, "
        "delivery_fulfillment_type string, "
        "order_created_time_utc timestamp_ntz, "
        "order_created_time_local timestamp_ntz, "
        "delivery_created_time_utc timestamp_ntz, "
        "click_start_time_local timestamp_ntz, "
        "eta_at_order_placement_time_utc timestamp_ntz, "
        "lower_bound_eta_at_order_placement_time_utc timestamp_ntz, "
        "eta_at_order_placement_time_local timestamp_ntz, "
        "dropoff_complete_time_utc timestamp_ntz, "
        "dropoff_complete_time_local timestamp_ntz, "
        "cancelled_time_local timestamp_ntz, "
        "business_day date"
    ),
    "order_profit": (
        "order_uuid string, "
        "order_date date, "
        "delivery_time_ct timestamp_ntz, "
        "managed_delivery_ind boolean, "
        "delivery_ind boolean, "
        "cancelled_order_ind boolean, "
        "cp_revenue decimal(18,2), "
        "cp_diner_adj decimal(18,2), "
        "cp_care_concession_awarded_amount decimal(18,2), "
        "cp_diner_care_tickets decimal(18,2), "
        "cp_driver_care_tickets decimal(18,2), "
        "cp_restaurant_care_tickets decimal(18,2), "
        "cp_gh_internal_care_tickets decimal(18,2), "
        "cp_redelivery_cost decimal(18,2), "
        "cp_grub_care_refund decimal(18,2), "
        "cp_grubcash_care_concession_awarded_amount decimal(18,2), "
        "cp_driver_pay_per_order decimal(18,2), "
        "cp_driver_true_up decimal(18,2), "
        "tip decimal(18,2)"
    ),
    "order_milestones": (
        "order_uuid string, "
        "status_cancelled_reached_ind boolean, "
        "business_day date"
    ),
    "order_attributes": (
        "order_uuid string, "
        "cust_id bigint, "
        "modified_cbsa_name string, "
        "food_and_beverage decimal(18,2), "
        "delivery_time_ct timestamp_ntz"
    ),
    "merchants": (
        "cust_id bigint, "
        "ghd_delivery_region_name string"
    ),
    "transactions": (
        "order_uuid string, "
        "net_amount bigint, "
        "created_date date, "
        "transaction_time_ct timestamp_ntz, "
        "transaction_type string"
    ),
    "order_locations": (
        "order_uuid string, "
        "dropoff_blockgroup_geoid string"
    ),
    "blockgroups": (
        "blockgroup_geoid string, "
        "csa_name string"
    ),
}

TABLES = tuple(SCHEMAS)


def read_tables(
    spark: SparkSession, root: str, paths: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """All input tables from Parquet directories ``root/<table>``.

    ``paths`` overrides the place of single tables; one that ends in ``.csv`` is
    read as a CSV file with a header (the reason-to-cost map is an uploaded file).
    Schemas are declared, so no job runs to infer them. Partitioning each fact by
    its date column lets the window prune directories.
    """
    places = {name: f"{root}/{name}" for name in TABLES} | dict(paths or {})
    tables = {}
    for name, ddl in SCHEMAS.items():
        reader = spark.read.schema(ddl)
        if places[name].endswith(".csv"):
            tables[name] = reader.csv(places[name], header=True, enforceSchema=False)
        else:
            tables[name] = reader.parquet(places[name])
    return tables


def catalog_tables(spark: SparkSession, names: Mapping[str, str]) -> dict[str, DataFrame]:
    """All input tables from the session catalog, ``names`` giving each table's name."""
    return {table: spark.table(names[table]) for table in TABLES}


def write_report(report: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Write a report as Parquet, one directory per ``by`` value when given.

    Report B is meant for ``by="date1"``. Rows are gathered by that column first
    so that a directory gets few files; AQE splits a day that is too large.
    """
    writer = report if by is None else report.hint("rebalance", by)
    out = writer.write.mode(mode)
    (out if by is None else out.partitionBy(by)).parquet(path)


def _marks(rows: DataFrame, by: str) -> DataFrame:
    """Per day the number of rows and two sums of row hashes, which no order of rows changes."""
    names = [name for name in sorted(rows.columns) if name != by]
    sums = [F.sum(mark) for mark in row_marks(names, nested_columns(rows))]
    return rows.groupBy(F.col(by).alias("day")).agg(F.struct(F.count("*"), *sums).alias("mark"))


def write_days(report: DataFrame, path: str, staging: str, first: date, last: date, by: str = "date1") -> list[date]:
    """Bring the days from ``first`` to ``last`` in ``path`` up to ``report``; all other days stay as they are.

    The report is computed once, into ``staging``. Only days whose rows differ are written again, and days
    that the report no longer has go; a repeated call writes nothing. Returns the days
    that changed. Rows of the report outside the two dates are not written.
    """
    spark = report.sparkSession
    inside = F.col(by).between(F.lit(first), F.lit(last))
    write_report(report.filter(inside), staging)
    new = spark.read.schema(report.schema).parquet(staging)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    was = "day date, mark struct<n: bigint, a: decimal(30,0), b: decimal(30,0)>"
    old = spark.createDataFrame([], was)
    if files.exists(root):
        stored = spark.read.schema(report.schema).option("basePath", path).parquet(path)
        old = _marks(stored.filter(inside).select(report.columns), by)
    both = _marks(new, by).alias("new").join(old.alias("old"), "day", "full")
    changed = both.filter(~F.col("new.mark").eqNullSafe(F.col("old.mark")))
    # One row per day of the window.
    days = {r["day"]: r["there"] for r in changed.select("day", F.col("new.mark").isNotNull().alias("there")).collect()}
    written = [day for day, there in days.items() if there]
    if written:
        rows = new.filter(F.col(by).isin(written)).hint("rebalance", by)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for day in set(days) - set(written):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{by}={day.isoformat()}"), True)
    return sorted(days)
