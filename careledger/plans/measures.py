"""Final aggregation shared by the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.operators.orders import cents, from_cents


def copies_of(orders: DataFrame) -> Column:
    """How many rows a row stands for."""
    return F.col("copies") if "copies" in orders.columns else F.lit(1).cast("bigint")


def number(condition: Column, copies: Column) -> Column:
    """Rows that meet a condition; NULL does not."""
    return F.when(condition, copies).otherwise(0)


def summarise(
    parts: Sequence[DataFrame],
    dimensions: Sequence[str],
    distinct: str,
    counts: Mapping[str, Column],
    amounts: Mapping[str, Column],
) -> DataFrame:
    """Counts, money sums and distinct orders of row sets that share no order.

    Every part is still partitioned by order after its joins, so the first step,
    one row per group and order, needs no exchange. Distinct orders are then a
    plain count, and only rows already combined per task are shuffled. Money is
    added up in cents (``amounts`` are cents) and is NULL for a group without any.
    """
    values = {**counts, **amounts}
    per_order = [
        part.groupBy(*dimensions, "order_uuid").agg(
            *[F.sum(value).alias(name) for name, value in values.items()]
        )
        for part in parts
    ]
    total = {name: F.sum(name) for name in values}
    for name in amounts:
        total[name] = from_cents(total[name])
    return (
        reduce(DataFrame.unionByName, per_order)
        .groupBy(*dimensions)
        .agg(
            F.count("order_uuid").alias(distinct),
            *[column.alias(name) for name, column in total.items()],
        )
    )


def amount(name: str, copies: Column) -> Column:
    """A money column in cents, times its copies."""
    return cents(F.col(name)) * copies
