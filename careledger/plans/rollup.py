"""Distinct orders that can be added up: exact bitmaps over dense order numbers.

A count of distinct orders by many dimensions cannot be summed to fewer. A bitmap per group
can: orders get numbers without gaps, a group holds one bit for each of its orders in
chunks of fixed size, and any roll-up is the OR of its groups' chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a chunk; what Spark's bitmap functions use.
CHUNK = 32768
#: Parts that number their orders on their own.
PARTS = 64


def order_numbers(rows: DataFrame, key: str = "order_uuid", parts: int = PARTS) -> DataFrame:
    """Each order once, with its ``part``, ``chunk`` and ``bit``.

    Numbers are dense within a part, which a hash of the order chooses, and follow its
    order, so they are the same whenever the same orders are numbered. More parts keep the windows small.
    """
    orders = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    number = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return (
        orders.withColumn("part", part)
        .withColumn("number", number)
        .select(
            key,
            "part",
            F.floor(F.col("number") / CHUNK).cast("int").alias("chunk"),
            F.pmod("number", F.lit(CHUNK)).alias("bit"),
        )
    )


def order_bitmaps(
    rows: DataFrame, by: Sequence[str], key: str = "order_uuid", parts: int = PARTS, numbers: DataFrame | None = None
) -> DataFrame:
    """The orders of each group of ``by`` as bitmaps, one row per group, part and chunk with a bit.

    Worth writing: every roll-up to some of ``by`` reads these rows only. Bitmaps of different days
    can be added up if all use the same ``numbers``. Rows without an order set no bit but keep
    their group.
    """
    if numbers is None:
        numbers = order_numbers(rows, key, parts)
    numbered = rows.select(*by, key).distinct().join(numbers, key, "left")
    return numbered.groupBy(*by, "part", "chunk").agg(F.bitmap_construct_agg("bit").alias("orders"))


def roll_up(bitmaps: DataFrame, by: Sequence[str], name: str = "orders") -> DataFrame:
    """The number of different orders by ``by``, any of the bitmaps' dimensions."""
    chunks = bitmaps.groupBy(*by, "part", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("orders")).alias("n"))
    return chunks.groupBy(*by).agg(F.sum("n").alias(name))
