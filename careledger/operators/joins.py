"""Joining the order-level stages to the profit fact, with hot orders split off.

The profit fact and every stage are keyed by order, so the whole chain of joins
needs one exchange per input and none in between. The price is that one order id
that holds a large share of a table (a placeholder id, say) would end up in one
task. Such ids, which a caller looks up beforehand, take a second path, where both
sides of each join are cut into slots; the result is the same bag of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one order that a task can take: an order with more in any table is hot.
ROWS_PER_TASK = 1_000_000
#: Hot orders that a run accepts and the bytes of their ids, as their table is broadcast.
MOST_HOT = 100_000
MOST_HOT_BYTES = 16_000_000

Hot = Mapping[str, int]


@dataclass(frozen=True)
class Side:
    """One input of the chain. ``unique``: at most one row per key.

    ``copies`` names a column that counts the rows a row stands for.
    """

    rows: DataFrame
    how: str = "left"
    unique: bool = True
    copies: str | None = None


def frequent_orders(
    tables: Mapping[str, DataFrame], rows_per_task: int = ROWS_PER_TASK, column: str = "order_uuid"
) -> dict[str, int]:
    """Order ids with more than ``rows_per_task`` rows in one of ``tables``, with that number.

    One job over all tables: their rows are counted per order, in each task first. No id is
    missed, and there are no more of them than the rows hold that bound.
    """
    keys = [df.select(F.lit(name).alias("_table"), column) for name, df in tables.items()]
    counts = (
        reduce(DataFrame.union, keys)
        .filter(F.col(column).isNotNull())
        .groupBy("_table", column)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > rows_per_task)
    )
    return {r[column]: r["n"] for r in counts.groupBy(column).agg(F.max("n").alias("n")).collect()}


def hot_table(spark: SparkSession, hot: Hot, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """order_uuid and _slots: in how many slots each hot order is cut, as its rows need, as a power of two.

    A local table of a checked size, not literals in the plan; it is the only thing that is broadcast by hint.
    """
    size = sum(len(order.encode()) for order in hot)
    if len(hot) > MOST_HOT or size > MOST_HOT_BYTES:
        raise ValueError(
            f"{len(hot)} hot orders of {size} bytes are more than {MOST_HOT} or {MOST_HOT_BYTES}: raise the rows per task"
        )
    needed = [max(2, -(-rows // rows_per_task)) for rows in hot.values()]
    slots = [1 << (n - 1).bit_length() for n in needed]
    table = pa.table({"order_uuid": pa.array(list(hot), pa.string()), "_slots": pa.array(slots, pa.int64())})
    return spark.createDataFrame(table, "order_uuid string, _slots bigint")


def join_order_sides(
    base: DataFrame,
    sides: Sequence[Side],
    keys: Sequence[str],
    hot: Hot | None = None,
    keep_null: bool = True,
) -> DataFrame:
    """``base`` joined to every side on ``keys``; the first key is the order."""
    return reduce(
        DataFrame.unionByName,
        join_order_branches(base, sides, keys, hot, counted=False, keep_null=keep_null),
    )


def join_order_branches(
    base: DataFrame,
    sides: Sequence[Side],
    keys: Sequence[str],
    hot: Hot | None = None,
    counted: bool = True,
    keep_null: bool = True,
) -> list[DataFrame]:
    """The joined rows as parts that share no order: the usual ones first.

    ``counted`` keeps a ``copies`` column instead of repeating rows, for callers
    that aggregate next. Hot orders are a part of their own. So are rows of
    ``base`` without an order: with outer joins they match nothing and skip the
    exchange, where they would share one partition. ``keep_null=False`` leaves
    them out.
    """
    keys = list(keys)
    order = F.col(keys[0])
    known = base.filter(order.isNotNull())
    if hot:
        table = _named(hot_table(base.sparkSession, hot), keys)
        usual = [Side(_usual(s.rows, table, keys), s.how, s.unique, s.copies) for s in sides]
        parts = [
            _chain(_usual(known, table, keys), usual, keys, counted),
            _hot_chain(known, sides, keys, counted, table),
        ]
    else:
        parts = [_chain(known, sides, keys, counted)]
    if keep_null and all(side.how == "left" for side in sides):
        parts.append(_unmatched(base.filter(order.isNull()), sides, keys, counted))
    return parts


def left_join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], hot: Hot | None = None
) -> DataFrame:
    """Left join to a side with one row per key; hot orders are cut into slots."""
    keys = list(keys)
    if not hot:
        return left.join(right, keys, "left")
    table = _named(hot_table(left.sparkSession, hot), keys)
    spread = _usual(left, table, keys).join(_usual(right, table, keys), keys, "left")
    return spread.unionByName(_hot_chain(left, [Side(right)], keys, False, table))


def spread_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Left join where many rows of ``left`` have no first key.

    NULL keys would gather in one task, so such rows get a second key, as many as there are
    shuffle partitions: a hash of the row, or of its columns ``by``, so a task that runs
    again sends every row where it went before. AQE splits a single key that many share.
    """
    keys = list(keys)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = ", ".join(f"`{name}`" for name in (by or left.columns))
    # As SQL texts: fewer calls into the JVM than columns would take.
    spread = F.expr(f"if(`{keys[0]}` IS NULL, pmod(xxhash64({hashed}), {parts}), -1L)")
    known = right.filter(f"`{keys[0]}` IS NOT NULL").withColumn("_spread", F.expr("-1L"))
    return left.withColumn("_spread", spread).join(known, [*keys, "_spread"], "left").drop("_spread")


def _named(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.withColumnRenamed("order_uuid", keys[0])


def _usual(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of orders that are not hot; rows without an order among them."""
    return df.join(F.broadcast(table.select(keys[0])), keys[0], "left_anti")


def _hot(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of hot orders with their ``_slots``."""
    return df.join(F.broadcast(table), keys[0]).select(*df.columns, "_slots")


def _every_slot(df: DataFrame) -> DataFrame:
    """Each row once per slot of its order."""
    return df.withColumn("_slot", F.explode(F.expr("sequence(0, cast(_slots AS int) - 1)"))).drop("_slots")


def _counts(sides: Sequence[Side]) -> Column:
    counts = [F.coalesce(F.col(s.copies), F.lit(1)) for s in sides if s.copies]
    return reduce(lambda a, b: a * b, counts, F.lit(1).cast("bigint"))


def _chain(base: DataFrame, sides: Sequence[Side], keys: list[str], counted: bool) -> DataFrame:
    for side in sides:
        base = base.join(side.rows, keys, side.how)
    if not counted:
        return base
    return base.withColumn("copies", _counts(sides)).drop(*[s.copies for s in sides if s.copies])


def _unmatched(base: DataFrame, sides: Sequence[Side], keys: list[str], counted: bool) -> DataFrame:
    """What an outer join gives for rows that cannot match."""
    empty = {
        field.name: F.lit(None).cast(field.dataType)
        for side in sides
        for field in side.rows.schema
        if field.name not in keys and field.name != side.copies
    }
    if counted:
        empty["copies"] = F.lit(1).cast("bigint")
    return base.withColumns(empty)


def _slotted(df: DataFrame, slot: str, copies: str) -> DataFrame:
    """Equal rows as one with a count, and every row's count dealt out to its ``_slots``.

    Different rows spread by their hash. Many copies of one row become one row in
    each slot that carries its part of the count.
    """
    columns = [name for name in df.columns if name != "_slots"]
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("_rows"), F.max("_slots").alias("_slots"))
        .withColumn("_part", F.explode(F.expr("sequence(0L, _slots - 1)")))
        .withColumn(copies, F.expr("cast(floor((_rows + _slots - 1 - _part) / _slots) AS bigint)"))
        .filter(F.col(copies) > 0)
        .withColumn(slot, F.pmod(F.xxhash64(*columns) + F.col("_part"), F.col("_slots")).cast("int"))
        .drop("_part", "_rows")
    )


def _hot_chain(
    base: DataFrame, sides: Sequence[Side], keys: list[str], counted: bool, table: DataFrame
) -> DataFrame:
    """The chain for few order ids with very many rows.

    ``base`` is cut into slots by its rows. A side with one row per key has that row in every
    slot. Any other side is cut into slots by its own rows, and each base slot
    meets each side slot once, so a task holds one part of both. Side slots that have no row
    for a key are left out first, which keeps outer joins exact.
    """
    joined = _slotted(_hot(base, table, keys), "_slot", "_n").drop("_slots")
    for side in sides:
        rows = _hot(side.rows, table, keys)
        if side.unique:
            joined = joined.join(_every_slot(rows), [*keys, "_slot"], side.how)
            continue
        cut = _slotted(rows, "_side_slot", "_side_n")
        # One row per hot id, window and slot, with as many numbers as the side has slots.
        present = _every_slot(cut.groupBy(*keys, "_slots").agg(F.collect_set("_side_slot").alias("_side_slots")))
        joined = (
            joined.join(present, [*keys, "_slot"], side.how)
            .withColumn("_side_slot", F.explode_outer("_side_slots"))
            .drop("_side_slots")
            .join(_every_slot(cut), [*keys, "_side_slot", "_slot"], side.how)
            .withColumn("_n", F.col("_n") * F.coalesce("_side_n", F.lit(1)))
            .drop("_side_slot", "_side_n")
        )
    if counted:
        return joined.withColumn("copies", F.col("_n") * _counts(sides)).drop(
            "_slot", "_n", *[s.copies for s in sides if s.copies]
        )
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).drop(
        "_slot", "_n"
    )
