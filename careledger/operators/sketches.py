"""The approximate form of the value-set check: sketches per day that merge to any window without a rescan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's registers; the error of a count is about 1.04 / sqrt(2 ** REGISTERS).
REGISTERS = 14


def value_sketches(df: DataFrame, day: str, columns: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """day, column_name, rows, longest and a sketch of the different values of each column.

    Worth writing: sketches are of bounded size and made per task before the exchange.
    """
    entries = F.array(
        *[F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")) for name in columns]
    )
    values = df.select(F.col(day).alias("day"), F.inline(entries))
    return values.groupBy("day", "column_name").agg(
        F.count("*").alias("rows"),
        F.max(F.length("value")).alias("longest"),
        F.hll_sketch_agg("value", registers).alias("sketch"),
    )


def sketched_values(sketches: DataFrame, first: date, last: date) -> DataFrame:
    """column_name, rows, longest and the approximate number of values from ``first`` to ``last``."""
    within = sketches.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return within.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.max("longest").alias("longest"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("values"),
    )
