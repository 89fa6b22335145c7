"""Exact percentiles by distributed selection: narrow to the range that holds a rank, then look inside.

Equal values are counted first. Approximate cut points, a bounded number per column, split the
different values into ranges; the rows of each range are added up, and only ranges that hold
a wanted rank go on. After ``rounds`` such steps a window over what is left finds the value, so
no task holds more than a small share of a column, however its values are spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cut points of a range in each round.
CUTS = 64


def _narrowed(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """The rows of the ranges that hold a rank, with their range as ``part`` and the rows ``before`` it.

    ``rows``: the keys, value, n and the rows before the group; ``ranks``: column_name and rank.
    """
    points = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("value", points, 20 * CUTS).alias("cuts"))
    placed = rows.join(cuts, list(keys)).withColumn(part, F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sizes = placed.groupBy(*keys, "before", part).agg(F.sum("n").alias("size"))
    lower = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as cut points in each group.
    from_ = sizes.withColumn("from", F.col("before") + F.coalesce(F.sum("size").over(lower), F.lit(0)))
    inside = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + F.col("size"))
    held = from_.join(ranks, "column_name").filter(inside).select(*keys, part, "from").distinct()
    return placed.drop("before").join(held, [*keys, part]).withColumnRenamed("from", "before")


def exact_percentiles(
    df: DataFrame, stage: str, columns: Iterable[str], at: Sequence[float] = (0.25, 0.5, 0.75), rounds: int = 2
) -> DataFrame:
    """stage, column_name, null_share, percentile and value: interpolated between the two ranks around it.

    Values are compared as doubles and not rounded. A column without values has NULLs.
    """
    entries = F.array(
        *[F.struct(F.lit(name).alias("column_name"), F.col(name).cast("double").alias("value")) for name in columns]
    )
    counts = df.select(F.inline(entries)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("all"), F.sum(known).alias("total"))
    marks = totals.select("*", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("percentile")).withColumn(
        "place", F.col("percentile") * (F.col("total") - 1)
    )
    lo, hi = F.floor("place"), F.ceil("place")
    ranks = marks.filter("total > 0").select("column_name", F.explode(F.array(lo, hi)).alias("rank")).distinct()

    rows = counts.filter("value is not null").withColumn("before", F.lit(0).cast("bigint"))
    keys = ["column_name"]
    for i in range(rounds):
        rows = _narrowed(rows, ranks, keys, f"part{i}")
        keys = [*keys, f"part{i}"]
    running = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.col("before") + F.sum("n").over(running))
    inside = (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n"))
    found = ends.join(ranks, "column_name").filter(inside).select("column_name", "rank", "value")
    low = found.select("column_name", F.col("rank").alias("lo"), F.col("value").alias("low"))
    high = found.select("column_name", F.col("rank").alias("hi"), F.col("value").alias("high"))
    share = F.round((F.col("all") - F.col("total")) / F.col("all"), 6)
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.col("lo"))
    return (
        marks.withColumn("lo", lo)
        .withColumn("hi", hi)
        .join(low, ["column_name", "lo"], "left")
        .join(high, ["column_name", "hi"], "left")
        .select(
            F.lit(stage).alias("stage"),
            "column_name",
            share.alias("null_share"),
            "percentile",
            F.round(between, 4).alias("value"),
        )
    )
