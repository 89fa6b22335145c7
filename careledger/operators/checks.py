"""Data-quality checks: one aggregation pass over a stage, a few rows as the result.

Column checks return ``stage, column_name, check, rows, bad_rows, detail``. No
check collects a frame, and none puts a group of unknown size into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from careledger.functions.columns import nested_columns, row_marks
from careledger.functions.windows import PaddedWindow, RollingWindow

_INT_RANGE = (-(2**31), 2**31 - 1)


class Recorder:
    """Stands for a frame in a column check and keeps what the check measures; see ``observed``."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str, str, Column, Column]] = []


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("none"))


def _span(low: Column, high: Column) -> Column:
    return F.concat(_text(low), F.lit(".."), _text(high))


def _long(df: DataFrame, stage: str, check: str, columns: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One aggregation for all columns, ``(bad rows, detail)`` each, as one row per column."""
    if isinstance(df, Recorder):
        df.found += [(stage, name, check, bad, detail) for name, (bad, detail) in columns.items()]
        return df
    measured = [F.count("*").alias("rows")]
    for i, (bad, detail) in enumerate(columns.values()):
        measured += [bad.alias(f"bad_{i}"), detail.alias(f"detail_{i}")]
    found = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"bad_{i}").alias("bad_rows"),
                F.col(f"detail_{i}").alias("detail"),
            )
            for i, name in enumerate(columns)
        ]
    )
    return (
        df.agg(*measured)
        .select("rows", F.inline(found))
        .select(
            F.lit(stage).alias("stage"),
            "column_name",
            F.lit(check).alias("check"),
            "rows",
            "bad_rows",
            "detail",
        )
    )


class Observed:
    """The rows of the checks that ran along with a frame, once an action has run it."""

    def __init__(self, observation: Observation, found: list[tuple[str, str, str, Column, Column]]):
        self._observation, self._found = observation, found

    def rows(self) -> list[tuple[str, str, str, int, int, str]]:
        """stage, column_name, check, rows, bad_rows and detail; waits for the first action."""
        got = self._observation.get
        return [
            (stage, name, check, got["rows"], got[f"bad_{i}"], got[f"detail_{i}"])
            for i, (stage, name, check, _, _) in enumerate(self._found)
        ]


def observed(
    df: DataFrame, stage: str, measure: Iterable[Callable[[Recorder, str], object]]
) -> tuple[DataFrame, Observed]:
    """``df`` with column checks that are measured while it is used, and where to read them.

    Each of ``measure`` calls a check of this module with the frame and stage that it gets. The checks cost no
    scan of their own: their sums come out of the job that writes or reads the frame. Only what the
    action really computes is measured, so use it below a write of the whole frame.
    """
    recorder = Recorder()
    for check in measure:
        check(recorder, stage)
    observation = Observation()
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, (_, _, _, bad, detail) in enumerate(recorder.found):
        sums += [bad.alias(f"bad_{i}"), detail.alias(f"detail_{i}")]
    return df.observe(observation, *sums), Observed(observation, recorder.found)


def numeric_text(
    df: DataFrame, stage: str, columns: Iterable[str], bounds: tuple[int, int] = _INT_RANGE
) -> DataFrame:
    """Texts that are not whole numbers within ``bounds``; detail is the range found."""

    def one(name: str) -> tuple[Column, Column]:
        number = F.col(name).try_cast("bigint")
        bad = F.col(name).isNotNull() & ~F.coalesce(number.between(*bounds), F.lit(False))
        return F.count_if(bad), _span(F.min(number), F.max(number))

    return _long(df, stage, "numeric_text", {name: one(name) for name in columns})


def value_set(df: DataFrame, stage: str, columns: Sequence[str], longest: int = 20) -> DataFrame:
    """Texts longer than ``longest``; detail is the number of values and the longest.

    Values are counted per column first, so a value that most rows have is one row
    per task before anything is shuffled.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
            for name in columns
        ]
    )
    values = df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    size = F.length("value")
    return values.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(size > longest, F.col("n"))), F.lit(0)).alias("bad_rows"),
        F.concat(
            F.lit("values="), F.count("value").cast("string"), F.lit(" longest="), _text(F.max(size))
        ).alias("detail"),
    ).select(
        F.lit(stage).alias("stage"),
        "column_name",
        F.lit("value_set").alias("check"),
        "rows",
        "bad_rows",
        "detail",
    )


def money_scale(df: DataFrame, stage: str, columns: Iterable[str]) -> DataFrame:
    """Amounts with more than two decimals; detail is the range."""
    return _long(
        df,
        stage,
        "money_scale",
        {
            name: (
                F.count_if(F.col(name) != F.round(name, 2)),
                _span(*[f(F.round(name, 2)).cast("decimal(18,2)") for f in (F.min, F.max)]),
            )
            for name in columns
        },
    )


def filter_coverage(df: DataFrame, stage: str, predicates: Mapping[str, Column]) -> DataFrame:
    """What each filter keeps and drops; bad rows are those it drops for being NULL."""
    return _long(
        df,
        stage,
        "filter_coverage",
        {
            name: (
                F.count_if(keep.isNull()),
                F.concat(
                    F.lit("kept="),
                    F.count_if(keep).cast("string"),
                    F.lit(" dropped="),
                    F.count_if(~keep).cast("string"),
                ),
            )
            for name, keep in predicates.items()
        },
    )


def in_window(
    df: DataFrame, stage: str, columns: Iterable[str], window: PaddedWindow | RollingWindow
) -> DataFrame:
    """Dates outside the window; detail is the range found."""
    return _long(
        df,
        stage,
        "in_window",
        {
            name: (
                F.count_if(~window.holds(F.col(name))),
                _span(F.min(name), F.max(name)),
            )
            for name in columns
        },
    )


def value_range(
    df: DataFrame, stage: str, bounds: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Values outside reasonable bounds; detail is the range and the NULLs."""
    return _long(
        df,
        stage,
        "value_range",
        {
            name: (
                F.count_if(~F.col(name).between(F.lit(low), F.lit(high))),
                F.concat(
                    _span(F.min(name), F.max(name)),
                    F.lit(" nulls="),
                    F.count_if(F.col(name).isNull()).cast("string"),
                ),
            )
            for name, (low, high) in bounds.items()
        },
    )


def percentiles(
    df: DataFrame, columns: Iterable[str], at: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10_000
) -> DataFrame:
    """Approximate percentiles per column, from mergeable summaries of bounded size."""
    names = list(columns)
    points = [float(p) for p in at]
    found = df.agg(
        *[F.percentile_approx(name, points, accuracy).cast("array<double>").alias(name) for name in names]
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("column_name"), F.col(name).alias("found")) for name in names]
    )
    marks = F.array(*[F.lit(p) for p in points])
    return (
        found.select(F.inline(rows))
        .select("column_name", F.inline(F.arrays_zip(marks.alias("percentile"), F.col("found").alias("value"))))
    )


def counted_percentiles(
    df: DataFrame, stage: str, columns: Mapping[str, int], at: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Exact percentiles of values rounded to a scale, and the share of NULLs.

    ``columns`` maps a name to the decimals that count. Equal values are counted per task
    before the shuffle; the last step merges one count per different value.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.round(F.col(name).cast("double"), scale).alias("value"))
            for name, scale in columns.items()
        ]
    )
    counts = df.select(F.inline(entries)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    points = F.array(*[F.lit(float(p)) for p in at])
    found = counts.groupBy("column_name").agg(
        F.percentile("value", points, F.col("n")).alias("found"),
        F.round(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("null_share"),
    )
    marks = F.arrays_zip(points.alias("percentile"), F.col("found").alias("value"))
    return found.select(F.lit(stage).alias("stage"), "column_name", "null_share", F.inline(marks)).withColumn(
        "value", F.round("value", 4)
    )


def time_order(df: DataFrame, stage: str, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Pairs of times in the wrong order; detail counts the pairs compared."""
    return _long(
        df,
        stage,
        "time_order",
        {
            f"{first} <= {then}": (
                F.count_if(F.col(then) < F.col(first)),
                F.concat(
                    F.lit("compared="), F.count_if(F.col(then) >= F.col(first)).cast("string")
                ),
            )
            for first, then in pairs
        },
    )


def sign_check(df: DataFrame, stage: str, negative_allowed: Mapping[str, bool]) -> DataFrame:
    """Negative values where none may be, or positive ones where costs are expected."""

    def one(name: str, negative: bool) -> tuple[Column, Column]:
        below, above = F.col(name) < 0, F.col(name) > 0
        return (
            F.count_if(above if negative else below),
            F.concat(
                F.lit("negative="),
                F.count_if(below).cast("string"),
                F.lit(" positive="),
                F.count_if(above).cast("string"),
            ),
        )

    return _long(
        df, stage, "sign", {name: one(name, negative) for name, negative in negative_allowed.items()}
    )


def allowed_values(df: DataFrame, stage: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values that are not in the documented list; detail counts NULLs."""
    return _long(
        df,
        stage,
        "allowed_values",
        {
            name: (
                F.count_if(~F.col(name).isin(*values)),
                F.concat(F.lit("nulls="), F.count_if(F.col(name).isNull()).cast("string")),
            )
            for name, values in allowed.items()
        },
    )


def fanout(report: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows beyond the first per order in each group of report A."""
    return report.select(
        *dimensions,
        "orders",
        "distinct_order_uuid",
        (F.col("orders") - F.col("distinct_order_uuid")).alias("repeated_rows"),
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compare two frames as bags: one row with both sizes and what only one has.

    One exchange on whole rows, and equal rows combine before it.
    """
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    more = F.sum("_side")
    rows = sides.groupBy(*left.columns).agg(
        more.alias("more"),
        F.count_if(F.col("_side") == 1).alias("left_rows"),
        F.count_if(F.col("_side") == -1).alias("right_rows"),
    )
    zero = F.lit(0).cast("bigint")
    return rows.agg(
        F.coalesce(F.sum("left_rows"), zero).alias("left_rows"),
        F.coalesce(F.sum("right_rows"), zero).alias("right_rows"),
        F.coalesce(F.sum(F.greatest("more", zero)), zero).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("more"), zero)), zero).alias("only_right"),
    )


def same_rows_by_parts(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None, parts: int = 4096
) -> DataFrame:
    """:func:`same_rows`, but only parts of the keys whose rows differ go through an exchange.

    Rows fall into ``parts`` by a hash of ``keys`` (default: the whole row). Each side is reduced to a
    number of rows and two sums of row hashes per part, in each task first, so no row
    is shuffled for that. At most ``parts`` numbers of differing parts are broadcast, and the rows in
    them are compared as whole rows. Two equal frames cost one scan of each side for the marks
    and one that keeps nothing; a part with different rows but equal sums, of two 64-bit hashes, would be missed.
    """
    columns = left.columns
    right = right.select(columns)
    part = F.pmod(F.xxhash64(*(keys or columns)), F.lit(parts)).cast("int")
    sides = [df.withColumn("_part", part) for df in (left, right)]
    zero = F.lit(0).cast("bigint")

    def marks(df: DataFrame, sign: int) -> DataFrame:
        sums = [(F.sum(mark) * sign).alias(f"_mark{i}") for i, mark in enumerate(row_marks(columns, nested_columns(df)))]
        n = F.count("*")
        return df.groupBy("_part").agg(
            (n if sign > 0 else zero).alias("left_rows"), (n if sign < 0 else zero).alias("right_rows"), *sums
        )

    both = (
        marks(sides[0], 1)
        .unionByName(marks(sides[1], -1))
        .groupBy("_part")
        .agg(*[F.sum(name).alias(name) for name in ("left_rows", "right_rows", "_mark0", "_mark1")])
    )
    differ = both.filter("left_rows <> right_rows OR _mark0 <> 0 OR _mark1 <> 0").select("_part")
    only = same_rows(*[df.join(F.broadcast(differ), "_part", "left_semi").drop("_part") for df in sides])
    sizes, found = ("left_rows", "right_rows"), ("only_left", "only_right")
    totals = both.agg(*[F.sum(name).alias(name) for name in sizes]).select(*sizes, *[zero.alias(name) for name in found])
    # One row each, added up, as a join of them would be a nested loop.
    added = totals.unionByName(only.select(*[zero.alias(name) for name in sizes], *found))
    return added.agg(*[F.coalesce(F.sum(name), zero).alias(name) for name in (*sizes, *found)])


Audit = tuple[str, DataFrame, DataFrame, Column, Column]


def join_audits(audits: Iterable[Audit]) -> DataFrame:
    """Sizes of both inputs of equi-joins and of their results, without joining them.

    An audit is a name, both sides and their keys. All keys of all audits go through one
    grouped count, so a key with very many rows is combined before the exchange and
    its pairs are multiplied, never made.
    """
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    audits = list(audits)

    def keys(name: str, side: DataFrame, key: Column, left: bool) -> DataFrame:
        return side.select(
            F.lit(name).alias("join_name"),
            key.cast("string").alias("key"),
            (one if left else zero).alias("l"),
            (zero if left else one).alias("r"),
        )

    sides = [keys(name, df, key, left) for name, x, y, kx, ky in audits for df, key, left in ((x, kx, True), (y, ky, False))]
    counts = (
        reduce(DataFrame.union, sides)
        .groupBy("join_name", "key")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    known = F.col("key").isNotNull()
    pairs = F.when(known, F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
    # Rows of a left join: every left row at least once.
    kept = F.when(known & (F.col("r") > 0), pairs).otherwise(F.col("l").cast("decimal(38,0)"))
    total = {
        "left_rows": F.sum("l"),
        "right_rows": F.sum("r"),
        "left_keys": F.count_if(known & (F.col("l") > 0)),
        "right_keys": F.count_if(known & (F.col("r") > 0)),
        "left_null_keys": F.sum(F.when(~known, F.col("l")).otherwise(0)),
        "right_null_keys": F.sum(F.when(~known, F.col("r")).otherwise(0)),
        "left_largest_key": F.max(F.when(known, F.col("l"))),
        "right_largest_key": F.max(F.when(known, F.col("r"))),
        "inner_rows": F.coalesce(F.sum(pairs), F.lit(0)).cast("decimal(38,0)"),
        "left_join_rows": F.coalesce(F.sum(kept), F.lit(0)).cast("decimal(38,0)"),
    }
    found = counts.groupBy("join_name").agg(*[column.alias(name) for name, column in total.items()])
    names = found.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(audit[0]) for audit in audits])).alias("join_name")
    )
    sizes = names.join(found, "join_name", "left")  # a join of two empty inputs has a row too
    return sizes.select(
        "join_name",
        *[F.coalesce(F.col(n), F.lit(0).cast(found.schema[n].dataType)).alias(n) for n in total],
        F.when(F.coalesce("left_rows", zero) >= F.coalesce("right_rows", zero), "left")
        .otherwise("right")
        .alias("larger_side"),
    )


def join_audit(
    name: str, left: DataFrame, right: DataFrame, left_key: Column, right_key: Column
) -> DataFrame:
    """:func:`join_audits` of a single join."""
    return join_audits([(name, left, right, left_key, right_key)])


def stage_counts(
    stages: Mapping[str, DataFrame], key: str = "order_uuid", same: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows, distinct keys, NULL keys and repeated rows of every stage that has the key.

    ``same`` names stages that have the very rows of another one, which is then read once.
    """
    twins = dict(same or {})

    def counted(stage: str, df: DataFrame) -> DataFrame:
        names = [stage, *[twin for twin, of in twins.items() if of == stage]]
        return df.agg(
            F.count("*").alias("rows"),
            F.count_distinct(key).alias("keys"),
            F.count_if(F.col(key).isNull()).alias("null_keys"),
        ).select(
            F.explode(F.array(*map(F.lit, names))).alias("stage"),
            "rows",
            "keys",
            "null_keys",
            (F.col("rows") - F.col("null_keys") - F.col("keys")).alias("repeated_rows"),
        )

    found = [counted(s, df) for s, df in stages.items() if key in df.columns and s not in twins]
    return reduce(DataFrame.unionByName, found)
