"""Date windows of a run.

A window turns "rows of this table that belong to the run" into a filter. The
bounds are literals, so they reach the scan. :class:`WindowSet` does the same for
many windows in one pass and adds ``window_id``; stages carry ``window.keys`` in
every group and join key, which makes them work for one window and for many.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = timedelta(days=1)


def months_before(day: date, months: int) -> date:
    """``day`` moved back by whole months, clamped to the end of the month."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def as_int(day: date) -> int:
    """``day`` in yyyymmdd form."""
    return day.year * 10_000 + day.month * 100 + day.day


class _Bounds:
    """Inclusive bounds; ``last`` may be open."""

    keys: tuple[str, ...] = ()

    def __init__(self, first: date, last: date | None) -> None:
        self.first, self.last = first, last

    def holds(self, column: Column) -> Column:
        """True where a date lies in the window."""
        after = column >= F.lit(self.first)
        return after if self.last is None else after & (column <= F.lit(self.last))

    def within(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose date lies in the window."""
        return df.filter(self.holds(F.col(column)))

    def within_int(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose yyyymmdd integer lies in the window.

        Compared as an integer: equal to parsing it for valid dates, and it is
        pushed to the scan while a parse is not.
        """
        keep = F.col(column) >= as_int(self.first)
        if self.last is not None:
            keep &= F.col(column) <= as_int(self.last)
        return df.filter(keep)


class PaddedWindow(_Bounds):
    """``start`` to ``end`` with one day of padding on both sides."""

    def __init__(self, start: date, end: date) -> None:
        super().__init__(start - _DAY, end + _DAY)
        self.start, self.end = start, end

    def exact(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose date lies in the window without its padding."""
        return df.filter(F.col(column).between(F.lit(self.start), F.lit(self.end)))


class RollingWindow(_Bounds):
    """The last ``months`` before ``as_of``, open at the end."""

    def __init__(self, as_of: date, months: int = 6) -> None:
        super().__init__(months_before(as_of, months), None)
        self.as_of = as_of


class WindowSet:
    """Many padded windows at once, as ``(window_id, start, end)``.

    Each window is spread over its days, and rows meet their windows by an
    equi-join on the day: a range condition would plan a nested loop.
    """

    keys = ("window_id",)

    def __init__(self, spark: SparkSession, windows: Iterable[tuple[str, date, date]]) -> None:
        self.windows = [(str(name), start, end) for name, start, end in windows]
        if len({name for name, _, _ in self.windows}) != len(self.windows):
            raise ValueError("window ids must be unique")
        rows = [
            F.struct(
                F.lit(name).alias("window_id"),
                F.lit(start).alias("window_start"),
                F.lit(end).alias("window_end"),
            )
            for name, start, end in self.windows
        ]
        table = spark.range(1).select(F.inline(F.array(*rows)))
        days = table.select(
            "window_id",
            F.explode(
                F.sequence(F.date_sub("window_start", 1), F.date_add("window_end", 1))
            ).alias("_day"),
            "window_start",
            "window_end",
        )
        exact = days.filter(F.col("_day").between(F.col("window_start"), F.col("window_end")))
        self._padded = days.select("window_id", "_day")
        self._padded_int = days.select(
            "window_id",
            (F.year("_day") * 10_000 + F.month("_day") * 100 + F.day("_day")).alias("_day"),
        )
        self._exact = exact.select("window_id", "_day")
        self.first = min(start for _, start, _ in self.windows) - _DAY
        self.last = max(end for _, _, end in self.windows) + _DAY
        self._hull = _Bounds(self.first, self.last)

    def holds(self, column: Column) -> Column:
        """True where a date lies between the first and the last day of all windows."""
        return self._hull.holds(column)

    def within(self, df: DataFrame, column: str) -> DataFrame:
        """Rows in any window, once per window that holds them, with ``window_id``."""
        return self._tag(self._hull.within(df, column), column, self._padded)

    def within_int(self, df: DataFrame, column: str) -> DataFrame:
        return self._tag(self._hull.within_int(df, column), column, self._padded_int)

    def exact(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose date lies in their own window without its padding."""
        days = self._exact.withColumnRenamed("_day", column)
        return df.join(days, ["window_id", column], "left_semi")

    @staticmethod
    def _tag(df: DataFrame, column: str, days: DataFrame) -> DataFrame:
        return df.join(days.withColumnRenamed("_day", column), column)


Window = PaddedWindow | RollingWindow | WindowSet
