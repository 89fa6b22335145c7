"""One timeline per order across all inputs that have times, and how often each state follows another.

Every order has two lines: ``life`` (created, assigned, delivered, cancelled) and ``care``
(created, contacted, adjusted, conceded). An order id that holds a large share of all events does
not meet in one task: neighbours are first looked up inside a day, then only between the last state
of a day and the first one of the next. So a task holds at most the different events of a day, or
the days of the calendar, of one order.

All events are dealt once, and packed: a task sends, of an order and day, the different places as
numbers and how many events there were of each state. What is dealt after that is a row for each
order, line and day.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order among events of the same instant.
STATES = ("created", "assigned", "delivered", "cancelled", "contacted", "adjusted", "conceded")
START = "start"
#: Microseconds of a day.
DAY = 86_400_000_000


def order_events(tables: Mapping[str, DataFrame]) -> DataFrame:
    """line, order_uuid, at and state of every event; events without order or time are left out.

    All times are UTC. Cancellations count where the order was really cancelled. The creation
    of an order that each of its legs repeats is one event.
    """
    legs, cancels = tables["deliveries"], tables["cancellations"].filter("order_status_cancel_ind")
    sources = [
        (legs, "order_created_time_utc", "created", ("life", "care")),
        (legs, "delivery_created_time_utc", "assigned", ("life",)),
        (legs, "dropoff_complete_time_utc", "delivered", ("life",)),
        (cancels, "cancellation_time_utc", "cancelled", ("life",)),
        (tables["tickets"], "created_time", "contacted", ("care",)),
        (tables["adjustments"], "adjustment_timestamp_utc", "adjusted", ("care",)),
        (tables["concessions"], "issue_timestamp_utc", "conceded", ("care",)),
    ]

    def events(df: DataFrame) -> DataFrame:
        """All events of one input from one scan of it."""
        found = F.array(
            *[
                F.struct(F.lit(line).alias("line"), "order_uuid", F.col(time).alias("at"), F.lit(state).alias("state"))
                for source, time, state, lines in sources
                if source is df
                for line in lines
            ]
        )
        return df.select(F.inline(found))

    # Only above the inputs, so that those of the same tables still read and deal the same rows once.
    inputs = list({id(source): source for source, *_ in sources}.values())
    return reduce(DataFrame.unionByName, map(events, inputs)).filter("order_uuid IS NOT NULL AND at IS NOT NULL")


def _rank(state: Column) -> Column:
    """From 1 on, so that 0 can stand for ``start``."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), state)
    unknown = F.concat(F.lit("not a state of a timeline: "), F.coalesce(state, F.lit("NULL")))
    return F.when(rank > 0, rank).otherwise(F.raise_error(unknown).cast("bigint"))


def _micros(events: DataFrame) -> Column:
    """Microseconds of ``at``, by its own clock if it has no time zone."""
    if dict(events.dtypes)["at"] == "timestamp":
        return F.unix_micros("at")
    at = F.col("at").cast("timestamp_ntz")
    seconds = (F.unix_date(at.cast("date")).cast("bigint") * 24 + F.hour(at)) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def legal(before: Column, state: Column) -> Column:
    """Whether ``state`` may follow ``before`` on a line."""
    first = (before == START) & (state == "created")
    over = (before == "cancelled") & state.isin("assigned", "delivered", "cancelled")
    late = (before == "delivered") & (state == "cancelled")
    return first | ((before != START) & (state != "created") & ~over & ~late)


def transitions(events: DataFrame) -> DataFrame:
    """line, from_state, to_state, legal, orders and times: how often one event follows another.

    The first event of an order follows ``start``. Events of one instant follow each other in the
    order of ``STATES``; equal ones follow each other, but for equal creations, which are one.
    """
    c = F.col
    order = ["order_uuid", "line"]
    micros = events.select(*order, _micros(events).alias("_micros"), _rank(c("state")).alias("_rank"))
    # Whole days from 1970 on, rounded towards it; an event without a time comes first.
    placed = micros.select(
        *order,
        F.expr(f"_micros div {DAY}").alias("_day"),
        (F.coalesce(c("_micros") % DAY, F.lit(0)) * 8 + c("_rank")).alias("_place"),
        "_rank",
    )
    repeatable = [rank for rank, state in enumerate(STATES, 1) if state != "created"]
    days = placed.groupBy(*order, "_day").agg(
        F.sort_array(F.collect_set("_place")).alias("_places"),
        F.array(*[F.count_if(c("_rank") == rank) for rank in repeatable]).alias("_events"),
    )
    states = days.select(
        *order, "_day", "_events", F.transform("_places", lambda place: place.bitwiseAND(F.lit(7))).alias("_states")
    )
    # A step is the rank before, times 8, and the rank; as an entry it has its number of times on top, times 64.
    follows = "zip_with(slice(_states, 1, size(_states) - 1), slice(_states, 2, size(_states) - 1), (x, y) -> x * 8 + y)"
    again = [
        F.expr(f"(_events[{i}] - size(filter(_states, x -> x = {rank}))) * 64 + {rank * 9}")
        for i, rank in enumerate(repeatable)
    ]
    different = F.size(F.filter("_states", lambda state: state != 1))
    repeated = reduce(Column.__add__, [c("_events")[i] for i in range(len(again))]) > different
    inside = states.select(
        *order,
        "_day",
        (F.element_at("_states", 1) * 8 + F.element_at("_states", -1)).alias("_ends"),
        F.when(F.size("_states") > 1, F.expr(follows)).alias("_follows"),
        F.when(repeated, F.filter(F.array(*again), lambda entry: entry >= 64)).alias("_copies"),
    )
    counted = F.transform(
        F.array_distinct("_follows"),
        lambda step: F.size(F.filter("_follows", lambda other: other == step)).cast("bigint") * 64 + step,
    )
    none = F.array().cast("array<bigint>")
    numbered = inside.select(
        *order, "_day", "_ends", F.concat(F.coalesce(counted, none), F.coalesce("_copies", none)).alias("_entries")
    )
    # Day, ends and entries go in one list, of two bytes each if all are small, as nearly always.
    # A day is two numbers there, and the least one where there is no time.
    high = F.coalesce(F.shiftright("_day", 15), F.lit(-(1 << 15)).cast("bigint"))
    low = F.coalesce(c("_day").bitwiseAND(F.lit((1 << 15) - 1)), F.lit(0).cast("bigint"))
    listed = numbered.select(*order, F.concat(F.array(high, low, c("_ends")), "_entries").alias("_list"))
    small = F.array_max("_list") < 1 << 15
    dealt = listed.select(
        *order,
        F.when(small, c("_list").cast("array<smallint>")).alias("_small"),
        F.when(~small, c("_list")).alias("_large"),
    ).repartition(*order)
    taken = dealt.select(*order, F.coalesce(c("_small").cast("array<bigint>"), "_large").alias("_list")).select(
        *order,
        (F.get("_list", 0) * (1 << 15) + F.get("_list", 1)).alias("_day"),
        F.get("_list", 2).alias("_ends"),
        F.expr("slice(_list, 4, size(_list) - 3)").alias("_entries"),
    )
    across = Window.partitionBy(*order).orderBy("_day")
    edge = F.coalesce(F.lag("_ends").over(across) % 8, F.lit(0)) * 8 + F.expr("_ends div 8") + 64
    entries = taken.select(*order, F.concat(F.array(edge), "_entries").alias("_entries"))
    steps = entries.select(*order, F.explode("_entries").alias("_entry")).select(
        *order, c("_entry").bitwiseAND(F.lit(63)).cast("int").alias("_step"), F.shiftright("_entry", 6).alias("n")
    )
    per_order = steps.groupBy(*order, "_step").agg(F.sum("n").alias("n"))
    found = per_order.groupBy("line", "_step").agg(F.count("*").alias("orders"), F.sum("n").alias("times"))
    names = F.array(*map(F.lit, (START, *STATES)))
    named = found.select(
        "line",
        F.element_at(names, F.expr("_step div 8 + 1").cast("int")).alias("from_state"),
        F.element_at(names, F.expr("_step % 8 + 1").cast("int")).alias("to_state"),
        "orders",
        "times",
    )
    ordered = legal(c("from_state"), c("to_state")).alias("legal")
    return named.select("line", "from_state", "to_state", ordered, "orders", "times")
