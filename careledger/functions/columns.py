"""Column builders: rule tables, latest-per-group picks, label maxima, durations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def sql_text(text: str) -> str:
    """``text`` as a literal of an SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mentions(name: str, pattern: str) -> str:
    """SQL: the column holds any phrase of ``pattern`` ("a|b|c").

    The patterns are plain phrases, so a byte search does what an unanchored
    regular expression would do, without leaving Spark's binary strings.
    """
    return " OR ".join(f"contains({name}, {sql_text(phrase)})" for phrase in pattern.split("|"))


def matchable(text: Column) -> Column:
    """``text`` in lower case and never NULL, for :func:`classify`.

    No rule matches the empty text, so NULL behaves as before, and the generated
    code of the rules needs no NULL handling: about half its size.
    """
    return F.coalesce(F.lower(text), F.lit(""))


def classify(
    name: str, rules: Sequence[tuple[str, str]], otherwise: str, first: str | None = None
) -> Column:
    """Ordered ``(pattern, result)`` rules over a :func:`matchable` column as one CASE.

    One SQL text, parsed once: built from Column calls, each phrase would cost a call
    into the JVM. ``otherwise`` is SQL; ``first`` is a WHEN branch before the rules.
    """
    whens = [f"WHEN {mentions(name, pattern)} THEN {sql_text(result)}" for pattern, result in rules]
    return F.expr(" ".join(["CASE", *([first] if first else []), *whens, f"ELSE {otherwise} END"]))


def lookup(code: Column, mapping: Mapping[str | int, str | int]) -> Column:
    """Value for a code, NULL for an unknown one."""
    (first, value), *others = mapping.items()
    return reduce(lambda chain, item: chain.when(code == item[0], item[1]), others, F.when(code == first, value))


def max_label(code: Column, mapping: Mapping[str, str]) -> Column:
    """``max`` over the texts that ``mapping`` gives for ``code``.

    Aggregates the alphabetical rank instead of the text, so the aggregate keeps a
    fixed-width buffer and Spark can hash it instead of sorting.
    """
    rank = {label: i for i, label in enumerate(sorted(set(mapping.values())))}
    found = F.max(lookup(code, {key: rank[text] for key, text in mapping.items()}))
    return lookup(found, {i: label for label, i in rank.items()})


def latest(value: Column, at: Column, *ties: Column) -> Column:
    """``value`` of the row with the greatest ``at``; a NULL value is kept.

    Rows without ``at`` never win. ``ties`` make the pick independent of row order.
    """
    return F.max_by(value, F.when(at.isNotNull(), F.struct(at, *ties)))


def earliest(value: Column, at: Column, *ties: Column) -> Column:
    """``value`` of the row with the least ``at``; see :func:`latest`."""
    return F.min_by(value, F.when(at.isNotNull(), F.struct(at, *ties)))


def whole_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, independent of the session time zone."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` as minutes, rounded to four places."""
    return F.round(whole_seconds(start, end) / F.lit(60.0), 4)


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def row_marks(columns: Sequence[str], nested: Sequence[str] = ()) -> list[Column]:
    """Two independent hashes of a row, as decimals that can be added up without overflow.

    A hash skips NULLs, so where they are is hashed too: (1, NULL) and (NULL, 1) differ.
    ``nested`` names the columns with NULLs inside, which are hashed as JSON. Sums of both marks
    over a bag of rows do not depend on their order; different bags share them by chance only.
    """
    missing = F.array(*[F.col(name).isNull() for name in columns])
    inner = set(nested)
    values = [
        F.to_json(name, {"ignoreNullFields": "false"}) if name in inner else F.col(name) for name in columns
    ]
    return [F.xxhash64(F.lit(seed), missing, *values).cast("decimal(20,0)") for seed in (1, 2)]


def nested_columns(df: DataFrame) -> list[str]:
    """The columns of ``df`` that hold arrays, maps or structs."""
    return [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
