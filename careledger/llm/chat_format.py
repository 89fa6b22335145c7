"""Chat formatting chosen by schema fingerprint, in DataFrame functions.

Conversation records come in many layouts: prompt and response, instruction with input
and output, lists of messages under various names. Read together they are one table
whose columns are null where a layout lacks a field. The field paths that are present in
a row are hashed to a fingerprint; the fingerprint picks a declarative mapping; the
mapping yields canonical turns of role and text.

The template marks turns with strings that start with ``<``. Inside roles and texts the
characters that a control string can start with, ``<`` and ``[``, and the escape character
itself are escaped, so no text can hold a control string, and reading back is lossless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Escape first what escapes; undo in reverse order. Each escape is a backslash and a letter.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))

TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Single:
    """A layout with one field per turn: (role, path) in order; optional fields may lack."""

    turns: tuple[tuple[str, str], ...]
    optional: frozenset[str] = frozenset()

    def fingerprints(self) -> list[str]:
        fixed = [p for _, p in self.turns if p not in self.optional]
        extra = sorted(self.optional)
        return [
            fingerprint_of([*fixed, *some]) for n in range(len(extra) + 1) for some in combinations(extra, n)
        ]

    def canonical(self) -> Column:
        each = [
            F.when(F.col(path).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(path).alias("text")))
            for role, path in self.turns
        ]
        return F.array_compact(F.array(*each))


@dataclass(frozen=True)
class Listed:
    """A layout with a list of messages, the names of its fields, and other names of roles."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[str]:
        return [fingerprint_of([f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"])]

    def canonical(self) -> Column:
        def turn(message: Column) -> Column:
            name = message[self.role]
            named = reduce(lambda c, r: c.when(name == r[0], r[1]), self.roles[1:], F.when(name == self.roles[0][0], self.roles[0][1])).otherwise(name) if self.roles else name
            return F.struct(
                F.coalesce(named, F.lit("")).alias("role"),
                F.coalesce(message[self.text], F.lit("")).alias("text"),
            )

        return F.transform(F.col(self.path), turn)


Layout = Single | Listed

LAYOUTS: tuple[Layout, ...] = (
    Single((("user", "prompt"), ("assistant", "response"))),
    Single((("system", "instruction"), ("user", "input"), ("assistant", "output")), frozenset({"instruction"})),
    Single((("system", "meta.system"), ("user", "meta.question"), ("assistant", "meta.answer")), frozenset({"meta.system"})),
    Listed("messages", "role", "content"),
    Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
)


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _present(kind: T.DataType, value: Column, path: str) -> list[Column]:
    """For every leaf below ``value`` its path where it is present, else null."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _present(f.dataType, value[f.name], f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):

        def some(name: str) -> Column:
            return F.exists(value, lambda e: e[name].isNotNull())

        return [F.when(some(f.name), F.lit(f"{path}[].{f.name}")) for f in kind.elementType.fields]
    return [F.when(value.isNotNull(), F.lit(path))]


def fingerprint(records: DataFrame, fields: Sequence[str]) -> Column:
    """Hash of the sorted paths that are present below ``fields``, columns of ``records``."""
    found = [x for name in fields for x in _present(records.schema[name].dataType, F.col(name), name)]
    return F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*found))), "\n"), 256)


def canonical(records: DataFrame, fields: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``turns`` instead of ``fields``; null where no layout fits."""
    known = {name for name in fields}
    usable = [x for x in layouts if _roots(x) <= known]
    marked = records.withColumn("_schema", fingerprint(records, fields))
    empty = F.lit(None).cast(TURNS_TYPE)
    turns = empty
    for layout in usable:
        turns = F.when(F.col("_schema").isin(layout.fingerprints()), layout.canonical()).otherwise(turns)
    return marked.withColumn("turns", turns.cast(TURNS_TYPE)).drop("_schema", *fields)


def _roots(layout: Layout) -> set[str]:
    paths = [p for _, p in layout.turns] if isinstance(layout, Single) else [layout.path]
    return {p.split(".")[0] for p in paths}


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


def formatted(turns: Column) -> Column:
    """One text per conversation."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END)),
        ),
        "",
    )


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Spans (start from 0, chars) of the formatted text that the loss counts."""
    marks = len(TURN) + len(TEXT) + len(END)
    none = F.array().cast("array<struct<start:bigint,chars:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def step(state: Column, t: Column) -> Column:
        head, body = F.length(escaped(t["role"])), F.length(escaped(t["text"]))
        span = F.struct(
            (state["at"] + len(TURN) + head + len(TEXT)).cast("bigint").alias("start"),
            body.cast("bigint").alias("chars"),
        )
        return F.struct(
            (state["at"] + marks + head + body).cast("bigint").alias("at"),
            F.when(t["role"] == role, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, END.replace("|", "\\|")), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring(F.substring_index(p, TEXT, 1), len(TURN) + 1, 1 << 30)).alias("role"),
            unescaped(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    parts = F.transform(
        mask,
        lambda m: unescaped(F.substring(text, (m["start"] + 1).cast("int"), m["chars"].cast("int"))),
    )
    return F.array_join(parts, "")


def format_records(records: DataFrame, fields: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``formatted`` and ``mask`` instead of ``fields``.

    A record whose fingerprint no layout has gets null for both. Null roles and texts of a
    message count as empty.
    """
    shaped = canonical(records, fields, layouts)
    return shaped.select(
        *[c for c in shaped.columns if c != "turns"],
        formatted(F.col("turns")).alias("formatted"),
        loss_mask(F.col("turns")).alias("mask"),
    )


#: The fields of ``layouts_of_rows``.
FIELDS = ("prompt", "response", "instruction", "input", "output", "messages", "conversations")


def layouts_of_rows(rows: DataFrame) -> DataFrame:
    """One record per conversation of (conv_id, turn, role, text) rows, in mixed layouts.

    Turns are in order of turn, then role, then text. A conversation of user and assistant
    becomes prompt and response; with a system turn before them an instruction; longer
    ones with the three usual roles a list of ``from`` and ``value`` when their number of
    turns is odd; all others a list of messages. A record holds its whole conversation.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    shaped = grouped.withColumn("roles", F.array_join(F.transform("t", lambda x: F.replace(x["role"], F.lit(","), F.lit(";"))), ","))
    pair, triple = F.col("roles") == "user,assistant", F.col("roles") == "system,user,assistant"
    usual = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    shared = ~pair & ~triple & usual & (F.size("t") % 2 == 1)
    text = lambda i: F.get(F.col("t"), i)["text"]
    other_name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    return shaped.select(
        "conv_id",
        F.when(pair, text(0)).alias("prompt"),
        F.when(pair, text(1)).alias("response"),
        F.when(triple, text(0)).alias("instruction"),
        F.when(triple, text(1)).alias("input"),
        F.when(triple, text(2)).alias("output"),
        F.when(
            ~pair & ~triple & ~shared,
            F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))),
        ).alias("messages"),
        F.when(
            shared,
            F.transform("t", lambda x: F.struct(other_name(x["role"]).alias("from"), x["text"].alias("value"))),
        ).alias("conversations"),
    )


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Per conversation what its formatted text gives when read back.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars and
    loss_sha256 (of all assistant text under the mask), formatted_chars. A null conv_id is a
    conversation of its own; an empty table gives no rows; other columns are not read.
    """
    done = format_records(layouts_of_rows(rows), FIELDS)
    read = done.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        parsed(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("mask")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
