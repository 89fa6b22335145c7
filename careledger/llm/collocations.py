"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

The corpus is split into words once; its shards are then scanned in turn, again and again. Words
are counted in the first cycle. A longer phrase becomes active once both phrases it is made of,
without its last and without its first word, have reached the threshold; from the next shard on
it is counted, together with all other active phrases of any length, until it has seen each
shard once.

The scans count 64-bit hashes. What has reached the threshold goes to the tasks as one bit per
bucket of hashes, a table of a bit per word of the corpus and of bounded size, broadcast once
and given up when no scan needs it. Phrases that share hashes or buckets are counted too much or
too early, never too little: the table loses no bit, so whatever became active stays so for a
full cycle. A last scan counts the words of all phrases that reached the threshold, which makes the counts
exact. In it, a task adds up what it has met and deals it as packed phrases to groups of their hashes,
where the counts of all tasks are added up. Counts never leave Spark; the driver sees the bits alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.shared import cut, loose_bytes, new_path, squeezed_bytes, whole

#: Phrases have so many words at most and stand so often at least.
MOST_WORDS, LEAST_COUNT = 4, 30
#: A phrase goes when a longer one has so many hundredths of its count.
COVERED = 80
SCALE = 2_000_000
#: Phrases reported of each language.
TOP = 2000
SHARDS = 3
#: Most bits of the table of buckets that have reached the threshold; more bits, fewer spare counts.
BITS = 1 << 27
#: Least bits of it.
_FEW_BITS = 1 << 16
#: Tokens and different words that a task holds before it passes counts on.
_TOKENS, _WORDS = 2_000_000, 150_000
#: Words of a language whose hashes a task remembers.
_KNOWN = 100_000
#: Words of a text that are taken at a time.
_SLICE = 100_000
#: Bits of a word's number in a phrase's key.
_WIDTH = 21
#: Phrases that a task of the last scan adds up before it passes them on.
_PHRASES = 300_000
#: Bits of the table for each group that phrases are dealt to.
_GROUP_BITS = 1 << 18

# A-Z to lower case; what ends a piece to a byte that UTF-8 never has.
_SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10)
_END = b"\xff"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BUCKET = 32768  # of Spark's bitmap functions


def _words(text: bytes) -> list[bytes]:
    """The words of a text, and ``_END`` where a piece ends."""
    return text.translate(_SPLIT).replace(_END, b" \xff ").split()


class _Tokens(dict):
    """A 32-bit hash of each word of a language; 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self._seed = zlib.crc32(lang.encode())

    def __missing__(self, word: bytes) -> int:
        token = xxhash.xxh32_intdigest(word, self._seed) or 1
        if len(self) < _KNOWN:
            self[word] = token
        return token


def _encoded(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The tokens of each text as unsigned 32-bit numbers, how many there are, and its shard."""
    known: dict[str, _Tokens] = {}
    for batch in batches:
        blobs, sizes, shard = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if lang not in known and len(known) > 50:
                known.clear()
            words, tokens = _words(text.as_py()), known.setdefault(lang, _Tokens(lang))
            blobs.append(np.fromiter(map(tokens.__getitem__, words), np.uint32, len(words)).tobytes())
            sizes.append(len(words))
            shard.append(zlib.crc32(blobs[-1]) % shards)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shard, pa.int32())],
            ["tokens", "size", "shard"],
        )


def _first(token: np.ndarray) -> np.ndarray:
    """The hash of each word as a phrase of its own."""
    mixed = token.astype(np.uint64) * _MIX
    return (mixed ^ (mixed >> np.uint64(31))) * _MIX


def _longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes of phrases, each with one more word."""
    return (hashes ^ (hashes >> np.uint64(29))) * _MIX + last


def _set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the buckets of ``hashes`` have their bit in the table."""
    at = hashes & np.uint64(8 * len(table) - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _scan(
    batches: Iterator[pa.RecordBatch],
    now: Broadcast | None,
    earlier: Broadcast | None,
    words_too: bool,
    most_tokens: int,
) -> Iterator[pa.RecordBatch]:
    """key and n: counts of the hashes of all active phrases."""
    now, earlier = (table and table.value for table in (now, earlier))
    held: list[np.ndarray] = []
    fresh: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        token, new = np.concatenate(held), np.concatenate(fresh)
        held.clear()
        fresh.clear()
        first, inside = _first(token), token > 0
        hashes, found = first, [first[inside & new]] if words_too else []
        for length in range(2, MOST_WORDS + 1 if now is not None else 2):
            inside = inside[:-1] & inside[1:]
            at = np.flatnonzero(inside & new[length - 1 :])
            at = at[_set(now, hashes[at])]
            at = at[_set(now, hashes[at + 1])]
            if earlier is not None:
                at = at[~(_set(earlier, hashes[at]) & _set(earlier, hashes[at + 1]))]
            hashes = _longer(hashes[:-1], first[length - 1 :])
            found.append(hashes[at])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for batch in batches:
        for blob in batch.column("tokens"):
            own = np.frombuffer(blob.as_buffer(), np.uint32)
            for start in range(0, len(own), most_tokens):
                before = min(start, MOST_WORDS - 1)
                part = own[start - before : start + most_tokens]
                held += [np.zeros(1, np.uint32), part]
                fresh += [np.zeros(1 + before, bool), np.ones(len(part) - before, bool)]
                size += len(part)
                if size > most_tokens:
                    yield counted()
                    size = 0
    if size:
        yield counted()


class _Numbers(dict):
    """Numbers of words in the order they are met; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Held:
    """The words of one language that a task holds. ``fresh`` ones end phrases that are not counted yet."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.tokens: list[np.ndarray] = []
        self.fresh: list[np.ndarray] = []

    def add(self, words: list[bytes], context: int) -> None:
        own = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.tokens += [np.zeros(1, np.int64), own]
        self.fresh += [np.zeros(1 + context, bool), np.ones(len(words) - context, bool)]


def _spelled(lang: str, held: _Held, table: np.ndarray) -> Iterator[pa.Table]:
    """The counts of all phrases in the table that end in fresh tokens, and of all words together, with their hashes."""
    words = list(held.numbers)
    token, fresh = np.concatenate(held.tokens), np.concatenate(held.fresh)
    tokens = _Tokens(lang)
    own = _first(np.fromiter(map(tokens.__missing__, words), np.uint32, len(words)))

    def rows(length: int, places: np.ndarray, n: np.ndarray, keys: np.ndarray) -> Iterator[pa.Table]:
        """``places``: of one occurrence of each phrase, at its last word."""
        for start in range(0, len(places), 100_000):
            part = slice(start, start + 100_000)
            ids = [token[places[part] - back].tolist() for back in range(length - 1, -1, -1)]
            phrases = [b" ".join([words[i] for i in phrase]) for phrase in zip(*ids, strict=True)] if length else [b""]
            yield pa.table({"phrase": pa.array(phrases, pa.binary()), "n": n[part].astype(np.int64), "key": keys[part]})

    frequent = _set(table, own)
    frequent[0] = False
    many = np.bincount(token[fresh], minlength=len(words))
    many[0] = 0
    yield from rows(0, np.zeros(1, np.int64), np.array([many.sum()]), np.zeros(1, np.uint64))
    seen = np.zeros(len(words), np.int64)
    seen[token] = np.arange(len(token))
    met = np.flatnonzero(frequent & (many > 0))
    yield from rows(1, seen[met], many[met], own[met])

    # ``starts``: where the frequent phrases of the last length start.
    hashes = first = own[token]
    starts = frequent[token]
    for length in range(2, MOST_WORDS + 1):
        at = np.flatnonzero(starts[:-1] & starts[1:])
        longer = _longer(hashes[at], first[at + length - 1])
        at, longer = (x[_set(table, longer)] for x in (at, longer))
        hashes, starts = np.zeros(len(hashes) - 1, np.uint64), np.zeros(len(starts) - 1, bool)
        hashes[at], starts[at] = longer, True
        start = at[fresh[at + length - 1]]
        end = start + length - 1
        if not len(end):
            continue
        if length < MOST_WORDS:
            key = np.zeros(len(end), np.int64)
            for back in range(length - 1, -1, -1):
                key = key << _WIDTH | token[end - back]
        else:  # four numbers are too wide, so pairs of words are numbered first
            pairs = np.concatenate([token[end - 3] << _WIDTH | token[end - 2], token[end - 1] << _WIDTH | token[end]])
            _, number = np.unique(pairs, return_inverse=True)
            key = number[: len(end)] << 32 | number[len(end) :]
        _, one, times = np.unique(key, return_index=True, return_counts=True)
        yield from rows(length, end[one], times, hashes[start[one]])


def _dealt(lang: str, met: list[pa.Table], groups: int) -> pa.RecordBatch:
    """The phrases of a task by group of their hashes, packed, each once with its count."""
    found = pa.concat_tables(met).group_by(["phrase", "key"]).aggregate([("n", "sum")])
    group = (_longer(found["key"].to_numpy(), np.uint64(0)) >> np.uint64(32)) % np.uint64(groups)
    order = np.argsort(group.astype(np.uint16), kind="stable")
    many = np.bincount(group.astype(np.int64), minlength=groups)
    own = np.flatnonzero(many)
    ends = np.cumsum(many[own])
    lists = pa.LargeListArray.from_arrays(np.r_[0, ends], found["phrase"].take(order).combine_chunks())
    n = np.split(found["n_sum"].to_numpy()[order], ends[:-1])
    joined = pc.binary_join(lists, b"\n")  # which ends pieces, so no phrase has it
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(own)),
            pa.array(own, pa.int32()),
            pa.array([squeezed_bytes(x.as_py()) for x in joined], pa.binary()),
            pa.array([squeezed_bytes(x.tobytes()) for x in n], pa.binary()),
        ],
        ["lang", "group", "phrases", "n"],
    )


def _spell(
    batches: Iterator[pa.RecordBatch], table: Broadcast, limits: tuple[int, int, int], groups: int
) -> Iterator[pa.RecordBatch]:
    most_tokens, most_words, slice_ = limits
    held: dict[str, _Held] = {}
    met: dict[str, list[pa.Table]] = {}
    size = 0

    def spelled() -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            met.setdefault(lang, []).extend(_spelled(lang, own, table.value))
        held.clear()
        if sum(len(t) for own in met.values() for t in own) > _PHRASES:
            yield from dealt()

    def dealt() -> Iterator[pa.RecordBatch]:
        for lang in list(met):
            yield _dealt(lang, met.pop(lang), groups)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            words = _words(text.as_py())
            for start in range(0, len(words), slice_):
                context = min(start, MOST_WORDS - 1)
                part = words[start - context : start + slice_]
                held.setdefault(lang, _Held()).add(part, context)
                size += len(part)
                if size > most_tokens or sum(len(h.numbers) for h in held.values()) > most_words:
                    yield from spelled()
                    size = 0
    yield from spelled()
    yield from dealt()


def _added(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The counts of a group's phrases of one language, added up."""
    lang, sums = None, pa.table({"phrase": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    for batch in batches:
        for first in range(0, batch.num_rows, 100):
            some = batch.slice(first, 100)
            lang = some.column("lang")[0]
            phrases = pa.array([loose_bytes(x.as_py()) for x in some.column("phrases")], pa.binary())
            n = np.concatenate([np.frombuffer(loose_bytes(x.as_py()), np.int64) for x in some.column("n")])
            more = pa.table({"phrase": pc.split_pattern(phrases, b"\n").flatten(), "n": n})
            added = pa.concat_tables([sums, more]).group_by("phrase").aggregate([("n", "sum")])
            sums = added.select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])
    spaces = pc.count_substring(sums["phrase"], b" ")
    words = pc.if_else(pc.equal(pc.binary_length(sums["phrase"]), 0), 0, pc.add(spaces, 1)).cast(pa.int32())
    found = sums.append_column("words", words).filter(pc.or_(pc.greater_equal(sums["n"], least), pc.equal(words, 0)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([lang and lang.as_py()] * len(found), pa.string()),
            found["phrase"].combine_chunks().cast(pa.string()),
            found["words"].combine_chunks(),
            found["n"].combine_chunks(),
        ],
        ["lang", "phrase", "words", "n"],
    )


def _bits_of(keys: DataFrame, bits: int) -> np.ndarray:
    """The table of the buckets of ``keys``, of ``bits`` bits however many keys there are."""
    bit = F.expr(f"key & {bits - 1}L") + 1
    made = keys.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    table = np.zeros(max(bits, _BUCKET) // 8, np.uint8)
    for r in made.collect():
        start = (r["part"] - 1) * _BUCKET // 8
        table[start : start + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return table[: bits // 8]


def reached(docs: DataFrame, shards: int, least: int, bits: int, most_tokens: int = _TOKENS) -> Broadcast:
    """The table of all phrases of (lang, text) rows that may stand ``least`` times, by dynamic itemset counting.

    It has a bit per word, ``bits`` at most. All scans use one size, as a bit that is set must stay set.
    A table is broadcast once for all scans that use it, and the older ones are given up.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "shards")
    schema = "tokens binary, size long, shard int"
    docs.mapInArrow(partial(_encoded, shards=shards), schema).write.partitionBy("shard").parquet(path)
    there = spark.read.schema(schema).parquet(path)
    size = there.agg(F.sum("size")).first()[0] or 0
    bits = min(bits, max(_FEW_BITS, 1 << (size - 1).bit_length()))

    marks: list[bytes] = []  # in place of the tables, which would fill the driver
    sent: list[Broadcast] = []
    state = None
    for step in range(MOST_WORDS * shards):
        old = step - shards - 1
        if old >= 0 and marks[-1] == marks[old]:
            break  # no phrase has become active in the last cycle
        now, earlier = sent[-1] if sent else None, sent[old] if old >= 0 else None
        scan = partial(_scan, now=now, earlier=earlier, words_too=step < shards, most_tokens=most_tokens)
        shard = there.filter(F.col("shard") == step % shards).select("tokens")
        counted = shard.mapInArrow(scan, "key long, n long").withColumn("first", F.lit(step))
        if state is not None:
            counted = counted.unionByName(state)
        merged = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        # A phrase first met in some step has been through a full cycle so many steps later at most.
        running = F.col("first") + shards - 1 > step
        state = cut(merged.filter((F.col("n") >= least) | running), "phrases")
        table = _bits_of(state.filter(F.col("n") >= least), bits)
        marks.append(hashlib.sha256(table).digest())
        sent.append(spark.sparkContext.broadcast(table))
        if earlier is not None:
            earlier.destroy(blocking=True)
    for older in sent[max(0, len(sent) - 1 - shards) : -1]:
        older.destroy(blocking=True)
    return sent[-1]


def phrase_counts(
    docs: DataFrame,
    shards: int = SHARDS,
    least: int = LEAST_COUNT,
    bits: int = BITS,
    limits: tuple[int, int, int] = (_TOKENS, _WORDS, _SLICE),
) -> DataFrame:
    """lang, phrase, words and n of all phrases with ``least`` occurrences in their language.

    The row with no words holds the number of all words of its language. ``limits`` are the tokens
    and different words that a task holds, and the words of a text taken at a time.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole().cast("binary").alias("text")
    )
    table = reached(rows, shards, least, bits, limits[0])
    groups = max(4, 8 * table.value.nbytes // _GROUP_BITS)
    spell = partial(_spell, table=table, limits=limits, groups=groups)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added(batches, least)

    spelled = rows.mapInArrow(spell, "lang string, group int, phrases binary, n binary")
    counts = spelled.groupBy("lang", "group").applyInArrow(add, "lang string, phrase string, words int, n long")
    counted = cut(counts, "counts")
    table.destroy(blocking=True)
    return counted


def _phrase(words: str, start: int | Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of every phrase of several words, by its weakest cut."""
    parts = counts.filter("words > 0")
    candidates = parts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "words",
        F.col("n").alias("a"),
        "k",
        _phrase("w", 1, F.col("k")).alias("left"),
        _phrase("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(weakest.alias("least"))
        .select("lang", "phrase", "words", "a", "least.l", "least.r", "least.score")
    )


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The phrases (lang, phrase, words, a) that no longer one nearly always stands around."""
    inner = (
        candidates.filter("words > 2")
        .withColumn("w", F.split("phrase", " "))
        .withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
        .select("lang", _phrase("w", F.col("start"), F.col("length")).alias("phrase"), F.col("a").alias("around"))
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    gone = candidates.join(most, ["lang", "phrase"]).filter(100 * F.col("around") >= covered * F.col("a"))
    return candidates.join(gone.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, top: int = TOP, shards: int = SHARDS, least: int = LEAST_COUNT, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of every language.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as
    often as they stand. Other columns are not read; an empty table gives no rows.
    """
    counts = phrase_counts(docs, shards, least, **how)
    candidates = cut(scored(counts), "scored")
    kept = uncovered(candidates)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each of a fixed number of parts passes its first ones on, so one language is no hot group.
    some = Window.partitionBy("lang", "part").orderBy(*order)
    parts = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(16)))
    first = parts.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("n"))
    return (
        ranked.filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
