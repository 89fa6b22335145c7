"""Toxicity of documents by a weighted lexicon that is learned from labels.

Texts are folded first: compatibility forms, look-alike letters of other scripts, accents,
and digits that stand for letters all become plain letters, other signs become spaces.
The lexicon holds words, and beginnings of words, weighted by how far the labelled rows
with them lean to toxic. One Aho-Corasick automaton finds all of them, and the exception
phrases that cancel a hit inside them, in a single pass over a text. The sum of weights
is normalised by the length of the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence, Set
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.llm.shared import documents_of, whole

#: Labelled rows that the lexicon is fitted on at most: those with the least hash of doc_id.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
#: Words in which one certain hit halves the distance to 1; longer texts need more hits.
WORDS_PER_HIT = 400
#: Beginnings of words that are tried as patterns, by length.
PREFIXES = range(4, 9)
#: Families of toxic rows that must have a pattern; a family shares its least shingle.
LEAST_FAMILIES = 4
LEAST_SHARE = 0.6
#: Texts whose features a task holds at a time, of the batch that Spark hands it.
_SLICE = 200

# Letters that look like others, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h",
    "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
}
# ``l`` and ``i`` are folded together, as 1 and | stand for both.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
INNER_SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "pond scum", "class clown")

_INNER = re.compile(r"(?<=\w)[@$!€](?=\w)")


def _folding() -> dict[int, str]:
    """What single characters become, after lower-casing."""
    table = {}
    for point in range(0x80, 0x250):  # accented Latin letters: the letter alone
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base.isascii() and base.isalpha():
            table[point] = SUBSTITUTES.get(base, base)
    for point in range(0x300, 0x370):  # combining accents
        table[point] = ""
    for sign in map(chr, range(0x20, 0x7F)):
        if not sign.isalnum():
            table[ord(sign)] = " "
    for space in "\t\n\x0b\x0c\r\x85\xa0«»¿¡…–—‘’“”":
        table[ord(space)] = " "
    for hidden in "\xad​‌‍﻿":
        table[ord(hidden)] = ""
    return table | {ord(k): SUBSTITUTES.get(v, v) for k, v in (LOOKALIKES | SUBSTITUTES).items()}


FOLDING = _folding()


def folded(text: str) -> str:
    """A text as the lexicon sees it, with a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(sign in text for sign in INNER_SIGNS):
        text = _INNER.sub(lambda m: INNER_SIGNS[m[0]], text)
    return f" {text.translate(FOLDING)} "


def _features(words: set[str]) -> set[str]:
    """Whole words end with a space, beginnings do not."""
    return {f"{w} " for w in words if len(w) > 2} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def _family(words: list[str]) -> int:
    """The least hash of a text's word triples: alike texts mostly share it."""
    grams = (" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2)))
    return min(map(zlib.crc32, grams))


def _by_text(
    batches: Iterator[pa.RecordBatch], excepted: re.Pattern[str] | None, known: Set[str] | None
) -> Iterator[pa.RecordBatch]:
    """(feature, family) rows of texts, those of ``_SLICE`` texts in a batch, only ``known`` features if given."""
    for batch in (b.slice(at, _SLICE) for b in batches for at in range(0, b.num_rows, _SLICE)):
        features, families, counts = [], [], []
        for text in batch.column("text"):
            plain = folded(text.as_py())
            words = (excepted.sub(" ", plain) if excepted else plain).split()
            found = _features(set(words)) | {""}
            if known is not None:
                found &= known
            features += found
            families.append(_family(words))
            counts.append(len(found))
        family = np.repeat(np.array(families, np.int64), counts)
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array(family)], ["feature", "family"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row's label must not be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """text and toxic of at most ``most`` labelled rows that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    sample = (
        usable.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return documents_of(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic")


def learn(rows: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> dict[str, float]:
    """Patterns with weights from (text, toxic) rows; none without toxic rows.

    Candidates are what enough families of toxic rows have, or one family in many copies;
    only those are counted in the other rows, in families too. Exception phrases are left
    out before. Counts are per pattern and family, then per pattern.
    """
    phrases = "|".join(re.escape(folded(p).strip()) for p in sorted(exceptions, key=len, reverse=True))
    excepted = re.compile(f" (?:{phrases})(?= )") if phrases else None

    def by_family(toxic: int, known: Set[str] | None = None) -> DataFrame:
        found = rows.filter(F.col("toxic") == toxic).select("text")
        by_text = partial(_by_text, excepted=excepted, known=known)
        pairs = found.mapInArrow(by_text, "feature string, family long")
        return pairs.groupBy("feature", "family").agg(F.count("*").alias("rows"))

    sums = by_family(1).groupBy("feature").agg(F.count("*").alias("n"), F.sum(1 + F.log2("rows")).alias("weight"))
    common = sums.filter(F.col("weight") >= LEAST_FAMILIES).collect()
    against = by_family(0, {r["feature"] for r in common} | {""}).groupBy("feature").agg(F.count("*").alias("n"))
    return _select(
        {r["feature"]: r["n"] for r in common},
        {r["feature"]: r["weight"] for r in common},
        {r["feature"]: r["n"] for r in against.collect()},
    )


def _select(support: dict[str, int], copies: dict[str, float], against: dict[str, int]) -> dict[str, float]:
    """``copies`` are families with a weight of 1 more for each doubling of their rows."""
    families, clean = support.get("", 0), against.get("", 0)
    if not families:
        return {}
    # So many families that no candidate is expected to have only toxic ones by chance.
    rate = min(0.5, families / (families + clean))
    least = max(LEAST_FAMILIES, math.log(20 * len(support)) / -math.log(rate))
    weights = {}
    for feature, n in support.items():
        share = n / (n + against.get(feature, 0))
        # Copies make up for families only where no clean row has the pattern.
        enough = n if against.get(feature, 0) else copies[feature]
        if feature and share >= LEAST_SHARE and enough >= least:
            weights[feature] = 2 * share - 1
    # A beginning gives way to a longer pattern with nearly all of its families ...
    best_longer: dict[str, int] = {}
    for feature in weights:
        for n in range(PREFIXES[0], len(feature)):
            best_longer[feature[:n]] = max(best_longer.get(feature[:n], 0), support[feature])
    kept = {f: w for f, w in weights.items() if best_longer.get(f, 0) < 0.8 * support[f]}
    # ... and the patterns that start with one that stays are not needed.
    return {
        f: w for f, w in kept.items() if not any(f[:n] in kept for n in range(PREFIXES[0], len(f)))
    }


def _matcher(weights: dict[str, float], exceptions: Sequence[str]):
    """A function from text to (score, hits)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, weight in weights.items():
        automaton.add_word(f" {pattern}", (len(pattern) + 1, weight))
    for phrase in exceptions:
        pattern = folded(phrase)
        automaton.add_word(pattern, (len(pattern), None))
    automaton.make_automaton()

    def score(text: str) -> tuple[float, int]:
        if not weights:
            return 0.0, 0
        plain = folded(text)
        found = [(end - length + 1, end, weight) for end, (length, weight) in automaton.iter(plain)]
        if not found:
            return 0.0, 0
        excepted = sorted((a, b) for a, b, w in found if w is None)

        def stands(a: int, b: int) -> bool:
            at = bisect_right(excepted, (a, math.inf)) - 1
            return at < 0 or excepted[at][1] < b

        hits = [w for a, b, w in found if w is not None and stands(a, b)]
        words = len(plain.split())
        return 1 - 0.5 ** (sum(hits) / (1 + words / WORDS_PER_HIT)), len(hits)

    return score


def scored(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """``docs`` with ``_toxicity``: a struct of score (0 to 1) and hits.

    The lexicon is learned here, from labelled rows of ``docs`` that are not held out. A null
    or empty text scores 0; without labels every text does. Repeated rows score alike.
    """
    weights = learn(training_rows(docs, labels), exceptions)

    @F.arrow_udf("score double, hits long")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _matcher(weights, exceptions)
        for texts in batches:
            scores, hits = np.empty(len(texts)), np.empty(len(texts), np.int64)
            for i, text in enumerate(texts):
                scores[i], hits[i] = score(text.as_py())
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array(hits)], ["score", "hits"])

    return docs.withColumn("_toxicity", toxicity(whole()))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and hits of every document."""
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_toxicity.score").alias("score"),
        F.when(F.col("_toxicity.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.col("_toxicity.hits").alias("hits"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return scored(docs, labels).filter(F.col("_toxicity.score") < THRESHOLD).select(*docs.columns)
