"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification.

One permutation spreads the shingle hashes over a ring; a second one is shifted along the
ring by one step per coordinate, so two permutations yield a signature of any length. Equal
bands make candidates, and every link is confirmed on the full shingle sets.

No bucket is expanded into all its pairs. First each member is compared with the least
member of its bucket only, and the links found are contracted to components. Then
buckets with several components are left; of their members those pairs are compared that
share one of their rarest shingles, which every link does. So each candidate pair is either
confirmed, refused, or known to be connected, while a group of thousands of near
copies costs a few comparisons per member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.components import components
from careledger.llm.shared import cut, documents_of, whole

SHINGLE_WORDS = 5
#: Links: 100 * intersection >= percent * union; PERCENT unless a caller says otherwise.
PERCENT = 85
#: 44 bands of 8: a pair at the bound is missed once in a million times; a pair at 0.3,
#: such as two texts that share a passage, meets in a band three times in a thousand.
BANDS, ROWS = 44, 8
#: Bands and their rows for links from 0.8 on: a pair at the bound is missed as rarely.
LAYOUT_80 = (60, 7)
#: Shingles whose whole signature is computed at a time.
_BLOCK = 256

# Odd multipliers of the two permutations of 32-bit numbers.
_FIRST = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))
_SECOND = (np.uint32(0x21F0AAAD), np.uint32(0xD35A2D97))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a UTF-8 text.

    Words are split at the six white-space characters of ASCII and A-Z lower-cased, which
    is what ``bytes`` methods do. Fewer words are one shingle, none give an empty set.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    rolled = np.zeros(len(words) - SHINGLE_WORDS + 1, np.uint64)
    for i in range(SHINGLE_WORDS):
        rolled = rolled * _MIX + hashes[i : i + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def _permuted(x: np.ndarray, multipliers: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    for multiplier, shift in zip(multipliers, (16, 15), strict=True):
        x ^= x >> np.uint32(shift)
        x *= multiplier
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash of a non-empty set: coordinate k uses the second permutation k steps on."""
    ring = _permuted((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), _FIRST)
    least = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for start in range(0, len(ring), _BLOCK):
        shifted = ring[start : start + _BLOCK] + shifts
        np.minimum(least, _permuted(shifted, _SECOND).min(axis=1), out=least)
    return least


def bands(hashes: np.ndarray, layout: tuple[int, int] = (BANDS, ROWS)) -> np.ndarray:
    """One 64-bit key per band, different for equal contents of different bands."""
    keys = np.arange(layout[0], dtype=np.uint64)
    for column in signature(hashes, layout[0] * layout[1]).reshape(layout).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], layout: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, keys = [], [], []
        for text in batch.column("text"):
            content = text.as_py()
            found = shingles(content)
            counts.append(len(found))
            digests.append(hashlib.sha256(content).digest())
            keys.append(bands(found, layout) if len(found) else np.empty(0, np.int64))
        offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(digests, pa.binary()),
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            ["doc_id", "digest", "n_shingles", "bands"],
        )


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text_a, text_b) rows the pairs whose full sets are alike enough."""
    last, own = None, None
    for batch in batches:
        keep = []
        for i, (a, text_a, text_b) in enumerate(
            zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True)
        ):
            if a != last or own is None:
                last, own = a, shingles(text_a.as_py())
            other = shingles(text_b.as_py())
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(other) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that are links. Texts go to their pairs, first to ``b``, then to ``a``."""
    right = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    near = partial(_near, percent=percent)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(near, "a long, b long").distinct()


def _links(signed: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of classes that connect the same ones as all links together."""
    reps = signed.join(classes, ["digest"]).filter("doc_id = least").select("rep", "bands").distinct()
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    members = cut(buckets.join(shared.filter("least < most"), "bucket").select("bucket", "rep", "least"), "buckets")
    some = classes.join(members.select("rep").distinct(), "rep").select("rep", "least", F.col("digest").alias("wanted"))
    # By id first; where an id repeats with another text, only the class's own text stays.
    own = rows.join(some, rows["doc_id"] == some["least"]).select("rep", "wanted", F.col("text").cast("binary").alias("text"))
    texts = cut(own.filter(F.unhex(F.sha2("text", 256)) == F.col("wanted")).select("rep", "text").distinct(), "texts")

    stars = members.filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    first = cut(_verified(stars, texts, percent), "links")

    found = components(first, "a", "b")
    labelled = members.join(found, members["rep"] == found["node"], "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("label")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    open_ = cut(labelled.join(mixed, "bucket", "left_semi").select("rep", "label").distinct(), "open")
    rest = _rare_pairs(open_, texts, percent).join(stars, ["a", "b"], "left_anti")
    return first.union(cut(_verified(rest, texts, percent), "links"))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text.as_py()).view(np.int64) for text in batch.column("text")]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), pa.array(np.concatenate(found))
        )
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), lists], ["rep", "label", "shingles"])


def _rare_pairs(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs with different labels that can be links, of documents that share buckets.

    Linked sets have one of their rarest shingles in common: of n shingles, in an order that
    is the same for all, the first n - ceil(n percent / 100) + 1 of both overlap, and none that
    stands before the first common one is in the other. Near copies that are not linked
    differ in many shingles which hardly another text has, and those come first. So the
    pairs left are few where a bucket holds many texts, and no link is lost.
    """
    sets = open_.join(texts, "rep").mapInArrow(_shingled, "rep long, label long, shingles array<long>")
    rows = sets.select("rep", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    ordered = (
        rows.join(often.filter("often > 1"), "shingle", "left")
        .groupBy("rep", "label", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle"))).alias("s"))
    )
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = ordered.select(
        "rep", "label", "n", F.posexplode(F.slice("s", F.lit(1), prefix.cast("int"))).alias("before", "x")
    )
    tokens = cut(
        first.filter("x.often > 1").select("rep", "label", "n", "before", F.col("x.shingle").alias("token")), "tokens"
    )
    mixed = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    both = tokens.join(mixed, "token", "left_semi")
    one, other = both.alias("one"), both.alias("other")
    # From the first common shingle on, what is left of both must still be enough.
    left = F.least(F.col("one.n") - F.col("one.before"), F.col("other.n") - F.col("other.before"))
    apart = (
        (F.col("one.token") == F.col("other.token"))
        & (F.col("one.label") < F.col("other.label"))
        & ((100 + percent) * left >= percent * (F.col("one.n") + F.col("other.n")))
    )
    return (
        one.join(other, apart)
        .select(F.least("one.rep", "other.rep").alias("a"), F.greatest("one.rep", "other.rep").alias("b"))
        .distinct()
    )


def _placed(docs: DataFrame, percent: int, layout: tuple[int, int]) -> DataFrame:
    """What ``near_groups`` returns, with the digest of each text."""
    rows = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(
        rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
            partial(_signed, layout=layout), "doc_id long, digest binary, n_shingles long, bands array<long>"
        ),
        "signatures",
    )
    least = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least")).filter("least is not null")
    # A class is named by its least doc_id. Where another class has the same, by a hash of its text, so that
    # an id that stands for several texts does not link them.
    shared = least.groupBy("least").agg(F.count("*").alias("texts"))
    name = F.when(F.col("texts") == 1, F.col("least")).otherwise(F.xxhash64("digest"))
    classes = cut(least.join(shared, "least").select("digest", "least", name.alias("rep")), "classes")
    found = components(_links(signed, classes, rows, percent), "a", "b")
    placed = classes.join(found, classes["rep"] == found["node"], "left").select(
        "digest", "least", F.coalesce("component", "rep").alias("name")
    )
    groups = placed.join(placed.groupBy("name").agg(F.min("least").alias("component")), "name").select("digest", "component")
    own = signed.select("doc_id", "digest", "n_shingles").join(groups, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select(
        "doc_id",
        "digest",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def near_groups(docs: DataFrame, percent: int = PERCENT, layout: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Texts are linked from a resemblance of ``percent`` on; ``layout`` is the number of bands
    and of rows in each, which must suit that bound.
    A document's component is the least doc_id that links lead to. Equal texts are one
    class; only a class's row of least doc_id is compared. A null text counts as empty;
    texts without words are linked with nothing, also not with their copies. Rows without
    a doc_id are linked with nothing, have no component and are kept. Each row that repeats a
    doc_id follows its own text, also where the texts differ. Other columns are not read; an
    empty table gives no rows.
    """
    return _placed(docs, percent, layout).drop("digest")


def near_unique(docs: DataFrame, percent: int = PERCENT, layout: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    dropped = _placed(docs, percent, layout).filter("not kept").select("doc_id", "digest").distinct()
    text = F.sha2(whole().cast("binary"), 256)
    gone = (docs["doc_id"].cast("long") == dropped["doc_id"]) & (F.unhex(text) == dropped["digest"])
    return docs.join(dropped, gone, "left_anti")
