"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions.

A sketch keeps the ``k`` smallest 48-bit hashes of a text's distinct word shingles, in
ascending order. The bottom-k of a union is the bottom-k of two sketches, so sketches
merge across parts and tasks; with fewer than ``k`` shingles a sketch is the whole set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.shared import whole

#: Hashes kept: estimates of resemblance are off by about 0.5 / sqrt(k) at most, 0.04.
SKETCH_SIZE = 128
SHINGLE_WORDS = 5
_RANGE = float(1 << 48)


def word_hashes(text: Column) -> Column:
    """One hash per word in lower case, split at white space."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: Column, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> Column:
    """The sketch of a text with these word hashes.

    A text with fewer words than a shingle is one shingle; one without words has an
    empty sketch. ``hashes`` should be a column of its own, as it is read several times.
    """
    count = F.size(hashes)
    starts = F.when(count >= words, F.slice(hashes, F.lit(1), F.greatest(count - (words - 1), F.lit(1))))
    shingles = F.transform(
        starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, words)])
    )
    short = F.when(count > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    kept = F.transform(F.coalesce(shingles, short), lambda h: F.shiftrightunsigned(h, 16))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, k)


def merged(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], column: str, k: int = SKETCH_SIZE) -> DataFrame:
    """The sketch of all parts of each key: the ``k`` smallest different hashes.

    Equal hashes are dropped per task before the shuffle, and per key only ``k`` remain.
    """
    hashes = df.select(*keys, F.explode(column).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    least = hashes.withColumn("_place", place).filter(F.col("_place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimate of the share of shingles in both, among those in either; 1 for two empty ones."""
    union = merged(a, b, k)
    both = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact below ``k``."""
    full = F.lit((k - 1) * _RANGE) / F.element_at(a, -1)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimate of the share of a's shingles that b has; 1 for an empty one."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), both / distinct_shingles(a, k))
    )


def as_text(sketch_column: Column) -> Column:
    """A sketch as text: 12 hex digits a hash."""
    return F.array_join(
        F.transform(sketch_column, lambda h: F.lpad(F.lower(F.hex(h)), 12, "0")), ""
    )


def from_text(text: Column) -> Column:
    """The sketch that ``as_text`` wrote."""
    count = F.floor(F.length(text) / 12)
    starts = F.filter(F.sequence(F.lit(0), count.cast("int")), lambda i: i < count)
    return F.transform(
        starts, lambda i: F.conv(F.substring(text, i * 12 + 1, F.lit(12)), 16, 10).cast("bigint")
    )


# Buckets of 2^6 ids, groups of 2^18 buckets, and groups of 2^20 of those: no window over
# them has more than 2^20 rows, and all ids of 64 bits are covered.
_BUCKET_BITS, _GROUP_BITS, _TOP_BITS = 6, 24, 44


def _next_filled(ids: DataFrame, bits: list[int]) -> DataFrame:
    """(id, next): the next larger of a column of distinct ids; after the largest the least."""
    if not bits:
        order = Window.partitionBy(F.lit(0)).orderBy("id")
        return ids.select("id", F.coalesce(F.lead("id").over(order), F.first("id").over(order)).alias("next"))
    shift, *rest = bits
    grouped = ids.withColumn("up", F.shiftright("id", shift))
    heads = grouped.groupBy("up").agg(F.min("id").alias("head"))
    follow = _next_filled(heads.select(F.col("up").alias("id")), [b - shift for b in rest])
    after = follow.join(heads.select(F.col("up").alias("next"), "head"), "next").select(
        F.col("id").alias("up"), "head"
    )
    inside = F.lead("id").over(Window.partitionBy("up").orderBy("id"))
    return (
        grouped.withColumn("inside", inside)
        .join(after, "up", "left")
        .select("id", F.coalesce("inside", "head").alias("next"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, chars, hashes, sketch, next_text, next_sketch by ascending doc_id.

    The last document is followed by the first. Texts are shuffled once, in buckets of
    neighbouring ids; only the first text of a bucket travels to the bucket before it.
    Rows with equal doc_id follow each other by text. Null ids come first, as one bucket.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole().alias("text"),
        F.shiftright(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long"), _BUCKET_BITS).alias("bucket"),
    )
    near = Window.partitionBy("bucket").orderBy("doc_id", "text")
    hashed = rows.repartition("bucket").withColumn("hashes", word_hashes(F.col("text")))
    own = (
        hashed.withColumn("sketch", sketch(F.col("hashes")))
        .drop("hashes")
        .withColumn("next_text", F.lead("text").over(near))
        .withColumn("next_sketch", F.lead("sketch").over(near))
        .withColumn("place", F.row_number().over(near))
    )
    heads = (
        rows.repartition("bucket")
        .withColumn("place", F.row_number().over(near))
        .filter("place = 1")
        .select(F.col("bucket").alias("next"), F.col("text").alias("head_text"))
    )
    buckets = rows.select(F.col("bucket").alias("id")).distinct()
    follow = _next_filled(buckets, [_GROUP_BITS - _BUCKET_BITS, _TOP_BITS - _BUCKET_BITS])
    after = follow.join(heads, "next").select(F.col("id").alias("bucket"), "head_text")
    return (
        own.join(after, "bucket")
        .withColumn("head_hashes", F.when(F.col("next_text").isNull(), word_hashes(F.col("head_text"))))
        .select(
            "doc_id",
            "text",
            F.length("text").cast("long").alias("n_chars"),
            "sketch",
            F.coalesce("next_text", "head_text").alias("next_text"),
            F.coalesce(
                "next_sketch", F.when(F.col("head_hashes").isNotNull(), sketch(F.col("head_hashes")))
            ).alias("next_sketch"),
        )
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    The edited text has the last half of the code points replaced by as many of the
    next document's first ones. A null text counts as empty; other columns are not read;
    an empty table gives no rows.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = with_next(docs).withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.substring("next_text", F.lit(1), half),
        ),
    )
    hashed = edited.withColumn("edited_hashes", word_hashes(F.col("edited")))
    sketched = hashed.withColumn("edited_sketch", sketch(F.col("edited_hashes")))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_own"),
    )
