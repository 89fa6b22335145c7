"""Exact dedup by skew-safe combining of digest groups.

Texts are equal when they are identical without white space. Copies are combined three
times, and each time the key is the digest *and* the whole normalised text, so equal
digests alone never merge two rows:

1. inside each input task, before anything is shuffled;
2. per salt, which is taken from the input task: a text that fills a third of the table
   has one row per task left, and those spread over all salts;
3. over the salts, of which there are as many as shuffle partitions.

Rows then find their group by digest. A digest with two different texts (none is known)
is settled by a join on the text as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.shared import cut, squeezed, whole


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", whole().alias("text"))
    rows = rows.select("doc_id", F.length("text").alias("chars"), squeezed(F.col("text")).alias("body"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("body"), 256)))


def _combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))


def text_groups(docs: DataFrame) -> DataFrame:
    """One row per different text: digest, body, keep_id, copies, texts.

    The row that stays has the most code points, then the smallest doc_id (a null doc_id
    comes last). ``texts`` counts the different texts of the digest: 1 but for collisions.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ~doc_id turns the order of longs around without overflow; nulls are least in a struct.
    rows = _keyed(docs).select(
        "digest",
        "body",
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        F.struct("chars", F.bitwise_not("doc_id").alias("id")).alias("best"),
        F.lit(1).cast("long").alias("copies"),
    )
    salted = _combined(rows, ["digest", "salt", "body"])
    return _combined(salted, ["digest", "body"]).select(
        "digest", "body", F.bitwise_not("best.id").alias("keep_id"), F.col("best.chars").alias("keep_chars"), "copies"
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    A null text counts as empty; all empty texts are one group. Rows that repeat both
    doc_id and text are counted one by one and share their fate. Other columns are not
    read. An empty table gives no rows.
    """
    groups = text_groups(docs)
    # One scan of the combined groups gives the winners without their texts; texts are
    # kept only for digests that turn out to have several.
    winners = cut(
        groups.groupBy("digest").agg(
            F.count("*").alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("copies").alias("copies"),
        ),
        "winners",
    )
    rows = _keyed(docs)
    found = rows.select("doc_id", "digest").join(winners, "digest")
    shape = ["doc_id", "keep_id", F.col("copies").alias("group_size"), "digest"]
    settled = found.filter("texts = 1").select(*shape)
    if not winners.filter("texts > 1").isEmpty():
        mixed = winners.filter("texts > 1").select("digest")
        texts = groups.join(mixed, "digest", "left_semi")
        settled = settled.union(rows.join(texts, ["digest", "body"]).select(*shape))
    return settled.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat doc_id, text and length one stays.
    """
    winners = text_groups(docs).select(
        F.col("digest").alias("_digest"),
        F.col("keep_id").alias("_id"),
        F.xxhash64("digest", "keep_id", "keep_chars").alias("_winner"),
    )
    # One hash as the key: it spreads the copies of a text, and the rows stay where the join
    # puts them when repeated ones are dropped.
    rows = docs.withColumn("_of", F.unhex(F.sha2(squeezed(whole()), 256))).withColumn(
        "_key", F.xxhash64("_of", "doc_id", F.length(whole()))
    )
    same = (
        (F.col("_key") == F.col("_winner"))
        & (F.col("_of") == F.col("_digest"))
        & F.coalesce(F.col("doc_id") == F.col("_id"), F.col("doc_id").isNull() & F.col("_id").isNull())
    )
    return rows.join(winners, same, "left_semi").dropDuplicates(["_key", "_of", "doc_id"]).select(*docs.columns)
