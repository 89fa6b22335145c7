"""The uploaded reason-to-cost map: rows that can be used, and those that cannot, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careledger.sources.tables import SCHEMAS

_TABLE, _KEY = "contact_reason_cost_map", "scr"


def read_reason_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The usable rows of the CSV file at ``path``, and the refused ones as (reason, key, record).

    Refused are rows that do not parse (``broken``: too few or too many fields), rows without a key
    (``no key``) and all rows of a key that is mapped in several ways (``clash``). Rows that repeat
    one mapping are usable; each stays, as in the reports a repeated row counts again.
    """
    rows = spark.read.schema(f"{SCHEMAS[_TABLE]}, _broken string").csv(
        path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken"
    )
    names = [name for name in rows.columns if name != "_broken"]
    mapping = F.to_json(F.struct(*names))
    sound = F.col("_broken").isNull() & F.col(_KEY).isNotNull()
    # One map row per key or few; a key is compared with itself only.
    same = Window.partitionBy(_KEY)
    kinds = F.size(F.collect_set(F.when(sound, mapping)).over(same))
    judged = rows.withColumn(
        "_reason",
        F.when(F.col("_broken").isNotNull(), "broken").when(F.col(_KEY).isNull(), "no key").when(kinds > 1, "clash"),
    )
    refused = judged.filter("_reason is not null").select(
        F.col("_reason").alias("reason"), F.col(_KEY).alias("key"), F.coalesce("_broken", mapping).alias("record")
    )
    return judged.filter("_reason is null").select(names), refused


def upload_check(kept: DataFrame, refused: DataFrame) -> DataFrame:
    """reason and rows of an upload; usable rows as ``kept``."""
    found = kept.select(F.lit("kept").alias("reason")).unionByName(refused.select("reason"))
    return found.groupBy("reason").agg(F.count("*").alias("rows"))
