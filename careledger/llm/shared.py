"""Helpers of the training-data operators: the shared folder, written cuts, texts."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space, as code points.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without one, as in tests, gets a temporary folder. On a cluster that would
    be a folder of each machine's own, so a session there must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master!r} share")
        folder = tempfile.mkdtemp(prefix="careledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeezed_bytes(data: bytes) -> bytes:
    """Bytes of less size, with the size they had."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def loose_bytes(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def whole(text: str = "text") -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """A text without its white space; plain replacements, as they need no regex."""
    for point in SPACES:
        text = F.replace(text, F.lit(chr(point)), F.lit(""))
    return text


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else, unlike ``lower``."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, null texts as empty, other columns left."""
    return docs.select(F.col("doc_id"), whole().alias("text"))
