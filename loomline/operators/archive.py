"""Lossless archives: compressed chunks of texts that restore and verify, and timelines."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from loomline.functions.text import pieces

CHUNK_CHARS, PAGE_ROWS = 524_288, 1_000


@F.pandas_udf(BinaryType())
def packed(data: pd.Series) -> pd.Series:
    """gzip at level 9 without a time stamp; null stays null."""
    return data.map(lambda x: None if x is None else gzip.compress(bytes(x), 9, mtime=0))


@F.pandas_udf(BinaryType())
def unpacked(data: pd.Series) -> pd.Series:
    """The bytes of a gzip stream; null where it is damaged."""

    def one(x):
        try:
            return None if x is None else gzip.decompress(bytes(x))
        except (OSError, EOFError, ValueError, zlib.error):
            return None

    return data.map(one)


def archived(sources: DataFrame, key: str, text: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of every source: ``key``, ``chunk_index``, ``chunk_count``, ``data`` (base64), with the hashes and sizes of raw and packed bytes.

    A null text has no chunk; an empty one has one.
    """
    raw = sources.filter(F.col(text).isNotNull()).select(F.col(key).alias(key), F.encode(text, "UTF-8").alias("_raw"))
    made = raw.withColumn("_packed", packed("_raw")).withColumn("_pieces", pieces(F.base64("_packed"), chunk_chars))
    return made.select(
        key, F.sha2("_raw", 256).alias("raw_sha256"), F.octet_length("_raw").cast("long").alias("raw_bytes"), F.sha2("_packed", 256).alias("packed_sha256"),
        F.octet_length("_packed").cast("long").alias("packed_bytes"), F.size("_pieces").alias("chunk_count"), F.posexplode("_pieces").alias("chunk_index", "data"),
    )


def restored(chunks: DataFrame, key: str) -> DataFrame:
    """``key``, ``text``, ``intact``: chunks put together again; ``intact`` only if all are there once and every size and hash fits.

    The chunks of one source meet in one row, as its text did before.
    """
    whole = chunks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("c"), F.max("chunk_count").alias("n"), F.count_distinct("chunk_index").alias("d"), F.count("*").alias("rows"),
        F.max("raw_sha256").alias("raw_sha256"), F.max("raw_bytes").alias("raw_bytes"), F.max("packed_sha256").alias("packed_sha256"), F.max("packed_bytes").alias("packed_bytes"),
    )
    data = whole.withColumn("_packed", F.try_to_binary(F.array_join(F.transform("c", lambda x: x["data"]), ""), F.lit("base64"))).withColumn("_raw", unpacked("_packed"))
    fits = (
        (F.col("n") == F.col("d")) & (F.col("n") == F.col("rows")) & (F.sha2("_packed", 256) == F.col("packed_sha256")) & (F.octet_length("_packed") == F.col("packed_bytes"))
        & (F.sha2("_raw", 256) == F.col("raw_sha256")) & (F.octet_length("_raw") == F.col("raw_bytes"))
    )
    return data.select(key, F.decode("_raw", "UTF-8").alias("text"), F.coalesce(fits, F.lit(False)).alias("intact"))
