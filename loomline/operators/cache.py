"""A content-addressed table of results, so that equal work is done once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.text import whole_json

SCHEMA = "cache_key string, model string, prompt_version string, name string, input_hash string, value string"


def key_of(identity: dict) -> str:
    """SHA-256 of the identity with its keys sorted."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, empty where none is."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def lookup(wanted: DataFrame, table: DataFrame, identity: dict) -> DataFrame:
    """Wanted results (``name``, ``input_hash``) with ``value``: of the same key if stored, else of any with the same model and prompt version, else null.

    A value that is no JSON counts as not stored.
    """
    key = key_of(identity)
    fits = table.filter((F.col("cache_key") == key) | ((F.col("model") == identity.get("model")) & (F.col("prompt_version") == identity.get("promptVersion"))))
    fits = fits.filter(whole_json("value").isNotNull())
    first = Window.partitionBy("name", "input_hash").orderBy((F.col("cache_key") != key).cast("int"), "cache_key", "value")
    best = fits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("name", "input_hash", "value")
    return wanted.join(best, ["name", "input_hash"], "left")


def store(results: DataFrame, path: str, identity: dict) -> None:
    """Append results (``name``, ``input_hash``, ``value``) that are not stored yet under this key; stored ones stay as they are."""
    spark, key = results.sparkSession, key_of(identity)
    held = stored(spark, path).filter(F.col("cache_key") == key).select("name", "input_hash")
    fresh = results.select("name", "input_hash", "value").dropDuplicates(["name", "input_hash"]).join(held, ["name", "input_hash"], "left_anti")
    fresh.select(F.lit(key).alias("cache_key"), F.lit(identity.get("model")).alias("model"), F.lit(identity.get("promptVersion")).alias("prompt_version"), "name", "input_hash", "value").write.mode("append").parquet(path)
