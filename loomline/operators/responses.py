"""Model responses as an input table: the JSON object each one holds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions.text import WS, trim_ws, whole_json


def first_object(text: str) -> str | None:
    """The first balanced ``{...}`` of a text, braces in strings not counted; null unless it is a JSON object."""
    begin = text.find("{")
    if begin < 0:
        return None
    try:
        found, end = json.JSONDecoder().raw_decode(text, begin)
    except (ValueError, RecursionError):
        return None
    return text[begin:end] if isinstance(found, dict) else None


@F.pandas_udf(StringType())
def embedded(texts: pd.Series) -> pd.Series:
    """``first_object`` over a column."""
    return texts.map(lambda t: None if t is None else first_object(t))


def objects(responses: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Adds ``object``: the JSON object of each response, or null.

    Tried in turn: the whole text, the first fenced block, the first balanced
    object within.  ``strict`` takes the whole text only.  Python sees only the
    rows for which the first two fail.
    """

    def whole(x):
        v = whole_json(x)
        return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), x)

    raw = trim_ws(F.col(text))
    rows = responses.withColumn("_whole", whole(raw))
    if strict:
        return rows.withColumnRenamed("_whole", "object")
    fence = F.regexp_extract(raw, f"(?s)```(?:json|javascript)?[{WS}]*\n?(.*?)\n?```", 1)
    rows = rows.withColumn("_near", F.coalesce("_whole", whole(trim_ws(fence))))
    rest = F.when(F.col("_near").isNull(), F.col(text))
    return rows.withColumn("_inner", embedded(rest)).withColumn("object", F.coalesce("_near", "_inner")).drop("_whole", "_near", "_inner")


def strict_objects(responses: DataFrame, text: str = "text", stop_reason: str = "stop_reason") -> DataFrame:
    """Adds ``object`` and ``fault``: responses that must be one JSON object and nothing else.

    ``fault`` is the first of: ``not stopped`` (the model did not end by itself),
    ``fenced``, ``no JSON``, ``no object``; null where there is none.
    """
    v = whole_json(F.col(text))
    fault = (
        F.when(~F.coalesce(F.col(stop_reason) == "stop", F.lit(False)), "not stopped").when(F.col(text).rlike(f"^[{WS}]*```"), "fenced").when(v.isNull(), "no JSON")
        .when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no object")
    )
    return responses.withColumn("fault", fault).withColumn("object", F.when(F.col("fault").isNull(), F.col(text)))


def latest_valid(reports: DataFrame) -> DataFrame:
    """Per source the last report of its branch (``source_id``, ``place``, ``data``, ``valid``) that is valid: ``source_id``, ``place``, ``data``."""
    best = reports.filter("valid").groupBy("source_id").agg(F.max(F.struct("place", "data")).alias("r"))
    return best.select("source_id", "r.place", "r.data")
