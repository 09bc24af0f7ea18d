"""Finding, naming and checking sessions."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions.text import trim_ws, whole_json

CURRENT_VERSION = 3


@F.pandas_udf(StringType())
def resolved_path(paths: pd.Series) -> pd.Series:
    """Paths without ``.``, ``..`` and doubled separators; null and empty stand for the root."""
    return paths.map(lambda p: posixpath.normpath("/" + p.lstrip("/")) if isinstance(p, str) and p else "/")


def discovered(known: DataFrame, local: DataFrame) -> DataFrame:
    """Sessions of both lists (``source_path`` and further columns), one per resolved path: the local one where both have it.

    Adds ``path``.  Of several rows of one list the one of the greatest ``source_id`` holds.
    """
    rows = known.withColumn("_turn", F.lit(0)).unionByName(local.withColumn("_turn", F.lit(1))).withColumn("path", resolved_path("source_path"))
    best = rows.groupBy("path").agg(F.max_by(F.struct(*known.columns), F.struct("_turn", "source_id")).alias("b"))
    return best.select("path", "b.*")


def header_status(raw: Column, expected: Column) -> tuple[Column, Column]:
    """(``ok`` or what is wrong with a header line, its version): unreadable, no session header, another id; version 1 where none is given."""
    v = whole_json(raw)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    status = (
        F.when(v.isNull(), "unreadable").when(~is_object | ~F.coalesce(F.try_variant_get(v, "$.type", "string") == "session", F.lit(False)), "no session header")
        .when(~F.coalesce(F.try_variant_get(v, "$.id", "string") == expected, F.lit(False)), "another id").otherwise("ok")
    )
    return status, F.when(status == "ok", F.coalesce(F.try_variant_get(v, "$.version", "int"), F.lit(1)))


def resolved_ids(sessions: DataFrame, asked: DataFrame, current: str | None = None) -> DataFrame:
    """Each key asked for (``key``, ``turn``, ``cwd``) with ``source_id`` and ``status``.

    A key names the session of that id whatever its case, else the only one
    whose id begins with it.  ``status``: ``empty``, ``none``, ``ambiguous``,
    ``other cwd``, ``repeated`` (an earlier turn of the same ``cwd`` named it), ``current`` (several were
    named, this one among them), ``ok``.  Beginnings are joined by equality, one
    row per session and length of a key.  Two sessions of one id are ambiguous.
    """
    keys = asked.select("turn", "cwd", "key", F.lower(trim_ws(F.coalesce("key", F.lit("")))).alias("_k")).withColumn("_n", F.length("_k"))
    ids = sessions.filter("source_id is not null").select("source_id", F.lower("source_id").alias("_id"), resolved_path("cwd").alias("_cwd"))
    summed = lambda df: df.groupBy("_k").agg(F.count("*").alias("n"), F.min(F.struct("source_id", "_cwd")).alias("m"))
    wanted = keys.filter("_k <> ''").select("_k", "_n").distinct()
    exact = summed(ids.join(wanted, F.col("_id") == F.col("_k")))
    begins = ids.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length("_id"))))
    begun = summed(begins.join(wanted.select("_n").distinct(), "_n").withColumn("_k", F.left("_id", F.col("_n"))).join(wanted.select("_k"), "_k"))
    found = keys.join(exact.select("_k", F.struct("n", "m").alias("e")), "_k", "left").join(begun.select("_k", F.struct("n", "m").alias("b")), "_k", "left").withColumn("f", F.coalesce("e", "b"))
    first = F.when(F.col("_k") == "", "empty").when(F.col("f").isNull(), "none").when(F.col("f.n") > 1, "ambiguous").when(F.col("f.m._cwd") != F.col("_at"), "other cwd")
    named = found.withColumn("_at", resolved_path("cwd")).withColumn("_first", first).withColumn("source_id", F.when(F.col("_first").isNull() | (F.col("_first") == "other cwd"), F.col("f.m.source_id")))
    good = named.filter("_first is null").groupBy(F.col("_at").alias("_ga"), F.col("source_id").alias("_gs")).agg(F.min("turn").alias("_earliest"))
    many = named.filter("_first is null").groupBy(F.col("_at").alias("_ma")).agg(F.count_distinct("source_id").alias("_many"))
    joined = named.join(good, (F.col("_at") == F.col("_ga")) & (F.col("source_id") == F.col("_gs")), "left").join(many, F.col("_at") == F.col("_ma"), "left")
    status = F.coalesce("_first", F.when(F.col("turn") > F.col("_earliest"), "repeated"), F.when((F.col("source_id") == F.lit(current)) & (F.col("_many") > 1), "current"), F.lit("ok"))
    return joined.select("turn", "cwd", "key", "source_id", status.alias("status"))


#: The stored result of an earlier cleaning.
STORED = "schemaVersion int, body string, outputContentHash string, policyHash string, segments array<struct<kind:string,text:string,sourceOrder:long,occurredAt:long,incomplete:boolean,fidelity:string,sourceId:string>>"
KINDS = ("user", "assistant", "tool", "checkpoint", "break")


def stored_result(data: Column) -> Column:
    """The stored result (``STORED``) in JSON text; null unless it is whole and of version 1."""
    d = F.from_json(data, STORED)
    sound = (d["schemaVersion"] == 1) & d["body"].isNotNull() & d["outputContentHash"].isNotNull() & d["policyHash"].isNotNull() & d["segments"].isNotNull()
    return F.when(F.coalesce(sound & F.forall(d["segments"], lambda s: F.coalesce(s["kind"].isin(*KINDS) & s["text"].isNotNull(), F.lit(False))), F.lit(False)), d)


def reusable(branch: DataFrame) -> DataFrame:
    """Per source the latest stored result of its branch that no compaction follows: ``source_id``, ``at`` (its place), ``stored``.

    branch: ``source_id``, ``place``, ``entry_type``, ``custom_type``, ``data``.
    """
    seen = branch.withColumn("stored", F.when((F.col("entry_type") == "custom") & (F.col("custom_type") == "cleanup_ir"), stored_result(F.col("data"))))
    held = seen.groupBy("source_id").agg(
        F.max_by(F.when(F.col("stored").isNotNull(), F.struct("place", "stored")), F.when(F.col("stored").isNotNull(), F.col("place"))).alias("s"), F.max(F.when(F.col("entry_type") == "compaction", F.col("place"))).alias("last")
    )
    return held.filter(F.col("s").isNotNull() & (F.col("last").isNull() | (F.col("last") < F.col("s.place")))).select("source_id", F.col("s.place").alias("at"), F.col("s.stored").alias("stored"))


def document_segments(branch: DataFrame, projected: DataFrame) -> DataFrame:
    """The segments of each source: those of its reusable stored result and then what was said after it, else all that is projected.

    projected: ``source_id``, ``place``, ``part``, ``seg_kind``, ``text``,
    ``fidelity``.  Result: ``source_id``, ``source_order``, ``sub``,
    ``seg_kind``, ``text``, ``fidelity``, ``reused``.
    """
    kept = reusable(branch)
    base = kept.select("source_id", F.posexplode("stored.segments").alias("source_order", "s")).select(
        "source_id", F.col("source_order").cast("long").alias("source_order"), F.lit(0).cast("long").alias("sub"), F.col("s.kind").alias("seg_kind"), F.col("s.text").alias("text"),
        F.when(F.col("s.fidelity") == "derived", "derived").otherwise("verbatim").alias("fidelity"), F.lit(True).alias("reused"),
    )
    after = projected.join(kept.select("source_id", "at", F.size("stored.segments").alias("n")), "source_id", "left").filter("at is null or place > at")
    order = F.when(F.col("at").isNull(), F.col("place")).otherwise(F.col("n") + F.col("place") - F.col("at") - 1).cast("long")
    return base.unionByName(after.select("source_id", order.alias("source_order"), F.col("part").cast("long").alias("sub"), "seg_kind", "text", "fidelity", F.lit(False).alias("reused")))


def import_sources(direct: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct imported sources (``source``, ``import_id``, ``first``): those named directly, then those of ``import_source`` entries, in order of first mention.

    direct: ``source``, ``import_id``, ``turn``; entries: ``source_id``,
    ``line_index``, ``entry_type``, ``custom_type``, ``data`` (JSON).
    """
    v = whole_json("data")
    told = entries.filter("entry_type = 'custom' and custom_type = 'import_source'").select(
        F.try_variant_get(v, "$.source", "string").alias("source"), F.try_variant_get(v, "$.sourceId", "string").alias("import_id"), F.struct(F.lit(1).alias("list"), "source_id", F.col("line_index").cast("long").alias("turn")).alias("o")
    )
    given = direct.select("source", "import_id", F.struct(F.lit(0).alias("list"), F.lit("").alias("source_id"), F.col("turn").cast("long").alias("turn")).alias("o"))
    rows = given.unionByName(told).filter("source <> '' and import_id <> ''")
    return rows.groupBy("source", "import_id").agg(F.min("o").alias("first"))
