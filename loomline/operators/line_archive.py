"""Archives of sessions line by line: chunks of whole lines, a manifest, a timeline, and the checks that all of it holds.

A chunk holds a fixed number of lines and is packed on its own, so that no row
ever holds a whole session and a damaged chunk costs its own lines only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import whole_json
from loomline.functions.values import any_millis, record_time
from loomline.operators.archive import packed, unpacked
from loomline.operators.ordering import previous_value

CHUNK_LINES = 1_000
#: Lists of hashes are folded through this many buckets.
BUCKETS = 1_024
SCHEMA, SCOPE = "hidden-history/v1", "full-session-tree"


def chunks(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``source_id``, ``chunk_index``, ``lines``, ``raw_bytes``, ``raw_sha256``, ``data`` (base64 of gzip): ``chunk_lines`` lines each, of ``source_id``, ``line_index`` (dense, from 0), ``raw``."""
    placed = lines.withColumn("chunk_index", F.floor(F.col("line_index") / chunk_lines).cast("long"))
    held = placed.groupBy("source_id", "chunk_index").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("line_index", "raw"))).alias("l"))
    text = held.select("source_id", "chunk_index", "lines", F.encode(F.array_join(F.transform("l", lambda x: x["raw"]), "\n"), "UTF-8").alias("_raw"))
    return text.withColumn("_packed", packed("_raw")).select("source_id", "chunk_index", "lines", F.octet_length("_raw").cast("long").alias("raw_bytes"), F.sha2("_raw", 256).alias("raw_sha256"), F.base64("_packed").alias("data"))


def manifest(archive: DataFrame) -> DataFrame:
    """Per source ``line_count``, ``bytes``, ``chunk_count`` and ``sha256``, the hash of its chunk hashes in order."""
    return archive.groupBy("source_id").agg(
        F.sum("lines").alias("line_count"), (F.sum("raw_bytes") + F.count("*") - 1).alias("bytes"), F.count("*").alias("chunk_count"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "raw_sha256"))), lambda c: c["raw_sha256"]), "\n"), 256).alias("sha256"),
    )


def archive_id(sources: DataFrame) -> DataFrame:
    """One row ``archive_id``: ``hist-`` and 24 hex digits of the hash over all manifest rows, whatever their order."""
    row = F.concat_ws("\n", F.lit(SCHEMA), F.lit(SCOPE), "source_id", "line_count", "bytes", "chunk_count", "sha256")
    part = sources.select(F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).alias("b"), F.sha2(row, 256).alias("h")).groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return part.agg(F.concat(F.lit("hist-"), F.left(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256), F.lit(24))).alias("archive_id"))


def timeline(lines: DataFrame) -> DataFrame:
    """One row per line: ``source_id``, ``line_index``, ``entry_type``, ``entry_id``, ``parent_id``, ``ts_text``, ``ts_ms``, ``raw_line_sha256``."""
    v = whole_json("raw")
    get = lambda p: F.when(F.schema_of_variant(F.variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))
    time = record_time(F.col("raw"))
    return lines.select(
        "source_id", F.col("line_index").cast("long").alias("line_index"), F.coalesce(get("$.type"), F.lit("unknown")).alias("entry_type"), get("$.id").alias("entry_id"), get("$.parentId").alias("parent_id"),
        F.coalesce(F.try_variant_get(whole_json(time), "$", "string"), time).alias("ts_text"), any_millis(time).alias("ts_ms"), F.sha2("raw", 256).alias("raw_line_sha256"),
    )


def restored_lines(archive: DataFrame) -> DataFrame:
    """``source_id``, ``chunk_index``, ``intact``, ``first_line``, ``raw_lines``: chunks unpacked and held against their hash and size."""
    raw = archive.withColumn("_raw", unpacked(F.try_to_binary("data", F.lit("base64"))))
    text = raw.withColumn("raw_lines", F.split(F.decode("_raw", "UTF-8"), "\n", -1))
    fits = (F.sha2("_raw", 256) == F.col("raw_sha256")) & (F.octet_length("_raw") == F.col("raw_bytes")) & (F.size("raw_lines") == F.col("lines"))
    return text.select("source_id", "chunk_index", F.coalesce(fits, F.lit(False)).alias("intact"), "raw_lines")


#: What can be wrong with an archived source, in the order of checking.
FAULTS = ("chunk missing", "chunk damaged", "line count", "line hash", "order")


def faults(archive: DataFrame, sources: DataFrame, records: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``source_id``, ``fault``: the first fault (``FAULTS``) of each source that is not archived whole.

    Chunks must be there once each and fit their hash; lines must be as many as
    the manifest says; every record must carry the hash of its line; records
    with a ``position`` must stand in order of time (null last), source and line.
    """
    whole = restored_lines(archive)
    have = archive.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.max("chunk_index").alias("top"), F.sum("lines").alias("have_lines"))
    counted = sources.join(have, "source_id", "left")
    missing = counted.filter("n is null or n <> chunk_count or d <> n or top <> n - 1").select("source_id", F.lit(0).alias("f"))
    damaged = whole.filter("not intact").select("source_id", F.lit(1).alias("f"))
    short = counted.filter("have_lines <> line_count").select("source_id", F.lit(2).alias("f"))
    lines = whole.select("source_id", "chunk_index", F.posexplode("raw_lines").alias("_k", "_raw")).select("source_id", (F.col("chunk_index") * chunk_lines + F.col("_k")).alias("line_index"), F.sha2("_raw", 256).alias("_sha"))
    wrong = records.join(lines, ["source_id", "line_index"], "left").filter("_sha is null or _sha <> raw_line_sha256").select("source_id", F.lit(3).alias("f"))
    found = missing.unionByName(damaged).unionByName(short).unionByName(wrong)
    if "position" in records.columns:
        rank = F.struct(F.col("ts_ms").isNull().alias("none"), F.coalesce("ts_ms", F.lit(0)).alias("ms"), "source_id", "line_index")
        seen = previous_value(records.select("source_id", "position", F.lit("all").alias("g"), rank.alias("rank")), "g", "position", "source_id", "rank", "before")
        found = found.unionByName(seen.filter("before > rank").select("source_id", F.lit(4).alias("f")))
    name = F.element_at(F.array(*(F.lit(x) for x in FAULTS)), F.col("f") + 1)
    return found.groupBy("source_id").agg(F.min("f").alias("f")).select("source_id", name.alias("fault"))


def embedded(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of session lines (``source_id``, ``entry_type``, ``custom_type``, ``data``) that carry archives: (``source_id``, ``data`` of the one manifest; ``source_id``, ``fault`` where there are several).

    A session without a manifest carries no archive and is in neither.
    """
    found = entries.filter("entry_type = 'custom' and custom_type = 'cleanup_history_manifest'").groupBy("source_id").agg(F.count("*").alias("n"), F.max("data").alias("data"))
    return found.filter("n = 1").select("source_id", "data"), found.filter("n > 1").select("source_id", F.lit("several manifests").alias("fault"))


def chained(rows: DataFrame, parent: str, leaf: str | None = None) -> DataFrame:
    """Archive rows (``place`` from 0, ``custom_type``, ``data``) as a line of entries, each the parent of the next: plus ``entry_id``, ``parent_id``.

    The first hangs below ``parent``; the last gets the id ``leaf`` if one is given.
    """
    name = F.left(F.sha2(F.concat_ws("\n", F.lit(parent), F.col("place").cast("string")), 256), F.lit(16))
    last = rows.agg(F.max("place")).first()[0]
    ident = F.when(F.col("place") == F.lit(last), F.lit(leaf)).otherwise(name) if leaf else name
    before = F.left(F.sha2(F.concat_ws("\n", F.lit(parent), (F.col("place") - 1).cast("string")), 256), F.lit(16))
    return rows.select("*", ident.alias("entry_id"), F.when(F.col("place") == 0, F.lit(parent)).otherwise(before).alias("parent_id"))
