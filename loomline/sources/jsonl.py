"""Session files: JSON Lines with a header line, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.text import whole_json
from loomline.runtime import Spool

VERSION = 3


def read_lines(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """``source_path``, ``line_index`` (place among all lines of the file, from 0), ``raw``: every line that is not blank.

    ``exact`` keeps each line byte for byte, blank ones and ``\\r`` included;
    only what follows a last line end is no line.  Large files are read in
    blocks by many tasks: a line's place is its place in its block plus the
    lines of the blocks before, one row per block.
    """
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("source_path"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("raw"))
    blocks = text.groupBy(F.col("source_path").alias("_path"), F.col("_block").alias("_at")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = Spool(blocks.withColumn("_before", before), "blocks").df
    lines = text.join(blocks, (F.col("source_path") == F.col("_path")) & (F.col("_block") == F.col("_at")))
    placed = lines.select("source_path", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_index"), "raw")
    return placed if exact else placed.withColumn("raw", F.regexp_replace("raw", "\r$", "")).filter(F.trim("raw") != "")


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``entry_type``, ``entry_id``, ``parent_id``, ``ts_text``, ``message``, ``summary``, ``raw_line_sha256``, ``readable``."""
    v = lines.withColumn("_v", whole_json("raw"))
    get = lambda p: F.try_variant_get("_v", p, "string")
    return v.select(
        *lines.columns, get("$.type").alias("entry_type"), get("$.id").alias("entry_id"), get("$.parentId").alias("parent_id"), get("$.timestamp").alias("ts_text"),
        F.to_json(F.try_variant_get("_v", "$.message", "variant")).alias("message"), get("$.summary").alias("summary"), F.sha2("raw", 256).alias("raw_line_sha256"),
        F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("readable"),
    )


def failing(what: str, holds: Column) -> Column:
    """True where ``holds``; else reading fails and names the line."""
    wrong = F.raise_error(F.concat(F.lit(f"{what}: line "), F.col("line_index").cast("string"), F.lit(" of "), F.col("source_path")))
    return F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(wrong.cast("boolean"))


def read_sessions(spark: SparkSession, path: str, strict: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(headers, entries) of session files.

    Headers: ``source_path``, ``source_id``, ``format_version`` (1 where none is
    given), ``cwd``, ``parent_session``.  The first line must be the header.
    Strict reading fails on an unreadable line (with ``exact`` also on a blank
    one) and on a file that does not begin with a header; otherwise unreadable
    lines are left out, and a file without header goes by ``source-`` and its
    number in order of path.  Entries without a string id are left out.
    """
    rows = parsed(read_lines(spark, path, exact))
    rows = rows.filter(failing("unreadable", F.col("readable")) if strict else F.col("readable"))
    first = rows.groupBy("source_path").agg(F.min_by(F.struct("line_index", "entry_type", "entry_id", "raw"), "line_index").alias("h")).select("source_path", "h.*")
    is_header = (F.col("entry_type") == "session") & F.col("entry_id").isNotNull()
    number = F.concat(F.lit("source-"), F.row_number().over(Window.orderBy("source_path")) - 1)  # one row per file
    v = F.parse_json("raw")
    get = lambda p, kind: F.when(is_header, F.try_variant_get(v, p, kind))
    named = first.filter(failing("no header", is_header)) if strict else first
    headers = named.select(
        "source_path", F.when(is_header, F.col("entry_id")).otherwise(number).alias("source_id"), F.coalesce(get("$.version", "int"), F.lit(1)).alias("format_version"), get("$.cwd", "string").alias("cwd"), get("$.parentSession", "string").alias("parent_session")
    )
    entries = rows.filter("entry_type <> 'session' and entry_id is not null").join(headers.select("source_path", "source_id"), "source_path")
    return headers, entries


def write_lines(entries: DataFrame, path: str, mode: str = "error") -> None:
    """Entries (``source_id``, ``line_index``, ``raw``) as text files, one folder per source, lines in order."""
    ordered = entries.repartition(F.col("source_id")).sortWithinPartitions("source_id", "line_index")
    ordered.select("source_id", F.col("raw").alias("value")).write.mode(mode).partitionBy("source_id").text(path)
