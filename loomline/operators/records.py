"""Kept turns rendered as texts, and sizes before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import messages as M
from loomline.functions.text import bounded, round_half_up, trim_ws, utf16_length
from loomline.operators.turns import turn_records

# The labels of the parts of a record, and the most units of each.
USER_LABEL, FINAL_LABEL = "[User intent / constraints · authoritative for user requirements]\n", "[Assistant final result]\n"
STATUS_LABEL = "[Assistant durable status · turn unfinished · milestone {}/{} · chronological]\n"
TOOL_LABEL, TOOL_ERROR = "[Tool evidence · ", " · ERROR"
USER_UNITS, TOOL_UNITS = 6_000, 5_000


def rendered(entries: DataFrame) -> DataFrame:
    """One row per kept turn with some text: ``source_id``, ``turn_index``, ``mode``, ``text``, ``selected_units``.

    A head line, then requests, assistant texts and tool results, each under its
    label and in order, joined by blank lines.  The time is that of the last
    assistant message, without one of the first request that has one.
    ``selected_units`` counts requests and tool results as rendered and assistant
    texts without their label.  A turn keeps at most a few messages.
    """
    kept = turn_records(entries)
    said = M.with_message(M.distinct_entries(entries)).select(
        F.col("source_id").alias("_s"), F.col("entry_id").alias("_e"), "text", "tool_name", "is_error", M.message_iso().alias("time"), "error_message"
    )
    many = F.size("assistant_ids")
    kinds = (("user_ids", 0), ("assistant_ids", 1), ("tool_ids", 2))
    listed = None
    for column, kind in kinds:
        rows = kept.select("source_id", "turn_index", "mode", many.alias("n"), F.posexplode(column).alias("k", "id")).withColumn("kind", F.lit(kind))
        listed = rows if listed is None else listed.unionByName(rows)
    parts = listed.join(said, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("id") == F.col("_e")))
    user, tool = bounded(F.col("text"), USER_UNITS), bounded(F.col("text"), TOOL_UNITS)
    own = F.when(trim_ws(F.coalesce("error_message", F.lit(""))) != "", F.concat("text", F.lit("\n[Assistant error]: "), "error_message")).otherwise(F.col("text"))
    before, after = STATUS_LABEL.split("{}/{}")
    status = F.concat(F.lit(before), (F.col("k") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(after), own)
    name = F.when(F.col("tool_name") == "", "unknown").otherwise(F.col("tool_name"))
    block = (
        F.when((F.col("kind") == 0) & (user != ""), F.concat(F.lit(USER_LABEL), user)).when((F.col("kind") == 1) & (trim_ws(own) != ""), F.when(F.col("mode") == "assistant_final", F.concat(F.lit(FINAL_LABEL), own)).otherwise(status))
        .when((F.col("kind") == 2) & (tool != ""), F.concat(F.lit(TOOL_LABEL), name, F.when(F.col("is_error"), TOOL_ERROR).otherwise(""), F.lit("]\n"), tool))
    )
    size = F.when(F.col("kind") == 1, utf16_length(own)).otherwise(utf16_length(F.col("block")))
    held = parts.withColumn("block", block).groupBy("source_id", "turn_index", "mode").agg(
        F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("kind", "k", "block")))).alias("b"), F.sum(F.when(F.col("block").isNotNull(), size).otherwise(0)).alias("selected_units"),
        F.max_by("time", F.when(F.col("kind") == 1, F.col("k"))).alias("last"), F.min_by("time", F.when((F.col("kind") == 0) & F.col("time").isNotNull(), F.col("k"))).alias("first"), F.max(F.col("kind") == 1).alias("answered"),
    )
    time = F.when(F.col("answered"), F.col("last")).otherwise(F.col("first"))
    head = F.concat(F.lit("[result_record turn="), F.col("turn_index").cast("string"), F.lit(" mode="), "mode", F.lit("]"), F.coalesce(F.concat(F.lit(" time="), time), F.lit("")))
    return held.filter(F.size("b") > 0).select("source_id", "turn_index", "mode", F.concat_ws("\n\n", head, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("text"), "selected_units")


def with_summary(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Blocks (``source_id``, ``turn_index``, ``text``) with the latest compaction summary of each source before them, as block -1; sources without one are as they were."""
    rows = M.distinct_entries(entries).filter("entry_type = 'compaction'").filter(trim_ws(F.coalesce("summary", F.lit(""))) != "")
    last = rows.groupBy("source_id").agg(F.max_by("summary", "line_index").alias("text")).select("source_id", F.lit(-1).cast("long").alias("turn_index"), "text")
    return blocks.select("source_id", "turn_index", "text").unionByName(last)


def size_stats(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source ``raw_units`` of all message JSON, ``selected_units`` of its blocks, and ``reduction_pct`` to one digit (0 without messages)."""
    raw = M.distinct_entries(entries).filter("entry_type = 'message' and message is not null").groupBy("source_id").agg(F.sum(utf16_length(F.col("message"))).alias("raw_units"))
    chosen = blocks.groupBy(F.col("source_id").alias("_s")).agg(F.sum(utf16_length(F.col("text"))).alias("selected_units"))
    both = raw.join(chosen, F.col("source_id").eqNullSafe(F.col("_s")), "left").withColumn("selected_units", F.coalesce("selected_units", F.lit(0)))
    cut = round_half_up((1 - F.col("selected_units") / F.col("raw_units")) * 1000) / 10
    return both.select("source_id", "raw_units", "selected_units", F.when(F.col("raw_units") > 0, cut).otherwise(0.0).alias("reduction_pct"))
