"""Trees of several sessions under one root, and runs of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import messages as M

ROOT = "root"


def fresh_id(*parts) -> F.Column:
    """A new id that depends on nothing but the parts: 16 hex digits."""
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(16))


def merged(entries: DataFrame) -> DataFrame:
    """The entry trees of all sources under one root: ``new_id``, ``new_parent_id``, ``source_id``, ``source_index``, ``line_index``, ``entry_id``, ``entry_type``, ``fault``.

    entries: one row per entry with ``source_id``, ``source_index``,
    ``entry_id``, ``parent_id``, ``line_index``, ``entry_type``.  Each source
    hangs below a marker of its own (``line_index`` -1, type ``source_root``)
    and the markers below ``ROOT``.  An entry without parent hangs below its
    marker; a parent that is not in the source leaves ``new_parent_id`` null and
    is a ``fault``, as is a repeated id.  Null sources and ids are left out.
    Parents are renamed by the same hash as entries, so only their existence
    takes a join.
    """
    rows = entries.filter("source_id is not null and entry_id is not null and entry_id <> ''")
    ids = rows.groupBy("source_id", "entry_id").agg(F.count("*").alias("_n"))
    there = ids.select(F.col("source_id").alias("_s"), F.col("entry_id").alias("_e"))
    named = F.coalesce("parent_id", F.lit("")) != ""
    known = rows.join(ids, ["source_id", "entry_id"]).join(there, (F.col("source_id") == F.col("_s")) & (F.col("parent_id") == F.col("_e")), "left")
    parent = F.when(~named, fresh_id("source_id")).when(F.col("_e").isNotNull(), fresh_id("source_id", "parent_id"))
    fault = F.when(F.col("_n") > 1, "repeated id").when(named & F.col("_e").isNull(), "no parent")
    out = known.select(fresh_id("source_id", "entry_id").alias("new_id"), parent.alias("new_parent_id"), "source_id", "source_index", F.col("line_index").cast("long").alias("line_index"), "entry_id", "entry_type", fault.alias("fault"))
    none = F.lit(None).cast("string")
    markers = rows.groupBy("source_id").agg(F.min("source_index").alias("source_index")).select(
        fresh_id("source_id").alias("new_id"), F.lit(ROOT).alias("new_parent_id"), "source_id", "source_index", F.lit(-1).cast("long").alias("line_index"), none.alias("entry_id"), F.lit("source_root").alias("entry_type"), none.alias("fault")
    )
    return out.unionByName(markers)


def merge_faults(tree: DataFrame, entries: DataFrame) -> DataFrame:
    """What of the entries a merged tree does not hold as it should: ``source_id``, ``entry_id``, ``fault`` (``missing``, ``extra``, ``changed``, ``wrong parent``)."""
    want = merged(entries).filter("line_index >= 0")
    keys = ["source_id", "entry_id", "line_index"]
    side = lambda df, p: df.select(*keys, F.struct("new_id", "entry_type").alias(f"{p}_row"), F.col("new_parent_id").alias(f"{p}_parent"), F.lit(True).alias(p))
    both = side(want, "want").join(side(tree.filter("line_index >= 0"), "have"), keys, "full")
    fault = (
        F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want_row") != F.col("have_row"), "changed")
        .when(~F.col("want_parent").eqNullSafe(F.col("have_parent")), "wrong parent")
    )
    return both.select("source_id", "entry_id", fault.alias("fault")).filter("fault is not null")


def authoritative_tail(entries: DataFrame) -> DataFrame:
    """The messages of each source from its last user message on: ``source_id``, ``entry_id``, ``line_index``.

    Without a user message from the last assistant message that calls a tool on,
    without one all messages.
    """
    m = M.with_message(M.distinct_entries(entries)).filter("entry_type = 'message' and role is not null")
    rows = m.select("source_id", "entry_id", "line_index", (F.col("role") == "user").alias("user"), ((F.col("role") == "assistant") & M.has_tool_call()).alias("calls"))
    begin = rows.groupBy(F.col("source_id").alias("_s")).agg(F.max(F.when(F.col("user"), F.col("line_index"))).alias("user"), F.max(F.when(F.col("calls"), F.col("line_index"))).alias("call"))
    begin = begin.select("_s", F.coalesce("user", "call", F.lit(-1)).alias("begin"))
    return rows.join(begin, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("line_index") >= F.col("begin"))).select("source_id", "entry_id", "line_index")


def transactions(entries: DataFrame) -> DataFrame:
    """Adds to each message its ``transaction`` (the line of its first message): a tool-calling assistant message and the tool results right after it are one.

    ``source_id``, ``entry_id``, ``line_index``, ``transaction``.  A tool result
    belongs to the last message before it that is none, if that calls a tool.
    """
    m = M.with_message(M.distinct_entries(entries)).filter("entry_type = 'message'")
    rows = m.select("source_id", "entry_id", F.col("line_index").cast("long").alias("line_index"), F.coalesce(F.col("role") == "toolResult", F.lit(False)).alias("result"), F.coalesce((F.col("role") == "assistant") & M.has_tool_call(), F.lit(False)).alias("calls"))
    before = F.last(F.when(~F.col("result"), F.struct("line_index", "calls")), ignorenulls=True).over(Window.partitionBy("source_id").orderBy("line_index", "entry_id"))
    held = rows.withColumn("_head", before)
    return held.select("source_id", "entry_id", "line_index", F.when(F.col("result") & F.coalesce("_head.calls", F.lit(False)), F.col("_head.line_index")).otherwise(F.col("line_index")).alias("transaction"))


def with_retained_tail(messages: DataFrame, tails: DataFrame, summaries: DataFrame) -> DataFrame:
    """Messages (``source_id``, ``place``, ``message``) with the tail that a compaction kept put in behind its summary: plus ``sub``, the order at one place.

    tails: ``source_id``, ``idx`` (from 0), ``message``; summaries:
    ``source_id``, ``at`` (place of the summary).  Where the messages right
    behind the summary already are the tail nothing is put in; without a summary
    the tail comes first (place -1).
    """
    sized = tails.groupBy("source_id").agg(F.count("*").alias("n")).join(summaries.groupBy("source_id").agg(F.min("at").alias("at")), "source_id", "left").withColumn("at", F.coalesce("at", F.lit(-1)))
    placed = tails.join(sized, "source_id").withColumn("place", F.col("at") + 1 + F.col("idx"))
    same = placed.filter("at >= 0").join(messages, ["source_id", "place", "message"], "left_semi").groupBy("source_id").agg(F.count("*").alias("same"))
    open_tails = placed.join(same, "source_id", "left").filter(F.coalesce("same", F.lit(0)) < F.col("n"))
    put = open_tails.select("source_id", F.col("at").cast("long").alias("place"), "message", (F.col("idx") + 1).cast("long").alias("sub"))
    return messages.select("source_id", F.col("place").cast("long").alias("place"), "message", F.lit(0).cast("long").alias("sub")).unionByName(put)
