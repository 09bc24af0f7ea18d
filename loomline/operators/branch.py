"""The active branch of a session and what of it is in effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.messages import distinct_entries
from loomline.operators.hierarchy import LOCAL_ROWS, hierarchy


def active_branch(entries: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The path from the root to the last entry of each source: ``source_id``, ``entry_id``, ``depth``, ``whole``.

    The last entry has the greatest ``line_index`` (ties: the greater id).  An
    entry is on the path if the last entry's pre-order number lies in the
    interval of its subtree: one equi-join on the tree, no walk.  ``whole`` is
    false where the path ends in a parent that is not there.  A source whose
    last entry lies on or below a loop has no row.
    """
    tree = hierarchy(entries, with_path=False, local_rows=local_rows).filter("node_depth >= 0")
    one = distinct_entries(entries).select(F.col("source_id").alias("_s"), F.col("entry_id").alias("_e"), F.coalesce("line_index", F.lit(-1)).alias("_line"), F.coalesce("parent_id", F.lit("")).alias("_parent"))
    last = one.groupBy("_s").agg(F.max(F.struct("_line", "_e")).alias("l")).select(F.col("_s"), F.col("l._e").alias("_tip"))
    at = tree.join(last, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("entry_id") == F.col("_tip"))).select(
        F.col("source_id").alias("_ts"), F.col("root_id").alias("_tr"), F.col("pre_order").alias("_at")
    )
    holds = (F.col("pre_order") <= F.col("_at")) & (F.col("_at") < F.col("pre_order") + F.col("subtree_size"))
    path = tree.join(at, F.col("source_id").eqNullSafe(F.col("_ts")) & (F.col("root_id") == F.col("_tr"))).filter(holds)
    roots = one.select(F.col("_s").alias("_rs"), F.col("_e").alias("_re"), (F.col("_parent") == "").alias("whole"))
    return path.join(roots, F.col("source_id").eqNullSafe(F.col("_rs")) & (F.col("root_id") == F.col("_re"))).select("source_id", "entry_id", F.col("node_depth").alias("depth"), "whole")


def effective_entries(entries: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """What of the active branch is in effect: ``source_id``, ``entry_id``, ``position`` (of the order, not dense), ``from_compaction``.

    Without a compaction the whole branch; else the latest compaction first,
    then the entries kept from its ``first_kept_entry_id`` on (none if that is
    not before it), then all entries after it.
    """
    info = distinct_entries(entries).select(F.col("source_id").alias("_s"), F.col("entry_id").alias("_e"), "entry_type", "first_kept_entry_id")
    path = active_branch(entries, local_rows).join(info, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("entry_id") == F.col("_e")))
    latest = path.filter("entry_type = 'compaction'").groupBy(F.col("source_id").alias("_cs")).agg(F.max_by(F.struct("depth", "first_kept_entry_id"), "depth").alias("c"))
    both = path.join(latest, F.col("source_id").eqNullSafe(F.col("_cs")), "left")
    kept = path.select(F.col("source_id").alias("_ks"), F.col("entry_id").alias("_ke"), F.col("depth").alias("_kd"))
    same = F.col("source_id").eqNullSafe(F.col("_ks")) & (F.col("c.first_kept_entry_id") == F.col("_ke"))
    both = both.join(kept, same, "left")
    inside = F.col("c").isNull() | (F.col("depth") >= F.col("c.depth")) | ((F.col("_kd") < F.col("c.depth")) & (F.col("depth") >= F.col("_kd")))
    is_it = F.coalesce(F.col("depth") == F.col("c.depth"), F.lit(False))
    return both.filter(F.coalesce(inside, F.lit(False))).select("source_id", "entry_id", F.when(is_it, -1).otherwise(F.col("depth")).cast("long").alias("position"), is_it.alias("from_compaction"))


def tree_faults(entries: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Per source: entries, repeated ids, roots, parents that are not there, entries on or below loops, and whether it is one sound tree."""
    tree = hierarchy(entries, with_path=False, local_rows=local_rows)
    rows = entries.filter("entry_id is not null and entry_id <> ''").groupBy("source_id", "entry_id").agg(F.count("*").alias("lines"), F.max(F.coalesce("parent_id", F.lit(""))).alias("parent"))
    counts = rows.groupBy("source_id").agg(F.count("*").alias("entries"), F.count_if(F.col("lines") > 1).alias("repeated"), F.count_if(F.col("parent") == "").alias("roots"))
    shape = tree.groupBy(F.col("source_id").alias("_s")).agg(F.count_if(F.col("node_depth") == 0).alias("tops"), F.count_if(F.col("node_depth") < 0).alias("looped"))
    both = counts.join(shape, F.col("source_id").eqNullSafe(F.col("_s")))
    lost = F.col("tops") - F.col("roots")
    return both.select("source_id", "entries", "repeated", "roots", lost.alias("lost_parents"), "looped", ((F.col("repeated") == 0) & (F.col("roots") == 1) & (lost == 0) & (F.col("looped") == 0)).alias("sound"))
