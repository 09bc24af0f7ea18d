"""Merging sessions: families by parent session, overlaps between neighbours, near duplicates where they meet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.hierarchy import LOCAL_ROWS, hierarchy
from loomline.operators.segments import signed
from loomline.runtime import Spool

LEAST_CHARS, LEAST_RATIO = 80, 0.98


def families(sessions: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``source_path``, ``root_path``, ``generation`` of each session by its ``parent_session``.

    A parent that is not there makes a root; sessions on or below a loop have
    generation -1 and the loop's smallest path as root.  Rows without a path are
    left out.
    """
    rows = sessions.select(F.lit("all").alias("source_id"), F.col("source_path").alias("entry_id"), F.col("parent_session").alias("parent_id"), F.coalesce("created_ms", F.lit(-1)).alias("line_index"))
    return hierarchy(rows, with_path=False, local_rows=local_rows).select(F.col("entry_id").alias("source_path"), F.col("root_id").alias("root_path"), F.col("node_depth").alias("generation"))


def overlaps(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``left``, ``right``, ``overlap``: how many last rows of ``left`` are the first of ``right``, for each pair (0 for none).

    rows: ``source``, ``place`` (dense, from 0), ``signature``.  Candidates are
    the places of ``right``'s first signature in ``left``; a candidate of length
    k holds if k rows agree at its offset.  All by equi-joins and counts, so
    that no list of a whole source is made.  Rows are written once and joined by
    sorting: from the plan that made them Spark may take them for few and
    broadcast them all.
    """
    pairs = pairs.select("left", "right").filter("left is not null and right is not null").distinct()
    rows = Spool(rows.select("source", "place", "signature"), "places").df
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    n_left, n_right = (sizes.select(F.col("source").alias(side), F.col("n").alias(f"n_{side}")).hint("merge") for side in ("left", "right"))
    sized = pairs.join(n_left, "left").join(n_right, "right")
    l = rows.select(F.col("source").alias("left"), F.col("place").alias("l"), F.col("signature").alias("s")).hint("merge")  # noqa: E741
    r = rows.select(F.col("source").alias("right"), F.col("place").alias("r"), F.col("signature").alias("s")).hint("merge")
    k = F.col("n_left") - F.col("l")
    starts = sized.join(r.filter("r = 0"), "right").join(l, ["left", "s"]).filter(k <= F.col("n_right")).select("left", "right", "n_left", k.alias("k"))
    met = starts.join(r, "right").filter("r < k").withColumn("l", F.col("n_left") - F.col("k") + F.col("r")).join(l, ["left", "l", "s"])
    best = met.groupBy("left", "right", "k").agg(F.count("*").alias("c")).filter("c = k").groupBy("left", "right").agg(F.max("k").alias("k"))
    return pairs.join(best, ["left", "right"], "left").select("left", "right", F.coalesce("k", F.lit(0)).alias("overlap"))


def boundary_near(segments: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``segment_id``, ``kept_id``: where neighbours of two sources nearly repeat each other, the longer text is kept in the earlier place.

    One streaming pass per group, comparing with the row last kept; the state
    is one row.  Compared are segments of one kind from different sources
    without code, of 80 characters or more, when the key of one holds that of
    the other at 98 % of its length or more.
    """
    key = T.lexical_key(F.col("canon"))
    rows = signed(segments).select(
        *dict.fromkeys([group, *order, "segment_id", "source_id", "seg_kind"]), T.utf16_length(F.col("canon")).alias("size"), T.looks_like_code(F.col("canon")).alias("code"),
        F.when((T.utf16_length(F.col("canon")) >= LEAST_CHARS) & ~T.looks_like_code(F.col("canon")), key).alias("key"),
    )

    def same(a, b) -> bool:
        if a.seg_kind != b.seg_kind or a.source_id == b.source_id or not a.key or not b.key:
            return False
        short, long = sorted((a.key, b.key), key=len)
        return short in long and len(short.encode("utf-16-le")) >= LEAST_RATIO * len(long.encode("utf-16-le"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if last is not None and getattr(last, group) == getattr(r, group) and same(last, r):
                    longer = r if r.size > last.size else last
                    gone = last if longer is r else r
                    out.append((gone.segment_id, longer.segment_id))
                    last = longer
                else:
                    last = r
            yield pd.DataFrame(out, columns=["segment_id", "kept_id"], dtype="int64")

    return rows.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInPandas(run, "segment_id long, kept_id long")
