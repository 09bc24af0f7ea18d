"""Cleaning sets of documents, each set into one: normalise, redact, drop adjacent repeats, order the documents, drop
whole repeated ones, overlaps, adjacent repeats and near repeats where documents meet, number, render."""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.merge import boundary_near
from loomline.operators.ordering import position_in_group, previous_value
from loomline.operators.segments import signed
from loomline.runtime import Spool

# The labels of rendered segments.
LABELS = {"user": "用户", "assistant": "助手", "tool": "工具", "checkpoint": "上下文", "break": "断点"}


@dataclass(frozen=True)
class Policy:
    """What cleaning does; resolved when the plan is made.

    ``exact``, ``overlap`` and ``near`` switch the adjacent, overlap and boundary
    steps; whole repeated documents of a merge always go.
    """

    redact: bool = True
    labels: bool = True
    timestamps: bool = False
    breaks: bool = True
    exact: bool = True
    overlap: bool = True
    near: bool = True


#: Every segment stays: normalised, redacted and rendered only.
ALL_STAY = Policy(exact=False, overlap=False, near=False)


def merge_order(documents: list[dict]) -> list[str]:
    """Ids in order of merging: parents before children, the ready one created first (unknown last), then by index.

    documents: ``id``, ``path``, ``parent``, ``created``, ``index``.  A loop
    leaves the plain order.  The documents of one merge are named by the caller
    and are few.
    """
    rank = {d["id"]: (d["created"] is None, d["created"] or 0, d["index"]) for d in documents}
    by_path = {d["path"]: d["id"] for d in documents if d["path"]}
    waits = {d["id"]: by_path[d["parent"]] for d in documents if d["parent"] in by_path and by_path[d["parent"]] != d["id"]}
    children = defaultdict(list)
    for child, parent in waits.items():
        children[parent].append(child)
    ready = [(rank[i], i) for i in rank if i not in waits]
    heapq.heapify(ready)
    out = []
    while ready:
        _, at = heapq.heappop(ready)
        out.append(at)
        for child in children[at]:
            heapq.heappush(ready, (rank[child], child))
    return out if len(out) == len(rank) else sorted(rank, key=rank.get)


def cleaned(segments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Segments with canonical (and redacted) ``clean`` text and the number of ``redactions``; those left empty are dropped."""
    rows = signed(segments)
    if not policy.redact:
        return rows.withColumn("clean", F.col("canon")).withColumn("redactions", F.lit(0).cast("long"))
    total = F.lit(0).cast("long")
    for name, *_ in T.SECRET_RULES:
        total = total + F.col(f"_r.{name}")
    return rows.withColumn("_r", T.redaction(F.col("canon"))).withColumn("redactions", total).withColumn("clean", F.col("_r.text")).drop("_r")


def key_of(name: str, prefix: str):
    """A key that is never null, different for each prefix."""
    return F.coalesce(F.concat(F.lit(f"{prefix}:"), F.col(name)), F.lit(prefix))


def placed_documents(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """``d`` (key of the source), ``m`` (key of its merge), ``merge``, ``ord`` (place in it, from 0), ``many`` (more documents than one).

    Sources that ``documents`` does not list are merges of their own.  Ordering
    sees one short row per document of a merge.
    """
    listed = documents.select(key_of("source_id", "s").alias("d"), "merge", "source_path", "parent_session", F.col("created_ms").cast("long").alias("created_ms")).filter("merge is not null").dropDuplicates(["d"])
    own = segments.select(key_of("source_id", "s").alias("d"), F.col("source_id").alias("own")).distinct()
    every = listed.join(own, "d", "full").withColumn("m", F.when(F.col("merge").isNotNull(), key_of("merge", "m")).otherwise(F.col("d"))).withColumn("merge", F.coalesce("merge", "own"))
    every = Spool(every.drop("own").join(every.groupBy("m").agg((F.count("*") > 1).alias("many")), "m"), "documents").df

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        text = lambda x: x if isinstance(x, str) and x else None
        rows = [
            {"id": r.d, "path": text(r.source_path), "parent": text(r.parent_session), "created": None if pd.isna(r.created_ms) else int(r.created_ms), "index": r.d}
            for r in docs.sort_values("d").itertuples(index=False)
        ]
        return pd.DataFrame({"d": merge_order(rows), "ord": range(len(rows))})

    placed = every.filter("many").select("m", "d", "source_path", "parent_session", "created_ms").groupBy("m").applyInPandas(run, "d string, ord long")
    return Spool(every.select("d", "m", "merge", "many").join(placed, "d", "left").withColumn("ord", F.coalesce("ord", F.lit(0).cast("long"))), "documents").df


def suffix_prefix(left: list, right: list) -> int:
    """The most last elements of ``left`` that are the first of ``right``, in time linear in ``right``."""
    left = left[max(0, len(left) - len(right)) :]
    if not right or right[0] not in left:
        return 0
    fail, k = [0] * len(right), 0
    for n in range(1, len(right)):
        while k and right[n] != right[k]:
            k = fail[k - 1]
        k += right[n] == right[k]
        fail[n] = k
    k = 0
    for x in left:
        while k and (k == len(right) or x != right[k]):
            k = fail[k - 1]
        k += x == right[k]
    return k


def overlap_starts(rows: DataFrame) -> DataFrame:
    """``m``, ``ord``, ``start``: how many first segments of a document end what is merged before it.

    rows: ``m``, ``ord``, ``place``, ``signature``.  A merge is a fold, each
    document against all that earlier ones left, so one streaming pass per
    merge; the state is 16 bytes a segment of the open merge.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merge, at = None, None
        merged, doc = (array("q"), array("q")), (array("q"), array("q"))

        def close() -> tuple | None:
            n = len(doc[0])
            start = suffix_prefix(list(zip(merged[0][-n:], merged[1][-n:], strict=True)), list(zip(*doc, strict=True))) if n else 0
            for held, new in zip(merged, doc, strict=True):
                held.extend(new[start:])
            return (merge, at, start) if start else None

        def frame(out: list) -> pd.DataFrame:
            return pd.DataFrame([x for x in out if x], columns=["m", "ord", "start"])

        for b in batches:
            out = []
            for (m, o), part in b.groupby(["m", "ord"], sort=False):
                if (m, o) != (merge, at):
                    out.append(close())
                    doc = (array("q"), array("q"))
                    if m != merge:
                        merged = (array("q"), array("q"))
                    merge, at = m, o
                for held, c in zip(doc, ("h1", "h2"), strict=True):
                    held.extend(part[c].tolist())
            yield frame(out)
        yield frame([close()])

    hashed = rows.select("m", "ord", "place", F.xxhash64("signature").alias("h1"), F.xxhash64(F.lit(7), F.reverse("signature")).alias("h2"))
    return hashed.repartition(F.col("m")).sortWithinPartitions("m", "ord", "place").mapInPandas(run, "m string, ord long, start long")


def merged(segments: DataFrame, policy: Policy = Policy(), documents: DataFrame | None = None) -> DataFrame:
    """Every clean segment with its ``merge`` and ``fate``: kept, or removed as exact, document, overlap or near.

    documents: ``merge``, ``source_id``, ``source_path``, ``parent_session``,
    ``created_ms``; without them every source is a merge of its own.  Kept
    segments stand in the order of ``m``, ``ord``, ``place``, ``segment_id``.
    Signatures and lengths are those of the text after redaction.
    """
    rows = cleaned(segments, policy).filter("clean <> ''")
    own = rows.withColumn("d", key_of("source_id", "s"))
    if documents is None and not (policy.exact or policy.overlap or policy.near):
        return own.withColumn("m", F.col("d")).withColumn("merge", F.col("source_id")).withColumn("ord", F.lit(0).cast("long")).withColumn("place", F.col("source_order").cast("long")).withColumn("fate", F.lit("kept"))
    text = Spool(signed(own.withColumn("text", F.col("clean")).drop("canon", "signature")).drop("clean").withColumnRenamed("canon", "clean"), "clean").df
    if documents is None:
        documents = segments.sparkSession.createDataFrame([], "merge string, source_id string, source_path string, parent_session string, created_ms long")
    docs = placed_documents(segments, documents)
    gone = []

    def without(left: DataFrame, condition, fate: str) -> DataFrame:
        left = Spool(left.withColumn("_out", F.coalesce(condition, F.lit(False))), fate).df
        gone.append(left.filter("_out").select("segment_id", F.lit(fate).alias("fate")))
        return left.filter(~F.col("_out")).drop("_out")

    left = text.select("segment_id", "d", "source_order", "signature")
    if policy.exact:
        left = without(previous_value(left, "d", "source_order", "segment_id", "signature", "before"), F.col("before") == F.col("signature"), "exact").drop("before")
    left = position_in_group(left, "d", [F.col("source_order"), F.col("segment_id")], "place").join(docs.drop("merge"), "d")
    left = Spool(left.select("segment_id", "d", "m", "ord", "many", "place", "signature"), "placed").df

    marks = left.filter("many").groupBy("m", "ord").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("place", "signature")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), F.reverse("signature"), F.col("place"))).alias("b"))
    first = marks.groupBy("m", "n", "a", "b").agg(F.min("ord").alias("first"))
    copies = marks.join(first, ["m", "n", "a", "b"]).filter("ord > first").select("m", "ord", F.lit(True).alias("copy"))
    left = without(left.join(copies, ["m", "ord"], "left"), F.col("copy"), "document").drop("copy")
    if policy.overlap:
        starts = overlap_starts(left.filter("many"))
        left = without(left.join(starts, ["m", "ord"], "left"), F.col("place") <= F.col("start"), "overlap").drop("start")
    if policy.exact or policy.near:
        left = position_in_group(left, "m", [F.col("ord"), F.col("place")], "at")
    if policy.exact:
        left = without(previous_value(left, "m", "at", "segment_id", "signature", "before"), F.col("before") == F.col("signature"), "exact").drop("before")
    if policy.near:
        met = left.filter("many").select("segment_id", "m", "at").join(text.select("segment_id", "source_id", "seg_kind", F.col("clean").alias("text")), "segment_id")
        near = boundary_near(met, "m", ["at"]).select("segment_id", F.lit(True).alias("near"))
        left = without(left.join(near, "segment_id", "left"), F.col("near"), "near").drop("near")
    fates = left.select("segment_id", F.lit("kept").alias("fate"), "ord", "place")
    for part in gone:
        fates = fates.unionByName(part, allowMissingColumns=True)
    return text.join(fates, "segment_id").join(docs.select("d", "m", "merge"), "d")


def rendered(segments: DataFrame, policy: Policy = ALL_STAY, documents: DataFrame | None = None) -> DataFrame:
    """One block per kept segment as it stands in the rendered text: ``source_id`` (``merge`` where documents are given), ``position`` (dense, from 1), ``block``."""
    label = F.coalesce(*[F.when(F.col("seg_kind") == k, v) for k, v in LABELS.items()], F.lit(""))
    time = T.iso_text(F.unix_millis("occurred_at")) if policy.timestamps else F.lit(None).cast("string")
    stamp = F.when(time.isNotNull(), F.concat(F.lit(" ["), time, F.lit("]"))).otherwise("")
    body = F.concat(label, stamp, F.lit("：\n"), F.col("clean")) if policy.labels else F.concat(F.when(time.isNotNull(), F.concat(F.lit("["), time, F.lit("]\n"))).otherwise(""), F.col("clean"))
    shown = merged(segments, policy, documents).filter("fate = 'kept'")
    if not policy.breaks:
        shown = shown.filter("seg_kind is null or seg_kind <> 'break'")
    placed = position_in_group(shown.select("m", "merge", "ord", "place", "segment_id", body.alias("block")), "m", [F.col("ord"), F.col("place"), F.col("segment_id")])
    return placed.select(F.col("merge").alias("source_id" if documents is None else "merge"), "position", "block")


def summary(segments: DataFrame, policy: Policy = ALL_STAY, documents: DataFrame | None = None) -> DataFrame:
    """Per source: segments, those left after cleaning, redactions, characters before and after, and the reduction in per cent.

    Where documents are given, per ``merge`` of at least one segment, with the
    numbers removed as exact repeats (whole documents included), overlaps and
    near repeats.
    """
    if documents is None:
        before = segments.select(F.col("source_id").alias("g"), "source_id", "text")
    else:
        of = placed_documents(segments, documents).select("d", F.col("m").alias("g"), F.col("merge").alias("source_id"))
        before = segments.select(key_of("source_id", "s").alias("d"), "text").join(of, "d")
    before = before.groupBy("g", "source_id").agg(F.count("*").alias("input_segments"), F.coalesce(F.sum(T.utf16_length(F.col("text"))), F.lit(0)).alias("raw_chars"))
    kept = F.col("fate") == "kept"
    after = merged(segments, policy, documents).groupBy(F.col("source_id" if documents is None else "m").alias("_g")).agg(
        F.count_if(kept).alias("n"), F.sum("redactions").alias("r"), F.sum(F.when(kept, T.utf16_length(F.col("clean")))).alias("c"),
        F.count_if(F.col("fate").isin("exact", "document")).alias("e"), F.count_if(F.col("fate") == "overlap").alias("o"), F.count_if(F.col("fate") == "near").alias("x"),
    )
    both = before.join(after, F.col("g").eqNullSafe(F.col("_g")), "left")
    left = F.coalesce("c", F.lit(0))
    share = F.when(F.col("raw_chars") > 0, T.round_half_up((1 - left / F.col("raw_chars")) * 1000) / 10).otherwise(0.0)
    removed = [F.coalesce(a, F.lit(0)).alias(b) for a, b in (("e", "exact_removed"), ("o", "overlap_removed"), ("x", "near_removed"))]
    return both.select(
        F.col("source_id").alias("source_id" if documents is None else "merge"), "input_segments", F.coalesce("n", F.lit(0)).alias("output_segments"), *(removed if documents is not None else []),
        F.coalesce("r", F.lit(0)).alias("redactions"), "raw_chars", left.alias("clean_chars"), share.alias("reduction_pct"),
    )
