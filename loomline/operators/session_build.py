"""Rows of a new session file around cleaned text, and the checks of a written one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import SECRET_RULES, whole_json
from loomline.functions.values import any_millis

#: The custom types of a cleaned session, each there exactly once and in this order.
PARTS = ("cleanup_text", "cleanup_ir", "cleanup_manifest")


def stored_results(segments: DataFrame, policy_hash: str) -> DataFrame:
    """``source_id``, ``body``, ``data``: the stored result of each source as JSON text, from its final segments (``source_id``, ``source_order``, ``seg_kind``, ``text``, ``fidelity``).

    A source's segments meet in one row, as they do in its file.
    """
    item = F.struct(F.col("source_order").cast("long").alias("sourceOrder"), F.col("seg_kind").alias("kind"), "text", "fidelity")
    held = segments.groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    body = held.withColumn("body", F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n"))
    data = F.struct(F.lit(1).alias("schemaVersion"), "body", F.sha2("body", 256).alias("outputContentHash"), F.lit(policy_hash).alias("policyHash"), "segments")
    return body.select("source_id", "body", F.to_json(data).alias("data"))


def built(results: DataFrame, manifest: F.Column) -> DataFrame:
    """The lines of a cleaned session per source (``source_id``, ``body``, ``data``): a header, the text, the stored result and the manifest, each below the one before.

    ``source_id``, ``line_index``, ``entry_id``, ``parent_id``, ``entry_type``,
    ``custom_type``, ``raw`` (JSON).  Ids follow from source and place, so the
    same input gives the same file.
    """
    name = lambda k: F.left(F.sha2(F.concat_ws("\n", F.coalesce("source_id", F.lit("")), F.lit(str(k))), 256), F.lit(16))
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("text"))))
    payload = {"cleanup_text": text, "cleanup_ir": F.col("data"), "cleanup_manifest": F.to_json(manifest)}
    rows = [F.struct(F.lit(0).cast("long").alias("line_index"), F.col("source_id").alias("entry_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("session").alias("entry_type"), F.lit(None).cast("string").alias("custom_type"), F.lit(None).cast("string").alias("data"))]
    for k, part in enumerate(PARTS, 1):
        parent = F.lit(None).cast("string") if k == 1 else name(k - 1)
        rows.append(F.struct(F.lit(k).cast("long").alias("line_index"), name(k).alias("entry_id"), parent.alias("parent_id"), F.lit("custom_message" if part == "cleanup_text" else "custom").alias("entry_type"), F.lit(part).alias("custom_type"), payload[part].alias("data")))
    flat = results.select("source_id", F.explode(F.array(*rows)).alias("r")).select("source_id", "r.*")
    own = F.struct(F.col("entry_type").alias("type"), F.col("entry_id").alias("id"), F.col("parent_id").alias("parentId"), F.col("custom_type").alias("customType"))
    head = F.regexp_replace(F.to_json(own), r"\}$", "")
    field = F.when(F.col("entry_type") == "custom_message", "content").otherwise("data")
    raw = F.when(F.col("data").isNull(), F.to_json(F.struct(F.lit("session").alias("type"), F.col("entry_id").alias("id"), F.lit(3).alias("version")))).otherwise(F.concat(head, F.lit(',"'), field, F.lit('":'), "data", F.lit("}")))
    return flat.select("source_id", "line_index", "entry_id", "parent_id", "entry_type", "custom_type", raw.alias("raw"))


def build_faults(lines: DataFrame) -> DataFrame:
    """``source_id``, ``fault`` of written sessions: a part that is not there exactly once, an entry that does not hang below the one before it, a header that is not first."""
    counts = lines.groupBy("source_id").agg(*(F.count_if(F.col("custom_type") == p).alias(p) for p in PARTS), F.count_if((F.col("entry_type") == "session") & (F.col("line_index") == 0)).alias("header"))
    short = None
    for p in (*PARTS, "header"):
        found = counts.filter(F.col(p) != 1).select("source_id", F.concat(F.lit(p), F.lit(" not once")).alias("fault"))
        short = found if short is None else short.unionByName(found)
    entry = lines.filter("entry_type <> 'session'")
    before = entry.select(F.col("source_id").alias("_s"), (F.col("line_index") + 1).alias("_l"), F.col("entry_id").alias("_e"))
    chained = entry.filter("line_index > 1").join(before, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("line_index") == F.col("_l")), "left")
    return short.unionByName(chained.filter(~F.col("parent_id").eqNullSafe(F.col("_e")) | F.col("_e").isNull()).select("source_id", F.lit("broken chain").alias("fault"))).distinct()


def secret_shaped(texts: DataFrame, text: str) -> DataFrame:
    """The rows whose text still holds something shaped like a secret: none may be published."""
    hit = F.lit(False)
    for _, rule, _ in SECRET_RULES:
        hit = hit | F.col(text).rlike(rule)
    return texts.filter(hit)


def title(names: F.Column, most: int = 3) -> F.Column:
    """The first names of an array joined by ``, ``, and how many more there are."""
    more = F.greatest(F.size(names) - most, F.lit(0))
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def usage_totals(entries: DataFrame) -> DataFrame:
    """Per source the sums of the usage that messages report: ``input``, ``output``, ``cache_read``, ``cache_write``, ``total_tokens``, ``cost_total``; what is no number counts for nothing."""
    v = whole_json("message")
    number = lambda p: F.sum(F.coalesce(F.when(~F.isnan(F.try_variant_get(v, p, "double")), F.try_variant_get(v, p, "double")), F.lit(0.0)))
    fields = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "total_tokens": "totalTokens", "cost_total": "cost.total"}
    return entries.groupBy("source_id").agg(*(number(f"$.usage.{path}").alias(name) for name, path in fields.items()))


def input_hash(sources: DataFrame, group: str) -> DataFrame:
    """``group``, ``input_hash``: one hash for the inputs of each merge, over its lines ``source_id:sha256`` in order.  A merge has few sources."""
    line = F.concat_ws(":", "source_id", "sha256")
    return sources.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("input_hash"))


def session_time(created: F.Column, timestamp: F.Column) -> F.Column:
    """Milliseconds of a session: of its creation (number or ISO text, as JSON), else of its timestamp, else 0."""
    return F.coalesce(any_millis(created), any_millis(timestamp), F.lit(0).cast("long"))
