"""Segments: projection of messages, signatures, exact, overlapping and boundary duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomline.functions import messages as M
from loomline.functions import text as T
from loomline.functions.values import units
from loomline.operators.ordering import previous_value

#: What of tool output is shown: nothing, errors only, or all.
TOOL_POLICIES = ("none", "errors", "all")


def project(entries: DataFrame, tool_text: str = "all", effective: bool = True, shell_text: str | None = None) -> DataFrame:
    """One row per visible text of each entry: ``source_id``, ``entry_id``, ``line_index``, ``part``, ``seg_kind``, ``text``, ``fidelity``, ``incomplete``.

    User and assistant texts are verbatim (an assistant text cut off is
    incomplete); tool results as ``tool_text`` says and shell executions, command
    and output as one text, as ``shell_text`` says (``tool_text`` where it is not
    given); summaries are derived checkpoints (of compactions only in the
    effective view), as are custom messages unless they are the hidden text of a
    cleaning.  Custom messages need the columns ``content`` (JSON) and
    ``display``; a table without them has none.  Empty texts give no row; roles
    are taken as written.
    """
    policies = tool_text, shell_text or tool_text
    if not set(policies) <= set(TOOL_POLICIES):
        raise ValueError(f"tool_text and shell_text must be of {TOOL_POLICIES}")
    m = M.with_message(M.distinct_entries(entries))
    tools, shells = ({"none": F.lit(False), "errors": failed, "all": F.lit(True)}[p] for p, failed in zip(policies, (M.is_failure(), M.shell_failed()), strict=True))
    role, kind_of, is_message = F.col("role"), F.col("entry_type"), F.col("entry_type") == "message"
    custom = F.lit(False)
    if {"content", "display"} <= set(entries.columns):
        hidden = F.coalesce((F.col("custom_type") == "cleanup_text") & ~F.col("display"), F.lit(False))
        custom = (kind_of == "custom_message") & ~hidden
    kind = (
        F.when(is_message & role.isin("user", "assistant"), role)
        .when(is_message & (((role == "toolResult") & tools) | ((role == "bashExecution") & shells)), "tool")
        .when((is_message & role.isin("custom", "branchSummary", "compactionSummary")) | custom, "checkpoint")
        .when((kind_of == "branch_summary") | ((kind_of == "compaction") & F.lit(effective)), "checkpoint")
    )
    said = (
        F.when(is_message & (role == "bashExecution"), F.array(M.shell_text()))
        .when(is_message & role.isin("branchSummary", "compactionSummary"), F.array(F.coalesce("own_summary", F.array_join("texts", "\n"))))
        .when(is_message, F.col("texts"))
    )
    if {"content", "display"} <= set(entries.columns):
        said = said.when(kind_of == "custom_message", M.custom_text(F.col("content"), F.col("display")))
    said = said.otherwise(F.array("summary"))
    rows = m.withColumn("seg_kind", kind).filter("seg_kind is not null").select(
        "source_id", "entry_id", "line_index", "seg_kind", "stop_reason", F.posexplode(F.filter(said, lambda x: x != "")).alias("part", "text")
    )
    return rows.select(
        "source_id", "entry_id", "line_index", F.col("part").cast("long").alias("part"), "seg_kind", "text",
        F.when(F.col("seg_kind") == "checkpoint", "derived").otherwise("verbatim").alias("fidelity"),
        F.coalesce((F.col("seg_kind") == "assistant") & F.col("stop_reason").isin("length", "aborted", "abort"), F.lit(False)).alias("incomplete"),
    )


def signed(segments: DataFrame) -> DataFrame:
    """Adds ``canon`` (canonical text) and ``signature`` (kind and SHA-256 of its fingerprint); null and empty texts are dropped."""
    canon = segments.withColumn("canon", T.canonical_text("text")).filter("canon is not null and canon <> ''")
    return canon.withColumn("signature", F.concat(F.coalesce("seg_kind", F.lit("")), F.lit(":"), F.sha2(T.fingerprint_text(F.col("canon")), 256)))


def without_adjacent(segments: DataFrame) -> DataFrame:
    """Signed segments (``source_id``, ``source_order``, ``segment_id``) that repeat the one before in their source, marked ``repeated``."""
    before = previous_value(signed(segments), "source_id", "source_order", "segment_id", "signature", "before")
    return before.withColumn("repeated", F.coalesce(F.col("before") == F.col("signature"), F.lit(False))).drop("before")


def first_documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``signature``, ``first_doc_id`` (the least with that text), ``copies``: documents alike up to white space."""
    one = documents.select("doc_id", F.sha2(T.fingerprint_text(T.canonical_text("text")), 256).alias("signature")).filter("doc_id is not null and signature is not null")
    first = one.groupBy("signature").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"))
    return one.join(first, "signature").select("doc_id", "signature", "first_doc_id", "copies")


def pack(blocks: DataFrame, group: str, order: list[str], size: str, most: int = 24_000, between: int = 2) -> DataFrame:
    """Adds ``chunk``, from 1: whole blocks packed greedily in order, at most ``most`` characters with ``between`` per joint.

    A block above the limit stands alone.  One streaming pass per group: the
    only state is the size of the open chunk.  ``size`` is an integer column.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", chunk long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, used, begun = None, 0, 0, False
        for b in batches:
            numbers = []
            for k, n in zip(b[group], b[size], strict=True):
                k = None if k is None or k != k else k
                if not begun or k != key:
                    key, chunk, used, begun = k, 1, int(n), True
                elif used + int(n) + between > most:
                    chunk, used = chunk + 1, int(n)
                else:
                    used += int(n) + between
                numbers.append(chunk)
            yield b.assign(chunk=numbers)

    return blocks.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def split_oversized(text: str, most: int = 24_000) -> list[str]:
    """Labelled parts of a text of more than ``most`` UTF-16 units, cut at its last line end within the limit unless that loses half of it."""
    if len(text.encode("utf-16-le", "surrogatepass")) <= 2 * most:
        return [text]
    parts = []
    while len(text.encode("utf-16-le", "surrogatepass")) > 2 * most:
        whole = len(units(text, most))
        at = text.rfind("\n", 0, whole + 1)
        at = whole if at < whole // 2 else at
        parts.append(text[:at])
        text = text[at:].lstrip("\n")
    parts += [text] if text else []
    return [f"[oversized block part {k}/{len(parts)}]\n{p}" for k, p in enumerate(parts, 1)]


def oversized_parts(most: int = 24_000):
    """``split_oversized`` as a column function; null stays null."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_oversized(t, most))

    return run
