"""Checks on ledgers of facts: every check gives a table of violations, empty for a sound ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import Spool

VIOLATION = "ledger_id string, fact_id string, violation string"


def repeated(facts: DataFrame) -> DataFrame:
    """Facts (``ledger_id``, ``fact_id``, ``domain``, ``subject``, ``category``, ``status``, ``statement``) that share what must be unique.

    Ids; domain, subject and statement (compared without case and outer space);
    and one current state fact per domain and subject.
    """
    said = F.lower(F.trim("statement"))

    def over(rows: DataFrame, keys: list, name: str) -> DataFrame:
        named = rows.select("ledger_id", "fact_id", F.struct(*keys).alias("_k"))
        many = named.groupBy("ledger_id", "_k").agg(F.count("*").alias("n")).filter("n > 1").select("ledger_id", "_k")
        return named.join(many, ["ledger_id", "_k"], "left_semi").select("ledger_id", "fact_id", F.lit(name).alias("violation"))

    current = facts.filter("category = 'state' and status = 'current'")
    return (
        over(facts, [F.col("fact_id")], "repeated id").unionByName(over(facts, ["domain", "subject", said.alias("said")], "repeated statement")).unionByName(over(current, ["domain", "subject"], "two current states"))
    ).distinct()


def broken_links(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Supersession links (``ledger_id``, ``fact_id``, ``target_id``) to itself, to nothing, to another topic or to a fact that is not superseded."""
    one = facts.dropDuplicates(["ledger_id", "fact_id"])
    own = one.select("ledger_id", "fact_id", F.struct("domain", "subject").alias("about"))
    other = one.select("ledger_id", F.col("fact_id").alias("target_id"), F.struct("domain", "subject").alias("of"), "status")
    both = links.join(own, ["ledger_id", "fact_id"], "left").join(other, ["ledger_id", "target_id"], "left")
    why = F.when((F.col("fact_id") == F.col("target_id")) | F.col("of").isNull(), "no such target").when(~F.col("about").eqNullSafe(F.col("of")) | (F.coalesce("status", F.lit("")) != "superseded"), "wrong target")
    return both.withColumn("violation", why).filter("violation is not null").select("ledger_id", "fact_id", "violation").distinct()


def in_loops(links: DataFrame) -> DataFrame:
    """Facts that supersede each other in a loop, or are reached only through one: what is left when facts without open links are stripped again and again.

    Each round strips every fact whose targets are all stripped; the number of
    rounds is the longest chain, which is short in ledgers.
    """
    left = Spool(links.select("ledger_id", "fact_id", "target_id").distinct(), "links")
    n = left.df.count()
    while n:
        sources = left.df.select("ledger_id", F.col("fact_id").alias("target_id")).distinct()
        after = Spool(left.df.join(sources, ["ledger_id", "target_id"], "left_semi"), "links")
        m = after.df.count()
        left.drop()
        left = after
        if m == n:
            break
        n = m
    return left.df.select("ledger_id", "fact_id", F.lit("loop").alias("violation")).distinct()


def uncovered(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """Sources (``ledger_id``, ``source_id``) missing from, extra in or repeated in what a ledger covers."""
    want = expected.select("ledger_id", "source_id").distinct()
    have = covered.groupBy("ledger_id", "source_id").agg(F.count("*").alias("n"))
    name = lambda df, v: df.select("ledger_id", "source_id", F.lit(v).alias("violation"))
    return name(want.join(have, ["ledger_id", "source_id"], "left_anti"), "missing").unionByName(name(have.join(want, ["ledger_id", "source_id"], "left_anti"), "extra")).unionByName(name(have.filter("n > 1"), "repeated"))


def remapped(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """References (``item_id``, ``ref``) with coverage ids replaced by evidence ids (``coverage_id``, ``evidence_id``), each once; others kept."""
    return refs.join(evidence.select(F.col("coverage_id").alias("ref"), "evidence_id"), "ref", "left").select("item_id", F.coalesce("evidence_id", "ref").alias("ref")).distinct()


def referenced(evidence: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence that some item refers to, references without evidence): a semi- and an anti-join."""
    used = evidence.join(refs.select(F.col("ref").alias("evidence_id")), "evidence_id", "left_semi")
    dangling = refs.join(evidence.select(F.col("evidence_id").alias("ref")), "ref", "left_anti").select("item_id", "ref")
    return used, dangling


INTERNAL_ID = "(?i)(?<![A-Za-z0-9_])(?:CON|EVT|PHS|DEC|WRK|OPN|RES|ACT|CLM|EVD)-[a-f0-9]{10}(?![A-Za-z0-9_])"


def without_phantoms(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts (``item_id``, ``text``) but those that are only internal ids of which at least one is unknown (``id``)."""
    found = texts.withColumn("_ids", F.regexp_extract_all("text", F.lit(INTERNAL_ID), F.lit(0))).withColumn("_rest", F.trim(F.regexp_replace("text", INTERNAL_ID, " ")))
    bare = found.filter((F.size("_ids") > 0) & (F.col("_rest") == ""))
    ids = bare.select("item_id", "text", F.explode("_ids").alias("_id")).withColumn("_id", F.lower("_id"))
    phantom = ids.join(known.select(F.lower("id").alias("_id")), "_id", "left_anti").select("item_id", "text").distinct()
    return texts.join(phantom, ["item_id", "text"], "left_anti")
