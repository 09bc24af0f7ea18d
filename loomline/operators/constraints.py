"""Carrying hard constraints from earlier reports into a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import constraint_text
from loomline.runtime import Spool

#: Texts shorter than this supersede others only by equality.
LEAST_CONTAINED = 8
#: Characters of the stretches by which texts meet: a text is looked for by one of the greatest size that it has.
SIZES = tuple(LEAST_CONTAINED << k for k in range(24))


def fitting(text: str):
    """The ``SIZES`` that a text is long enough for."""
    return F.filter(F.array(*map(F.lit, SIZES)), lambda n: n <= F.length(text))


def stretches(texts: DataFrame, text: str, key: str) -> DataFrame:
    """``key`` and ``_stretch`` (hash): every stretch of ``_size`` characters of a text, one row each."""
    hashes = F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_size") + 1), lambda i: F.xxhash64(F.substring(text, i, F.col("_size"))))
    return texts.select(key, F.explode(F.array_distinct(hashes)).alias("_stretch"))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """``part``, ``whole``: which texts of ``parts`` stand in which of ``wholes``.

    Both have one column of these names, distinct and of ``LEAST_CONTAINED``
    characters or more.  Of a part the stretch that the fewest wholes hold is
    taken, at least half of the part long, so that beginnings that many share
    bring nothing together; a part with a stretch that no whole holds is in
    none.  Wholes with that stretch are tested.  Wholes and stretches go by
    hashes of 8 bytes, which only bring together; parts by 16.  Rows by stretch
    are many more than Spark estimates from the texts, and are not broadcast.
    """
    parts = parts.withColumn("_part", F.struct(F.xxhash64("part").alias("a"), F.xxhash64(F.lit(7), F.reverse("part")).alias("b")))
    wholes = wholes.withColumn("_whole", F.xxhash64("whole"))
    sized = parts.withColumn("_size", F.array_max(fitting("part")))
    used = F.broadcast(sized.select("_size").distinct())  # as many as SIZES at most
    held = stretches(wholes.withColumn("_size", F.explode(fitting("whole"))).join(used, "_size"), "whole", "_whole")
    often = held.groupBy("_stretch").agg(F.count("*").alias("n"))
    own = stretches(sized, "part", "_part").join(often.hint("merge"), "_stretch", "left")
    rare = own.groupBy("_part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_stretch")).alias("r")).filter("r.n > 0")
    near = rare.select("_part", F.col("r._stretch").alias("_stretch")).join(held.hint("merge"), "_stretch").select("_part", "_whole")
    near = near.join(parts.hint("merge"), "_part").join(wholes.hint("merge"), "_whole")
    return near.filter(F.contains("whole", "part")).select("part", "whole")


def preserved(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` and the active hard constraints of ``old`` that it neither retains nor supersedes, with ``inherited``.

    Columns of both: ``id``, ``statement``, ``level``, ``status``,
    ``supersedes``, ``evidence`` (array).  Retained: an active hard constraint
    of the same id or the same text up to white space and punctuation.
    Superseded: a constraint with evidence names the old id, equals its text, or
    one text contains the other and both have 8 characters or more.  Equality is
    joined on keys, containment on stretches of texts (``contained``).  Null
    statements match nothing.
    """
    wanted = ["id", "statement", "level", "status", "supersedes", "evidence"]
    rest = old.filter("level = 'hard' and status = 'active'").select(*wanted).dropDuplicates(["id"]).withColumn("_text", constraint_text(F.col("statement")))
    held = new.filter("level = 'hard' and status = 'active'").select(F.col("id").alias("_id"), constraint_text(F.col("statement")).alias("_t"))
    rest = rest.join(held.select("_id").hint("merge"), F.col("id") == F.col("_id"), "left_anti").join(held.select("_t").hint("merge"), F.col("_text") == F.col("_t"), "left_anti")
    ends = new.filter(F.col("supersedes").isNotNull() & (F.size("evidence") > 0)).select(F.col("supersedes").alias("_s"), constraint_text(F.col("supersedes")).alias("_t"))
    rest = rest.join(ends.select("_s").hint("merge"), F.col("id") == F.col("_s"), "left_anti").join(ends.select("_t").hint("merge"), F.col("_text") == F.col("_t"), "left_anti")
    rest = Spool(rest, "rest").df
    long_rest = rest.filter(F.length("_text") >= LEAST_CONTAINED).select("_text").distinct()
    long_ends = Spool(ends.filter(F.length("_t") >= LEAST_CONTAINED).select("_t").distinct(), "ends").df
    met = contained(long_ends.toDF("part"), long_rest.toDF("whole")).select(F.col("whole").alias("_text")).unionByName(contained(long_rest.toDF("part"), long_ends.toDF("whole")).select(F.col("part").alias("_text")))
    rest = rest.join(met.distinct(), "_text", "left_anti")
    return new.select(*wanted).withColumn("inherited", F.lit(False)).unionByName(rest.select(*wanted).withColumn("inherited", F.lit(True)))
