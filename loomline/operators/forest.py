"""Pointer doubling over parent links, as DataFrame rounds.

Each round doubles the number of ancestors a row has summed up, so a forest of
depth d takes about log2(d) rounds, each of two equi-joins on long keys.  No
round collects rows: only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import Spool


def climb(
    links: DataFrame,
    sums: tuple[str, ...] = (),
    mins: tuple[str, ...] = (),
    chains: tuple[str, ...] = (),
    sub_sums: tuple[str, ...] = (),
    sub_maxes: tuple[str, ...] = (),
    rounds: int | None = None,
) -> Spool:
    """Follow ``ptr`` from every ``node`` to the end of its path.

    links: ``node`` long (unique), ``ptr`` long or null (must name a node), and
    value columns.  Result, spooled: ``node``, ``top`` (last node reached),
    ``hops`` (steps taken), ``jump`` (null where the path ended, else the node
    lies on or below a loop), every ``sums`` column added up over the path (the
    node's own value included), ``mins`` minimised, ``chains`` (arrays)
    concatenated from the top down, ``sub_sums`` / ``sub_maxes`` folded over
    all rows below a node.  Rows on or below a loop keep partial values.

    Stops when no path is open or when a round closes none: depths in a forest
    are contiguous, so a round that closes no path proves that only loops are
    left.  With ``rounds`` given, exactly that many rounds run.
    """
    keep = [*sums, *mins, *chains, *sub_sums, *sub_maxes]
    state = Spool(
        links.select("node", F.col("ptr").alias("jump"), F.col("node").alias("top"), F.lit(0).cast("long").alias("hops"), *keep),
        "climb",
    )
    left, done = None, 0
    while True:
        now = state.df
        if rounds is None:
            open_rows = now.filter("jump is not null").count()
            if open_rows == 0 or open_rows == left:
                return state
            left = open_rows
        elif done == rounds:
            return state
        ahead = now.select(
            F.col("node").alias("_at"),
            F.col("jump").alias("_jump"),
            F.col("top").alias("_top"),
            F.col("hops").alias("_hops"),
            *(F.col(c).alias(f"_{c}") for c in (*sums, *mins, *chains)),
        )
        open_part = now.filter("jump is not null").join(ahead, F.col("jump") == F.col("_at"))
        moved = open_part.select(
            "node",
            F.col("_jump").alias("jump"),
            F.col("_top").alias("top"),
            (F.col("hops") + F.col("_hops") + 1).alias("hops"),
            *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums),
            *(F.least(F.col(c), F.col(f"_{c}")).alias(c) for c in mins),
            *(F.concat(F.col(f"_{c}"), F.col(c)).alias(c) for c in chains),
            *sub_sums,
            *sub_maxes,
        )
        fresh = moved.unionByName(now.filter("jump is null").select(moved.columns))
        if sub_sums or sub_maxes:
            below = (
                now.filter("jump is not null")
                .groupBy(F.col("jump").alias("_at"))
                .agg(*(F.sum(c).alias(f"_{c}") for c in sub_sums), *(F.max(c).alias(f"_{c}") for c in sub_maxes))
            )
            fresh = fresh.join(below, F.col("node") == F.col("_at"), "left").select(
                *(c for c in moved.columns if c not in sub_sums and c not in sub_maxes),
                *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sub_sums),
                *(F.greatest(F.col(c), F.col(f"_{c}")).alias(c) for c in sub_maxes),
            )
        after = Spool(fresh, "climb")
        state.drop()
        state, done = after, done + 1


def loop_minimum(links: DataFrame) -> DataFrame:
    """For rows on or below loops (``node``, ``ptr``, ``label``): the smallest label on the loop.

    After 2**k >= number of rows steps every pointer stands on its loop and the
    running minimum of a row on the loop covers the whole loop.
    """
    many = links.count()
    steps = max(1, many.bit_length() + 1)
    walked = climb(links, mins=("label",), rounds=steps).df
    on_loop = walked.select(F.col("node").alias("_at"), F.col("label").alias("loop_label"))
    return walked.select("node", "jump").join(on_loop, F.col("jump") == F.col("_at")).select("node", "loop_label")


def split_by_size(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with at most ``most`` rows, and the rest.

    The list of larger keys has at most rows/most entries; whether it is small
    enough to be sent everywhere is left to Spark, which knows its size.  Null
    keys form one group of their own.
    """
    large = Spool(df.groupBy(F.col(key).alias("_key")).count().filter(F.col("count") > most).select("_key"), "large").df
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def prefix_offsets(df: DataFrame, group: str, order: list, value: str, salt: str, buckets: int = 1024) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same ``group``, for groups of any size.

    Rows are spread over ``buckets`` by the hash of ``salt``; a first sum runs
    over the buckets of a group (at most ``buckets`` rows), a second inside one
    bucket, so no task sees a whole hot group.  The order is (bucket, order).
    """
    with_bucket = df.withColumn("_bucket", F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    per = with_bucket.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = per.select(
        F.col(group).alias("_group"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        with_bucket.withColumn("_inside", inside)
        .join(before, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("offset", F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_group", "_b", "_before", "_inside")
    )


def components(links: DataFrame) -> DataFrame:
    """``node``, ``least``: the smallest node of each connected component, for every node of the links (``a``, ``b``, longs).

    Alternates large stars (every greater neighbour goes to the least one) and
    small stars (so do the smaller ones) until no link changes: log rounds, each
    of a minimum per node, combined before it is shuffled, and an equi-join.
    """
    ends = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    now = Spool(links.filter("a <> b").select(*ends).distinct(), "stars")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        led = both.join(least, "u")
        moved = led.filter("v > u") if large else led.unionByName(least.select("u", F.col("u").alias("v"), "m"))
        return moved.filter("v <> m").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))).first())

    seen = mark(now.df)
    while True:
        after = Spool(star(star(now.df, True), False), "stars")
        now.drop()
        now, state = after, mark(after.df)
        if state == seen:
            break
        seen = state
    found = now.df
    return found.select(F.col("high").alias("node"), F.col("low").alias("least")).unionByName(found.select(F.col("low").alias("node"), F.col("low").alias("least")).distinct())
