"""Order-dependent numbers without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import Spool


def global_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Adds the place of every row in the order of all rows, from 1.

    Rows are range-partitioned on the order columns and written; the number of
    rows of earlier ranges is added to the place within a range.  Order columns
    should decide between all rows; equal rows get places in any order.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = Spool(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged").df
    sizes = ranged.groupBy("_range").count()  # one row per partition
    before = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_r", "_inside", "_before")


def position_in_group(df: DataFrame, group: str, order: list, name: str = "position") -> DataFrame:
    """Adds the place of every row within its group, from 1, for groups of any size."""
    placed = global_position(df, [F.col(group).asc_nulls_first(), *order], "_place")
    first = placed.groupBy(F.col(group).alias("_g")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_g", "_first", "_place")


def previous_value(df: DataFrame, group: str, order: str, tie: str, value: str, name: str, bucket: int = 1_000) -> DataFrame:
    """Adds the ``value`` of the row before, by ``order`` (an integer) then ``tie``, within ``group``.

    Orders are cut into buckets of ``bucket``: inside a bucket a window, at its
    first row the last row of the nearest earlier bucket.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / bucket))
    keys = Window.partitionBy(group, "_b").orderBy(order, tie)
    inside = b.withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(keys))
    ends = b.groupBy(group, "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(order, tie)).alias("_end"))
    prior = ends.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.lag("_end").over(Window.partitionBy(group).orderBy("_b")).alias("_prior"))
    joined = inside.join(prior, F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_bb")))
    return joined.withColumn(name, F.coalesce("_in", "_prior")["v"]).drop("_b", "_in", "_g", "_bb", "_prior")
