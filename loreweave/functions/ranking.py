"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.lineage import cut, written


def ranked(rows: DataFrame, *key: str) -> DataFrame:
    """rows with rank, from 0 in order of key, and total. Ranges of the key are counted apart and their counts added up."""
    part = rows.repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    part = cut(part.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1))
    sizes = {r["part"]: r["n"] for r in part.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, total = {-1: 0}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    return part.withColumn("rank", F.col("at") + shift[F.col("part")]).withColumn("total", F.lit(total)).drop("part", "at")


def running(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of their group that come before them in order (unique in a group).

    Ranges of (group, order) are summed up apart, then a group's sums by range, which are as few as ranges. So a group may
    have any number of rows.
    """
    own = Window.partitionBy("part", group).orderBy(order)
    part = written(rows.repartitionByRange(group, order).withColumn("part", F.spark_partition_id()))
    part = part.withColumn("own", F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = part.groupBy(group, "part").agg(F.sum(value).alias("s"))
    ahead = sums.select(group, "part", F.coalesce(F.sum("s").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return part.join(ahead, [group, "part"]).withColumn(name, F.col("own") + F.col("ahead")).select(*rows.columns, name)
