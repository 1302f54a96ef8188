"""Points inside intervals, by equality: each interval lies in two buckets at most of the width that is the next power of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.lineage import cut, written
from loreweave.functions.ranking import ranked


def _level(length: Column) -> Column:
    """The least power of two, as an exponent, that is more than length."""
    return F.when(length <= 0, F.lit(0)).otherwise(F.length(F.bin(length))).cast("int")


def containing(intervals: DataFrame, points: DataFrame, first: str = "first", last: str = "last", at: str = "at") -> DataFrame:
    """Every row of intervals with every row of points whose at (a long) is in first to last, both ends included.

    A null first or last is open: the interval then reaches to the least or largest point. Intervals that end before they
    begin, and null points, meet nothing. An interval goes to the buckets of its width, a point to one bucket of each width that
    intervals have (64 at most), so bucket numbers alone bring them together; a third of what meets or more is kept.
    The tables' columns must have different names.
    """
    known = points.where(F.col(at).isNotNull())
    least, most = known.agg(F.min(at), F.max(at)).collect()[0]
    least, most = (0, -1) if least is None else (least, most)
    i = intervals.withColumn("_a", F.greatest(F.col(first), F.lit(least))).withColumn("_b", F.least(F.col(last), F.lit(most)))  # both pass nulls over
    i = i.where(F.col("_a") <= F.col("_b")).withColumn("_level", _level(F.col("_b") - F.col("_a")))
    levels = sorted(r["_level"] for r in i.select("_level").distinct().collect())  # 64 at most
    down = lambda x, n: F.call_function("shiftright", x, n)
    i = i.withColumn("_bucket", F.explode(F.array_distinct(F.array(down(F.col("_a"), F.col("_level")), down(F.col("_b"), F.col("_level"))))))
    each = F.array(*[F.struct(F.lit(n).alias("level"), down(F.col(at), F.lit(n)).alias("bucket")) for n in levels]) if levels else F.array().cast("array<struct<level:int,bucket:long>>")
    p = known.withColumn("_k", F.explode(each)).withColumn("_at", F.col(at)).withColumn("_level", F.col("_k.level")).withColumn("_bucket", F.col("_k.bucket")).drop("_k")
    met = i.join(p, ["_level", "_bucket"]).where((F.col("_a") <= F.col("_at")) & (F.col("_at") <= F.col("_b")))
    return met.drop("_a", "_b", "_at", "_level", "_bucket")


def open_at(intervals: DataFrame, points: DataFrame, first: str = "first", last: str = "last", at: str = "at") -> DataFrame:
    """at, n_open, earliest for every distinct point inside an interval: how many rows of intervals have it, as containing() has
    them, and the least first of these (null if all are open there).

    No point meets an interval. Begun less ended is what is open, and the earliest is the least first of all that end at the
    point or later: sums and minima along the times, in ranges apart and then over the ranges. So rows grow with both
    tables together, and a time that many share is one row.
    """
    known = points.where(F.col(at).isNotNull()).select(F.col(at).alias("t")).distinct()
    i = intervals.select(F.col(first).alias("first"), F.col(last).alias("last")).where("first is null or last is null or first <= last")
    row = lambda rows, t, kind, change, earliest: rows.select(t.cast("long").alias("t"), F.lit(kind).alias("kind"), change.cast("long").alias("change"), earliest.cast("long").alias("earliest"))
    least, most, none = F.lit(-(2**63)), F.lit(2**63 - 1), F.lit(None)
    turns = row(i, F.coalesce("first", least), 0, F.lit(1), none).unionByName(row(i, F.coalesce("last", most), 2, F.lit(-1), F.col("first")))
    turns = turns.groupBy("t", "kind").agg(F.sum("change").alias("change"), F.min("earliest").alias("earliest"))
    turns = turns.unionByName(row(known, F.col("t"), 1, F.lit(0), none))
    part = written(written(turns).repartitionByRange("t", "kind").withColumn("part", F.spark_partition_id()))
    sums = part.groupBy("part").agg(F.sum("change").alias("change"), F.min("earliest").alias("earliest"))
    before, after = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # a row per range
    sums = sums.select("part", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("ahead"), F.min("earliest").over(after).alias("behind"))
    up, down = Window.partitionBy("part").orderBy("t", "kind"), Window.partitionBy("part").orderBy(F.desc("t"), F.desc("kind"))
    told = part.withColumn("own", F.sum("change").over(up)).withColumn("next", F.min("earliest").over(down)).where("kind = 1").join(F.broadcast(sums), "part")
    told = told.select(F.col("t").alias(at), (F.col("own") + F.col("ahead")).alias("n_open"), F.least("next", "behind").alias("earliest")).where("n_open > 0")
    return told.withColumn("earliest", F.when(F.col("earliest") <= F.col(at), F.col("earliest")))


def active_at(related: DataFrame, times: DataFrame) -> DataFrame:
    """relationship_id and time_value for every relationship and every distinct time that its label equals or its start and
    end include (an end that is null is open; without a start only the label counts). Times compare as strings, by bytes.

    Strings become numbers in their order first, so containment needs no comparison of all pairs.
    """
    start, end, label = (F.col(f"story_time.time_{x}") for x in ("start", "end", "label"))
    t = times.select("time_value").where("time_value is not null").distinct()
    r = related.select("relationship_id", start.alias("start"), end.alias("end"), label.alias("label"))
    texts = t.select(F.col("time_value").alias("s")).unionByName(r.select(F.col("start").alias("s"))).unionByName(r.select(F.col("end").alias("s"))).where("s is not null").distinct()
    number = cut(ranked(texts, "s").select("s", F.col("rank").cast("long").alias("number")))
    of = lambda rows, c, to: rows.join(number.select(F.col("s").alias(c), F.col("number").alias(to)), c, "left")
    spans = of(of(r.where("start is not null"), "start", "first"), "end", "last").select("relationship_id", "first", "last")
    inside = containing(spans, of(t, "time_value", "at")).select("relationship_id", "time_value")
    named = r.join(t, F.col("label") == F.col("time_value")).select("relationship_id", "time_value")
    return inside.unionByName(named).distinct()
