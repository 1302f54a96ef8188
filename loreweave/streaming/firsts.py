"""Running counts and first sights by key over a stream, kept as state; what they are now is a keyed log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreweave.sources.keyed_log import KeyedLog

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_firsts(rows: DataFrame, key: list[str], root: str, checkpoint: str) -> StreamingQuery:
    """rows is a stream with the key's columns, at and id (longs without nulls). Runs over what is there and ends. The log has,
    for a key, n: how many rows there were, and the least (at, id) of them, as first_at and first_id.

    State is Spark's own of a running aggregate, so a key costs no call of Python. It lies in the checkpoint by version, and a
    batch, which has a row per key that it touches, writes the log under its own number. So a batch that is run again starts from
    the state before it, and replaces what it wrote: counts are exactly once.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    log = KeyedLog(spark, root, key)
    held = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("at", "id")).alias("first"))
    told = held.select(*key, "n", F.col("first.at").alias("first_at"), F.col("first.id").alias("first_id"))
    return told.writeStream.outputMode("update").foreachBatch(lambda batch, number: log.write(number + 1, batch, ["n"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
