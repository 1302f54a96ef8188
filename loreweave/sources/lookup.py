"""Tables laid out for lookups: rows lie in buckets by a hash of their key, sorted by it, with Bloom filters in the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class LookupTable:
    """A table by key below a folder. A lookup opens the buckets of its keys alone, and of their files the row groups whose
    Bloom filter or bounds may have them."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame) -> None:
        """Buckets that are too large for a task are split among several, each sorted by key."""
        dealt = rows.withColumn(BUCKET, self._bucket(F.col(self.key))).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, self.key)
        dealt.write.mode("overwrite").partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(self.root)

    def get(self, *keys: str) -> DataFrame:
        """The rows of some keys."""
        one = self.spark.createDataFrame([(k,) for k in keys], "k string")
        held = sorted({r["b"] for r in one.select(self._bucket(F.col("k")).alias("b")).collect()})
        return self.spark.read.parquet(self.root).where(F.col(BUCKET).isin(held) & F.col(self.key).isin(list(keys))).drop(BUCKET)

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows whose key a table of keys has (in the key's column), however many these are: they meet by bucket and key, and where the
        keys are few enough to be sent, Spark prunes the buckets by them."""
        asked = keys.select(self.key).distinct().withColumn(BUCKET, self._bucket(F.col(self.key)))
        return self.spark.read.parquet(self.root).join(asked, [BUCKET, self.key], "left_semi").drop(BUCKET)
